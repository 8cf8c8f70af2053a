"""Personal data and the terms that give it away.

Four kinds of entity are found by pattern: e-mail addresses, IP addresses, payment card numbers
(Luhn) and international phone numbers.  The ``CONTEXT`` words on either side of an entity, less those
that belong to an entity, are its context; a term is a word, lower-cased (A-Z).  Over the whole corpus,
with documents as the unit, a context term t discloses an entity e to the degree

    log(P(e | t) N / c(e)) / log(N / c(e)),   P(e | t) = (c(e, t) + S c(e) / N) / (c(t) + S),

that is PMI(e; t) / IC(e) with the conditional probability smoothed by ``S`` documents at independence:
1 at most, for a term that is seen with e only and often; 0 for one that tells nothing.  A term seen
once, with e, tells all but one bit of it, so in any corpus of more than a hundred documents it is above
``DISCLOSURE``; a term of many documents is below.  There is no count under which pairs are left out.
Terms at or above the threshold are generalised wherever they stand in a context of e.

Contexts are joined and counted as rows; only counts of terms of some context are taken over the
full corpus, from the terms' digests where their counted number allows a broadcast and from all
words otherwise.  Equal texts (by a 128-bit digest) share one set of context rows with a count.

Null or empty texts hold nothing.  Every input row gives one result row, repeated ids and null
ids included.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import arrow_map, signed, stored
from fieldloom.llm.text import blocks
from fieldloom.session import BROADCAST_BYTES, sized_broadcast

CONTEXT = 8
SMOOTHING = 1.0
DISCLOSURE = 0.85
KINDS = ["email", "ip", "card", "phone"]
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]")
SPAN = "array<struct<kind:string,start:int,end:int>>"
CONTEXTS = "array<struct<entity:bigint,term:bigint,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ is tried with the whole run of local characters before it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        tail = DOMAIN.match(text, at)
        if tail:
            start = at
            while start > last and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, tail.end()))
                last = tail.end()
        at = text.find("@", max(at + 1, last))
    return found


def find_entities(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind, then start, in code points."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if not DIGITS.search(text):
        return spans
    if "." in text:
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, in code points."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = np.concatenate([[False], ~((code == 32) | ((code >= 9) & (code <= 13))), [False]])
    return np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(~ink[1:] & ink[:-1])


def _context(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(entity, start, end) of the words on either side of each entity, without those that touch any."""
    starts, ends = _words(text)
    clear = np.ones(starts.size, bool)
    for _, a, b in spans:
        clear[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = False
    out = []
    for kind, a, b in spans:
        before, after = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b))
        near = [*range(max(0, before - CONTEXT), before), *range(after, min(starts.size, after + CONTEXT))]
        entity = f"{kind}:{text[a:b].lower()}"
        out += [(entity, int(starts[k]), int(ends[k])) for k in near if clear[k]]
    return out


def _digests(strings: list[str]) -> np.ndarray:
    parts = [b.hashes(b.bounds[:-1], b.bounds[1:]) for b in blocks(pa.array(strings, pa.string()), lower=True)]
    return signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def text_digest(text_col: str) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, spans, contexts) of every row; entities and terms of contexts as 64-bit digests."""

    def run(batch):
        texts = batch.column("text").to_pylist()
        spans = [find_entities(t) if t else [] for t in texts]
        near = [_context(t, x) if x else [] for t, x in zip(texts, spans)]
        bounds = np.append(0, np.cumsum([len(x) for x in near]))
        entity = _digests([e for x in near for e, _, _ in x])
        term = _digests([t[a:b] for t, x in zip(texts, near) for _, a, b in x])
        place = np.array([(a, b) for x in near for _, a, b in x], np.int32).reshape(-1, 2)
        context = pa.StructArray.from_arrays(
            [pa.array(entity), pa.array(term), pa.array(place[:, 0]), pa.array(place[:, 1])], ["entity", "term", "start", "end"])
        yield {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "spans": _spans(spans),
               "contexts": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), context)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("digest", text_digest("text"))
    return arrow_map(rows, run, {"doc_id": "long", "digest": "binary", "spans": SPAN, "contexts": CONTEXTS})


def _spans(lists: list) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in lists], pa.list_(kind))


def document_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, ct): documents of the whole corpus that have each of the distinct ``terms``."""
    few = terms.count() * 8 <= BROADCAST_BYTES
    wanted = None
    if few:
        found = np.sort(terms.select("term").toArrow().column("term").to_numpy())
        wanted = docs.sparkSession.sparkContext.broadcast(found)

    def run(batch):
        for block in blocks(batch.column("text"), lower=True):
            words = signed(block.find_words().word_hashes())
            text = np.repeat(np.arange(block.n), np.diff(block.first))
            if wanted is None:
                list_, at = np.unique(words, return_inverse=True)
            else:
                list_ = wanted.value
                at = np.searchsorted(list_, words)
                at[at == list_.size] = 0
                hit = list_[at] == words if list_.size else np.zeros(words.size, bool)
                text, at = text[hit], at[hit]
            each = np.unique(text * max(list_.size, 1) + at)
            n = np.bincount(each % max(list_.size, 1), minlength=list_.size)
            yield {"term": list_[n > 0], "n": n[n > 0]}

    rows = arrow_map(docs.select(F.col(text_col).alias("text")), run, {"term": "long", "n": "long"})
    counts = rows.groupBy("term").agg(F.sum("n").alias("ct"))
    return counts if few else counts.join(terms.select("term"), "term", "left_semi")


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((entity, term) pairs above the threshold, context rows of each distinct text)."""
    texts = found.where(F.size("contexts") > 0).groupBy("digest").agg(F.count("*").alias("m"), F.first("contexts").alias("x"))
    near = stored(texts.select("digest", "m", F.inline("x")))
    once = near.select("digest", "m", "entity", "term").distinct()
    pairs = stored(once.groupBy("entity", "term").agg(F.sum("m").alias("c")))
    counts = document_frequencies(docs, pairs.select("term").distinct(), text_col)
    whole = near.select("digest", "m", "entity").distinct().groupBy("entity").agg(F.sum("m").alias("ce"))
    scored = pairs.join(counts, "term").join(whole, "entity")
    n = F.lit(float(found.count()))
    return scored.where(disclosure(n) >= DISCLOSURE).select("entity", "term"), near


def disclosure(n: Column) -> Column:
    """Degree to which a term discloses an entity, from the counts c, ce, ct; 0 where every document has it."""
    given = (F.col("c") + SMOOTHING * F.col("ce") / n) / (F.col("ct") + SMOOTHING)
    return F.when(F.col("ce") < n, F.log(given * n / F.col("ce")) / F.log(n / F.col("ce"))).otherwise(0.0)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, spans, terms): entity spans and spans of disclosing terms of every row."""
    found = stored(entities(docs, id_col, text_col))
    pairs, near = disclosing_terms(found, docs, text_col)
    terms = near.join(pairs, ["entity", "term"]).select("digest", F.struct(F.lit("term").alias("kind"), "start", "end").alias("span"))
    terms = terms.distinct().groupBy("digest").agg(F.array_sort(F.collect_list("span")).alias("terms"))
    empty = F.array().cast(SPAN)
    return found.select("doc_id", "digest", "spans").join(terms, "digest", "left").select(
        "doc_id", "digest", "spans", F.coalesce("terms", empty).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans give one mark."""
    spans = find_personal_data(docs, id_col, text_col).select("digest", F.concat("spans", "terms").alias("_spans"))
    spans = stored(spans.where(F.size("_spans") > 0).dropDuplicates(["digest"]))
    spans = sized_broadcast(spans.withColumnRenamed("digest", "_digest"), spans.count(), 512)
    joined = docs.withColumn("_digest", text_digest(text_col)).join(spans, "_digest", "left").drop("_digest")

    def run(batch):
        texts = [_masked(t, s) if s else t for t, s in zip(batch.column(text_col).to_pylist(), batch.column("_spans").to_pylist())]
        yield {n: pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in batch.schema.names[:-1]}

    return arrow_map(joined, run, {f.name: f.dataType.simpleString() for f in docs.schema})


def _masked(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]
