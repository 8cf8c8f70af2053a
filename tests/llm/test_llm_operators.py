"""Every operator against a plain Python version, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldloom.llm import (byte_bpe, decontaminate, licences, ngram_join, ppm, quality_rules, sanitise, sharding,
                           substring_dedup, suffix_dedup)

rng = random.Random(7)
VOCAB = [f"w{k}" for k in range(300)] + ["the", "of", "É", "ß", "中文", "x y"]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text: str, places: int) -> str:
    w = text.split(" ")
    for _ in range(places):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


BASE = prose(200)
LONG = "\n".join(prose(40) for _ in range(120))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "one two"), (7, BASE), (8, BASE), (9, BASE.upper()),
    (10, edited(BASE, 1)), (11, edited(BASE, 2)), (12, edited(BASE, 3)), (13, edited(BASE, 12)), (14, LONG),
    (15, edited(LONG, 20)), (16, prose(30) + " " + BASE[:400] + " " + prose(30)), (17, prose(60)), (18, prose(4)),
    (19, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (20, "a" * 300),
    (21, "a" * 120), (22, "line\nline\n\nline\r\n#$ %&|<>*"), (23, prose(35)), (24, "don't  we'll\n\n x  9९ é"),
]
ROWS += [(100 + k, edited(BASE, k % 5)) for k in range(30)]


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_jaccard_components(make):
    got = collected(ngram_join.jaccard_components(make(ROWS)))
    assert got == brute.jaccard_components(ROWS)


def test_jaccard_null_and_repeated_ids(make):
    rows = [(None, BASE), (7, BASE), (7, BASE), (7, "other words in this row"), (3, "other words in this row"), (9, edited(BASE, 1))]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.jaccard_components(make(rows)).collect())
    assert got == [(-1, -1), (3, 3), (7, 3), (7, 7), (7, 7), (9, 7)]


def test_components_of_a_chain(spark):
    from fieldloom.llm.shared import components

    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges, "a", "b").select("root").distinct().count() == 1


def test_substring_dedup(make):
    cut = substring_dedup.remove_repeats(make(ROWS))
    got = collected(cut.select("doc_id", "n_words", "n_removed", "kept"))
    assert got == brute.kept_words(ROWS)


def test_suffix_dedup(make):
    cut = suffix_dedup.remove_repeats(make(ROWS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    got = {k: (*v[:3], bytes(v[3])) for k, v in collected(cut).items()}
    assert got == brute.kept_bytes(ROWS)


def test_blind_trie_order():
    for _ in range(300):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 9))]
        order, lcp = suffix_dedup.blind_trie(strings)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for k in range(1, len(got)):
            a, b = got[k - 1], got[k]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == same


def test_shallow_and_deep_sort():
    """Groups of strings with long common prefixes, ends at every depth and zero bytes, against plain sorting."""
    import numpy as np

    own = random.Random(4)
    for _ in range(200):
        groups = [[bytes(own.choice([0, 97, 98]) for _ in range(own.choice([0, 1, 7, 8, 9, 14]))) for _ in range(own.randint(1, 9))]
                  for _ in range(own.randint(1, 6))]
        groups[0] += [b"same prefix here" + bytes([own.randrange(3)]) * own.randint(0, 3) for _ in range(6)]
        flat = [s for g in groups for s in g]
        which = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        order, lcp = suffix_dedup.sort_suffixes(which, np.array([len(s) for s in flat]), np.frombuffer(b"".join(flat), np.uint8))
        assert [(which[i], flat[i]) for i in order] == [(k, s) for k, g in enumerate(groups) for s in sorted(g)]
        for k in range(1, len(flat)):
            a, b = flat[order[k - 1]], flat[order[k]]
            if which[order[k - 1]] == which[order[k]]:
                assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_suffix_dedup_of_hot_grams(make):
    """A phrase in all texts with varied surroundings, some of which repeat: by windows, without gathering it."""
    own = random.Random(6)
    word = lambda n: "".join(own.choice("abcdefgh") for _ in range(n))
    phrase = "this phrase stands in every text "
    around = [word(40) for _ in range(15)]
    rows = [(k, f"{own.choice(around)} {phrase}{own.choice(around)} {word(10)} {phrase} {phrase}{word(60)}") for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(20)] + [(None, rows[3][1] + "x"), (5, word(30) + rows[7][1])]
    rows = [(i, t) for i, t in rows if i is not None or t]
    plain = {i: t for i, t in rows if i not in (5, None)}
    want = brute.kept_bytes(list(plain.items()))
    for hot in (4, suffix_dedup.HOT):
        cut = suffix_dedup.remove_repeats(make(list(plain.items())), hot=hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.collect()}
        assert got == want
    odd = [sorted(((r.doc_id or -1, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(make(rows), hot=h).collect()))
           for h in (4, suffix_dedup.HOT)]
    assert odd[0] == odd[1] and len(odd[0]) == len(rows)


def test_merges_equal_the_library():
    from fieldloom.llm.bpe_merge import encoded, merges_of

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéß 中\n\t!?0123"
    words = ["".join(own.choice(letters) for _ in range(own.randint(1, 14))).encode() for _ in range(20_000)]
    words += [b"a" * k for k in range(1, 700, 7)] + [bytes(own.randrange(256) for _ in range(own.randint(1, 400))) for _ in range(200)]
    words += [b"", " ".join(VOCAB).encode()]
    got = encoded(merges_of(ranks), words)
    assert [g.tolist() for g in got] == [coder._encode_single_piece(w) if w else [] for w in words]


def test_byte_bpe(make):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = "'’ab strevldm  \n\t\r\x0b\x1c\x85 éß中0९½!?#_-​\U0001F600́S"
    rows = ROWS + [(1000 + k, "".join(rng.choice(letters) for _ in range(40))) for k in range(200)] + [(None, "null id")]
    coded = byte_bpe.encode(make(rows), path)
    for doc_id, ids, decoded in byte_bpe.decode(coded, path).collect():
        text = dict(rows)[doc_id] or ""
        want = coder.encode_ordinary(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
        assert bytes(decoded).decode() == text


def test_ppm(make):
    df = make(ROWS)
    got = collected(ppm.score(df, order=3, share=400))
    train = [(i, t) for i, t in ROWS if zlib.crc32(str(i).encode()) % 10]
    model = brute.Ppm([t for _, t in train], 3, 400)
    c: Counter = Counter()
    for _, t in train:
        c.update(brute.words(brute.lower(t or "")))
        c[None] += 1
    n = sum(c.values())
    for i, t in ROWS:
        w = [*brute.words(brute.lower(t or "")), None]
        held, tokens, known, total, base, score = got[i]
        assert (held, tokens, known, total) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert base == pytest.approx(sum(log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w))
        assert score == pytest.approx(model.log10(t), rel=1e-5)


def test_ppm_keeps_every_context(make):
    """Contexts met once among 2**18 symbols or more are nodes too, and repeated ids keep their rows."""
    once = "qzx jkv wqj"
    rows = [*ROWS, (200, once), (201, once), (None, None), (7, once)] + [(300 + k, prose(9000)) for k in range(12)]
    got = sorted((r.doc_id or -1, r.score) for r in ppm.score(make(rows), held_out="coalesce(doc_id, 0) IN (13, 201)").collect())
    model = brute.Ppm([t for i, t in rows if i not in (13, 201)], 6, 1 << 60)
    few = [(i, s) for i, s in got if i < 300]
    assert [i for i, _ in few] == sorted(i or -1 for i, _ in rows if (i or -1) < 300)
    want = sorted((i or -1, model.log10(t)) for i, t in rows if (i or -1) < 300)
    assert [s for _, s in few] == pytest.approx([s for _, s in want], rel=1e-5)


def test_ppm_is_a_distribution():
    import numpy as np

    counts = {"k": [0, 0, 0, 1, 1], "context": [0, 0, 0, 97, 97], "symbol": [97, 98, 10, 98, 10], "n": [5, 3, 2, 3, 1]}
    model = ppm.Model({k: np.array(v, np.int64) for k, v in counts.items()}, 1)
    others = 256 - (model.width - 1)
    mass = 10.0 ** model.logp[: model.dead].astype(float)
    assert mass[:, :-1].sum(1) + others * mass[:, -1] == pytest.approx([1.0, 1.0], rel=1e-6)


MAIL, IP, CARD, PHONE = "ann.b@mail.example.com", "10.20.255.1", "4111 1111 1111 1111", "+44 (20) 7946-0958"


def personal_rows():
    rows = [
        (1, None), (2, ""), (3, f"write {MAIL}, or {IP} now"), (4, f"card {CARD} and 4111111111111112 not"),
        (5, f"call {PHONE}."), (6, "256.1.1.1 and 1.2.3.4.5.6.7.8 and @x.y a@b a@b.c@d.e +1 23"), (7, "é" * 5 + f" {MAIL}"),
        (8, "1" * 5000 + ".1.1.1"), (9, "x@" * 200 + "y.z"), (None, MAIL), (3, f"again {MAIL}"),
    ]
    rows += [(20 + k, f"{prose(30)} agent zorblax met {MAIL} with nadirium today {prose(20)}") for k in range(6)]
    return rows + [(40 + k, prose(60)) for k in range(40)]


def test_personal_data_spans(make):
    import re

    def base(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
            if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
                out.append(("card", *m.span()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
        return out

    rows = personal_rows()
    found = sanitise.find_personal_data(make(rows)).collect()
    assert len(found) == len(rows)
    got = sorted((r.doc_id or -1, [tuple(s) for s in r.spans]) for r in found)
    assert got == sorted((i or -1, base(t or "")) for i, t in rows)


def plain_terms(rows):
    """Spans of disclosing terms by the formula, with dictionaries of documents."""
    from math import log

    full = [(i, t or "") for i, t in rows]
    spans = [[(k, a, b) for k, a, b in sanitise.find_entities(t)] for _, t in full]
    near = []
    for (_, t), found in zip(full, spans):
        words = [m.span() for m in brute.WORD.finditer(t)]
        mine = []
        for k, a, b in found:
            left = [w for w in words if w[1] <= a][-sanitise.CONTEXT :]
            right = [w for w in words if w[0] >= b][: sanitise.CONTEXT]
            mine += [(f"{k}:{t[a:b].lower()}", brute.lower(t[x:y]), x, y) for x, y in left + right
                     if not any(x < d and c < y for _, c, d in found)]
        near.append(mine)
    n, ce, ct, c = len(full), Counter(), Counter(), Counter()
    for (_, t), mine in zip(full, near):
        ct.update(set(brute.words(brute.lower(t))))
        ce.update({e for e, *_ in mine})
        c.update({(e, w) for e, w, _, _ in mine})
    out = []
    for (i, _), mine in zip(full, near):
        told = set()
        for e, w, x, y in mine:
            given = (c[e, w] + sanitise.SMOOTHING * ce[e] / n) / (ct[w] + sanitise.SMOOTHING)
            if ce[e] < n and log(given * n / ce[e]) / log(n / ce[e]) >= sanitise.DISCLOSURE:
                told.add((x, y))
        out.append((i or -1, sorted(told)))
    return sorted(out)


def test_disclosing_terms(make):
    """All rows against the formula: entities in one text, in two, in equal copies, long words, several in a row."""
    long = "q" * 700
    rows = personal_rows()
    rows += [(400, f"only {long} here 10.9.8.7 {'z' * 300} the of"), (401, "the of 10.9.8.7 wexil"), (402, f"twin plorv {PHONE} {MAIL} quam the"),
             (403, f"twin plorv {PHONE} {MAIL} quam the"), (404, f"x{MAIL}y,{IP} edge"), (405, MAIL)]
    rows += [(200 + k, prose(30)) for k in range(200)]
    found = sanitise.find_personal_data(make(rows)).collect()
    got = sorted((r.doc_id or -1, [(s.start, s.end) for s in r.terms]) for r in found)
    assert got == plain_terms(rows)
    texts = dict(rows)
    words = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms} for r in found}
    assert {"zorblax", "nadirium"} <= words[20] and long in words[400] and "wexil" in words[401] and "plorv" in words[402]
    assert not any(words[200 + k] for k in range(200)) and "of" not in words[401]


def test_sanitise(make):
    df = make(personal_rows() + [(300 + k, prose(40)) for k in range(100)])
    out = sanitise.sanitise(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.where("doc_id IN (4, 5, 20)").collect()}
    assert "[CARD]" in text[4] and CARD not in text[4] and "[PHONE]." in text[5]
    assert MAIL not in text[20] and "zorblax" not in text[20] and "[TERM]" in text[20]


def rule_rows():
    hot = "Buy now at this shop and save twenty percent of it all today"
    rows = [(k, f"{hot}\n{prose(60)}", "h") for k in range(12)]
    rows += [(20 + k, f"{prose(10)}\n{hot}\n{hot}\n{hot}\n{hot}\n{prose(10)}", "h") for k in range(3)]
    rows += [(30, BASE, "h"), (31, BASE, "h"), (32, "cut " * 80, None), (33, None, "h"), (34, "", None), (35, LONG, "g")]
    rows += [(36, f"  BUY now  at this shop and save twenty percent of it all TODAY \n{prose(70)}", "h")]
    return rows + [(37, ROWS[21][1] * 3, "g"), (None, prose(55), None), (30, BASE, "h")]


def plain_rules(rows):
    lines = {}
    for _, t, h in rows:
        for x in {" ".join(brute.words(x.lower())) for x in (t or "").split("\n")} - {""}:
            lines.setdefault((h or "", x), set()).add(t)
    hosts = {h or "": {t or "" for _, t, g in rows if (g or "") == (h or "")} for _, _, h in rows}
    over = {k for k, v in lines.items() if len(v) >= 10 and 100 * len(v) > 5 * len(hosts[k[0]])}
    out = []
    for i, t, h in rows:
        w, full = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + o for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for o in range(3)}
        lost = sum(len(brute.words(x)) for x in full if (h or "", " ".join(brute.words(x.lower()))) in over)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(rep),
                    failed, lost, not failed and 2 * (len(w) - lost) >= len(w)))
    return out


def test_quality_rules(make):
    rows = rule_rows()
    got = [tuple(r) for r in quality_rules.apply_rules(make(rows)).drop("host", "digest").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(plain_rules(rows), key=key)
    assert any(r[7] and not r[8] for r in got) and any(r[7] and r[8] for r in got)


def test_cleaned_text(make):
    rows = rule_rows()
    df = make(rows)
    out = quality_rules.clean(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[30] == BASE and got[3] == rows[3][1].split("\n")[1] and 20 not in got and 33 not in got
    assert out.count() == sum(r[-1] for r in plain_rules(rows))


ITEMS = [(k, prose(20 + k)) for k in range(12)] + [(50, None), (51, "too short item"), (52, "")]


def test_leaks(spark, make):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    items = dict(ITEMS)
    rows = [(1, f"{prose(50)} {items[3]} {prose(9)}"), (2, items[4].upper() + "!"), (3, prose(400)), (4, None), (5, ""),
            (6, f"{prose(9)} {' '.join(items[7].split(' ')[:-1])} {prose(9)}"), (7, " ".join(items[5].split(" ")[:12])),
            (None, items[2]), (8, f"{items[0]}\n{items[0]}"), (8, f"{items[0]}\n{items[0]}"), (9, items[9].replace(" ", "  ,"))]
    found = decontaminate.leaked_items(decontaminate.find_leaks(make(rows), bench)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 3), (2, 4), (6, 7), (None, 2), (8, 0), (9, 9)}
    assert {r.doc_id: r.n_windows for r in found}[8] == 2
    assert all(r.similarity == 1 for r in found if r.doc_id in (1, 2, 8, 9))


def test_leaks_edited_at_the_end(spark, make):
    """Similarity of 0.80 to 0.85: end words replaced or cut off.  Fingerprints miss one in a thousand at most."""
    own = random.Random(3)
    text = lambda n: [f"u{own.randrange(10**9)}" for _ in range(n)]
    items, rows = [], []
    for words, lost, replaced in ((40, 4, True), (60, 5, True), (60, 6, True), (60, 9, False), (60, 11, False)):
        for _ in range(120):
            item = text(words)
            rows.append((len(items), " ".join([*text(20), *item[: words - lost], *(text(lost + 20) if replaced else [])])))
            items.append((len(items), " ".join(item)))
    found = decontaminate.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert all(a == b for a, b in pairs) and len(pairs) >= 0.99 * len(items)
    assert all(0.8 <= r.similarity < 0.85 for r in found)


def test_leaks_of_templated_items(spark, make):
    """Items of one template: every shared shingle places a window, and only those near enough match."""
    own = random.Random(8)
    frame = [f"t{k}" for k in range(40)]
    items, rows = [], []
    for k in range(60):
        w = list(frame)
        for at in [39] if k % 2 else own.sample(range(40), 1 + k % 6):
            w[at] = f"v{own.randrange(12)}"
        items.append((k, " ".join(w)))
        rows.append((k, " ".join([*(f"d{own.randrange(10**6)}" for _ in range(15)), *w[: 40 - k % 4], "tail", "end"])))
    found = decontaminate.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.similarity) for r in decontaminate.leaked_items(found).collect()}
    want = brute.leaks(rows, items)
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want) and len(want) > 200
    assert all(got[k] == (want[k][0], want[k][1], pytest.approx(want[k][2], abs=1e-6)) for k in got)


def test_hamming_blocks_find_all_within_radius(spark):
    from pyspark.sql import functions as F

    signed = lambda x: x - (1 << 64) * (x >> 63)
    halves = lambda x: [signed(x & (2**64 - 1)), signed(x >> 64)]
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(decontaminate.BITS)
        b = a
        for bit in rng.sample(range(decontaminate.BITS), decontaminate.RADIUS):
            b ^= 1 << bit
        pairs.append((halves(a), halves(b)))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>").withColumn("id", F.monotonically_increasing_id())
    left = df.select("id", decontaminate._blocks("a"))
    right = df.select("id", decontaminate._blocks("b"))
    assert left.join(right, ["id", "block", "value"]).select("id").distinct().count() == 200
    assert {r[0] for r in df.select(decontaminate._distance("a", "b")).collect()} == {decontaminate.RADIUS}


def test_sharding(make):
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert sorted(Counter(table).values()) == [33, 34, 34]
    fewer = sharding.lookup_table(["a", "c"], 101)
    assert sum(x != y for x, y in zip(table, fewer) if x != "b") <= 20
    placed = sharding.place(make([*ROWS, (None, "x"), (7, "again")]), ["a", "b", "c"], 101)
    assert placed.count() == len(ROWS) + 2
    for r in placed.collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    for shards, slots in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_licences(spark, make):
    mit, bsd = licences.KNOWN["MIT"][2], licences.KNOWN["BSD-3-Clause"][0]
    wrapped = mit.replace(", ", ",\n")
    rows = [(1, f"Copyright (c) 2001 A. Nobody\n{mit.lower()}"), (2, f"{prose(9)}\nReleased under the mit licence\n{prose(9)}"),
            (3, "Licenced under the Apache License - Version 2.0"), (4, None), (5, ""), (6, "Copyright 2000"), (None, mit),
            (7, prose(80)), (2, "Released under the MIT License."), (8, mit + " and more"),
            (9, f"The MIT License (MIT)\n\nCopyright (c) 1999 B\n\n{wrapped}\n"), (10, f"# {prose(12)}\n{prose(30)}\n{wrapped}\n{bsd}\n{prose(9)}"),
            (11, "MIT License"), (12, f"ISC License\n\n© 2020 C\n{licences.KNOWN['ISC'][0]}"), (13, f"{mit}\n{mit}\n{prose(5)}"),
            (14, "Permission is hereby granted, free of\nnothing"), (15, f"x {mit}")]
    got = licences.scan(make(rows), licences.known_licences(spark)).collect()
    assert {(r.doc_id, r.license_id, r.whole_text) for r in got} == {
        (1, "MIT", True), (2, "MIT", True), (3, "Apache-2.0", True), (None, "MIT", True), (9, "MIT", True), (10, "MIT", False),
        (10, "BSD-3-Clause", False), (12, "ISC", True), (13, "MIT", False)}
    assert all(r.n_units == 1 for r in got)


def test_licences_of_a_folder(spark, make, tmp_path):
    """Full texts read from files, one of them long, found whole, wrapped otherwise, and inside a larger text."""
    long = "\n".join(f"{k}. {prose(40)}" for k in range(300))
    (tmp_path / "Long-1.0.txt").write_text(f"Long License\nCopyright 1990 Some Body\n\n{long}\n")
    (tmp_path / "Short").write_text("Do what you like with it.\n")
    known = licences.read_licences(spark, str(tmp_path))
    assert {r.license_id for r in known.collect()} == {"Long-1.0", "Short"}
    again = " ".join(long.split()).replace(". ", ".\n")
    rows = [(1, f"Long License\n{again}"), (2, f"{prose(500)}\nlong LICENSE\n{long}\n{prose(9)}"), (3, long[:-40]), (4, "do what you like\nwith it")]
    got = {(r.doc_id, r.license_id, r.whole_text) for r in licences.scan(make(rows), known).collect()}
    assert got == {(1, "Long-1.0", True), (2, "Long-1.0", False), (4, "Short", True)}


def test_licences_in_a_very_long_text(spark, make):
    rows = [(1, "\n".join([*(prose(12) for _ in range(40_000)), licences.KNOWN["Zlib"][0], prose(5)]))]
    got = licences.scan(make(rows, clash=False), licences.known_licences(spark)).collect()
    assert [(r.doc_id, r.license_id, r.n_units, r.whole_text) for r in got] == [(1, "Zlib", 1, False)]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    results = [
        ngram_join.jaccard_components(empty), substring_dedup.remove_repeats(empty), suffix_dedup.remove_repeats(empty),
        byte_bpe.encode(empty, path), ppm.score(empty), sanitise.find_personal_data(empty),
        sanitise.sanitise(empty), quality_rules.apply_rules(empty), quality_rules.clean(empty), sharding.place(empty),
        licences.scan(empty, licences.known_licences(spark)), decontaminate.find_leaks(empty, full),
        decontaminate.find_leaks(empty, bench),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    assert decontaminate.find_leaks(spark.createDataFrame([(1, BASE)], "doc_id long, text string"), bench).count() == 0


def test_very_long_text(spark, make):
    """One text of some megabytes, longer than a block, beside short ones that share parts of it."""
    long = "\n".join(prose(60) for _ in range(6000))
    part = long[1_000_000:1_000_900]
    rows = [(1, "x"), (2, long), (3, part), (4, long + " end"), (5, prose(70))]
    df = make(rows, clash=False)
    n = len(brute.words(long))
    assert {r.doc_id: r.n_words for r in quality_rules.apply_rules(df).collect()}[2] == len(brute.words(long))
    groups = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert cut[2].n_words == n == cut[2].n_removed and cut[4].n_removed == n and cut[4].kept == "end"
    spans = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert spans[2].n_removed == 0 and spans[4].n_bytes - spans[4].n_removed == 4
    assert spans[3].n_removed == spans[3].n_bytes == len(part.encode())
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(df, path, decoded=True)
    assert {r.doc_id: bytes(r.decoded).decode() for r in coded.where("doc_id IN (2, 3)").collect()} == {2: long, 3: part}
    scores = {r.doc_id: r for r in ppm.score(df, held_out="doc_id = 4").collect()}
    assert scores[2].n_tokens == n + 1 and scores[4].n_known == n + 1
    assert sanitise.find_personal_data(df).where("size(spans) > 0").count() == 0
    bench = spark.createDataFrame([(0, long[500_000:500_300].strip())], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(df, bench).collect()} == {2, 4}


def test_ppm_counts_without_places():
    """Grams, their counts in marked texts and those of short contexts, against plain dictionaries."""
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.choice(np.frombuffer(b"ab \xc3\n", np.uint8), 900)
    data[-1] = ppm.END
    marked, code = rng.random(900) < 0.6, ppm._grams(data, 6)
    grams, short, start = Counter(), Counter(), 0
    for i, c in enumerate(code):
        k = min(i - start + 1, 6)
        context = bytes([ppm.END] * 6 + data.tolist())[i + 6 - k : i + 7][::-1]
        assert int(c) == int.from_bytes(context, "little") | k << 56
        grams[int(c)] += int(marked[i])
        for j in range(min(k, 2) + 1):
            short[int.from_bytes(context[: j + 1], "little") | j << 56] += int(marked[i])
        start = i + 1 if data[i] == ppm.END else start
    u, n = ppm._tally(code, marked)
    assert dict(zip(u.tolist(), n.tolist())) == dict(grams) and (np.diff(u) > 0).all()
    u, n = ppm._short(u, n, 2)
    assert dict(zip(u.tolist(), n.tolist())) == {k: v for k, v in short.items() if v} and (np.diff(u) > 0).all()
