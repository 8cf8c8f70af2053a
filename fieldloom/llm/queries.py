"""Registered queries of this package: thin digests of the operators, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import byte_bpe, conversation_repair, decontaminate, licences, merkle, ngram_join, ppm, quality_rules, sanitise, sharding, simhash_trees, substring_dedup, suffix_dedup
from fieldloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.leaked_items(leaks)


@query
def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_personal_data(table(spark, sf_dir, "documents"))
    told = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in sanitise.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(told.format("spans")), 256).alias("base_sha256"),
        F.expr(told.format("concat(spans, terms)")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@query
def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


ORACLES["op4_shard_placement"] = sharding.placement_sql()


@query
def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return rules.drop("host", "digest")


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select(
        "doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


ORACLES["op7_licence_scan"] = licences.scan_sql()


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_line_frequency_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(source, '') host, coalesce(text, '') t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) l FROM d),
wins AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) i FROM w)),
rep AS (
  SELECT r, count(DISTINCT i + o) n
  FROM (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, k) > 1), (SELECT unnest([0, 1, 2]) o) GROUP BY r),
lines AS (
  SELECT r, host, t, array_to_string(regexp_extract_all(lower(l), '[^ \t\n\x0B\f\r]+'), ' ') line,
         len(regexp_extract_all(l, '[^ \t\n\x0B\f\r]+')) n
  FROM (SELECT r, host, t, unnest(l) l FROM w)),
over AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) n FROM lines GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT t) a FROM d GROUP BY host) USING (host)
  WHERE n >= {quality_rules.MIN_DOCUMENTS} AND 100 * n > {quality_rules.MAX_SHARE} * a),
lost AS (SELECT r, sum(n)::BIGINT n FROM lines JOIN over USING (host, line) GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
         coalesce(rep.n, 0)::BIGINT n_repeat_words, coalesce(lost.n, 0)::BIGINT n_removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words)
       AND 100 * (n_words - n_removed) >= {quality_rules.MIN_KEPT} * n_words AS kept
FROM c"""

# Exact similarity of all placed windows; the fingerprints only propose candidates.
ORACLES["op1_benchmark_leaks"] = rf"""
WITH words AS (
  SELECT 'd' kind, doc_id id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}} \t\n\x0B\f\r]+', '', 'g'), '[^ \t\n\x0B\f\r]+') w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}} \t\n\x0B\f\r]+', '', 'g'), '[^ \t\n\x0B\f\r]+') FROM benchmark),
s AS (
  SELECT kind, id, i, array_to_string(w[i + 1:i + 5], ' ') s
  FROM (SELECT kind, id, w, unnest(range(0, len(w) - 4)) i FROM words WHERE len(w) >= 5)),
item AS (SELECT id, i, s FROM s WHERE kind = 'i'), doc AS (SELECT id, i, s FROM s WHERE kind = 'd'),
n_items AS (SELECT count(*) n FROM words WHERE kind = 'i' AND len(w) >= 5),
weight AS (SELECT s, round(1000 * ln(1 + n / count(DISTINCT id)))::BIGINT weight FROM item, n_items GROUP BY s, n),
size AS (SELECT kind, id, len(w) n FROM words),
win AS (
  SELECT DISTINCT doc.id doc_id, item.id item_id, greatest(doc.i - item.i, 0) a, least(doc.i - item.i + si.n, sd.n) b
  FROM doc JOIN item USING (s) JOIN size sd ON sd.kind = 'd' AND sd.id = doc.id JOIN size si ON si.kind = 'i' AND si.id = item.id),
has AS (
  SELECT DISTINCT doc_id, item_id, a, b, s FROM win JOIN doc ON doc.id = doc_id AND doc.i >= a AND doc.i + 5 <= b),
of_item AS (SELECT id item_id, sum(weight) w FROM (SELECT DISTINCT id, s FROM item) JOIN weight USING (s) GROUP BY id),
score AS (
  SELECT has.doc_id, has.item_id, a, b, sum(coalesce(weight, round(1000 * ln(1 + n))::BIGINT)) of_window,
         sum(CASE WHEN mine.s IS NOT NULL THEN weight ELSE 0 END) common
  FROM has CROSS JOIN n_items LEFT JOIN weight USING (s)
  LEFT JOIN (SELECT DISTINCT id, s FROM item) mine ON mine.id = has.item_id AND mine.s = has.s GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS n_windows, min(a)::BIGINT AS first_word, round(max(common / (of_window + w - common)), 6) AS similarity
FROM score JOIN of_item USING (item_id)
WHERE 100 * common >= {decontaminate.PERCENT} * (of_window + w - common) GROUP BY doc_id, item_id"""


@query
def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trees.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    done = conversation_repair.repair(damaged, present_col="present")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    columns = ["conv_id", *conversation_repair.REPORT, "repaired_sha256"]
    whole = done.whole.withColumn("repaired_sha256", F.sha2(lines, 256)).select(columns)
    digest = conversation_repair.digests(done.chunks).withColumnRenamed("conv_id", "c")
    return whole.union(done.long.join(digest, F.col("conv_id").eqNullSafe(F.col("c"))).select(columns))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    made = merkle.build(docs, fields, "lang", "doc_id", [*map(F.col, fields[:-1]), lowered], tampered)
    return merkle.verified(made).withColumnRenamed("key", "doc_id")


# Unsigned CRC-32 of the decimal or ASCII text ``s``, from a table ``t`` of 256 remainders.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) t"""


def _crc(s: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))")


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_told = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"  # noqa: E731
_leaf = lambda text: "sha256(" + " || ".join(map(_told, ["doc_id", "source", "lang", "n_chars", text])) + ")"  # noqa: E731


def _climb(name: str, leaves: str) -> str:
    """CTEs of the tree over ``leaves`` (tree, idx, h) and of every leaf's (place, run) list."""
    return f"""
{name}_up AS (
  SELECT tree, 0 l, idx, h, count(*) OVER (PARTITION BY tree) n FROM {leaves}
  UNION ALL
  SELECT tree, l + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM {name}_up WHERE n > 1
  GROUP BY tree, l, n, idx // 8),
{name}_root AS (SELECT tree, h root FROM {name}_up WHERE n = 1),
{name}_run AS (SELECT tree, l, idx // 8 g, string_agg(h, '' ORDER BY idx) run FROM {name}_up WHERE n > 1 GROUP BY tree, l, idx // 8),
{name}_path AS (
  SELECT s.tree, s.idx, coalesce(list({{'p': (s.idx // (8 ** l)::BIGINT) % 8, 'run': run}} ORDER BY l) FILTER (run IS NOT NULL), []) path
  FROM {leaves} s LEFT JOIN {name}_run r ON r.tree IS NOT DISTINCT FROM s.tree AND r.g = s.idx // (8 ** (l + 1))::BIGINT
  GROUP BY s.tree, s.idx)"""


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (
  SELECT doc_id, lang tree, {_leaf('text')} h,
         CASE WHEN {_crc('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(f"translate(text, '{_UP}', '{_LOW}')")} END seen FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 idx FROM d),
{_climb('doc', 'leaves')},
names AS (SELECT 0 tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 idx, root h, tree lang FROM doc_root),
{_climb('top', 'names')},
whole AS (
  SELECT doc_id, leaves.h leaf, seen, names.h subroot, root, list_concat(doc_path.path, top_path.path) path
  FROM leaves JOIN doc_path ON doc_path.tree IS NOT DISTINCT FROM leaves.tree AND doc_path.idx = leaves.idx
  JOIN names ON names.lang IS NOT DISTINCT FROM leaves.tree JOIN top_path ON top_path.idx = names.idx, top_root),
folded AS (
  SELECT *, list_reduce(list_prepend({{'p': 0, 'run': coalesce(seen, leaf)}}, path), lambda a, x:
    {{'p': 0, 'run': sha256(x.run[1 : 64 * x.p] || a.run || x.run[64 * x.p + 65 :])}}).run folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, folded_root, folded_root = root AS verified,
  sha256(array_to_string(list_transform(path, lambda x: x.run[1 : 64 * x.p] || x.run[64 * x.p + 65 :]), '')) AS proof_sha256
FROM folded"""

_GAP_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
fates AS (
  SELECT conv_id conv, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt,
         {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 fate FROM conversations, crc),
hurt AS (
  SELECT conv, turn, CASE fate WHEN 4 THEN 'user' ELSE role END role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END txt,
         unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) copy FROM fates WHERE fate > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, txt, copy) k FROM hurt),
rows_ AS (
  SELECT *, left(role, 1) i, CASE WHEN NOT regexp_matches(txt, '[^ 	

]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv, role, txt ORDER BY k) > 1 THEN 'd'
    WHEN right(rtrim(txt, {_GAP_CHARS}), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) || left(role, 1) pair FROM numbered),
state AS (SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) v(q, nxt, name)),
step AS (SELECT * FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) v(q, i)),
more AS (
  SELECT q, q r, '' letters, 0 price, '' lines FROM state
  UNION ALL SELECT q, nxt, 'I', 3, chr(10) || name || ':' FROM state
  UNION ALL SELECT a.q, b.nxt, 'II', 6, chr(10) || a.name || ':' || chr(10) || b.name || ':' FROM state a JOIN state b ON b.q = a.nxt),
walk AS (
  SELECT conv, 0::BIGINT k, r q, {{'c': price, 'a': letters, 't': lines}} best FROM (SELECT DISTINCT conv FROM rows_), more WHERE q = ''
  UNION ALL
  SELECT conv, k, r, min({{'c': best.c + cost + price, 'a': best.a || letter || letters, 't': best.t || line || lines}})
  FROM (
    SELECT w.conv, x.k, w.q, w.best, e.*
    FROM walk w JOIN rows_ x ON x.conv IS NOT DISTINCT FROM w.conv AND x.k = w.k + 1
    JOIN LATERAL (
      SELECT w.q t, 4 cost, 'D' letter, '' line
      UNION ALL SELECT nxt, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || txt FROM state WHERE state.q = w.q AND fault IN ('', 't')
      UNION ALL SELECT step.i, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || x.role || ':' || txt FROM step
        WHERE step.q = w.q AND step.i = x.i AND fault IN ('', 't')) e ON true)
  JOIN more ON more.q = t GROUP BY conv, k, r),
done AS (
  SELECT w.conv, min(best) best FROM walk w JOIN (SELECT conv, max(k) k FROM rows_ GROUP BY conv) n
    ON n.conv IS NOT DISTINCT FROM w.conv AND n.k = w.k WHERE q IN ('', 'a') GROUP BY w.conv),
told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'b') blank,
         count(*) FILTER (fault = 'd') duplicate, count(*) FILTER (fault = 't') truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal FROM rows_ GROUP BY conv)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate,
       coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') audit, sha256(coalesce(best.t[2 :], '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN told ON told.conv IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv IS NOT DISTINCT FROM a.conv_id"""


_INK = r"[^ \t\n\x0B\f\r]+"

# All windows of every text, counted by their words.
ORACLES["op8_substring_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_INK}') w FROM documents),
pos AS (SELECT r, unnest(range(1, len(w) + 1)) i FROM d),
win AS (SELECT r, i, md5(array_to_string(w[i : i + {substring_dedup.WIDTH - 1}], ' ')) k FROM pos JOIN d USING (r) WHERE i + {substring_dedup.WIDTH - 1} <= len(w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (
  SELECT pos.r, pos.i, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END) OVER (
    PARTITION BY pos.r ORDER BY pos.i ROWS BETWEEN {substring_dedup.WIDTH - 1} PRECEDING AND CURRENT ROW) gone
  FROM pos LEFT JOIN rep ON rep.r = pos.r AND rep.i = pos.i),
kept AS (SELECT r, list(i ORDER BY i) FILTER (gone = 0) l, sum(gone) g FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(g, 0)::BIGINT n_removed,
       sha256(coalesce(array_to_string(list_transform(l, lambda i: w[i]), ' '), '')) kept_sha256
FROM d LEFT JOIN kept USING (r)"""

# All byte strings of every text, as pairs of hexadecimal digits, with the smallest document of each;
# what they cover as runs, and the rest as the pieces between.
ORACLES["op6_suffix_array_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n FROM documents),
win AS (
  SELECT r, doc_id, i, md5(substr(h, 2 * i + 1, {2 * suffix_dedup.WINDOW})) k
  FROM (SELECT r, doc_id, h, unnest(range(0, n - {suffix_dedup.WINDOW - 1})) i FROM d WHERE n >= {suffix_dedup.WINDOW})),
least AS (SELECT k, min(doc_id) low FROM win GROUP BY k HAVING count(*) > 1),
rep AS (SELECT r, i FROM win JOIN least USING (k) WHERE low < doc_id),
cut AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {suffix_dedup.WINDOW} THEN 0 ELSE 1 END first FROM rep),
runs AS (
  SELECT r, min(i) a, max(i) + {suffix_dedup.WINDOW} b FROM (SELECT *, sum(first) OVER (PARTITION BY r ORDER BY i) g FROM cut) GROUP BY r, g),
pieces AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) done FROM runs),
kept AS (
  SELECT r, sum(b - a) g, count(*) f, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) k, max(b) e
  FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT n_bytes, coalesce(g, 0)::BIGINT n_removed, coalesce(f, 0)::BIGINT n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(e, 0) + 1))) kept_sha256
FROM d LEFT JOIN kept USING (r)"""

# All pairs of documents that share a shingle, exact set sizes, and reachability over links.
ORACLES["op10_ngram_jaccard_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_INK}') w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {ngram_join.WIDTH - 1}], ' ') s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {ngram_join.WIDTH - 2}))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {ngram_join.PERCENT} * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) m FROM reach GROUP BY x) r ON r.x = d.doc_id"""
