"""The pipeline on planted cases, against results worked out by hand and by brute force."""

from __future__ import annotations

import hashlib
import random

import brute
import public_tokenizers
import tiktoken

import corpus_pipeline
from fieldloom.llm import byte_bpe
from fieldloom.llm.shared import stored

rng = random.Random(11)


def prose(n: int) -> str:
    return " ".join(f"t{rng.randrange(4000)}" for _ in range(n))


ITEM, BASE = prose(40), prose(120)
HOT = "All rights to this page are kept by its owner for good"
NEAR = BASE.rsplit(" ", 2)[0] + " other end"
ROWS = [
    (1, prose(80)), (2, BASE), (3, BASE), (4, NEAR), (5, prose(30)), (6, "again " * 90), (7, f"{prose(40)} {ITEM} {prose(40)}"),
    (8, f"{prose(60)} write to jo.doe@mail.example.org or +1 (555) 010-9999 {prose(20)}"), (9, None), (10, ""),
    (None, prose(70)), (1, prose(75)), (1, BASE),
] + [(20 + k, f"{prose(55)}\n{HOT}") for k in range(14)] + [(40, f"{prose(8)}\n" + f"{HOT}\n" * 6 + prose(8))]


ROWS += [(None, ROWS[10][1]), (None, f"{prose(30)} {ITEM} {prose(30)}"), ROWS[7]]  # a copy and a leak without id, a repeated row


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in ROWS],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frames = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], str(tmp_path))))
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    ids = [sorted(-1 if r.doc_id is None else r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    hot = list(range(20, 34))
    assert ids[1] == sorted([-1, -1, -1, 1, 1, 1, 2, 3, 4, 7, 8, 8, *hot])
    kept = [(r.doc_id, r.text) for r in frames[1].where("doc_id IS NOT NULL").collect()]
    group = brute.jaccard_components([(i, t) for i, t in kept if i > 1])
    assert ids[2] == sorted([-1, -1, 1, 1, *(i for i, (_, c) in group.items() if i == c)])
    assert ids[2] == sorted([-1, -1, 1, 1, 2, 7, 8, *hot])
    assert {r.text for r in frames[2].where("doc_id = 1").collect()} == {ROWS[0][1], ROWS[11][1]}
    assert ids[3] == sorted([-1, 1, 1, 2, 8, *hot]) == ids[4] == ids[5]
    assert [r.text for r in frames[3].where("doc_id IS NULL").collect()] == [ROWS[10][1]]
    text = {r.doc_id: r.text for r in frames[4].collect()}
    assert "jo.doe" not in text[8] and "[EMAIL]" in text[8] and "[PHONE]" in text[8]
    assert all(HOT not in text[i] and text[i] == dict(ROWS)[i].split("\n")[0] for i in hot)
    assert {r.n_chars for r in frames[4].where("doc_id = 8").collect()} == {len(text[8])}

    ranks = byte_bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == len(ids[5])
    for r in final:
        if r.doc_id not in (None, 1):
            assert r.n_tokens == len(coder.encode_ordinary(text[r.doc_id]))
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
