"""The pipeline's stages against a plain rerun of their decisions."""

import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.conftest import SMALL
from tests.llm.test_ops import fingerprint, groups_of
from tidewell.llm import mixing, quality
from tidewell.llm.common import table
from tidewell.llm.queries import TOKENIZERS


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    said = {r.doc_id: r.predicted for r in quality.quality_report(docs, table(spark, SMALL, "labels")).collect()}
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if said[r.doc_id]:
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    rows = sorted((i, t) for t, i in first.items())
    fps = [fingerprint(t) for _, t in rows]
    root = groups_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    left = sorted({rows[r][0] for r in root})
    frames = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], SMALL).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert [f.columns for f in frames[1:5]] == [docs.columns] * 4
    assert sorted(r.doc_id for r in frames[1].collect()) == sorted(i for i, p in said.items() if p)
    assert sorted(r.doc_id for r in frames[2].collect()) == [i for i, _ in rows]
    assert sorted(r.doc_id for r in frames[3].collect()) == left
    copies = {r.doc_id: r["_tw_copies"] for r in mixing.rated(frames[3]).collect()}
    got = {r.doc_id: r["count"] for r in frames[4].groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}
    lib = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = frames[5].collect()
    assert len(out) == sum(got.values()) and all(r.token_ids == lib.encode(texts[r.doc_id]) and r.round_trip for r in out)


def test_run(spark):
    out = pipeline.run(spark, SMALL)
    assert {"doc_id", "token_ids", "n_tokens"} <= set(out.columns) and out.where(~F.col("round_trip")).count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties and repeated rows, columns with the operators' own names."""
    long = " ".join(f"word{k % 900}" for k in range(30_000))
    texts = [None, "", "  \n", long, long, "same text here for all", "same text here for all", "x", "日本語 😀", "same  text here\tfor all"]
    rows = [(None if k % 4 == 0 else k // 2, t, None if k % 3 else "en", None if k % 2 else "a", None) for k, t in enumerate(texts)] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "_tw_score", "_tw_sha", "_tw_copies", "key", "fp", "root", "c0"):
        odd = odd.withColumn(name, F.lit("mine"))
    spark.createDataFrame([(None, None, None), (1, None, 0), (1, 1, 0), (1, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            place = str(tmp_path / f"{name}{docs is odd}{k}{id(docs)}")
            before = docs.columns
            stage(spark, docs, str(tmp_path)).write.parquet(place)
            docs = spark.read.parquet(place)
            assert docs.columns == before or k == len(pipeline.STAGES) - 1
            if name == "exact" and docs.count():
                assert docs.count() == docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).distinct().count()
        assert "token_ids" in docs.columns and docs.where("not round_trip").count() == 0
