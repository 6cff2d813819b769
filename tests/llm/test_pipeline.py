"""The pipeline against its stages by brute force."""

import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, mixing, near_dup, quality
from tessera.llm.common import shared_dir
from tessera.llm.tokens import LowerBpe, public_path
from tests.llm.conftest import ODD, words
from tests.llm.test_operators import plain_groups, plain_hits, texts


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    kept = quality.quality_filter(docs).cache()
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {i for i, _ in texts(kept)} == judged
    single = near_dup.drop_near_duplicates(kept).cache()
    assert sorted(i for i, _ in texts(single)) == sorted(g[0] for g in plain_groups(kept) if g[3])
    clean = decontaminate.decontaminate(single, bench).cache()
    assert {i for i, _ in texts(clean)} == {i for i, t in texts(single) if not plain_hits(t, items)[4]}
    mixed = mixing.mixed_documents(clean)
    assert mixed.columns == docs.columns
    encoder = LowerBpe(public_path("word_bpe_49k.json"))
    want = sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts(mixed) for ids in [[*encoder.encode(t.encode()).tolist(), 2]])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_tables(spark, table, sf_dir):
    """Null and blank texts, ties, repeated rows, null ids, a long text, clashing columns, and an empty table, through every stage."""
    natural = [(100 + i, " ".join(words(i, 80, 3000)), "en", f"s{i % 3}") for i in range(12)]
    rows = [*ODD, *natural, natural[0], (None, natural[3][1], None, None)]
    source = table(rows).withColumns({c: F.lit(c) for c in ("__set", "__size", "target", "__q_script", "doc")})
    for docs in (source, source.limit(0)):
        whole = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            alone = stage(spark, docs, sf_dir)
            assert alone.columns == docs.columns, name
            assert all(r["target"] == "target" and r["__set"] == "__set" and r["doc"] == "doc" for r in alone.collect()), name
            whole = stage(spark, whole, sf_dir).cache()
        last = corpus_pipeline.token_output(spark, whole, sf_dir)
        assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == whole.count()
        left = {i for i, _ in texts(whole)}
        assert not left & {1, 2, 3, 4} and (left <= {r[0] for r in natural} | {6} if docs is source else not left)


def test_run_keeps_one_stage(spark, sf_dir):
    """A stage's documents go when the next stage's are written; the last stage's input stays for its result."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    shared.mkdir(exist_ok=True)
    there = set(shared.glob("stage-*"))
    result = corpus_pipeline.run(spark, sf_dir)
    assert [p.name[:7] for p in set(shared.glob("stage-*")) - there] == ["stage-3"]
    assert result.count() == result.count() > 0
