"""The pipeline against a plain version of its decisions."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import bpe
from tracewright.llm.queries import VOCABULARY


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline(spark, docs, benchmark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    leak = spark.createDataFrame([(70, f"{item} and more of it", "en", "src0", 0), (71, "my number is +1 (279) 555-0216 so call, please do", "en", "src0", 0)], docs.schema)
    source = docs.where("doc_id is not null").union(leak)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {}
    for r in source.collect():
        rows.setdefault(r["doc_id"], r["text"])
    kept = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    sets, parent = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i and item not in t}

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "pseudonyms", "packing"]
    frames = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames = stage(spark, frames, str(tmp_path))
        assert frames.columns == source.columns, name
    private = {r["doc_id"]: r["text"] for r in frames.collect()}
    assert set(private) == set(kept)
    assert "555-0216" not in private.pop(71) and all(private[i] == kept[i] for i in private)
    sizes = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sizes.setdefault(r["doc_id"], {})[r["piece"]] = r["tokens"]
    decoded = {i: bpe.byte_pairs(VOCABULARY).encoding.decode(np.frombuffer(b"".join(t for _, t in sorted(own.items())), "<u2").tolist()) for i, own in sizes.items()}
    assert decoded.pop(71) == frames.where("doc_id = 71").first()["text"] and decoded == {i: kept[i] for i in private}


def test_pipeline_without_documents_or_items(spark, docs, empty, benchmark, tmp_path):
    """Empty tables, rows without an id and columns with clashing names."""
    empty.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    docs.withColumns({c: F.lit("x") for c in ("n", "row", "class", "words", "tie", "bucket", "_row", "_all")}).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    benchmark.where("false").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "b")).collect()}
    assert {None, 5, 7, 63} <= ids and not {60, 61, 62, 64, 65, 68} & ids
