"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewright.llm import alignment, collocations, decontaminate, divergence, imatch, jaccard, langid, licenses, packing, pii, secrets, token_counts, token_shards

V, P = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("n", "class", "column", "row", "range", "bucket", "words", "spans", "base", "which", "term", "guest", "tokens", "number", "label", "next", "counts", "slot", "own_id", "kept_id", "found", "piece", "tie", "mask", "lead", "own", "size", "seed", "width", "pair", "times", "name", "f", "phrase", "place", "share", "groups")

#: name -> (operator over documents and benchmark, whether a row of documents gives a row)
ROWWISE = {
    "secrets": (lambda d, b: secrets.secrets(d), True),
    "token_counts": (lambda d, b: token_counts.token_counts(d, V), True),
    "imatch": (lambda d, b: imatch.fingerprints(d), True),
    "langid": (lambda d, b: langid.languages(d), True),
    "pseudonyms": (lambda d, b: pii.report(d, "key"), True),
    "licenses": (lambda d, b: licenses.licenses(d), True),
    "jaccard": (lambda d, b: jaccard.jaccard_components(d), True),
    "alignment": (lambda d, b: alignment.aligned(d, V, P), True),
    "divergence": (lambda d, b: divergence.quality(d), True),
    "collocations": (lambda d, b: collocations.collocations(d), False),
    "decontaminate": (lambda d, b: decontaminate.contaminated(d, b), False),
    "token_shards": (lambda d, b: token_shards.training_shards(d, V), False),
    "packing": (lambda d, b: packing.packed(d, V), False),
}


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.mark.parametrize("name", ROWWISE)
def test_edges(spark, docs, empty, benchmark, name):
    f, rowwise = ROWWISE[name]
    got = f(docs, benchmark).collect()
    if rowwise:
        assert len(got) == docs.count()
        ids = [r["doc_id"] for r in got]
        assert sorted(i for i in ids if i is not None) == sorted(r[0] for r in docs.select("doc_id").collect() if r[0] is not None)
    assert f(empty, benchmark).count() == 0
    more = f(clashing(docs), benchmark).collect()
    assert sorted(map(str, more)) == sorted(map(str, got)) or name in ("token_shards", "packing") and len(more) == len(got)


@pytest.mark.parametrize("stage", ["identified", "one_of_each", "clean", "pseudonymised"])
def test_stages_keep_columns(spark, docs, empty, benchmark, stage):
    f = {"identified": langid.identified, "one_of_each": jaccard.one_of_each, "clean": lambda d: decontaminate.clean(d, benchmark), "pseudonymised": lambda d: pii.pseudonymised(d, "key")}[stage]
    wide = clashing(docs)
    out = f(wide)
    assert out.columns == wide.columns
    assert f(empty).count() == 0
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert {7, 63} <= set(rows)
    if stage == "one_of_each":
        assert 64 not in rows and 5 in rows and None in rows
        assert out.where("doc_id = 5").count() == 1
    if stage == "identified":
        assert not {60, 61, 62, 68} & set(rows)


def test_the_floor_is_measured_on_all_held_out_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracewright.llm import langid

    asked = []
    monkeypatch.setattr(langid, "predict", lambda rows, model: asked.append(rows.count()) or rows.select(F.lit("en").alias("lang_pred"), F.lit(0.5).alias("score")))
    held = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"))
    assert langid.floor_of(held, langid.Filter(["en"], [__import__("numpy").zeros(langid.SLOTS, "uint64")])) == langid.FLOOR * 0.5 and asked == [12_000]
