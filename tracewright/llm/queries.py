"""The queries of this subpackage: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, collocations, decontaminate, divergence, imatch, jaccard, langid, licenses, packing, pii, secrets, token_counts, token_shards

#: The vocabulary and the key that the queries use; operators take both as parameters.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PSEUDONYM_KEY = "pseudonyms-1"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_shards(documents(spark, sf_dir), VOCABULARY)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), VOCABULARY)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir), PSEUDONYM_KEY)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), VOCABULARY)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), VOCABULARY, PIECES)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_training_order, op3_token_counts, op4_decontaminate, op5_imatch, op6_language_id, op7_pseudonyms, op8_packing, op9_licenses, op10_jaccard_join, op11_collocations, op12_alignment, op13_divergence)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) t(size) WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND f >= 30),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c longer WHERE longer.lang = c.lang AND longer.size > c.size AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * longer.f >= 80 * c.f)),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM kept),
cut AS (SELECT t.lang, t.phrase, t.a, t.k, x.f AS l, y.f AS r, (t.a::HUGEINT * 2000000 // (x.f + y.f))::BIGINT AS score FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.ws[1:t.k], ' ') JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.ws[t.k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
}
