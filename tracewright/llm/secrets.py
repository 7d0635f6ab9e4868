"""Secret scans: known forms, and strings that a character Markov model takes for random rather than for an identifier."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import before, let, spans

#: The base forms (kind, pattern, group, least length of the group).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = {"assign": 0, "access": 1, "hex": 2, "markov": 3}

#: Strings that the model judges: runs of these characters, of this length at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Log-likelihood ratio, in nats: in all and per pair of characters.
LEAST_RATIO, LEAST_RATE = 12.0, 0.5
#: Rows of the labelled sample: random strings, and about this many documents for the identifiers.
RANDOM_ROWS, SAMPLE_DOCS = 3000, 1000
#: Characters are ASCII codes; anything else is code 0.
CODES = 128
#: Past every place of a text.
END = (1 << 31) - 1


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """(value, random = true): digests written in base 64, base 32 letters and hexadecimal, from a seeded rule."""
    digest = F.sha2(F.concat(F.lit("labelled-"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    upper = F.translate(F.upper(F.substring(base64, 1, 40)), "+/", "27")
    value = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.substring(digest, 1, 48)).otherwise(upper)
    return spark.range(rows).select(value.alias("value"), F.lit(True).alias("random"))


def numbers(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """(value, random = false): runs of digits, which are ordinary however random they are."""
    digits = F.translate(F.sha2(F.concat(F.lit("digits-"), F.col("id").cast("string")), 256), "abcdef", "012345")
    return spark.range(rows).select(F.substring(digits, 1, 20).alias("value"), F.lit(False).alias("random"))


def identifiers(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random = false): words of a sample of about ``most`` documents, alone and joined as identifiers are.

    The sample is by a hash of the text and has equal texts once, so it is the same at every run and no group of copies is
    all of it.
    """
    rows = max(docs.count(), 1)
    sample = docs.where("text is not null").where(F.pmod(F.xxhash64("text", F.lit("identifiers")), F.lit(1_000_000)) < min(1_000_000, math.ceil(1e6 * most / rows)))
    sample = sample.groupBy(F.xxhash64("text").alias("name")).agg(F.min("text").alias("text"))
    words = sample.select(F.filter(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9_-]+"), lambda w: F.char_length(w).between(2, 15)).alias("words"))
    pairs = words.select("words", F.zip_with("words", F.slice("words", 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("x")).alias("b"))).alias("pairs"))
    pair = pairs.select(F.explode("pairs").alias("p")).select(F.explode(F.array("p.a", F.concat_ws("_", "p.a", "p.b"), F.concat_ws("-", "p.a", "p.b"), F.concat("p.a", F.initcap("p.b")), F.concat(F.initcap("p.a"), F.initcap("p.b")))).alias("value"))
    both = pair.where(~F.col("value").rlike(BASE[2][1]))
    return both.select("value", F.lit(False).alias("random"))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.when(F.ascii(c) < CODES, F.ascii(c)).otherwise(0))


def train(samples: DataFrame, weight: float = 0.5) -> np.ndarray:
    """The log-ratio of each pair of characters, from labelled (value, random) rows; CODES squared numbers.

    Counts of pairs are taken by Spark and only the counts, at most 2 * CODES squared rows, come to the driver. Each pair
    has ``weight`` more than it was seen. Without samples of a label all its pairs are alike.
    """
    codes = samples.select("random", _codes(F.coalesce("value", F.lit(""))).alias("codes"))
    rest = F.greatest(F.size("codes") - 1, F.lit(0))
    pairs = codes.select("random", F.explode(F.arrays_zip(F.slice("codes", F.lit(1), rest).alias("a"), F.slice("codes", F.lit(2), rest).alias("b"))).alias("p"))
    counts = np.zeros((2, CODES * CODES))
    for r in pairs.select("random", (F.col("p.a") * CODES + F.col("p.b")).alias("pair")).groupBy("random", "pair").count().collect():
        counts[int(r["random"]), r["pair"]] = r["count"]
    seen = counts.reshape(2, CODES, CODES) + weight
    chance = np.log(seen / seen.sum(axis=2, keepdims=True))
    return (chance[1] - chance[0]).reshape(-1)


def ratio(value: Column, model: np.ndarray) -> Column:
    """Log-likelihood ratio of a string: over 0, it looks random."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, a["last"] * CODES + c + 1))).alias("sum"))
    return F.aggregate(_codes(value), start, step)["sum"]


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the secrets of every whole text, array<struct<start, kind_no, end, kind>> in order.

    Places are code points, ends exclusive. Of the base forms every match stays, even where kinds overlap; strings that the
    model finds are added where they touch no base span; spans that begin at one place come in the order of the kinds. Null
    is taken as an empty text, which has no secret. Texts may be of any length. Repeated rows are repeated; an empty table
    gives an empty one; other columns aren't read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS[kind]).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def known(kind: str, pattern: str, group: int, least: int) -> Column:
        return of(kind, F.filter(spans(F.col("text"), pattern, group), lambda s: F.char_length(s["part"]) >= least))

    def judged() -> Column:
        found = F.transform(spans(F.col("text"), CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), ratio(s["value"], model).alias("ratio")))
        return of("markov", F.filter(found, lambda s: (s["ratio"] >= LEAST_RATIO) & (s["ratio"] >= LEAST_RATE * (s["end"] - s["start"] - 1))))

    def added(sorted_spans: Column) -> Column:
        """Base spans, and those of the model that end before the next base span and begin after all earlier ones."""
        is_base = lambda s: s["kind_no"] < KINDS["markov"]
        last = before(F.transform(sorted_spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
        first = F.reverse(before(F.reverse(F.transform(sorted_spans, lambda s: F.when(is_base(s), s["start"]).otherwise(F.lit(END)))), F.lit(END), lambda a, b: F.least(a, b)))
        marked = F.zip_with(F.zip_with(sorted_spans, last, lambda s, a: F.struct(s.alias("s"), a.alias("last"))), first, lambda x, b: F.struct(x["s"].alias("s"), (is_base(x["s"]) | ((x["last"] <= x["s"]["start"]) & (b >= x["s"]["end"]))).alias("stays")))
        return F.transform(F.filter(marked, lambda x: x["stays"]), lambda x: x["s"])

    docs = docs.withColumn("base", F.concat(*(known(*form) for form in BASE)))
    found = let(judged(), lambda random: F.when(F.size(random) == 0, F.array_sort("base")).otherwise(let(F.array_sort(F.concat("base", random)), added)))
    return docs.select("doc_id", found.alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """The digest of ``scan`` over documents, with a model trained from seeded random strings and the documents' own words."""
    spark = docs.sparkSession
    model = train(random_strings(spark).union(numbers(spark)).union(identifiers(docs)))
    out = scan(docs, model)
    base = F.filter("found", lambda s: s["kind_no"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind_no"] == KINDS[kind])).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), count("markov"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
