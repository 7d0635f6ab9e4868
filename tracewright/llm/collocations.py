"""Phrase collocations: n-grams of dictionary ids as fixed-width binary keys, counted by range-partitioned sort and run length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from . import vec
from .store import settle

#: Words of a phrase, least count of one, phrases a language, and the share (per cent) at which a longer one covers it.
LONGEST, LEAST, BEST, COVERED = 4, 30, 2000, 80
#: A score is floor(SCALE * a / (l + r)).
SCALE = 2_000_000
#: Frequent words whose names are sent to all tasks, 8 bytes each; with more of them a filter of FILTER_BITS bits is sent and
#: a word's id is its 64-bit name.
BROADCAST_WORDS, FILTER_BITS = 3_000_000, 1 << 27
#: Text that one row of the encoded table holds, and keys that a task adds up before it gives them on.
SLICE, HELD = 4 << 20, 4_000_000
NONE = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"
WORDS = vec.byte_table(b" \t" + BREAKS)
_BREAK = np.isin(np.arange(256), list(BREAKS))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.col("text").cast("string").alias("text"))


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


def _named(langs: pa.Array, texts: pa.Array):
    """(lower-case bytes, starts of words, their ends, names of (language, word), breaks before each word, text of each)."""
    data, offsets = vec.closed(texts)
    hashes, first = vec.words(data, offsets, WORDS)
    inside = WORDS[1][data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    known: dict[str, np.uint64] = {}
    seeds = np.array([known[x] if x in known else known.setdefault(x, _seed(x)) for x in langs.to_pylist()], np.uint64)
    names = vec.mix(hashes ^ seeds[of]) if len(of) else hashes
    return WORDS[0][data], starts, ends, np.where(names == 0, np.uint64(1), names), np.cumsum(_BREAK[data])[starts], of


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, name, f): words that occur LEAST times in their language; the row without a word has all occurrences."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("name", pa.int64()), ("f", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text", SLICE):
                langs = part.column(0)
                data, starts, ends, names, _, of = _named(langs, part.column(1))
                own, at, times = np.unique(names, return_index=True, return_counts=True)
                flat, offsets = vec.gathered(data, starts[at], ends[at])
                words = pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.record_batch([langs.take(pa.array(of[at])).cast(pa.string()), words, pa.array(own.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)
                total = np.bincount(of, minlength=len(langs))
                yield pa.record_batch([langs.cast(pa.string()), pa.nulls(len(langs), pa.string()), pa.nulls(len(langs), pa.int64()), pa.array(total.astype(np.int64))], schema=schema)

    counted = _texts(docs).mapInArrow(vec.tidy(run), "lang string, word string, name long, f long").groupBy("lang", "word").agg(F.min("name").alias("name"), F.sum("f").alias("f"))
    return counted.where(F.col("word").isNull() | (F.col("f") >= LEAST))


class Filter:
    """A Bloom filter of 64-bit names, of a fixed size; two places a name."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((vec.mix(names + np.uint64(k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)) for k in (1, 2))

    def has(self, names: np.ndarray) -> np.ndarray:
        one, two = self.places(names)
        return (self.bits[one >> 3] >> (one & 7).astype(np.uint8)) & (self.bits[two >> 3] >> (two & 7).astype(np.uint8)) & np.uint8(1) > 0


def _filter(names: DataFrame) -> Filter:
    """The filter of a column of names; what comes to the driver are its bytes that aren't zero."""
    schema = pa.schema([("byte", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        for batch in batches:
            at = np.concatenate(Filter.places(np.asarray(batch.column(0)).view(np.uint64)))
            yield pa.record_batch([pa.array(at >> 3), pa.array(1 << (at & 7))], schema=schema)

    found = names.mapInArrow(vec.tidy(run), "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").cast("short").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint8)
    return Filter(bits)


class Codes:
    """Ids of frequent words: places in their sorted names, from 1 on, or the names themselves; 0 is a break.

    A packed key holds the ids of an n-gram, each in ``32`` or ``64`` bits, as big-endian 64-bit words.
    """

    def __init__(self, names: np.ndarray | None, filtered: Filter | None):
        self.names, self.filtered = names, filtered

    @property
    def narrow(self) -> bool:
        return self.names is not None

    def of(self, names: np.ndarray) -> np.ndarray:
        if not self.narrow:
            return np.where(self.filtered.has(names), names, np.uint64(0))
        if not len(self.names):
            return np.zeros(len(names), np.uint64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at + 1, 0).astype(np.uint64)

    @property
    def kind(self):
        return np.uint32 if self.narrow else np.uint64

    def packed(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        if not self.narrow:
            return ids
        ids = [*ids, *[np.zeros_like(ids[0])] * (len(ids) % 2)]
        return [a << np.uint64(32) | b for a, b in zip(ids[::2], ids[1::2], strict=True)]

    def unpacked(self, words: np.ndarray, n: int) -> np.ndarray:
        """Names, a row each n-gram, of rows of packed words."""
        if not self.narrow:
            return words
        ids = np.stack([words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)], 2).reshape(len(words), 2 * words.shape[1])[:, :n]
        return self.names[ids.astype(np.int64) - 1]


def phrase_names(ids: list[np.ndarray]) -> np.ndarray:
    """One 64-bit name of an n-gram from its columns of word names or ids."""
    total = np.full(len(ids[0]), len(ids), np.uint64)
    for column in ids:
        total = vec.mix(total + column)
    return total


def encoded(docs: DataFrame, codes) -> DataFrame:
    """(ids): ids of the words of some texts in order, with a 0 where a piece ends or a word isn't frequent.

    Words that have such a break on either side are in no phrase and are left out.
    """
    def run(batches):
        own = codes.value
        for batch in batches:
            for part in vec.slices(batch, "text", SLICE):
                *_, names, piece, _ = _named(part.column(0), part.column(1))
                ids = own.of(names)
                new = np.concatenate(([True], piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, bool)
                spread = np.zeros(len(ids) + int(new.sum()) + 1, np.uint64)
                spread[np.arange(len(ids)) + np.cumsum(new)] = ids
                full = np.concatenate(([False], spread != 0, [False]))
                paired = full[1:-1] & (full[:-2] | full[2:])
                keep = paired | np.concatenate(([False], paired[:-1]))
                spread = np.where(paired, spread, np.uint64(0))[keep]
                yield pa.record_batch([pa.array([spread.astype(own.kind).tobytes()], pa.binary())], names=["ids"])

    return _texts(docs).mapInArrow(vec.tidy(run), "ids binary")


def _added(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of ``columns`` in order, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def _packed(n: int, codes, before) -> callable:
    """Rows of ``encoded`` -> (key, times) of their n-grams, added up in the task.

    With ``before``, the filter of frequent (n - 1)-grams, only those are given of which both (n - 1)-grams pass it.
    """
    def emit(columns, counts):
        keys = np.stack(columns, 1).astype(">u8")
        offsets = np.arange(len(counts) + 1, dtype=np.int32) * np.int32(8 * len(columns))
        return pa.record_batch([pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())]), pa.array(counts)], names=["key", "times"])

    def run(batches):
        own, held, size = codes.value, [], 0

        def total():
            return _added([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))

        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_buffer(), own.kind)
                full = ids != 0
                m = len(ids) - n + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(np.logical_and.reduce([full[i : m + i] for i in range(n)]))
                if before is not None and len(at):
                    shorter = before.value.has(phrase_names([ids[i : m + 1 + i].astype(np.uint64) for i in range(n - 1)]))
                    at = at[shorter[at] & shorter[at + 1]]
                if not len(at):
                    continue
                held.append(_added(own.packed([ids[at + i].astype(np.uint64) for i in range(n)]), np.ones(len(at), np.int64)))
                size += len(held[-1][1])
                if size > HELD:
                    held = [total()]
                    size = len(held[0][1])
                    if size > HELD // 2:
                        yield emit(*held[0])
                        held, size = [], 0
        if held:
            yield emit(*total())

    return run


def _runs(n: int, codes) -> callable:
    """Sorted (key, times) of a range -> (names, f, name) of the keys that have LEAST in all, by run length."""
    def run(batches):
        own, rest = codes.value, None

        def closed(keys, counts):
            keep = counts >= LEAST
            keys, counts = keys[keep], counts[keep]
            names = own.unpacked(keys, n)
            # the filter of the next length is over ids as they are encoded
            ids = own.of(names.ravel()).reshape(names.shape) if own.narrow else names
            flat = pa.array(np.ascontiguousarray(names).view(np.int64).ravel())
            return pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * np.int32(n)), flat), pa.array(counts), pa.array(phrase_names([ids[:, i] for i in range(n)]).view(np.int64))], names=["phrase", "f", "name"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
            times = np.asarray(batch.column(1))
            if rest is not None:
                keys, times = np.concatenate((rest[0], keys)), np.concatenate((rest[1], times))
            new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))
            at = np.flatnonzero(new)
            sums = np.add.reduceat(times, at)
            rest = keys[at[-1:]], sums[-1:]
            yield closed(keys[at[:-1]], sums[:-1])
        if rest is not None:
            yield closed(*rest)

    return run


def _exact(a: Column, times: int) -> Column:
    return a.cast("decimal(20,0)") * F.lit(times).cast("decimal(10,0)")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), exact for counts whose products pass 64 bits."""
    return F.call_function("div", _exact(a, SCALE), (l + r).cast("decimal(20,0)"))


def phrases(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words as ``word_counts`` has them; (phrase array<long>, f): phrases of 2 to LONGEST words with f >= LEAST).

    A phrase is the array of the names of its words, which hold their language. Words are encoded once; then one length after
    the other is counted, and only n-grams of which both shorter ones are frequent are given on.
    """
    spark = docs.sparkSession
    words = settle(word_counts(docs), "words")
    frequent = words.where("word is not null").select("name")
    if frequent.count() <= broadcast_words:
        names = np.sort(frequent.toArrow().column(0).to_numpy().view(np.uint64))
        codes = spark.sparkContext.broadcast(Codes(names, None))
    else:
        codes = spark.sparkContext.broadcast(Codes(None, _filter(frequent)))
    texts = settle(encoded(docs, codes), "encoded")
    found, before = [], None
    for n in range(2, LONGEST + 1):
        keys = settle(texts.mapInArrow(vec.tidy(_packed(n, codes, before)), "key binary, times long"), f"keys-{n}")
        dealt = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        counted = settle(dealt.mapInArrow(vec.tidy(_runs(n, codes)), "phrase array<long>, f long, name long"), f"phrases-{n}")
        found.append(counted.select("phrase", "f"))
        if n < LONGEST:
            before = spark.sparkContext.broadcast(_filter(counted.select("name")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return words, out


def collocations(docs: DataFrame, best: int = BEST, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases by score.

    Texts are in lower case (A-Z only), cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at spaces and
    tabs. A phrase has 2 to 4 words of one piece and occurs a >= 30 times in its language. Its score is that of its lowest
    cut, floor(2,000,000 a / (l + r)), ties to the smallest k; whole numbers of 38 digits are used. Phrases that stand in a
    longer one which has 80 % of their occurrences are dropped. Order: score and a descending, then the phrase's bytes.

    A null language is ``und``, a null text empty; empty texts and tables give no rows. Texts are taken whole and may be of
    any length, repeated rows count as often as they occur, and only ``lang`` and ``text`` are read. A common first word is
    in many phrases: their counts are looked up by joins that Spark deals anew where a key is frequent, all else is added up
    before it moves.
    """
    words, found = phrases(docs, broadcast_words)
    known = words.where("word is not null")
    parts = known.select(F.array("name").alias("part"), F.col("f"), F.col("lang")).unionByName(found.where(F.size("phrase") < LONGEST).select(F.col("phrase").alias("part"), "f", F.lit(None).cast("string").alias("lang")))
    size = F.size("phrase")
    # longest count of a longer phrase around each one
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("phrase", i, m))))
    around = found.where(size > 2).select(F.explode(inside).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("f").alias("longer"))
    kept = found.select("phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("longer")).union(around).groupBy("phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    kept = kept.where(F.col("longer").isNull() | (_exact(F.col("longer"), 100) < _exact(F.col("a"), COVERED))).select("phrase", "a")

    cuts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns({"first": F.slice("phrase", 1, F.col("k")), "rest": F.slice("phrase", F.col("k") + 1, LONGEST)})
    cut = cuts.join(parts.select(F.col("part").alias("first"), F.col("f").alias("l"), "lang"), "first").join(parts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    cut = cut.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = cut.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.max("lang").alias("lang"))
    scored = scored.select("phrase", "a", "lang", "low.l", "low.r", "low.score")

    # the best of each part of a language, ties included; those are numbered by ranges
    order = [F.desc("score"), F.desc("a")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = settle(scored.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= best).drop("part", "place"), "best")
    spelled = some.select("phrase", F.posexplode("phrase").alias("at", "name")).join(known.select("name", "word"), "name").groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("spelled"))
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    ranked = numbered(some.join(spelled, "phrase"), [*order, "spelled"], "rank", ("lang",)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("spelled").alias("phrase"), "a", "l", "r", "n", "score")
