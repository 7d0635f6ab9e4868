"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Shingles are columns of the incidence matrix and sets are its rows; equal sets count as one row. All columns are put in one
order, those that a counting sketch of the whole corpus finds rare first, and a row keeps only as many leading columns as
any partner has to meet (its size less the least overlap, plus one). The product of these leading parts is made column by
column in sorted blocks: a column of up to ``SMALL`` rows adds one to the overlap of each pair in it, and pairs whose
overlap stays below the bound that follows from both sizes are discarded. In a larger column each row is paired with a hub
only, the row of like size whose leading columns are the most common: in a group of near copies that is the one with the
least of its own, so all others are near it. When the links found so far are known, rows that are outside the hub's
component are paired with those rows of the column outside their own with which they can still reach the bound. A column that
is dealt over blocks is a larger one, however few rows each block has, so that its rows meet across blocks. So work on
a group of many near copies is linear, and no link that joins two components is lost. Remaining pairs are decided by the
exact overlap of their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .store import settle, swept

#: Rows up to which all pairs of a column are counted.
SMALL = 16
#: Rows of a column that stay together; columns that are hotter in the corpus are dealt over several blocks, numbered from 1.
BLOCK = 20_000
#: Slots of the sketch: at least, at most. One row of counters, 4 bytes a slot when summed.
SLOTS = (1 << 20, 1 << 26)
#: The sketch moves in parts of so many slots.
PART = 1 << 16
#: Bits of the filter for documents whose sets are compared: at least, at most, and for each document. Its false positives
#: only cost time; where the most would be too few, documents are joined instead.
FILTER_BITS = (1 << 20, 1 << 27, 8)
#: Sizes are in one band up to this ratio where rows of large columns meet.
BAND = 1.05


def _floor_of(n, p: int, q: int):
    """Least overlap that a set of n needs with any partner: ceil(p n / q)."""
    return (p * n + q - 1) // q


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in vec.slices(batch, "text"):
        hashes, first = vec.separated(part.column(part.schema.get_field_index("text")))
        yield part, [vec.shingles(hashes[a:b], k) for a, b in zip(first, first[1:], strict=False)]


def _class_of(s: np.ndarray) -> int:
    """One 64-bit name for a set, from two sums over its members."""
    one = vec.mix(np.array([np.add.reduce(vec.mix(s)), len(s)], np.uint64))
    two = vec.mix(np.array([np.add.reduce(vec.mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64))
    return int(vec.mix(one[:1] + one[1:] * np.uint64(31) + two * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def _first_pass(k: int, slots: int):
    """Rows (doc_id, n, class) of all documents, and parts of this task's counters."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, seen = np.zeros(slots, np.uint16), set()
        shift = np.uint64(64 - slots.bit_length() + 1)
        for batch in batches:
            for part, sets in _sets(batch, k):
                names = [_class_of(s) for s in sets]
                fresh = []
                for name, s in zip(names, sets, strict=True):
                    if name not in seen and len(s):
                        if len(seen) < 1 << 20:  # beyond that copies are merely counted again
                            seen.add(name)
                        fresh.append(s >> shift)
                if fresh:
                    at, n = np.unique(np.concatenate(fresh), return_counts=True)
                    at = at.astype(np.int64)
                    counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(names, pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        for i in range(0, slots, PART):
            if (c := counts[i : i + PART]).any():
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([i // PART], pa.int32()), pa.array([c.tobytes()], pa.binary())], schema=schema)

    return run


def _summed(batches):
    """One part of the counters, of all tasks; parts of a fixed size come one after another."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total.setdefault(i, np.zeros(PART, np.int64))
            total[i] += np.frombuffer(c.as_buffer(), np.uint16)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])


def _leading(k: int, p: int, q: int, sketch, slots: int):
    """Rows (column, block, band, rank, n, class, pos) of each distinct set's leading columns.

    The band is the set's size class; the rank is lower for sets whose leading columns are more common. ``pos`` is the
    column's place among the set's own.
    """
    schema = pa.schema([("column", pa.int64()), ("block", pa.int32()), ("band", pa.int32()), ("rank", pa.int32()), ("n", pa.int32()), ("class", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        counts = np.frombuffer(sketch.value, np.int32)
        shift, most = np.uint64(64 - slots.bit_length() + 1), BLOCK + 4 * int(counts.mean())
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for _, sets in _sets(batch, k):
                for s in sets:
                    if not len(s):
                        continue
                    name = _class_of(s)
                    if name in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(name)
                    n = len(s)
                    load = counts[(s >> shift).astype(np.int64)]
                    lead = np.lexsort((s, load))[: n - _floor_of(n, p, q) + 1]
                    blocks = 1 + load[lead] // most
                    own = np.array([int(math.log(n) / math.log(q / p)) if p < q else n, -int(256 * np.log2(np.maximum(load[lead], 1)).mean()), n], np.int32)
                    band, rank, size = (np.full(len(lead), x, np.int32) for x in own)
                    out.append((s[lead].view(np.int64), np.where(blocks > 1, 1 + (np.uint64(name % 2**64) % blocks.astype(np.uint64)).astype(np.int32), 0).astype(np.int32), band, rank, size, np.full(len(lead), name, np.int64), np.arange(len(lead), dtype=np.int32)))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return run


PAIRS = "a long, na int, b long, nb int, column long, pos int, small boolean"


def _products(p: int, q: int):
    """Pairs of small columns and (row, hub) of large ones, from rows sorted by column, block, band, rank and class."""
    schema = pa.schema([("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32()), ("column", pa.int64()), ("pos", pa.int32()), ("small", pa.bool_())])

    def made(a, na, b, nb, column, pos, small):
        swap = small & (a > b)
        return pa.record_batch([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, nb, na)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, na, nb)), pa.array(column), pa.array(pos), pa.array(np.full(len(a), small))], schema=schema)

    def starred(rows, hub):
        """Each row of one large column with its hub, the first row of its band; and the last hub, for rows to come."""
        c, _, band, n, name, pos = rows
        first = np.concatenate(([True], band[1:] != band[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        to, to_n = name[at], n[at]
        if hub is not None and hub[0] == band[0]:
            same = band == band[0]
            to, to_n = np.where(same, hub[1], to), np.where(same, hub[2], to_n)
        return made(name, n, to, to_n, c, pos, False), (int(band[-1]), int(to[-1]), int(to_n[-1]))

    def run(batches):
        held = None  # rows of the last column so far
        large = None  # (column, block, hub) while a large column goes on
        for batch in batches:
            rows = tuple(np.asarray(batch.column(i)) for i in (0, 1, 2, 4, 5, 6))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
                held = None
            if len(rows[0]) == 0:
                continue
            fresh = np.ones(len(rows[0]), bool)
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[4][1:] != rows[4][:-1])
            rows = tuple(x[fresh] for x in rows)
            if large is not None:
                on = (rows[0] == large[0]) & (rows[1] == large[1])
                m = len(on) if on.all() else int(np.argmin(on))
                if m:
                    out, hub = starred(tuple(x[:m] for x in rows), large[2])
                    large = (*large[:2], hub)
                    yield out
                    rows = tuple(x[m:] for x in rows)
                if len(rows[0]) == 0:
                    continue
                large = None
            edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            starts = np.concatenate(([0], edge))
            size = np.diff(np.concatenate((starts, [len(rows[0])])))
            last = tuple(x[starts[-1] :].copy() for x in rows)
            if size[-1] <= SMALL and not last[1][0]:
                held = last
            else:
                out, hub = starred(last, None)
                large = (last[0][0], last[1][0], hub)
                yield out
            yield from closed(rows, starts[:-1], size[:-1])
        if held is not None:
            yield from closed(held, np.array([0]), np.array([len(held[0])]))

    def closed(rows, starts, size):
        """What whole columns and whole blocks give."""
        big = (size > SMALL) | (rows[1][starts] > 0)
        keep = np.repeat((size > 1) & ~big, size)
        run_of = np.repeat(np.arange(len(size)), size)[keep]
        cs, ns, names, pos = (rows[i][: len(keep)][keep] for i in (0, 3, 4, 5))
        for d in range(1, SMALL):
            if len(run_of) <= d:
                break
            i = np.flatnonzero(run_of[:-d] == run_of[d:])
            if not len(i):
                break
            low, high = np.minimum(ns[i], ns[i + d]).astype(np.int64), np.maximum(ns[i], ns[i + d]).astype(np.int64)
            i = i[low * q >= high * p]
            if len(i):
                yield made(names[i], ns[i], names[i + d], ns[i + d], cs[i], pos[i], True)
        for s, m in zip(starts[big], size[big], strict=True):
            yield starred(tuple(x[s : s + m] for x in rows), None)[0]

    return run


def _members(bits, k: int):
    """Rows (class, members) of the documents that the filter lets through; of all without a filter."""
    schema = pa.schema([("class", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        bitmap = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            if bitmap is not None:
                ids = vec.mix(np.asarray(batch.column(0).fill_null(0)).view(np.uint64)) % np.uint64(8 * len(bitmap))
                hit = (bitmap[(ids >> np.uint64(3)).astype(np.int64)] >> (ids & np.uint64(7)).astype(np.uint8)) & 1
                batch = batch.filter(pa.array(hit.astype(bool)))
            for _, sets in _sets(batch, k):
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.record_batch([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    return run


def _filter_words(size: int):
    """Bit positions of documents, as (64-bit word, its bits)."""

    def run(batches):
        for batch in batches:
            at = np.unique(vec.mix(np.asarray(batch.column(0).fill_null(0)).view(np.uint64)) % np.uint64(size))
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    return run


def jaccard_classes(docs: DataFrame, k: int = 4, p: int = 85, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, labels): all documents with their set's size and class, links between classes, and components.

    documents: doc_id, n, class (a name of the set; equal sets have one). links: a, b, overlap, na, nb with
    q * overlap >= p * (na + nb - overlap), among them for every component enough to connect it. labels: node, label (the
    least class of the component) of the classes that have a link.

    Null and empty texts, and texts of white space, have the empty set (n 0), which links with nothing. A text of fewer than
    k words is one shingle. Repeated rows are repeated. Only the two columns named are read, so other columns may have any
    names. Sets are named by 64-bit hashes, shingles too.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slots = SLOTS[0]
    rows = texts.count()
    while slots < min(SLOTS[1], 4 * rows):
        slots *= 2
    first = settle(texts.mapInArrow(vec.tidy(_first_pass(k, slots)), "doc_id long, n int, class long, part int, counts binary"), "sets")
    documents = first.where("part is null").select("doc_id", "n", "class")
    parts = first.where("part is not null").select("part", "counts").repartition(max(1, slots // PART // 8), "part").mapInArrow(vec.tidy(_summed), "part int, counts binary")
    whole = np.zeros(slots, np.int32)
    for r in parts.toLocalIterator():  # a fixed number of bytes, whatever the input
        whole[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int32)
    sketch = spark.sparkContext.broadcast(whole.tobytes())

    lead = texts.mapInArrow(vec.tidy(_leading(k, p, q, sketch, slots)), "column long, block int, band int, rank int, n int, class long, pos int")
    made = settle(lead.repartition("column", "block").sortWithinPartitions("column", "block", "band", "rank", "class").mapInArrow(vec.tidy(_products(p, q)), PAIRS), "products")
    swept(spark)  # the leading columns of all sets have been moved and aren't needed again

    least = F.ceil(F.lit(p) * (F.col("na") + F.col("nb")) / F.lit(p + q))
    tail = lambda n: F.ceil(F.lit(p) * F.col(n) / F.lit(q))
    bound = F.greatest(F.lit(1), F.least(least - tail("na"), least - tail("nb")) + 1)
    counted = made.where("small").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("met")).where(F.col("met") >= bound).select("a", "b")
    large = made.where("not small")
    fits = F.least("na", "nb") * q >= F.greatest("na", "nb") * p
    starred = large.where("a != b").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tops = large.groupBy("column").agg(F.min("b").alias("top"))
    between = large.select("column", "b").distinct().join(tops, "column").where("b != top").select(F.col("top").alias("a"), "b").distinct()
    pairs = settle(counted.union(starred).union(between).distinct(), "pairs")
    reps = documents.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    links = settle(_verified(texts, reps, pairs, k, p, q), "links")
    swept(spark)

    labels = components(links)
    rows = large.select("column", F.col("a").alias("class"), F.col("na").alias("n"), "pos").distinct().join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed = rows.groupBy("column").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one != other").select("column")
    rows = settle(rows.join(mixed, "column"), "mixed")
    if not rows.isEmpty():
        # small columns in which a row meets any other: so much a pair can have in common before its first large column
        few = made.where("small").select(F.explode(F.array("a", "b")).alias("class"), "column").distinct().groupBy("class").agg(F.count("*").alias("few"))
        # the home of a column is the component of most of its rows, so that as few rows as can be are strays
        home = rows.groupBy("column", "label").agg(F.count("*").alias("rows")).groupBy("column").agg(F.max_by("label", F.struct("rows", "label")).alias("home"))
        rows = rows.join(few, "class", "left").withColumn("few", F.coalesce("few", F.lit(0))).join(home, "column")
        # a row meets partners of such sizes only with which it can still reach the bound; the sizes are joined by bands
        band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(BAND))).cast("int")
        high = F.least(F.floor(F.col("n") * q / F.lit(p)), F.floor((F.col("few") + F.col("n") - F.col("pos")) * (p + q) / F.lit(p)) - F.col("n"))
        bands = F.sequence(band(tail("n")), F.greatest(band(tail("n")), band(high)))
        rows = rows.withColumn("high", high).where("high >= 1")
        stray = rows.where("label != home").where(F.col("high") >= tail("n")).withColumn("band", F.explode(bands)).select("band", "column", F.col("class").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("few").alias("fa"), F.col("pos").alias("pa"))
        other = rows.select(band(F.col("n")).alias("band"), "column", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("few").alias("fb"), F.col("pos").alias("pb"), (F.col("label") != F.col("home")).alias("astray"))
        # of the first large column that two sets share, what stands before it is small and what follows is at most the rest
        can = F.expr("la != lb and (not astray or a < b)") & fits & (F.least("fa", "fb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least)
        more = stray.alias("s").join(other.alias("o"), (F.col("s.column") == F.col("o.column")) & (F.col("s.band") == F.col("o.band")) & can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = settle(_verified(texts, reps, settle(more, "pairs"), k, p, q), "links")
        if not new.isEmpty():
            links = links.union(new)
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(new.select("a", "b")))
    return documents, links, labels


def _verified(texts: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The pairs that link, with the exact overlap of their whole sets.

    A hub is in many pairs; adaptive execution splits its partition, as both joins are inner ones by sorting.
    """
    nodes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = nodes.join(reps, "class").select("doc_id", "class")
    least, most, each = FILTER_BITS
    size, n = least, wanted.count()
    while size < min(most, each * n):
        size *= 2
    if 2 * size >= each * n:
        words = wanted.select("doc_id").mapInArrow(vec.tidy(_filter_words(size)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        bitmap = np.zeros(size // 64, np.int64)
        for r in words.toLocalIterator():  # size / 64 rows at most
            bitmap[r["word"]] = r["bits"]
        bits = texts.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    else:
        bits, texts = None, texts.join(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = texts.mapInArrow(vec.tidy(_members(bits, k)), "class long, members array<long>")
    sets = sets.join(nodes, "class", "left_semi").groupBy("class").agg(F.first("members").alias("members"))
    sets = settle(sets, "members")
    swept(texts.sparkSession)
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("ma")), "a")
    two = one.join(sets.select(F.col("class").alias("b"), F.col("members").alias("mb")), "b")
    met = two.select("a", "b", F.size(F.array_intersect("ma", "mb")).alias("overlap"), F.size("ma").alias("na"), F.size("mb").alias("nb"))
    return met.where(F.col("overlap") * q >= (F.col("na") + F.col("nb") - F.col("overlap")) * p)


def jaccard_components(docs: DataFrame, k: int = 4, p: int = 85, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: the smallest id reachable by links, its own included.

    Cases as for ``jaccard_classes``; an empty table gives an empty one, and a document without a set is alone.
    """
    documents, _, labels = jaccard_classes(docs, k, p, q, id_col, text_col)
    reps = documents.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    grouped = reps.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "label").select("class", "component_id")
    out = documents.join(named, "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near copies; repeated rows of an id go down to one.

    Rows without an id can't be named by another one's group and stay.
    """
    keep = jaccard_components(docs, k, p, q).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct("*").alias("row"))
    named = rows.join(keep, F.col("own_id") == F.col("kept_id"), "left_semi").dropDuplicates(["own_id"])
    return named.union(rows.where("own_id is null")).select("row.*")
