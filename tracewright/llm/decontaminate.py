"""Benchmark decontamination by greedy string tiling.

Documents and items that share a seed, five words in a row, are tiled: the longest run of words that both have and that no
tile covers yet is found with Karp-Rabin hashes of windows and marked in both, again and again, down to the least length.
The share of an item's words under tiles decides; so passages are caught in whatever order they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .store import settle

#: Words of a tile at least (all of an item that has fewer), and share of an item's words under tiles from which a document counts as contaminated.
LEAST, COVERAGE = 5, 0.6
#: Words of all items together (8 bytes each) up to which items are broadcast; beyond that seeds are joined by a shuffle.
BROADCAST_WORDS = 4_000_000

_B = 0xD6E8FEB86659FD93


class Windows:
    """Karp-Rabin hashes of all windows of one length, from running sums over hashed words."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        up, self.down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(self.down)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1])))

    def of(self, size: int) -> np.ndarray:
        starts = len(self.total) - size
        return vec.mix((self.total[size:] - self.total[:starts]) * self.down[:starts]) if starts > 0 else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, length) of the tiles, longest first; ties from the front."""
    one, two = Windows(doc), Windows(item)
    free_one, free_two = np.ones(len(doc), bool), np.ones(len(item), bool)

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        def windows(w: Windows, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            taken = np.concatenate(([0], np.cumsum(~free)))
            at = np.flatnonzero(taken[size:] == taken[:-size])
            return at, w.of(size)[at]

        (a, ha), (b, hb) = windows(one, free_one), windows(two, free_two)
        hit = np.isin(hb, ha)
        return (a, ha, b[hit], hb[hit]) if hit.any() else None

    out, most = [], min(len(doc), len(item))
    while most >= least and common(least) is not None:
        low, high = least, most  # a common run of a length has common runs of all lesser ones
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) is not None else (low, middle - 1)
        most = low
        a, ha, b, hb = common(low)
        order = np.argsort(ha, kind="stable")
        a, ha = a[order], ha[order]
        for at, h in zip(b.tolist(), hb.tolist(), strict=True):
            if not free_two[at : at + low].all():
                continue
            for i in range(int(np.searchsorted(ha, np.uint64(h))), int(np.searchsorted(ha, np.uint64(h), side="right"))):
                place = int(a[i])
                if free_one[place : place + low].all():
                    free_one[place : place + low] = free_two[at : at + low] = False
                    out.append((place, at, low))
                    break
    return out


def word_hashes(column: pa.Array) -> list[np.ndarray]:
    """Hashed words of each text: runs of letters and digits, in lower case."""
    hashes, first = vec.separated(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), vec.LETTERS)
    return [hashes[a:b] for a, b in zip(first, first[1:], strict=False)]


def seeds(words: np.ndarray, size: int = LEAST) -> np.ndarray:
    return Windows(words).of(size)


def _hashed(table: DataFrame, id_col: str, name: str) -> DataFrame:
    schema = pa.schema([(name, pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array([w.view(np.int64) for w in word_hashes(part.column(1))], pa.list_(pa.int64()))], schema=schema)

    return table.select(F.col(id_col).cast("long").alias(name), F.col("text").cast("string").alias("text")).mapInArrow(vec.tidy(run), f"{name} long, words array<long>")


class Items:
    """The items, with all places of their seeds in one array, sorted by seed."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.rows = [(i, w) for i, w in rows if len(w)]
        self.sizes = np.array([len(w) for _, w in self.rows], np.int64)
        self.by_size = {}
        for size in sorted({min(LEAST, n) for n in self.sizes.tolist()}):
            own = [seeds(w, size) if min(LEAST, len(w)) == size else np.zeros(0, np.uint64) for _, w in self.rows]
            flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own])
            places = np.concatenate([np.arange(len(s)) for s in own])
            order = np.argsort(flat, kind="stable")
            self.by_size[size] = flat[order], of[order], places[order]

    def met(self, words: np.ndarray, coverage: float) -> np.ndarray:
        """Items of which so many words stand in seeds that a text shares as the coverage needs.

        Every word under a tile stands in a shared seed, so no item that reaches the coverage is left out, and one that
        shares a common passage only isn't tiled.
        """
        out = [np.zeros(0, np.int64)]
        for size, (known, of, places) in self.by_size.items():
            own = seeds(words, size)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.unique(own[known[at] == own])
            low, high = np.searchsorted(known, hit), np.searchsorted(known, hit, side="right")
            rows, _ = vec.gathered(np.arange(len(known)), low, high)
            if not len(rows):
                continue
            item, place = of[rows], places[rows]
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            reach = np.full(len(item), size)
            same = item[1:] == item[:-1]
            reach[:-1][same] = np.minimum(size, (place[1:] - place[:-1])[same])
            covered = np.bincount(item, weights=reach, minlength=len(self.sizes))
            out.append(np.flatnonzero((covered > 0) & (covered >= coverage * self.sizes - 1e-9)))
        return np.unique(np.concatenate(out))


FOUND = "doc_id long, item_id long, n_item_words int, n_matched int, coverage double, tiles array<struct<doc_word:int,item_word:int,size:int>>"


def _result(doc_id, item_id, doc: np.ndarray, item: np.ndarray) -> dict:
    found = tiles(doc, item, min(LEAST, len(item)))  # an item of fewer words is looked for as a whole
    matched = sum(t[2] for t in found)
    return {"doc_id": doc_id, "item_id": item_id, "n_item_words": len(item), "n_matched": matched, "coverage": matched / len(item), "tiles": [{"doc_word": a, "item_word": b, "size": n} for a, b, n in found]}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    tile = pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("size", pa.int32())])
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_words", pa.int32()), ("n_matched", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(tile))]))


def _small(benchmark: DataFrame) -> Items | None:
    """The items, if all their words together are few enough to be sent to every task."""
    hashed = _hashed(benchmark, "item_id", "item_id")
    size = hashed.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    if size > BROADCAST_WORDS:
        return None
    return Items([(r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in hashed.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_item_words, n_matched, coverage, tiles) of documents and items over the threshold.

    Null and empty texts and items match nothing; an item of fewer than five words has to stand there as a whole. Whole
    texts are tiled, tiles of one length from the front of the item and of the document. Rows of equal id and text give
    equal rows; equal items are found one by one. Empty tables, of documents or items, give an empty one. Of documents only
    the id and ``text`` are read, of the benchmark ``item_id`` and ``text``.
    """
    items = _small(benchmark)
    if items is None:
        return _by_shuffle(docs, benchmark, coverage, id_col).where(F.col("coverage") >= coverage)
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in vec.slices(batch, "text"):
                rows = [r for doc_id, words in zip(part.column(0).to_pylist(), word_hashes(part.column(1)), strict=True) for i in known.met(words, coverage).tolist() if (r := _result(doc_id, known.rows[i][0], words, known.rows[i][1]))["coverage"] >= coverage]
                if rows:
                    yield _arrow(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(vec.tidy(run), FOUND)


def _by_shuffle(docs: DataFrame, benchmark: DataFrame, coverage: float, id_col: str = "doc_id") -> DataFrame:
    """The same without a broadcast: seeds of documents are joined with seeds of items, then each pair's words.

    A pair is tiled only if so many of the item's places have a shared seed as the coverage needs with the shortest tiles,
    so a passage that all documents share brings no pair by itself unless it is most of an item. Seeds are counted before
    the shuffle of pairs, and a seed that very many documents have is split over tasks by adaptive execution.
    """
    words = settle(_hashed(docs, id_col, "doc_id").withColumn("row", F.monotonically_increasing_id()), "words")
    items = settle(_hashed(benchmark, "item_id", "item_id").withColumn("item_row", F.monotonically_increasing_id()), "items")

    def of(df: DataFrame, row: str, whole: bool) -> DataFrame:
        """Seeds of each size with their number of places; of an item, those of its own size only."""
        schema = pa.schema([(row, pa.int64()), ("size", pa.int32()), ("seed", pa.int64()), ("places", pa.int32())])

        def run(batches):
            for batch in batches:
                for row_id, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.asarray(w.values).view(np.uint64)
                    for size in range(1, LEAST + 1) if whole else [min(LEAST, len(own))] if len(own) else []:
                        seed, n = np.unique(seeds(own, size), return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(seed), row_id)), pa.array(np.full(len(seed), size, np.int32)), pa.array(seed.view(np.int64)), pa.array(n.astype(np.int32))], schema=schema)

        return df.select(row, "words").mapInArrow(vec.tidy(run), f"{row} long, size int, seed long, places int")

    own = of(items, "item_row", False)
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # at most LEAST of them
    met = of(words, "row", True).where(F.col("size").isin(sizes)).drop("places").join(own, ["size", "seed"])
    needed = items.select("item_row", F.size("words").alias("n"))
    need = F.when(F.col("n") < LEAST, F.lit(1)).otherwise(F.ceil(F.lit(coverage) * F.col("n") / LEAST - F.lit(1e-9)))
    pairs = met.groupBy("row", "item_row").agg(F.sum("places").alias("places")).join(needed, "item_row").where(F.col("places") >= need).select("row", "item_row")
    both = pairs.join(words, "row").join(items.withColumnRenamed("words", "item_words"), "item_row").select("doc_id", "words", "item_id", "item_words")

    def run(batches):
        for batch in batches:
            rows = [_result(d, i, np.asarray(w.values).view(np.uint64), np.asarray(v.values).view(np.uint64)) for d, w, i, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True)]
            if rows:
                yield _arrow(rows)

    return both.mapInArrow(vec.tidy(run), FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all columns; cases as for ``contaminated``."""
    items = _small(benchmark)
    if items is None:
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_all"))
        rows = settle(rows, "rows")
        bad = _by_shuffle(rows.select("_row", F.col("_all.text").alias("text")), benchmark, coverage, "_row").where(F.col("coverage") >= coverage).select(F.col("doc_id").alias("_row")).distinct()
        return rows.join(bad, "_row", "left_anti").select("_all.*")
    sent = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in vec.slices(batch, "text"):
                keep = [not any(_result(None, None, words, known.rows[i][1])["coverage"] >= coverage for i in known.met(words, coverage).tolist()) for words in word_hashes(part.column(at))]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(vec.tidy(run), T.StructType(docs.schema.fields))
