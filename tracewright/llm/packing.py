"""Optimal length buckets: boundaries by dynamic programming over the global histogram, and batches of a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import buckets_for, range_bucket
from .store import settle
from .token_shards import sequences

#: Tokens of a sequence and of a padded batch at most, and buckets at most.
LONGEST, BUDGET, BUCKETS = 4096, 65536, 16


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper ends of at most ``buckets`` ranges of lengths that give the least padding.

    cost[j] is the least total width of all sequences up to the j-th length; the last bucket of the best split is the range
    (i, j], whose sequences are all padded to the j-th length. Ties take the longer last bucket.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    before = np.concatenate(([0], np.cumsum([histogram[int(n)] for n in lengths]))).astype(np.float64)
    m = len(lengths)
    cost = np.concatenate(([0.0], np.full(m, np.inf)))
    back = []
    for _ in range(min(buckets, m)):
        new, frm = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            total = cost[:j] + (before[j] - before[:j]) * lengths[j - 1]
            frm[j] = int(total.argmin())
            new[j] = total[frm[j]]
        cost = new
        back.append(frm)
    out, j = [], m
    for frm in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(frm[j])
    return sorted(out)


def packed(docs: DataFrame, tokenizer: str, longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, width, batch, place, padding, tokens): the sequences in their batches.

    Texts are encoded with the vocabulary at ``tokenizer`` and ``tokens`` has a sequence's ids, as little-endian numbers of
    two bytes (four where the vocabulary needs them) without padding; ``padding`` is what fills it up to its bucket's width.
    A text of more than ``longest`` tokens is cut into pieces, so nothing is dropped and the histogram has at most
    ``longest`` rows, whatever the input. A batch of a bucket holds budget // width sequences, the last one of a bucket the
    rest. Sequences of a bucket are numbered by (doc_id, piece) within ranges of the id and counts before each range, so a
    bucket that has most of the rows isn't one task, and batches stand together in the output. Ids are computed once and
    kept in the shared folder, and moved once.

    Null and empty texts have no sequence. Repeated rows are packed each by itself; rows without an id come first, dealt by
    a hash. Equal lengths are in one bucket, and equal costs of two splits take the longer last bucket. An empty table gives
    an empty one. Only ``doc_id`` and ``text`` are read.
    """
    made = settle(sequences(docs, tokenizer, longest, pad=False), "sequences")
    histogram = {r["n_tokens"]: r["rows"] for r in made.groupBy("n_tokens").agg(F.count("*").alias("rows")).collect()}
    ends = boundaries(histogram, buckets)
    # the bucket of each length, one entry a length
    of = np.searchsorted(ends, np.arange(longest + 1)) if ends else np.zeros(longest + 1, int)
    bucket = F.element_at(F.split(F.lit(",".join(map(str, of.tolist()))), ",").cast("array<int>"), F.col("n_tokens") + 1)
    tied = made.withColumn("tie", F.when(F.col("doc_id").isNull(), F.xxhash64("row")))
    ranged = tied.withColumn("bucket", bucket).withColumn("range", range_bucket(tied.where("seq_no = 0"), "doc_id", buckets_for(docs), "tie"))
    counts = {(r["bucket"], r["range"]): r["rows"] for r in ranged.groupBy("bucket", "range").agg(F.count("*").alias("rows")).collect()}
    top = max((r for _, r in counts), default=0) + 1
    start = [[0] * top for _ in range(max(1, len(ends)))]
    for b, row in enumerate(start):
        for r in range(1, top):
            row[r] = row[r - 1] + counts.get((b, r - 1), 0)
    flat = F.split(F.lit(",".join(str(x) for row in start for x in row)), ",").cast("array<bigint>")
    own = F.row_number().over(Window.partitionBy("bucket", "range").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "row", "seq_no"))
    numbered = ranged.withColumn("number", F.element_at(flat, F.col("bucket") * top + F.col("range") + 1) + own - 1)
    numbered = numbered.withColumn("width", F.element_at(F.lit(ends or [1]), F.col("bucket") + 1))
    each = F.greatest(F.lit(1), F.call_function("div", F.lit(budget).cast("long"), F.col("width")))
    batch, place = F.call_function("div", F.col("number"), each), (F.col("number") % each).cast("int")
    return numbered.select("doc_id", F.col("seq_no").alias("piece"), "n_tokens", "bucket", "width", batch.alias("batch"), place.alias("place"), (F.col("width") - F.col("n_tokens")).alias("padding"), "tokens")
