"""Training-order materialisation: every token sequence gets a slot of a keyed permutation, and shards are ranges of slots."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vec
from .bpe import byte_pairs
from .ranks import with_offsets
from .store import settle

SEQUENCE = 512
PER_SHARD = 4096
ROUNDS = 4
#: Rows of two numbers up to which the first numbers of texts are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
KEY = "training-order-1"


def permuted(x: Column, n: int, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of 0..n-1: a Feistel network over the next even number of bits, walked until it is below ``n``.

    The domain is less than four times n, so a walk of 64 steps misses with a probability under 1e-7 a row for the
    worst n; it is followed on to 1024 steps, and what even then is outside raises an error instead of colliding.
    """
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    mask = (1 << half) - 1

    def once(v: Column) -> Column:
        left, right = F.shiftright(v, half), v.bitwiseAND(F.lit(mask))
        for i in range(rounds):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(f"{key}/{i}")).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    def walk(v: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), v, lambda a, _: F.when(a < n, a).otherwise(once(a)))

    first = once(x.cast("long"))
    near = walk(first, 63)
    far = walk(near, 960)
    out = F.when(first < n, first).otherwise(F.when(near < n, near).otherwise(far))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the permutation's walk didn't end")).cast("long"))


def sequences(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, pad: bool = True) -> DataFrame:
    """(doc_id, row, seqs, seq_no, n_tokens, tokens): each text's ids in pieces of ``length``, in a fixed stride of bytes.

    The last piece is padded with the end-of-text id, if ``pad``. Null and empty texts have no sequence. ``row`` tells the
    rows of one id apart and ``seqs`` is their number of sequences.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seqs", pa.int32()), ("seq_no", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])

    def run(batches):
        pairs = byte_pairs(tokenizer)
        filler = next(iter(pairs.special.values()), max(pairs.ranks.values()) + 1)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                rows = []
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), pairs.ids(part.column(1).fill_null("").to_pylist()), strict=True):
                    for i in range(0, len(ids), length):
                        own = ids[i : i + length]
                        rows.append((doc, row, -(-len(ids) // length), i // length, len(own), (np.pad(own, (0, length - len(own)), constant_values=filler) if pad else own).tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        pairs.ids_of.clear()  # a worker lives on for other stages, and what is kept for this one would be memory that they lack

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    return texts.mapInArrow(vec.tidy(run), "doc_id long, row long, seqs int, seq_no int, n_tokens int, tokens binary")


def training_shards(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: str = KEY) -> DataFrame:
    """(slot, shard, offset, doc_id, seq_no, n_tokens, tokens), range-partitioned and sorted by slot.

    Sequences are numbered by (doc_id, seq_no); the permutation turns the number into the slot. Shard s holds the slots
    from s * per_shard on, and a sequence starts at byte ``offset`` of its shard, so a reader that stopped at a slot goes
    on at slot // per_shard and offset without a look at other shards. Each partition is a run of whole shards, which
    ``write_shards`` writes as files. Null and empty texts have no sequence. Repeated rows are sequences of their own, one
    after another, as are rows of one id; those without an id come first. An empty table has no slots. Texts may be of any
    length. Only ``doc_id`` and ``text`` are read. Ids are computed once and kept in the shared folder, so lost executors
    don't change a slot.
    """
    made = settle(sequences(docs, tokenizer, length), "sequences")
    first, n = with_offsets(made.where("seq_no = 0").select("doc_id", "row", "seqs"), "doc_id", "seqs", "before", ("row",))
    first = first.select("row", "before")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    whole = made.join(first, "row").withColumn("number", F.col("before") + F.col("seq_no"))
    slot = permuted(F.col("number"), max(n, 1), key)
    placed = whole.select(slot.alias("slot"), "doc_id", "seq_no", "n_tokens", "tokens")
    shards = max(1, -(-n // per_shard))
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    # slots are even over 0..n-1, so ranges of shards are even without sampling
    placed = placed.withColumn("shard", shard).withColumn("_part", F.floor(F.col("shard") * parts / F.lit(shards)).cast("int"))
    placed = placed.repartitionById(parts, F.col("_part")).sortWithinPartitions("slot")
    stride = F.floor(F.octet_length("tokens")).cast("long")
    return placed.select("slot", "shard", ((F.col("slot") - F.col("shard") * per_shard) * stride).alias("offset"), "doc_id", "seq_no", "n_tokens", "tokens")


def _opened(path: str):
    """(file system, folder) of a local path or of a URI that Arrow can open on every host."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(placed: DataFrame, path: str, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: str = KEY) -> DataFrame:
    """(shard, first, rows, bytes): writes the rows of ``training_shards`` as one file a shard, and lists the shards.

    A file is the sequences of its slots one after another, each of the same number of bytes, without header. Each task
    writes the shards of its partition one by one, under a name of its own that becomes the shard's at its end; so a task
    that is run again, or twice at once, leaves the same files. ``path`` has to be a folder that all hosts share. The list
    is kept in ``path``/_shards and the sizes in ``path``/manifest.json, which is written last: without it the shards
    aren't whole. An empty table has a manifest and no shards.
    """
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        files, root = _opened(path)
        shard, out, name, first, rows, size = None, None, "", 0, 0, 0

        def closed():
            out.close()
            files.move(name, f"{root}/{_shard_name(shard)}")
            return pa.record_batch([pa.array([x], pa.int64()) for x in (shard, first, rows, size)], schema=schema)

        for batch in batches:
            for slot, own, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != shard:
                    if out is not None:
                        yield closed()
                    shard, name, first, rows, size = own, f"{root}/.{_shard_name(own)}-{uuid.uuid4().hex}", slot, 0, 0
                    out = files.open_output_stream(name)
                if slot != shard * per_shard + rows:
                    raise ValueError(f"slot {slot} isn't at its place in shard {shard}")
                rows, size = rows + 1, size + len(tokens.as_buffer())
                out.write(tokens.as_buffer())
        if out is not None:
            yield closed()

    files, root = _opened(path)
    files.create_dir(root, recursive=True)
    placed.select("slot", "shard", "tokens").mapInArrow(vec.tidy(run), "shard long, first long, rows long, bytes long").write.mode("overwrite").parquet(f"{path}/_shards")
    shards = placed.sparkSession.read.parquet(f"{path}/_shards")
    total = shards.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    stride = (total["bytes"] or 0) // max(total["rows"] or 0, 1)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"slots": total["rows"] or 0, "stride": stride, "length": length, "per_shard": per_shard, "key": key}).encode())
    return shards


def manifest(path: str) -> dict:
    files, root = _opened(path)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_from(path: str, slot: int = 0, at_once: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on, in order: one seek in the first shard, and sequential reads from there.

    A reader that was stopped goes on at the slot after its last one. ``at_once`` sequences are in memory. A slot past the
    end gives nothing.
    """
    of = manifest(path)
    files, root = _opened(path)
    kind = np.dtype(f"<u{of['stride'] // of['length']}") if of["slots"] else None
    while slot < of["slots"]:
        shard = slot // of["per_shard"]
        with files.open_input_file(f"{root}/{_shard_name(shard)}") as f:
            f.seek((slot - shard * of["per_shard"]) * of["stride"])
            while data := f.read(at_once * of["stride"]):
                for row in np.frombuffer(data, kind).reshape(-1, of["length"]):
                    yield slot, row
                    slot += 1


def read_shards(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """(slot, tokens) of all sequences from a slot on, each task reading shards of its own; sorted by slot within a shard."""
    of = manifest(path)
    stride, per_shard = of["stride"], of["per_shard"]
    schema = pa.schema([("slot", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        files, root = _opened(path)
        for batch in batches:
            for shard, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = max(slot, shard * per_shard)
                with files.open_input_file(f"{root}/{_shard_name(shard)}") as f:
                    f.seek((begin - shard * per_shard) * stride)
                    while begin < shard * per_shard + rows:
                        data = f.read(256 * stride)
                        n = len(data) // stride
                        yield pa.record_batch([pa.array(range(begin, begin + n), pa.int64()), pa.array([data[i * stride : (i + 1) * stride] for i in range(n)], pa.binary())], schema=schema)
                        begin += n

    shards = spark.read.parquet(f"{path}/_shards").where(F.col("first") + F.col("rows") > slot)
    return shards.select("shard", "rows").repartition("shard").mapInArrow(vec.tidy(run), "slot long, tokens binary")
