"""Token counts of every prefix, by dynamic programming, kept so that later questions need no encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .bpe import byte_pairs

LIMIT = 512


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, counts): ``counts[i]`` is the exact token count of the first i + 1 characters.

    Counts are those of the vocabulary's own library without added tokens; special strings inside a text count as one token
    each, as the library takes them by default. Null and empty texts have no prefix: 0 bytes, 0 tokens, an empty array. A
    text may be of any length; it is counted in one piece, with 4 bytes a character. Repeated rows are repeated; an empty
    table gives an empty one; columns other than the two named aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                texts = part.column(1).fill_null("")
                counts = [pairs.prefix_counts(t) for t in texts.to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(np.int32)
                flat = np.concatenate(counts) if counts else np.zeros(0, np.int32)
                _, ends = vec.text_bytes(texts)
                yield pa.record_batch([part.column(0), pa.array(np.diff(ends)), pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(vec.tidy(run), "doc_id long, n_bytes long, n_tokens long, counts array<int>")


def tokens_of_prefix(n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters (all, where the text is shorter), from ``counts``."""
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size("counts"))
    return F.when(n < 1, F.lit(0)).otherwise(F.try_element_at("counts", n))


def longest_prefix(budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from ``counts``.

    A longer prefix can have fewer tokens, so this is the last place within the budget and not the first one past it.
    """
    return F.coalesce(F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) from the last prefix of each text."""
    whole = F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")
    return prefix_counts(docs, tokenizer).select("doc_id", "n_bytes", whole.alias("n_tokens"), (whole > limit).alias("over_limit"))
