"""Language identification with a bit-sliced Bloom filter: one mask of languages a slot, for character n-grams."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .store import settle

#: Lengths of n-grams; a word's ends count as one character.
SIZES = (2, 3, 4)
#: Slots, and slots of one n-gram. A slot has one 64-bit mask for each 64 languages: 8 MB, whatever the corpus.
SLOTS, HASHES = 1 << 20, 3
#: Different texts learned from, about.
SAMPLE = 20_000
#: An n-gram belongs to a language in which it is seen so often, and no rarer than this share of where it is commonest.
LEAST_SEEN, SHARE = 3, 0.25
#: A text is in none of the learned languages below this share of the score that all but a hundredth of held-out texts reach.
#: The floor is measured on all of them; with fewer than LEAST_MEASURED nothing is rejected by its score.
FLOOR, LEAST_MEASURED = 0.5, 30
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit names of the n-grams of all texts, the text of each, the letters of each text).

    Texts are in lower case; what isn't a letter ends a word, and n-grams stay within a word and its two ends.
    """
    texts = pc.utf8_lower(column.cast(pa.large_string()).fill_null("")).to_pylist()
    codes = np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([10], codes, [10])).astype(np.uint32)
    text = np.cumsum(codes == 10) - 1
    letter = _letters()[codes]
    counts = np.bincount(text[letter], minlength=len(texts))[: len(texts)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one end after each word stays, and is the next one's beginning
    keep[0] = True
    codes, text, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), text[keep], letter[keep]
    names, of = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        inner = np.ones(len(codes) - n + 1, bool)
        for i in range(1, n - 1):
            inner &= letter[i : len(codes) - n + 1 + i]
        inner &= letter[: len(inner)] | letter[n - 1 :]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x110001) + codes[at + i]
        names.append(vec.mix(h))
        of.append(np.where(letter[at], text[at], text[at + 1]))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(names), np.concatenate(of), counts


def slots_of(names: np.ndarray) -> list[np.ndarray]:
    one, two = names, vec.mix(names ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return [((one + np.uint64(i) * two) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Filter:
    """The masks and languages; a language's bit in all slots of an n-gram says that the n-gram may be its own.

    ``masks`` has one array over the slots for each 64 languages.
    """

    def __init__(self, languages: list[str], masks: list[np.ndarray]):
        self.languages, self.masks = languages, masks
        full = np.array([np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))]) / SLOTS
        self.false = full**HASHES

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams of each text in each language, without what false positives give; n-grams of each text; its letters)."""
        names, of, letters = grams(column)
        n = len(letters)
        slots = slots_of(names)
        total = np.bincount(of, minlength=n).astype(float)
        hits = np.zeros((n, len(self.languages)))
        for word, masks in enumerate(self.masks):
            mask = np.full(len(names), np.uint64(2**64 - 1))
            for at in slots:
                mask &= masks[at]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits[:, i] = np.bincount(of, weights=(mask >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
        return np.clip((hits - total[:, None] * self.false) / (1 - self.false), 0, None), total, letters


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Filter:
    """A filter from rows (doc_id, text, lang); rows without a language aren't learned from.

    About ``sample`` different texts are taken by a hash of the text, so that copies are learned once. N-grams are counted by
    Spark; what comes to the driver is one mask for each slot that isn't empty and each 64 languages. All languages of the
    sample are told apart, the most seen first.
    """
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    n = max(rows.count(), 1)
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 20)) < min(1 << 20, math.ceil((1 << 20) * sample / n)))
    rows = rows.groupBy(F.xxhash64("text").alias("name"), "lang").agg(F.min("text").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("seen", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                names, of, _ = grams(part.column(0))
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in sorted(set(langs.tolist())):
                    own, seen = np.unique(names[(langs == lang)[of]], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(seen.astype(np.int64))], schema=schema)

    counted = rows.select("text", "lang").mapInArrow(vec.tidy(run), "lang string, gram long, seen long").groupBy("lang", "gram").agg(F.sum("seen").alias("seen"))
    counted = settle(counted, "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    languages = list(totals)
    masks = [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(languages) // 64))]
    if languages:
        place = F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)))
        size = F.create_map(*(F.lit(x) for lang in languages for x in (lang, float(totals[lang]))))
        rate = counted.select("gram", "seen", F.try_element_at(place, F.col("lang")).alias("bit"), (F.col("seen") / F.try_element_at(size, F.col("lang"))).alias("rate"))
        best = rate.groupBy("gram").agg(F.max("rate").alias("best"))
        own = rate.join(best, "gram").where((F.col("seen") >= LEAST_SEEN) & (F.col("rate") >= SHARE * F.col("best"))).groupBy("gram", F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("mask"))
        slot_schema = pa.schema([("slot", pa.int64()), ("word", pa.int64()), ("mask", pa.int64())])

        def slotted(batches):
            for batch in batches:
                for at in slots_of(np.asarray(batch.column(0)).view(np.uint64)):
                    yield pa.record_batch([pa.array(at), batch.column(1), batch.column(2)], schema=slot_schema)

        for r in own.mapInArrow(vec.tidy(slotted), "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            masks[r["word"]][r["slot"]] = np.uint64(r["mask"] % 2**64)
    return Filter(languages, masks)


def _predicted(model: Filter, column: pa.Array) -> tuple[list[str], np.ndarray]:
    counts, total, letters = model.counts(column)
    if not model.languages:
        return [NONE] * len(letters), np.zeros(len(letters))
    best = counts.argmax(1)  # ties go to the language that was seen more
    score = np.where(total > 0, counts[np.arange(len(best)), best] / np.maximum(total, 1), 0)
    return [model.languages[b] if n else NONE for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, np.clip(score, 0, 1), 0)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text; the score is the share of n-grams that are the language's.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing was learned. Of
    languages that have the same count the one that was seen more is taken, then the first by name. Texts may be of any
    length. Repeated rows are repeated; an empty table gives an empty one; only the id and the text are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                lang, score = _predicted(sent.value, part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text").cast("string")).toDF("doc_id", "held_out", "text").mapInArrow(vec.tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those that aren't held out."""
    return predict(docs, learn(docs.where(~held_out()).select("doc_id", "text", "lang")))


def floor_of(held: DataFrame, model: Filter) -> float:
    """The least score of a text in a learned language, from held-out rows (doc_id, text, lang); 0 where they are too few."""
    rows = held.where("lang is not null and text is not null").where(F.col("lang").isin(model.languages))
    seen = predict(rows, model).where(F.col("lang_pred") != NONE).agg(F.count("*").alias("n"), F.percentile_approx("score", 0.01).alias("low")).first()
    return FLOOR * seen["low"] if seen["n"] >= LEAST_MEASURED else 0.0


def identified(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language: its best score reaches the measured floor.

    With ``wanted``, the predicted language has to be one of these as well. Texts that are null or have no letter go. Where
    nothing was learned there is no verdict, and every text with a letter stays; where the held-out texts are too few to
    measure a floor, none goes by its score. Repeated rows are judged alike, ties as in ``predict``; texts may be of any
    length; an empty table gives an empty one.
    """
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    floor = floor_of(docs.where(held_out()).select("doc_id", "text", "lang"), model) if model.languages else 0.0
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                if sent.value.languages:
                    lang, score = _predicted(sent.value, part.column(at))
                    stays = [x != NONE and y >= floor and (wanted is None or x in wanted) for x, y in zip(lang, score.tolist(), strict=True)]
                else:
                    stays = grams(part.column(at))[2] > 0
                yield part.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(vec.tidy(run), docs.schema)
