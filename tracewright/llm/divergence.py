"""Quality rules: a text's character classes and common words against those of its language, by Jensen-Shannon distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .store import settle

#: Base rules: least words, and the share of words in windows of WIDTH words that occur again, in per cent.
LEAST_WORDS, MOST_REPEATED, WIDTH = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: A reference is learned from all different texts of its language; a language of fewer rows than LEAST_TEXTS has none.
LEAST_TEXTS = 20
#: The common words of a language: its COMMON most frequent ones among those in this share of its texts.
COMMON, LEAST_SHARE = 150, 0.02
#: Words of a language whose different texts are counted in the first round, and words of all languages in one round at most.
FIRST_ROUND, MOST_IN_ROUND = 1024, 200_000
#: Shares of a text are added up in whole numbers of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1 << 40
#: Texts of fewer words of letters or digits, or characters in words, aren't judged by the distance.
JUDGED_WORDS, JUDGED_CHARS = 50, 200
#: Largest distance (0 to 1) from a reference, after what chance gives a text of that length is taken off.
CLASS_LIMIT, WORD_LIMIT = 0.3, 0.25

#: Words of the base rules end at ASCII white space and keep their case; lines end at a line feed.
WORDS = vec.byte_table(b" \t\n\x0b\x0c\r", lower=False)
LINES = vec.byte_table(b"\n", lower=False)

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "other", "latin", "alphabet", "wide", "rare")


def _class_table() -> np.ndarray:
    """Byte -> class; the bytes that go on a character have none (255). Past ASCII the first byte tells the script roughly."""
    out = np.full(256, 255, np.uint8)
    for byte in range(128):
        c = chr(byte)
        kind = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "line" if c in "\n\r" else "space" if c.isspace() else "stop" if c in ".,;:!?" else "mark" if c in "'\"()-" else "symbol" if byte in SYMBOLS else "other"
        out[byte] = CLASSES.index(kind)
    out[0xC0:0xC8], out[0xC8:0xE0], out[0xE0:0xF0], out[0xF0:] = (CLASSES.index(x) for x in ("latin", "alphabet", "wide", "rare"))
    return out


_CLASS = _class_table()


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; null is empty.

    Lines and windows of words are compared by 64-bit hashes, within one text only.
    """
    data, offsets = vec.closed(column)
    n, at = len(offsets) - 1, offsets[:-1]
    hashes, first = vec.words(data, offsets, WORDS)
    inside, symbol = WORDS[1][data], np.isin(np.arange(256), list(SYMBOLS))[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    chars = np.add.reduceat(inside & ((data & 0xC0) != 0x80), at, dtype=np.int64) if n else np.zeros(0, np.int64)
    symbols = np.add.reduceat(symbol, at, dtype=np.int64) if n else np.zeros(0, np.int64)

    lines, first_line = vec.words(data, offsets, LINES)
    full = data != 10
    begins = np.flatnonzero(full & ~np.concatenate(([False], full[:-1])))
    ends = np.flatnonzero(full & ~np.concatenate((full[1:], [False]))) + 1
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    of = np.repeat(np.arange(n), np.diff(first_line))[worded]
    named = lines[worded] + vec.mix(of.astype(np.uint64))
    once = np.unique(named, return_index=True)[1]
    dup = np.bincount(of, minlength=n) - np.bincount(of[once], minlength=n)

    sizes = np.diff(first)
    of_word = np.repeat(np.arange(n), sizes)
    repeated = np.zeros(n, np.int64)
    if len(hashes) >= WIDTH:
        window = vec.mix(of_word[: len(hashes) - WIDTH + 1].astype(np.uint64))
        for i in range(WIDTH):
            window = vec.mix(window + hashes[i : len(hashes) - WIDTH + 1 + i])
        whole = np.flatnonzero(of_word[: len(window)] == of_word[WIDTH - 1 :])
        _, which, times = np.unique(window[whole], return_inverse=True, return_counts=True)
        again = whole[times[which] > 1]
        change = np.bincount(again, minlength=len(hashes) + 1) - np.bincount(again + WIDTH, minlength=len(hashes) + 1)
        repeated = np.bincount(of_word[np.cumsum(change[:-1]) > 0], minlength=n).astype(np.int64)
    return {"n_words": sizes.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeated}


def class_counts(column: pa.Array) -> np.ndarray:
    """Characters of each text in each class; the line feed that ends a text isn't one."""
    data, offsets = vec.closed(column)
    kinds = _CLASS[data]
    out = np.stack([np.add.reduceat(kinds == k, offsets[:-1], dtype=np.int64) for k in range(len(CLASSES))], 1) if len(offsets) > 1 else np.zeros((0, len(CLASSES)), np.int64)
    out[:, CLASSES.index("line")] -= 1
    return out


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the lower-case words of letters, the text of each, how many each text has)."""
    hashes, first = vec.words(*vec.closed(column), vec.LETTERS)
    sizes = np.diff(first)
    return hashes, np.repeat(np.arange(len(sizes)), sizes), sizes


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row of ``p`` from ``q``; rows without a count are as far as can be."""
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(p > 0, p * np.log2(p / mean), 0).sum(1)
        other = np.where(q > 0, q * np.log2(q / mean), 0).sum(1)
    return np.where(p.sum(1) > 0, np.clip((own + other) / 2, 0, 1), 1.0)


class References:
    """Of each language the mean shares of character classes, its common words and their mean shares.

    The last share of words is that of all other words.
    """

    def __init__(self, languages: list[str], classes: np.ndarray, words: list[np.ndarray], shares: list[np.ndarray]):
        self.languages, self.classes, self.words, self.shares = languages, classes, words, shares

    def _counted(self, names, of, sizes, which: int) -> np.ndarray:
        known = self.words[which]
        out = np.zeros((len(sizes), len(known) + 1))
        if len(known):
            place = np.minimum(np.searchsorted(known, names), len(known) - 1)
            hit = known[place] == names
            np.add.at(out, (of[hit], place[hit]), 1)
        out[:, -1] = sizes - out[:, :-1].sum(1)
        return out

    def distances(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance of classes, distance of words, words) of each text from the language that is nearest.

        Nearest is the least sum of both. From each divergence goes what chance gives a sample of that size: the number of
        shares that are filled in the reference, over 8 n ln 2.
        """
        kinds, (names, of, sizes) = class_counts(column), _terms(column)
        total = kinds.sum(1)
        best = np.full((2, len(sizes)), np.inf)
        for i in range(len(self.languages)):
            words = self._counted(names, of, sizes, i)
            pair = []
            for counts, n, shares in ((kinds, total, self.classes[i]), (words, sizes, self.shares[i])):
                own = distance(counts / np.maximum(n, 1)[:, None], shares[None, :])
                chance = (np.count_nonzero(shares) - 1) / (8 * math.log(2) * np.maximum(n, 1))
                pair.append(np.sqrt(np.clip(own - chance, 0, 1)))
            nearer = sum(pair) < best.sum(0)
            best = np.where(nearer, np.stack(pair), best)
        return best[0], best[1], sizes


def _upper(rows: DataFrame, least: dict[str, int]) -> DataFrame:
    """(lang, word, texts): the rows of a language that have a word, copies included, where they are ``least`` or more."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.int64()), ("texts", pa.int64())])

    def seen(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                names, of, _ = _terms(part.column(0))
                langs = np.array(part.column(1).to_pylist(), object)
                if len(names):
                    order = np.lexsort((of, names))
                    names, of = names[order], of[order]
                    first = np.concatenate(([True], (names[1:] != names[:-1]) | (of[1:] != of[:-1])))
                    names, of = names[first], of[first]
                for lang in sorted(set(langs.tolist())):
                    own, times = np.unique(names[(langs == lang)[of]], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

    enough = F.try_element_at(F.create_map(*(F.lit(x) for lang in least for x in (lang, least[lang]))), F.col("lang"))
    return rows.select("text", "lang").mapInArrow(vec.tidy(seen), "lang string, word long, texts long").groupBy("lang", "word").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= enough)


#: Places before those of words: the character classes, then all words of a text.
_ALL = len(CLASSES)


def _sums(rows: DataFrame, words: dict[str, np.ndarray], classes: bool) -> DataFrame:
    """(lang, place, texts, times, share) over the different texts of the languages of ``words``.

    ``texts`` have something at a place, ``times`` in all; ``share`` is the sum of their shares, in 1 / UNIT. Places are
    the classes, if asked for, all words, and after these the given words. Of each text only its counts at these places
    are moved, under the text's 128-bit name, and copies fall away there.
    """
    sent = rows.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("lang", pa.string()), ("name", pa.int64()), ("other", pa.int64()), ("chars", pa.int64()), ("words", pa.int64()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def counted(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                names, of, sizes = _terms(part.column(0))
                langs = np.array(part.column(1).to_pylist(), object)
                kinds = class_counts(part.column(0)) if classes else np.zeros((len(sizes), _ALL), np.int64)
                fixed = np.concatenate((kinds, sizes[:, None]), 1)
                found = [(*np.nonzero(fixed), fixed[np.nonzero(fixed)])]
                for lang in sorted(set(langs.tolist())):
                    known = sent.value[lang]
                    if len(known):
                        place = np.minimum(np.searchsorted(known, names), len(known) - 1)
                        hit = (known[place] == names) & (langs == lang)[of]
                        key, times = np.unique(of[hit] * len(known) + place[hit], return_counts=True)
                        found.append((key // len(known), _ALL + 1 + key % len(known), times))
                text, place, times = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((place, text))
                at = pa.array(np.searchsorted(text[order], np.arange(len(sizes) + 1)).astype(np.int32))
                places, counts = (pa.ListArray.from_arrays(at, pa.array(x[order].astype(t))) for x, t in ((place, np.int32), (times, np.int64)))
                yield pa.record_batch([part.column(1).cast(pa.string()), part.column(2), part.column(3), pa.array(kinds.sum(1)), pa.array(sizes.astype(np.int64)), places, counts], schema=schema)

    own = rows.where(F.col("lang").isin(sorted(words))).mapInArrow(vec.tidy(counted), "lang string, name long, other long, chars long, words long, places array<int>, counts array<long>")
    each = own.dropDuplicates(["lang", "name", "other"]).select("lang", "chars", "words", F.inline(F.arrays_zip("places", "counts")).alias("place", "count"))
    share = F.rint(F.col("count") * F.lit(float(UNIT)) / F.when(F.col("place") < _ALL, F.col("chars")).otherwise(F.col("words")))
    return each.groupBy("lang", "place").agg(F.count("*").alias("texts"), F.sum("count").alias("times"), F.sum(share.cast("decimal(20,0)")).alias("share"))


def learn(docs: DataFrame) -> References:
    """References from all rows of ``docs`` that have a text and a ``lang``; copies of a text count once in a language.

    Common words are found in rounds. The rows that have a word, copies included, bound its texts from above; a round counts
    the different texts of the words with the largest bounds, and a language is done when no bound that is left reaches the
    last of its common words. Nearly always that is after one round; with many copies more follow, each of twice the words.
    What comes to the driver: two numbers a language, and of each language the classes and the words of a round.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.select("text", "lang", F.xxhash64("text").alias("name"), F.xxhash64(F.lit("references"), "text").alias("other"))
    sizes = rows.groupBy("lang", "name", "other").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("n") >= LEAST_TEXTS)
    texts = {r["lang"]: r["texts"] for r in sizes.collect()}
    languages = sorted(texts)
    if not languages:
        return References([], np.zeros((0, len(CLASSES))), [], [])
    rows = rows.where(F.col("lang").isin(languages))
    least = {lang: max(2, math.ceil(LEAST_SHARE * texts[lang])) for lang in languages}
    upper = settle(_upper(rows, least), "references")
    by_bound = Window.partitionBy("lang").orderBy(F.desc("texts"), "word")

    classes, common = np.zeros((len(languages), len(CLASSES))), {lang: [] for lang in languages}
    whole, open_, at, size = {}, languages, 0, FIRST_ROUND
    while open_:
        size = max(1, min(size, MOST_IN_ROUND // len(open_)))
        ranked = upper.where(F.col("lang").isin(open_)).withColumn("rank", F.row_number().over(by_bound)).where((F.col("rank") > at) & (F.col("rank") <= at + size))
        bounds = {lang: [] for lang in open_}
        for r in ranked.collect():
            bounds[r["lang"]].append((r["word"], r["texts"]))
        words = {lang: np.sort(np.array([w for w, _ in bounds[lang]], np.int64).view(np.uint64)) for lang in open_ if bounds[lang] or not at}
        for r in _sums(rows, words, not at).collect() if words else ():
            lang, place, share = r["lang"], r["place"], int(r["share"])
            if place < _ALL:
                classes[languages.index(lang), place] = share
            elif place == _ALL:
                whole[lang] = (r["times"], share)
            elif r["texts"] >= least[lang]:
                common[lang].append((-r["texts"], int(words[lang][place - _ALL - 1].astype(np.int64)), r["times"], share))
        common = {lang: sorted(found)[:COMMON] for lang, found in common.items()}
        open_ = [lang for lang in open_ if len(bounds[lang]) == size and not (len(common[lang]) == COMMON and -common[lang][-1][0] > min(n for _, n in bounds[lang]))]
        at, size = at + size, 2 * size

    words, shares = [], []
    for lang in languages:
        names = np.array([w for _, w, _, _ in common[lang]], np.int64).view(np.uint64)
        order = np.argsort(names)
        times, share = whole.get(lang, (0, 0))
        rest = max(share - sum(x[3] for x in common[lang]), 0) if times > sum(x[2] for x in common[lang]) else 0
        words.append(names[order])
        shares.append(np.concatenate((np.array([x[3] for x in common[lang]], float)[order], [float(rest)])))
    scaled = lambda x: x / x.sum() if x.sum() else x
    return References(languages, np.array([scaled(c) for c in classes]), words, [scaled(s) for s in shares])


def judged(docs: DataFrame, references: References, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance).

    A text fails the base rules with fewer than LEAST_WORDS words, or where over MOST_REPEATED per cent of its words stand in
    windows of WIDTH words that occur again in it. One that passes is kept unless its character classes or its common words
    are further than a limit from those of every language; a text of fewer than JUDGED_WORDS words or JUDGED_CHARS characters in words,
    and all texts where there is no reference, are kept by the base rules alone (their distances are null).

    Null and empty texts have no words and fail. Texts may be of any length and are taken whole. Repeated rows are repeated,
    equal texts are judged alike; an empty table gives an empty one; only the id and the text are read, so other columns,
    whatever their names, change nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                base = base_counts(part.column(1))
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                by_class, by_word, words = sent.value.distances(part.column(1))
                known = (base["word_chars"] >= JUDGED_CHARS) & (words >= JUDGED_WORDS) & bool(sent.value.languages)
                far = known & ((by_class > class_limit) | (by_word > word_limit))
                measured = [pa.array(x, mask=~known) for x in (by_class, by_word)]
                yield pa.record_batch([part.column(0), *(pa.array(base[c]) for c in counts), pa.array(failed), pa.array(~failed & ~far), *measured], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(vec.tidy(run), ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else 'double'}" for f in schema))


def quality(docs: DataFrame) -> DataFrame:
    """``judged`` by the references of the languages of ``docs``."""
    return judged(docs, learn(docs))
