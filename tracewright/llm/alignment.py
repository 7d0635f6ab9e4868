"""Two tokenizers' tokens of the same texts, aligned by bytes with a dangling-suffix transducer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .bpe import byte_pairs
from .store import settle

#: Words and transitions kept per worker; beyond that the cache starts anew.
KEPT_WORDS, KEPT_STEPS = 400_000, 400_000
#: New words that are encoded and walked in one piece.
AT_ONCE = 200
#: Id pairs whose counts are sent to all tasks, 17 bytes each: the most counted ones. Others are joined.
BROADCAST_PAIRS = 2_000_000

#: What a step of the transducer takes: the first token of a group (A's), one of B, one more of A.
FIRST, OF_B, OF_A = 0, 1, 2


class Pieces:
    """A sentencepiece vocabulary and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.token = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        #: No piece goes on past a space, so that words can be encoded one by one.
        self.by_words = not any("▁" in x.lstrip("▁") for x in names)


class Transducer:
    """Walks two token sequences of the same bytes; the state is which side leads and the bytes it is ahead by.

    The side that is behind gives the next token. That token overlaps the last token of the side ahead, and no other one
    that is done; so a step is one link. A group closes where nothing is left over. What a step does depends on the state
    and the token's id only and is kept; states are numbered, 0 being the empty one.
    """

    def __init__(self, a_bytes, b_bytes):
        self.bytes = (a_bytes, b_bytes)
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple[bool, bytes], int] = {}
        self.states: list[tuple[bool, bytes]] = [(True, b"")]
        self.a_leads: list[bool] = [True]
        self.begin: dict[int, int] = {}
        self.steps: dict[int, int] = {}

    def _number(self, a_leads: bool, ahead: bytes) -> int:
        if not ahead:
            return 0
        got = self.numbers.get((a_leads, ahead))
        if got is None:
            got = self.numbers[a_leads, ahead] = len(self.states)
            self.states.append((a_leads, ahead))
            self.a_leads.append(a_leads)
        return got

    def _started(self, token: int) -> int:
        state = self.begin[token] = self._number(True, self.bytes[0][token])
        return state

    def _stepped(self, key: int) -> int:
        """The state after a token of the side behind; ValueError where the bytes differ."""
        a_leads, ahead = self.states[key >> 24]
        own = self.bytes[a_leads][key & 0xFFFFFF]
        if not own or not (ahead.startswith(own) or own.startswith(ahead)):
            raise ValueError("the bytes differ")
        state = self.steps[key] = self._number(a_leads, ahead[len(own) :]) if len(own) <= len(ahead) else self._number(not a_leads, own[len(ahead) :])
        return state

    def walk(self, a: list[int], b: list[int]) -> np.ndarray | None:
        """What each step takes (FIRST, OF_B or OF_A); None where the bytes differ."""
        if len(self.steps) > KEPT_STEPS:
            self._restart()
        begin, steps, leads = self.begin.get, self.steps.get, self.a_leads
        taken = bytearray()
        add, of_a, of_b = taken.append, iter(a), iter(b)
        try:
            for token in of_a:
                state = begin(token) or self._started(token)
                add(FIRST)
                while state:
                    if leads[state]:
                        key = state << 24 | next(of_b)
                        add(OF_B)
                    else:
                        key = state << 24 | next(of_a)
                        add(OF_A)
                    state = steps(key)
                    if state is None:
                        state = self._stepped(key)
        except (StopIteration, ValueError):
            return None
        return np.frombuffer(taken, np.uint8) if next(of_b, None) is None else None


class Aligner:
    """Alignments of texts; words that no token crosses are walked once and kept."""

    def __init__(self, a_path: str, b_path: str):
        self.pairs, self.pieces = byte_pairs(a_path), Pieces(b_path)
        self.transducer = Transducer(self.pairs.token, self.pieces.token)
        n_a, n_b = len(self.pairs.sizes), len(self.pieces.token)
        #: A token in a group's text: an id and what stands after it. Codes are ids, from ``bases`` on.
        self.shown = [f"{i}{after}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for after in ends for i in range(n)]
        self.bases = (0, n_a, 2 * n_a, 2 * n_a + n_b)
        self.words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.codes, self.code_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.links, self.link_starts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.sizes = np.zeros((0, 3), np.int64)

    def _walked(self, a: np.ndarray, b: np.ndarray):
        """(codes, tokens before each group; links, links before each group; tokens of A and of B in each group)."""
        taken = self.transducer.walk(a.tolist(), b.tolist())
        if taken is None:
            return None
        from_b = taken == OF_B
        i, j = np.cumsum(~from_b) - 1, np.cumsum(from_b) - 1
        group = np.cumsum(taken == FIRST) - 1
        n = int(group[-1]) + 1 if len(group) else 0
        linked = taken != FIRST
        links = a[i[linked]].astype(np.int64) << 32 | b[j[linked]]
        of_a, of_b = np.bincount(group[~from_b], minlength=n), np.bincount(group[from_b], minlength=n)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(of_a) - 1], last_b[np.cumsum(of_b) - 1] = True, True
        bases = self.bases
        codes = np.empty(len(taken), np.int32)
        starts = np.concatenate(([0], np.cumsum(of_a + of_b)))
        codes[np.arange(len(a)) + np.repeat(starts[:-1] - np.cumsum(of_a) + of_a, of_a)] = a + np.where(last_a, bases[1], bases[0])
        codes[np.arange(len(b)) + np.repeat(starts[1:] - np.cumsum(of_b), of_b)] = b + np.where(last_b, bases[3], bases[2])
        return codes, starts, links, np.concatenate(([0], np.cumsum(of_a + of_b - 1))), np.stack([of_a, of_b], 1)

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Tokens of a text by A (with a space before it) and by B; None where they don't have just these bytes."""
        own = f" {text}".encode()
        a = np.array(self.pairs.encoding.encode_ordinary(f" {text}"), np.int64)
        b = np.array(self.pieces.model.encode([text], num_threads=1)[0], np.int64)
        return (a, b) if b"".join([self.pieces.token[x] for x in b.tolist()]) == own and b"".join([self.pairs.token[x] for x in a.tolist()]) == own else None

    def _learn(self, words: list[str]) -> None:
        """Walks new words, AT_ONCE of them joined, and cuts what comes out at their ends."""
        codes, links, n_codes, n_links, sizes = [self.codes], [self.links], [], [], [self.sizes]
        known = len(self.code_starts) - 1
        queue = [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        while queue:
            some = queue.pop()
            both = self._encoded(" ".join(some))
            walked = both and self._walked(*both)
            if not walked:
                if len(some) > 1:
                    queue += [[w] for w in some]
                else:
                    self.words[some[0]] = -1
                continue
            own, starts, pairs, link_starts, counts = walked
            # a word's end is where as many bytes of A are done; it is a group's end
            group_ends = np.cumsum(self.pairs.sizes[both[0]])[np.cumsum(counts[:, 0]) - 1]
            stops = np.searchsorted(group_ends, np.cumsum([len(w.encode()) + 1 for w in some])) + 1
            begins = np.concatenate(([0], stops[:-1]))
            codes.append(own)
            links.append(pairs)
            n_codes.append(starts[stops] - starts[begins])
            n_links.append(link_starts[stops] - link_starts[begins])
            tokens = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(counts, 0)))
            sizes.append(np.column_stack((tokens[stops] - tokens[begins], stops - begins)))
            self.words.update(zip(some, range(known, known + len(some)), strict=True))
            known += len(some)
        if n_codes:
            self.codes, self.links, self.sizes = np.concatenate(codes), np.concatenate(links), np.concatenate(sizes)
            self.code_starts = np.concatenate((self.code_starts, self.code_starts[-1] + np.cumsum(np.concatenate(n_codes))))
            self.link_starts = np.concatenate((self.link_starts, self.link_starts[-1] + np.cumsum(np.concatenate(n_links))))

    def _text(self, codes: np.ndarray) -> str:
        return "".join(map(self.shown.__getitem__, codes.tolist()))[:-1]

    def align(self, texts: list[str]) -> list[tuple[str, np.ndarray, tuple[int, int, int]] | None]:
        """Of each text its groups as text, the id pairs of its links and its numbers of tokens and groups."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        # a single space before a word starts a token of both; where white space is doubled it may not
        split = [t.split(" ") if t and self.pieces.by_words and self.pairs.doubled.search(f" {t} ") is None else None for t in texts]
        known = self.words
        new = list({w for parts in split if parts for w in parts if w not in known})
        if new:
            self._learn(new)
        out = []
        for text, parts in zip(texts, split, strict=True):
            if parts is not None:
                at = np.array([known[w] for w in parts], np.int64)
                if at.min() < 0:
                    out.append(None)
                    continue
                codes, links = (vec.gathered(flat, starts[at], starts[at + 1])[0] for flat, starts in ((self.codes, self.code_starts), (self.links, self.link_starts)))
                out.append((self._text(codes), links, tuple(self.sizes[at].sum(0).tolist())))
                continue
            both = self._encoded(text) if text else None
            walked = both and self._walked(*both)
            out.append((self._text(walked[0]), walked[2], (len(both[0]), len(both[1]), len(walked[4]))) if walked else None)
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, groups, pairs, times): each text's groups ``a1,a2|b1;a3|b2`` and its linked id pairs.

    ``pairs`` holds ``a << 32 | b``, each once and ascending, as 64-bit words; ``times`` how often each is linked, as 32-bit
    words. A encodes a space and the text, B the text; special strings are plain text for both. Texts that are null or empty,
    or of which the tokens don't have just these bytes, have no tokens: zeros and empty values. A text is taken whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches):
        both = aligner(a_path, b_path)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                out = ([], [], [], [], [], [])
                for got in both.align(part.column(1).fill_null("").to_pylist()):
                    shown, links, sizes = got or ("", np.zeros(0, np.int64), (0, 0, 0))
                    pairs, times = np.unique(links, return_counts=True)
                    for column, value in zip(out, (*sizes, shown, pairs.tobytes(), times.astype(np.int32).tobytes()), strict=True):
                        column.append(value)
                yield pa.record_batch([part.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(vec.tidy(run), "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair over all rows of ``linked`` (pairs, times), and whether no other
    pair of its B id has more. Tasks add up their own rows first."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size = [], 0

        def added():
            pairs, times = (np.concatenate(x) for x in zip(*held, strict=True))
            own, which = np.unique(pairs, return_inverse=True)
            return own, np.bincount(which, weights=times, minlength=len(own)).astype(np.int64)

        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1), strict=True):
                held.append((np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int32).astype(np.int64)))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [added()]
                    size = len(held[0][0])
                    if size > 1 << 20:  # what doesn't grow together goes on
                        yield pa.record_batch([pa.array(x) for x in held[0]], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x) for x in added()], schema=schema)

    counts = linked.select("pairs", "times").mapInArrow(vec.tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = settle(counts, "pairs")
    most = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("most"))
    both = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(most, "b")
    return both.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    An id pair's count is the number of links of all rows that hold it; ``n_best`` counts the links whose pair has the most
    of its B id, ties included, ``count_sum`` adds the counts of a row's links. The ``broadcast_pairs`` pairs of the highest
    counts go to all tasks; the links of others, none of which is frequent then, are joined by pair. Repeated rows are
    repeated and count as often; ids may be null. An empty table gives an empty one; only id and text are read, so other
    columns, whatever their names, change nothing.
    """
    spark = docs.sparkSession
    rows = alignments(docs, a_path, b_path).withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = settle(pair_counts(rows), "pair-counts")
    n_pairs, low = counts.count(), 0
    if n_pairs > broadcast_pairs:  # pairs above this count are sent; the quantile is off by a 10,000th of all pairs at most
        low = counts.select(F.percentile_approx("n", 1 - broadcast_pairs / n_pairs, 10_000)).first()[0]
    most = counts.where(F.col("n") > low).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(most.column(i).to_numpy() for i in range(3)))
    kept = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "row")
    schema = pa.schema([*((c, pa.string() if c == "groups_sha256" else pa.int64()) for c in kept), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])

    def run(batches):
        keys, n, best = sent.value
        for batch in batches:
            out = [[], [], [], []]
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                own, many = np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                at, found = at[hit], many[hit]
                rest = [{"pair": p, "times": t} for p, t in zip(own[~hit].tolist(), many[~hit].tolist(), strict=True)]
                for column, value in zip(out, (int(many.sum()), int(found[best[at]].sum()), int((found * n[at]).sum()), rest), strict=True):
                    column.append(value)
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array(x, schema.field(len(kept) + i).type) for i, x in enumerate(out))], schema=schema)

    scored = rows.mapInArrow(vec.tidy(run), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, row long, n_links long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    if not low:
        return scored.select(*COLUMNS)
    scored = settle(scored, "scored")
    rare = scored.select("row", F.explode("rest").alias("link")).select("row", "link.pair", "link.times").join(counts.where(F.col("n") <= low), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*COLUMNS)
