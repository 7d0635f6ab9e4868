"""Byte-pair vocabularies on the workers: token ids and prefix counts, with caches of bounded size.

A vocabulary is loaded once per Python worker from its path. Text is cut where no token can cross (before single spaces,
or by the vocabulary's own pattern where white space is doubled), and what a piece gives is kept for the next texts.
"""

from __future__ import annotations

import base64
import json
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

#: Fixed values of the byte-level vocabulary: its pre-token pattern, and the contractions that the pattern takes whole.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'re", "'ve", "'ll")

#: Pieces kept per worker; beyond that the cache starts anew.
KEPT = 600_000


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special strings -> id) of a ``.json`` or ``.tiktoken`` file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        return {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}, special
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}


class BytePairs:
    def __init__(self, path: str):
        import tiktoken

        self.ranks, self.special = load_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.single = self.encoding._encode_single_piece
        self.token = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)
        self.doubled = regex.compile(r"[\s\x1c-\x1f]{2}")
        self.runs = regex.compile(r"\s{2,}")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.counts_of: dict[str, bytes] = {}
        self.pieces_of: dict[str, array] = {}
        self.missed = 0
        self.ids_of: dict[str, bytes] = {}
        self.pair_ok: dict[int, bool] = {}

    # prefix counts

    def _compatible(self, one: int, two: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as just these two."""
        if len(self.pair_ok) > KEPT:
            self.pair_ok.clear()
        ok = self.pair_ok[one << 32 | two] = self.single(self.token[one] + self.token[two]) == [one, two]
        return ok

    def _dynamic(self, data: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token.

        The encoding of a prefix is that of a shorter prefix and one last token; the last token is the one ending here
        that is compatible with the shorter prefix's last token, and there is exactly one. So places may be tried in any
        order; the start of the last token so far and those after it come first.
        """
        n = len(data)
        last, count, start = [-1] * (n + 1), [0] * (n + 1), 0
        rank, known, longest = self.ranks.get, self.pair_ok.get, self.longest
        for j in range(1, n + 1):
            found = -1
            for places in (range(max(start, j - longest), j), range(max(0, j - longest), start)):
                for i in places:
                    token = rank(data[i:j])
                    if token is not None:
                        if i:
                            ok = known(last[i] << 32 | token)
                            if ok is None:
                                ok = self._compatible(last[i], token)
                            if not ok:
                                continue
                        found = i
                        break
                if found >= 0:
                    break
            if found < 0:
                raise ValueError("a byte is missing in the vocabulary")
            start, last[j], count[j] = found, token, count[found] + 1
        return count

    def _piece(self, piece: str) -> array:
        """Tokens of each prefix, by character, of one pre-token."""
        got = self.pieces_of.get(piece)
        if got is None:
            count = self._dynamic(piece.encode())
            got = array("i", count[1:] if piece.isascii() else [count[e] for e in accumulate(len(c.encode()) for c in piece)])
            if piece in CONTRACTIONS:  # a part of one is a quote and a letter
                got[1] = 2
            if len(self.pieces_of) < KEPT // 2:
                self.pieces_of[piece] = got
        return got

    def _joined(self, parts: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(parts), np.int32).copy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        parts_end = flat[np.cumsum(sizes) - 1]
        flat += np.repeat(np.cumsum(parts_end) - parts_end, sizes).astype(np.int32)
        return flat

    def _chunk(self, chunk: str) -> bytes:
        out, before = array("i"), 0
        for piece in self.pattern.findall(chunk):
            own = self._piece(piece)
            out.extend([x + before for x in own] if before else own)
            before = out[-1]
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        """Counts of a word with the space before it; kept as long as there is room, and anew when most words are new."""
        got = self._chunk(" " + word)
        if len(self.counts_of) < KEPT:
            self.counts_of[word] = got
        else:
            self.missed += 1
            if self.missed > KEPT:
                self.counts_of, self.pieces_of, self.missed = {word: got}, {}, 0
        return got

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text without special strings."""
        if not text:
            return np.zeros(0, np.int32)
        if self.doubled.search(text) is None:
            first, *rest = text.split(" ")
            parts, known = [self._chunk(first)] if first else [], self.counts_of
            for word in rest:
                parts.append(known.get(word) or self._word(word))
            return self._joined(parts)
        flat = self._joined([self._piece(p).tobytes() for p in self.pattern.findall(text)])
        for m in self.runs.finditer(text):  # white space at a prefix's end is one pre-token, which later text may split
            before = int(flat[m.start() - 1]) if m.start() else 0
            flat[m.start() : m.end()] = before + np.array(self._piece(m.group()), np.int32)
        return flat

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix, by character; special strings count as one token once they are complete."""
        if self.at_special is None or self.at_special.search(text) is None:
            return self._plain(text)
        out, before = [], 0
        parts = self.at_special.split(text)
        for plain, mark in zip(parts[::2], [*parts[1::2], None], strict=True):
            flat = self._plain(plain + mark[:-1] if mark else plain) + before
            out.append(flat)
            if mark:
                before = (int(flat[len(plain) - 1]) if plain else before) + 1
                out.append(np.array([before], np.int32))
        return np.concatenate(out)

    # ids

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text as uint16 or uint32; special strings are ordinary text."""
        kind = self.kind
        if len(self.ids_of) > KEPT:
            self.ids_of.clear()
        known = self.ids_of
        split = [None if self.doubled.search(t) else t.split(" ") for t in texts]
        new = list({w for parts in split if parts for w in parts[1:] if w not in known})
        if new:  # all new words in one call: a word with its space before it is never joined to the next
            joined = " " + " ".join(new)
            ids = np.array(self.encoding.encode_ordinary(joined), np.uint32)
            ends = np.cumsum(self.sizes[ids])
            stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in new])) + 1
            ids = ids.astype(kind)
            at = 0
            for w, stop in zip(new, stops.tolist(), strict=True):
                known[w] = ids[at:stop].tobytes()
                at = stop
        out = []
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                out.append(np.array(self.encoding.encode_ordinary(text), kind))
            else:
                first = np.array(self.encoding.encode_ordinary(parts[0]), kind).tobytes() if parts[0] else b""
                out.append(np.frombuffer(first + b"".join([known[w] for w in parts[1:]]), kind))
        return out

    @property
    def kind(self):
        return np.uint16 if max(self.ranks.values()) + len(self.special) < 65536 else np.uint32

    @property
    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for token, i in self.ranks.items():
                self._sizes[i] = len(token)
        return self._sizes


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)
