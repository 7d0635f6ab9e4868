"""Permutations, shards, filters and seeds held against plain Python versions."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, langid, pii, token_shards

V = public_tokenizers.path("byte_bpe_50k.json")


def mixed(number, text):
    """Spark's xxhash64 of a long and a string."""
    first = xxhash.xxh64(number.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return xxhash.xxh64(text.encode(), seed=first).intdigest()


def plain_slot(x, n, key):
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(token_shards.ROUNDS):
            left, right = right, left ^ (mixed(right, f"{key}/{i}") & mask)
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 3, 64, 1000])
def test_slots_are_those_of_a_plain_network(spark, n):
    out = [r[0] for r in spark.range(n).orderBy("id").select(token_shards.permuted(F.col("id"), n, "k")).collect()]
    assert out == [plain_slot(i, n, "k") for i in range(n)]


@pytest.mark.parametrize("rows_broadcast", [None, 0])
def test_slots_by_plain_numbers(spark, docs, monkeypatch, rows_broadcast):
    if rows_broadcast is not None:
        monkeypatch.setattr(token_shards, "BROADCAST_ROWS", rows_broadcast)
    docs = docs.where("doc_id is not null and doc_id != 5")
    pairs, number, expected = bpe.byte_pairs(V), 0, {}
    for doc_id, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = pairs.ids([text])[0]
        for i in range(0, len(ids), 64):
            expected[number] = (doc_id, i // 64, ids[i : i + 64].tolist())
            number += 1
    for r in token_shards.training_shards(docs, V, 64, 16).collect():
        own = [k for k, v in expected.items() if v[:2] == (r["doc_id"], r["seq_no"])]
        assert r["slot"] == plain_slot(own[0], number, token_shards.KEY)
        assert np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist() == expected.pop(own[0])[2]
    assert not expected


def test_shards_are_read_on_from_any_slot(spark, docs, empty, tmp_path):
    placed = token_shards.training_shards(docs, V, 64, 16)
    rows = {r["slot"]: r["tokens"] for r in placed.collect()}
    path = str(tmp_path / "shards")
    for _ in range(2):  # written twice, as by a task that is run again
        listed = token_shards.write_shards(placed, path, 64, 16).collect()
    assert sum(r["rows"] for r in listed) == len(rows) and {r["first"] for r in listed} == set(range(0, len(rows), 16))
    assert len(list((tmp_path / "shards").glob("shard-*.bin"))) == len(listed) and not list((tmp_path / "shards").glob(".shard*"))
    seen, reader = [], token_shards.read_from(path, at_once=5)
    for _ in range(37):
        seen.append(next(reader))
    reader.close()  # stopped, and gone on at the next slot
    seen += list(token_shards.read_from(path, seen[-1][0] + 1, at_once=5))
    assert [s for s, _ in seen] == sorted(rows) and all(x.tobytes() == rows[s] for s, x in seen)
    assert list(token_shards.read_from(path, len(rows))) == []
    for start in (0, 37, len(rows) - 1):
        got = {r["slot"]: bytes(r["tokens"]) for r in token_shards.read_shards(spark, path, start).collect()}
        assert got == {s: bytes(t) for s, t in rows.items() if s >= start}
    token_shards.write_shards(token_shards.training_shards(empty, V), str(tmp_path / "none"))
    assert list(token_shards.read_from(str(tmp_path / "none"))) == []


def plain_grams(text):
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"\n{word}\n"
        out += [padded[i : i + n] for n in langid.SIZES for i in range(len(padded) - n + 1) if padded[i : i + n].strip("\n")]
    return out


def test_languages_by_a_plain_filter(spark):
    """Sets of n-grams instead of bits: the same languages, and scores that differ by false positives only."""
    rng = random.Random(12)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for lang, letters in {"aa": "abcdefghi", "bb": "efghijklm", "cc": "abefijmno"}.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 40))), lang) for i in range(240) for lang in [sorted(words)[i % 3]]]
    held = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", langid.held_out()).collect()}
    assert 0 < sum(held.values()) < 120
    import zlib

    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held)
    seen = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if not held[i]:
            seen[lang].update(plain_grams(text))
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    best = {g: max(seen[x][g] / total[x] for x in seen) for x in seen for g in seen[x]}
    own = {lang: {g for g, n in c.items() if n >= langid.LEAST_SEEN and n / total[lang] >= langid.SHARE * best[g]} for lang, c in seen.items()}
    order = sorted(total, key=lambda x: (-total[x], x))
    right = 0
    for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        text, lang = rows[r["doc_id"]][1:]
        grams = plain_grams(text)
        share = {x: sum(g in own[x] for g in grams) / len(grams) for x in order}
        top = max(order, key=lambda x: share[x])
        assert r["held_out"] == held[r["doc_id"]] and abs(r["score"] - share[top]) < 0.02
        assert r["lang_pred"] == top or share[top] - share[r["lang_pred"]] < 0.02
        right += held[r["doc_id"]] and r["lang_pred"] == lang
    assert right >= 0.95 * sum(held.values())


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(15)
    rows = [(i, " ".join("".join(chr(0x4E00 + 20 * lang + rng.randrange(20)) for _ in range(3)) for _ in range(30)), f"l{lang:03d}") for i in range(840) for lang in [i % 70]]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len({r["lang_pred"] for r in got}) > 64 and all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)


def test_languages_that_are_equal(spark):
    """Of equal counts the language that was seen more is taken, then the first by name."""
    docs = spark.createDataFrame([(i, "same words here", ("xx", "yy")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.languages(docs).collect()} == {"xx"}


def test_a_document_in_another_language_goes(spark):
    rng = random.Random(8)
    words = {"en": "the house river walking think quiet".split(), "de": "der fluss straße über schön gehen".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.identified(docs, ("en",)).collect()} == set(range(0, 200, 2))
    assert langid.identified(docs).count() == 200


def plain_feistel(x, a, b, key, tweak):
    h, low = divmod(x, b)
    for i in range(pii.ROUNDS):
        shift = lambda other, size, i=i: int(hashlib.sha256(f"{key}/{tweak}/{i}/{other}".encode()).hexdigest()[:15], 16) % size
        if i % 2 == 0:
            h = (h + shift(low, a)) % a
        else:
            low = (low + shift(h, b)) % b
    return h * b + low


def test_pseudonyms_are_those_of_a_plain_network(spark):
    from datetime import date, timedelta

    base = date(1900, 1, 1)

    def moved(d):
        n = (d - base).days
        first, a, b = [s for s in pii.SPANS if s[0] <= n][-1]
        return base + timedelta(first + plain_feistel(n - first, a, b, "k", "date"))

    dates = [date(1, 1, 1), date(1066, 10, 14), date(1898, 7, 16), date(1899, 12, 31), base, date(1999, 12, 31), date(2100, 5, 3), date(2100, 5, 4), date(2500, 2, 28), date(9999, 1, 1), date(9999, 12, 31)]
    ips, ssns = ["10.0.0.1", "255.255.255.255"], ["123-45-6789", "899-99-9999", "001-01-0001"]
    values = [f"{d.year:04d}-{d.month:02d}-{d.day:02d}" for d in dates] + ips + ssns
    docs = spark.createDataFrame([(i, f"at {v}, so") for i, v in enumerate(values)], "doc_id long, text string")
    got = [r["text"][3:-4] for r in sorted(pii.report(docs, "k").collect())]
    assert got[: len(dates)] == [f"{d.year:04d}-{d.month:02d}-{d.day:02d}" for d in map(moved, dates)]

    def ip(v):
        y = plain_feistel(int.from_bytes(bytes(map(int, v.split("."))), "big"), 65536, 65536, "k", "ip")
        return ".".join(map(str, y.to_bytes(4, "big")))

    def ssn(v):
        area, group, serial = map(int, v.split("-"))
        y = plain_feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "k", "ssn")
        a = y // (99 * 9999) + 1
        return f"{a + (a >= 666):03d}-{y // 9999 % 99 + 1:02d}-{y % 9999 + 1:04d}"

    assert got[len(dates) :] == [ip(v) for v in ips] + [ssn(v) for v in ssns]
    assert sum(a * b for _, a, b in pii.SPANS) == (date(9999, 12, 31) - date(1, 1, 1)).days + 1


@pytest.mark.parametrize("words_broadcast", [None, 0])
def test_short_items_and_shared_passages(spark, monkeypatch, words_broadcast):
    """Items of a few words stand as a whole; a passage of all documents contaminates where it is most of an item."""
    if words_broadcast is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", words_broadcast)
    shared = "this notice stands in every document here"
    docs = spark.createDataFrame([(i, f"{shared} {x}") for i, x in enumerate(["zero", "one rare pair here", "pair rare", "and then much more of the long item about rivers follows it"])], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare pair"), (2, f"{shared} and then much more of the long item about rivers"), (3, "Zero"), (4, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1), (3, 2), (0, 3)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {2}
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0 and decontaminate.clean(docs, items.where("false")).count() == 4


def test_tiles_of_one_length_come_from_the_front():
    a = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.tiles(a, a[:5]) == [(0, 0, 5)]
    assert decontaminate.tiles(a[:5], a) == [(0, 0, 5)]
    assert decontaminate.tiles(np.array([7, 1, 2], np.uint64), np.array([1, 2], np.uint64), 2) == [(1, 0, 2)]
