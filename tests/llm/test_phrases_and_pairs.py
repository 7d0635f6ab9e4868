"""Collocations, alignments and quality rules held against plain Python versions."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers
import pytest

from tracewright.llm import alignment, bpe, collocations, divergence

V, P = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, best):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if a >= 30 and len(x[1]) > 1}
    covered = {(lang, p[i : i + k]) for (lang, p), a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, i + 1, x[2].decode(), *x[3:]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:best]))


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    words = ["a", "the", "New", "york", "City", "straße", "été", "x\xa0y", "😀", "of", "in"]
    seams = [" "] * 12 + ["  ", "\t", ".", ",", "\n", "; ", "\r\n", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(seams) for _ in range(rng.randrange(0, 90)))) for _ in range(250)]
    rows += [("en", "new york city hall of fame " * 200), (None, None), ("de", ""), ("fr", "one two three four five"), ("en", "ha " * 5000)]
    return [*rows, *[("en", "the new york city marathon")] * 40]


@pytest.mark.parametrize(("best", "sent"), [(2000, 1000), (7, 1000), (2000, 3)])
def test_collocations(spark, phrases, best, sent):
    """With more frequent words than are sent, ids are the words' names and a filter of fixed size says which are frequent."""
    docs = spark.createDataFrame(phrases, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, best, sent).collect())
    assert got == plain_collocations(phrases, best) and {r[0] for r in got} >= ({"en", "und"} if best > 7 else {"en"})


def test_exact_scores(spark):
    """Counts whose products pass 64 bits."""
    a, longer = 5_000_000_000_000, 4_000_000_000_000
    df = spark.createDataFrame([(a, longer)], "a long, longer long")
    row = df.select(collocations._exact(df["longer"], 100) >= collocations._exact(df["a"], 80), collocations.score(df["a"], df["a"] + 1, df["a"] + 2)).first()
    assert row[0] and row[1] == 2_000_000 * a // (2 * a + 3)


def plain_alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t, model, alphabet = Tokenizer.from_file(V), sentencepiece.SentencePieceProcessor(model_file=P), bpe._byte_alphabet()
    t.encode_special_tokens = True
    of, counts = [], collections.Counter()
    for doc_id, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        own_a = [bytes(alphabet[c] for c in t.id_to_token(x)) for x in a]
        own_b = [bytes([int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = f" {text}".encode() if text else b""
        if b"".join(own_a) != whole or b"".join(own_b) != whole:
            a, b, own_a, own_b = [], [], [], []
        ends_a, ends_b = ([0], [0])
        for ends, own in ((ends_a, own_a), (ends_b, own_b)):
            for x in own:
                ends.append(ends[-1] + len(x))
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if ends_a[i] < ends_b[j + 1] and ends_b[j] < ends_a[i + 1]]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [",".join(map(str, a[ends_a.index(p) : ends_a.index(q)])) + "|" + ",".join(map(str, b[ends_b.index(p) : ends_b.index(q)])) for p, q in zip(cuts, cuts[1:], strict=False)]
        counts.update(links)
        of.append((doc_id, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((str(d), a, b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, x in of)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    parts = ["'", "re", "ve", " ", " ", "  ", "\n", "\t", "the", "é", "😀", "<|endoftext|>", "<s>", "<0x41>", "▁", "9", "!!", "\xa0", "\x1c", "　", "ing", "中", "\x85", "\x00", "straße", " hello", " worldwide"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(None, "a b"), (3, None), (4, ""), (5, "same text"), (5, "same text"), (6, "hello " * 3000), (7, "x" * 3000)]


@pytest.mark.parametrize("sent", [1_000_000, 30, 1])
def test_alignments(spark, mixed, sent):
    """Pairs beyond those that are sent to all tasks are joined."""
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    rows = alignment.aligned(docs, V, P, sent).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in rows) == plain_alignments(mixed)


def test_transducer_states_and_bytes_that_differ():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"c", b""])
    assert t.walk([0, 1], [0, 1]).tolist() == [alignment.FIRST, alignment.OF_B, alignment.OF_B, alignment.OF_A]
    assert t.walk([2, 0, 1], [2, 2]).tolist() == [alignment.FIRST, alignment.OF_B, alignment.FIRST, alignment.OF_B, alignment.OF_A]
    assert t.walk([3], [0]) is None and t.walk([0], [0]) is None and t.walk([2], [2, 2]) is None and t.walk([0], [4, 0]) is None and t.walk([], []).tolist() == []
    assert t.steps and len(t.states) > 1


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_base_rules(spark, docs):
    rng = random.Random(9)
    parts = ["a b c d e f g h", "x", "É|", "# ", "\n", "\n", "line one\n", "line one \n", " ", "\t\n", "y z", "😀 "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)] + [(1000 + i, r["text"]) for i, r in enumerate(docs.collect())] + [(2000, "\n\n"), (2001, None)]
    got = {r["doc_id"]: r for r in divergence.quality(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "string(null) as lang").repartition(3)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(text), text
        assert r["kept"] is (not r["base_failed"]) and r["class_distance"] is None  # no language, no reference


def test_divergence(spark):
    """Junk of three kinds goes, clean texts of every learned language stay, also where labels are missing or a third is copies."""
    rng = random.Random(4)
    common = {"en": ["the", "of", "and", "to", "is", "a"], "de": ["der", "und", "die", "ist", "zu", "ein"]}
    text = lambda lang, n: " ".join((rng.choice(common[lang]) if rng.random() < 0.45 else "".join(rng.choice("abcdefghij") for _ in range(6))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize()
    copy = text("en", 300)
    rows = [(i, text("en" if i % 3 else "de", rng.randrange(60, 400)), "en" if i % 3 else "de") for i in range(300)] + [(1000 + i, copy, "en") for i in range(150)]
    rows += [(2000 + i, text("de", 200), None) for i in range(10)] + [(2500, text("en", 30), "en")]
    junk = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)), " ".join(f"{rng.randrange(10**6)}" for _ in range(200)), " ".join(rng.choice("#$%&") * 4 + "ab" for _ in range(200))]
    rows += [(3000 + i, t, "en") for i, t in enumerate(junk)]
    got = {r["doc_id"]: r for r in divergence.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert all(r["kept"] for i, r in got.items() if i < 3000), [i for i, r in got.items() if i < 3000 and not r["kept"]]
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in range(3000, 3003))
    assert got[2500]["word_distance"] is None  # too short to be judged


def test_distance_by_its_formula():
    import numpy as np

    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0]]), np.array([0.25, 0.75, 0.0])
    kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y, strict=True) if a)
    m = [(a + b) / 2 for a, b in zip(p[0], q, strict=True)]
    assert np.allclose(divergence.distance(p, q), [(kl(p[0], m) + kl(q, m)) / 2, 1.0, 1.0])
