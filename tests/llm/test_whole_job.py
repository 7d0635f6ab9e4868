"""Inputs on which a cap or a shortcut would lose results."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import imatch, jaccard, langid, licenses, pii


def components(sets, p):
    """The smallest number reachable by links, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [2, 30])
def test_rows_of_a_dealt_column_meet_across_its_blocks(spark, monkeypatch, block):
    rng = random.Random(23)
    notice = [f"n{i}" for i in range(60)]
    # few texts are the notice and little else; many have it among so many own words that it isn't leading
    texts = [" ".join([*notice, *(f"a{i}_{j}" for j in range(rng.randrange(4)))]) for i in range(24)]
    texts += [" ".join([*notice, *(f"b{i}_{j}" for j in range(300))]) for i in range(120)]
    texts += [" ".join([*notice[:30], *(f"c{i // 2}_{j}" for j in range(40)), f"d{i}"]) for i in range(24)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == dict(enumerate(components(sets, 85)))


@pytest.mark.parametrize(("block", "seed"), [(40, 1), (100, 2), (400, 3), (100, 4)])
def test_hot_and_rare_columns_in_shared_slots(spark, monkeypatch, block, seed):
    """Few sketch slots, so that rare shingles share one with hot ones and are dealt like them."""
    rng = random.Random(seed)
    notice = [f"n{i}" for i in range(100)]
    texts = []
    for i in range(220):
        cut = rng.randrange(80)
        texts.append(" ".join([*notice[cut : cut + 20], f"u{i}_{rng.randrange(3)}"]))
        own = [f"o{i}_{j}" for j in range(rng.choice([1, 2, 4, 60]))]
        texts.append(" ".join(notice[: rng.choice([90, 95, 100])] + own))
        twin = [f"t{i}_{j}" for j in range(25)]
        texts += [" ".join(twin), " ".join([*twin[:-1], "other"])]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SLOTS", (jaccard.PART, jaccard.PART))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == dict(enumerate(components(sets, 85)))


def test_documents_are_joined_where_the_filter_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_BITS", (64, 64, 64))
    texts = [f"{' '.join(f'w{i // 2}_{j}' for j in range(30))} x{i}" for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0] + "y"), (None, "alone here and there")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert {(i, i - i % 2) for i in range(40)} <= got and len(got) == 42


def test_all_templates_of_one_file_are_found(spark):
    texts, names = [t for _, t, _ in licenses.TEMPLATES], sorted(label for label, _, _ in licenses.TEMPLATES)
    rng = random.Random(4)
    orders = [texts, texts[::-1], *(rng.sample(texts, len(texts)) for _ in range(4))]
    # the last one's common words stand beside all the rarer licence words, out of their order
    rest = " ".join(sorted({w for t in texts for w in t.split()}))
    files = [" some words between ".join(o) for o in orders] + [f"{rest} {dict((a, b) for a, b, _ in licenses.TEMPLATES)['cc']} {rest}"]
    docs = spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")
    rows = {r["doc_id"]: r["hits"] for r in licenses.scan(docs).collect()}
    for i, order in enumerate(orders):
        places, at = {}, 0
        for text in order:
            places[next(a for a, b, _ in licenses.TEMPLATES if b == text)] = (at, len(text.split()))
            at += len(text.split()) + 3
        assert sorted(h["label"] for h in rows[i]) == names
        assert all((h["at"], h["agree"], h["share"]) == (*places[h["label"]], 1.0) for h in rows[i])
    assert [h["label"] for h in rows[len(orders)]] == ["cc"]


def test_near_copies_of_a_hot_group_have_like_fingerprints(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    notice = [word() for _ in range(80)]
    vocabulary = [word() for _ in range(300)]
    plain = " ".join(notice)
    variants = [plain, plain.upper(), plain.title(), ", ".join(notice), " ".join(notice[:-1])]
    rows = [(i, variants[i % 5]) for i in range(40)]  # a third of all rows, each followed by a near copy
    rows += [(40 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    assert len({got[i]["fingerprint"] for i in range(40) if i % 5 < 4}) == 1
    assert all(got[i]["near_next"] >= 0.7 for i in range(39))


def test_texts_of_common_terms_only_are_like_their_near_copies(spark):
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my".split()
    rows = [(i, f"{' '.join(common[:-(1 + i % 2)])} {'own' * (i > 3)}{chr(97 + i) * 3 * (i > 3)}") for i in range(60) if i < 26]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    assert got[0]["fingerprint"] == got[2]["fingerprint"] and len(got[0]["fingerprint"]) == 8 * imatch.HASHES
    assert got[0]["near_next"] >= 0.5


def test_texts_stay_when_no_language_was_learned(spark):
    rows = [(i, t, None) for i, t in enumerate(["a clean text", "noch ein Text", "Ж", "12 !?", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.identified(docs).collect()} == {0, 1, 2}


def test_letters_of_no_language_go_by_the_score(spark):
    rng = random.Random(6)
    words = {"en": "the house river walking think quiet other water".split(), "de": "der fluss straße über schön gehen wasser andere".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 60))), lang if i % 5 else None) for i in range(400) for lang in [("en", "de")[i % 2]]]
    junk = [(400 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(30)), None) for i in range(10)]
    junk += [(410, "слово за словом", None)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(3)
    assert {r["doc_id"] for r in langid.identified(docs).collect()} == set(range(400))


def test_all_spellings_of_a_value_have_one_pseudonym(spark):
    groups = [
        ["+14155550123", "4155550123", "14155550123", "415-555-0123", "+1 (415) 555-0123", "+1 415 555 0123"],
        ["+442079460958", "+44 20 7946 0958", "+44 2079 460958", "+44 (20) 7946-0958"],
        ["+49 30 901820", "+4930901820", "+49 30 90 18 20"],
        ["1999-12-31", "31-12-1999", "12-31-1999", "31.12.1999", "12/31/1999", "31 December 1999", "December 31, 1999", "31 Dec 1999", "Dec. 31, 1999", "31. December 1999"],
    ]
    flat = [(i, f"on {v}, so") for i, v in enumerate(v for g in groups for v in g)]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(flat, "doc_id long, text string"), "key").collect()}
    assert all(r["changed"] for r in out.values())
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    i = 0
    for k, group in enumerate(groups):
        seen = set()
        for old in group:
            new = out[i]["text"].removeprefix("on ").removesuffix(", so")
            if k == 3:
                year = re.search(r"\d{4}", new)[0]
                two = re.findall(r"(?<!\d)\d\d(?!\d)", new)
                named = re.search("[A-Za-z]+", new)
                seen.add((year, *sorted([*two, f"{months.index(named[0][:3].lower()) + 1:02d}"] if named else two)))
            else:
                seen.add(re.sub(r"\D", "", new)[-10 if k == 0 else 0 :])
                assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)
            i += 1
        assert len(seen) == 1, (group, seen)
    kept = ["12345678901234567890123", "3.4155550123", "1155550123", "+33 1", "31 Movember 1999", "45-45-1999"]
    same = pii.report(spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string"), "key").collect()
    assert not any(r["changed"] for r in same)


def test_spans_of_a_long_text_with_many_matches(spark):
    """200,000 strings in one text of some MB, with base spans between them: places as a plain search has them."""
    import hashlib
    import re
    import time

    from tracewright.llm import secrets

    words = [hashlib.sha256(str(i).encode()).hexdigest()[:20].translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(200_000)]
    for i in range(0, len(words), 5_000):
        words[i] = "token=" + hashlib.md5(str(i).encode()).hexdigest()
    text = "é " + " ".join(words)
    model = secrets.train(secrets.random_strings(spark).union(secrets.numbers(spark)))
    began = time.time()
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["found"]
    assert time.time() - began < 60
    got = [(s["start"], s["end"]) for s in found if s["kind"] == "assign"]
    assert got == [m.span() for m in re.finditer(r"token=[0-9a-f]+", text)]
    assert len(found) > 40 + 40 and [s["start"] for s in found] == sorted(s["start"] for s in found)
    base = [s for s in found if s["kind"] != "markov"]
    ends = {s["end"] for s in base}
    assert all(text[s["start"] - 1] == " " and s["end"] not in ends for s in found if s["kind"] == "markov")


def test_running_values(spark):
    from tracewright.llm import spans

    df = spark.createDataFrame([([3, 1, 4],), ([],), (list(range(2000)),)], "v array<int>")
    for row in df.select("v", spans.before(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), spans.before(F.col("v"), F.lit(-1), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        v = row["v"]
        sums, tops = [0], [-1]
        for x in v:
            sums.append(sums[-1] + x)
            tops.append(max(tops[-1], x))
        assert row["s"] == sums[:-1] and row["m"] == tops[:-1]


def test_a_preamble_of_many_items_makes_no_pairs(spark):
    """4,000 items begin with the same twelve words; a text that has these words only isn't tiled with any of them."""
    import time

    import numpy as np

    from tracewright.llm import decontaminate

    preamble = "answer the following question with one word and give no reason now".split()
    rng = random.Random(3)
    rows = [(i, " ".join(preamble + [f"q{rng.randrange(10**6)}" for _ in range(20)])) for i in range(4000)]
    hashed = lambda t: decontaminate.word_hashes(pa.array([t]))[0]
    items = decontaminate.Items([(i, hashed(t)) for i, t in rows])
    own, whole = hashed(" ".join(["x"] * 30 + preamble + ["y"] * 30)), hashed("z " * 40 + rows[7][1])
    items.met(own, 0.6)
    began = time.time()
    assert len(items.met(own, 0.6)) == 0 and time.time() - began < 0.05
    assert items.met(whole, 0.6).tolist() == [7]
    got = decontaminate.contaminated(spark.createDataFrame([(1, "x " * 30 + " ".join(preamble)), (2, "z " * 40 + rows[7][1])], "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(2, 7)] and np.isclose(got[0]["coverage"], 1.0)


def test_references_are_learned_from_all_texts(spark):
    """45,000 different texts: a sample of any size would miss the exact shares of two words."""
    import numpy as np

    from tracewright.llm import divergence

    docs = spark.range(45_000).selectExpr("id AS doc_id", "concat_ws(' ', if(id % 3 = 0, 'third', 'other'), 'w' || id) AS text", "'en' AS lang")
    known = divergence.learn(docs)
    of = dict(zip(known.words[0].tolist(), known.shares[0].tolist(), strict=False))
    name = lambda w: int(divergence._terms(pa.array([w]))[0][0])
    assert known.languages == ["en"] and set(of) == {name("third"), name("other")}
    assert np.allclose([of[name("third")], of[name("other")], known.shares[0][-1]], [1 / 6, 1 / 3, 1 / 2], rtol=0, atol=1e-11)


@pytest.mark.parametrize("first", [1, 7, 1024])
def test_references_by_a_plain_version(spark, monkeypatch, first):
    """Copies count once, also where they put words of one text before all others, and texts of the same words aren't copies."""
    import collections

    import numpy as np

    from tracewright.llm import divergence

    rng = random.Random(31)
    texts = [(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))), lang) for lang in ("en", "de") for _ in range(60)]
    texts += [(" ".join(f"rare{i}" for i in range(40)), "en")] * 300 + [("A b", "en"), ("a B", "en"), ("a b", "de"), ("", "de"), ("?!", "en"), ("?!", "xx")] * 5
    texts += [("-- !", "marks")] * 25 + [("b a", None), (None, "en")]
    monkeypatch.setattr(divergence, "FIRST_ROUND", first)
    monkeypatch.setattr(divergence, "COMMON", 9)
    known = divergence.learn(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5))
    assert known.languages == ["de", "en", "marks"]
    name = lambda w: int(divergence._terms(pa.array([w]))[0][0])
    for at, lang in enumerate(known.languages):
        own = sorted({t for t, x in texts if x == lang and t is not None})
        words = [[name(w) for w in re.findall("[a-z0-9]+", t.lower())] for t in own]
        have = collections.Counter(w for ws in words for w in set(ws))
        enough = max(2, -(-len(own) // 50))
        signed = lambda w: w - (w >> 63 << 64)
        common = sorted((w for w in have if have[w] >= enough), key=lambda w: (-have[w], signed(w)))[:9]
        assert known.words[at].tolist() == sorted(common)
        shares = [[ws.count(w) / len(ws) for w in sorted(common)] + [sum(w not in common for w in ws) / len(ws)] for ws in words if ws]
        total = np.sum(shares, 0) if shares else np.zeros(1)
        assert np.allclose(known.shares[at], total / (total.sum() or 1), rtol=0, atol=1e-10)
        kinds = divergence.class_counts(pa.array(own))
        kinds = kinds[kinds.sum(1) > 0]
        total = (kinds / kinds.sum(1)[:, None]).sum(0)
        assert np.allclose(known.classes[at], total / total.sum(), rtol=0, atol=1e-10)
