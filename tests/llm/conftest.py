import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and unusual characters."""
    rng = random.Random(11)
    words = {"en": ["the", "house", "river", "walking", "think", "quiet"], "de": ["der", "fluss", "straße", "über", "schön", "gehen"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "ing", "er", "s"]) for _ in range(rng.randrange(3, 80))), lang, f"src{i % 4}"))
    rows += [
        (60, None, "en", "src0"),
        (61, "", None, None),
        (62, "12345 !!! ---", "en", "src1"),
        (63, " ".join(rng.choice(words["en"]) for _ in range(30_000)), "en", "src1"),
        (64, rows[5][1], "en", "src2"),
        (65, rows[5][1], "en", "src2"),
        (5, rows[5][1], "en", "src1"),
        (None, "a text without an id", "en", "src1"),
        (66, "x y　z ퟿ 😀 naïve ǅ İ", None, "src3"),
        (67, "a" * 70_000, "en", "src3"),
        (68, " \t\n\x0b\x0c\r ", "de", "src3"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
