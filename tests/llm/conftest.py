"""An awkward documents table: nulls, empty, short, very long and repeated texts, ties, clashing extra columns."""
import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, kept string, score string, "
          "label string, runs string, words string, batch string, key string, component_id string, row string, slot string")


def sentence(rng, n, words=("alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "été", "ñu", "42")):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def awkward_rows():
    rng = random.Random(3)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 90)
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: "   ", 7: "one", 8: "two words", 9: "two words",
        10: sentence(rng, 6000), 11: sentence(rng, 40) + " " + passage + " " + sentence(rng, 35),
        12: sentence(rng, 20) + " " + passage + " " + sentence(rng, 45), 13: passage, 14: "x" * 3000,
        15: "... !!! 123", 16: sentence(rng, 4), 17: "\n\t", 18: "日本語のテキスト と 日本語", 19: base.upper(),
    }
    rows = []
    for doc_id, text in texts.items():
        lang = None if doc_id % 5 == 0 else ("en" if doc_id % 2 else "fr")
        rows.append((doc_id, text, lang, None if doc_id == 8 else f"s{doc_id % 3}", len(text or "")))
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a text without an id " + sentence(rng, 30), "en", "s1", 10))
    rows.append((None, None, None, None, None))
    return [(*r, *["x"] * 11) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
