import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ro", "su", "ta") for c in ("x", "ve", "po", "")]
OTHER = [f"{a}{b}" for a in ("zu", "qua", "gri", "blo") for b in ("ssen", "chten", "fen", "rke")]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, size long"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.1, "x", 3) for i, t, lang, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    r = random.Random(3)
    long = prose(r, 30_000)
    base = prose(r, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (4, base, "en", "b"), (5, base, "en", "a"), (6, " ".join(near), None, "b"), (6, " ".join(near), None, "b"), (None, "no id here", "en", None), (8, "\n\n", "xx", "c"), (9, "١٢٣ 漢字 <|endoftext|> don't é", "en", "c"), (10, "!!! 12 --", "en", "a")]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
