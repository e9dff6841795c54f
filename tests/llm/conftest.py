import random

import pytest

EXTRA = "lang string, source string, score double, ids string, decoded int, n int, key long, component long, `__text` string, `__cuts` int, part int"


def rows_of(texts, start=0):
    """Documents with further columns whose names the operators use themselves."""
    return [(k, t, "en", "s", 0.5, "x", 1, 2, 3, 4, "t", 5, 6) for k, t in enumerate(texts, start)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, start=0: frame(spark, rows_of(texts, start))


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


def word(k):
    """An invented word for each number."""
    return "w" + "".join("abcdefghij"[int(d)] for d in str(k))


def words(rnd, n, size=1200):
    """n invented words."""
    return [word(rnd.randrange(size)) for _ in range(n)]


@pytest.fixture
def rnd():
    return random.Random(5)


#: Texts that are easily mishandled.
ODD = [None, "", " ", "\n\t\v", "one", "one two three four", "one two three four five", "ONE two Three four five", "a\x00b \x1c c d", "▁ ▁▁x  y ", "<|endoftext|> a<|endoftext|>", "日本語 テキスト é ñ", "word " * 3000, "x" * 20000, "a  b   c    ", "'s it's ''", "  \u0085 z"]
