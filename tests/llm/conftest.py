import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def sentence(rng, words=None, n=12):
    words = words or [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ion", "or", "um")]
    return " ".join(rng.choice(words) for _ in range(n))


def corpus() -> list[tuple]:
    """Documents with nulls, empty and repeated rows, copies, near copies, repeated lines and passages; ``row`` is a clashing extra column."""
    rng = random.Random(11)
    texts = ["\n".join(sentence(rng, n=rng.randint(5, 15)) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    near = texts[3].split(" ")
    near[1] = "changed"
    passage = sentence(rng, n=90)
    texts += [texts[0], texts[0], " ".join(near), f"{texts[5]}\n{passage}\n{texts[6]}", f"{texts[7]} {passage}", "", " \n ", None, "é", "ab " * 300, "x" * 900, "日本語 テスト", "one two three"]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 13}", None, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id at all here", "en", "s1", 1, None), (None, texts[1], None, None, None, None), (7, "same id other text", "fr", None, None, None)]
    rows += [(100 + i, f"banner of the site\n{sentence(rng, n=8)}\n", "en", f"s{i}", None, None) for i in range(15)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark):
    from captrix.llm.common import shared_folder

    return shared_folder(spark)


def key(t):
    return tuple((x is None, str(x)) for x in t)


@pytest.fixture(scope="session")
def same():
    """Asserts that rows are equal as bags."""

    def check(df, columns, want):
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
        assert got == sorted(want, key=key)

    return check
