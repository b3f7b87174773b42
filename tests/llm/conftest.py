import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty and long texts, odd white space, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(11)
    passage = prose(rng, 60, 10**6)
    base = prose(rng, 200, 10**6)
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d", "a b c d", "A B C D", "x " * 30, "é ß 中文\x0b\x0c done", "¡no!", "12 34 %%", base, base, prose(rng, 20000, 5000)]
    for _ in range(12):  # near copies: one word changed here and there
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 40, 10**6) + " " + passage + "\n" + prose(rng, 30, 10**6) for _ in range(6)]
    texts += [prose(rng, rng.randrange(1, 300), 40) for _ in range(40)]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[12]]  # repeated rows


@pytest.fixture(scope="session")
def documents(spark, messy):
    return spark.createDataFrame(messy, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def bare(nothing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bare"))
    nothing.write.parquet(f"{path}/documents.parquet")
    return path
