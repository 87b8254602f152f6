import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, row string, salt int, slot int, class string, place long"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ing", "es", "tion", "ly", "wh"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows with nulls in any column, empty, blank and long texts, copies, near copies, repeated rows and
    repeated ids."""
    rng = random.Random(5)
    base = words(rng, 300)
    near = base.split()
    near[10] = "changed"
    passage = words(rng, 120)
    texts = [None, "", "   ", "a", "...", base, base, base + " ", " ".join(near), base.replace(" ", "\n", 3), passage, words(rng, 50) + " " + passage + " " + words(rng, 50), words(rng, 6000), "ab" * 700, "é€𝄞 " * 300, "x" * 399, "x" * 400, "same short text", "same short text"]
    texts += [words(rng, rng.randint(5, 200)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), None if t is None else len(t), "u", "r", 1, 2, "c", 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[1], (None, base, "en", "s0", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (7, "another text of a repeated id", "en", "s1", 2, "u", "r", 1, 2, "c", 3)]
    return rows


@pytest.fixture(scope="session")
def messy_docs(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
