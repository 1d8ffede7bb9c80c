import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A few dozen documents with every odd case: null and empty texts, one word, marks, copies, near copies, a long one."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(1, 61):
        text = " ".join(r.choices(vocabulary, k=r.randint(3, 120)))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(text)))
    base = rows[5][1].split()
    rows += [(101, rows[5][1], "en", "a", 0), (102, " ".join(base[:-1] + ["zzz"]), "en", "a", 0), (103, rows[5][1].upper(), "en", "b", 0)]
    rows += [(201, None, None, None, None), (202, "", "en", "a", 0), (203, "  \n\t ", "en", "a", 5), (204, "word", "de", "b", 4), (205, "WORD", "de", "b", 4), (206, "é ü", "de", "b", 3), (207, "12 34 -- !!", "en", "c", 11)]
    rows += [(301, " ".join(r.choices(vocabulary, k=20_000)), "en", "a", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def folder(docs, tmp_path):
    """docs as a folder of tables."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
