import random

import pytest

WORDS = "the of and to in is on at by for alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat in sequence."""
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) + str(own.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, copies, near copies, shared passages, a long text."""
    long = prose(1, 9000)
    passage = prose(2, 60)
    near = prose(3, 120)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "!!! ??? 123"), (5, "Ünï cödé ßtraße 😀 漢字"), (6, near), (7, near.replace("alpha", "ALPHA")), (8, near + " tail words here"),
        (9, prose(4, 80) + " " + passage + " " + prose(5, 80)), (10, prose(6, 40) + " " + passage), (11, passage), (11, passage), (12, "a " * 400), (13, "one two"), (14, "One TWO"),
        (15, long), (16, long[: len(long) // 2]), (None, near), (None, None), (17, prose(7, 30) + " " + near.split(" ", 5)[5]), (18, "x" * 500), (19, "x" * 350),
    ]
    return rows + [(100 + k, f"{near} extra{k}") for k in range(30)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with columns whose names the operators use themselves."""
    rows = [(i, t, "en", 0.5, k, "x") for k, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, block int, row string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def small_rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
