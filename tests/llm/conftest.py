import random

import pytest

WORDS = "the of anth erble thou tion ness wher Éclair über niño and it was for with that not are".split()


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, edge cases, one long text; ids are not in order."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", str(rng.randrange(99))]) for _ in range(k))
    shared = prose(60)
    rows = []
    for i in range(n):
        text = prose(rng.randrange(1, 90))
        if i % 5 == 1:
            text = f"{text} {shared} {prose(5)}"
        if i % 7 == 2 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 3 and rows:
            text = (rows[rng.randrange(len(rows))][1] or "") + " more"
        rows.append((i * 3 + 5, text))
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (6, "a b\x0bc\x1cd  e"), (7, prose(6000)), (None, prose(30)), (None, None), (9001, "\U0001f600 " * 40)]
    rows += [rows[8], rows[8]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, id string, block int, kept double").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string, block int, kept double")


def by_id(df) -> list:
    """Rows in order of id, null first, then of all they hold."""
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
