import random

import pytest
from texts import prose

#: Columns whose names operators use inside.
CLASH = "keep_id long, kept string, n long, h long, digest string, size int, score double, _keep int, starts int, salt int"


def corpus():
    """(doc_id, text): prose, exact and near copies, a hot text, shared passages, odd and empty texts, nulls."""
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(5, 120))) for i in range(60)]
    shared = prose("shared", 40)
    hot = prose("hot", 60)
    for i in range(60, 80):
        rows.append((i, hot))
    for i in range(80, 95):  # near copies of each other
        w = hot.split()
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(95, 105):
        rows.append((i, f"{prose(1000 + i, 15)}\n{shared} {prose(2000 + i, 9)}"))
    rows += [
        (105, None), (106, ""), (107, " \t\n "), (108, "a"), (109, "A"), (110, "a b c"), (111, "A  B\tC"), (112, "é ñ 日本語 ▁x <|endoftext|> 'tis don't"),
        (113, "ha " * 400), (114, prose("long", 6000)), (115, "x" * 3000), (116, rows[0][1].replace(" ", "  ")), (117, rows[1][1].upper()), (118, "\x00\x01 z\x7f"),
    ]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clash(spark, rows):
    """Columns that clash with inner names, rows that repeat, null ids."""
    out = [(i, t, *[None] * 10) for i, t in [*rows[:30], rows[0], rows[0], (None, rows[1][1]), (None, "only here"), (None, None)]]
    return spark.createDataFrame(out, "doc_id long, text string, " + CLASH).cache()
