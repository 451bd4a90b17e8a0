import random

import pytest

SCHEMA = "doc_id long, text string, slot string, digest int, chunk double, data string, node string, n_words int"


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty, blank, short, long, equal and nearly equal texts, repeated identifiers."""
    rng = random.Random(11)
    vocabulary = ["alpha", "beta", "Gamma", "delta.", "épsilon", "zeta,", "eta", "theta", "iota", "kappa"]
    vocabulary += [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = draw(60), draw(120)
    rows = [None, None, "", " \n\t", "one", "one two three", "ONE  two\tthree", "alpha beta"]
    rows += [base, base, base.upper(), base.replace(" ", "\n"), base + " end", "start " + base]
    for i in range(12):
        words = base.split()
        words[(7 * i) % len(words)] = f"new{i}"
        rows.append(" ".join(words))
    rows += [f"{draw(rng.randint(3, 80))} {passage} {draw(rng.randint(0, 50))}" for _ in range(8)]
    rows += [passage + " " + passage, draw(9_000), "x" * 5_000, "line again\n" * 400]
    rows += [draw(rng.randint(1, 60)) for _ in range(20)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark, texts):
    """Those texts as documents with clashing extra columns."""
    rows = [(i, t, "s", i, 1.0, "d", None, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, texts):
    """Rows that come twice, and rows without an identifier."""
    rows = [(i, t) for i, t in enumerate(texts[:20])]
    rows += rows[5:12] + [(None, texts[8]), (None, None), (None, "nobody's text")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def corpus(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
