import hashlib
import random

import pytest

from gristmill.llm import secrets as op
from gristmill.session import scratch_path

BITS = ["token", "PassWord", "api_key", "=", ":", " ", "'", '"', "abc", "abcdef12", "é", "AKIA", "ABCDEFGHIJ1234567",
        "0123456789abcdef" * 2, "secret", "\n", "ghp_" + "a" * 36, "ff00", "apikey", "xoxb-123456789012"]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    rows += [(None, None), (5, None), (7, "token=abcdefgh"), (7, "token=abcdefgh"), (9, "token=abcdefgh")]
    rows.append((10, "x " * 20_000 + "secret: 'abcdefgh'"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def expected(doc, text):
    spans = op.brute_force(text)
    counts = tuple(sum(k == r.kind for _, _, k in spans) for r in op.BASE)
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
    return str(doc), *counts, digest


def test_base_spans_are_those_of_the_patterns(mixed, documents):
    for df in (mixed, documents):
        got = sorted((str(r[0]), *r[1:5]) for r in op.secret_report(df).collect())
        assert got == sorted(expected(r["doc_id"], r["text"]) for r in df.collect())


def test_more_kinds_are_added(mixed):
    spans = {s.split(":")[0] for r in op.secret_report(mixed).collect() for s in r["spans"].split(",")}
    assert {"forge", "chat", "assign", "access", "hex"} <= spans


def test_ledger_scans_only_what_is_new(spark, mixed):
    ledger = scratch_path(spark, "ledger")
    entries = lambda: spark.read.parquet(ledger)
    first = sorted(map(str, op.scan(mixed, ledger).collect()))
    n = entries().count()
    assert n == mixed.selectExpr("coalesce(text, '')").distinct().count()
    assert sorted(map(str, op.scan(mixed, ledger).collect())) == first and entries().count() == n
    # One new blob under an old path, one old blob under a new path.
    more = spark.createDataFrame([(5, "password: 'hunter22'"), (11, "token=abcdefgh")], "doc_id long, text string")
    got = {r["path"]: [f["kind"] for f in r["findings"]] for r in op.scan(more, ledger).collect()}
    assert got == {5: ["assign"], 11: ["assign"]} and entries().count() == n + 1
    # A new version of one rule: only that rule runs, and old findings of it are no longer told.
    newer = (op.Rule("assign", op.BASE[0].pattern, 2, 8, (":", "="), version=2), *op.RULES[1:])
    got = {r["path"]: r["findings"] for r in op.scan(more, ledger, rules=newer).collect()}
    assert [f["rule"] for f in got[11]] == ["assign:2"]
    assert {tuple(r["scanned"]) for r in entries().collect()} == {
        tuple(r.name for r in op.RULES), ("assign:2",)
    }


def test_odd_rows(nasty, nothing, repeated, texts, spark):
    assert op.secret_report(nasty).count() == len(texts)
    assert op.secret_report(nothing).collect() == []
    assert op.secret_report(repeated).count() == repeated.count()


def test_no_python_on_the_main_path(documents):
    plan = op.secret_report(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_many_matches_in_one_text(spark):
    """Time follows the number of matches: a text of a hundred thousand takes seconds."""
    import time

    text = "é token=abcdef123 x " * 100_000
    docs = spark.createDataFrame([(1, text), (2, "token=abcdef")], "doc_id long, text string")
    began = time.perf_counter()
    rows = {r["doc_id"]: r for r in op.secret_report(docs).collect()}
    assert time.perf_counter() - began < 60
    assert (rows[1]["n_assign"], rows[2]["n_assign"]) == (100_000, 1)
    assert rows[1]["base_sha256"] == expected(1, text)[4]


def test_a_second_run_opens_its_own_parts_of_the_ledger(spark):
    ledger = scratch_path(spark, "ledger")
    docs = spark.createDataFrame([(i, f"token=abcdef{i}") for i in range(300)], "doc_id long, text string")
    op.scan(docs, ledger).count()
    one = docs.where("doc_id = 7")
    again = op.scan(one, ledger)
    slot = one.select(op.slot("blob") if "blob" in one.columns else op.slot(op.blob("text"))).first()[0]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(slot" in plan and f"= {slot})" in plan or f"slot#" in plan and f"IN ({slot})" in plan
    assert [len(r["findings"]) for r in again.collect()] == [1]
