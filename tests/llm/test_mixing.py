"""Mixing: targets by plain water filling, the words near them, and the design of the sample."""

import re
from collections import defaultdict

import pytest
from gristmill.llm.mixing import mix_report, mixed


def targets(sizes, shares=(5, 2, 1), most=3):
    """Deal out, cap, and deal out again what is over, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        rest = total - sum(out.values())
        part = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if part[s] > most * sizes[s]]
        if not over:
            return out | part
        out |= {s: most * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def gathered(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r["source"]].append(r)
    return by


@pytest.mark.parametrize("names", [["a", "b", None], ["z"], ["a", "b", "c", "d", "é", "ab", None]])
def test_targets_and_words(spark, names):
    rows = []
    for i in range(900):
        source = names[0] if i % 3 == 0 else names[i * 7 // 3 % len(names)]
        rows.append((i, " ".join(["w"] * (1 + i * 37 % 90)), source, 5, 1.0))
    rows += [(None, None, names[-1], 1, 0.0), (7, "", names[0], 1, 0.0)] + [(5, "same again", names[0], 1, 0.0)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int, part double")
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += words(text)
    want, got = targets(sizes), gathered(mixed(docs))
    assert sum(map(len, got.values())) == len(rows)
    for source, found in got.items():
        assert {r["source_size"] for r in found} == {sizes[source]}
        assert found[0]["target"] == pytest.approx(want[source])
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in found)
        assert abs(sum(r["taken"] for r in found) - want[source]) <= 3
        whole = int(want[source] // sizes[source]) if sizes[source] else 0
        assert {r["copies"] for r in found} <= {whole, whole + 1}
    again = sorted(map(tuple, mix_report(docs.repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, mix_report(docs).collect()), key=repr)


def test_large_source_is_cut_within_a_bucket(spark):
    """Several buckets a source: the cut and the sums agree with ranking everything."""
    docs = spark.range(9_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 17 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source"
    )
    by = gathered(mixed(docs))
    for found in by.values():
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 3
    extra = [r for r in by["b"] if r["copies"] > min(x["copies"] for x in by["b"])]
    assert len(extra) == pytest.approx(6_000 * (by["b"][0]["target"] / by["b"][0]["source_size"] % 1), rel=0.1)


def test_unequal_inclusion(spark):
    """With a preference, expected copies differ and none exceeds the bound."""
    docs = spark.range(6_000).selectExpr(
        "id as doc_id", "'two words' as text", "if(id < 3000, 'a', 'b') as source",
        "case when id % 5 = 0 then null when id % 2 = 0 then 4.0 else 1.0 end as liked",
    )
    rows = mixed(docs, preference="liked").collect()
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 and max(r["copies"] for r in own) <= 3
        liked = [r["copies"] for r in own if r["doc_id"] % 5 and r["doc_id"] % 2 == 0]
        others = [r["copies"] for r in own if r["doc_id"] % 5 == 0 or r["doc_id"] % 2]
        factor = min(4, 3 / (sum(others) / len(others)))
        assert sum(liked) / len(liked) == pytest.approx(factor * sum(others) / len(others), rel=0.2)


def test_a_source_at_its_bound_takes_whole_copies_only(spark):
    docs = spark.range(1_000).selectExpr("id as doc_id", "'a few words' as text", "if(id < 50, 'a', 'b') as source")
    by = gathered(mixed(docs))
    assert {r["copies"] for r in by["a"]} == {3} and by["a"][0]["target"] == 450.0
    assert abs(sum(r["taken"] for r in by["b"]) - 2_550) <= 3
    liked = docs.selectExpr("*", "CAST('NaN' AS DOUBLE) AS liked")
    assert gathered(mixed(liked, preference="liked")).keys() == by.keys()


def test_nothing_and_no_words(spark):
    schema = "doc_id long, text string, source string"
    assert mixed(spark.createDataFrame([], schema)).count() == 0
    rows = mixed(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert {(r["target"], r["taken"], r["source_size"]) for r in rows} == {(0.0, 0, 0)}
