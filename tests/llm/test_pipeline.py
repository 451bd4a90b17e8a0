import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline as pipeline
from gristmill.llm import contamination, nearcopies, queries, toxicity
from gristmill.llm.packing import END, Encoder


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_run_against_brute_force(spark, sf_dir, documents, corpus):
    """Each stage's verdict worked out on plain lists; the packed pieces give back what is left."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    score = toxicity.learnt(documents, labels).scores
    left = {d: t for d, t in corpus.items() if score([(t or "").encode()])[0] < 0.5}
    groups = {}
    for d, t in left.items():
        groups.setdefault("".join((t or "").split(" ")).translate(str.maketrans("", "", "\t\n\v\f\r")), []).append(
            (-len(t or ""), d)
        )
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    left = {d: left[d] for d, v in nearcopies.brute_force(left).items() if v[2]}
    left = {d: left[d] for d, v in contamination.brute_force(left, items).items() if not v[4]}
    encoder = Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pipeline.run(spark, sf_dir).collect()
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert {d for d, *_ in pieces} == set(left) and max(pieces.values()) == 1
    for doc, text in left.items():
        ids = np.append(encoder.encode(text or ""), END).astype("<u4")
        mine = sorted(p for p in pieces if p[0] == doc)
        assert sum(n for _, _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)


def test_stages_keep_the_columns(spark, sf_dir, documents):
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns, name


def test_stages_on_odd_rows(spark, sf_dir, repeated):
    docs = repeated.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    for rows in (docs, docs.where("false")):
        now = rows
        for _, stage in pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert now.count() == 0 if rows is not docs else now.count() > 0


def test_stages_free_what_is_no_longer_read(spark, sf_dir, documents):
    """Tables of a stage go once its result is written; what a lazy result still reads stays."""
    from pathlib import Path

    from gristmill.llm.common import STAGED, free_staged, staged

    left = staged(documents, "left")
    free_staged(left)
    assert len(STAGED) == 1 and left.count() == documents.count()
    free_staged(left.limit(1).union(documents))
    assert len(STAGED) == 1
    free_staged(documents)
    assert not STAGED
    docs = documents
    for name, stage in pipeline.STAGES[:4]:
        docs = staged(stage(spark, docs, sf_dir), name)
    assert docs.count() and len(STAGED) < 8
    assert all(Path(path.removeprefix("file:")).exists() for _, path in STAGED)


def test_columns_with_names_of_ours(spark, sf_dir, documents):
    docs = documents.withColumn("kept__id", documents.doc_id).withColumn("score", documents.text)
    for name in ("toxicity", "decontamination", "near_dedup"):
        assert dict(pipeline.STAGES)[name](spark, docs, sf_dir).columns == docs.columns


def test_a_row_is_judged_by_its_own_text(spark, sf_dir, documents, corpus):
    """Rows without an identifier, or all with the same one, fare as the same texts do with their own."""
    kept = {"decontamination": [], "near_dedup": []}
    for identifier in ("doc_id", "CAST(NULL AS LONG) AS doc_id", "7L AS doc_id"):
        rows = documents.selectExpr(identifier, "text")
        for name, found in kept.items():
            stays = dict(pipeline.STAGES)[name](spark, rows, sf_dir).select("text").collect()
            found.append(Counter(r["text"] for r in stays))
    first, *others = kept["decontamination"]
    assert 0 < first.total() < len(corpus) and others == [first, first]
    # Which row of a component stays depends on identifiers, how many stay does not.
    first, *others = (x.total() for x in kept["near_dedup"])
    assert 0 < first < len(corpus) and others == [first, first]


def test_toxic_rows_without_identifiers_go(spark, tmp_path):
    """One clean text without an identifier, or under a repeated one, does not save the toxic ones."""
    said = [(i, f"vile insult number w{i}" if i % 2 else f"kind word number w{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in said], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    said += [(None, "kind word"), (None, "vile insult"), (None, "insult vile"), (300, "word kind"), (300, "vile insult")]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    kept = {tuple(r) for r in pipeline.without_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {(i, t) for i, t in said if "kind" in t}
