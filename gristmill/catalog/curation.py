"""Tags, duplicates, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.catalog.registry import NORMAL_TEXT, query, table
from gristmill.functions.json_text import parse_record
from gristmill.functions.record import TypedRecord, VariantRecord
from gristmill.functions.text import normalize_text
from gristmill.operators.curation import (
    drop_copies,
    filter_tags,
    first_keys,
    has_any_tag,
    record_hash,
    row_hash,
    tags_of,
)
from gristmill.operators.records import with_record
from gristmill.operators.split import split_counts, split_rows
from gristmill.plans.curation import curate_table

SURVIVORS = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({NORMAL_TEXT})"


def split_sql(rows: str) -> str:
    """Rank all rows by seeded hash and cut at the two whole-number positions."""
    return f"""
        SELECT *, CASE WHEN rank < t THEN 'train' WHEN rank < t + v THEN 'val' ELSE 'test' END
                  AS split
        FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS rank,
                     floor(count(*) OVER () * 0.8::DOUBLE) AS t,
                     floor(count(*) OVER () * 0.1::DOUBLE) AS v
              FROM ({rows}))
    """


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TypedRecord]:
    df = table(spark, sf_dir, "documents")
    return df, TypedRecord(df, ["text"])


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON records with a comma string and a nested list of tags."""
    df = table(spark, sf_dir, "documents")
    record = F.struct(
        F.concat_ws(",", "lang", "source").alias("tags"),
        F.struct(F.array("source", F.concat(F.lit("x-"), "lang")).alias("tags")).alias("metadata"),
        "text",
    )
    return with_record(df, F.to_json(record), keep=["doc_id"])


@query(
    """SELECT doc_id, concat_ws(',',
           CASE WHEN contains(lower(text), 'internal') THEN 'internal' END,
           CASE WHEN contains(lower(text), 'pii') THEN 'pii' END,
           CASE WHEN contains(lower(text), 'private') THEN 'private' END,
           CASE WHEN contains(lower(text), 'public') THEN 'public' END,
           CASE WHEN contains(lower(text), 'sensitive') THEN 'sensitive' END) AS tags
       FROM documents"""
)
def t1_extract_tags(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return df.select("doc_id", F.array_join(F.sort_array(tags_of(record)), ",").alias("tags"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
               [lang, source, 'x-' || lang],
               CASE WHEN contains(lower(text), 'public') THEN ['public'] ELSE [] END))), ',')
           AS tags
       FROM documents"""
)
def t1_declared_tags(spark, sf_dir):
    df = tagged_documents(spark, sf_dir)
    tags = tags_of(VariantRecord(F.col("fields")))
    return df.select("doc_id", F.array_join(F.sort_array(tags), ",").alias("tags"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'public')")
def t2_include(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return df.where(has_any_tag(record, ["public", "pii"])).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE NOT contains(lower(text), 'public')")
def t3_exclude(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return df.where(~has_any_tag(record, ["public", "private"])).select("doc_id", "lang")


@query(
    """SELECT doc_id FROM documents
       WHERE (lang IN ('fr', 'de') OR source = 'src3' OR contains(lower(text), 'public'))
         AND source NOT IN ('src7', 'src8')"""
)
def t4_filter_tags(spark, sf_dir):
    df = tagged_documents(spark, sf_dir)
    record = VariantRecord(F.col("fields"))
    kept = filter_tags(df, record, ["x-fr", "de", "src3", "public"], ["src7", "src8"])
    return kept.select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'public') AND lang <> 'en'")
def t5_tag_arguments(spark, sf_dir):
    df = tagged_documents(spark, sf_dir)
    return filter_tags(df, VariantRecord(F.col("fields")), "", "public,en").select("doc_id")


@query("SELECT count(*) AS n, count(*) FILTER (contains(lower(text), 'public')) AS public "
       "FROM documents")
def tag_filter(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return df.agg(F.count("*").alias("n"), F.count_if(has_any_tag(record, ["public"])).alias("public"))


@query(f"SELECT doc_id, md5({NORMAL_TEXT}) AS text_hash, length({NORMAL_TEXT}) AS text_length "
       "FROM documents")
def d1_normalized_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    text = normalize_text(F.col("text"))
    return df.select(
        "doc_id", F.md5(text).alias("text_hash"), F.length(text).cast("long").alias("text_length")
    )


@query(
    f"""SELECT copies, count(*) AS groups FROM (
            SELECT count(*) AS copies FROM documents GROUP BY {NORMAL_TEXT}, lang)
        GROUP BY copies"""
)
def d2_record_hash(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    raw = F.to_json(F.struct(F.col("doc_id").alias("id"), "text", "lang", "source"))
    hashes = df.select(record_hash(parse_record(raw)).alias("hash"))
    copies = hashes.groupBy("hash").agg(F.count("*").alias("copies"))
    return copies.groupBy("copies").agg(F.count("*").alias("groups"))


@query(f"SELECT doc_id, md5({NORMAL_TEXT}) AS hash FROM documents")
def d2_row_hash(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return df.select("doc_id", row_hash(record).alias("hash"))


@query(SURVIVORS)
def d3_first_keys(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    return first_keys(df, row_hash(record), "doc_id")


@query(f"SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents "
       f"WHERE doc_id IN ({SURVIVORS})")
def exact_dedup(spark, sf_dir):
    df, record = documents(spark, sf_dir)
    unique = drop_copies(df, row_hash(record), "doc_id")
    return unique.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    """SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer
       GROUP BY c_nationkey, c_mktsegment"""
)
def d3_typed_columns(spark, sf_dir):
    """Copies by two columns: each of the few groups holds a large share of the table."""
    df = table(spark, sf_dir, "customer")
    record = TypedRecord(df, ["c_nationkey", "c_mktsegment"])
    unique = drop_copies(df, row_hash(record), "c_custkey")
    return unique.select("c_nationkey", "c_mktsegment", "c_custkey")


@query(f"SELECT doc_id, split FROM ({split_sql('SELECT doc_id FROM documents')})")
def p1_split(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id")
    return split_rows(df, "doc_id")


@query(
    """SELECT split, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (
           SELECT o_orderkey, CASE WHEN rank < floor(n * 0.5::DOUBLE) THEN 'train'
                  WHEN rank < floor(n * 0.5::DOUBLE) + floor(n * 0.25::DOUBLE) THEN 'val'
                  ELSE 'test' END AS split
           FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) - 1 AS rank,
                        count(*) OVER () AS n FROM orders))
       GROUP BY split"""
)
def p1_split_ratios(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = split_rows(df, "o_orderkey", train_ratio=0.5, val_ratio=0.25, seed=7)
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


@query(f"SELECT split, count(*) AS n FROM ({split_sql(SURVIVORS)}) GROUP BY split")
def split_counts_report(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return split_counts(curate_table(df, "doc_id"))


@query(
    f"""SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, split FROM documents JOIN
        (SELECT doc_id, split FROM ({split_sql(f'''
            SELECT min(doc_id) AS doc_id FROM documents WHERE NOT contains(lower(text), 'public')
            GROUP BY md5({NORMAL_TEXT})''')})) USING (doc_id)"""
)
def curate_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    rows = curate_table(df, "doc_id", exclude="pii,public")
    return rows.select(
        "doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "split"
    )
