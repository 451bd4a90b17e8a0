"""Sources and sinks, over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.catalog.curation import split_sql
from gristmill.catalog.registry import NORMAL_TEXT, query, table
from gristmill.functions.record import VariantRecord
from gristmill.functions.text import normalize_text
from gristmill.operators.curation import drop_copies_in_scan, record_hash
from gristmill.operators.split import split_rows
from gristmill.plans.curation import curate_corpus
from gristmill.session import scratch_path
from gristmill.sources.files import (
    SCAN_ORDER,
    file_inventory,
    find_files,
    read_json_array,
    read_jsonl,
    read_lines,
    read_yaml_list,
    scan_corpus,
)
from gristmill.sources.sinks import append_lines, curation_summary, write_jsonl, write_lines

# A whole-file format holds at most this many records per file; the key is unique.
RECORDS_PER_FILE = 1000


def write_array_files(df: DataFrame, key: str, path: str, columns: list[str]) -> None:
    """JSON arrays, one file each, of up to RECORDS_PER_FILE records."""
    numbered = df.select(
        F.floor(F.col(key) / RECORDS_PER_FILE).alias("file"),
        F.struct(F.col(key), F.to_json(F.struct(*columns)).alias("raw")).alias("item"),
    )
    items = F.transform(F.sort_array(F.collect_list("item")), lambda x: x["raw"])
    arrays = numbered.groupBy("file").agg(items.alias("items"))
    text = F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]"))
    arrays.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_yaml_files(df: DataFrame, path: str, columns: list[str]) -> None:
    """YAML lists of up to RECORDS_PER_FILE records; an item is its JSON form."""
    line = F.concat(F.lit("- "), F.to_json(F.struct(*columns)))
    df.select(line.alias("value")).write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write_jsonl_files(df: DataFrame, path: str, columns: list[str]) -> None:
    """JSON lines with a blank line after each."""
    line = F.concat(F.to_json(F.struct(*columns)), F.lit("\n  "))
    df.select(line.alias("value")).write.text(path)


def number(name: str):
    return VariantRecord(F.col("fields")).value(name).number


def text(name: str):
    return VariantRecord(F.col("fields")).value(name).text


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, md5(text) AS text_md5, lang, doc_id % 1000 AS pos FROM documents")
def s1_json_array_scan(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    write_array_files(documents(spark, sf_dir), "doc_id", path, ["doc_id", "text", "lang"])
    scan = read_json_array(spark, path, pattern="*.txt")
    return scan.select(
        number("doc_id").cast("long").alias("doc_id"), F.md5(text("text")).alias("text_md5"),
        text("lang").alias("lang"), F.col("offset").alias("pos"),
    )


@query("SELECT doc_id, md5(text) AS text_md5, lang, doc_id % 1000 AS pos FROM documents")
def s1_array_in_ranges(spark, sf_dir):
    """The same arrays, each read in ranges of bytes that several tasks share."""
    path = scratch_path(spark, "arrays")
    write_array_files(documents(spark, sf_dir), "doc_id", path, ["doc_id", "text", "lang"])
    scan = read_json_array(spark, path, pattern="*.txt", whole_bytes=0)
    return scan.select(
        number("doc_id").cast("long").alias("doc_id"), F.md5(text("text")).alias("text_md5"),
        text("lang").alias("lang"), F.col("offset").alias("pos"),
    )


@query("SELECT event_id, event_type, value, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events")
def s2_jsonl_scan(spark, sf_dir):
    path = scratch_path(spark, "lines")
    write_jsonl_files(
        table(spark, sf_dir, "events"), path, ["event_id", "event_type", "value", "props"]
    )
    scan = read_jsonl(spark, path, pattern="*.txt")
    return scan.select(
        number("event_id").cast("long").alias("event_id"), text("event_type").alias("event_type"),
        number("value").alias("value"), F.regexp_extract(text("props"), "[0-9]+", 0).cast("long").alias("k"),
    )


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def s3_yaml_scan(spark, sf_dir):
    path = scratch_path(spark, "yaml")
    write_yaml_files(table(spark, sf_dir, "conversations"), path, ["conv_id", "turn", "role", "text"])
    scan = read_yaml_list(spark, path, pattern="*.txt")
    return scan.select(
        number("conv_id").cast("long").alias("conv_id"), number("turn").cast("long").alias("turn"),
        text("role").alias("role"), F.md5(text("text")).alias("text_md5"),
    )


def write_corpus(spark, sf_dir, columns) -> tuple[str, dict[str, str]]:
    """The documents in four formats, by key; and where each format lies."""
    path = scratch_path(spark, "corpus")
    df = documents(spark, sf_dir).withColumn("id", F.col("doc_id"))
    part = [df.where(F.col("doc_id") % 4 == rank) for rank in range(4)]
    write_array_files(part[0], "doc_id", f"{path}/json", columns)
    write_jsonl_files(part[1], f"{path}/jsonl", columns)
    write_yaml_files(part[2], f"{path}/yaml", columns)
    write_yaml_files(part[3], f"{path}/yml", columns)
    return path, {kind: f"{kind}/*.txt" for kind in ("json", "jsonl", "yaml", "yml")}


@query("SELECT doc_id, doc_id % 4 AS src_rank, md5(text) AS text_md5 FROM documents")
def s4_corpus_scan(spark, sf_dir):
    path, patterns = write_corpus(spark, sf_dir, ["doc_id", "text"])
    scan = scan_corpus(spark, path, patterns=patterns)
    return scan.select(
        number("doc_id").cast("long").alias("doc_id"), F.col("src_rank").cast("long").alias("src_rank"),
        F.md5(text("text")).alias("text_md5"),
    )


@query("SELECT DISTINCT 'lang=' || lang AS folder FROM documents")
def s5_find_files(spark, sf_dir):
    path = scratch_path(spark, "found")
    documents(spark, sf_dir).select("source", "lang").write.partitionBy("lang").text(path)
    files = find_files(spark, path, "*.txt", recursive=True)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


LINES = f"(SELECT unnest(string_split(text, chr(10))) AS text FROM documents)"


@query(f"""SELECT md5(line) AS line_md5, count(*) AS n FROM (
               SELECT trim(text, ' ' || chr(9) || chr(11) || chr(12) || chr(160)) AS line FROM {LINES})
           WHERE line <> '' GROUP BY line""")
def s6_read_lines(spark, sf_dir):
    path = scratch_path(spark, "text")
    documents(spark, sf_dir).select("text").write.text(path)
    lines = read_lines(spark, path)
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@query(
    """SELECT '.txt' AS extension, strlen(content) AS size, sha256(content) AS hash, n AS line_count,
              false AS is_binary, true AS is_text
       FROM (SELECT string_agg(c_name || '|' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10)
                    AS content, count(*) AS n FROM customer GROUP BY c_custkey // 100)"""
)
def s7_file_inventory(spark, sf_dir):
    path = scratch_path(spark, "inventory")
    line = F.concat("c_name", F.lit("|"), "c_mktsegment")
    files = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("items")
    )
    content = F.array_join(F.transform("items", lambda x: x["line"]), "\n")
    files.select(content.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    listed = file_inventory(spark, path, pattern="*.txt", algorithm="sha256")
    return listed.select("extension", "size", "hash", "line_count", "is_binary", "is_text")


@query(f"SELECT split, doc_id FROM ({split_sql('SELECT doc_id FROM documents')})")
def s8_jsonl_sink(spark, sf_dir):
    """Records written per split and read back from their folders."""
    path = scratch_path(spark, "splits")
    raw = F.to_json(F.struct("doc_id", "text", "lang"))
    write_jsonl(split_rows(documents(spark, sf_dir).withColumn("raw", raw), "doc_id"), path)
    scan = read_jsonl(spark, path, pattern="*.txt", recursive=True)
    return scan.select(
        F.regexp_extract("path", "split=([a-z]+)", 1).alias("split"),
        number("doc_id").cast("long").alias("doc_id"),
    )


@query(
    """SELECT count(*) AS total_samples, floor(count(*) * 0.8::DOUBLE)::BIGINT AS train_samples,
              floor(count(*) * 0.1::DOUBLE)::BIGINT AS val_samples,
              (count(*) - floor(count(*) * 0.8::DOUBLE) - floor(count(*) * 0.1::DOUBLE))::BIGINT
                  AS test_samples,
              'a,b' AS include_tags, 'pii' AS exclude_tags
       FROM documents"""
)
def s9_summary(spark, sf_dir):
    rows = split_rows(documents(spark, sf_dir).select("doc_id"), "doc_id")
    summary = curation_summary(rows, ["a", "b"], ["pii"])
    return summary.withColumns(
        {name: F.array_join(name, ",") for name in ("include_tags", "exclude_tags")}
    )


@query("SELECT source AS line, 2 * count(*) AS n FROM documents GROUP BY source")
def s10_write_and_append_lines(spark, sf_dir):
    path = scratch_path(spark, "written")
    lines = documents(spark, sf_dir).select(F.col("source").alias("value"))
    write_lines(lines, path)
    append_lines(lines, path)
    return read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT md5({NORMAL_TEXT}) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def d3_scan_dedup(spark, sf_dir):
    """First record of each group of copies in scan order; one file per 1000 keys, in key order."""
    path = scratch_path(spark, "arrays")
    df = documents(spark, sf_dir).withColumn("id", F.col("doc_id"))
    write_array_files(df, "doc_id", path, ["id", "text"])
    scan = read_json_array(spark, path, pattern="*.txt")
    # The writer names files at random, so the file order is restored from the first key.
    ordered = scan.withColumn("src_rank", F.floor(number("id") / RECORDS_PER_FILE))
    unique = drop_copies_in_scan(ordered, record_hash(F.col("fields")), SCAN_ORDER)
    return unique.select(
        F.md5(normalize_text(text("text"))).alias("text_hash"), number("id").cast("long").alias("doc_id")
    )


@query(f"SELECT md5({NORMAL_TEXT}) AS text_hash, 1::BIGINT AS n FROM documents GROUP BY 1")
def d3_addressed_lines(spark, sf_dir):
    """First copies among JSON lines, found by hash and byte address in one pass and read in another."""
    path = scratch_path(spark, "lines")
    df = documents(spark, sf_dir).withColumn("id", F.col("doc_id"))
    write_jsonl_files(df, path, ["id", "text"])
    scan = read_jsonl(spark, path, pattern="*.txt", addressed=True).withColumn("src_rank", F.lit(0))
    unique = drop_copies_in_scan(scan, record_hash(F.col("fields")), SCAN_ORDER)
    digest = F.md5(normalize_text(text("text"))).alias("text_hash")
    return unique.groupBy(digest).agg(F.count("*").alias("n"))


KEPT_TEXTS = f"""SELECT DISTINCT md5('{{}}[]' || chr(10) || {NORMAL_TEXT}) AS doc_id,
                        md5({NORMAL_TEXT}) AS text_hash
                 FROM documents WHERE NOT contains(lower(text), 'public')"""


def curated(spark, sf_dir) -> tuple[str, DataFrame]:
    """Curation from end to end over files in four formats: where to, and the summary."""
    path, patterns = write_corpus(spark, sf_dir, ["id", "text"])
    out = scratch_path(spark, "clean")
    return out, curate_corpus(spark, path, out, exclude="public,pii", patterns=patterns)


@query(f"SELECT split, text_hash FROM ({split_sql(KEPT_TEXTS)})")
def curate_corpus_files(spark, sf_dir):
    """What the job wrote, read back from the files of each split."""
    out, _ = curated(spark, sf_dir)
    written = read_jsonl(spark, f"{out}/data", pattern="*.txt", recursive=True)
    return written.select(
        F.regexp_extract("path", "split=([a-z]+)", 1).alias("split"),
        F.md5(normalize_text(text("text"))).alias("text_hash"),
    )


@query(
    f"""SELECT n AS total_samples, floor(n * 0.8::DOUBLE)::BIGINT AS train_samples,
               floor(n * 0.1::DOUBLE)::BIGINT AS val_samples,
               (n - floor(n * 0.8::DOUBLE) - floor(n * 0.1::DOUBLE))::BIGINT AS test_samples
        FROM (SELECT count(DISTINCT {NORMAL_TEXT}) AS n FROM documents
              WHERE NOT contains(lower(text), 'public'))"""
)
def curate_corpus_summary(spark, sf_dir):
    _, summary = curated(spark, sf_dir)
    return summary.select("total_samples", "train_samples", "val_samples", "test_samples")
