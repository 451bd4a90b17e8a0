"""Scans of JSON, JSONL, YAML and text files, and the file inventory.

Record scans share one shape: ``raw`` (the record's JSON text), ``fields`` (the parsed record),
``path`` and ``offset``: the number of an element in its array or list, the byte at which a line
begins. ``path, offset`` is a record's address, the same in every pass and for every way a file may
be split; ``SCAN_ORDER`` sorts a whole corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.json_text import RECORD_TYPE, parse_records
from gristmill.functions.text import strip
from gristmill.operators.records import with_record
from gristmill.session import ship_package
from gristmill.sources.ranges import addressed_lines, array_elements

SCAN_ORDER = ["src_rank", "path", "offset"]

# Characters of YAML records that go back to Spark together.
PART_CHARS = 1 << 20

# The corpus formats in scan order, and the extensions of text files.
CORPUS_PATTERNS = {
    "json": "*.json",
    "jsonl": "*.jsonl",
    "yaml": "*.yaml",
    "yml": "*.yml",
}
TEXT_EXTENSIONS = (
    ".txt", ".md", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".xml", ".html", ".css",
)


def _options(pattern: str | None, recursive: bool) -> dict[str, str]:
    options = {"recursiveFileLookup": str(recursive).lower()}
    if pattern:
        options["pathGlobFilter"] = pattern
    return options


def _check(df: DataFrame, on_bad: str, what: str) -> DataFrame:
    """Fail the job on an unreadable record, or keep it with null ``fields``."""
    if on_bad == "quarantine":
        return df
    if on_bad != "fail":
        raise ValueError("on_bad must be 'fail' or 'quarantine'")
    message = F.concat(F.lit(f"unreadable {what} in "), F.col("path"))
    return df.where(F.when(F.col("fields").isNull(), F.raise_error(message)).otherwise(F.lit(True)))


def split_unreadable(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, quarantined ones) of a scan made with ``on_bad='quarantine'``."""
    return scan.where(F.col("fields").isNotNull()), scan.where(F.col("fields").isNull())


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task reads."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_json_array(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = "*.json",
    recursive: bool = False,
    on_bad: str = "fail",
    whole_bytes: int | None = None,
) -> DataFrame:
    """Files that each hold one JSON array of objects.

    A file of up to ``whole_bytes`` (by default what one task reads) is parsed whole; a larger one is read
    in ranges by several tasks, with the same result. An unreadable file counts as one bad record:
    its text, or the first part of it that cannot be, if it is read in ranges.
    """
    options = _options(pattern, recursive)
    limit = split_bytes(spark) if whole_bytes is None else whole_bytes
    size = F.col("_metadata.file_size")
    files = spark.read.options(**options).text(path, wholetext=True).where(size <= limit)
    items = files.select(
        F.col("_metadata.file_path").alias("path"), "value", parse_records(F.col("value")).alias("items")
    )
    unreadable = F.array(
        F.struct(F.col("value").alias("raw"), F.lit(None).cast(RECORD_TYPE).alias("fields"))
    )
    rows = items.select(
        "path", F.posexplode(F.coalesce(F.col("items"), unreadable)).alias("offset", "item")
    )
    scan = _check(rows.select("item.raw", "item.fields", "path", F.col("offset").cast("long").alias("offset")),
                  on_bad, "JSON array")
    listed = spark.read.format("binaryFile").options(**options).load(path)
    if listed.where(F.col("length") > limit).select("path").isEmpty():
        return scan
    return scan.unionByName(_ranged_array(spark, path, options, limit, on_bad))


def _ranged_array(spark: SparkSession, path: str, options: dict, limit: int, on_bad: str) -> DataFrame:
    """The records of JSON arrays larger than ``limit``."""
    elements = with_record(array_elements(spark, path, options, limit))
    fields = F.when(F.col("sound"), F.col("fields"))
    rows = elements.select("raw", fields.alias("fields"), "path", F.col("pos").alias("offset"))
    if on_bad != "quarantine":
        return _check(rows, on_bad, "JSON array")
    first = F.min_by(F.struct("raw", "fields", "offset"), "offset").alias("first")
    bad = rows.where(F.col("fields").isNull()).groupBy("path").agg(first)
    return rows.join(bad.select("path"), "path", "left_anti").unionByName(
        bad.select("first.raw", "first.fields", "path", "first.offset")
    )


def read_jsonl(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = "*.jsonl",
    recursive: bool = False,
    on_bad: str = "fail",
    addressed: bool = False,
) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    With ``addressed``, records have their ``offset``, for which one more pass goes over the lines' lengths.
    """
    options = _options(pattern, recursive)
    if addressed:
        lines = addressed_lines(spark, path, options)
    else:
        lines = spark.read.options(**options).text(path).select(
            F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path")
        )
    return _check(with_record(lines.where(strip(F.col("raw")) != "")), on_bad, "JSON line")


def read_yaml_list(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = "*.yaml",
    recursive: bool = False,
    on_bad: str = "fail",
) -> DataFrame:
    """Files that each hold one YAML list of mappings; a file is parsed by one Python task, item by item."""
    ship_package(spark)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                texts = yaml_texts(content.as_buffer())
                for start, part in text_parts(texts):
                    columns = [pa.array([name.as_py()] * len(part)), pa.array(range(start, start + len(part))), pa.array(part)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "pos", "raw"])

    files = spark.read.format("binaryFile").options(**_options(pattern, recursive)).load(path)
    rows = files.select("path", "content").mapInArrow(
        records, "path string, pos long, raw string"
    )
    found = rows.select("raw", "path", F.col("pos").alias("offset"))
    return _check(with_record(found), on_bad, "YAML record")


def yaml_texts(content: pa.Buffer) -> list[str]:
    """The JSON texts of a YAML file's items; one that is no JSON object, if the file cannot be read."""
    import yaml

    try:
        return [json.dumps(item, ensure_ascii=False, default=str) for item in _yaml_items(content)]
    except (yaml.YAMLError, UnicodeDecodeError):
        return ["!unreadable " + content.to_pybytes().decode(errors="replace")]


def _yaml_items(content: pa.Buffer) -> Iterator[object]:
    """What ``yaml.load`` finds in a file, but only one item of its list is there at a time."""
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    # Composes nodes from single events, which the C parser alone does for whole documents.
    class ItemLoader(*([] if base is yaml.SafeLoader else [yaml.composer.Composer]), base):
        def __init__(self, stream):
            base.__init__(self, stream)
            yaml.composer.Composer.__init__(self)

    loader = ItemLoader(pa.BufferReader(content))
    try:
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            yield None
            return
        loader.get_event()
        first = loader.peek_event()
        if isinstance(first, yaml.SequenceStartEvent) and first.implicit and first.anchor is None:
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield loader.construct_document(loader.compose_node(None, None))
            loader.get_event()
        else:
            value = loader.construct_document(loader.compose_node(None, None))
            yield from value if isinstance(value, list) else [value]
        loader.get_event()
        if not loader.check_event(yaml.StreamEndEvent):
            raise yaml.composer.ComposerError(problem="expected a single document in the stream")
    finally:
        loader.dispose()


def text_parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``PART_CHARS`` characters, and the number of the first."""
    start, size = 0, 0
    for place, text in enumerate(texts):
        size += len(text)
        if size >= PART_CHARS or place == len(texts) - 1:
            yield start, texts[start : place + 1]
            start, size = place + 1, 0


READERS = {
    "json": read_json_array,
    "jsonl": read_jsonl,
    "yaml": read_yaml_list,
    "yml": read_yaml_list,
}


def scan_corpus(
    spark: SparkSession,
    raw_dir: str,
    *,
    patterns: Mapping[str, str] | None = None,
    recursive: bool = False,
    on_bad: str = "fail",
) -> DataFrame:
    """All records of a folder: JSON files first, then JSONL, YAML and YML.

    ``patterns`` may name other file names per format, also below a subfolder. A missing folder,
    a folder without data files and files that Spark would skip for their names are errors.
    """
    patterns = patterns or CORPUS_PATTERNS
    scans = []
    for rank, (kind, reader) in enumerate(READERS.items()):
        if kind not in patterns:
            continue
        folder, pattern = locate(raw_dir, patterns[kind])
        if _any_file(spark, folder, pattern, recursive):
            more = {"addressed": True} if reader is read_jsonl else {}
            scan = reader(spark, folder, pattern=pattern, recursive=recursive, on_bad=on_bad, **more)
            scans.append(scan.withColumn("src_rank", F.lit(rank)))
    if not scans:
        raise ValueError(f"no data files found in {raw_dir}")
    corpus = scans[0]
    for scan in scans[1:]:
        corpus = corpus.unionByName(scan)
    return corpus


def locate(raw_dir: str, pattern: str) -> tuple[str, str]:
    """Folder and file-name pattern of a pattern that may start with subfolders."""
    below, _, name = pattern.rpartition("/")
    return (f"{raw_dir}/{below}" if below else raw_dir), name


def list_files(
    spark: SparkSession, path: str, pattern: str | None = None, *, recursive: bool = False
) -> list[tuple[str, int]] | None:
    """(path, size) of all files below a folder, hidden and empty ones too; None without a folder.

    Listed by the file system on the driver, as Spark lists the files it reads.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    wanted = jvm.org.apache.hadoop.fs.GlobFilter(pattern) if pattern else None
    found, waiting = [], [folder]
    while waiting:
        for status in system.listStatus(waiting.pop()):
            if status.isDirectory():
                if recursive:
                    waiting.append(status.getPath())
            elif wanted is None or wanted.accept(status.getPath()):
                found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def is_hidden(name: str) -> bool:
    """Whether Spark's readers skip a file of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _any_file(spark: SparkSession, path: str, pattern: str, recursive: bool) -> bool:
    files = list_files(spark, path, pattern, recursive=recursive)
    if files is None:
        raise FileNotFoundError(f"raw data folder not found: {path}")
    skipped = [name for name, size in files if size and is_hidden(name.rpartition("/")[2])]
    if skipped:
        raise ValueError(f"files whose names Spark's readers skip: {', '.join(skipped)}")
    return any(size for _, size in files)


def find_files(
    spark: SparkSession, path: str, pattern: str = "*", *, recursive: bool = False
) -> DataFrame:
    """Files below a folder that match a pattern, hidden and empty ones too; none without a folder."""
    files = list_files(spark, path, pattern, recursive=recursive)
    return spark.createDataFrame(files or [], "path string, size long")


def read_lines(
    spark: SparkSession, path: str, *, pattern: str | None = None, recursive: bool = False
) -> DataFrame:
    """Stripped, non-blank lines of text files."""
    lines = spark.read.options(**_options(pattern, recursive)).text(path)
    return lines.select(strip(F.col("value")).alias("line")).where(F.col("line") != "")


def digest(content: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content, int(algorithm.removeprefix("sha")))
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def file_inventory(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = None,
    recursive: bool = True,
    algorithm: str = "md5",
    binary_probe: int | None = None,
) -> DataFrame:
    """One row per file: size, hash, line count, extension, binary and text tests.

    A file is binary if it holds a NUL anywhere, or in its first ``binary_probe`` bytes if that is
    set. Empty files are listed; files that Spark hides (names starting with ``_`` or ``.``) are
    listed with their size, without what only their content tells.
    """
    read = spark.read.format("binaryFile").options(**_options(pattern, recursive)).load(path)
    empty = F.when(F.col("size") == 0, F.lit(b""))
    # Spark's listing leaves these out.
    left_out = [
        f for f in list_files(spark, path, pattern, recursive=recursive) or []
        if not f[1] or is_hidden(f[0].rpartition("/")[2])
    ]
    unread = spark.createDataFrame(left_out, "path string, size long").select(
        "path", F.col("size").alias("length"), empty.alias("content")
    )
    files = read.select("path", "length", "content").unionByName(unread)
    root = path.split("://", 1)[-1].rstrip("/") + "/"
    name = F.substring_index(F.col("path"), "/", -1)
    chars = F.decode(F.col("content"), "ISO-8859-1")
    start = chars if binary_probe is None else F.substring(chars, 1, binary_probe)
    line_ends = F.regexp_count(chars, F.lit("\r\n|\r|\n"))
    open_line = (F.length(chars) > 0) & ~F.rlike(chars, F.lit("[\r\n]\\z"))
    listed = files.select(
        "path",
        F.substring_index(F.col("path"), root, -1).alias("relative_path"),
        F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).alias("extension"),
        F.col("length").alias("size"),
        digest(F.col("content"), algorithm).alias("hash"),
        (line_ends + open_line.cast("int")).cast("long").alias("line_count"),
        F.contains(start, F.lit("\x00")).alias("is_binary"),
    )
    return listed.withColumn(
        "is_text", F.col("extension").isin(*TEXT_EXTENSIONS) & ~F.col("is_binary")
    )
