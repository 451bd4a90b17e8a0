"""Reading one file in several tasks: where lines begin, and one JSON array split by byte ranges.

Spark reads a text file in ranges of bytes. What a range means depends on what stands before it: how
many bytes its first line is from the start of the file; whether it begins inside a string, how
deep in brackets, and in the how-manieth element of an array. Each range is summed up first, for
every state it may begin in; a running sum over the ranges of a file tells which one holds. Then
each task reads its own range with what came before it, a few numbers per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.session import ship_package

# Text of a range that is looked at in one piece; an element longer than it is held whole.
PIECE_BYTES = 1 << 20

# Signs that count outside strings.
QUOTE, ESCAPE, COMMA, OPEN, CLOSE = b'"'[0], b"\\"[0], b","[0], b"[{", b"]}"


def before_each(sums: DataFrame, value: str) -> F.Column:
    """Running sum of a value over the ranges of a file, without the range itself."""
    window = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


class RangeTable:
    """A few numbers for each range: the driver's copy of a running sum, sorted by file and range.

    Its size follows the number of ranges, one for some 128 MB of data: 13 MB for each number at 100 TB.
    """

    def __init__(self, rows: DataFrame, names: list[str]):
        found = rows.select(F.xxhash64("path", "block").alias("key"), *names).toPandas()
        found = found.sort_values("key", kind="stable")
        self.keys = found["key"].to_numpy(dtype=np.int64)
        self.values = {n: found[n].to_numpy(dtype=np.int64) for n in names}

    def __getitem__(self, key: int) -> dict[str, int]:
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            raise LookupError("files are read in other ranges than when the scan was built; build it again")
        return {n: int(v[at]) for n, v in self.values.items()}


def ranged_text(spark: SparkSession, path: str, options: dict[str, str], end: str) -> DataFrame:
    """Stretches of text up to a sign, with file and range, and the range's key."""
    read = spark.read.options(**options).option("lineSep", end).text(path)
    block = F.col("_metadata.file_block_start")
    ship_package(spark)
    return read.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"),
        block.alias("block"), F.col("_metadata.file_size").alias("size"),
    )


# --- lines -------------------------------------------------------------------------------


def addressed_lines(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """``raw, path, offset``: lines and the byte at which each begins, however the file is split.

    Lines end with a line feed, a carriage return or both. Ranges after the first of a file are summed up
    by one pass over all bytes before the scan proper.
    """
    lines = ranged_text(spark, path, options, "\n")
    sums = lines.groupBy("path", "block").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    starts = sums.withColumn("start", before_each(sums, "bytes"))
    sent = spark.sparkContext.broadcast(RangeTable(starts.where("block > 0"), ["start"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, offset = None, 0
        for batch in batches:
            values, keys = batch.column(0), batch.column(2).to_numpy()
            blocks = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
            lengths = pc.binary_length(values).to_numpy().astype(np.int64) + 1
            offsets = np.empty(batch.num_rows, dtype=np.int64)
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if first == last:
                    continue
                if keys[first] != at:
                    at = keys[first]
                    offset = sent.value[int(at)]["start"] if blocks[first] else 0
                ends = offset + np.cumsum(lengths[first:last])
                offsets[first:last] = ends - lengths[first:last]
                offset = int(ends[-1])
            texts, paths, places = values, batch.column(1), pa.array(offsets)
            if pc.any(pc.match_substring(values, "\r")).as_py():
                parts, owner, places = split_returns(values.to_pylist(), offsets)
                texts, paths = pa.array(parts, type=pa.binary()), batch.column(1).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [texts.cast(pa.string()), paths, places], names=["raw", "path", "offset"]
            )

    keyed = lines.select("value", "path", F.xxhash64("path", "block").alias("key"), "block")
    return keyed.mapInArrow(run, "raw string, path string, offset long")


def split_returns(values: list[bytes], offsets: np.ndarray) -> tuple[list[bytes], list[int], pa.Array]:
    """Lines that hold carriage returns, split there as well."""
    parts, owner, places = [], [], []
    for i, (value, offset) in enumerate(zip(values, offsets.tolist(), strict=True)):
        pieces = value.split(b"\r")
        if len(pieces) > 1 and not pieces[-1]:
            pieces.pop()
        for piece in pieces:
            parts.append(piece)
            owner.append(i)
            places.append(offset)
            offset += len(piece) + 1
    return parts, owner, pa.array(places, type=pa.int64())


# --- arrays ------------------------------------------------------------------------------


def signs(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which bytes lie outside strings, how each changes the depth, and whether the end is inside.

    A quote counts unless an odd number of backslashes stands before it.
    """
    slash = data == ESCAPE
    # Length of the run of backslashes that ends before each byte.
    place = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, place))
    run = np.concatenate([[0], (place - last_other)[:-1]])
    quote = (data == QUOTE) & (run % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2
    # The closing quote has parity 0 and the opening one 1; neither is a sign outside.
    outside = (within == 0) & ~quote
    step = np.isin(data, np.frombuffer(OPEN, np.uint8)).astype(np.int64)
    step -= np.isin(data, np.frombuffer(CLOSE, np.uint8))
    return outside, np.where(outside, step, 0), int(within[-1]) if len(data) else inside


def bounds(data: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, int, int]:
    """Where the elements of the outermost array are parted, and the state at the end."""
    outside, step, inside = signs(data, inside)
    after = depth + np.cumsum(step)
    comma = outside & (data == COMMA) & (after == 1)
    opened = outside & (data == OPEN[0]) & (after == 1) & (step > 0)
    closed = outside & (data == CLOSE[0]) & (after == 0) & (step < 0)
    return np.flatnonzero(comma | opened | closed), inside, int(after[-1]) if len(data) else depth


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], int, np.ndarray]]:
    """The bytes of each range in turn, as (file, range and file's size; key; piece); an empty piece ends a range.

    The sign at which Spark has split the text is put back.
    """
    at, where, held, size = None, None, [], 0

    def joined() -> np.ndarray:
        return np.frombuffer(b"".join(held), dtype=np.uint8)

    for batch in batches:
        keys, blocks, sizes = (batch.column(c).to_pylist() for c in (0, 3, 4))
        for i, value in enumerate(batch.column(1)):
            if keys[i] != at:
                if at is not None:
                    if held:
                        yield where, at, joined()
                    yield where, at, np.zeros(0, dtype=np.uint8)
                at, where, held, size = keys[i], (batch.column(2)[i].as_py(), blocks[i], sizes[i]), [], 0
            held.append(value.as_py() + b"}")
            size += len(held[-1])
            # A piece ends at a bracket, so no escape is cut.
            if size >= PIECE_BYTES:
                yield where, at, joined()
                held, size = [], 0
    if at is not None:
        if held:
            yield where, at, joined()
        yield where, at, np.zeros(0, dtype=np.uint8)


def summed_ranges(text: DataFrame) -> DataFrame:
    """Per range: parity of quotes and, for a start outside and inside a string, the change of depth and
    how many bounds of elements there are, by the depth at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for (path, block, size), key, data in pieces(batches):
            if state is None:
                state, total = {s: [s, 0, {}] for s in (0, 1)}, 0
            total += len(data)
            if not len(data):
                row = {"path": path, "block": block, "size": size, "bytes": total, "parity": state[0][0]}
                for s in (0, 1):
                    row |= {f"depth{s}": state[s][1], f"bounds{s}": [{"at": d, "n": n} for d, n in state[s][2].items()]}
                yield pa.RecordBatch.from_pylist([row], schema=shape)
                state = None
                continue
            for s in (0, 1):
                inside, depth, counts = state[s]
                outside, step, state[s][0] = signs(data, inside)
                after = depth + np.cumsum(step)
                comma = after[outside & (data == COMMA)]
                opened = after[outside & (data == OPEN[0])]
                closed = after[outside & (data == CLOSE[0])]
                # A comma parts elements if the depth there is 1, and so on, counted from the depth at the start.
                for starts in (1 - comma, 1 - opened, -closed):
                    for d, n in zip(*(x.tolist() for x in np.unique(starts, return_counts=True)), strict=True):
                        counts[d] = counts.get(d, 0) + n
                state[s][1] = int(after[-1])

    counted = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
    shape = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
        ("parity", pa.int32()), ("depth0", pa.int64()), ("bounds0", counted),
        ("depth1", pa.int64()), ("bounds1", counted),
    ])
    ddl = "array<struct<at:bigint,n:bigint>>"
    sums = f"size long, bytes long, parity int, depth0 long, bounds0 {ddl}, depth1 long, bounds1 {ddl}"
    return text.mapInArrow(run, f"path string, block long, {sums}")


def states(ranges: DataFrame) -> DataFrame:
    """Each range's own start: inside a string or not, depth, and bounds of elements before it."""
    inside = ranges.withColumn("inside", before_each(ranges, "parity") % 2)
    chosen = inside.withColumn("change", F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    deep = chosen.withColumn("depth", before_each(chosen, "change"))
    held = F.when(F.col("inside") == 0, F.col("bounds0")).otherwise(F.col("bounds1"))
    at_depth = F.filter(held, lambda b: b["at"] == F.col("depth"))
    n = F.aggregate(at_depth, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    counted = deep.withColumn("n", n)
    return counted.withColumn("before", before_each(counted, "n"))


def array_elements(spark: SparkSession, path: str, options: dict[str, str], larger_than: int) -> DataFrame:
    """``path, pos, raw, sound`` of the elements of files of one JSON array each, read in ranges.

    Only files of more than so many bytes are read. Texts before the first and after the last bracket, and
    what lies between commas, are parts of their own; those that may not be there, and all parts of
    a file whose brackets or quotes do not close, are not ``sound``. An element that spans ranges comes as one
    fragment from each, put together by its number in the array.
    """
    text = ranged_text(spark, path, options, "}").where(F.col("size") > larger_than)
    keyed = text.select(F.xxhash64("path", "block").alias("key"), "value", "path", "block", "size")
    table = states(summed_ranges(keyed)).persist()
    sent = spark.sparkContext.broadcast(RangeTable(table, ["inside", "depth", "before"]))
    # The bracket put back after the last part of a file has closed one too many, unless the file has it.
    closed = (F.sum("parity") % 2 == 0) & (F.sum("bytes") != F.max("size"))
    ends = table.groupBy("path").agg(
        closed.alias("closed"), F.sum("change").alias("left"), F.sum("n").alias("last")
    )
    ends = spark.createDataFrame(ends.collect(), "path string, closed boolean, left long, last long")
    table.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [dict(zip(shape.names, r, strict=True)) for r in found], schema=shape
            )

        for where, key, data in pieces(batches):
            if key != at:
                at, start = key, sent.value[key]
                state, number, held, first = (start["inside"], start["depth"]), start["before"], [], True
            if not len(data):
                yield rows([(*where[:2], number, False, b"".join(held))])
                at = None
                continue
            places, *state = bounds(data, *state)
            raw, begin, found = data.tobytes(), 0, []
            for place in places.tolist():
                held.append(raw[begin:place])
                found.append((*where[:2], number, not first, b"".join(held)))
                number, begin, held, first = number + 1, place + 1, [], False
            held.append(raw[begin:])
            if found:
                yield rows(found)

    shape = pa.schema([
        ("path", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary()),
    ])
    parts = keyed.mapInArrow(run, "path string, block long, part long, whole boolean, text binary")
    fragments = F.sort_array(F.collect_list(F.struct("block", "text")))
    together = (
        parts.where("not whole").groupBy("path", "part").agg(fragments.alias("f"))
        .select("path", "part", F.array_join(F.transform("f", lambda x: x["text"].cast("string")), "").alias("raw"))
    )
    everything = parts.where("whole").select("path", "part", F.col("text").cast("string").alias("raw")).unionByName(together)
    raw = F.regexp_replace("raw", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    known = everything.withColumn("raw", raw).join(ends, "path")
    edge = (F.col("part") == 0) | (F.col("part") == F.col("last"))
    empty = (F.col("last") == 2) & (F.col("part") == 1) & (F.col("raw") == "")
    well = F.col("closed") & (F.col("left") == -1) & (F.col("last") >= 2)
    right_edge = F.when(F.col("part") == 0, F.col("raw") == "").otherwise(F.regexp_replace("raw", r"[ \t\r\n]*\}$", "") == "")
    return known.where(~(well & (empty | (edge & right_edge)))).select(
        "path", (F.col("part") - 1).alias("pos"), "raw", (well & ~edge).alias("sound")
    )
