"""Records to training text and token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.checks import light_valid
from gristmill.functions.json_text import as_record, parse_record, parse_texts
from gristmill.functions.prompt import LAYOUTS, format_input, format_output
from gristmill.functions.record import VariantRecord
from gristmill.session import ship_package
from gristmill.spec import Spec

# Ids of each of some texts.
Tokenizer = Callable[[Sequence[str]], Sequence[Sequence[int]]]

# Bytes of text that are ids at one time in a Python worker; a longer text is alone.
SLICE_BYTES = 1 << 20


def training_text(
    df: DataFrame, raw: str, *, layout: str = "indented", keep: Sequence[str] = ()
) -> DataFrame:
    """``text``: prompt lines, a line end, and the output; or the ready ``text`` of other records.

    ``raw`` names the column with the records' JSON text. Outputs are laid out ``indented``, byte
    for byte Python's two-space layout with escaped non-ASCII characters, or ``compact``.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    source = F.col(raw)
    record, texts = VariantRecord(F.col("_fields")), F.col("_texts")
    given, wanted, ready = record.value("input"), record.value("output"), record.value("text")
    is_pair = given.present & wanted.present
    text = F.when(ready.present, format_input(ready.raw, texts["text"])).otherwise(F.lit(""))
    parts = df.select(
        *keep, parse_record(source).alias("_fields"), parse_texts(source).alias("_texts")
    ).select(
        *keep,
        F.when(is_pair, format_input(given.raw, texts["input"])).otherwise(text).alias("_prompt"),
        F.when(is_pair, format_output(wanted.raw, texts["output"])).alias("_answer"),
    )
    answer = F.coalesce(LAYOUTS[layout](F.col("_answer")), F.lit(""))
    return parts.select(*keep, F.concat("_prompt", F.lit("\n"), answer).alias("text"))


def output_conforms(fields: Column, spec: Spec) -> Column:
    """The light schema check of ``output``; training keeps the row either way."""
    output = as_record(VariantRecord(fields).value("output").raw)
    return light_valid(VariantRecord(output), spec)


def pair_columns(prompt: dict[str, Column], answer: Column) -> Column:
    """Training text from typed columns: prompt lines, a line end, the answer's JSON text."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in prompt.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"), answer)


def tokenize(
    df: DataFrame,
    text: str | Column,
    tokenizer: Tokenizer | None = None,
    *,
    keep: Sequence[str] = (),
    max_tokens: int | None = None,
) -> DataFrame:
    """``input_ids``, cut only if ``max_tokens`` is set, and ``labels`` equal to them; no padding.

    Without a tokenizer the tokens are the words between white space. A tokenizer is called in
    Python with texts of ``SLICE_BYTES`` together; their ids go back to Spark before the next ones.
    """
    column = F.col(text) if isinstance(text, str) else text
    if tokenizer is None:
        words = F.array_remove(F.split(column, r"[\s\x1c-\x1f\x85\p{Z}]+"), "")
        ids = words if max_tokens is None else F.slice(words, 1, max_tokens)
    else:
        ship_package(df.sparkSession)

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for part in text_slices(batch):
                    ids = iter(tokenizer(part.drop_null().to_pylist()) if part.null_count < len(part) else ())
                    rows = [list(next(ids))[:max_tokens] if known.as_py() else None for known in part.is_valid()]
                    yield pa.array(rows, pa.list_(pa.int64()))

        ids = encode(column)
    return df.select(*keep, ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about ``SLICE_BYTES`` together, one at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(done + SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
