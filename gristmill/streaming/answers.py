"""Choosing among a model's answers while they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from gristmill.session import ship_package
from gristmill.streaming.streams import STATE_STORE

# The prompts of a bucket, as JSON: of each the bounds of the runs of attempts seen, the texts that may still be the
# answer, the latest time, whether it is answered, and when its time is up.
STATE = "prompts string"
UNSEEN = ([], None, None, None, -1, False, -1)

# A call for a group costs milliseconds, whatever it holds, so that prompts share this many groups.
BUCKETS = 4_096

# Prompts of any type travel as JSON that gives back the same value.
EXACT = {f"{kind}Format": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + zone for kind, zone in (("timestamp", "XXX"), ("timestampNTZ", ""))}

# Stand for "no valid attempt in this run" and "no time"; not null, so that pandas keeps whole numbers.
NO_ATTEMPT = -(2**63)
NO_TIME = -1


def answers_in_stream(
    stream: DataFrame,
    valid: Column,
    event_time: str,
    delay: str,
    *,
    prompt: str = "prompt_id",
    attempt: str = "attempt",
    text: str = "text",
    first_attempt: int = 1,
    max_attempts: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``best_of`` on attempts that arrive in any order: one answer per prompt, as soon as it is certain.

    The answer is the first valid attempt, once all attempts from ``first_attempt`` up to it have arrived. It
    is the last one, if all up to ``max_attempts`` have arrived and none is valid. A prompt that stays
    undecided is answered from what it has when the watermark passes its latest attempt: its time is up
    then, and ``timed_out`` says so. The attempts of a prompt must be less than ``delay`` apart; one that comes
    behind the watermark is left out, and one after the prompt was closed begins it anew.

    Rows without an attempt number, and those beyond ``max_attempts``, are no attempts but move the time. A
    prompt may be null. Rows without a time are never late. Of rows that repeat a number the valid
    ones count, then the least text. An answered prompt keeps a mark without texts until its time is up,
    then nothing.

    Each task first reduces its rows to runs of consecutive attempts with at most two texts, so a prompt with a
    large part of all rows sends little to the task that keeps its state. Prompts are dealt into ``buckets``
    by hash; a bucket is one row of state, read and written when one of its prompts gets an attempt. The
    number has to stay the same for a checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship_package(spark)
    judged = stream.select(
        F.to_json(F.struct(F.col(prompt).alias("prompt")), EXACT).alias("prompt"),
        F.col(attempt).cast("long").alias("attempt"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.col(event_time).cast("timestamp").alias("time"),
    )
    kind = stream.select(F.col(prompt).alias("prompt")).schema
    runs = StructType([
        StructField("prompt", StringType()),
        *(StructField(name, LongType()) for name in ("start", "stop", "valid_attempt", "millis")),
        *(StructField(name, StringType()) for name in ("valid_text", "last_text")),
        StructField("time", TimestampType()),
    ])
    answer = StructType(_fields("prompt string, attempt long, text string, accepted boolean, timed_out boolean"))
    reduced = judged.mapInArrow(_reducer(max_attempts), runs).withWatermark("time", delay)
    dealt = reduced.withColumn("bucket", F.pmod(F.xxhash64("prompt"), F.lit(buckets)))
    chosen = dealt.groupBy("bucket").applyInPandasWithState(
        _chooser(first_attempt, max_attempts), answer, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    chosen = chosen.withColumn("prompt", F.from_json("prompt", kind, EXACT)["prompt"])
    return chosen.withColumnsRenamed({"prompt": prompt, "attempt": attempt, "text": text})


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _reducer(max_attempts: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch["attempt"].is_valid()
            if max_attempts is not None:
                counts = pc.and_(counts, pc.fill_null(pc.less_equal(batch["attempt"], max_attempts), False))
            rest, batch = batch.filter(pc.invert(counts)), batch.filter(counts)
            if batch.num_rows:
                yield runs_of(batch)
            if rest.num_rows:
                yield _only_time(rest)

    return reduce


def _only_time(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row with an empty run at the latest time of a batch; no numbers are null, so that pandas keeps them whole."""
    latest = pa.array([pc.max(batch["time"]).as_py()], batch["time"].type)
    numbers = [pa.array([n], pa.int64()) for n in (0, -1, NO_ATTEMPT, NO_TIME)]
    columns = [pa.nulls(1, batch["prompt"].type), *numbers, *[pa.nulls(1, pa.string())] * 2, latest]
    return pa.RecordBatch.from_arrays(columns, names=RUN_COLUMNS)


RUN_COLUMNS = ["prompt", "start", "stop", "valid_attempt", "millis", "valid_text", "last_text", "time"]


def runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch as runs of consecutive attempts: bounds, first valid attempt, its text, the last one's text."""
    rows = pa.table({
        "code": batch["prompt"].dictionary_encode(null_encoding="encode").indices,
        "attempt": batch["attempt"],
        "invalid": pc.invert(batch["valid"]).cast(pa.int8()),
        "text": batch["text"],
    })
    order = pc.sort_indices(rows, [(name, "ascending") for name in rows.column_names])
    batch, rows = batch.take(order), rows.take(order)
    code, number = rows["code"].to_numpy(), rows["attempt"].to_numpy()
    n, place = len(code), np.arange(len(code))
    new_prompt = np.r_[True, code[1:] != code[:-1]]
    step = np.r_[0, np.diff(number)]
    begin = np.flatnonzero(new_prompt | (step > 1) | (step < 0))
    end = np.r_[begin[1:], n] - 1
    # The first row of each number is the one that counts.
    head = np.maximum.accumulate(np.where(new_prompt | (step != 0), place, 0))
    first = np.minimum.reduceat(np.where(rows["invalid"].to_numpy() == 0, place, n), begin)
    found = first < n
    index = pa.array(first, mask=~found)
    micros = pc.fill_null(batch["time"].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    latest = np.maximum.reduceat(micros, begin)
    timed = latest != np.iinfo(np.int64).min
    columns = [
        batch["prompt"].take(pa.array(begin)),
        pa.array(number[begin]),
        pa.array(number[end]),
        pa.array(np.where(found, number[np.minimum(first, n - 1)], NO_ATTEMPT)),
        pa.array(np.where(timed, latest // 1_000, NO_TIME)),
        batch["text"].take(index),
        batch["text"].take(pa.array(head[end])),
        pa.array(latest, mask=~timed).cast(batch["time"].type),
    ]
    return pa.RecordBatch.from_arrays(columns, names=RUN_COLUMNS)


def joined(seen: list[int], more: list[tuple[int, int]]) -> list[int]:
    """Bounds of the runs that two sets of runs make together, flat and ascending."""
    out: list[int] = []
    for start, stop in sorted([*zip(seen[::2], seen[1::2], strict=True), *more]):
        if out and start <= out[-1] + 1:
            out[-1] = max(out[-1], stop)
        else:
            out += [start, stop]
    return out


def _chooser(first_attempt: int, max_attempts: int | None) -> Callable:
    names = ["prompt", "attempt", "text", "accepted", "timed_out"]

    def take(kept: list, runs: list[tuple]) -> tuple[list, tuple | None]:
        """A prompt's state with more runs of attempts, and its answer if that is certain now."""
        seen, valid, valid_text, last_text, latest, answered, _ = kept
        bounds = [(start, stop) for start, stop, *_ in runs]
        latest = max(latest, *(millis for _, _, _, millis, _, _ in runs))
        out = None
        if not answered:
            found = [(n, _text(t)) for _, _, n, _, t, _ in runs if n != NO_ATTEMPT]
            found += [(valid, valid_text)] if valid is not None else []
            valid, valid_text = min(found, key=lambda f: (f[0], _order(f[1])), default=(None, None))
            stop = max(b for _, b in bounds)
            if not seen or stop >= seen[-1]:
                ends = [_text(t) for _, b, _, _, _, t in runs if b == stop]
                ends += [last_text] if seen and stop == seen[-1] else []
                last_text = min(ends, key=_order)
        seen = joined(seen, bounds)
        if not answered:
            upto = seen[1] if seen[0] <= first_attempt else first_attempt - 1
            if valid is not None and valid <= upto:
                out = (valid, valid_text, True, False)
            elif valid is None and max_attempts is not None and upto >= max_attempts:
                out = (seen[-1], last_text, False, False)
            answered = out is not None
        if answered:
            valid, valid_text, last_text = None, None, None
        return [seen, valid, valid_text, last_text, latest, answered, None], out

    def choose(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        prompts = json.loads(state.get[0]) if state.exists else {}
        runs: dict[str, list[tuple]] = {}
        for part in () if state.hasTimedOut else parts:
            for prompt, *run in zip(*(part[name].tolist() for name in RUN_COLUMNS[:-1]), strict=True):
                if run[0] <= run[1]:
                    runs.setdefault(prompt, []).append(run)
        answers = []
        for prompt, more in runs.items():
            kept, out = take(prompts.get(prompt, UNSEEN), more)
            kept[-1] = max(mark, kept[-3]) + 1
            prompts[prompt] = kept
            answers += [(prompt, *out)] if out else []
        for prompt in [prompt for prompt, kept in prompts.items() if kept[-1] < mark]:
            seen, valid, valid_text, last_text, _, answered, _ = prompts.pop(prompt)
            found = valid is not None
            if not answered:
                answers.append((prompt, valid if found else seen[-1], valid_text if found else last_text, found, True))
        if prompts:
            state.update((json.dumps(prompts),))
            state.setTimeoutTimestamp(max(mark, min(kept[-1] for kept in prompts.values())))
        elif state.exists:
            state.remove()
        if answers:
            yield pd.DataFrame(answers, columns=names)

    return choose


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _order(text: str | None) -> tuple[bool, str]:
    return text is None, text or ""
