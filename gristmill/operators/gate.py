"""The validation gate: accept or quarantine rows, batch inference between two gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.checks import Record, no_errors, schema_errors, schema_valid
from gristmill.functions.json_text import as_record
from gristmill.functions.prompt import format_fields, parse_output
from gristmill.functions.record import LOOKED_UP, VariantRecord, is_true, look_up
from gristmill.operators.records import with_record
from gristmill.spec import Spec


@dataclass(frozen=True)
class GateConfig:
    enable_validation: bool = True
    fail_closed: bool = True


def gate(
    df: DataFrame, record: Record, spec: Spec, config: GateConfig = GateConfig()
) -> DataFrame:
    """Add ``is_valid``, ``errors`` and ``accepted``.

    A closed gate refuses invalid rows; an open one lets them pass with their errors. A row
    whose check yields no answer counts as invalid.
    """
    if not config.enable_validation:
        return df.withColumns(
            {"is_valid": F.lit(True), "errors": no_errors(), "accepted": F.lit(True)}
        )
    if isinstance(record, VariantRecord):
        df, record = look_up(df, record, spec.field_names)
    judged = df.withColumn("is_valid", is_true(schema_valid(record, spec)))
    errors = schema_errors(record, spec, valid=F.col("is_valid"))
    accepted = F.col("is_valid") if config.fail_closed else F.lit(True)
    return judged.withColumns({"errors": errors, "accepted": accepted}).drop(LOOKED_UP)


def shorten_errors(gated: DataFrame, limit: int) -> DataFrame:
    """For showing: at most ``limit`` errors of each row. Reports count the whole lists before."""
    return gated.withColumn("errors", F.slice("errors", 1, limit))


def accepted_rows(gated: DataFrame) -> DataFrame:
    return gated.where("accepted")


def quarantined_rows(gated: DataFrame) -> DataFrame:
    return gated.where("NOT accepted")


def require_accepted(gated: DataFrame) -> DataFrame:
    """Pass the rows on, failing the job at the first one the gate refused."""
    message = F.concat(F.lit("the gate refused a row: "), F.to_json("errors"))
    return gated.where(
        F.when(F.col("accepted"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def lenient(gated: DataFrame) -> DataFrame:
    """Pass every row on; its errors stay attached as a warning."""
    return gated.drop("accepted")


PredictFunction = Callable[[Sequence[str]], Sequence[str]]


def predict(
    df: DataFrame,
    raw: str,
    spec: Spec,
    predict_fn: PredictFunction,
    *,
    strict: bool = True,
    config: GateConfig = GateConfig(),
) -> DataFrame:
    """Gate the JSON text ``raw``, build the prompt, call the model in batches, parse and check its text.

    With ``strict`` a refused input fails the job, otherwise it is left out. Outputs are never
    refused; ``output_valid`` and ``output_errors`` tell about them.
    """
    parsed = with_record(df, raw, "_fields")
    gated = gate(parsed, VariantRecord(F.col("_fields")), spec, config)
    requests = require_accepted(gated) if strict else accepted_rows(gated)

    @F.pandas_udf(T.StringType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(list(predict_fn(prompts.tolist())), dtype="object")

    answers = (
        requests.drop("_fields", "is_valid", "errors", "accepted")
        .withColumn("prompt", format_fields(F.col(raw)))
        .withColumn("generated", answer(F.col("prompt")))
        .withColumn("output", parse_output(F.col("generated")))
    )
    answers = answers.withColumn("_fields", as_record(F.col("output")))
    checked = gate(answers, VariantRecord(F.col("_fields")), spec, config)
    return checked.withColumnsRenamed(
        {"is_valid": "output_valid", "errors": "output_errors"}
    ).drop("_fields", "accepted")


def rule_counts(gated: DataFrame) -> DataFrame:
    """``accepted, rules, n``: how many rows break which set of rules.

    What a report needs to know of a batch. Counts of batches add up, so they can be kept, and a report over
    many batches reads none of their rows again. Rows are not multiplied by their errors: sets are
    few, and each task adds them up before anything moves.
    """
    rules = F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["rule"])))
    return gated.groupBy("accepted", rules.alias("rules")).agg(F.count("*").alias("n"))


def quality_report(gated: DataFrame, max_rejected_share: float = 0.0) -> DataFrame:
    """One row: row counts, rejected rows per rule, and ``healthy`` or ``unhealthy``."""
    return report_of(rule_counts(gated), max_rejected_share)


def report_of(counted: DataFrame, max_rejected_share: float = 0.0) -> DataFrame:
    """The report of one batch or several, from their ``rule_counts``."""
    accepted = F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("rejected"))
    rules = F.transform("rules", lambda rule: F.concat(F.lit("rule:"), rule))
    counters = counted.select(
        F.explode(F.concat(F.array(F.lit("rows"), accepted), rules)).alias("counter"), "n"
    )
    counts = counters.groupBy("counter").agg(F.sum("n").alias("n"))

    def count_of(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("counter") == name, F.col("n"))), F.lit(0))

    per_rule = F.sort_array(
        F.collect_list(
            F.when(
                F.col("counter").startswith("rule:"),
                F.struct(
                    F.regexp_replace("counter", "^rule:", "").alias("rule"), F.col("n").alias("rows")
                ),
            )
        )
    )
    report = counts.agg(
        count_of("rows").alias("rows"),
        count_of("accepted").alias("accepted"),
        count_of("rejected").alias("rejected"),
        per_rule.alias("rules"),
    )
    healthy = F.col("rejected") <= F.col("rows") * F.lit(max_rejected_share)
    return report.withColumn("status", F.when(healthy, "healthy").otherwise("unhealthy"))


def observe_gate(gated: DataFrame, name: str = "gate") -> tuple[DataFrame, Observation]:
    """Count rows while they flow to wherever the job writes them; no extra pass."""
    observation = Observation(name)
    observed = gated.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
    )
    return observed, observation
