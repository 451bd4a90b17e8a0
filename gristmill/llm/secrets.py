"""Secrets in versioned texts, by an incremental ledger of content-addressed blobs.

A version of a path is named by the digest of its content, its blob. The ledger is a table of
scans: a blob, the rules (with their versions) it was scanned by, and what they found. A run scans
only pairs of blob and rule version the ledger does not have, one text per blob, appends them, and
joins the ledger's findings back to all paths. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import staged
from gristmill.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    The pattern has no look-around, so that its matches can be located one after the other. Texts
    without any of ``needs`` have no match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


BASE = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2, least=6, needs=(":", "="),
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20, needs=("AKIA",)),
    # A run of 24 and more is what a run of any length with a least length of 24 would give.
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("forge", "gh[opsru]_[A-Za-z0-9]{36,}", needs=("gh",)),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY",)),
)
RULES = BASE + MORE

FINDINGS = "array<struct<rule:string,kind:string,start:int,end:int>>"


STEPS = "array<struct<rule:int,before:int,size:int,judged:int>>"


def steps(text: Column, rule: Rule, number: int) -> Column:
    """For each match of a rule, in order: how long the text before it is, back to the last match, how long
    the match and how long the part that is judged, in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    rows = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("b"), found.alias("m"), judged.alias("v")),
        lambda x: F.struct(
            F.lit(number).alias("rule"), F.length(x["b"]).alias("before"), F.length(x["m"]).alias("size"),
            F.length(x["v"]).alias("judged"),
        ),
    )
    # What comes after the last match is no step.
    rows = F.filter(rows, lambda x: x["size"].isNotNull()).cast(STEPS)
    nothing = F.array().cast(STEPS)
    if not rule.needs:
        return rows
    possible = F.lit(False)
    for literal in rule.needs:
        possible = possible | F.contains(text, F.lit(literal))
    return F.when(possible, rows).otherwise(nothing)


def found_spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, found``: the spans of all rules that are due, of blobs with any; in time linear in the matches.

    Steps become rows, and a running sum over those of one blob and rule gives the places. ``texts`` has a
    row per blob: ``blob``, ``due``, ``body``.
    """
    nothing = F.array().cast(STEPS)
    run = [
        F.when(F.array_contains("due", r.name), steps(F.col("body"), r, n)).otherwise(nothing)
        for n, r in enumerate(rules)
    ]
    # A text that comes twice is counted through twice.
    numbered = texts.withColumn("copy", F.monotonically_increasing_id())
    rows = numbered.select("blob", "copy", F.posexplode(F.concat(*run)).alias("nth", "s"))
    order = Window.partitionBy("copy", "s.rule").orderBy("nth")
    end = F.sum(F.col("s.before") + F.col("s.size")).over(order)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("s.rule") + 1)
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind")) for r in rules])
    of = F.element_at(names, F.col("s.rule") + 1)
    spans = rows.withColumn("end", end.cast("int")).where(F.col("s.judged") >= least).select(
        "blob", F.struct(
            of["rule"].alias("rule"), of["kind"].alias("kind"),
            (F.col("end") - F.col("s.size")).alias("start"), F.col("end").alias("end"),
        ).alias("f"),
    )
    return spans.groupBy("blob").agg(F.collect_set("f").cast(FINDINGS).alias("found"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def slot(blob: str = "blob") -> Column:
    """The part of the ledger that a blob belongs to: the first digit of its address."""
    return F.substring(blob, 1, 1)


def ledger_entries(spark: SparkSession, ledger: str, slots: list[str] | None = None) -> DataFrame:
    """The entries of a ledger, or of some parts of it; other parts are not opened."""
    schema = f"blob string, scanned array<string>, found {FINDINGS}, slot string"
    if exists(spark, ledger):
        entries = spark.read.schema(schema).parquet(ledger)
        return (entries if slots is None else entries.where(F.col("slot").isin(slots))).drop("slot")
    return spark.sql(
        f"SELECT '' AS blob, cast(array() AS array<string>) AS scanned, cast(array() AS {FINDINGS}) AS found"
    ).where("false")


def blob(text: str) -> Column:
    """The address of a content; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(
    docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Bring the ledger up to date with some versions, and give each version its findings.

    Each row of ``docs`` is a version of a path; a path may have several, and versions may share
    their content. Appends one entry per blob that had rules to be run, also where nothing was
    found. Returns ``path``, ``blob`` and ``findings`` of the given rules, one row per row of
    ``docs``: null texts count as empty, repeated rows are separate versions, a null path is a path
    like any other, other columns are ignored. An empty table changes nothing and gives no rows.
    """
    spark = docs.sparkSession
    versions = staged(docs.select(F.col(path).alias("path"), blob(text).alias("blob")), "versions")
    names = F.array(*[F.lit(r.name) for r in rules])
    # At most sixteen values.
    slots = sorted(r["slot"] for r in versions.select(slot().alias("slot")).distinct().collect())
    own = versions.select("blob").distinct()
    seen = ledger_entries(spark, ledger, slots).join(own, "blob", "left_semi").groupBy("blob").agg(
        F.flatten(F.collect_set("scanned")).alias("scanned")
    )
    todo = (
        versions.groupBy("blob").agg(F.min("path").alias("sample"))
        .join(seen, "blob", "left")
        .withColumn("due", F.array_except(names, F.coalesce("scanned", F.array().cast("array<string>"))))
        .where(F.size("due") > 0)
        .select("blob", "sample", "due")
    )
    todo = staged(todo, "due")
    texts = docs.select(
        F.col(path).alias("sample_path"), blob(text).alias("blob_of"), F.coalesce(text, F.lit("")).alias("body")
    )
    met = texts.join(
        todo, F.col("sample_path").eqNullSafe(F.col("sample")) & (F.col("blob_of") == F.col("blob"))
    )
    # Rows that repeat path and content carry the same spans; the ledger takes one of each.
    spans = found_spans(met.select("blob", "due", "body"), rules)
    nothing = F.array().cast(FINDINGS)
    once = todo.join(spans, "blob", "left").select(
        "blob", F.col("due").alias("scanned"), F.coalesce("found", nothing).alias("found"),
        slot().alias("slot"),
    )
    once.write.mode("append").partitionBy("slot").parquet(ledger)
    current = ledger_entries(spark, ledger, slots).join(own, "blob", "left_semi")
    current = current.select("blob", F.explode("found").alias("f"))
    current = current.where(F.col("f.rule").isin([r.name for r in rules]))
    told = current.groupBy("blob").agg(F.collect_set("f").alias("findings"))
    return versions.join(told, "blob", "left").select(
        "path", "blob", F.coalesce("findings", nothing).alias("findings")
    )


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, by start and kind as listed, joined by commas."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("s"), F.array_position(order, s["kind"]).alias("r"), s["end"].alias("e"),
            s["kind"].alias("k"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """The rows of ``op9_secret_scan``; counts and digest are of the base kinds, ``spans`` is all."""
    found = scan(docs, ledger or scratch_path(docs.sparkSession, "ledger"))
    of = lambda rules: F.filter("findings", lambda s: s["kind"].isin([r.kind for r in rules]))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(of((r,))).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(of(BASE), BASE), 256).alias("base_sha256"),
        listed(F.col("findings"), RULES).alias("spans"),
    )


def brute_force(text: str | None) -> list[tuple[int, int, str]]:
    """Base spans by the patterns as they are defined; for tests."""
    text, out = text or "", []
    word = r"(password|passwd|secret|token|api_?key)"
    for m in re.finditer(rf"(?i:{word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6 and m[1].isascii():
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(s, e, k) for s, _, e, k in sorted(out)]
