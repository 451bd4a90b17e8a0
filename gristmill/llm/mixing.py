"""Mixing sources to target weights by Pareto order sampling.

A source's target says how many copies of a document are expected. Whole copies are certain; for
the part left over each document draws random odds, divides them by the odds of being included and
is ranked by the quotient. The first ones, up to the words still missing, get one copy more.

No source is ranked as a whole. Ranks fall into buckets whose words are added up first; only the
bucket that holds the cut is put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import ship_package, staged

SHARES = (5, 2, 1)
MOST = 3
SEED = "mix"

# Documents of a source that a bucket of ranks holds, and buckets of a source at most.
BUCKET_ROWS = 2_000
MOST_BUCKETS = 65_536

# Preferences are rounded to sixteen levels an octave, within twenty octaves of 1.
LEVELS = 16
OCTAVES = 20

WORDS = r"[^\x20\x09-\x0D]+"


def filled(items: DataFrame, group: list[str], weight: str, cap: str, total: str) -> DataFrame:
    """Add ``got``: a total dealt out by weight, no item above its cap, what is over dealt again.

    With items in the order of cap by weight, those at their cap come first; the first that stays
    below tells what one unit of weight gets. Items of a group are few: sources, or levels.
    """
    order = Window.partitionBy(*group).orderBy("fill_key", cap, weight)
    everything = Window.partitionBy(*group)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    remaining, weights = F.col(total) - before, F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    laid = items.withColumn("fill_key", F.col(cap) / F.col(weight)).withColumns(
        {"fill_left": remaining.cast("double"), "fill_weights": weights.cast("double")}
    )
    below = F.col("fill_left") * F.col(weight) < F.col(cap) * F.col("fill_weights")
    first = F.min_by(
        F.when(below, F.struct("fill_left", "fill_weights")), F.when(below, F.col("fill_key"))
    ).over(everything)
    got = F.when(below, F.col("first.fill_left") * F.col(weight) / F.col("first.fill_weights"))
    return (
        laid.withColumn("first", first)
        .withColumn("got", F.coalesce(got, F.col(cap).cast("double")))
        .drop("fill_key", "fill_left", "fill_weights", "first")
    )


def uniform(seed: str, docs_id: str, text: str) -> Column:
    """A number between 0 and 1 that depends on seed, identifier and text alone."""
    name = F.coalesce(F.col(docs_id).cast("string"), F.lit("-"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), name, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def level_of(preference: str | None) -> Column:
    if preference is None:
        return F.lit(0)
    given = F.col(preference).cast("double")
    bound = LEVELS * OCTAVES
    level = F.round(F.log2(F.when((given > 0) & ~F.isnan(given), given).otherwise(1.0)) * LEVELS)
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), level)).cast("int")


def weighted(sources: DataFrame, shares: tuple[int, ...]) -> DataFrame:
    """Sources by code point, null last, with their repeating weights; one row a source."""
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(shares)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, shares)), turn + 1).cast("long"))


def placed(rows: DataFrame) -> DataFrame:
    """The ranking variable of each document: random odds by odds of inclusion, and its bucket.

    Buckets split (0, 1) into which quotients q fall as q / (1 + q). A document without a part of a copy
    left to draw has no rank.
    """
    part = F.col("part")
    drawn = (F.col("u") / (1 - F.col("u"))) / F.when(part > 0, part / (1 - part))
    bucket = F.floor(F.col("q") / (1 + F.col("q")) * F.col("buckets"))
    # "least" passes over nulls, so it is only asked where there is a rank.
    placed_in = F.when(F.col("q").isNotNull(), F.least(F.col("buckets") - 1, bucket))
    return rows.withColumn("q", drawn).withColumn("bucket", placed_in)


def first_fitting(groups: DataFrame) -> DataFrame:
    """Documents of one source's cut bucket in order of rank, each taken if it fits what is missing."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["q", "size"], kind="stable").reset_index(drop=True)
        left, extra = int(batch["missing"].iloc[0]) if len(batch) else 0, []
        for size in batch["size"]:
            extra.append(int(size <= left))
            left -= size if size <= left else 0
        batch["extra"] = pd.array(extra, dtype="int64")
        return batch.drop(columns=["missing"])

    ship_package(groups.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in groups.dtypes if n != "missing") + ", extra bigint"
    return groups.groupBy("source").applyInPandas(run, schema)


def mixed(
    docs: DataFrame,
    shares: tuple[int, ...] = SHARES,
    most: int = MOST,
    preference: str | None = None,
    seed: str = SEED,
) -> DataFrame:
    """How often a mix takes each document, and the words that makes.

    ``docs`` has ``doc_id``, ``source`` and ``text``. Sources weigh ``shares`` in turn and share all
    words; none gets over ``most`` times its own. Within a source documents are expected equally often,
    or in proportion to a numeric column ``preference`` (in steps of a sixteenth octave; null, NaN, zero
    and less count as 1), each ``most`` times at most. The words of a source come within the shortest
    document passed over of its target, as far as whole copies allow.

    Null texts have no words; a null source is a source; rows without or with the same identifier are
    rows of their own, and of rows alike in every way any may be the one taken. No row gives no row.
    Draws depend on seed, identifier and text only, so reruns agree. Returns ``doc_id, source, size,
    source_size, target, copies, taken``.
    """
    rows = staged(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            level_of(preference).alias("level"),
            uniform(seed, "doc_id", "text").alias("u"),
        ),
        "sizes",
    )
    levels = staged(
        rows.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "levels"
    )
    plan = staged(budgets(levels, shares, most), "budgets")
    ranked = placed(on_source(rows, plan, "level"))
    sums = ranked.where("q is not null").groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.first("budget").alias("budget")
    )
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    # The first bucket that does not fit as a whole; all before it do, none after it is looked at.
    over = sums.withColumn("upto", upto).where("upto > budget").groupBy("source").agg(
        F.min_by(F.struct("bucket", (F.col("budget") - F.col("upto") + F.col("words")).alias("missing")), "bucket")
        .alias("cut")
    )
    cuts = staged(over.select("source", F.col("cut.bucket").alias("cut"), F.col("cut.missing").alias("missing")), "cuts")
    known = on_source(ranked, cuts)
    names = ["doc_id", "source", "size", "source_size", "target", "whole"]
    at_cut = first_fitting(known.where("bucket = cut").select(*names, "q", "missing"))
    before = F.coalesce(F.col("bucket") < F.coalesce("cut", "buckets"), F.lit(False))
    clear = known.where("bucket is null or cut is null or bucket <> cut")
    both = clear.select(*names, before.cast("long").alias("extra")).unionByName(at_cut.select(*names, "extra"))
    return both.select(
        *names[:-1],
        (F.col("whole") + F.col("extra")).alias("copies"),
        ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"),
    )


def budgets(levels: DataFrame, shares: tuple[int, ...], most: int) -> DataFrame:
    """For each source and level: target, whole copies, part of a copy; words missing after whole copies."""
    sources = weighted(
        levels.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows")), shares
    )
    sources = sources.withColumns(
        {"cap": most * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())}
    )
    targets = filled(sources, [], "weight", "cap", "total").withColumnRenamed("got", "target")
    targets = targets.withColumn("buckets", F.least(F.lit(MOST_BUCKETS), F.expr(f"rows div {BUCKET_ROWS}") + 1))
    named = targets.select(F.col("source").alias("its"), "source_size", "target", "buckets")
    shared = (
        levels.where("words > 0")
        .join(named, F.col("source").eqNullSafe(F.col("its")))
        .withColumn("share", F.col("words") * F.pow(F.lit(2.0), F.col("level") / LEVELS))
        .withColumn("cap", most * F.col("words"))
    )
    copies = filled(shared, ["source"], "share", "cap", "target").withColumn("copies", F.col("got") / F.col("words"))
    whole = F.floor("copies")
    sure = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    parted = copies.withColumn("whole", whole).withColumn("part", F.col("copies") - whole)
    parted = parted.withColumn("budget", F.round("target").cast("long") - sure)
    empty = levels.where("words = 0").join(named, F.col("source").eqNullSafe(F.col("its")))
    names = ["source", "level", "source_size", "target", "buckets", "whole", "part", "budget"]
    return parted.select(*names).unionByName(
        empty.withColumns({"whole": F.lit(0).cast("long"), "part": F.lit(0.0), "budget": F.lit(0).cast("long")})
        .select(*names)
    )


def on_source(rows: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """Join a small table of sources (null equals null) to all rows; Spark sees its size in the staged files."""
    keys = ["source", *more]
    renamed = table.select(*(F.col(c).alias(f"on_{c}") if c in keys else F.col(c) for c in table.columns))
    on = [F.col(k).eqNullSafe(F.col(f"on_{k}")) for k in keys]
    return rows.join(renamed, on, "left").drop(*(f"on_{k}" for k in keys))


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))
      ::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT *, {MOST} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN {SHARES[0]} WHEN 1 THEN {SHARES[1]} ELSE {SHARES[2]} END)::BIGINT AS weight
  FROM sources),
laid AS (
  SELECT *, cap / weight AS key,
    (total - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, cap, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    (sum(weight) OVER (
      ORDER BY cap / weight, cap, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights
  FROM weighed),
first AS (SELECT rest, weights FROM laid WHERE rest * weight < cap * weights ORDER BY key LIMIT 1),
targets AS (
  SELECT source, source_size, n // {BUCKET_ROWS} + 1 AS buckets,
    CASE WHEN l.rest * weight < cap * l.weights
      THEN (SELECT rest FROM first) * weight / (SELECT weights FROM first) ELSE cap::DOUBLE END AS target
  FROM laid l),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part
  FROM targets),
drawn AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.buckets,
    CASE WHEN p.part > 0 THEN (d.u / (1 - d.u)) / (p.part / (1 - p.part)) END AS q,
    round(p.target)::BIGINT - (p.whole * p.source_size)::BIGINT AS budget
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
bucketed AS (
  SELECT *, least(buckets - 1, floor(q / (1 + q) * buckets)) AS bucket FROM drawn),
sums AS (
  SELECT source, bucket, sum(size) AS words, any_value(budget) AS budget
  FROM bucketed WHERE q IS NOT NULL GROUP BY source, bucket),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM sums),
cuts AS (
  SELECT source, min(bucket) AS cut, min_by(budget - upto + words, bucket)::BIGINT AS missing
  FROM running WHERE upto > budget GROUP BY source),
known AS (
  SELECT b.*, c.cut, c.missing FROM bucketed b LEFT JOIN cuts c ON b.source IS NOT DISTINCT FROM c.source),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY q, size) AS place FROM known WHERE bucket = cut),
walk AS (
  SELECT source, 0::BIGINT AS place, missing AS rest, NULL::BIGINT AS doc_id, NULL::BIGINT AS size,
    NULL::BIGINT AS source_size, NULL::DOUBLE AS target, NULL::DOUBLE AS whole, 0 AS extra FROM cuts
  UNION ALL
  SELECT q.source, q.place, CASE WHEN q.size <= w.rest THEN w.rest - q.size ELSE w.rest END, q.doc_id, q.size,
    q.source_size, q.target, q.whole, CASE WHEN q.size <= w.rest THEN 1 ELSE 0 END
  FROM walk w JOIN queue q ON q.source IS NOT DISTINCT FROM w.source AND q.place = w.place + 1),
everything AS (
  SELECT doc_id, size, source_size, target, whole,
    CASE WHEN q IS NOT NULL AND bucket < coalesce(cut, buckets) THEN 1 ELSE 0 END AS extra
  FROM known WHERE bucket IS NULL OR cut IS NULL OR bucket <> cut
  UNION ALL
  SELECT doc_id, size, source_size, target, whole, extra FROM walk WHERE place > 0)
SELECT doc_id, size, source_size, target, ((whole + extra) * size)::BIGINT AS taken FROM everything
"""
