"""Exact copies by a tree-merge of sorted digest runs.

Every row starts in a slot chosen by its identifier, so a group of copies is spread over all
slots. In each round a slot exchanges its run with the few slots that differ from it in one digit
and merges what it receives: rows move to the slot in which that digit is the one of their
digest's home. After as many rounds as a slot has digits every digest has met in its home. Each
merge keeps, per digest, the size of the group and its best row, so a group's rows shrink to one
per slot before they move and to at most ``fan`` per digest in any later merge. The verdict takes
the same way back, one join per level, where a key matches at most ``fan`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import shuffle_width, staged

# The characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"

FAN = 8

# What makes two texts the same: the digest, verified by length and an independent hash.
IDENTITY = ["digest", "length", "proof"]


def squeezed(text: Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def leaves(docs: DataFrame, doc_id: str, text: str, slots: int) -> DataFrame:
    normal = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"),
        squeezed(F.col(text)).alias("normal"),
    )
    return normal.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id", "chars"), F.lit(slots)).alias("slot"),
        F.sha2("normal", 256).alias("digest"),
        F.length("normal").alias("length"),
        F.xxhash64("normal").alias("proof"),
        "chars",
    )


def merged(rows: DataFrame) -> DataFrame:
    """Merge what a slot holds: one row per distinct text, sorted by digest.

    The best row is a struct, which Spark can only aggregate over sorted runs.
    """
    runs = rows.groupBy("slot", *IDENTITY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return runs.sortWithinPartitions("slot", "digest")


def next_slot(level: int, fan: int, slots: int) -> Column:
    """The slot with its digit at this level replaced by that of the digest's home."""
    step = fan**level
    home = F.pmod(F.xxhash64("digest"), F.lit(slots))
    digit = lambda slot: F.floor(slot / step) % fan
    return (F.col("slot") + (digit(home) - digit(F.col("slot"))) * step).cast("long")


def judged(docs: DataFrame, doc_id: str, text: str, fan: int = FAN) -> DataFrame:
    """``exact_copies`` with each row's number of code points, ``chars``."""
    if fan < 2:
        raise ValueError("runs merge at least in pairs")
    rounds = 1
    while fan**rounds < shuffle_width(docs.sparkSession):
        rounds += 1
    slots = fan**rounds
    rows = staged(leaves(docs, doc_id, text, slots), "digests")
    best = F.struct((-F.col("chars")).alias("order"), F.isnull("doc_id").alias("nameless"), "doc_id")
    runs = [staged(merged(rows.withColumn("best", best).withColumn("n", F.lit(1).cast("long"))), "run")]
    for level in range(rounds):
        moved = runs[-1].withColumn("slot", next_slot(level, fan, slots))
        runs.append(staged(merged(moved), "run"))
    verdict = runs[-1]
    for level in reversed(range(rounds)):
        asked = runs[level].select("slot", *IDENTITY, next_slot(level, fan, slots).alias("above"))
        answer = verdict.select(F.col("slot").alias("above"), *IDENTITY, "best", "n")
        verdict = asked.join(answer, ["above", *IDENTITY]).drop("above")
    return rows.join(verdict, ["slot", *IDENTITY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("chars") == -F.col("best.order"))).alias(
            "kept"
        ),
        F.col("digest").alias("text_sha256"),
        "chars",
    )


def exact_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = FAN
) -> DataFrame:
    """Per row the copy of its text that stays and the size of its group.

    Texts are equal when they are the same after removing ASCII white space; null counts as the
    empty text. Of equal texts the row with the most code points in the original text stays, then
    the smallest identifier; a null identifier comes last. Rows that repeat both identifier and
    text are counted and judged alike. Other columns are ignored, whatever their names. An empty
    table gives an empty result.

    Returns ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the text
    without white space).
    """
    return judged(docs, doc_id, text, fan).drop("chars")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each text.

    Rows may share an identifier, or have none, and differ in their texts; each is judged by its own.
    """
    verdict = staged(judged(docs, doc_id, text), "copies")
    kept = verdict.where("kept").groupBy("doc_id", "text_sha256", "chars").count()
    rows = docs.withColumn("kept__digest", F.sha2(squeezed(F.col(text)), 256))
    same = (
        F.col(doc_id).eqNullSafe(F.col("kept__id"))
        & (F.col("kept__digest") == F.col("kept__sha256"))
        & (F.coalesce(F.length(text), F.lit(0)) == F.col("kept__chars"))
    )
    rows = rows.join(kept.select(
        F.col("doc_id").alias("kept__id"), F.col("text_sha256").alias("kept__sha256"), F.col("chars").alias("kept__chars")
    ), same, "left_semi")
    # Whole rows move a second time only where some identifier and text are repeated.
    once = rows if kept.where("count > 1").isEmpty() else rows.dropDuplicates([doc_id, "kept__digest"])
    return once.drop("kept__digest")


SQL = r"""
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER best AS kept, text_sha256
    FROM (SELECT doc_id, coalesce(length(text), 0) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
    WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
