"""Text and score extraction, quality filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import Spec
from gristmill.catalog.registry import query, table
from gristmill.functions.quality import (
    QualityConfig,
    extract_score,
    extract_text,
    passes_quality,
)
from gristmill.functions.record import TypedRecord, VariantRecord
from gristmill.operators.patterns import with_patterns_found
from gristmill.operators.quality import filter_quality, filter_rows, reject_reasons
from gristmill.operators.records import with_record

MAIL = r"[a-zA-Z0-9._]+@[a-z]+\.(com|org|net)"


def labelled(spark, sf_dir):
    """Documents with their label, where there is one; both sides have unique keys."""
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def kept(spark, sf_dir, **conditions):
    df = table(spark, sf_dir, "documents")
    record = TypedRecord(df, ["text"])
    return filter_quality(df, record, QualityConfig(**conditions)).select("doc_id")


@query(
    """SELECT o_orderkey, CASE WHEN length(o_orderpriority) > 10 THEN o_orderpriority ELSE '' END
           AS text FROM orders"""
)
def q1_text_fallback(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    text = extract_text(TypedRecord(df, ["o_orderkey", "o_orderstatus", "o_orderpriority"]))
    return df.select("o_orderkey", text.alias("text"))


@query(
    """SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN text WHEN turn <> 0 THEN turn::VARCHAR
                                 ELSE CASE WHEN length(role) > 10 THEN role ELSE text END END)
           AS text_md5 FROM conversations"""
)
def q1_text_keys(spark, sf_dir):
    """Empty strings, zeros and missing keys are passed over; other values are printed."""
    df = table(spark, sf_dir, "conversations")
    is_user = F.col("role") == "user"
    raw = F.to_json(
        F.struct(
            F.lit("").alias("text"),
            F.when(is_user, F.col("text")).alias("content"),
            F.col("turn").alias("message"),
            F.lit(False).alias("description"),
            "role",
            F.col("text").alias("body"),
        )
    )
    text = extract_text(VariantRecord(F.col("fields")))
    parsed = with_record(df, raw, keep=["conv_id", "turn", F.col("text").alias("body")])
    return parsed.select(
        "conv_id", "turn",
        F.md5(F.coalesce(F.nullif(text, F.lit("")), F.col("body"))).alias("text_md5"),
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.0::DOUBLE
           ELSE value END AS score FROM events"""
)
def q2_quality_score(spark, sf_dir):
    """A text that is no number and a null are passed over; a bool counts; else 1.0."""
    df = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    number = F.concat(F.lit('"  '), F.col("value").cast("string"), F.lit(' "'))
    raw = (
        F.when(kind == "click", F.concat(F.lit('{"quality_score":"1.5d","score":'), number, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"score":null,"quality":'), F.col("value").cast("string"), F.lit("}")))
        .when(kind == "purchase", F.lit('{"confidence":false}'))
        .when(kind == "signup", F.concat(F.lit('{"quality_score":[1],"confidence":'), number, F.lit("}")))
        .otherwise(F.lit('{"other":5}'))
    )
    score = extract_score(VariantRecord(F.col("fields")))
    return with_record(df, raw, keep=["event_id"]).select("event_id", score.alias("score"))


@query(
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
       WHERE coalesce(quality, 1) >= 0.5"""
)
def min_quality(spark, sf_dir):
    df = labelled(spark, sf_dir)
    scored = df.withColumn("score", F.coalesce("quality", F.lit(1)))
    config = QualityConfig(min_quality_score=0.5)
    return filter_quality(scored, TypedRecord(scored, ["text", "score"]), config).select("doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id)")
def q3_required_fields(spark, sf_dir):
    df = labelled(spark, sf_dir)
    config = QualityConfig(required_fields=("text", "quality"))
    return filter_quality(df, TypedRecord(df), config).select("doc_id")


@query("SELECT doc_id FROM documents WHERE text = '' OR length(text) BETWEEN 500 AND 5000")
def length_filter(spark, sf_dir):
    return kept(spark, sf_dir, min_length=500, max_length=5000)


@query("SELECT doc_id FROM documents WHERE text = '' OR length(text) <= 2000")
def q4_upper_bound_only(spark, sf_dir):
    return kept(spark, sf_dir, min_length=0, max_length=2000)


@query(
    f"""SELECT doc_id FROM documents WHERE text = '' OR NOT (contains(text, 'license')
            OR regexp_matches(text, '{MAIL}'))"""
)
def forbidden_patterns(spark, sf_dir):
    return kept(spark, sf_dir, forbidden_patterns=("license", MAIL))


@query(
    """SELECT doc_id FROM documents WHERE text <> ''
           AND (regexp_matches(text, '^[A-E][a-z]+ ') OR regexp_matches(text, '[0-9]{3,}'))"""
)
def allowed_patterns(spark, sf_dir):
    return kept(spark, sf_dir, allowed_patterns=("^[A-E][a-z]+ ", "[0-9]{3,}"))


# 500 patterns of two common words: side by side, and in every second one with a word between them.
HEADS = "the of and to in that for it on was with by are this from de la le les des en der die den von".split()
TAILS = "the a an his her its their these which who la el un une que et und ein nicht mit".split()
PHRASES = [
    f" {a} {'[a-z]+ ' if (i + j) % 2 else ''}{b} " for i, a in enumerate(HEADS) for j, b in enumerate(TAILS)
]
PHRASE_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))


@query(
    f"""SELECT doc_id, count(p) AS n_found, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (p IS NOT NULL), '') AS found
        FROM documents LEFT JOIN (VALUES {PHRASE_ROWS}) AS phrases(i, p) ON regexp_matches(text, p) GROUP BY doc_id"""
)
def q5_many_patterns(spark, sf_dir):
    """Which of 500 patterns each document contains, told in one pass over its text."""
    df = with_patterns_found(table(spark, sf_dir, "documents"), F.col("text"), PHRASES)
    return df.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join("found", ",").alias("found"))


@query("SELECT event_id FROM events WHERE value >= 25.5")
def q7_min_score(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    record = TypedRecord(df, {"score": "value"})
    return filter_quality(df, record, QualityConfig(min_quality_score=25.5)).select("event_id")


@query(
    f"""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
        WHERE source IS NOT NULL AND length(text) BETWEEN 200 AND 8000
          AND NOT regexp_matches(text, '{MAIL}') AND regexp_matches(text, '[a-z]+\\.')
          AND coalesce(quality, 1) >= 1"""
)
def quality_filter(spark, sf_dir):
    df = labelled(spark, sf_dir)
    config = QualityConfig(
        min_length=200,
        max_length=8000,
        required_fields=("source",),
        forbidden_patterns=(MAIL,),
        allowed_patterns=(r"[a-z]+\.",),
        min_quality_score=1,
    )
    scored = df.withColumn("score", F.coalesce("quality", F.lit(1)))
    return filter_quality(scored, TypedRecord(scored), config).select("doc_id")


@query("SELECT count(*) FILTER (text <> '' AND length(text) >= 300 AND contains(text, 'the')) AS kept, "
       "count(*) AS total FROM documents")
def q9_custom_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    config = QualityConfig(min_length=300, allowed_patterns=["the"])
    ok = passes_quality(TypedRecord(df, ["text"]), config)
    return df.agg(F.count_if(ok).alias("kept"), F.count("*").alias("total"))


@query(
    """SELECT doc_id FROM documents JOIN labels USING (doc_id)
       WHERE text = '' OR (length(text) >= 101 AND length(text) <= 3999)"""
)
def q10_spec_filter(spark, sf_dir):
    """Length constraints of a spec, and the required fields of both its entities."""
    spec = Spec.from_dict(
        {
            "entities": {
                "Document": {"fields": {"text": "string", "lang": "string"}},
                "Label": {
                    "fields": {"quality": "int", "note": {"type": "string", "required": False}}
                },
            },
            "constraints": [
                {"expr": "len(text) <= 90000"},
                {"expr": "len(title) < 4000"},
                {"expr": "len(text) > 100"},
                {"expr": "len(text) == 5"},
                {"expr": "quality >= 1"},
            ],
        }
    )
    df = labelled(spark, sf_dir)
    return filter_quality(df, TypedRecord(df), QualityConfig.from_spec(spec)).select("doc_id")


@query(
    f"""SELECT reason, count(*) AS n FROM (
            SELECT CASE WHEN quality IS NULL THEN 'required_fields'
                        WHEN text <> '' AND NOT length(text) BETWEEN 400 AND 6000 THEN 'length'
                        WHEN text <> '' AND regexp_matches(text, '{MAIL}') THEN 'forbidden_pattern'
                        WHEN text = '' OR NOT contains(text, 'the') THEN 'allowed_pattern'
                        WHEN quality < 1 THEN 'quality_score' END AS reason
            FROM documents LEFT JOIN labels USING (doc_id))
        WHERE reason IS NOT NULL GROUP BY reason"""
)
def reject_reasons_report(spark, sf_dir):
    df = labelled(spark, sf_dir)
    config = QualityConfig(
        min_length=400,
        max_length=6000,
        required_fields=("quality",),
        forbidden_patterns=(MAIL,),
        allowed_patterns=("the",),
        min_quality_score=1,
    )
    return reject_reasons(df, TypedRecord(df), config)


def document_records(spark, sf_dir):
    """Labelled documents as JSON records, the label as a score where there is one."""
    raw = F.to_json(F.struct("doc_id", "text", "lang", "source", F.col("quality").alias("score")))
    return with_record(labelled(spark, sf_dir), raw, keep=["doc_id"])


JSON_QUALITY = QualityConfig(
    min_length=200,
    max_length=8000,
    required_fields=("source", "text"),
    forbidden_patterns=(MAIL,),
    allowed_patterns=(r"[a-z]+\.",),
    min_quality_score=0.5,
)


@query(
    f"""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
        WHERE source IS NOT NULL AND text IS NOT NULL AND length(text) BETWEEN 200 AND 8000
          AND NOT regexp_matches(text, '{MAIL}') AND regexp_matches(text, '[a-z]+\\.')
          AND coalesce(quality, 1) >= 0.5"""
)
def q8_json_quality_filter(spark, sf_dir):
    df = document_records(spark, sf_dir)
    return filter_quality(df, VariantRecord(F.col("fields")), JSON_QUALITY).select("doc_id")


@query(
    f"""SELECT reason, count(*) AS n FROM (
            SELECT CASE WHEN source IS NULL OR text IS NULL THEN 'required_fields'
                        WHEN text <> '' AND NOT length(text) BETWEEN 200 AND 8000 THEN 'length'
                        WHEN text <> '' AND regexp_matches(text, '{MAIL}') THEN 'forbidden_pattern'
                        WHEN text = '' OR NOT regexp_matches(text, '[a-z]+\\.') THEN 'allowed_pattern'
                        WHEN quality < 0.5 THEN 'quality_score' END AS reason
            FROM documents LEFT JOIN labels USING (doc_id))
        WHERE reason IS NOT NULL GROUP BY reason"""
)
def q11_json_reject_reasons(spark, sf_dir):
    df = document_records(spark, sf_dir)
    return reject_reasons(df, VariantRecord(F.col("fields")), JSON_QUALITY)


@query("SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def u1_row_predicate(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return filter_rows(df, lambda d: (d["n_chars"] > 1000) & (d["lang"] == "en")).select("doc_id")
