"""Model answers: extraction and choice; training text and tokens; batch inference."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill import Spec
from gristmill.catalog.registry import query, table
from gristmill.functions import checks
from gristmill.functions.json_text import parse_texts
from gristmill.functions.prompt import (
    LAYOUTS,
    extract_json,
    extract_json_text,
    format_fields,
    format_output,
    parse_output,
)
from gristmill.functions.record import VariantRecord
from gristmill.operators.candidates import best_of, rejection_log
from gristmill.operators.gate import predict
from gristmill.operators.records import with_record
from gristmill.operators.training import (
    output_conforms,
    pair_columns,
    tokenize,
    training_text,
)


def small_spec() -> Spec:
    return Spec.from_dict({"entities": {"Small": {"fields": {"k": {"type": "int", "range": [0, 12]}}}}})


def answers(spark, sf_dir):
    """Model-like texts per event type."""
    df = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("x "), "props", F.lit(" y {\"k\":0}")))
        .when(kind == "view", F.concat(F.lit('x {"a":'), "props", F.lit("} y")))
        .when(kind == "purchase", F.concat(F.lit("{bad} "), "props"))
        .when(kind == "signup", F.concat(F.lit("["), F.regexp_extract("props", "[0-9]+", 0), F.lit(",2]")))
        .otherwise(F.lit("plain"))
    )
    return df.select("event_id", "event_type", text.alias("text"))


def attempts(spark, sf_dir):
    """Each user's events in time order as numbered attempts at one prompt."""
    df = table(spark, sf_dir, "events")
    in_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = df.withColumn("attempt", F.row_number().over(in_time))
    return numbered.select(
        F.col("user_id").alias("prompt_id"), "attempt",
        F.concat(F.lit("x "), "props", F.lit(" y")).alias("text"),
        "event_id", "ts",
    )


ATTEMPTS = """(SELECT user_id AS prompt_id, event_id, regexp_extract(props, '[0-9]+')::INT AS k,
                      'x ' || props || ' y' AS text,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
               FROM events)"""


def parsed_attempts(spark, sf_dir):
    """Attempts with the record found in their text, parsed once per attempt."""
    return with_record(attempts(spark, sf_dir), extract_json_text(F.col("text")))


def answer_record():
    return VariantRecord(F.col("fields"))


@query(
    """SELECT event_id, CASE event_type WHEN 'signup'
               THEN '[' || regexp_extract(props, '[0-9]+') || ',2]' WHEN 'error' THEN NULL
               ELSE props END AS found,
           CASE event_type WHEN 'signup' THEN '[' || regexp_extract(props, '[0-9]+') || ',2]'
               WHEN 'error' THEN NULL ELSE replace(props, ' ', '') END AS value
       FROM events"""
)
def r1_extract_json(spark, sf_dir):
    df = answers(spark, sf_dir)
    return df.select(
        "event_id",
        extract_json_text(F.col("text")).alias("found"),
        F.to_json(extract_json(F.col("text"))).alias("value"),
    )


@query(
    f"""SELECT prompt_id, coalesce(min(attempt) FILTER (k <= 12), max(attempt)) AS attempt,
               coalesce(arg_min(text, attempt) FILTER (k <= 12), arg_max(text, attempt)) AS text,
               coalesce(bool_or(k <= 12), false) AS accepted
        FROM {ATTEMPTS} WHERE attempt <= 10 GROUP BY prompt_id"""
)
def best_of_n(spark, sf_dir):
    valid = checks.schema_valid(answer_record(), small_spec())
    return best_of(parsed_attempts(spark, sf_dir), valid, max_attempts=10)


@query(f"SELECT prompt_id, attempt, 'maximum' AS rule FROM {ATTEMPTS} WHERE attempt <= 10 AND k > 12 "
       f"UNION ALL SELECT prompt_id, attempt, 'oneOf' FROM {ATTEMPTS} WHERE attempt <= 10 AND k > 12")
def r3_rejection_log(spark, sf_dir):
    errors = checks.output_errors(answer_record(), small_spec())
    log = rejection_log(parsed_attempts(spark, sf_dir), errors, max_attempts=10)
    return log.select("prompt_id", "attempt", "rule")


@query(
    """SELECT event_id, CASE event_type WHEN 'signup' THEN '[' || regexp_extract(props, '[0-9]+') || ',2]'
           WHEN 'error' THEN '{"text":"plain"}'
           WHEN 'click' THEN '{"text":"x ' || replace(props, '"', '\\"') || ' y {\\"k\\":0}"}'
           WHEN 'view' THEN '{"text":"x {\\"a\\":' || replace(props, '"', '\\"') || '} y"}'
           ELSE '{"text":"{bad} ' || replace(props, '"', '\\"') || '"}' END AS output
       FROM events"""
)
def r4_parse_output(spark, sf_dir):
    df = answers(spark, sf_dir)
    return df.select("event_id", F.to_json(parse_output(F.col("text"))).alias("output"))


# --- training text ---------------------------------------------------------------------


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def pairs(spark, sf_dir):
    """A user turn and the assistant turn right after it, met on a key that is unique per row."""
    df = turns(spark, sf_dir)
    asked = df.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = df.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def pair_records(spark, sf_dir):
    """Pairs as JSON records; a question with a line end goes in as ready text."""
    df = pairs(spark, sf_dir)
    pair = F.to_json(
        F.struct(
            F.struct("question", "turn", F.lit(True).alias("first")).alias("input"),
            F.struct("answer").alias("output"),
        )
    )
    ready = F.to_json(F.struct(F.col("question").alias("text")))
    raw = F.when(F.col("question").contains("\n"), ready).otherwise(pair)
    return df.select("conv_id", "turn", raw.alias("raw"))


PAIRS = """(SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer
            FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
            WHERE a.role = 'user' AND b.role = 'assistant')"""


@query("SELECT conv_id, turn, 'role: ' || role || chr(10) || 'turn: ' || turn || chr(10) || 'text: ' "
       "|| text || chr(10) || 'none: null' AS prompt FROM conversations")
def f1_format_input(spark, sf_dir):
    df = turns(spark, sf_dir)
    raw = F.to_json(
        F.struct("role", "turn", "text", F.lit(None).cast("string").alias("none")),
        {"ignoreNullFields": "false"},
    )
    return df.select("conv_id", "turn", format_fields(raw).alias("prompt"))


@query(f"""SELECT conv_id, turn, to_json({{'answer': answer}})::VARCHAR AS output, true AS schema_ok
           FROM {PAIRS} WHERE NOT contains(question, chr(10))""")
def f2_format_output(spark, sf_dir):
    spec = Spec.from_dict({"entities": {"Answer": {"fields": {"answer": "string"}}}})
    df = with_record(pair_records(spark, sf_dir)).withColumn("texts", parse_texts(F.col("raw")))
    output = format_output(F.col("fields")["output"]["value"], F.col("texts")["output"])
    return df.where(F.map_contains_key("fields", F.lit("output"))).select(
        "conv_id", "turn", output.alias("output"),
        output_conforms(F.col("fields"), spec).alias("schema_ok"),
    )


@query(f"""SELECT conv_id, turn, CASE WHEN contains(question, chr(10)) THEN question || chr(10)
               ELSE 'question: ' || question || chr(10) || 'turn: ' || turn || chr(10) || 'first: true'
                    || chr(10) || to_json({{'answer': answer}})::VARCHAR END AS text FROM {PAIRS}""")
def f3_format_example(spark, sf_dir):
    df = pair_records(spark, sf_dir)
    return training_text(df, "raw", layout="compact", keep=["conv_id", "turn"])


@query(
    """SELECT conv_id, turn, 'turn: ' || turn || chr(10) || 'tags: ["' || role || '", "\\u00e9"]' || chr(10)
              || 'inner: {"role": "' || role || '", "n": [' || turn || ', {}]}' || chr(10)
              || 'plain: [1,2]' AS prompt FROM conversations"""
)
def f1_nested_input(spark, sf_dir):
    """Lists and objects in a prompt are laid out as Python does; texts that look like one are not."""
    inner = F.concat(
        F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"tags":["'), "role", F.lit('","é"],"inner":{"role":"'),
        "role", F.lit('","n":['), F.col("turn").cast("string"), F.lit(',{}]},"plain":"[1,2]"}'),
    )
    return turns(spark, sf_dir).select("conv_id", "turn", format_fields(inner).alias("prompt"))


@query(
    f"""SELECT conv_id, turn, '{{' || chr(10) || '  "answer": ' || to_json(length(answer)) || ',' || chr(10)
               || '  "turns": [' || chr(10) || '    ' || turn || ',' || chr(10) || '    ' || (turn + 1) || chr(10)
               || '  ],' || chr(10) || '  "none": {{}},' || chr(10) || '  "mark": "\\u00e9, [:]"' || chr(10) || '}}'
               AS output FROM {PAIRS}"""
)
def f2_indented_output(spark, sf_dir):
    raw = F.concat(
        F.lit('{"answer":'), F.length("answer").cast("string"), F.lit(',"turns":['), F.col("turn").cast("string"),
        F.lit(","), (F.col("turn") + 1).cast("string"), F.lit('],"none":{},"mark":"é, [:]"}'),
    )
    df = pairs(spark, sf_dir)
    return df.select("conv_id", "turn", LAYOUTS["indented"](raw).alias("output"))


@query(f"""SELECT conv_id, turn, 'text: ' || question || chr(10) || to_json({{'text': answer}})::VARCHAR
           AS text FROM {PAIRS}""")
def training_text_pairs(spark, sf_dir):
    df = pairs(spark, sf_dir)
    answer = F.to_json(F.struct(F.col("answer").alias("text")))
    text = pair_columns({"text": F.col("question")}, answer)
    return df.select("conv_id", "turn", text.alias("text"))


def tokens_sql(count: str) -> str:
    """Number of tokens, the first and the last one."""
    return f"""
        SELECT doc_id, {count} AS n_tokens, words[1] AS first_token, words[{count}] AS last_token
        FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words
              FROM documents)"""


@query(tokens_sql("len(words)"))
def f4_tokenize(spark, sf_dir):
    return token_ends(tokenize(table(spark, sf_dir, "documents"), "text", keep=["doc_id"]))


@query(tokens_sql("least(len(words), 2048)"))
def f4_tokenize_cut(spark, sf_dir):
    """The cut is the feature here: training input of at most 2048 tokens."""
    df = table(spark, sf_dir, "documents")
    return token_ends(tokenize(df, "text", keep=["doc_id"], max_tokens=2048))


def token_ends(tokens):
    return tokens.select(
        "doc_id", F.size("input_ids").alias("n_tokens"),
        F.try_element_at("input_ids", F.lit(1)).alias("first_token"),
        F.try_element_at("labels", F.lit(-1)).alias("last_token"),
    )


@query("SELECT doc_id, strlen(text) AS n_tokens FROM documents")
def u3_tokenizer(spark, sf_dir):
    """A user-supplied tokenizer, here one token per UTF-8 byte."""
    tokens = tokenize(
        table(spark, sf_dir, "documents"), "text", lambda texts: [t.encode() for t in texts],
        keep=["doc_id"],
    )
    return tokens.select("doc_id", F.size("input_ids").alias("n_tokens"))


@query(
    """SELECT event_id, 'k: ' || k AS prompt,
              CASE WHEN k % 5 <> 0 THEN '{"k":' || 2 * k || '}'
                   ELSE '{"text":"no idea about ' || k || '"}' END AS output,
              k % 5 <> 0 AND 2 * k <= 12 AS output_valid
       FROM (SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k FROM events) WHERE k <= 12"""
)
def u4_predict(spark, sf_dir):
    """A stand-in for a model: doubles the number in the prompt, or just talks."""

    def double_it(prompts):
        numbers = [int(prompt.removeprefix("k: ")) for prompt in prompts]
        return [json.dumps({"k": 2 * n}) if n % 5 else f"no idea about {n}" for n in numbers]

    df = table(spark, sf_dir, "events").select("event_id", "props")
    answered = predict(df, "props", small_spec(), double_it, strict=False)
    return answered.select(
        "event_id", "prompt", F.to_json("output").alias("output"), "output_valid"
    )
