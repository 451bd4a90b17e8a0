"""The trie of conversation prefixes.

A prefix is known by a digest of its turns that can be added up piecewise, so that a conversation
of any length is digested over several tasks. A count-min screen over all digests tells which
prefixes only one conversation can have: these tails are emitted where they are. Only prefixes that
may be shared are grouped exactly.

Every node is owned by its smallest member. Going down a conversation the members become fewer, so
a conversation owns a last stretch of its path, and these stretches part the trie into disjoint
lines. Counts of children, leaves and words below a node are then sums over its members: each knows
where its own stretch begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import blank_words, map_rows, ship_package, staged
from gristmill.llm.screens import screen

# Digests are sums of turn digests times powers of BASE, modulo two primes; TURNS of another conversation
# at most stand before a conversation's own.
PRIMES = (2**61 - 1, 2**61 - 31)
BASE = 0x1B873593CC9E2D51 % PRIMES[1]
TURNS = 4
FAMILY = 20

# Rows a key may have before its table row is sent to all tasks: a share of all rows, so that such keys
# are at most this many.
HOT_KEYS = 2_000

# Bytes of listed members that travel in one row.
LIST_BYTES = 1 << 18

NOBODY = hashlib.sha256(b"").hexdigest()


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Join rows to a staged table with one row a key; ``weight`` tells how many rows a key has.

    Keys with more than one in ``HOT_KEYS`` of all rows are at most that many and go to every task; rows
    of the others are shuffled.
    """
    hot = table.where(F.col(weight) * HOT_KEYS > total)
    cold = table.where(F.col(weight) * HOT_KEYS <= total)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    )


def digested(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, words``: two numbers that stand for role and text, and the words of the text."""

    def work(rows: list) -> Iterator[tuple]:
        for conv_id, turn, role, text in rows:
            role, text = role or b"", text or b""
            digest = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
            a, b = (1 + int.from_bytes(digest[8 * i : 8 * i + 8], "little") % (p - 1) for i, p in enumerate(PRIMES))
            yield conv_id, turn, a, b, len(blank_words(text))

    read = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary")
    )
    return map_rows(read, "conv_id long, turn long, a long, b long, words long", work)


RUN = "conv_id long, part int, pos long, pa long, pb long, pw long, a long, b long, w long, edge boolean"


def summed(turns: DataFrame) -> DataFrame:
    """Position of each turn and sums up to it, ``a, b, w``, and up to the one before, ``pa, pb, pw``.

    Turns are dealt out by range, so a long conversation lies in several tasks. Each sums what it has;
    a table of the last sums of each task, at most two rows a task, then tells what came before.
    """
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("a"), F.asc("b")]
    dealt = staged(turns, "turns").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, at = TaskContext.get().partitionId(), None, None
        first = True
        for batch in batches:
            out = []
            for conv_id, _, a, b, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != at:
                    # A row known to end its conversation's run; the first and the last run may go on elsewhere.
                    if held is not None:
                        out.append((*held, first))
                        first = False
                    at, pos, x, y, w, power = conv_id, 0, 0, 0, 0, (1, 1)
                elif held is not None:
                    out.append((*held, False))
                power = (power[0] * BASE % PRIMES[0], power[1] * BASE % PRIMES[1])
                before = (x, y, w)
                pos, x, y = pos + 1, (x + a * power[0]) % PRIMES[0], (y + b * power[1]) % PRIMES[1]
                w += words
                held = (conv_id, part, pos, *before, x, y, w)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema=ARROW)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, (*held, True), strict=True))], schema=ARROW)

    NAMES = [p.split()[0] for p in RUN.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    ARROW = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in RUN.split(", ")])
    parts = staged(dealt.mapInArrow(run, RUN), "runs")
    ends = parts.where("edge").select("part", "conv_id", "pos", "a", "b", "w").orderBy("part", "conv_id").collect()
    carried, sums = {}, {}
    for row in ends:
        if row["conv_id"] in sums:
            carried[(row["part"], row["conv_id"])] = sums[row["conv_id"]]
        n, a, b, w = sums.get(row["conv_id"], (0, 0, 0, 0))
        sums = {
            row["conv_id"]: (
                n + row["pos"],
                (a + row["a"] * pow(BASE, n, PRIMES[0])) % PRIMES[0],
                (b + row["b"] * pow(BASE, n, PRIMES[1])) % PRIMES[1],
                w + row["w"],
            )
        }

    def shifted(rows: list) -> Iterator[tuple]:
        for conv_id, part, pos, *own in rows:
            if before := carried.get((part, conv_id)):
                n, a, b, w = before
                up = [pow(BASE, n, p) for p in PRIMES]
                own = [
                    (a + own[0] * up[0]) % PRIMES[0], (b + own[1] * up[1]) % PRIMES[1], w + own[2],
                    (a + own[3] * up[0]) % PRIMES[0], (b + own[4] * up[1]) % PRIMES[1], w + own[5],
                ]
                pos += n
            yield (conv_id, pos, *own)

    plain = parts.select("conv_id", "part", "pos", "pa", "pb", "pw", "a", "b", "w")
    if not carried:
        return plain.drop("part")
    return staged(
        map_rows(plain, "conv_id long, pos long, pa long, pb long, pw long, a long, b long, w long", shifted), "turns"
    )


PATH = "conv_id long, d long, pa long, pb long, pw long, a long, b long, w long, length long"


def paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations, rebuilt: ``conv_id, length`` and a row for every prefix of every one.

    The first turns of the head of its family of ``FAMILY`` take the place of a conversation's own; how
    many depends on its name. The sums of what follows are moved from where they stood to where they go.
    """
    heads = F.sort_array(F.collect_list(F.when(F.col("pos") < TURNS, F.struct("pos", "a", "b", "w"))))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), heads.alias("heads"))
    convs = staged(convs, "conversations")
    names = convs.select(
        "*", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS).alias("h"),
    )
    base = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("theirs"))
    theirs = F.greatest(F.lit(0), F.coalesce(F.size("theirs"), F.lit(0))).cast("long")
    built = (
        names.join(base, "base", "left")
        .withColumn("m", F.least("h", theirs))
        .withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
        .withColumn("front", F.when(F.col("m") > 0, F.slice("theirs", 1, F.col("m").cast("int"))))
        # Sums at the end of what was put in front, and at the end of what it replaced.
        .withColumn("top", F.expr("case when m > 0 then element_at(front, cast(m as int)) end"))
        .withColumn("skip", F.expr("case when h > 0 and n > h then element_at(heads, cast(h as int)) end"))
    )
    built = staged(
        built.select(
            "conv_id", "n", "h", "m", "length", "front",
            *(F.coalesce(F.col(f"top.{x}"), F.lit(0).cast("long")).alias(f"t{x}") for x in "abw"),
            *(F.coalesce(F.col(f"skip.{x}"), F.lit(0).cast("long")).alias(f"s{x}") for x in "abw"),
        ),
        "rebuilt",
    )
    none = F.lit(0).cast("long")
    prior = lambda x: F.coalesce(F.expr(f"case when i > 0 then front[i - 1].{x} end"), none)
    fronts = built.select("conv_id", "length", "front", F.posexplode("front").alias("i", "at")).select(
        "conv_id", F.col("at.pos").alias("d"), *(prior(x).alias(f"p{x}") for x in "abw"), "at.a", "at.b", "at.w", "length"
    )

    def moved(rows: list) -> Iterator[tuple]:
        scale = {}
        for conv_id, pos, pa_, pb, pw, a, b, w, h, m, length, ta, tb, tw, sa, sb, sw in rows:
            e = m - h
            if e not in scale:
                scale[e] = [pow(BASE, e, p) for p in PRIMES]
            x, y = scale[e]
            yield (
                conv_id, pos + e,
                (ta + (pa_ - sa) * x) % PRIMES[0], (tb + (pb - sb) * y) % PRIMES[1], tw + pw - sw,
                (ta + (a - sa) * x) % PRIMES[0], (tb + (b - sb) * y) % PRIMES[1], tw + w - sw, length,
            )

    own = looked_up(turns, built.drop("front"), ["conv_id"], "n", turns.count()).where("pos > h")
    own = own.select(*"conv_id pos pa pb pw a b w h m length ta tb tw sa sb sw".split())
    rows = fronts.unionByName(map_rows(own, PATH, moved))
    return built.select("conv_id", "length"), staged(rows.withColumn("key", F.xxhash64("a", "b")), "paths")


def ended(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` of listed conversations ``a, b, conv_id``, in ascending order.

    Members are put in order by range, so a list may lie in several tasks; each writes its stretch as
    text. The stretches of a node are then hashed one after the other, never held together.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, None, [], 0

        def stretch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"a": at[0], "b": at[1], "first": first, "listed": b",".join(held)}], schema=kinds
            )

        for batch in batches:
            for a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != at or size >= LIST_BYTES:
                    if held:
                        yield stretch()
                    at, first, held, size = (a, b), conv_id, [], 0
                held.append(b"%d" % conv_id)
                size += len(held[-1]) + 1
        if held:
            yield stretch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for a, b, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) == at:
                    digest.update(b"," + text)
                    continue
                if at is not None:
                    out.append({"a": at[0], "b": at[1], "ends_sha256": digest.hexdigest()})
                at, digest = (a, b), hashlib.sha256(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=named)
        if at is not None:
            yield pa.RecordBatch.from_pylist(
                [{"a": at[0], "b": at[1], "ends_sha256": digest.hexdigest()}], schema=named
            )

    whole = pa.int64()
    kinds = pa.schema([("a", whole), ("b", whole), ("first", whole), ("listed", pa.binary())])
    named = pa.schema([("a", whole), ("b", whole), ("ends_sha256", pa.string())])
    ship_package(ends.sparkSession)
    order = ["a", "b", "conv_id"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    stretches = dealt.mapInArrow(listed, "a long, b long, first long, listed binary")
    met = stretches.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return met.mapInArrow(hashed, "a long, b long, ends_sha256 string")


def screened(rows: DataFrame) -> DataFrame:
    """Path rows with ``shared``: whether another conversation may have the same prefix."""
    n = rows.count()
    sketch = rows.sparkSession.sparkContext.broadcast(screen(rows, "key", n, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy().view(np.uint64)
            yield batch.append_column("shared", pa.array(sketch.value.passes(keys)))

    ship_package(rows.sparkSession)
    return staged(rows.mapInArrow(run, f"{PATH}, key long, shared boolean"), "screened")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are ignored. Turns come in the
    order of ``turn``, null first; of equal turns a digest of role and text decides, and repeated rows
    are turns of their own. Null role or text is empty. Rows without ``conv_id`` belong to no conversation
    and are left out; without any conversation there is no node. Returns ``conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    convs, rows = paths(summed(digested(conversations)))
    rows = screened(rows)
    tails, maybe = rows.where("not shared"), rows.where("shared")

    nodes = staged(
        maybe.groupBy("a", "b").agg(
            F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"),
            F.sum((F.col("d") == F.col("length")).cast("long")).alias("n_ends"),
        ),
        "nodes",
    )
    known = staged(looked_up(maybe, nodes, ["a", "b"], "n_convs", maybe.count()), "known")

    # Where the stretch of each conversation begins, and who owns what lies above it.
    mine = F.col("owner") == F.col("conv_id")
    leaf = mine & (F.col("d") == F.col("length")) & (F.col("n_ends") == F.col("n_convs"))
    plain = ["conv_id", "d", "length", "pw", "w"]
    steps = known.select(*plain, "owner", mine.alias("mine"), leaf.alias("leaf")).unionByName(
        tails.select(
            *plain, F.col("conv_id").alias("owner"), F.lit(True).alias("mine"), (F.col("d") == F.col("length")).alias("leaf")
        )
    )
    lines = staged(
        steps.groupBy("conv_id").agg(
            F.count("*").alias("rows"),
            F.max("w").alias("all_words"),
            F.min(F.when(F.col("mine"), F.col("d"))).alias("begin"),
            F.min_by(F.when(F.col("mine"), F.col("pw")), F.when(F.col("mine"), F.col("d"))).alias("above"),
            F.max_by(F.when(~F.col("mine"), F.col("owner")), F.when(~F.col("mine"), F.col("d"))).alias("upper"),
            F.max("leaf").alias("leaf"),
        ).withColumn("above", F.coalesce("above", "all_words")),
        "lines",
    )
    top = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).first()
    root_owner = F.lit(top["owner"]).cast("long")

    members = looked_up(
        known.select("a", "b", "d", "conv_id", "pw", "length", "owner", "n_convs", "n_ends"),
        lines.select("conv_id", "rows", "begin", "above", "upper", "leaf"), ["conv_id"], "rows", rows.count(),
    )
    under = F.col("begin").isNull() | (F.col("begin") > F.col("d"))
    owner = F.col("conv_id") == F.col("owner")
    ends = ended(
        known.where("d = length").select("a", "b", "conv_id").unionByName(
            convs.where("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
        )
    )
    ends = staged(ends, "ends")
    exact = (
        members.groupBy("a", "b").agg(
            F.first("owner").alias("conv_id"),
            F.first("d").alias("depth"),
            F.max(F.when(owner, F.when(F.col("begin") < F.col("d"), F.col("conv_id"))
                         .otherwise(F.coalesce("upper", root_owner)))).alias("parent_conv_id"),
            F.first("n_convs").alias("n_convs"),
            (F.count_if(F.col("begin") == F.col("d") + 1)
             + F.max(F.when(owner, (F.col("length") > F.col("d")).cast("long")).otherwise(0))).alias("n_children"),
            F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
            F.sum(F.when(under, F.col("above") - F.col("pw")).otherwise(0)).alias("saved_tokens"),
        )
        .join(ends, ["a", "b"], "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
        .drop("a", "b")
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = looked_up(
        tails.select("conv_id", "d", "length"), lines.select("conv_id", "rows", "begin", "upper"),
        ["conv_id"], "rows", rows.count(),
    ).select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("begin") < F.col("d"), F.col("conv_id")).otherwise(F.coalesce("upper", root_owner))
        .alias("parent_conv_id"),
        one.alias("n_convs"), (F.col("d") < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("d") < F.col("length"), F.lit(NOBODY))
        .otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"),
    )
    return exact.unionByName(alone).unionByName(root(conversations.sparkSession, lines, ends, top))


def root(spark: SparkSession, lines: DataFrame, ends: DataFrame, top) -> DataFrame:
    """The root's row, if there is any conversation."""
    found = ends.where("a = 0 and b = 0").first()
    zero = F.lit(0).cast("long")
    total = lines.agg(
        F.count_if(F.col("begin") == 1).alias("n_children"),
        # With no turn at all the root is a leaf itself.
        F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce(F.sum("above"), zero).alias("saved_tokens"),
    )
    return total.where(F.lit(top["n"] > 0)).select(
        F.lit(top["owner"]).cast("long").alias("conv_id"), zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top["n"]).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens",
        F.lit(found["ends_sha256"] if found else NOBODY).alias("ends_sha256"),
    )


SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id AS c, list(struct_pack(role := role, words :=
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), text := text) ORDER BY pos) AS turns,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
        string_split(conv_id::VARCHAR, ''),
        lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda y: -1::BIGINT))))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
        WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END) AS crc
  FROM placed GROUP BY conv_id),
shortened AS (SELECT *, xor(crc, 4294967295::BIGINT) % {TURNS} AS h FROM own),
rebuilt AS (
  SELECT o.c, list_concat(coalesce(b.turns[1 : o.h], []), o.turns[o.h + 1 :]) AS turns
  FROM shortened o LEFT JOIN own b ON b.c = o.c - o.c % {FAMILY}),
prefixes AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT turns[1 : d] AS node, d, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(turns) = d), '') AS ends
  FROM prefixes GROUP BY turns[1 : d], d),
children AS (SELECT node[1 : d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY node[1 : d - 1]),
full_nodes AS (
  SELECT o.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id,
    CASE WHEN o.d > 0 THEN (o.n_convs - 1) * o.node[o.d].words ELSE 0 END AS saved
  FROM nodes o LEFT JOIN children k ON k.node = o.node
  LEFT JOIN nodes p ON p.d = o.d - 1 AND p.node = o.node[1 : o.d - 1]),
above AS (SELECT node, saved, n_children, unnest(range(0, d + 1)) AS up FROM full_nodes),
below AS (
  SELECT node[1 : up] AS node, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM above GROUP BY node[1 : up])
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes JOIN below ON below.node = full_nodes.node
"""
