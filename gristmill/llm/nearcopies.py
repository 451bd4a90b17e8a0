"""Near copies by a multi-index Hamming join of MinHash signatures.

A signature is ``SYMBOLS`` minima of hashed shingles, 16 bits of each. Two sets of similarity 0.75
differ in a symbol with probability 1/4, so beyond ``DISTANCE`` of 64 symbols only about once in
100,000 times; pairs up to that distance are all found. By the pigeonhole principle ``DISTANCE``
errors over ``CHUNKS`` chunks leave some chunk with one error at most. Each chunk is therefore
indexed once per symbol, with that symbol left out: pairs within the distance share a key.

A key may hold thousands of texts, so pairs are not listed. Equal sets are one node from the start.
First every node meets the smallest node of each of its keys, nearest first. Nodes of a key that
are not connected by then, though sizes and signatures allow a link, form families; a family's
texts are compared with each other exactly. Every link is confirmed on the full shingle sets, and
components are found by joins.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import (
    LOWERED,
    MULTIPLIER,
    hash_words,
    lowered_words,
    map_rows,
    mix,
    ship_package,
    staged,
    text_bytes,
    window_hashes,
)
from gristmill.llm.components import components

SHINGLE = 5
SHARE = 75  # least similarity of a link, in hundredths
SYMBOLS = 64
DISTANCE = 32
CHUNKS = DISTANCE // 2 + 1

# Members of a key, and of a family, that meet at once; larger ones are dealt in blocks.
BLOCK = 1_500
FAMILY = 500

# Shingles of fewer sets than this are counted pair by pair; the others so many at a time.
FEW, COLUMNS = 12, 4_096

ORDERS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = lowered_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(SHINGLE, len(words))
    return np.unique(window_hashes(hash_words(words), width, seed=SHINGLE - width))


def signature(held: np.ndarray) -> np.ndarray:
    """Per symbol the low 16 bits of the smallest shingle in an order of its own."""
    least = np.empty(SYMBOLS, dtype=np.uint64)
    for i in range(0, SYMBOLS, 8):
        orders = (held[None, :] ^ ORDERS[i : i + 8, None]) * MULTIPLIER
        orders ^= orders >> np.uint64(32)
        orders *= ORDERS[i : i + 8, None]
        least[i : i + 8] = orders.min(axis=1)
    return (mix(least) >> np.uint64(40)).astype("<u2")


def nibbles(symbols: np.ndarray) -> list[int]:
    """Four bits of each symbol, sixteen to a number."""
    low = (symbols & 15).astype(np.uint64).reshape(-1, 16)
    packed = (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return packed.astype(np.int64).tolist()


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """For an array of signatures, per chunk and symbol left out, the hash of what remains."""
    keys = []
    for c, chunk in enumerate(np.array_split(np.arange(SYMBOLS), CHUNKS)):
        for gone in chunk:
            key = np.full(len(symbols), (c << 8 | int(gone)) + 1, dtype=np.uint64)
            for s in chunk[chunk != gone]:
                key = mix(key * MULTIPLIER + symbols[:, s])
            keys.append(key)
    return np.stack(keys, axis=1).astype(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """Per row the size, digest and signature of its shingle set."""

    def work(rows):
        for doc, data in rows:
            held = shingles(data)
            digest = xxhash.xxh3_128_digest(held.tobytes())
            symbols = signature(held) if len(held) else np.zeros(SYMBOLS, "<u2")
            proof = xxhash.xxh3_64_intdigest((data or b"").translate(LOWERED)) - (1 << 63)
            yield doc, proof, len(held), digest, symbols.tobytes(), nibbles(symbols)

    return map_rows(
        docs, "doc_id long, proof long, n long, digest binary, symbols binary, nibbles array<long>", work
    )


def distance(a: str, b: str) -> Column:
    """In how many symbols two signatures differ in their low four bits: never more than in all."""
    parts = []
    for i in range(SYMBOLS // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        parts.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(add, parts)


def linkable(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SHARE


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that sizes and signatures allow, with their distance."""
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("nibbles").alias(f"s_{x}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    met = both.where(linkable("n_a", "n_b")).withColumn("apart", distance("s_a", "s_b"))
    return met.where(F.col("apart") <= DISTANCE).select("a", "b", "apart")


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` whose full shingle sets are similar enough.

    The texts of the nodes concerned are fetched once; Spark broadcasts the list of nodes where it
    is short and splits the partitions of nodes with many partners.
    """
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = staged(asked.join(nodes.select("node", "proof"), "node"), "asked")
    lowered = docs.select(F.col("doc_id").alias("node"), "data")
    texts = staged(
        lowered.join(named.select("node"), "node").dropDuplicates(["node"]).select("node", "data"), "texts"
    )
    side = lambda x: texts.select(F.col("node").alias(x), F.col("data").alias(f"data_{x}"))
    met = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def work(rows):
        last, of_last = None, None
        for a, b, data_a, data_b in rows:
            if a != last:
                last, of_last = a, shingles(data_a)
            other = shingles(data_b)
            common = len(np.intersect1d(of_last, other, assume_unique=True))
            if common * 100 >= (len(of_last) + len(other) - common) * SHARE:
                yield a, b

    return map_rows(met.select("a", "b", "data_a", "data_b"), "a long, b long", work)


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes in different components."""
    of = lambda x: labels.select(F.col("u").alias(x), F.col("v").alias(f"c_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def dealt(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal the members of each group to pairs of blocks ``i, j``, so that all of them still meet.

    A group of up to ``block`` members is the single pair 0, 0.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return both.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop(
        "blocks", "own", "other"
    )


def groups_of(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row it is connected with."""
    first = np.arange(len(linked))
    while True:
        reached = np.where(linked, first[None, :], len(first)).min(axis=1, initial=len(first))
        now = np.minimum(first, reached)
        now = now[now]
        if (now == first).all():
            return first
        first = now


def near_members(component: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Which members of a key may be linked though they are in different components."""
    found = np.zeros((len(n), len(n)), dtype=bool)
    for i in range(len(n)):
        differ = (symbols != symbols[i]).sum(axis=1)
        fits = np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * SHARE
        found[i] = fits & (differ <= DISTANCE) & (component != component[i])
    return found


def open_families(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges ``u, v`` between nodes that could be linked by size and signature but are not connected.

    Only keys of three and more with several components are looked at, as a key's smallest member
    has met all others. A task reads keys in order and gives, per key, each member's way to the
    others it could be linked with: at most one row per member, never the pairs themselves.
    """
    of = labels.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = members.where("size > 2").join(of, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    open_keys = named.join(mixed.where("x <> y").select("key"), "key")
    full = dealt(open_keys.join(nodes.select("node", "n", "nibbles"), "node"), "key", "size", BLOCK)
    together = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def edges(node, component, n, packed):
        shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
        symbols = ((packed[:, :, None] >> shifts) & np.uint64(15)).astype(np.uint8).reshape(len(node), -1)
        first = groups_of(near_members(component, n, symbols))
        hung = np.flatnonzero(first != np.arange(len(first)))
        return node[hung], node[first[hung]]

    def read(batches):
        held = None
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                now = [
                    np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")], axis=1),
                    *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n")),
                    np.array(batch.column("nibbles").to_pylist(), dtype=np.int64).view(np.uint64),
                ]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None:
                continue
            new = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1)) + 1
            ends = [0, *new.tolist(), *([len(held[0])] if batch is None else [])]
            out = [edges(*(x[a:b] for x in held[1:])) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a > 1]
            # The last key may go on in the next batch.
            held = None if batch is None else [x[ends[-1] :] for x in held]
            if out:
                u, v = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    ship_package(members.sparkSession)
    narrow = together.select("key", "i", "j", "node", "component", "n", "nibbles")
    return narrow.mapInArrow(read, "u long, v long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common.

    Shingles of many sets are counted by products of 0/1 matrices, a few thousand shingles at a
    time; those of few sets by going through their pairs.
    """
    n = len(sets)
    counts = np.zeros((n, n), dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    names, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owners, starts = owner[order], np.cumsum(often) - often
    for c in range(2, FEW):
        rows = owners[starts[often == c][:, None] + np.arange(c)]
        for a in range(c):
            for b in range(a):
                np.add.at(counts, (rows[:, a], rows[:, b]), 1)
                np.add.at(counts, (rows[:, b], rows[:, a]), 1)
    many = np.flatnonzero(often >= FEW)
    column = np.full(len(names), -1)
    column[many] = np.arange(len(many))
    column = column[place]
    for first in range(0, len(many), COLUMNS):
        here = (column >= first) & (column < first + COLUMNS)
        held = np.zeros((n, min(COLUMNS, len(many) - first)), dtype=np.float32)
        held[owner[here], column[here] - first] = 1
        counts += held @ held.T
    return counts


def family_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links ``a, b`` inside the families that some edges make, all members compared exactly.

    A family's texts meet in one task, or block by block where it is large; only as many links
    come out as it takes to connect what is linked.
    """
    named = staged(components(edges), "families")
    all_named = named.unionByName(named.select(F.col("v").alias("u"), "v").distinct())
    sizes = named.groupBy("v").agg((F.count("*") + 1).alias("size"))
    members = all_named.join(sizes, "v").select(F.col("u").alias("node"), F.col("v").alias("family"), "size")
    members = staged(members, "members")
    texts = docs.select(F.col("doc_id").alias("node"), "data").join(members.select("node"), "node")
    texts = staged(texts.dropDuplicates(["node"]).select("node", "data"), "texts")
    placed = dealt(members, "family", "size", FAMILY).join(texts, "node")

    def compare(key, rows):
        sets = [shingles(data) for data in rows.column("data").to_pylist()]
        node = rows.column("node").to_numpy()
        size = np.array([len(s) for s in sets])
        common = shared_counts(sets).astype(np.int64)
        both = size[:, None] + size[None, :] - common
        linked = (common * 100 >= both * SHARE) & (common > 0)
        first = groups_of(linked)
        hung = np.flatnonzero(first != np.arange(len(first)))
        return pa.table({"a": node[first[hung]], "b": node[hung]})

    ship_package(docs.sparkSession)
    return placed.select("family", "i", "j", "node", "data").groupBy("family", "i", "j").applyInArrow(
        compare, "a long, b long"
    )


def nearest(pairs: DataFrame, node: str) -> DataFrame:
    """Per node the nearest of its pairs."""
    window = Window.partitionBy(node).orderBy("apart", "a", "b")
    return pairs.withColumn("rank", F.row_number().over(window)).where("rank = 1").drop("rank")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the size of its shingle set and the component of near copies it is in.

    Words are runs of anything but ASCII white space, A-Z in lower case; the set of a text are its
    distinct runs of five words, or all its words as one run if it has fewer. Texts are linked when
    the sets' intersection is at least 75 hundredths of their union; a component is all that links
    reach. Null and empty texts have an empty set and stand alone. Equal sets are always linked.
    Rows without an identifier are linked through equal sets only; rows that repeat an identifier
    are one node. Other columns are ignored; an empty table gives an empty result.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the smallest identifier in it) and
    ``kept`` (whether that is the row's own).
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))
    rows = staged(described(slim), "sets")
    groups = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("doc_id", "proof")).alias("best"), F.first("n").alias("n"),
        F.first("symbols").alias("symbols"), F.first("nibbles").alias("nibbles"),
    )
    nodes = staged(
        groups.select("digest", F.col("best.doc_id").alias("node"), "best.proof", "n", "symbols", "nibbles"),
        "nodes",
    )
    labels = component_labels(slim, nodes)
    named = nodes.join(labels, F.col("node") == F.col("u"), "left").select(
        "digest", F.coalesce("v", "node").alias("component")
    )
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return rows.join(named, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(alone, F.col("component"), F.col("doc_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce(alone, F.col("component"), F.col("doc_id"))).alias("kept"),
    )


def component_labels(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    def keys_of(rows):
        symbols = np.frombuffer(b"".join(s for _, s in rows), "<u2").reshape(len(rows), SYMBOLS)
        keys = chunk_keys(symbols.astype(np.uint64))
        for (node, _), of_node in zip(rows, keys.tolist(), strict=True):
            for key in of_node:
                yield key, node

    keys = map_rows(nodes.select("node", "symbols"), "key long, node long", keys_of, batch_bytes=1 << 20)
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
    members = staged(keys.join(shared.where("size > 1"), "key"), "members")
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    candidates = staged(near(star.distinct(), nodes), "candidates")
    links = staged(linked(nearest(candidates, "b"), docs, nodes), "links")
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    pairs = staged(apart(candidates, labels), "pairs")
    labels = extended(labels, staged(linked(pairs, docs, nodes), "links"))
    edges = staged(open_families(members, nodes, labels), "edges")
    return extended(labels, staged(family_links(docs, nodes, edges), "links"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links ``a, b``."""
    if links.isEmpty():
        return labels
    return components(labels.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, bool]]:
    """The same by comparing all pairs of word runs; for tests on small tables."""
    sets = {}
    for doc, text in texts.items():
        words = lowered_words((text or "").encode())
        width = min(SHINGLE, len(words))
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    above = {doc: doc for doc in texts}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    holders: dict[tuple, list] = {}
    for doc, held in sets.items():
        for s in held:
            holders.setdefault(s, []).append(doc)
    common: dict[tuple, int] = {}
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if n * 100 >= (len(sets[a]) + len(sets[b]) - n) * SHARE:
            x, y = sorted((root(a), root(b)))
            above[y] = x
    return {doc: (len(held), root(doc), root(doc) == doc) for doc, held in sets.items()}
