"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its words and of the stems of longer words, each hashed to one of 2**22
numbers; stems carry what inflected languages spread over many endings. The machine adds a weight per
term and, for each pair of terms in a text, the product of their factors: an insult that counts
only beside the mention of a group gets its weight from the pair. It is fitted on a bounded sample
of labelled rows; terms whose presence says nothing about the label in that sample are left out,
so what is sent to the tasks has a fixed bound. Every text is then scored whole, in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import (
    RESULT_ROWS,
    Remembered,
    alphanumeric_words,
    kept_rows,
    map_rows,
    staged,
    starts_of,
    text_bytes,
)

HASH_BITS = 22
STEMS = (4, 5)  # bytes of a longer word that make a stem
TRAIN_ROWS = 16_000  # labelled rows in the sample
TERMS = 1_024  # terms of the machine, at most
LEAST_ROWS = 8  # rows of the sample that hold a term of the machine, at least
LEAST_CHI2 = 30.0  # and how far its presence and the label depend on each other, at least
FACTORS = 6
EPOCHS = 30
BATCH = 256
RATE = 0.1
DECAY = 1e-5
MISSING = 0.5  # share of a text's terms hidden in each step of the fit
SEED = 7


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def hashed_terms(word: bytes) -> bytes:
    """The word and its stems, as so many 32-bit numbers for every word (a lacking stem repeats)."""
    whole = xxhash.xxh3_64_intdigest(word) >> (64 - HASH_BITS)
    stems = [
        xxhash.xxh3_64_intdigest(word[:n], seed=n) >> (64 - HASH_BITS) if len(word) > n else whole
        for n in STEMS
    ]
    return np.array([whole, *stems], dtype=np.uint32).tobytes()


WORD_TERMS = Remembered(hashed_terms)


def distinct_terms(texts: list[bytes | None], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the distinct terms of each text, or of those among some (by term), in order.

    Text by text, as the words and repeated terms of a whole block take a multiple of its bytes.
    """
    held = []
    for data in texts:
        term = np.frombuffer(b"".join(map(WORD_TERMS.__getitem__, alphanumeric_words(data))), np.uint32)
        held.append(np.unique(term if among is None else term[among[term]]))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in held])
    return text, np.concatenate([np.zeros(0, np.uint32), *held])


def known_terms(names: np.ndarray) -> np.ndarray:
    """Whether a term is one of some, by term."""
    known = np.zeros(1 << HASH_BITS, dtype=bool)
    known[names] = True
    return known


@dataclass
class Machine:
    """Terms in ascending order, with their weights and factors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, text: np.ndarray, term: np.ndarray, texts: int):
        """Scores before the logistic function, and each text's sum of factors."""
        linear = np.bincount(text, self.weights[term], texts)
        rows = self.factors[term]
        sums = np.stack([np.bincount(text, c, texts) for c in rows.T], axis=1)
        squares = np.bincount(text, (rows**2).sum(axis=1), texts)
        return self.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        text, term = distinct_terms(texts, known_terms(self.terms))
        return logistic(self.raw(text, np.searchsorted(self.terms, term), len(texts))[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(names: np.ndarray, cells: list[np.ndarray], labels: list[int]) -> Machine:
    """Fit by AdaGrad on small batches; ``cells`` are each row's terms as places in ``names``.

    Without labels of both kinds, or terms that tell them apart, the score is the label's share.
    """
    label = np.array(labels, dtype=float)
    share = label.mean() if len(label) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    rng = np.random.default_rng(SEED)
    factors = rng.normal(0, 0.05, (len(names), FACTORS))
    machine = Machine(names, bias, np.zeros(len(names)), factors)
    if not len(names):
        return machine
    at = np.concatenate(cells)
    starts = starts_of(np.array([len(c) for c in cells]))
    past_w, past_v, past_b = np.full(len(names), 1e-6), np.full(factors.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            lengths = starts[batch + 1] - starts[batch]
            places = np.repeat(starts[batch] - starts_of(lengths)[:-1], lengths) + np.arange(lengths.sum())
            # Terms missing at random teach each term to speak without its usual company.
            seen = rng.random(len(places)) >= MISSING
            text, used = np.repeat(np.arange(len(batch)), lengths)[seen], at[places[seen]]
            raw, sums = machine.raw(text, used, len(batch))
            error = (logistic(raw) - label[batch]) / len(batch)
            slope = error[text]
            gw = np.bincount(used, slope, len(names)) + DECAY * machine.weights
            each = slope[:, None] * (sums[text] - machine.factors[used])
            gv = np.stack([np.bincount(used, c, len(names)) for c in each.T], axis=1)
            gv += DECAY * machine.factors
            gb = error.sum()
            past_w += gw**2
            past_v += gv**2
            past_b += gb**2
            machine.weights -= RATE * gw / np.sqrt(past_w)
            machine.factors -= RATE * gv / np.sqrt(past_v)
            machine.bias -= RATE * gb / np.sqrt(past_b)
    return machine


def chosen_terms(sample: DataFrame) -> np.ndarray:
    """Terms of a sample whose presence depends on the label, the strongest by chi-squared; sorted.

    Tasks count terms block by block; what reaches the driver is the chosen terms alone.
    """

    def count(held):
        text, term = distinct_terms([data for _, _, data in held])
        names, at = np.unique(term, return_inverse=True)
        labels = np.array([label for _, label, _ in held], dtype=float)[text]
        counts = names, np.bincount(at), np.bincount(at, labels)
        for i in range(0, len(names), RESULT_ROWS):
            yield from zip(*(x[i : i + RESULT_ROWS].tolist() for x in counts), strict=True)

    n, positive = sample.agg(F.count("*"), F.sum("label")).first()
    if not positive or positive == n:
        return np.zeros(0, np.int64)
    counted = map_rows(sample, "term long, seen double, both double", count, 1 << 22)
    seen, both = F.sum("seen").alias("seen"), F.sum("both").alias("both")
    counted = counted.groupBy("term").agg(seen, both).where(F.col("seen") >= LEAST_ROWS)
    apart = F.pow(F.col("both") * n - F.col("seen") * positive, 2) * n
    spread = F.col("seen") * (F.lit(n) - F.col("seen")) * (positive * (n - positive))
    chi2 = F.when(spread > 0, apart / spread)
    best = counted.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    best = best.orderBy(F.desc("chi2"), "term").limit(TERMS)
    return np.array(sorted(r["term"] for r in best.select("term").collect()), dtype=np.int64)


def learnt(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``train_rows`` labelled rows, those with the smallest hashed identifiers.

    Held-out rows, rows without a label and labels without a document teach nothing. The driver
    gets the chosen terms of each row of the sample, never its text.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select(
        F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("label")
    )
    wanted = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
    rows = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))
    sample = staged(rows.select("doc_id", "label", "data"), "sample")
    names = chosen_terms(sample)

    def use(held):
        text, term = distinct_terms([data for _, _, data in held], known_terms(names))
        at = np.searchsorted(names, term).astype("<i4")
        ends = np.searchsorted(text, np.arange(len(held) + 1))
        for (doc, label, _), i, j in zip(held, ends[:-1], ends[1:], strict=True):
            yield doc, label, at[i:j].tobytes()

    taught = sorted(tuple(r) for r in map_rows(sample, "doc_id long, label int, terms binary", use).collect())
    return fitted(names, [np.frombuffer(t, "<i4") for _, _, t in taught], [label for _, label, _ in taught])


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id`` and ``score``; null counts as the empty text, every text is read whole."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def work(held):
        scores = sent.value.scores([data for _, data in held])
        return zip([doc for doc, _ in held], scores.tolist(), strict=True)

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))
    return map_rows(slim, "doc_id long, score double", work)


def without_toxic(docs: DataFrame, machine: Machine, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text scores below a limit, with all their columns; scored and dropped in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return kept_rows(docs, lambda texts: sent.value.scores(texts) < limit, text)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document; labels, language, source and identifier are no inputs of a score.

    Returns ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), one row
    per row of the input. An empty table gives an empty result; without usable labels the score is
    the same for all.
    """
    rows = scored(docs, learnt(docs, labels, train_rows))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
