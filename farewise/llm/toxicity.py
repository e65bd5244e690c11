"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first ``PREFIXES`` letters, each hashed to 64 bits. With
x the terms a text holds, the machine's logit is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum v_if^2 x_i ]

so a pair of terms (an insult and a group) weighs what its factors say, beyond the two single weights. The machine holds
terms that tell on their own, being more or less usual in toxic rows than in others (``MIN_Z``), and the words of each
pair of which one tells among the rows that hold the other (``PAIR_Z``), however little each tells alone. Terms of fewer
than ``MIN_DOCS`` training rows are left out, and so are all beyond the ``MAX_TERMS`` most telling, so the model has a
fixed bound. Pairs are sought among whole words, not among prefixes. It is fitted in one task with AdaGrad on a bounded sample: all labelled rows with the
fold's share of them, or about ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other rows by a hash of the id if there are more.
The rows' texts are cut into distinct words where they lie; that task holds each word of the sample once, and rows as numbers.

Labels are learned only from rows with crc32(doc_id as text) mod 3 other than 1; scores see the text alone. Null and
empty texts get the score of no terms. Without labelled rows of both kinds every score is 0. A doc_id labelled twice
counts as toxic if any of its labels is; repeated documents are each scored (and learned) as they come.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm import common
from farewise.llm.common import id_text, text_slices

PREFIXES = (4, 5, 6)
MIN_DOCS = 3
#: Standard errors by which a term's share of toxic and of other training rows must differ.
MIN_Z = 4.0
#: The same for one word among the rows that hold another, as the signed root of the likelihood ratio, which stays true at
#: few rows: chance passes it about twice in 10^9 pairs.
PAIR_Z = 6.0
MAX_TERMS = 200_000
MAX_POSITIVE = 4_000
MAX_NEGATIVE = 8_000
FACTORS = 4
EPOCHS = 16
BATCH = 64
RATE = 0.15
DECAY = 2e-5
THRESHOLD = 0.7
SEED = 7
CACHE_WORDS = 500_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def term_hashes(word: str) -> list[int]:
    """Hashes of a word and of its prefixes."""
    parts = [word, *[f"{word[:n]}\x00{n}" for n in PREFIXES if len(word) >= n]]
    return [xxhash.xxh3_64_intdigest(p) for p in parts]


@dataclass
class Machine:
    """A fitted machine: sorted term hashes with their weights and factors."""

    hashes: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * (s @ s - (v * v).sum()))


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def pair_z(held: list[np.ndarray], y: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each word, the most by which it tells among the rows of another, or lets one tell that does not ``alone``.

    ``held`` has each row's distinct words as numbers. Values under ``PAIR_Z`` may be left at 0.
    """
    n_words = len(alone)
    best = np.zeros(n_words)
    order = np.argsort(-y, kind="stable")  # toxic rows first
    sizes = np.array([len(held[i]) for i in order])
    flat = np.concatenate([*[held[i] for i in order], np.zeros(0, np.int32)], dtype=np.int32)
    start = np.r_[0, np.cumsum(sizes)]
    by_word = np.argsort(flat, kind="stable")
    doc = np.repeat(np.arange(len(order), dtype=np.int32), sizes)[by_word]
    del by_word
    edge = np.r_[0, np.cumsum(np.bincount(flat, minlength=n_words))]
    n_toxic = int(y.sum())
    for a in range(n_words):
        mine = doc[edge[a]:edge[a + 1]]
        n, k = len(mine), int(np.searchsorted(mine, n_toxic))
        whole = _xlogx(np.array([n, k, n - k]))
        if 2 * (whole[0] - whole[1] - whole[2]) < PAIR_Z ** 2:  # no split of these rows can tell so much
            continue
        toxic, other = (np.bincount(np.concatenate([flat[start[i]:start[i + 1]] for i in part]), minlength=n_words)
                        for part in (mine[:k], mine[k:]))
        b = np.flatnonzero((toxic + other >= MIN_DOCS) & (toxic + other < n))
        t, o = toxic[b], other[b]
        g = 2 * (_xlogx(t) + _xlogx(o) - _xlogx(t + o) + _xlogx(k - t) + _xlogx(n - k - o) - _xlogx(n - t - o)
                 + whole[0] - whole[1] - whole[2])
        z = np.sqrt(np.maximum(g, 0))
        best[b] = np.maximum(best[b], z)
        best[a] = max(best[a], z[~alone[b]].max(initial=0.0))
    return best


def numbered(docs: Iterable[Iterable[str]]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of all rows, and each row's words as their numbers there."""
    number: dict[str, int] = {}
    held = [np.array([number.setdefault(w, len(number)) for w in d], np.int32) for d in docs]
    return list(number), held


def fit(docs: Iterable[Iterable[str]], labels: list[int], seed: int = SEED) -> Machine | None:
    """Fit a machine to rows of distinct words; None if the labels are all alike."""
    return fit_numbered(*numbered(docs), labels, seed)


def fit_numbered(words: list[str], docs: list[np.ndarray], labels: list[int], seed: int = SEED) -> Machine | None:
    """The same for rows given as numbers of ``words``."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    flat, edge = array("Q"), array("q", [0])
    for word in words:
        flat.extend(term_hashes(word))
        edge.append(len(flat))
    hashes, term = np.unique(np.frombuffer(flat, np.uint64), return_inverse=True)
    term, edge = term.astype(np.int32), np.frombuffer(edge, np.int64)
    del flat

    def terms_of(d: np.ndarray) -> np.ndarray:
        sizes = edge[d + 1] - edge[d]
        return term[np.repeat(edge[d + 1] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]

    counts, toxic, seen = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(words), np.int64)
    for d, t in zip(docs, y):
        seen[d] += 1
        h = np.unique(terms_of(d))
        counts[h] += 1
        toxic[h] += t > 0
    pooled = counts / len(y)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / y.sum() + 1 / (len(y) - y.sum()))) + 1e-12
    z = np.abs(toxic / y.sum() - (counts - toxic) / (len(y) - y.sum())) / spread
    usual = np.flatnonzero(seen >= MIN_DOCS)
    at = term[edge[usual]]  # a word's own hash is the first of its terms
    number = np.full(len(words), -1, np.int32)
    number[usual] = np.arange(len(usual))
    paired = pair_z([n[n >= 0] for n in (number[d] for d in docs)], y, z[at] >= MIN_Z)
    told = np.where(z >= MIN_Z, z, 0)
    told[at] = np.maximum(told[at], np.where(paired >= PAIR_Z, paired, 0))
    told[z >= MIN_Z] += 1e-12  # kept even where MIN_Z is 0
    keep = np.lexsort((hashes, -told))[:MAX_TERMS]
    keep = np.sort(keep[(counts[keep] >= MIN_DOCS) & (told[keep] > 0)])  # by hash, as the terms are
    hashes = hashes[keep]
    number = np.full(len(told), -1, np.int32)
    number[keep] = np.arange(len(keep))
    rows = [np.unique(n[n >= 0]) for n in (number[terms_of(d)] for d in docs)]
    del term, edge, number
    rng = np.random.default_rng(seed)
    n = len(hashes)
    w, v, b = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        for lo in range(0, len(y), BATCH):
            pick = order[lo:lo + BATCH] if lo else (order := rng.permutation(len(y)))[:BATCH]
            terms = np.concatenate([rows[i] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            vt = v[terms]
            s = np.stack([np.bincount(of, vt[:, f], len(pick)) for f in range(FACTORS)], axis=1)
            z = b + np.bincount(of, w[terms] + -0.5 * (vt * vt).sum(axis=1), len(pick)) + 0.5 * (s * s).sum(axis=1)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            u, inv = np.unique(terms, return_inverse=True)
            e = err[of]
            dw = np.bincount(inv, e, len(u)) + DECAY * len(pick) * w[u]
            dv = np.stack([np.bincount(inv, e * (s[of, f] - vt[:, f]), len(u)) for f in range(FACTORS)], axis=1) \
                + DECAY * len(pick) * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += err.sum() ** 2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= 0.2 * RATE * dv / np.sqrt(gv[u])
            b -= RATE * err.sum() / np.sqrt(gb)
    return Machine(hashes, b, w.astype(np.float32), v.astype(np.float32))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> DataFrame:
    """``text, toxic`` of the sampled labelled rows outside the held-out fold."""
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
         .filter("doc_id is not null and toxic is not null").filter(~is_held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    counts = {r.toxic: r["count"] for r in y.groupBy("toxic").count().collect()}  # two rows
    unit = 1 << 20
    share = {t: min(unit, int(unit * most / max(counts.get(t, 0), 1)) + 1)
             for t, most in ((1, max_positive), (0, max_negative))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(unit))
    picked = y.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # at most about max_positive + max_negative ids (12 bytes each): bounded by the sample's parameters
    return id_text(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE,
          max_negative: int = MAX_NEGATIVE) -> Machine | None:
    """Fit on the sample in one task; the model comes back as one row of a bounded size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array(found, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []

        def docs() -> Iterator[list[str]]:
            for batch in text_slices(batches, "words"):
                keys.extend(zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()))
                for x in batch.column("words").to_pylist():
                    yield x.split()

        names, held = numbered(docs())
        order = sorted(range(len(keys)), key=lambda r: (*keys[r], len(held[r])))
        m = fit_numbered(names, [held[r] for r in order], [keys[r][1] for r in order])
        if m is not None:
            yield pa.record_batch({
                "hashes": pa.array([m.hashes.tobytes()], pa.binary()), "bias": pa.array([m.bias], pa.float64()),
                "weights": pa.array([m.weights.tobytes()], pa.binary()),
                "factors": pa.array([m.factors.tobytes()], pa.binary())})

    sample = training_rows(docs, labels, max_positive, max_negative)
    sample = sample.mapInArrow(common.released(cut), "doc_id long, toxic int, words string").repartition(1)
    got = sample.mapInArrow(common.released(run), "hashes binary, bias double, weights binary, factors binary").collect()
    if not got:
        return None
    r = got[0]
    return Machine(np.frombuffer(r.hashes, np.uint64), r.bias, np.frombuffer(r.weights, np.float32),
                   np.frombuffer(r.factors, np.float32).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine | None, *, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, or the columns ``keep`` (none of these names) with ``score, predicted``.

    The machine is broadcast: at most ``MAX_TERMS`` terms of 8 + 4 + 4 * FACTORS bytes.
    """
    names = [id_col, text_col] if keep is None else list(dict.fromkeys([*keep, text_col]))
    rows = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    out = [f for f in rows.schema.fields if keep is None and f.name == id_col or keep is not None and f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine | None = shared.value
        index = {} if m is None else {int(h): i for i, h in enumerate(m.hashes)}
        held: dict[str, tuple[int, ...]] = {}
        for batch in text_slices(batches, text_col):
            scores = []
            for text in batch.column(text_col).to_pylist():
                if m is None:
                    scores.append(0.0)
                    continue
                terms: set[int] = set()
                for w in words_of(text or ""):
                    t = held.get(w)
                    if t is None:
                        if len(held) >= CACHE_WORDS:
                            held.clear()
                        t = held[w] = tuple(index[h] for h in term_hashes(w) if h in index)
                    terms.update(t)
                z = m.logit(np.array(sorted(terms), np.int64))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            cols = {f.name: batch.column(f.name) for f in out}
            yield pa.record_batch({**cols, "score": pa.array(scores, pa.float64())})

    scored = rows.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))) if keep is None else rows
    got = scored.mapInArrow(common.released(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    if keep is not None:
        return got
    return got.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                      "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the learning fold and score every document."""
    return score(docs, train(docs, labels))
