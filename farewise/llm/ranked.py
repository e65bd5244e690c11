"""Ranked lexical search: best-first document intervals under range-maximum bounds.

1. Distinct query texts are taken in blocks of bounded size. One scan of the documents per block keeps, per document, its number of terms and
   the tf of the block's terms, written as a table; tasks also leave their sums for N, L and the document frequencies.
2. A task cuts its rows into shards in doc_id order. A shard has one posting list per term with the impact (the term's whole
   contribution to a score) of each document, and over each list a sparse table that gives the place of the greatest impact in any
   range of it by two look-ups.
3. A query starts with the interval of all documents of a shard. The sum of the range maxima of its terms' lists bounds every score in
   an interval. The intervals of the greatest bounds are taken first: one of up to ``LEAF`` documents is scored whole, a longer one
   is split at the document of the greatest single impact, which is scored, and both sides get bounds of their own. Intervals whose bound is below
   the k-th best score so far are dropped; the best so far go on to the task's next shard. Bounds are never below a score and equal bounds
   are looked into, so ties are settled by doc_id and the result is exact.
4. The best of all tasks are merged per query, and queries of one text share the work.

Scores are integers; products stay below 2^63 while tf < 2^32. Null texts have no terms; empty texts and texts of separators have none
either and rank nowhere; such items get no rows. Texts of any length are read whole, in slices of ``SLICE_BYTES``. Every row is a document of
its own: repeated rows and equal ids take a rank each. A null doc_id ranks after equal scores with an id; rows of ``items`` with a null or repeated
item_id are ranked row by row. Empty tables give an empty result. Only the id and text columns are read, so other columns may bear any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import id_text, text_slices
from farewise.session import materialize

K = 20
#: Queries, and bytes of query text, sent to the tasks at once.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 16 << 20
#: Documents and postings of a shard at most (one document at least).
SHARD_DOCS = 8192
SHARD_POSTINGS = 1_000_000
#: Intervals of at most so many documents are scored whole; so many intervals are taken at once.
LEAF = 128
STEP = 16
#: Bytes of one text that are cut into terms at once.
SLICE_BYTES = 1 << 20

#: Digits, letters and everything beyond ASCII are term characters; A-Z are lower-cased, the rest become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))


def terms(text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text in order, slice by slice."""
    raw, lo = text.encode().translate(_TERM_BYTES), 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + slice_bytes) if len(raw) - lo > slice_bytes else -1
        yield raw[lo:hi if hi >= 0 else len(raw)].split()
        lo = hi if hi >= 0 else len(raw)


def _scan(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """Per document with a term of the block its size and packed (term, tf); per task, with null ``terms``, its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = ids.get, max(len(ids), 1)
        n_docs, n_terms, freq = 0, 0, np.zeros(width, np.int64)
        for batch in text_slices(batches):
            sizes, hits, found = [], [], []
            for text in batch.column("text").to_pylist():
                n = m = 0
                for some in terms(text):
                    n += len(some)
                    known = [t for t in map(get, some) if t is not None]
                    found.append(np.array(known, np.int64))
                    m += len(known)
                sizes.append(n)
                hits.append(m)
            sizes = np.array(sizes, np.int64)
            n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), hits) * width
                                + np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            who, term = key // width, key % width
            freq += np.bincount(term, minlength=width)
            at = np.searchsorted(who, np.arange(len(sizes) + 1))
            live = np.flatnonzero(at[1:] > at[:-1])
            packed = [np.stack([term[a:b], tf[a:b]]).astype("<u4").tobytes() for a, b in zip(at[live], at[live + 1])]
            rows = pa.array(live)
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(rows), "n": pa.array(sizes[live]),
                                   "terms": pa.array(packed, pa.binary()), "n_docs": pa.nulls(len(live), pa.int64()),
                                   "freq": pa.nulls(len(live), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "n": pa.array([n_terms], pa.int64()),
                               "terms": pa.nulls(1, pa.binary()), "n_docs": pa.array([n_docs], pa.int64()),
                               "freq": pa.array([freq.tobytes()], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, n_docs long, freq binary")


def _statistics(scanned: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("freq").to_pylist():
                freq = np.frombuffer(raw, np.int64)
                some = np.flatnonzero(freq)
                yield pa.record_batch({"term": pa.array(some), "df": pa.array(freq[some])})

    sums = scanned.filter("terms is null")
    total = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")).first()
    freq = np.zeros(width, np.int64)
    for r in sums.select("freq").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        freq[r.term] = r.df
    return total.n_docs or 0, total.n or 0, freq


def term_weights(n_docs: int, freq: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in freq.tolist()], np.int64)


class Shard:
    """Posting lists of some documents, one after another, under one sparse table of range maxima."""

    def __init__(self, docs: list, sizes: np.ndarray, packed: list[bytes], weight: np.ndarray, n_docs: int, n_terms: int):
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0))
        self.docs = [docs[i] for i in order]
        self.n = len(docs)
        pairs = [np.frombuffer(packed[i], "<u4").reshape(2, -1).astype(np.int64) for i in order]
        term, tf = np.concatenate(pairs, axis=1)
        place = np.repeat(np.arange(self.n), [p.shape[1] for p in pairs])
        m = 75 + 25 * sizes[order].astype(np.int64) * n_docs // n_terms
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
        key = term * self.n + place
        by_term = np.argsort(key, kind="stable")
        self.key, self.place, self.impact = key[by_term], place[by_term], impact[by_term]
        longest = int(np.bincount(term).max())
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1
        # best[j, i]: where the greatest of the 2^j impacts from i on stands; ranges stay within one list when asked
        best = np.empty((int(self.log[longest]) + 1, len(key)), np.int32)
        best[0] = np.arange(len(key))
        for j in range(1, len(best)):
            half = 1 << (j - 1)
            best[j] = best[j - 1]
            left, right = best[j - 1, :-half], best[j - 1, half:]
            best[j, :-half] = np.where(self.impact[left] >= self.impact[right], left, right)
        self.best = best

    def bounds(self, term: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Per interval [lo, hi]: the sum of range maxima, and the document of the greatest single one."""
        base = term * self.n
        a = np.searchsorted(self.key, (lo[:, None] + base).ravel())
        b = np.searchsorted(self.key, (hi[:, None] + base).ravel(), side="right")
        some = np.flatnonzero(b > a)
        value, where = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        level = self.log[b[some] - a[some]]
        left, right = self.best[level, a[some]], self.best[level, b[some] - (1 << level)]
        where[some] = np.where(self.impact[left] >= self.impact[right], left, right)
        value[some] = self.impact[where[some]]
        value = value.reshape(len(lo), -1) * times
        top = value.argmax(axis=1)
        return value.sum(axis=1), self.place[where.reshape(len(lo), -1)[np.arange(len(lo)), top]]

    def scores(self, term: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents of disjoint intervals that hold a term."""
        base = term * self.n
        a = np.searchsorted(self.key, (lo[:, None] + base).ravel())
        n = np.searchsorted(self.key, (hi[:, None] + base).ravel(), side="right") - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        places, which = np.unique(self.place[at], return_inverse=True)
        out = np.zeros(len(places), np.int64)
        np.add.at(out, which, self.impact[at] * np.repeat(np.broadcast_to(times, (len(lo), len(term))).ravel(), n))
        return places, out

    def search(self, term: np.ndarray, times: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The k best ``(-score, no id, doc_id)`` of ``best`` and this shard, in order."""
        lo, hi = np.array([0]), np.array([self.n - 1])
        heap: list[tuple[int, int, int, int]] = []
        while True:
            floor = -best[-1][0] if len(best) == k else 1
            if len(lo):
                bound, split = self.bounds(term, times, lo, hi)
                for x in np.flatnonzero(bound >= floor).tolist():
                    heappush(heap, (-int(bound[x]), int(lo[x]), int(hi[x]), int(split[x])))
            taken = []
            while heap and len(taken) < STEP and -heap[0][0] >= floor:
                taken.append(heappop(heap))
            if not taken:
                return best
            now, later = [], []
            for _, a, b, at in taken:
                if b - a < LEAF:
                    now.append((a, b))
                else:
                    now.append((at, at))
                    later += [(x, y) for x, y in ((a, at - 1), (at + 1, b)) if x <= y]
            places, score = self.scores(term, times, *np.array(now).T)
            good = score >= floor
            found = [(-s, self.docs[p] is None, self.docs[p] or 0) for p, s in zip(places[good].tolist(), score[good].tolist())]
            best = sorted(best + found)[:k]
            lo, hi = np.array(later, np.int64).reshape(-1, 2).T


def _search(scanned: DataFrame, queries: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best of each partition for each query: ``query, doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        docs: list = []
        sizes: list = []
        packed: list[bytes] = []

        def search() -> None:
            shard = Shard(docs, np.array(sizes, np.int64), packed, weight, n_docs, n_terms)
            for i, (_, term, times) in enumerate(queries):
                best[i] = shard.search(term, times, best[i], k)

        held = 0
        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms"))):
                docs.append(doc)
                sizes.append(n)
                packed.append(raw)
                held += len(raw) // 8
                if held >= SHARD_POSTINGS or len(docs) >= SHARD_DOCS:
                    search()
                    docs, sizes, packed, held = [], [], [], 0
        if docs:
            search()
        rows = [(q[0], None if gone else doc, -score) for q, some in zip(queries, best) for score, gone, doc in some]
        yield pa.record_batch({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(
            (("query", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())))})

    return scanned.filter("terms is not null").select("doc_id", "n", "terms").mapInArrow(
        run, "query string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each row of ``items``, scores above 0."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    asked = materialize(items.select(F.col(item_col).cast("long").alias("item_id"), F.sha2(item_text_col, 256).alias("query"),
                                     F.col(item_text_col).alias("text")).filter("text is not null"), "items")
    texts = asked.select("query", "text").dropDuplicates(["query"])
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    blocks, found = max(-(-size.n // block_queries), -(-(size.b or 0) // BLOCK_BYTES)), None
    for b in range(blocks):
        ids: dict[bytes, int] = {}
        queries = []
        for r in texts.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect():  # one block, bounded above
            named = np.array([ids.setdefault(t, len(ids)) for some in terms(r.text) for t in some], np.int64)
            if len(named):
                queries.append((r["query"], *np.unique(named, return_counts=True)))
        if not queries:
            continue
        scanned = materialize(_scan(rows, ids), "postings")
        n_docs, n_terms, freq = _statistics(scanned, len(ids))
        if not n_docs:
            break
        part = materialize(_search(scanned, queries, term_weights(n_docs, freq), n_docs, n_terms, k), "ranked")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.select("item_id", "query").join(top, "query").select("item_id", "rank", "doc_id", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS words FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
i AS (SELECT item_id, term, count(*) AS c
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark)
      GROUP BY ALL),
p AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, term, count(*) AS tf
      FROM (SELECT doc_id, words, unnest(words) AS term FROM d) GROUP BY doc_id, words, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
h AS (SELECT doc_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
      FROM p JOIN f USING (term), s WHERE term IN (SELECT term FROM i)),
r AS (SELECT item_id, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM i JOIN h USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {K}"""
