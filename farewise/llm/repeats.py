"""Suffix-array dedup: every byte covered by a 200-byte string that starts anywhere else is removed.

1. Whole texts that are exact copies are found by digest; one of them stands for all in what follows.
2. Each 200-byte window has an anchor, its least-hashed 50-byte gram, so equal windows have equal anchors. Anchors are
   dealt by hash ranges and those that stand once are dropped: their windows cannot repeat.
3. Windows in a row with one anchor are one segment of text. Segments are dealt to shards by anchor. A shard's
   distinct segments are laid end to end and their suffixes sorted by induction (``suffixes``); windows that agree with
   a neighbour in suffix order over all 200 bytes, compared byte by byte, repeat, and so does every window of a segment
   that stands twice. Shards are read in anchor order and sorted piece by piece, so a task holds a few megabytes of
   text; Spark's external sort brings the pieces together from disk. Anchors of more than ``HEAVY_BYTES`` (a passage
   that many documents share, each in its own context) are dealt again: their distinct segments are counted, the windows
   of these are dealt and counted by digest, and positions are joined back to the segments only then.
4. Repeating windows are joined into ranges of bytes per document and cut out.

Matches never cross documents; null and empty texts have no bytes; texts under 200 bytes lose nothing. Repeated rows
are copies of one another. Removed ranges are judged on the input, never on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm import common
from farewise.llm.common import drop_keys, keep_keys, mix64, text_buffers, text_slices
from farewise.llm.suffixes import suffix_order
from farewise.session import materialize

LENGTH = 200
GRAM = 50
#: Anchors counted in one task, on average.
RANGE_ANCHORS = 500_000
#: Text laid end to end for one sort, but for the last anchor's.
SHARD_BYTES = 1 << 19
#: Anchors whose segments and positions take more are dealt by windows.
HEAVY_BYTES = SHARD_BYTES
#: Windows that stand in more distinct segments are joined by broadcast: at most one in so many windows.
COMMON_WINDOWS = 10_000
#: Text scanned at once; the arrays of a scan take about a hundred times as much.
SCAN_BYTES = 1 << 19
#: Long texts are scanned in pieces of this many window starts.
PIECE = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return common.byte_table(), common.powers(common.BASE, n), common.powers(common.BASE_INV, n)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` values in a row."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchor_runs(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(first window start, last window start, anchor hash) of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < length:
        return none, none, none.astype(np.uint64)
    values, up, down = _tables(1 << max(20, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[raw] * up[:n], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    del sums
    bits = np.uint64(int(n).bit_length())
    place = np.arange(len(h), dtype=np.uint64)
    least = _sliding_min((h >> bits << bits) | place, length - gram + 1)
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # anchor of each window start
    sizes = np.diff(off)
    valid = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:len(at)] > 0)
    if not len(starts):
        return none, none, none.astype(np.uint64)
    a = at[starts]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
    return first, last, h[a[new]]


def _pieces(batch: pa.RecordBatch, length: int):
    """(raw bytes, offsets, row of each text, base of each text in its document) of a batch, in bounded pieces."""
    raw, at = text_buffers(batch.column("text"))
    at = at.astype(np.int64)
    if at[-1] - at[0] <= 2 * PIECE:
        yield raw[at[0]:at[-1]], at - at[0], np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        return
    for row in range(batch.num_rows):
        doc = raw[at[row]:at[row + 1]]
        for base in range(0, max(len(doc), 1), PIECE):
            part = doc[base:base + PIECE + length - 1]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([base])


def _range_bits(n_bytes: int, length: int, gram: int) -> int:
    anchors = 2 * n_bytes / (length - gram + 2)
    return max(1, min(16, int(anchors / RANGE_ANCHORS).bit_length()))


def _repeated_anchors(rows: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """``key, tops``: per document, the anchors (their leading bits) that stand more than once; documents without any are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SCAN_BYTES):
            keys = batch.column("key").to_numpy()
            for raw, off, row, _ in _pieces(batch, length):
                first, _, h = anchor_runs(raw, off, length, gram)
                doc = np.searchsorted(off, first, side="right") - 1
                part = (h >> np.uint64(64 - bits)).astype(np.int64)
                low = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((part, doc))
                doc, part, low = doc[order], part[order], low[order]
                cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]) if len(doc) else []
                ends = [*cut[1:], len(doc)]
                yield pa.record_batch({
                    "part": pa.array([int(part[a]) for a in cut], pa.int32()),
                    "key": pa.array([int(keys[row[doc[a]]]) for a in cut], pa.int64()),
                    "low": pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})

    def repeated(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        lows = [np.frombuffer(b, np.uint32) for b in got["low"]]
        _, inverse, count = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        many = np.split(count[inverse] > 1, np.cumsum([len(x) for x in lows])[:-1])
        top = np.uint64(key[0]) << np.uint64(32)
        tops = [(np.unique(x[m]).astype(np.uint64) | top).tobytes() if m.any() else None for x, m in zip(lows, many)]
        return pd.DataFrame({"key": got["key"], "tops": tops}).dropna()

    found = rows.mapInArrow(common.released(scan, _tables), "part int, key long, low binary")
    found = found.groupBy("part").applyInPandas(repeated, "key long, tops binary")
    return found.groupBy("key").agg(F.collect_list("tops").alias("tops"))


def _segments(rows: DataFrame, bits: int, length: int, gram: int) -> DataFrame:
    """``anchor, segment, keys, starts``: text of the windows of each repeated anchor and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SCAN_BYTES):
            keys = batch.column("key").to_numpy()
            tops = [np.sort(np.frombuffer(b"".join(x), np.uint64)) for x in batch.column("tops").to_pylist()]
            found: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
            for raw, off, row, base in _pieces(batch, length):
                first, last, h = anchor_runs(raw, off, length, gram)
                doc = np.searchsorted(off, first, side="right") - 1
                top = h >> np.uint64(32 - bits)
                data = raw.tobytes()
                lo, hi = np.searchsorted(doc, np.arange(len(off) - 1)), np.searchsorted(doc, np.arange(1, len(off)))
                for d in range(len(off) - 1):
                    mine = np.arange(lo[d], hi[d])
                    for i in mine[np.isin(top[mine], tops[row[d]])].tolist():
                        a, b = int(first[i]), int(last[i]) + length
                        at = found.setdefault((int(h[i].astype(np.int64)), data[a:b]), ([], []))
                        at[0].append(int(keys[row[d]]))
                        at[1].append(a - int(off[d]) + int(base[d]))
            yield pa.record_batch({
                "anchor": pa.array([k[0] for k in found], pa.int64()),
                "segment": pa.array([k[1] for k in found], pa.binary()),
                "keys": pa.array([v[0] for v in found.values()], pa.list_(pa.int64())),
                "starts": pa.array([v[1] for v in found.values()], pa.list_(pa.int64()))})

    return rows.mapInArrow(common.released(run, _tables), "anchor long, segment binary, keys array<long>, starts array<long>")


def repeated_windows(segments: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct segment, which of its windows repeat."""
    sizes = np.array([len(s) for s in segments])
    raw = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    t = raw.astype(np.int64) + 1
    t[starts + sizes] = 0
    hit = np.zeros(len(t), bool)
    whole = np.zeros(len(t) + 1, np.int64)
    np.add.at(whole, starts, 1)
    np.add.at(whole, starts + sizes - length + 1, -1)
    window = np.cumsum(whole)[:-1] > 0
    if len(segments) > 1 or int(window.sum()) > 1:
        order = suffix_order(t, 257, length)
        order = order[window[order]]
        a, b = order[:-1], order[1:]
        live = np.arange(len(a))
        for k in range(0, length, 8):  # common prefixes, eight bytes at a time
            p, q = a[live], b[live]
            equal = np.ones(len(live), bool)
            for j in range(k, min(k + 8, length)):
                equal &= raw[p + j] == raw[q + j]
            live = live[equal]
        hit[a[live]] = hit[b[live]] = True
    return [np.ones(n - length + 1, bool) if c > 1 else hit[s:s + n - length + 1]
            for s, n, c in zip(starts.tolist(), sizes.tolist(), copies.tolist())]


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """``key, lo, hi``: ranges of bytes covered by repeating windows, not yet joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, bytes], list[tuple[list[int], list[int]]]] = {}
        size, key = 0, None

        def sort() -> pa.RecordBatch:
            texts = list(shard)
            copies = np.array([sum(len(k) for k, _ in shard[x]) for x in texts])
            out: tuple[list, list, list] = ([], [], [])
            for x, hit in zip(texts, repeated_windows([x[1] for x in texts], copies, length)):
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                gap = np.flatnonzero(np.diff(at) > 1)
                los, his = at[np.r_[0, gap + 1]].tolist(), (at[np.r_[gap, len(at) - 1]] + length).tolist()
                for keys, starts in shard[x]:
                    for k, s in zip(keys, starts):
                        for lo, hi in zip(los, his):
                            out[0].append(k)
                            out[1].append(s + lo)
                            out[2].append(s + hi)
            return pa.record_batch({n: pa.array(v, pa.int64()) for n, v in zip(("key", "lo", "hi"), out)})

        for batch in batches:
            for anchor, text, keys, starts in zip(*(batch.column(c).to_pylist()
                                                    for c in ("anchor", "segment", "keys", "starts"))):
                if anchor != key and size >= SHARD_BYTES:
                    yield sort()
                    shard, size = {}, 0
                key = anchor
                if (anchor, text) not in shard:
                    size += len(text)
                shard.setdefault((anchor, text), []).append((keys, starts))
        if shard:
            yield sort()

    return segments.repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(common.released(run, _tables), "key long, lo long, hi long")


def heavy_anchors(segments: DataFrame, heavy_bytes: int) -> DataFrame:
    """``anchor`` of those whose segments and positions take more than ``heavy_bytes``."""
    size = F.octet_length("segment") + F.size("keys") * 16
    return segments.groupBy("anchor").agg(F.sum(size).alias("n")).filter(F.col("n") > heavy_bytes).select("anchor")


def _dealt_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same as ``_windows``, dealt by windows instead of anchors; equal SHA-256 digests count as equal bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out: tuple[list, list, list] = ([], [], [])
                for i, x in zip(part.column("id").to_pylist(), part.column("segment").to_pylist()):
                    for at in range(len(x) - length + 1):
                        out[0].append(i)
                        out[1].append(at)
                        out[2].append(hashlib.sha256(x[at:at + length]).digest())
                yield pa.record_batch({"id": pa.array(out[0], pa.int64()), "at": pa.array(out[1], pa.int32()),
                                       "window": pa.array(out[2], pa.binary())})

    def hit_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for ats in batch.column("ats").to_pylist():
                at = np.array(ats, np.int64)
                lo, hi = join_ranges(at, at + length)
                spans.append([{"a": a, "b": b} for a, b in zip(lo.tolist(), hi.tolist())])
            yield pa.record_batch({"id": batch.column("id"), "hits": pa.array(
                spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))})

    named = segments.withColumn("segment_sha", F.sha2("segment", 256))
    distinct = named.groupBy("segment_sha").agg(F.first("segment").alias("segment"), F.sum(F.size("keys")).alias("copies"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "heavy-segments")
    windows = materialize(distinct.select("id", "segment").mapInArrow(common.released(cut, _tables), "id long, at int, window binary"),
                          "heavy-windows")
    counts = materialize(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1"), "heavy-counts")
    frequent = F.broadcast(counts.filter(F.col("n") > COMMON_WINDOWS).select("window"))
    rest = windows.join(frequent, "window", "left_anti") \
        .join(counts.filter(F.col("n") <= COMMON_WINDOWS).select("window"), "window")
    found = rest.unionByName(windows.join(frequent, "window")).join(
        distinct.filter("copies > 1").select("id"), "id", "left_anti")
    hits = found.groupBy("id").agg(F.collect_list("at").alias("ats")) \
        .mapInArrow(common.released(hit_ranges, _tables), "id long, hits array<struct<a: long, b: long>>")
    part = distinct.select("id", "segment_sha").join(hits, "id").select("segment_sha", "hits")
    whole = distinct.filter("copies > 1").select("segment_sha", F.array(F.struct(
        F.lit(0).cast("long").alias("a"), F.octet_length("segment").cast("long").alias("b"))).alias("hits"))
    placed = named.select("segment_sha", "keys", "starts").join(part.unionByName(whole), "segment_sha")
    return placed.select("hits", F.explode(F.arrays_zip("keys", "starts")).alias("place")) \
        .select("place", F.explode("hits").alias("hit")) \
        .select(F.col("place.keys").alias("key"), (F.col("place.starts") + F.col("hit.a")).alias("lo"),
                (F.col("place.starts") + F.col("hit.b")).alias("hi"))


def join_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return lo[new], hi[np.r_[new[1:] - 1, len(lo) - 1]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = common.id_text(docs, id_col, text_col)
    return rows.withColumn("digest", F.sha2("text", 256)).withColumn("key", F.xxhash64("doc_id", "digest"))


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 gram: int = GRAM, heavy_bytes: int = HEAVY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(every row's ``doc_id, key, digest, n_bytes, whole``, the ranges ``key, spans`` of the rows not ``whole``).

    ``whole`` marks rows removed in full as copies of one another. ``docs`` is read several times, so pass a table.
    """
    keyed = _keyed(docs, id_col, text_col)
    named = materialize(keyed.select("doc_id", "key", "digest", F.octet_length("text").cast("long").alias("n_bytes")),
                        "digests")
    copies = materialize(named.filter(F.col("n_bytes") >= length).groupBy("digest")
                         .agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1"), "copies")
    spare = named.join(copies, "digest").filter("key <> first").select("key").distinct()
    named = named.join(copies.select("digest", F.lit(True).alias("whole")), "digest", "left") \
        .withColumn("whole", F.coalesce("whole", F.lit(False)))
    total = named.agg(F.sum("n_bytes")).first()[0] or 0
    bits = _range_bits(total, length, gram)
    long = keyed.filter(F.octet_length("text") >= length).select("key", "text")
    single = drop_keys(long, materialize(spare, "spare"), "key")
    anchors = materialize(_repeated_anchors(single, bits, length, gram), "anchors")
    touched = keep_keys(long, anchors.select("key"), "key").join(anchors, "key")
    segments = materialize(_segments(touched, bits, length, gram), "segments")
    heavy = materialize(heavy_anchors(segments, heavy_bytes), "heavy")
    if heavy.isEmpty():
        ranges = _windows(segments, length)
    else:
        ranges = _windows(segments.join(heavy, "anchor", "left_anti"), length) \
            .unionByName(_dealt_windows(segments.join(heavy, "anchor", "left_semi"), length))
    spans = ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return named, materialize(spans, "spans")


def cut_texts(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_removed, n_spans, kept_sha256, kept`` of the rows that lose bytes; ``kept`` drops split characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            raw, at = text_buffers(batch.column("text"))
            out = []
            for i, (key, ranges) in enumerate(zip(batch.column("key").to_pylist(), batch.column("spans").to_pylist())):
                text = raw[at[i]:at[i + 1]]
                lo, hi = join_ranges(np.array([r["lo"] for r in ranges]), np.array([r["hi"] for r in ranges]))
                parts = [text[a:b].tobytes() for a, b in zip(np.r_[0, hi], np.r_[lo, len(text)])]
                kept = b"".join(parts)
                whole = "".join(p.decode("utf-8", "ignore") for p in parts)
                out.append((key, int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], t) for j, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    keyed = _keyed(docs, id_col, text_col).select("key", "text")
    hit = keep_keys(keyed, spans.select("key"), "key").join(spans, "key")
    return hit.mapInArrow(common.released(run, _tables), "key long, n_removed long, n_spans long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    named, spans = find_repeats(docs, id_col=id_col, text_col=text_col, length=length, gram=gram, heavy_bytes=heavy_bytes)
    whole = named.select("key").where("whole").distinct()
    cut = cut_texts(docs, spans.join(whole, "key", "left_anti"), id_col=id_col, text_col=text_col).drop("kept")
    out = named.join(cut.dropDuplicates(["key"]), "key", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeats cut out of its text; all rows and columns stay."""
    named, spans = find_repeats(docs, id_col=id_col, text_col=text_col, length=length, gram=gram)
    whole = materialize(named.filter("whole").select("key").distinct(), "whole")
    cut = cut_texts(docs, spans.join(whole, "key", "left_anti"), id_col=id_col, text_col=text_col)
    new = materialize(cut.select("key", "kept").dropDuplicates(["key"])
                      .unionAll(whole.select("key", F.lit("").alias("kept"))), "kept")
    names = docs.columns
    row_key, kept = (common.free_name(names, c) for c in ("repeats_key", "repeats_kept"))
    key = F.xxhash64(F.col(id_col).cast("long"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.withColumn(row_key, key)
    test = common.may_hold(docs.sparkSession, common.bitmap(new.select(common.cell_of("key").alias("cell"))))
    hit = test(common.cell_of(row_key))
    changed = rows.filter(hit).join(new.withColumnsRenamed({"key": row_key, "kept": kept}), row_key, "left") \
        .withColumn(text_col, F.coalesce(kept, F.col(text_col)))
    return rows.filter(~hit).select(*names).unionByName(changed.select(*names))
