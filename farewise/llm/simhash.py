"""SimHash near-duplicates by a segment-popcount embedding.

1. Every text gets the 64-bit SimHash of its word shingles: a bit is set if it is set in over half of the shingles'
   XXH64 values. Documents of one fingerprint are one point from here on.
2. A fingerprint is cut into segments; the bit counts of the segments are its point on an integer grid. One differing
   bit moves one count by one, so the Manhattan distance of two points is a lower bound of the Hamming distance. Counts are
   kept in unary (``embed``), so that the Manhattan distance is a popcount itself.
3. Range join on the grid: two points within distance r differ on at most r axes. With the axes dealt into groups, all
   groups but r agree, so the two meet in the cell of at least one projection onto that many groups. A point stands
   in one cell per projection.
4. Within a cell a spanning forest of the links is found: the Manhattan distance first, then the exact Hamming distance.
   A pair is passed on only by the first projection in which it meets; what connects two points elsewhere is then connected by
   earlier projections, so components stay whole though no group ever gives all its pairs.
5. Points of a cell that holds more than ``CELL_POINTS`` are dealt again on the next, finer grid of ``LEVELS``: at one
   bit a segment the counts are the bits, and 13 of 16 groups leave at most 4096 fingerprints to a cell. Cells are counted by
   an aggregate, so no task ever receives a hot cell.
6. Components of the links give each document the least doc_id that it reaches.

Null and empty texts (and those of white space alone) have no words: fingerprint zero, linked like any other. Texts of any
length are read whole, in slices of ``SLICE_BYTES``. Repeated rows are copies of one another and give one row each; rows with a
null doc_id take part in links but never name a class (component_id is null if no row of the class has an id). An empty
table gives an empty result. Only ``id_col`` and ``text_col`` are read, so other columns may bear any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.llm.common import drop_keys, id_text, keep_keys, text_slices
from farewise.llm.components import components
from farewise.session import materialize

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Grids from coarse to fine: bits of a segment (1 or 2) and groups of axes; the cell is the projection on groups - radius of them.
LEVELS = ((2, 6), (1, 8), (1, 16))
#: A cell of more points is dealt again on the next grid.
CELL_POINTS = 8192
#: Bytes of one text that are cut into words at once.
SLICE_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_ONES = np.uint64(0x0101010101010101)
_LOW = 0x5555555555555555


def shingle_hashes(raw: bytes, n_words: int = SHINGLE_WORDS, seed: int = SEED,
                   slice_bytes: int = SLICE_BYTES) -> Iterator[list[int]]:
    """XXH64 of the shingles of a text in order, slice by slice; of the whole sequence where it has fewer words."""
    from xxhash import xxh64_intdigest as h

    lo, held, found = 0, [], False
    while lo < len(raw):
        cut = _SPACE.search(raw, lo + slice_bytes) if len(raw) - lo > slice_bytes else None
        hi = cut.start() if cut else len(raw)
        held += raw[lo:hi].lower().split()
        lo = hi
        if len(held) < n_words:
            continue
        found = True
        joined = b" ".join(held)
        size = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[:len(held) - n_words + 1].tolist()
        yield [h(joined[a:b], seed) for a, b in zip(starts, ends[n_words - 1:].tolist())]
        held = held[len(held) - n_words + 1:]
    if held and not found:
        yield [h(b" ".join(held), seed)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes the 64 bits set in over half of them; zero for an empty run."""
    votes = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        # up to 255 hashes add up within a byte, so eight bits are counted in one 64-bit sum
        ends = np.cumsum(sizes[full])
        begins = ends - sizes[full]
        blocks = -(-sizes[full] // 255)
        first = np.cumsum(blocks) - blocks
        at = np.repeat(begins, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
        for j in range(8):
            part = np.add.reduceat((hashes >> np.uint64(j)) & _ONES, at)
            eight = part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            votes[full, j::8] = np.add.reduceat(eight, first, axis=0)
    bits = 2 * votes > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS,
                 seed: int = SEED) -> DataFrame:
    """``doc_id, point`` of every row: the fingerprint as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            parts, sizes = [np.zeros(0, np.uint64)], []
            for text in batch.column("text").to_pylist():
                some = [np.array(x, np.uint64) for x in shingle_hashes(text.encode(), n_words, seed)]
                sizes.append(sum(map(len, some)))
                parts += some
            made = majority(np.concatenate(parts), np.array(sizes, np.int64))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "point": pa.array(made.view(np.int64))})

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, point long")


def embed(x: np.ndarray, width: int) -> np.ndarray:
    """Bit counts of segments of ``width`` (1 or 2) bits in unary: as many bits set at the low end of the segment."""
    if width == 1:
        return x
    low = np.uint64(_LOW)
    high, rest = (x >> np.uint64(1)) & low, x & low
    return high | rest | ((high & rest) << np.uint64(1))


def _embedded(x: Column, width: int) -> Column:
    """``embed`` as an expression on a long."""
    if width == 1:
        return x
    high, rest = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW)), x.bitwiseAND(F.lit(_LOW))
    return high.bitwiseOR(rest).bitwiseOR(F.shiftleft(high.bitwiseAND(rest), 1))


def group_masks(groups: int, width: int) -> list[int]:
    """Bits of each group of axes: whole segments, as even in number as they come."""
    axes = 64 // width
    edges = [width * (axes * g // groups) for g in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _projections(groups: int, width: int, radius: int) -> list[int]:
    masks = group_masks(groups, width)
    return [sum(some) for some in combinations(masks, groups - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def dealt(points: DataFrame, width: int, groups: int, radius: int = RADIUS) -> DataFrame:
    """``cell, turn, point``: every point in its cell of each projection."""
    where = _embedded(F.col("point"), width)
    cells = [F.struct(F.xxhash64(F.lit(i), where.bitwiseAND(F.lit(_signed(m)))).alias("cell"), F.lit(i).alias("turn"))
             for i, m in enumerate(_projections(groups, width, radius))]
    return points.select("point", F.explode(F.array(*cells)).alias("c")).select("c.cell", "c.turn", "point")


def forest(x: np.ndarray, at: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that join all points of a cell which link, directly or by others of the cell."""
    out, left = [], np.arange(len(x))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(at[left] ^ at[i]) <= radius  # Manhattan distance: never above the Hamming distance
            if near.any():
                some = np.flatnonzero(near)
                near[some] = np.bitwise_count(x[left[some]] ^ x[i]) <= radius
                hit = left[near].tolist()
                out += [(i, j) for j in hit]
                queue += hit
                left = left[~near]
    return out


def cell_links(cells: DataFrame, width: int, groups: int, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links that connect what each cell connects, every pair from its first common projection only."""
    masks = np.array(group_masks(groups, width), np.uint64)
    turns = {some: i for i, some in enumerate(combinations(range(groups), groups - radius))}

    def links(turn: np.ndarray, x: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        us, vs, lo = [], [], 0
        at = embed(x, width)
        for hi in ends.tolist():
            if hi - lo > 1:
                for i, j in forest(x[lo:hi], at[lo:hi], radius):
                    same = np.flatnonzero((masks & (at[lo + i] ^ at[lo + j])) == 0)
                    if turns[tuple(same[:groups - radius].tolist())] == turn[lo]:
                        us.append(lo + i)
                        vs.append(lo + j)
            lo = hi
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "turn", "point")], axis=1)
                held = np.concatenate([held, new])
            if not len(held):
                continue
            last = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            ends = last if batch is not None else np.append(last, len(held))
            if not len(ends):
                continue
            done, held = held[:ends[-1]], held[ends[-1]:]
            us, vs = links(done[:, 1], done[:, 2].astype(np.uint64), ends)
            yield pa.record_batch({"u": pa.array(done[us, 2], pa.int64()), "v": pa.array(done[vs, 2], pa.int64())})

    spread = cells.repartition("cell").sortWithinPartitions("cell", "turn", "point")
    return spread.mapInArrow(run, "u long, v long")


def range_join(points: DataFrame, *, radius: int = RADIUS, levels: tuple = LEVELS,
               cell_points: int = CELL_POINTS) -> DataFrame:
    """``u, v``: links whose components are those of all pairs of the distinct longs ``point`` within ``radius`` bits.

    ``points`` is read several times, so pass a written table.
    """
    found = None
    for i, (width, groups) in enumerate(levels):
        cells, more = dealt(points, width, groups, radius), None
        if i + 1 < len(levels):
            hot = cells.groupBy("cell").count().filter(F.col("count") > cell_points).select("cell")
            hot = materialize(hot, "hot-cells")
            if not hot.isEmpty():
                more = materialize(keep_keys(cells, hot, "cell").select("point").distinct(), "hot-points")
                cells = drop_keys(cells, hot, "cell")
        new = materialize(cell_links(cells, width, groups, radius), "links")
        found = new if found is None else found.unionAll(new)
        if more is None:
            return found
        points = more
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    levels: tuple = LEVELS, cell_points: int = CELL_POINTS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    named = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    points = materialize(named.groupBy("point").agg(F.min("doc_id").alias("least")), "points")
    links = range_join(points.select("point"), radius=radius, levels=levels, cell_points=cell_points)
    labels = components(links).withColumnRenamed("node", "point")
    classes = points.join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    best = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(best, "label").select("point", "component_id"), "classes")
    return named.join(classes, "point").select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")
