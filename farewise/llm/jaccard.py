"""N-gram Jaccard join: documents linked when their sets of word shingles overlap enough.

1. Every text becomes its sorted set of 64-bit shingle hashes. Texts of equal sets are one set from here on,
   named by a 64-bit hash of all its members.
2. Shingles are put in one order for all sets: those found common in a first count last, then by hash. Two sets
   that link share a shingle among the first ``n - ceil(t n) + 1`` of each. The prefixes are dealt by hash
   ranges; a range's task keeps the lists of sets that share a prefix shingle, each distinct list once.
3. Lists are cut into size-banded tiles: a set stands in the tile of its own band of sizes and, as the smaller
   side, in the next one; sets further apart in size cannot link. Within a tile hashed bitmap signatures (one
   bit flipped per shingle) bound the overlap from above: |x & y| <= (|x| + |y| - bits that differ) / 2. A tile passes on a
   spanning forest of the pairs within the bound, never all pairs of a group. Sets of one group share many lists, so
   each set first stands in its largest tile alone; the tiles of all lists then pass on only pairs that join what those
   forests left apart. A set that has no other within the bound in a tile leaves this tile for good.
4. The pairs are decided by exact intersection of the sorted arrays. Where pairs of a forest fail, the tiles of several
   classes are read again with wider signatures. A tile with few pairs between its classes within the bound passes on
   all of those that share no earlier list and is done, another one a forest between classes, by other pairs each time, while that links much; at last every
   pair within the bound whose sets are still in different classes is decided, so no link is lost.
5. Components of the links give each document the least doc_id of its class.

Null and empty texts have no shingles and link with nothing; repeated rows are copies of one another. Two distinct sets share a
name, or two shingles a hash, with odds of about (their number)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm import common
from farewise.llm.common import FILTER_BITS, id_text, mix64, text_buffers, text_slices
from farewise.llm.components import components, merge_components
from farewise.session import materialize

SHINGLE_WORDS = 5
PERCENT = 75
#: Prefix shingles of more sets than this are common and go last in the order.
COMMON = 32
MAX_SIGNATURE_BITS = 4096
#: Signatures are so many times as wide after the first forest, for a bound close to the overlap itself.
LAST_SCALE = 4
#: Prefix hashes dealt to one range.
RANGE_HASHES = 4_000_000
#: Rounds of a spanning forest between classes stop when a round links less than this share of its pairs.
WORTH_ANOTHER = 0.2
#: A tile passes on all its pairs between classes while they are at most so many per set, beyond that a forest first.
FEW_APART = 32
#: Text scanned at once; the arrays of a scan take some fifty times as much.
SCAN_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return common.byte_table()[_LOWER], common.powers(common.BASE, n), common.powers(common.BASE_INV, n)


def shingle_sets(column: pa.Array, n_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column."""
    raw, at = text_buffers(column)
    off = (at - at[0]).astype(np.int64)
    raw = raw[at[0]:at[-1]]
    size = len(raw)
    if not size:
        return [np.zeros(0, np.uint64)] * len(column)
    values, up, down = _tables(1 << max(21, int(size).bit_length()))
    space = _SPACE[raw]
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:size]
    last[:-1] &= space[1:] | edge[1:size]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(values[raw] * up[:size], out=sums[1:])
    word = mix64((sums[ends] - sums[starts]) * down[starts])
    del sums
    lo, hi = np.searchsorted(starts, off[:-1]), np.searchsorted(starts, off[1:])
    odd = np.random.default_rng(common.HASH_SEED + 1).integers(0, 2**64, n_words, np.uint64) | np.uint64(1)
    runs = np.zeros(max(len(word) - n_words + 1, 0), np.uint64)
    for j in range(n_words):
        runs += word[j:j + len(runs)] * odd[j]
    runs = mix64(runs)
    out = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if b - a >= n_words:
            out.append(np.unique(runs[a:b - n_words + 1]))
        elif b > a:
            whole = (word[a:b] * odd[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    """64-bit name of a set as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix64(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(np.array([total]))[0].astype(np.int64))


def prefix(s: np.ndarray, common_cells: np.ndarray | None, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, enough that linked sets share one."""
    n = len(s)
    take = n - -(-percent * n // 100) + 1
    if common_cells is None:
        return s[:take]
    late = common_cells[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    return np.concatenate([s[~late], s[late]])[:take]


def signature(s: np.ndarray, scale: int = 1) -> bytes:
    """One bit flipped per shingle; ``scale`` times as many bits as the set's size asks for, up to a bound."""
    width = scale * min(MAX_SIGNATURE_BITS, max(64, 1 << int(len(s)).bit_length()))
    bits = mix64(s ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(width - 1)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of bytes) folded to ``width`` bytes."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


@lru_cache(maxsize=4)
def band_edges(percent: int, most: int = 2**40) -> list[int]:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges


def _range_bits(rows: DataFrame, percent: int) -> int:
    """Hash ranges as a power of two: 64, or more where a range would hold over ``RANGE_HASHES`` prefix hashes."""
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    hashes = n_bytes // 6 * (100 - percent) // 100
    return max(6, min(16, (hashes // RANGE_HASHES).bit_length()))


def _cut(values: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Hashes by range: (range, the 32 bits below the range's)."""
    which = (values >> np.uint64(64 - bits)).astype(np.int64)
    low = ((values << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(which, kind="stable")
    which, low = which[order], low[order]
    at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else []
    return [(int(which[a]), low[a:b]) for a, b in zip(at, [*at[1:], len(which)])]


def _scan_sets(docs: DataFrame, bits: int, percent: int) -> DataFrame:
    """Per document its name and size (``part`` -1), and per range the prefix hashes of many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SCAN_BYTES):
            sets = shingle_sets(batch.column("text"))
            rows = {"part": [-1] * len(sets), "doc_id": batch.column("doc_id").to_pylist(),
                    "n": [len(s) for s in sets], "name": [set_name(s) for s in sets], "low": [None] * len(sets)}
            heads = [prefix(s, None, percent) for s in sets if len(s)]
            for part, low in _cut(np.concatenate([*heads, np.zeros(0, np.uint64)]), bits):
                for k, v in (("part", part), ("doc_id", None), ("n", 0), ("name", 0), ("low", low.tobytes())):
                    rows[k].append(v)
            yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(
                rows.items(), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

    return docs.mapInArrow(common.released(run, _tables), "part int, doc_id long, n long, name long, low binary")


def _common_cells(scanned: DataFrame, bits: int, above: int) -> np.ndarray:
    """Cells of the shingles that stand in more than ``above`` prefixes."""

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in rows["low"]]), return_counts=True)
        top = (np.uint64(key[0]) << np.uint64(32)) | low[n > above].astype(np.uint64)
        return pd.DataFrame({"cell": np.unique(top >> np.uint64(32 + bits - FILTER_BITS)).astype(np.int32)})

    cells = scanned.filter("part >= 0").select("part", "low").groupBy("part").applyInPandas(count, "cell int")
    return common.bitmap(cells)


def _lists(docs: DataFrame, bits: int, percent: int, cells: np.ndarray) -> DataFrame:
    """``list, name, n``: the distinct lists of two or more sets that share a prefix shingle.

    A list ends where the sizes leave so wide a gap that no set before it can link with one behind it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SCAN_BYTES):
            done: set[int] = set()
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for s in shingle_sets(batch.column("text")):
                name = set_name(s)
                if not len(s) or name in done:
                    continue
                done.add(name)
                for part, low in _cut(prefix(s, shared.value, percent), bits):
                    for c, v in zip(cols, (part, name, len(s), low.tobytes())):
                        c.append(v)
            yield pa.record_batch({k: pa.array(v, t) for k, v, t in zip(
                ("part", "name", "n", "low"), cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("name")
        names, sizes = rows["name"].to_numpy(), rows["n"].to_numpy()
        parts = [np.frombuffer(b, np.uint32) for b in rows["low"]]
        who = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        low = np.concatenate(parts)
        order = np.lexsort((sizes[who], low))
        low, who = low[order], who[order]
        size = sizes[who]
        at = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (100 * size[:-1] < percent * size[1:])])
        count = np.diff(np.r_[at, len(low)])
        with np.errstate(over="ignore"):
            named = np.add.reduceat(mix64(names[who].astype(np.uint64)), at)
        named = mix64(named + count.astype(np.uint64))
        many = np.flatnonzero(count > 1)
        _, one = np.unique(named[many], return_index=True)
        many = many[one]
        take = np.concatenate([np.arange(at[i], at[i] + count[i]) for i in many] or [np.zeros(0, np.int64)])
        return pd.DataFrame({"list": np.repeat(named[many], count[many]).astype(np.int64), "name": names[who[take]],
                             "n": sizes[who[take]]})

    found = docs.mapInArrow(common.released(scan, _tables), "part int, name long, n long, low binary")
    found = found.groupBy("part").applyInPandas(gather, "list long, name long, n long")
    return found.dropDuplicates(["list", "name"])


def _of_sets(docs: DataFrame, wanted: DataFrame, make) -> DataFrame:
    """``name, value`` with value = make(set) of each wanted (name, first, and more that is kept): one scan, one shuffle of what is wanted."""
    test = common.may_hold(docs.sparkSession, common.bitmap(wanted.select(common.cell_of("first").alias("cell"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SCAN_BYTES):
            sets = shingle_sets(batch.column("text"))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "name": pa.array([set_name(s) for s in sets], pa.int64()),
                "value": pa.array([make(s) for s in sets], pa.binary())})

    made = docs.filter(test(common.cell_of("doc_id"))).mapInArrow(common.released(run, _tables), "doc_id long, name long, value binary")
    # the same doc_id and text may stand in several rows; by both keys of the join, for no second shuffle of the values
    return made.join(wanted, "name").filter("doc_id = first").dropDuplicates(["name", "doc_id"]).drop("doc_id", "first")


def join(joined: dict[int, int], a: int, b: int) -> bool:
    """Joins two labels in a forest of labels; False if it held them joined before."""
    ends = []
    for x in (a, b):
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        ends.append(x)
    if ends[0] == ends[1]:
        return False
    joined[max(ends)] = min(ends)
    return True


class Tile:
    """Sets of one list and band, smaller to larger, with their signatures."""

    def __init__(self, rows: list[tuple], percent: int):
        self.names = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.home = np.array([r[2] for r in rows], bool)
        self.labels = np.array([r[4] for r in rows], np.int64)
        width = min(len(r[3]) for r in rows)
        self.bits = np.concatenate([fold(np.frombuffer(r[3], np.uint8)[None, :], width) for r in rows]).view(np.uint64)
        # lists that the sets share beside this one, as far as they come before it: a pair belongs to its least shared list
        self.before = [frozenset(r[5]) for r in rows] if rows[0][5] is not None else None
        self.percent = percent

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may link with set ``i`` by size and signature."""
        n, m = self.sizes[i], self.sizes[others]
        far = np.bitwise_count(self.bits[others] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum((n + m - far) // 2, np.minimum(n, m))
        ok = 100 * most >= self.percent * (n + m - most)
        hit = others[ok & (self.home[others] | self.home[i])]
        if self.before is None:
            return hit
        return hit[[self.before[i].isdisjoint(self.before[j]) for j in hit.tolist()]] if len(hit) else hit

    def forest(self, joined: dict[int, int]) -> list[tuple[int, int, int]]:
        """Pairs that join all sets which may link, each set entered once; none within a label or what ``joined`` joins.

        The third of each is a set that stands for all that the tile joins with the two. ``alone`` gets the sets that may link with none.
        """
        out, left, self.alone = [], np.arange(len(self.names)), []
        while len(left) > 1:
            root, queue, left = int(left[0]), [left[0]], left[1:]
            rest = len(left)
            while queue and len(left):
                i = queue.pop()
                hit = self.near(i, left)
                out += [(i, j, root) for j in hit.tolist() if join(joined, int(self.labels[i]), int(self.labels[j]))]
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
            if len(left) == rest:
                self.alone.append(root)
        self.alone += left.tolist()
        return out

    def between(self, turn: int, joined: dict[int, int]) -> list[tuple[int, int]]:
        """Pairs that may link and join different labels, each two labels joined once in ``joined`` (a task's forest)."""
        out, (values, counts) = [], np.unique(self.labels, return_counts=True)
        if len(values) < 2:
            return out
        spin = mix64(self.names.astype(np.uint64) + np.uint64(turn))
        for i in np.flatnonzero(self.labels != values[counts.argmax()]).tolist():
            hit = self.near(i, np.flatnonzero(self.labels != self.labels[i]))
            # another partner each turn and for each set: a failed pair says little about the next
            for j in hit[np.argsort(spin[hit] ^ spin[i], kind="stable")].tolist():
                if join(joined, int(self.labels[i]), int(self.labels[j])):
                    out.append((i, j))
        return out

    def apart(self, most: int | None = None) -> list[tuple[int, int]] | None:
        """All pairs that may link and bear different labels, or None if they are more than ``most``."""
        out = []
        if (self.labels == self.labels[0]).all():
            return out
        for i in range(len(self.names) - 1):
            rest = np.arange(i + 1, len(self.names))
            hit = self.near(i, rest[self.labels[rest] != self.labels[i]])
            out += [(i, j) for j in hit.tolist()]
            if most is not None and len(out) > most:
                return None
        return out


def _tile_pairs(tiles: DataFrame, percent: int, turn: int, alone: bool = False) -> DataFrame:
    """Pairs ``a, b`` to decide, ``root`` for all that a tile's forest joins: forests between labels (turn 0), all apart, but a forest of classes where those are
    many (turn > 0), or all apart (turn < 0). A pair of a set with itself marks a tile (``list``, ``band``) that may hold more pairs.
    With ``alone`` (turn 0) such rows name the sets that may link with none in that tile.
    """
    fields = {"a": pa.int64(), "b": pa.int64(), "root": pa.int64(), "list": pa.int64(), "band": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(tile: tuple, rows: list[tuple]) -> list[tuple]:
            if len(rows) < 2 or not any(r[2] for r in rows):
                return []
            t = Tile(rows, percent)
            found = t.apart(FEW_APART * len(rows) if turn > 0 else None) if turn else t.forest(joined)
            marked = t.names[:1] if found is None else t.names[t.alone] if alone else t.names[:0]
            found = t.between(turn, joined) if found is None else found
            found = [(min(a, b), max(a, b), int(t.names[root[0] if root else i]), None, None) for i, j, *root in found
                    for a, b in [(int(t.names[i]), int(t.names[j]))]]
            return found + [(a, a, a, *tile) for a in marked.tolist()]

        def batch_of(out: set) -> pa.RecordBatch:
            return pa.record_batch({n: pa.array([p[k] for p in out], t) for k, (n, t) in enumerate(fields.items())})

        key, rows, out = None, [], set()
        joined: dict[int, int] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("list", "band", "name", "n", "home", "signature", "label", "before")]
            for lst, band, *row in zip(*cols):
                if (lst, band) != key:
                    out.update(pairs(key, rows))
                    key, rows = (lst, band), []
                rows.append(tuple(row))
            if len(out) > 100_000:
                yield batch_of(out)
                out = set()
        out.update(pairs(key, rows))
        yield batch_of(out)

    spread = tiles.repartition("list", "band").sortWithinPartitions("list", "band", "n", "name")
    return spread.mapInArrow(common.released(run, _tables), "a long, b long, root long, list long, band int")


def _decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                both = int((p[at] == q).sum())
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked)})

    left = pairs.join(sets.withColumnsRenamed({"name": "a", "value": "x"}), "a")
    return left.join(sets.withColumnsRenamed({"name": "b", "value": "y"}), "b").select("a", "b", "x", "y") \
        .mapInArrow(common.released(run, _tables), "a long, b long, linked boolean")


def _sets_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of some pairs, and a few others: the rest need not be shuffled."""
    ends = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b"))
    test = common.may_hold(sets.sparkSession, common.bitmap(ends.select(common.cell_of("name").alias("cell"))))
    return sets.filter(test(common.cell_of("name")))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    common_above: int = COMMON) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row. ``docs`` is read several times, so pass a table."""
    rows = id_text(docs, id_col, text_col)
    bits = _range_bits(rows, percent)
    scanned = materialize(_scan_sets(rows, bits, percent), "shingle-sets")
    cells = _common_cells(scanned, bits, common_above)
    named = scanned.filter("part = -1").select("doc_id", "n", "name")
    lists = materialize(_lists(rows, bits, percent, cells), "lists")
    firsts = named.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("first"))
    edges = band_edges(percent, max(2, (named.agg(F.max("n")).first()[0] or 0) + 1))
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    band = F.size(F.filter(bounds, lambda e: e <= F.col("n")))

    def mixed_tiles(rows: DataFrame) -> DataFrame:
        """Rows of the tiles in which sets of different labels may meet, no signatures yet."""
        mixed = rows.groupBy("list", "band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("home").alias("h"),
                                                 F.count("*").alias("members"))
        return rows.join(mixed.filter("h and x <> y").select("list", "band", "members"), ["list", "band"])

    def tiles(rows: DataFrame, labels: DataFrame) -> DataFrame:
        labels = labels.withColumnsRenamed({"node": "name"})
        return mixed_tiles(rows.drop("label", "members").join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")))

    def signed(rows: DataFrame, signatures: DataFrame) -> DataFrame:
        rows = rows.join(signatures.withColumnRenamed("value", "signature"), "name")
        if "lists" not in signatures.columns:
            return rows.withColumn("before", F.lit(None).cast("array<long>"))
        return rows.withColumn("before", F.filter("lists", lambda x: x < F.col("list"))).drop("lists")

    spread = lists.withColumn("label", F.col("name")).withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))) \
        .withColumn("band", band + F.col("role")).withColumn("home", F.col("role") == 0).drop("role")
    first = materialize(mixed_tiles(spread), "tiles")
    listed = materialize(firsts.join(first.select("name").distinct(), "name", "left_semi"), "listed")
    signatures = materialize(_of_sets(rows, listed, signature), "signatures")
    largest = first.groupBy("name").agg(F.max(F.struct("members", "list", "band", "n", "home", "label")).alias("tile"))
    stars = materialize(_tile_pairs(signed(largest.select("name", "tile.*"), signatures), percent, 0), "stars")
    presumed = stars.select(F.col("a").alias("node"), F.col("root").alias("label")).unionAll(stars.select("b", "root")).distinct()
    rest = materialize(_tile_pairs(signed(tiles(first, presumed), signatures), percent, 0, alone=True), "rest")
    pairs = materialize(stars.unionAll(rest.filter("list is null")).select("a", "b").distinct(), "pairs")
    alone = rest.filter("list is not null").select("list", "band", F.col("a").alias("name"))
    ends = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).distinct()
    paired = materialize(listed.join(ends, "name", "left_semi"), "paired")
    # every set that may link with another stands in a pair of a forest: these are all the sets ever compared
    sets = materialize(_of_sets(rows, paired, np.ndarray.tobytes), "sets")
    labels, decided, near, wide, turn, more = None, None, None, None, 0, True
    while True:
        new = materialize(_decide(pairs, sets if decided is None else _sets_of(sets, pairs), percent), "decided")
        decided = new if decided is None else decided.unionAll(new)
        good = new.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        n_good, n_all = good.count(), new.count()
        if labels is None:
            labels = materialize(components(good), "labels")
        elif n_good:
            labels = materialize(merge_components(labels, good), "labels")
        if not more or n_good == n_all and not turn:
            break  # all pairs decided, or the first forest holds as it is
        turn = turn + 1 if n_good > WORTH_ANOTHER * n_all else -1
        if near is None:
            near = materialize(first.join(alone, ["list", "band", "name"], "left_anti"), "near")
        mixed = materialize(tiles(near, labels), "mixed")
        if wide is None:
            shared = mixed.groupBy("name").agg(F.collect_set("list").alias("lists"))
            again = materialize(listed.join(shared, "name"), "again")
            wide = materialize(_of_sets(rows, again, lambda s: signature(s, LAST_SCALE)), "wide")
        found = materialize(_tile_pairs(signed(mixed, wide), percent, turn), "found")
        marked = found.filter("a = b").select("list", "band")
        more = not marked.isEmpty()
        # a tile without a mark has passed on every pair of its own
        near = mixed.join(marked, ["list", "band"], "left_semi")
        pairs = found.filter("a <> b").select("a", "b").distinct().join(decided.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
    named = named.join(labels.withColumnsRenamed({"node": "name"}), "name", "left") \
        .withColumn("label", F.coalesce("label", "name"))
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return named.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
