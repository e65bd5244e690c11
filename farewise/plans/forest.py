"""Random forest regression on every training row: trees grown in parallel tasks, kept as a table of nodes.

The training rows are written in key order as blocks of coded columns: numeric columns in quantile bins of all rows, categories one against
the rest (what one-hot columns give a tree). A tree's bootstrap draws as many rows as there are, by generators seeded with the seed, the
tree and the block, so the forest does not depend on partitions or lost executors. While a node holds more than ``PART_ROWS`` rows, its
split comes from histograms that tasks add up a block at a time; the rows below go to one task per tree and part, which grows them on, level
by level on histograms. No limit on depth; leaves of ``min_instances`` rows or more.

The forest is the node table ``tree, node, feature, threshold, category, left, right, value, part``, written as Parquet. It grows with the
rows and stays in tasks: to predict, packed parts (14 bytes a node, deflated) meet the coded rows that reach them, and each row's
values are added in the order of trees. Only the nodes above the parts, the cuts (``max_bins`` a column) and labels reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from farewise.operators.quantiles import _cumulated
from farewise.operators.sampling import hash_sample, row_key
from farewise.session import materialize

#: Rows of a training block are 2 ** BLOCK_BITS; a bootstrap is drawn a block at a time.
BLOCK_BITS = 16
#: A node of so many rows or fewer is grown on by one task.
PART_ROWS = 1 << 19
#: Bins of one column that a task holds at once while it grows a level.
LEVEL_BINS = 1 << 16
#: Nodes of fewer rows than this are split apart from the others, whose rows fill more bins.
FEW_ROWS = 32
#: What a row adds to a number that also holds a sum of weights.
ROW = float(1 << 32)
#: Rows that are routed through the forest together.
PREDICT_ROWS = 8192
#: Tasks that blocks are dealt to at most.
MAX_TASKS = 10_000

NODE_SCHEMA = ("tree int, node int, feature string, threshold double, category string, `left` int, `right` int, value double, part int")


@dataclass(frozen=True)
class Coding:
    """How each column becomes small integers: edges of numeric bins, or labels of categories by code."""

    numeric: dict[str, np.ndarray]
    labels: dict[str, list[str]]

    def codes(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        """Bin of a number (values up to the bin's edge), code of a label; -1 for a label that the training rows do not hold."""
        out = {c: np.searchsorted(edges, rows[c].to_numpy(float)) for c, edges in self.numeric.items()}
        for c, labels in self.labels.items():
            out[c] = pd.Categorical(rows[c], categories=labels).codes.astype(np.int64)
        return out

    def size(self, col: str) -> int:
        return len(self.numeric[col]) + 1 if col in self.numeric else max(len(self.labels[col]), 1)

    def kinds(self) -> list[np.dtype]:
        """The least type of each column's codes."""
        return [np.min_scalar_type(self.size(c) - 1) for c in (*self.numeric, *self.labels)]

    def ordered(self) -> np.ndarray:
        return np.array([True] * len(self.numeric) + [False] * len(self.labels))


def make_coding(rows: pd.DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], max_bins: int) -> Coding:
    edges = {}
    for c in num_cols:
        x = np.unique(rows[c].to_numpy(float))
        if len(x) > max_bins:
            x = np.unique(np.quantile(rows[c].to_numpy(float), np.arange(1, max_bins) / max_bins, method="lower"))
        edges[c] = x[:-1] if len(x) and x[-1] == rows[c].max() else x
    return Coding(edges, {c: sorted(rows[c].unique()) for c in cat_cols})


def find_coding(rows: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], max_bins: int) -> Coding:
    """``make_coding`` of a table of any size: ranks among the counts of each column's values, all labels. NaN and null make no edge."""
    def long(cols: Sequence[str]) -> DataFrame:
        return rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_q"), F.col(c).alias("_v")) for i, c in enumerate(cols)])))

    edges = {}
    if num_cols:
        counted = long(num_cols).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_q", "_v").agg(F.count(F.lit(1)).alias("_c"))
        ranked = _cumulated(counted.withColumn("_cv", F.col("_c")), ["_q"], "_v")
        found = ranked.groupBy("_q").agg(F.count(F.lit(1)).alias("values"), F.max("_n").alias("rows"), F.max("_v").alias("top")).collect()
        wanted = F.lit(False)
        for r in found:
            keep = F.lit(True)
            if r["values"] > max_bins:
                ranks = F.lit(np.floor((r["rows"] - 1) * (np.arange(1, max_bins) / max_bins)).astype(int).tolist()).cast("array<bigint>")
                keep = F.exists(ranks, lambda at: (F.col("_cum") > at) & (F.col("_cum") - F.col("_cv") <= at))
            wanted = wanted | ((F.col("_q") == r["_q"]) & keep)
        values = ranked.filter(wanted).select("_q", "_v").collect()  # max_bins a column at most
        top = {r["_q"]: r["top"] for r in found}
        edges = {c: np.array(sorted(r["_v"] for r in values if r["_q"] == i and r["_v"] != top[i]), float) for i, c in enumerate(num_cols)}
    labels = long(cat_cols).filter(F.col("_v").isNotNull()).distinct().collect() if cat_cols else []
    return Coding(edges, {c: sorted(r["_v"] for r in labels if r["_q"] == i) for i, c in enumerate(cat_cols)})


# ---------------------------------------------------------------- packed columns

def _packed(columns: Iterable[np.ndarray]) -> bytes:
    return b"".join(x.tobytes() for x in columns)


def _columns(raw: bytes, rows: int, kinds: Iterable) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, rows, at))
        at += out[-1].nbytes
    return out


def write_blocks(rows: DataFrame, coding: Coding) -> tuple[DataFrame, int]:
    """Rows numbered as they stand (``_at`` is their partition and place) and written as ``block, rows, packed``: labels, then codes by column."""
    place = 33  # bits that monotonically_increasing_id leaves to the place in a partition
    rows = rows.withColumn("_part", F.shiftright("_at", place))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    ends = np.cumsum([r["n"] for r in counts], dtype=np.int64)
    starts = rows.sparkSession.createDataFrame([(r["_part"], int(e) - r["n"]) for r, e in zip(counts, ends)], "_part long, _start long")
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << place) - 1))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn("_row", number).drop("_part", "_start", "_at")
    kinds = coding.kinds()

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_row")
        codes = [x.astype(kind) for x, kind in zip(coding.codes(block).values(), kinds)]
        return pd.DataFrame({"block": block["_block"].iloc[:1], "rows": [len(block)], "packed": [_packed([block["_y"].to_numpy(float), *codes])]})

    blocks = numbered.withColumn("_block", F.shiftright("_row", BLOCK_BITS)).groupBy("_block")
    return materialize(blocks.applyInPandas(pack, "block long, rows int, packed binary"), "forest-blocks"), int(ends[-1])


def draws(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often a tree's bootstrap (``rows`` draws of ``rows`` rows) draws each row of a block: halves of the blocks share the draws."""
    size, low, high, count = 1 << BLOCK_BITS, 0, -(-rows >> BLOCK_BITS), rows
    while high - low > 1:
        middle = (low + high) // 2
        left, both = (middle - low) * size, min(high * size, rows) - low * size
        first = int(np.random.default_rng([seed, tree, low, high]).binomial(count, left / both))
        low, high, count = (low, middle, first) if block < middle else (middle, high, count - first)
    mine = min(size, rows - block * size)
    return np.bincount(np.random.default_rng([seed, tree, block]).integers(0, mine, count), minlength=mine)


# ---------------------------------------------------------------- growing

def _counts(key: np.ndarray, size: int, w: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By key: rows and weights in one number (``ROW`` times the rows, and the weights), weighted labels."""
    return np.bincount(key, w, size), np.bincount(key, wy, size)


def _apart(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.floor(both * (1 / ROW))
    return rows, both - rows * ROW


def _best_splits(rows: np.ndarray, weight: np.ndarray, total: np.ndarray, all_total: np.ndarray, ordered: bool,
                 least: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain measure, place) of the best split of each node on one column; minus infinity where none leaves ``least`` rows on both sides."""
    all_rows, all_weight = rows.sum(axis=1, keepdims=True), weight.sum(axis=1, keepdims=True)
    if ordered:
        rows, weight, total = (np.cumsum(x, axis=1) for x in (rows, weight, total))
    rest = all_weight - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total ** 2 / weight + (all_total - total) ** 2 / rest
    gain[(rows < least) | (all_rows - rows < least)] = -np.inf
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at], at


def _splits_of(code: np.ndarray, node: np.ndarray, n_nodes: int, size: int, ordered: bool, w: np.ndarray, wy: np.ndarray, least: int,
               most: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain measure, bin) of the best split of nodes on one column. Where nodes of at most ``most`` rows leave most bins empty, only the others count."""
    both, total = (x.reshape(n_nodes, size) for x in _counts(node * size + code, n_nodes * size, w, wy))
    all_total = total.sum(axis=1, keepdims=True)
    if 3 * most > size:
        return _best_splits(*_apart(both), total, all_total, ordered, least)
    held = np.flatnonzero(both)
    of, code = np.divmod(held, size)
    many = np.bincount(of, minlength=n_nodes)
    wide = int(many.max())
    place = np.arange(len(held)) - np.repeat(np.cumsum(many) - many - np.arange(n_nodes) * wide, many)
    near = np.zeros((2, n_nodes * wide))
    near[0, place], near[1, place] = both.ravel()[held], total.ravel()[held]
    bins = np.zeros(n_nodes * wide, np.int64)
    bins[place] = code
    both, total = near.reshape(2, n_nodes, wide)
    gain, at = _best_splits(*_apart(both), total, all_total, ordered, least)
    return gain, bins.reshape(n_nodes, wide)[np.arange(n_nodes), at]


def _unsplit(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    best = total ** 2 / weight
    return best + (1e-9 * np.abs(best) + 1e-12)  # a split must be worth more than rounding


def grow_nodes(codes: dict[str, np.ndarray], coding: Coding, y: np.ndarray, w: np.ndarray, least: int) -> pd.DataFrame:
    """One tree on rows with whole weights: a row per node, in level order. Rows stay sorted by node, so that a run of nodes is a run of rows."""
    x, ordered, sizes = np.stack([*codes.values()]), coding.ordered(), [coding.size(c) for c in codes]
    w, wy = w + ROW, w * y
    rows, first, out = np.array([len(y)]), 0, []
    while len(rows):
        count = len(rows)
        node = np.repeat(np.arange(count), rows)
        weight, total = _apart(np.bincount(node, w, count))[1], np.bincount(node, wy, count)
        best, col, at = _unsplit(weight, total), np.full(count, -1), np.zeros(count, np.int64)
        wide = rows >= 2 * least
        x, w, wy = (np.take(v, np.flatnonzero(np.repeat(wide, rows)), axis=-1) for v in (x, w, wy))
        wide = np.flatnonzero(wide)
        few = rows[wide] < FEW_ROWS
        for some, mine in ((np.flatnonzero(few), few), (np.flatnonzero(~few), ~few)):
            if not len(some):
                continue
            here = np.flatnonzero(np.repeat(mine, rows[wide]))
            n = rows[wide[some]]
            xs, ws, wys = (x, w, wy) if mine.all() else (np.take(v, here, axis=-1) for v in (x, w, wy))
            ends = np.concatenate([[0], np.cumsum(n)])
            for j, size in enumerate(sizes):
                step = max(1, LEVEL_BINS // size)
                for a in range(0, len(some), step):
                    run = wide[some[a:a + step]]
                    of = slice(ends[a], ends[a + len(run)])
                    gain, split = _splits_of(xs[j, of], np.repeat(np.arange(len(run)), rows[run]), len(run), size, ordered[j], ws[of], wys[of],
                                             least, int(rows[run].max()))
                    better = gain > best[run]
                    best[run], col[run], at[run] = np.where(better, gain, best[run]), np.where(better, j, col[run]), np.where(better, split, at[run])
        inner = col >= 0
        child = first + count + 2 * (np.cumsum(inner) - inner)
        out.append(pd.DataFrame({"node": first + np.arange(count), "col": col, "bin": at, "left": np.where(inner, child, -1),
                                 "value": total / weight}))
        goes = inner[wide]
        live = np.flatnonzero(np.repeat(goes, rows[wide]))
        split = wide[goes]
        n = rows[split]
        begin = np.cumsum(n) - n
        value, cut = np.take(x.ravel(), np.repeat(col[split] * x.shape[1], n) + live), np.repeat(at[split].astype(x.dtype), n)
        right = np.where(np.repeat(ordered[col[split]], n), value > cut, value != cut)
        seen = np.concatenate([[0], np.cumsum(right)])
        rights = seen[begin + n] - seen[begin]
        place = seen[1:] - np.repeat(seen[begin], n)  # rights of the node up to a row
        to = np.where(right, np.repeat(begin + n - rights - 1, n) + place, np.arange(len(right)) - place)
        order = np.empty_like(to)
        order[to] = live
        x, w, wy = (np.take(v, order, axis=-1) for v in (x, w, wy))
        rows = np.stack([n - rights, rights], axis=1).ravel()
        first += count
    return pd.concat(out, ignore_index=True)


def grow_tree(codes: dict[str, np.ndarray], coding: Coding, y: np.ndarray, least: int, rng: np.random.Generator) -> pd.DataFrame:
    """One tree on a bootstrap of the rows: a row per node, in level order."""
    drawn = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
    rows = np.flatnonzero(drawn)
    return grow_nodes({c: x[rows] for c, x in codes.items()}, coding, y[rows], drawn[rows].astype(float), least)


def descend(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The end node of each row (a column of codes in ``x``) in a tree of column (-1: an end), cut as a code, left child."""
    col, cut, left = tree
    at, live = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    while len(live):
        here = at[live]
        inner = col[here] >= 0
        live, here = live[inner], here[inner]
        value, split = x[col[here], live], cut[here]
        at[live] = left[here] + np.where(ordered[col[here]], value > split, value != split)
    return at


class Tops:
    """The trees above their parts, grown on the driver: of each tree ``[column, bin, left, value]`` by node, and its nodes still to split."""

    def __init__(self, trees: int, rows: int):
        self.nodes: list[list[list]] = [[[-1, 0, -1, None]] for _ in range(trees)]
        self.open: dict[int, list[int]] = {t: [0] for t in range(trees)} if rows > PART_ROWS else {}

    def split(self, tree: int, node: int, col: int, cut: int, value: float, sides: Sequence[int]) -> None:
        """A split into so many rows a side; none (``col`` -1) makes a leaf."""
        nodes = self.nodes[tree]
        nodes[node] = [col, cut, len(nodes) if col >= 0 else -1, value]
        if col >= 0:
            self.open.setdefault(tree, []).extend(len(nodes) + i for i, n in enumerate(sides) if n > PART_ROWS)
            nodes += [[-1, 0, -1, None], [-1, 0, -1, None]]

    def arrays(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array([n[k] for n in self.nodes[tree]]) for k in range(3))

    def parts(self, tree: int) -> list[int]:
        """Nodes that tasks grow on."""
        return [i for i, n in enumerate(self.nodes[tree]) if n[0] < 0 and n[3] is None]


def _bootstraps(coding: Coding, seed: int, rows: int, batches: Iterator[pd.DataFrame], trees: Sequence[int]):
    """For each block and tree: tree, block, labels and weights of the drawn rows, their codes a column a row."""
    for batch in batches:
        for block, n, raw in zip(batch["block"], batch["rows"], batch["packed"]):
            y, *codes = _columns(raw, n, [np.dtype(float), *coding.kinds()])
            x = np.stack(codes)
            for tree in trees:
                w = draws(seed, tree, block, rows)
                drawn = np.flatnonzero(w)
                yield tree, block, y[drawn], w[drawn], x[:, drawn]


def grow_tops(blocks: DataFrame, coding: Coding, rows: int, num_trees: int, least: int, seed: int) -> Tops:
    """Split all nodes of more than ``PART_ROWS`` rows, one level of all trees a job; a row per such node reaches the driver."""
    tops, names, ordered = Tops(num_trees, rows), [*coding.numeric, *coding.labels], coding.ordered()
    sizes = [coding.size(c) for c in names]
    ends = np.cumsum([3 * s for s in sizes])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = {t: arrays[t] for t in todo}
        for tree, block, y, w, x in _bootstraps(coding, seed, rows, batches, [*trees]):
            at = descend(trees[tree], x, ordered)
            which = np.full(len(trees[tree][0]), -1)
            which[todo[tree]] = np.arange(len(todo[tree]))
            here = np.flatnonzero(which[at] >= 0)
            node, w, y = which[at[here]], w[here].astype(float), y[here]
            found = []
            for j, size in enumerate(sizes):
                both, total = _counts(node * size + x[j, here], len(todo[tree]) * size, w + ROW, w * y)
                found.append(np.stack([*_apart(both), total]).reshape(3, -1, size))
            yield pd.DataFrame({"tree": tree, "node": todo[tree], "block": block,
                                "packed": [_packed(f[:, i] for f in found) for i in range(len(todo[tree]))]})

    def choose(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(ends[-1])
        for raw in some.sort_values("block")["packed"]:
            found += np.frombuffer(raw)
        found = [f.reshape(3, 1, -1) for f in np.split(found, ends[:-1])]
        n, weight, total = found[0].sum(axis=2)
        best, pick = _unsplit(weight, total)[0], (-1, 0, 0)
        for j, f in enumerate(found):
            gain, at = _best_splits(*f, f[2].sum(axis=1, keepdims=True), ordered[j], least)
            if gain[0] > best:
                left = f[0, 0, :at[0] + 1].sum() if ordered[j] else f[0, 0, at[0]]
                best, pick = gain[0], (j, int(at[0]), int(left))
        return pd.DataFrame([(*key, *pick, int(n[0]) - pick[2], float((total / weight)[0]))],
                            columns=["tree", "node", "col", "bin", "lefts", "rights", "value"])

    while tops.open:
        todo, tops.open = tops.open, {}
        arrays = {t: tops.arrays(t) for t in todo}
        found = blocks.mapInPandas(count, "tree int, node int, block long, packed binary").groupBy("tree", "node")
        splits = found.applyInPandas(choose, "tree int, node int, col int, bin int, lefts long, rights long, value double").collect()
        for r in sorted(splits):
            tops.split(r["tree"], r["node"], r["col"], r["bin"], r["value"], (r["lefts"], r["rights"]))
    return tops


def _texts(at: np.ndarray, names: Sequence[str]) -> pa.Array:
    """Names by place; null for -1."""
    return pa.DictionaryArray.from_arrays(pa.array(at, pa.int32(), mask=at < 0), pa.array([*names], pa.string())).cast(pa.string())


def _described(col: np.ndarray, cut: np.ndarray, coding: Coding) -> dict[str, pa.Array]:
    """``feature``, ``threshold`` and ``category`` of nodes given by column and bin."""
    names = [*coding.numeric, *coding.labels]
    labels = [v for c in coding.labels for v in coding.labels[c]]
    threshold, label = np.full(len(col), np.nan), np.full(len(col), -1)
    for j, c in enumerate(names):
        mine = col == j
        if c in coding.numeric:
            threshold[mine] = coding.numeric[c][cut[mine]]
        else:
            label[mine] = cut[mine] + sum(len(coding.labels[b]) for b in names[len(coding.numeric):j])
    numeric = (col >= 0) & (col < len(coding.numeric))
    return {"feature": _texts(col, names), "threshold": pa.array(threshold, mask=~numeric), "category": _texts(label, labels)}


def fit_forest(train: DataFrame, label: str, num_cols: Sequence[str], cat_cols: Sequence[str], key: str | None, num_trees: int = 200,
               min_instances: int = 5, max_bins: int = 256, seed: int = 42, max_train_rows: int | None = None) -> DataFrame:
    """The node table of a forest on all rows (a hash sample of about ``max_train_rows`` where the caller asks for one); empty without rows."""
    spark = train.sparkSession
    if max_train_rows is not None:
        train = hash_sample(train, min(1.0, max_train_rows / max(train.count(), 1)), key, seed + 1)
    rows = train.select(row_key(train, key).alias("_key"), F.col(label).cast("double").alias("_y"),
                        *[F.col(c).cast("double").alias(c) for c in num_cols], *[F.col(c).cast("string").alias(c) for c in cat_cols])
    # in key order, so that the bootstrap does not depend on partitions
    rows = materialize(rows.orderBy(*rows.columns).withColumn("_at", F.monotonically_increasing_id()), "forest-rows").drop("_key")
    if rows.isEmpty():
        return materialize(spark.createDataFrame([], NODE_SCHEMA), "forest")
    coding = find_coding(rows, num_cols, cat_cols, max_bins)
    blocks, n = write_blocks(rows, coding)
    blocks = blocks.repartition(min(-(-n >> BLOCK_BITS), MAX_TASKS))
    tops = grow_tops(blocks, coding, n, num_trees, min_instances, seed)
    ordered, kinds, names = coding.ordered(), coding.kinds(), [*coding.numeric, *coding.labels]
    parts = {t: (tops.arrays(t), tops.parts(t)) for t in range(num_trees)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tree, block, y, w, x in _bootstraps(coding, seed, n, batches, range(num_trees)):
            arrays, ends = parts[tree]
            at = descend(arrays, x, ordered)
            mine = [np.flatnonzero(at == end) for end in ends]
            raw = [_packed([y[m], w[m].astype(np.uint16), *(c[m].astype(kind) for c, kind in zip(x, kinds))]) for m in mine]
            yield pd.DataFrame({"tree": tree, "part": ends, "block": block, "rows": [len(m) for m in mine], "packed": raw})

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        some = [_columns(raw, rows, [np.dtype(float), np.dtype(np.uint16), *kinds])
                for _, rows, raw in sorted(zip(*(table[c].to_pylist() for c in ("block", "rows", "packed"))))]
        y, w, *codes = (np.concatenate(c) for c in zip(*some))
        t = grow_nodes(dict(zip(names, codes)), coding, y, w.astype(float), min_instances)
        end = {c: pa.array(np.full(len(t), k.as_py(), np.int32)) for c, k in zip(("tree", "part"), key)}
        return pa.table({**end, "node": t["node"].to_numpy(np.int32), **_described(t["col"].to_numpy(), t["bin"].to_numpy(), coding),
                         "left": t["left"].to_numpy(np.int32), "value": t["value"].to_numpy()})

    dealt = blocks.mapInPandas(deal, "tree int, part int, block long, rows int, packed binary").filter("rows > 0")
    dealt = dealt.repartition(min(sum(len(p) for _, p in parts.values()), MAX_TASKS), "tree", "part").groupBy("tree", "part")
    grown = materialize(dealt.applyInArrow(grow, "tree int, part int, node int, feature string, threshold double, category string, "
                                                 "`left` int, value double"), "forest")
    return _numbered(grown, tops, coding)


def _numbered(grown: DataFrame, tops: Tops, coding: Coding) -> DataFrame:
    """The node table: nodes above the parts first, each part's root in its place among them, then the parts' other nodes one part after another."""
    spark = grown.sparkSession
    sizes = spark.createDataFrame([(t, len(nodes)) for t, nodes in enumerate(tops.nodes)], "tree int, top int")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = grown.groupBy("tree", "part").agg((F.count(F.lit(1)) - 1).alias("n")).join(F.broadcast(sizes), "tree")
    starts = materialize(starts.select("tree", "part", (F.col("top") + F.coalesce(F.sum("n").over(before), F.lit(0))).cast("int").alias("_start")),
                         "forest-parts")
    left = F.when(F.col("left") < 0, F.lit(-1)).otherwise(F.col("_start") + F.col("left") - 1)
    nodes = grown.join(F.broadcast(starts), ["tree", "part"]).select(
        "tree", F.when(F.col("node") == 0, F.col("part")).otherwise(F.col("_start") + F.col("node") - 1).alias("node"), "feature", "threshold",
        "category", left.alias("left"), F.when(left < 0, left).otherwise(left + 1).alias("right"), "value", "part")
    top = [(t, i, *n) for t, of in enumerate(tops.nodes) for i, n in enumerate(of) if n[3] is not None]
    if not top:
        return nodes
    tree, node, col, cut, below, value = (np.array(c) for c in zip(*top))
    said = {k: v.to_pylist() for k, v in _described(col, cut, coding).items()}
    rows = [(int(tree[i]), int(node[i]), said["feature"][i], said["threshold"][i], said["category"][i], int(below[i]),
             int(below[i]) + (below[i] >= 0).item(), float(value[i]), None if below[i] >= 0 else int(node[i])) for i in range(len(top))]
    return nodes.unionByName(materialize(spark.createDataFrame(rows, NODE_SCHEMA), "forest-tops"))


# ---------------------------------------------------------------- prediction

#: A node in a packed part: place of its column (-1: a leaf), its cut (a threshold, a category's code, a leaf's value), left child.
PACKED = np.dtype([("col", "<i2"), ("cut", "<f8"), ("left", "<i4")])


def pack_trees(nodes: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """``tree, part, packed`` with a part's nodes in order as ``PACKED`` records, packed in tasks; the codes of each column's categories.

    A tree without nodes above its parts is one part.
    """
    cols = [*num_cols, *cat_cols]
    found = nodes.filter(F.col("category").isNotNull()).select("feature", "category").distinct().collect()  # labels of the training rows
    labels = {c: {v: i for i, v in enumerate(sorted(r.category for r in found if r.feature == c))} for c in cat_cols}

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        out = np.zeros(part.num_rows, PACKED)
        out["col"], out["cut"] = part["col"].to_numpy(), part["cut"].to_numpy()
        label = part["category"].combine_chunks().dictionary_encode()
        at = label.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for j, c in enumerate(cat_cols, len(num_cols)):
            mine = out["col"] == j
            out["cut"][mine] = np.array([labels[c].get(v, -1) for v in label.dictionary.to_pylist()], float)[at[mine]] if mine.any() else []
        left = part["left"].to_numpy()
        out["left"] = np.where(left < 0, -1, left - (part["node"][1].as_py() if len(out) > 1 else 0) + 1)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "packed": [out.tobytes()]})

    col = F.lit(-1)
    for i, c in enumerate(cols):
        col = F.when(F.col("feature") == c, F.lit(i)).otherwise(col)
    slim = nodes.filter(F.col("part").isNotNull()).select(
        "tree", "part", "node", col.alias("col"), F.coalesce("threshold", F.when(F.col("feature").isNull(), F.col("value")), F.lit(0.0)).alias("cut"),
        F.when(F.col("feature").isNotNull(), F.col("category")).alias("category"), "left")
    return slim.groupBy("tree", "part").applyInArrow(pack, "tree int, part int, packed binary"), labels


def deflated(tree: bytes) -> bytes:
    """Packed nodes, one field of all nodes after the other, deflated."""
    nodes = np.frombuffer(tree, PACKED)
    return zlib.compress(b"".join(nodes[k].tobytes() for k in PACKED.names))


def inflated(tree: bytes) -> np.ndarray:
    """The nodes of a deflated tree as ``PACKED`` records."""
    raw = zlib.decompress(tree)
    out, at = np.empty(len(raw) // PACKED.itemsize, PACKED), 0
    for k in PACKED.names:
        out[k] = np.frombuffer(raw, PACKED[k], len(out), at)
        at += len(out) * PACKED[k].itemsize
    return out


def _cut_codes(coding: Coding) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cuts of nodes (thresholds, codes of labels) as codes of their columns."""
    edges = [*coding.numeric.values()]

    def of(col: np.ndarray, cut: np.ndarray) -> np.ndarray:
        out = np.where(col >= len(edges), cut, 0).astype(np.int64)
        for j, e in enumerate(edges):
            mine = col == j
            out[mine] = np.searchsorted(e, cut[mine])
        return out

    return of


def predict(nodes: DataFrame, df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], out: str) -> DataFrame:
    """``df`` with the mean over all trees as ``out``; its other columns pass through the tasks unchanged.

    Rows go in blocks to the parts of every tree that they reach, and the values come back to their block.
    """
    cols = [*num_cols, *cat_cols]
    tops = nodes.filter(F.col("part").isNull() | (F.col("node") == F.col("part"))).orderBy("tree", "node").collect()  # the trees above their parts
    if not tops:
        return df.withColumn(out, F.lit(None).cast("double"))
    packed, labels = pack_trees(nodes, num_cols, cat_cols)
    cuts = nodes.filter(F.col("threshold").isNotNull()).select("feature", "threshold").distinct().collect()  # max_bins a column at most
    coding = Coding({c: np.array(sorted(r.threshold for r in cuts if r.feature == c), float) for c in num_cols},
                    {c: [*labels[c]] for c in cat_cols})
    kind, ordered, code = np.min_scalar_type(max((coding.size(c) for c in cols), default=0)), coding.ordered(), _cut_codes(coding)
    above: dict[int, tuple] = {}
    for tree in {r.tree for r in tops}:
        mine = [r for r in tops if r.tree == tree]
        col = np.array([-1 if r.part is not None else cols.index(r.feature) for r in mine])
        cut = np.array([0.0 if r.part is not None else labels[r.feature][r.category] if r.threshold is None else r.threshold for r in mine])
        above[tree] = col, code(col, cut), np.array([r.left for r in mine])
    kept = df.columns

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId()) << 33
        for batch in batches:
            for a in range(0, batch.num_rows, PREDICT_ROWS):
                some = batch.slice(a, PREDICT_ROWS)
                x = coding.codes(pd.DataFrame({c: some[f"__{c}"].to_pandas() for c in cols}))
                x = [np.where(v < 0, coding.size(c), v).astype(kind) for c, v in x.items()]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (plain := some.select(kept)).schema) as ipc:
                    ipc.write_batch(plain)
                yield pa.record_batch({"block": pa.array([number], pa.int64()), "rows": pa.array([some.num_rows], pa.int32()),
                                       "codes": [_packed(x)], "payload": [sink.getvalue().to_pybytes()]})
                number += 1

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, n, raw in zip(batch["block"], batch["rows"], batch["codes"]):
                x, found = np.stack(_columns(raw, n, [kind] * len(cols))), []
                for tree, arrays in above.items():
                    at = descend(arrays, x, ordered)
                    for end in np.unique(at):
                        mine = np.flatnonzero(at == end)
                        found.append((tree, end, block, len(mine), _packed([mine.astype(np.uint16), x[:, mine]])))
                yield pd.DataFrame(found, columns=["tree", "part", "block", "rows", "packed"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A part's nodes come before the rows that reach it."""
        for batch in batches:
            values = []
            for tree, block, n, raw in zip(batch["tree"], batch["block"], batch["rows"], batch["packed"]):
                if block < 0:
                    part = inflated(raw)
                    col, cut, left = (np.ascontiguousarray(part[k]) for k in PACKED.names)
                    arrays = col, code(col, cut), left
                else:
                    place, *x = _columns(raw, n, [np.dtype(np.uint16), *[kind] * len(cols)])
                    values.append((block, tree, n, _packed([place, cut[descend(arrays, np.stack(x), ordered)]]), None))
            yield pd.DataFrame(values, columns=["block", "tree", "rows", "packed", "payload"])

    def add(block: pa.Table) -> pa.Table:
        trees = sorted(zip(*(block[c].to_pylist() for c in ("tree", "rows", "packed", "payload"))), key=lambda r: r[0])
        (_, n, _, payload), *trees = trees
        total = np.zeros(n)
        for _, some, raw, _ in trees:  # each row once a tree, in the order of trees
            place, value = _columns(raw, some, [np.dtype(np.uint16), np.dtype(float)])
            total[place] += value
        rows = pa.ipc.open_stream(payload).read_all()
        return rows.append_column(out, pa.array(total / len(above)))

    wide = df.select(*kept, *[F.col(c).cast("double").alias(f"__{c}") for c in num_cols],
                     *[F.col(c).cast("string").alias(f"__{c}") for c in cat_cols])
    table = materialize(wide.mapInArrow(blocks, "block long, rows int, codes binary, payload binary"), "predict-blocks")
    small = F.pandas_udf(lambda trees: trees.map(deflated), "binary")
    packed = packed.select("tree", "part", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("rows"), small("packed").alias("packed"))
    tasks = min(max(table.count(), 1), MAX_TASKS)
    routed = table.select("block", "rows", "codes").repartition(tasks).mapInPandas(
        route, "tree int, part int, block long, rows int, packed binary")
    met = packed.unionByName(routed).repartition(min(sum(r.part is not None for r in tops), MAX_TASKS), "tree", "part")
    values = met.sortWithinPartitions("tree", "part", "block").mapInPandas(walk, "block long, tree int, rows int, packed binary, payload binary")
    own = table.select("block", F.lit(-1).alias("tree"), "rows", F.lit(None).cast("binary").alias("packed"), "payload")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields), T.StructField(out, T.DoubleType())])
    return own.unionByName(values).repartition(tasks, "block").groupBy("block").applyInArrow(add, schema)
