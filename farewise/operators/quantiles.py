"""Group statistics with percentiles: mergeable sketches or exact rank selection.

All methods return the discrete percentile (smallest v with at least
ceil(p * n) values <= v, as SQL ``percentile_disc`` / ``quantile_disc``).

NaN takes no part in a percentile, as null.

``method="digits"`` (default): exact and repeatable at any group size, in two or three scans of plain hash aggregates: the
value at a rank is found digit after digit (``_digit_stats``). No sketch, no sort of a group, nothing random. The counts of the first
scan are written while the DataFrame is built; the input must not change between the scans.

``method="bracket"``: exact and repeatable at any group size, in two scans. KLL sketches (below) give each
group and level a bracket of values around the wanted rank; the second scan counts the values below it and combines
(keys, value) counts of those inside, a few per mille of the rows, whose ranks are found as by "exact". A rank
that lies outside its bracket is looked up among all values of its group. The result depends neither on the sketches' random
choices nor on partitions. Jobs run while the DataFrame is built; the input is read twice and must not change between.

``method="kll"``: KLL sketches merged in two levels. Rows are first
sketched per (keys, salt) with salt = input partition id mod S, then the S
sketches of a group are merged. A group holding a third of all rows thus
never funnels one partial sketch per map task into a single reducer: each
merge sees about sqrt(#tasks) sketches. Sketch memory is bounded by k; exact
while a group holds fewer than about k rows (default 16384, at most 65535),
rank error of order 1/k beyond. Counts and means are carried through both levels, so the
input is scanned once.

``method="sketch"``: ``percentile_approx`` (the published analysis' choice),
one sketch per column and group merged in one reducer per group; exact while
a group holds fewer than about accuracy / 2 rows.

``method="exact"``: exact for any group size, without ever placing a whole
group in one task:

1. pre-aggregate (keys, value) -> count (map-side combine collapses repeats);
2. range-partition by (keys, value): a hot group is cut into many slices;
   the slice id is pinned by writing the slices to the checkpoint folder;
   several columns and key sets share one pass (rows are expanded to one
   row per (key set, column) first);
3. running count inside each (keys, slice), bounded by the slice size;
4. slice totals (at most #groups + #slices rows) give each slice's offset and
   each group's n;
5. the row whose global running count crosses ceil(p * n) is the answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.config import DEFAULT
from farewise.functions.exact_sum import LIMBS, limbs, total
from farewise.operators.stats import broadcast_if_bounded
from farewise.session import materialize

SKETCH = "sketch"
EXACT = "exact"
KLL = "kll"
BRACKET = "bracket"
DIGITS = "digits"
#: Half width of a bracket in ranks: three times the 99 % rank error of a KLL sketch of size k, 2.296 / k^0.9021.
BRACKET_ERRORS = 3


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    r = right
    renamed = {k: f"__r_{k}" for k in keys}
    for k, nk in renamed.items():
        r = r.withColumnRenamed(k, nk)
    cond = None
    for k, nk in renamed.items():
        c = left[k].eqNullSafe(r[nk])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*renamed.values())


def _cumulated(counted: DataFrame, keys: Sequence[str], col: str, num_slices: int | None = None) -> DataFrame:
    """Rows ``keys, col, _c`` (rows) ``, _cv`` (rows that count) with running counts ``_cum`` of their group.

    Also ``_n`` and ``_all``, the group's totals of both. The order is by value, null first; a hot group is cut into
    slices. Builds on a written table, so it runs a job.
    """
    v = F.col(col)
    by = [*[F.col(k).asc_nulls_first() for k in keys], v.asc_nulls_first()]
    ranged = counted.repartitionByRange(num_slices, *by) if num_slices else counted.repartitionByRange(*by)
    ranged = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "percentile-slices")
    inner = Window.partitionBy(*keys, "_slice").orderBy(v.asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_cum", F.sum("_cv").over(inner))
    totals = ranged.groupBy(*keys, "_slice").agg(F.sum("_cv").alias("_part"), F.sum("_c").alias("_rows"))
    by_group = Window.partitionBy(*keys)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_slice",
        F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_off"),
        F.sum("_part").over(by_group).alias("_n"),
        F.sum("_rows").over(by_group).alias("_all"),
    )
    return _null_safe_join(local, totals, [*keys, "_slice"]).withColumn("_cum", F.col("_off") + F.col("_cum"))


def _rank(level: float, n: str) -> Column:
    return F.greatest(F.ceil(F.lit(float(level)) * F.col(n)), F.lit(1))


def _crosses(rank: Column) -> Column:
    return (F.col("_cv") > 0) & (F.col("_cum") >= rank) & (F.col("_cum") - F.col("_cv") < rank)


def exact_percentiles(df: DataFrame, keys: Sequence[str], col: str, levels: Mapping[str, float],
                      count_as: str | None = None, num_slices: int | None = None) -> DataFrame:
    """Exact discrete percentiles of ``col`` per group (nulls ignored; all-null group -> null)."""
    keys = list(keys)
    v = F.col(col)
    counted = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_cv", F.when(v.isNull(), F.lit(0)).otherwise(F.col("_c")))
    picks = [F.max(F.when(_crosses(_rank(p, "_n")), v)).alias(name) for name, p in levels.items()]
    aggs = picks + ([F.max("_all").alias(count_as)] if count_as else [])
    return _cumulated(counted, keys, col, num_slices).groupBy(*keys).agg(*aggs)


def kll_salts(spark) -> int:
    """Salt count for the two-level merge: about sqrt(16 x parallelism)."""
    return max(1, math.ceil(math.sqrt(16 * spark.sparkContext.defaultParallelism)))


SET_COL = "_set"


def _grouped(df: DataFrame, sets: list[list[str]], all_keys: list[str], extra: list[str]):
    """groupBy for one key set, GROUPING SETS (one scan, one shuffle) for several."""
    if len(sets) == 1:
        return df.groupBy(*sets[0], *extra)
    return df.groupingSets([[*s, *extra] for s in sets], *all_keys, *extra)


def _set_index(sets: list[list[str]], all_keys: list[str], extra: list[str]) -> Column:
    """Map grouping_id() (bit set = column not grouped, first column = highest bit) to the set index."""
    cols = all_keys + extra
    expr = None
    for i, s in enumerate(sets):
        gid = sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in s and c not in extra)
        cond = F.col("_gid") == F.lit(gid)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


class Plain:
    """Row count, sums and means of a grouping, mergeable over levels; sums of doubles do not depend on the order."""

    def __init__(self, df: DataFrame, count_as: str | None, sums: Mapping[str, str], means: Mapping[str, str]):
        self.count_as, self.sums, self.means = count_as, sums, means
        types = {f.name: f.dataType.typeName() for f in df.schema.fields}
        self.cols = list(dict.fromkeys([*sums.values(), *means.values()]))
        self.doubles = {c for c in self.cols if types[c] in ("double", "float")}
        self.parts = {c: [f"_s{i}_{j}" for j in range(LIMBS + 1 if c in self.doubles else 1)] for i, c in enumerate(self.cols)}
        self.counts = {c: f"_mc{i}" for i, c in enumerate(self.cols) if c in means.values()}
        self.names = [count_as] if count_as else []
        self.names += [*sums, *means]

    def split(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that are summed."""
        return df.withColumns({name: x for c in self.cols for name, x in zip(
            self.parts[c], limbs(F.col(c).cast("double")) if c in self.doubles else [F.col(c)])})

    def first(self) -> list[Column]:
        """Aggregates over the rows of ``split``."""
        out = [F.count(F.lit(1)).alias("_n")]
        out += [F.sum(n).alias(n) for c in self.cols for n in self.parts[c]]
        return out + [F.count(c).alias(n) for c, n in self.counts.items()]

    def merged(self) -> list[Column]:
        """Aggregates over rows of ``first``."""
        return [F.sum(n).alias(n) for n in ("_n", *(n for c in self.cols for n in self.parts[c]), *self.counts.values())]

    def out(self) -> list[Column]:
        """The statistics from rows of ``first`` or ``merged``."""
        value = {c: total([F.col(n) for n in self.parts[c]]) if c in self.doubles else F.col(self.parts[c][0]) for c in self.cols}
        out = [F.col("_n").alias(self.count_as)] if self.count_as else []
        out += [value[c].alias(name) for name, c in self.sums.items()]
        return out + [F.try_divide(value[c], F.col(self.counts[c])).alias(name) for name, c in self.means.items()]


def _kll_stats(df: DataFrame, sets, all_keys, plain: Plain, by_col, k: int, salts: int | None, sizes: bool = False):
    """Statistics with percentiles from the sketches; ``sizes`` adds ``_n0, _n1, ...``, the values of each column."""
    salts = salts or kll_salts(df.sparkSession)
    cols = list(by_col)
    first = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"_sk{i}") for i, c in enumerate(cols)]
    first += plain.first()
    if len(sets) > 1:
        first.append(F.grouping_id().alias("_gid"))
    level1 = _grouped(plain.split(df).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))), sets, all_keys,
                      ["_salt"]).agg(*first)
    gid = ["_gid"] if len(sets) > 1 else []
    second = [F.kll_merge_agg_double(f"_sk{i}").alias(f"_sk{i}") for i in range(len(cols))]
    level2 = level1.groupBy(*gid, *all_keys).agg(*second, *plain.merged())
    out = [(_set_index(sets, all_keys, ["_salt"]) if gid else F.lit(0)).alias(SET_COL)]
    out += [F.col(k_) for k_ in all_keys] + plain.out()
    for i, c in enumerate(cols):
        levels = by_col[c]
        q = F.kll_sketch_get_quantile_double(f"_sk{i}", F.array(*[F.lit(float(p)) for p in levels.values()]))
        # a group whose values are all null has an empty sketch: no percentile
        q = F.when(F.kll_sketch_get_n_double(f"_sk{i}") > 0, q)
        out += [q[j].alias(name) for j, name in enumerate(levels)]
        if sizes:
            out.append(F.kll_sketch_get_n_double(f"_sk{i}").alias(f"_n{i}"))
    return level2.select(*out)


def _expanded(df: DataFrame, sets, all_keys, cols) -> DataFrame:
    """One row per (key set, column ``_q``) of each row: the set's keys (others null) and the value ``_v``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    entries = [
        F.struct(F.lit(i).alias(SET_COL),
                 *[(F.col(k) if k in s else F.lit(None).cast(types[k])).alias(k) for k in all_keys],
                 F.lit(j).alias("_q"), F.col(c).cast("double").alias("_v"))
        for i, s in enumerate(sets) for j, c in enumerate(cols)
    ]
    return df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def _in_brackets(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _l, _x``: the value at rank ``_r`` of each level ``_l``, where it lies between ``_lo`` and ``_hi``.

    ``brackets`` holds ``keys`` and an array ``_b`` of (_l, _r, _lo, _hi). Values below a bracket are one count (null
    ``_x``, first in the order), those above are dropped; both combine before the shuffle.
    """
    held = _null_safe_join(values, brackets, keys)
    held = held.select(*keys, "_v", F.explode(F.filter("_b", lambda e: F.col("_v") <= e["_hi"])).alias("_e"))
    counted = held.select(*keys, "_e._l", "_e._r", F.when(F.col("_v") >= F.col("_e._lo"), F.col("_v")).alias("_x")) \
        .groupBy(*keys, "_l", "_r", "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_cv", F.col("_c"))
    ranked = _cumulated(counted, [*keys, "_l", "_r"], "_x")
    return ranked.filter(F.col("_x").isNotNull() & _crosses(F.col("_r"))).select(*keys, "_l", "_x")


def _bracket_stats(df: DataFrame, sets, all_keys, plain: Plain, by_col, k: int, salts: int | None):
    """Exact percentiles in two scans: brackets from sketches, then ranks among the values inside the brackets.

    A sketch of at most ``k`` values still holds each of them and gives the percentile itself; the second scan ranks the
    groups of more values.
    """
    half = min(1.0, BRACKET_ERRORS * 2.296 / k ** 0.9021)
    cols = list(by_col)
    levels = [sorted(set(by_col[c].values())) for c in cols]
    ends = {c: {name: p for j, level in enumerate(levels[i])
                for name, p in ((f"_lo{i}_{j}", max(level - half, 0.0)), (f"_at{i}_{j}", level),
                                (f"_hi{i}_{j}", min(level + half, 1.0)))}
            for i, c in enumerate(cols)}
    groups = materialize(_kll_stats(df, sets, all_keys, plain, ends, k, salts, sizes=True),
                         "percentile-brackets")
    set_keys = [SET_COL, *all_keys]
    keys = [*set_keys, "_q"]

    def bracket(i: int, j: int) -> Column:
        return F.struct(F.lit(j).alias("_l"), _rank(levels[i][j], f"_n{i}").alias("_r"),
                        F.col(f"_lo{i}_{j}").alias("_lo"), F.col(f"_hi{i}_{j}").alias("_hi"))

    per_col = [F.when(F.col(f"_n{i}") > k, F.struct(
        F.lit(i).alias("_q"), F.array(*[bracket(i, j) for j in range(len(levels[i]))]).alias("_b"))) for i in range(len(cols))]
    fixed = [*set_keys, *plain.names]
    named = [(i, levels[i].index(p), out) for i, c in enumerate(cols) for out, p in by_col[c].items()]
    brackets = groups.select(*set_keys, F.explode(F.array(*per_col)).alias("_e")).filter("_e is not null") \
        .select(*set_keys, "_e.*")
    if brackets.isEmpty():
        return groups.select(*fixed, *[F.col(f"_at{i}_{j}").alias(out) for i, j, out in named])
    values = _expanded(df, sets, all_keys, cols).filter(F.col("_v").isNotNull())
    found = materialize(_in_brackets(values, brackets, keys), "percentiles")
    wanted = brackets.select(*keys, F.explode("_b").alias("_e")).select(*keys, "_e._l", "_e._r")
    missed = materialize(_null_safe_join(wanted, found, [*keys, "_l"], "left_anti"), "percentiles-missed")
    if not missed.isEmpty():
        # a rank outside its bracket: the whole group is the bracket
        whole = missed.groupBy(*keys).agg(F.collect_list(F.struct(
            "_l", "_r", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))).alias("_b"))
        found = found.unionByName(_in_brackets(values, whole, keys))
    picks = [F.max(F.when((F.col("_q") == F.lit(i)) & (F.col("_l") == F.lit(j)), F.col("_x"))).alias(f"_x{i}_{j}")
             for i, level in enumerate(levels) for j in range(len(level))]
    ranked = _null_safe_join(groups, found.groupBy(*set_keys).agg(*picks), set_keys, "left")
    return ranked.select(*fixed, *[F.coalesce(f"_x{i}_{j}", f"_at{i}_{j}").alias(out) for i, j, out in named])


def _sketch_stats(df: DataFrame, sets, all_keys, plain: Plain, by_col, accuracy: int):
    exprs = plain.first()
    quant_names = []
    for col, lv in by_col.items():
        sketch = F.percentile_approx(F.col(col), list(lv.values()), accuracy)
        exprs += [sketch[i].alias(out) for i, out in enumerate(lv)]
        quant_names += list(lv)
    if len(sets) > 1:
        exprs.append(F.grouping_id().alias("_gid"))
    agg = _grouped(plain.split(df), sets, all_keys, []).agg(*exprs)
    set_col = _set_index(sets, all_keys, []) if len(sets) > 1 else F.lit(0)
    return agg.select(set_col.alias(SET_COL), *all_keys, *plain.out(), *quant_names)


#: Significant bits of a value that each scan of the digit selection counts by; the last scan counts the values themselves.
DIGIT_BITS = (8, 30)
#: With at most so many rows within a chosen digit the next scan counts the values at once.
VALUE_ROWS = 4_000_000


def _digit(v: Column, bits: int) -> Column:
    """A double rounded to ``bits`` significant bits: smaller values never come out larger (beyond 2^900: the value itself)."""
    scaled = v * F.lit(float((1 << (53 - bits)) + 1))
    return F.when(F.abs(v) < F.lit(2.0 ** 900), scaled - (scaled - v)).otherwise(v)


def _digit_stats(df: DataFrame, sets, all_keys, plain: Plain, by_col, reads, min_rows: Mapping[int, int]):
    """Exact percentiles by selecting digit after digit of the wanted value: one hash aggregate per scan.

    Scan 1 counts the rows of each group by the first ``DIGIT_BITS`` of each column (with the row count, sums and
    means); running counts give the digit that holds each wanted rank and the rank within it. Further scans take
    only the rows of those digits and count by the next digits, the last one by the value. The keys of a count are
    bounded by the number of digits (2^23 of one digit at most) or by ``VALUE_ROWS``, whatever the size of the group.
    ``reads``: the sets that need each column.
    """
    cols = list(by_col)
    levels = [sorted(set(by_col[c].values())) for c in cols]
    set_keys = [SET_COL, *all_keys]
    keys = [*set_keys, "_q"]
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = [(i, j) for i in range(len(sets)) for j in reads.get(i, range(len(cols)))] if reads is not None else \
        [(i, j) for i in range(len(sets)) for j in range(len(cols))]

    def entry(i: int, j: int, stats: bool) -> Column:
        """Row of set ``i`` for column ``j`` (-1: none); the plain columns ride on one row per set."""
        out = [F.lit(i).alias(SET_COL)]
        out += [(F.col(k) if k in sets[i] else F.lit(None).cast(types[k])).alias(k) for k in all_keys]
        out += [F.lit(j).alias("_q"), (F.col(cols[j]) if j >= 0 else F.lit(None)).cast("double").alias("_v")]
        return F.struct(*out, *([F.lit(stats).alias("_one")] if stats is not None else []))

    # scan 1
    ridden = plain.split(df)
    carried = [n for c in plain.cols for n in plain.parts[c]] + list(plain.counts)
    seen: set[int] = set()
    entries = []
    for i, j in pairs + [(i, -1) for i in range(len(sets)) if all(a != i for a, _ in pairs)]:
        entries.append(entry(i, j, i not in seen))
        seen.add(i)
    long = ridden.select(F.explode(F.array(*entries)).alias("_e"), *dict.fromkeys(carried)).select("_e.*", *dict.fromkeys(carried))
    if plain.cols and len(entries) > 1:
        long = long.withColumns({c: F.when(F.col("_one"), F.col(c)) for c in dict.fromkeys(carried)})
    counted = long.withColumn("_d", _digit(F.col("_v"), DIGIT_BITS[0])).groupBy(*keys, "_one", "_d").agg(
        *plain.first()).withColumn("_c", F.col("_n"))
    counted = materialize(counted, "percentile-counts")
    stats = counted.filter("_one").groupBy(*set_keys).agg(*plain.merged())
    if min_rows:
        least = F.lit(1)
        for i, n in min_rows.items():
            least = F.when(F.col(SET_COL) == F.lit(i), F.lit(n)).otherwise(least)
        stats = stats.filter(F.col("_n") >= least)

    def chosen(counts: DataFrame, by: list[str], rank: Column) -> DataFrame:
        """``by, _d`` of the digit whose running count crosses the rank, and the rank within it as ``_r``."""
        ordered = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.select("*", F.sum("_c").over(ordered).alias("_cum"), rank.alias("_r")) \
            .filter((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r"))) \
            .withColumn("_r", F.col("_r") - F.col("_cum") + F.col("_c"))

    valued = counted.filter(F.col("_d").isNotNull()).select(*keys, "_d", "_c")
    if min_rows:
        valued = _null_safe_join(valued, stats.select(*set_keys), set_keys, "left_semi")
    by_group = Window.partitionBy(*keys)
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(float(p)).alias("_p"), F.lit(n).alias("_l"))
                                 for j in range(len(cols)) for n, p in enumerate(levels[j])])).alias("_w")
    asked = valued.withColumn("_all", F.sum("_c").over(by_group)).select("*", wanted).select("*", "_w.*").filter("_j = _q")
    found = chosen(asked, [*keys, "_l"], F.greatest(F.ceil(F.col("_p") * F.col("_all")), F.lit(1))).select(*keys, "_l", "_d", "_r", "_c")

    # further scans: only rows within the digits chosen so far
    rows = df.select(F.explode(F.array(*[entry(i, j, None) for i, j in pairs])).alias("_e")).select("_e.*") \
        .filter(F.col("_v").isNotNull()) if pairs else None
    turn, bits, bound = 0, DIGIT_BITS[0], None
    while pairs and bits:
        names = [f"_d{t}" for t in range(turn + 1)]
        found = found.withColumnRenamed("_d", names[-1])
        most = max(map(len, levels))
        targets = found.groupBy(*keys).agg(F.max("_c").alias("_most"), *[
            F.max(F.when(F.col("_l") == F.lit(n), F.col(c))).alias(f"_{n}{c}") for n in range(most) for c in (*names, "_r")])
        targets = materialize(targets.select(*keys, "_most", F.filter(F.array(*[
            F.struct(F.lit(n).alias("_l"), *[F.col(f"_{n}{c}").alias(c) for c in (*names, "_r")]) for n in range(most)]),
            lambda e: e["_r"].isNotNull()).alias("_t")), "percentile-digits")
        # as many rows as groups that are asked for: sent to the tasks if they are few
        size = targets.agg(F.count(F.lit(1)).alias("n"), F.max("_most").alias("most")).first()
        bound, turn = size.n, turn + 1
        bits = DIGIT_BITS[turn] if turn < len(DIGIT_BITS) and (size.most or 0) > VALUE_ROWS else None
        matched = _null_safe_join(rows, broadcast_if_bounded(targets.drop("_most"), bound), keys)
        same = [(_digit(F.col("_v"), DIGIT_BITS[t]), n) for t, n in enumerate(names)]
        matched = matched.select(*keys, "_v", F.explode(F.filter("_t", lambda e: _all_equal(e, same))).alias("_e"))
        digit = _digit(F.col("_v"), bits) if bits else F.col("_v")
        counts = matched.select(*keys, "_e.*", digit.alias("_d")).groupBy(*keys, "_l", *names, "_r", "_d") \
            .agg(F.count(F.lit(1)).alias("_c"))
        found = chosen(counts.withColumnRenamed("_r", "_rank"), [*keys, "_l"], F.col("_rank")) \
            .select(*keys, "_l", *names, "_d", "_r", "_c")
    picks = [F.max(F.when((F.col("_q") == F.lit(j)) & (F.col("_l") == F.lit(levels[j].index(p))), F.col("_d"))).alias(out)
             for j, c in enumerate(cols) for out, p in by_col[c].items()]
    stats = stats.select(*set_keys, *plain.out())
    if not pairs:
        return stats
    values = found.groupBy(*set_keys).agg(*picks)
    return _null_safe_join(stats, broadcast_if_bounded(values, bound), set_keys, "left")


def _all_equal(e: Column, same) -> Column:
    cond = F.lit(True)
    for value, name in same:
        cond = cond & (value == e[name])
    return cond


def group_stats_sets(df: DataFrame, sets: Sequence[Sequence[str]], count_as: str | None = None,
                     sums: Mapping[str, str] | None = None, means: Mapping[str, str] | None = None,
                     quantiles: Mapping[str, tuple[str, float]] | None = None, method: str | None = None,
                     accuracy: int | None = None, kll_k: int | None = None, salts: int | None = None,
                     reads: Mapping[int, Sequence[str]] | None = None,
                     min_rows: Mapping[int, int] | None = None) -> DataFrame:
    """Group statistics for several key sets in one pass (GROUPING SETS).

    Returns ``_set`` (index into ``sets``), the union of all keys (null where
    a key is not part of the row's set), the optional row count, named sums
    ``{out: column}``, named means ``{out: column}`` (sum / count of non-null
    values) and named percentiles ``{out: (column, level)}``.

    For the digit selection only: ``reads`` names the columns whose percentiles each set needs (others come out null), and
    ``min_rows`` leaves out smaller groups of a set before their percentiles are looked for.
    """
    sets = [list(s) for s in sets]
    all_keys: list[str] = []
    for s in sets:
        all_keys += [k for k in s if k not in all_keys]
    method = method or DEFAULT.percentile_method
    by_col: dict[str, dict[str, float]] = {}
    for out, (col, p) in (quantiles or {}).items():
        by_col.setdefault(col, {})[out] = p
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    source = {}
    for i, col in enumerate(list(by_col)):
        source[col] = col
        if types[col] in ("double", "float"):  # NaN takes no part, as null
            source[col] = f"_pv{i}"
            df = df.withColumn(f"_pv{i}", F.when(~F.isnan(col), F.col(col)))
    at = {i: [list(by_col).index(c) for c in some] for i, some in reads.items()} if reads is not None else None
    by_col = {source[c]: by_col[c] for c in by_col}
    plain = Plain(df, count_as, dict(sums or {}), dict(means or {}))
    if method == DIGITS and by_col:
        return _digit_stats(df, sets, all_keys, plain, by_col, at, min_rows or {})
    if method == BRACKET and by_col:
        return _bracket_stats(df, sets, all_keys, plain, by_col, kll_k or DEFAULT.kll_k, salts)
    if method == KLL and by_col:
        return _kll_stats(df, sets, all_keys, plain, by_col, kll_k or DEFAULT.kll_k, salts)
    if method in (SKETCH, KLL, BRACKET, DIGITS):
        # without percentiles every partial is a few numbers: one aggregate level suffices
        acc = DEFAULT.percentile_accuracy if accuracy is None else accuracy
        return _sketch_stats(df, sets, all_keys, plain, by_col, acc)
    if method != EXACT:
        raise ValueError(f"unknown percentile method {method!r}")
    return _exact_stats(df, sets, all_keys, plain, by_col)


def _exact_stats(df: DataFrame, sets, all_keys, plain: Plain, by_col) -> DataFrame:
    """Exact percentiles of every (key set, column) in one rank-selection pass.

    Each input row is expanded to one row per (key set, percentile column)
    carrying the set id, the set's keys (others null), the column id and the
    value; ``exact_percentiles`` then runs once over that long frame. Plain
    aggregates come from one GROUPING SETS aggregate and are joined on
    (set, keys) — both sides hold one row per group.
    """
    exprs = plain.first() + ([F.grouping_id().alias("_gid")] if len(sets) > 1 else [])
    set_col = _set_index(sets, all_keys, []) if len(sets) > 1 else F.lit(0)
    result = _grouped(plain.split(df), sets, all_keys, []).agg(*exprs) \
        .select(set_col.alias(SET_COL), *all_keys, *plain.out())
    cols = list(by_col)
    if not cols:
        return result
    # groups come from the plain aggregate; null values add nothing to a percentile
    long = _expanded(df, sets, all_keys, cols).filter(F.col("_v").isNotNull())
    levels = sorted({p for lv in by_col.values() for p in lv.values()})
    names = {p: f"_l{n}" for n, p in enumerate(levels)}
    part = exact_percentiles(long, [SET_COL, *all_keys, "_q"], "_v", {names[p]: p for p in levels})
    picks = [F.max(F.when(F.col("_q") == F.lit(j), F.col(names[p]))).alias(out)
             for j, c in enumerate(cols) for out, p in by_col[c].items()]
    pct = part.groupBy(SET_COL, *all_keys).agg(*picks)
    quant_names = [out for c in cols for out in by_col[c]]
    return _null_safe_join(result, pct, [SET_COL, *all_keys], "left").select(SET_COL, *all_keys, *plain.names, *quant_names)


def group_stats(df: DataFrame, keys: Sequence[str], count_as: str | None = None,
                means: Mapping[str, str] | None = None, quantiles: Mapping[str, tuple[str, float]] | None = None,
                method: str | None = None, accuracy: int | None = None, kll_k: int | None = None,
                salts: int | None = None, sums: Mapping[str, str] | None = None, min_rows: int = 1) -> DataFrame:
    """One row per group of ``keys``: see ``group_stats_sets`` (a single key set)."""
    return group_stats_sets(df, [list(keys)], count_as, sums, means, quantiles, method, accuracy, kll_k,
                            salts, None, {0: min_rows} if min_rows > 1 else None).drop(SET_COL)
