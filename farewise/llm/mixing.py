"""Mixing sources to target weights by temperature.

With p_s a source's share of the tokens, the weights are p_s^a / sum p^a. The exponent a in [0, 1] is bisected: the
largest a whose weights reach a target entropy (as a share of the greatest possible, log of the number of sources),
or the smallest a under which no source is repeated more than a limit. Weights times the budget of tokens give each source its
quota, which is realised as block permutations: a source's documents are dealt into blocks of about
``block_tokens`` tokens by a hash of the id; every full epoch takes all blocks, the last one takes blocks in the
order of their permutation until the quota is met, the block at the quota's end document by document. Reading by
(epoch, block_order, doc_order) gives blocks in permuted order and documents permuted within them.

Without a budget every source is taken at least once: the largest source once, the others repeated up to the limit, so no
document is lost. Sums over sources and blocks are Spark aggregates; no list of sources, blocks or documents
reaches the driver. Null sources form one source of their own; null and empty texts have no tokens and follow their
block; repeated rows are dealt alike and each kept. A source without tokens gets one epoch. Extra columns ride along under
any name; only one that an output is named (``prefix`` and its name) gives way to the output. A quota within a thousandth of whole epochs is
taken as whole epochs. An empty table gives an empty table; very long texts are documents of their block like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.session import materialize

BLOCK_TOKENS = 1_000_000
#: Exponents tried at once; each round narrows the bracket to one of their gaps.
GRID = 16
ROUNDS = 5
SEED = 17
LONG_MAX = 2 ** 63 - 1


@dataclass(frozen=True)
class Mix:
    """Chosen exponent with the sums that turn a source's tokens into its weight and quota."""

    exponent: float
    total: int
    norm: float
    budget: float


def token_column(text_col: str = "text") -> Column:
    """Tokens of a text: runs of characters other than white space."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("\\S+")), F.lit(0)).cast("long")


def _share(total: int) -> Column:
    return F.col("source_tokens") / F.lit(float(total))


def _sums(shares: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum p^a, sum p^a log p) of each exponent, in one aggregate over the sources."""
    cols = []
    for i, a in enumerate(exponents):
        power = F.pow(_share(total), F.lit(a))
        cols += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(_share(total))).alias(f"e{i}")]
    row = shares.filter("source_tokens > 0").agg(*cols).first()
    return [(row[f"z{i}"], row[f"e{i}"]) for i in range(len(exponents))]


def choose(shares: DataFrame, *, entropy_share: float | None = None, max_repetition: float | None = None,
           budget_tokens: int | None = None) -> Mix | None:
    """Bisect the exponent over a table of ``source_tokens``; None if there are no tokens."""
    import math

    live = shares.filter("source_tokens > 0")
    top = live.agg(F.sum("source_tokens").alias("total"), F.min("source_tokens").alias("least"),
                   F.max("source_tokens").alias("most"), F.count("*").alias("n")).first()
    if not top.n:
        return None
    total, small, large = int(top.total), top.least / top.total, top.most / top.total

    def budget(a: float, z: float) -> float:
        return float(budget_tokens) if budget_tokens is not None else total * z * large ** (1 - a)

    def repetition(a: float, z: float) -> float:
        return small ** (a - 1) / z * budget(a, z) / total

    def enough(a: float, z: float, e: float) -> bool:
        """Whether the exponent is within the target; both targets ask for a bracket with one change."""
        if entropy_share is not None:
            entropy = math.log(z) - a * e / z
            return entropy >= entropy_share * math.log(top.n) - 1e-12
        return max_repetition is None or repetition(a, z) > max_repetition

    # enough() holds from 0 up to some exponent: the last of them for an entropy, the first after them for a limit
    lo, hi = 0.0, 1.0
    ends = _sums(live, total, [0.0, 1.0])
    if enough(1.0, *ends[1]):
        lo = hi = 1.0
    elif not enough(0.0, *ends[0]):
        lo = hi = 0.0
    for _ in range(ROUNDS if lo < hi else 0):
        grid = [lo + (hi - lo) * i / GRID for i in range(1, GRID)]
        held = [a for a, (z, e) in zip(grid, _sums(live, total, grid)) if enough(a, z, e)]
        lo = max([lo, *held])
        hi = min([hi, *[a for a in grid if a > lo]])
    a = round(lo if entropy_share is not None else hi, 6)
    z = round(_sums(live, total, [a])[0][0], 12)
    return Mix(a, total, z, budget(a, z))


def mix_sources(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", tokens: Column | None = None,
                entropy_share: float | None = None, max_repetition: float | None = None,
                budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
                prefix: str = "mix_") -> DataFrame:
    """All columns of ``docs`` and ``source, tokens, weight, epoch, block_order, doc_order`` with ``prefix`` before each name.

    One row per copy taken. ``docs`` is read several times, so pass a table.
    """
    outputs = ["source", "tokens", "weight", "epoch", "block_order", "doc_order"]
    taken = {(prefix + c).lower() for c in outputs}
    # the columns of docs ride along as mix_0, mix_1, ...: no name of theirs can meet one used here
    keep = {f"mix_{i}": c for i, c in enumerate(docs.columns) if c.lower() not in taken}
    src = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in keep.items()], src.alias("mix_source"),
                       (tokens if tokens is not None else token_column()).alias("mix_tokens"), F.col(id_col).alias("mix_id"))
    id_col = "mix_id"
    shares = materialize(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("source_tokens")), "shares")
    mix = choose(shares, entropy_share=entropy_share, max_repetition=max_repetition, budget_tokens=budget_tokens)
    if mix is None:
        mix = Mix(1.0, 1, 1.0, 1.0)
    weight = F.pow(_share(mix.total), F.lit(mix.exponent)) / F.lit(mix.norm)
    none = F.col("source_tokens") == 0
    # quotas within a thousandth of whole epochs are whole: doubles decide nothing there
    quota = F.round(weight * F.lit(mix.budget)).cast("long")
    whole = F.round(quota / F.col("source_tokens"))
    quota = F.when(F.abs(quota - whole * F.col("source_tokens")) <= F.greatest(F.col("source_tokens") / 1000, F.lit(1)),
                   (whole * F.col("source_tokens")).cast("long")).otherwise(quota)
    plan = shares.select(
        "mix_source", F.when(none, 0.0).otherwise(weight).alias("mix_weight"),
        F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / block_tokens)).cast("long").alias("n_blocks"),
        F.when(none, 1).otherwise(F.floor(quota / F.col("source_tokens"))).cast("int").alias("epochs"),
        F.when(none, 0).otherwise(F.pmod(quota, F.col("source_tokens"))).cast("long").alias("rest"))
    dealt = rows.join(plan, "mix_source").withColumn(
        "mix_block", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.col("n_blocks")))
    blocks = materialize(dealt.groupBy("mix_source", "mix_block", "epochs", "rest")
                         .agg(F.sum("mix_tokens").alias("block_tokens")), "blocks")
    turn = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("mix_block")),
                                                    "mix_block")
    before = F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("room", F.col("rest") - F.coalesce(before, F.lit(0)))
    # room for the last, partial epoch: all of the block, part of it or none
    blocks = blocks.select("mix_source", "mix_block", F.least("room", "block_tokens").alias("room"),
                           ((F.col("room") > 0) & (F.col("room") < F.col("block_tokens"))).alias("cut"))
    dealt = dealt.join(blocks, ["mix_source", "mix_block"])
    within = Window.partitionBy("mix_source", "mix_block") \
        .orderBy(F.xxhash64(F.lit(seed), F.col("epochs"), F.col(id_col)), F.col(id_col)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = dealt.filter("cut").withColumn("taken", F.sum("mix_tokens").over(within) <= F.col("room"))
    rest = dealt.filter("not cut").withColumn("taken", (F.col("rest") > 0) & (F.col("room") > 0))
    copies = F.col("epochs") + F.col("taken").cast("int")
    out = cut.unionByName(rest).filter(copies > 0) \
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    out = out.select(
        *keep, "mix_source", "mix_tokens", "mix_weight", "mix_epoch",
        F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col("mix_block")).alias("mix_block_order"),
        F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col(id_col)).alias("mix_doc_order"))
    return out.select(*[F.col(k).alias(c) for k, c in keep.items()], *[F.col(f"mix_{c}").alias(prefix + c) for c in outputs])
