"""Document fingerprints: bottom-k sketches of shingle hashes, built with SQL functions only.

A text's words are split at ASCII white space with A-Z lower-cased; each run of five words is one shingle (all words
as one if there are fewer), hashed to 64 bits. The sketch is the ``k`` smallest distinct hashes in ascending
order. Sketches of parts merge to the sketch of the whole, and two sketches estimate resemblance, containment and
the number of distinct shingles. The fingerprint is the sketch in hexadecimal.

Null and empty texts, and texts of white space alone, have the empty sketch. Two empty sketches resemble each other
fully (1.0), an empty and another one not at all. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.llm.common import id_text, shuffle_partitions

K = 64
SHINGLE_WORDS = 5
SPACE = "[\\x20\\x09-\\x0D]+"
_HALF = 2.0 ** 63
_LEAST = -(2 ** 63)


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word, in order."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = SHINGLE_WORDS) -> Column:
    """Hash of each run of ``n`` words; all words as one if there are fewer, none without words."""
    last = F.size(hashes) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    return (F.when(last >= 0, runs)
            .when(F.size(hashes) > 0, F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " "))))
            .otherwise(F.array().cast("array<bigint>")))


def sketches(df: DataFrame, columns: dict[str, str], k: int = K) -> DataFrame:
    """Adds, for each (text column: new column) of ``columns``, the bottom-k sketch as an ascending array of longs."""
    keep = df.columns
    step = df.select(*keep, *[word_hashes(F.col(t)).alias(f"{s}_words") for t, s in columns.items()])
    step = step.select(*keep, *[shingle_hashes(F.col(f"{s}_words")).alias(f"{s}_all") for s in columns.values()])
    return step.select(*keep, *[F.slice(F.sort_array(F.array_distinct(f"{s}_all")), 1, k).alias(s)
                                for s in columns.values()])


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    total = F.least(F.lit(k), F.size(F.array_union(a, b)))
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total).cast("double")


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(_HALF)) / F.lit(2 * _HALF)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has; 1.0 for an empty first set."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(df: DataFrame, value: str, out: str, key: str = "doc_id", tie: str = "text") -> DataFrame:
    """Adds ``out``: ``value`` of the next row in descending (key, tie) order; the last row takes the first row's.

    Rows are dealt into key ranges of about equal size, each its own window; the last row of a range takes its value
    from the head of the next range. Only one row per range is handled beyond its window. Null keys come last.
    """
    order = F.coalesce(F.col(key), F.lit(_LEAST))
    ranges = shuffle_partitions(df.sparkSession)
    cuts = sorted(set(df.select(order.cast("double").alias("k")).approxQuantile(
        "k", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    cuts = [int(c) for c in cuts]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = df.withColumn("_order", order).withColumn(
        "_range", F.size(F.filter(bounds, lambda c: c >= F.col("_order"))))
    down = Window.partitionBy("_range").orderBy(F.col("_order").desc(), F.col(tie).desc())
    inside = ranged.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(down))
    # heads: the first row of each range; few rows, found by their keys
    tops = ranged.groupBy("_range").agg(F.max("_order").alias("_order"))
    tops = [(r["_range"], r["_order"]) for r in tops.collect()]  # one small row per range
    tops.sort()
    if not tops:
        return df.withColumn(out, F.col(value))
    after = [(r, tops[(i + 1) % len(tops)][1]) for i, (r, _) in enumerate(tops)]
    spark = df.sparkSession
    want = spark.createDataFrame(after, "_range int, _order long")
    first = (df.withColumn("_order", order).join(F.broadcast(want.select("_order").distinct()), "_order", "left_semi")
             .withColumn("_n", F.row_number().over(Window.partitionBy("_order").orderBy(F.col(tie).desc())))
             .filter("_n = 1").select("_order", F.col(value).alias("_head")))
    edge = want.join(first, "_order").select("_range", "_head")
    joined = inside.join(edge, "_range", "left")
    return joined.withColumn(out, F.when(F.col("_next").isNotNull(), F.col("_next.v")).otherwise(F.col("_head"))) \
        .drop("_order", "_range", "_next", "_head")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and estimates.

    The edited text replaces the last third of a text with the start of the next document's, in descending doc_id
    order with the first document after the last.
    """
    rows = sketches(id_text(docs, id_col, text_col), {"text": "sketch"}, k)
    rows = rows.withColumn("self", F.struct("text", "sketch"))
    rows = with_next(rows, "self", "following").drop("self")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third),
                      F.substring(F.col("following.text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch",
                       F.col("following.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = sketches(rows, {"edited": "edited_sketch"}, k)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("in_edited"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles_estimate"))
