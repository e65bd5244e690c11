"""Corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which ``run`` writes as Parquet and reads again as the next
one's docs. All but the last return the columns of ``documents``. A stage keeps every row that its operator does
not decide against: null and empty texts, repeated rows and null ids pass through as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.llm import jaccard, mixing, packing, repeats, toxicity, words
from farewise.llm.common import drop_keys, free_name, table
from farewise.session import materialize

#: No source is repeated more than this, and every document is kept at least once.
MAX_REPETITION = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    names = docs.columns
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(names)}
    scored = toxicity.score(docs.withColumnsRenamed(plain), machine, keep=list(plain.values()))
    return scored.filter("predicted = 0").select(*[F.col(p).alias(c) for c, p in plain.items()])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each class of the Jaccard join stays.

    Where a doc_id stands in several rows, its texts are classed each for itself: rows of one id whose texts do not link all stay.
    """
    classes = materialize(jaccard.jaccard_classes(docs), "classes")
    others = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = drop_keys(docs, materialize(others, "others"), "doc_id")
    repeated = classes.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1")
    repeated = materialize(repeated.select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    return _keep_one_text_of_each(docs)


def _keep_one_text_of_each(docs: DataFrame) -> DataFrame:
    """As above by rows of equal doc_id and text; the least doc_id stays, among its texts any one that is the same in each run."""
    row = free_name(docs.columns, "row_key")
    keyed = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))))
    keyed = materialize(keyed, "keyed")
    classes = jaccard.jaccard_classes(keyed.select(F.col(row).alias("key"), "text"), id_col="key") \
        .filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("class"), F.count("*").alias("rows"))
    classes = materialize(classes.withColumnRenamed("doc_id", row), "text-classes")
    first = keyed.select(row, "doc_id").distinct().join(classes, row).groupBy("class").agg(F.min(F.struct("doc_id", row)).alias("least"))
    others = materialize(classes.join(first.select(F.col(f"least.{row}").alias(row)), row, "left_anti").select(row), "other-texts")
    twice = materialize(classes.filter("rows > 1").select(row), "rows-twice")
    kept = drop_keys(keyed, others, row)
    once = kept.join(twice, row, "left_semi").select(*kept.columns).dropDuplicates([row])
    return drop_keys(kept, twice, row).unionByName(once).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that stand more than once are cut out of every text."""
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated towards equal weights, up to ``MAX_REPETITION``."""
    mixed = mixing.mix_sources(docs, max_repetition=MAX_REPETITION, prefix=free_name(docs.columns, "mix_"))
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows."""
    return packing.pack_documents(docs, words.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_each), ("suffix_dedup", cut_repeats),
          ("source_mixing", mix), ("packing", pack)]

#: The fitted model, the tokenizer and the hash orders are beyond SQL: see tests/llm/test_joins_and_repeats.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
