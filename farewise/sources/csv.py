"""CSV ingest with explicit schema and reject handling.

Malformed lines (unparsable cells, wrong token count) are detected with a
PERMISSIVE read and a corrupt-record column. Which rows Spark flags depends
on which columns a query parses, so the ingest job parses every column once
and writes kept rows and rejects to Parquet in a single pass (partitioned by
a reject flag). The counts of an ingest are observed during that write;
later reads of the rejects can name the cells that failed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.config import TRIP_SCHEMA
from farewise.operators.quality import rule_counts

CORRUPT_COL = "_corrupt_record"
REJECT_FLAG = "_rejected"
REASONS = "reject_reasons"
FIELD_COUNT = "field_count"
UNNAMED = "other"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
TS_WRITE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _options(time_zone: str | None) -> dict[str, str]:
    options = {"timestampNTZFormat": TS_FORMAT, "timestampFormat": TS_FORMAT}
    return options | {"timeZone": time_zone} if time_zone else options


def _reader(spark: SparkSession, schema: T.StructType, mode: str, header: bool, check_header: bool = False,
            time_zone: str | None = None):
    reader = (spark.read.option("header", header).option("mode", mode).option("enforceSchema", not check_header)
              .options(**_options(time_zone)))
    if mode == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COL, T.StringType(), True)])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.schema(schema)


def _paths(paths: str | Sequence[str]) -> str | list[str]:
    return paths if isinstance(paths, str) else list(paths)


def read_csv_flagged(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = TRIP_SCHEMA,
                     header: bool = True, check_header: bool = False, time_zone: str | None = None) -> DataFrame:
    """All lines with a boolean ``_rejected``; reject lines keep their parsable cells.

    ``check_header`` fails the scan on a file whose header does not name the
    schema's columns in their order (the schema is positional, so columns of
    another order would be read under wrong names). ``time_zone`` is the zone
    of the cells of TIMESTAMP columns (default: the session's); TIMESTAMP_NTZ
    columns keep the wall clock.
    """
    df = _reader(spark, schema, "PERMISSIVE", header, check_header, time_zone).csv(_paths(paths))
    return df.withColumn(REJECT_FLAG, F.col(CORRUPT_COL).isNotNull())


def ingest_csv(spark: SparkSession, paths: str | Sequence[str], out_path: str,
               schema: T.StructType = TRIP_SCHEMA, header: bool = True, check_header: bool = False,
               time_zone: str | None = None) -> str:
    """One pass: parse every column, write kept rows and rejects under ``out_path``."""
    flagged = read_csv_flagged(spark, paths, schema, header, check_header, time_zone)
    flagged.write.mode("overwrite").partitionBy(REJECT_FLAG).parquet(out_path)
    return out_path


def ingest_csv_observed(spark: SparkSession, paths: str | Sequence[str], out_path: str,
                        schema: T.StructType = TRIP_SCHEMA, header: bool = True, check_header: bool = False,
                        time_zone: str | None = None) -> dict[str, int]:
    """``ingest_csv`` with the ingest report counted by the writing job itself: no later scan.

    kept / rejected lines, rows and rule violations of the kept rows, columns.
    The write has no shuffle and each of its tasks counts once, when it
    succeeds, so retried or speculative tasks do not count twice.
    """
    flagged = read_csv_flagged(spark, paths, schema, header, check_header, time_zone)
    kept = ~F.col(REJECT_FLAG)
    seen = Observation("ingest")
    counts = [F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.count_if(kept).alias("rows"),
              *rule_counts(schema.fieldNames(), within=kept)]
    flagged.observe(seen, *counts).write.mode("overwrite").partitionBy(REJECT_FLAG).parquet(out_path)
    return {**seen.get, "columns": len(schema.fields)}


def file_headers(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = TRIP_SCHEMA) -> DataFrame:
    """One row per non-empty file: its header line, whether it names the schema's columns in order, the first that differs.

    ``first_difference`` is the 1-based position (null if none). Names compare
    without regard to case and outer blanks. The first lines come from one
    text scan (the least row of each file's first block, combined per task).
    """
    lines = spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("value"))
    first = lines.filter(F.col("_start") == 0).groupBy("file").agg(F.min_by("value", "_row").alias("header"))
    names = F.transform(F.split("header", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '^"|"$', ""))))
    wanted = F.array(*[F.lit(n.lower()) for n in schema.fieldNames()])
    differs = F.transform(F.arrays_zip(names.alias("found"), wanted.alias("wanted")),
                          lambda pair: ~pair["found"].eqNullSafe(pair["wanted"]))
    position = F.array_position(differs, True)
    return first.select("file", "header", (position == 0).alias("matches"),
                        F.nullif(position, F.lit(0)).cast("int").alias("first_difference"))


def _cell_fails(cell: Column, field: T.StructField, time_zone: str | None) -> Column:
    """Whether the CSV parser refuses one cell under its type (the same parser as the scan's)."""
    schema = T.StructType([T.StructField("c", field.dataType), T.StructField(CORRUPT_COL, T.StringType())])
    options = _options(time_zone) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    text = F.to_csv(F.struct(cell.alias("c")), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    parsed = F.from_csv(text, F.lit(schema.simpleString()[7:-1].replace(":", " ")), options)
    return cell.isNotNull() & parsed[CORRUPT_COL].isNotNull()


def reject_reasons(rejects: DataFrame, schema: T.StructType = TRIP_SCHEMA, time_zone: str | None = None) -> DataFrame:
    """Add ``reject_reasons`` to the rejects of an ingest (``read_ingested(..., rejected=True)``).

    An array in schema order: the columns whose cells the parser refused, then
    ``field_count`` if the line has not as many fields as the schema, or
    ``other`` if neither is the case. The kept text of the line is parsed again
    into plain strings; only rejects are read, no shuffle.
    """
    texts = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(schema.fields))],
                          T.StructField(CORRUPT_COL, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    ddl = ", ".join(f"{f.name} string" for f in texts.fields)
    cells = F.from_csv(F.col(CORRUPT_COL), F.lit(ddl), options)
    out = rejects.withColumn("_cells", cells)
    named = [F.when(_cell_fails(F.col("_cells")[f"c{i}"], field, time_zone), F.lit(field.name))
             for i, field in enumerate(schema.fields) if not isinstance(field.dataType, T.StringType)]
    named.append(F.when(F.col("_cells")[CORRUPT_COL].isNotNull(), F.lit(FIELD_COUNT)))
    found = F.array_compact(F.array(*named))
    return out.withColumn(REASONS, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNNAMED)))).drop("_cells")


def reject_counts(rejects: DataFrame, schema: T.StructType = TRIP_SCHEMA, time_zone: str | None = None) -> DataFrame:
    """Lines per reject reason; a line with several reasons counts under each."""
    reasons = reject_reasons(rejects, schema, time_zone).select(F.explode(REASONS).alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def read_ingested(spark: SparkSession, out_path: str, rejected: bool = False) -> DataFrame:
    """Kept rows (default) or rejects of an ingest output (partition pruning on the flag)."""
    df = spark.read.parquet(out_path).filter(F.col(REJECT_FLAG) == F.lit(rejected))
    return df.drop(REJECT_FLAG, CORRUPT_COL) if not rejected else df.drop(REJECT_FLAG)


def ingest_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """kept / rejected line counts of an ingest output (one aggregate over the flag)."""
    df = spark.read.parquet(out_path)
    return df.agg(F.count_if(~F.col(REJECT_FLAG)).alias("kept"), F.count_if(F.col(REJECT_FLAG)).alias("rejected"))


def read_trips_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = TRIP_SCHEMA,
                   on_bad: str = "drop", header: bool = True, out_path: str | None = None) -> DataFrame:
    """Multi-file CSV scan under a fixed positional schema.

    on_bad="drop": malformed lines are removed. When ``out_path`` is given the
    ingest is materialised there first (exact whatever columns are read later);
    otherwise kept rows are filtered lazily from a full parse.
    on_bad="fail": the first malformed line raises.
    """
    if on_bad == "fail":
        return _reader(spark, schema, "FAILFAST", header).csv(_paths(paths))
    if on_bad != "drop":
        raise ValueError("on_bad must be 'drop' or 'fail'")
    if out_path:
        return read_ingested(spark, ingest_csv(spark, paths, out_path, schema, header))
    flagged = read_csv_flagged(spark, paths, schema, header)
    return flagged.filter(~F.col(REJECT_FLAG)).select(*schema.fieldNames())


def write_csv(df: DataFrame, path: str, header: bool = True, single_file: bool = False) -> str:
    """CSV sink keeping microseconds of timestamps; ``single_file`` coalesces to one part."""
    if single_file:
        df = df.coalesce(1)
    (df.write.mode("overwrite").option("header", header)
     .option("timestampNTZFormat", TS_WRITE_FORMAT).option("timestampFormat", TS_WRITE_FORMAT).csv(path))
    return path
