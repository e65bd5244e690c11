"""Token ids as compressed binary blocks with an offset index and one shared dictionary.

Layout below ``path`` (all written and read by Spark, so any shared store works and a lost task is run again):

* ``blocks``: rows of up to ``BLOCK_BYTES`` of payload or ``BLOCK_DOCS`` documents in ascending doc_id order.
  ``payload`` is a run of zstandard frames, one per document, of its ids as little-endian unsigned integers of
  ``id_bytes`` bytes; ``doc_ids``, ``offsets`` and ``n_tokens`` are the index: one document is read by opening
  one frame. ``part`` and ``token_start`` place the block; ``dict_sha256`` names the dictionary.
* ``dictionary``: the dictionary, trained on the id arrays of a bounded sample of documents.
* ``parts``: the ids before each part (one row per part).

Null and empty texts hold the end id alone; null doc_ids come first; repeated rows are kept, in text order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.llm import words
from farewise.llm.common import id_text, shuffle_partitions, text_slices

END_ID = 1
#: Documents the dictionary is trained on (about; all documents if there are fewer).
DICT_SAMPLE_DOCS = 2_000
DICT_BYTES = 64 << 10
#: A training sample is a piece of an id array of at most this size.
DICT_PIECE_BYTES = 16 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096

BLOCK_SCHEMA = ("part int, token_start long, n_block_tokens long, first_doc long, last_doc long, id_bytes int, "
                "dict_sha256 string, doc_ids array<long>, offsets array<long>, n_tokens array<long>, payload binary")


def _ids(enc: words.PieceEncoder, texts: list[str], end_id: int) -> list[bytes]:
    end = np.array([end_id], enc.dtype).tobytes()
    return [raw + end for raw in enc.encode(texts)]


def train_dictionary(docs: DataFrame, path: str, *, end_id: int = END_ID, sample_docs: int = DICT_SAMPLE_DOCS,
                     dict_bytes: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from a hash sample of about ``sample_docs`` rows; b'' if there is too little text."""
    total = docs.count()
    if not total:
        return b""
    share = min(1.0, sample_docs / total)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pieces = words.encoder(path), []
        for batch in text_slices(batches):
            for raw in _ids(enc, batch.column("text").to_pylist(), end_id):
                pieces += [raw[a:a + DICT_PIECE_BYTES] for a in range(0, len(raw), DICT_PIECE_BYTES)]
        try:
            made = zstandard.train_dictionary(dict_bytes, sorted(pieces)).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            made = b""
        yield pa.record_batch({"d": pa.array([made], pa.binary())})

    rows = sample.repartition(1).mapInArrow(run, "d binary").collect()
    return bytes(rows[0].d) if rows else b""


def _compressor(dictionary: bytes, level: int):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=shared)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, level: int = LEVEL, sample_docs: int = DICT_SAMPLE_DOCS) -> None:
    """Encode every row and write the files; one range shuffle of the texts by doc_id."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    dictionary = train_dictionary(rows, tokenizer, end_id=end_id, sample_docs=sample_docs)
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = words.encoder(tokenizer), _compressor(dictionary, level)
        part, size = TaskContext.get().partitionId(), enc.dtype.itemsize
        done, ids, frames, counts = 0, [], [], []

        def block() -> pa.RecordBatch:
            sizes = np.array([len(f) for f in frames], np.int64)
            row = {"part": part, "token_start": done, "n_block_tokens": sum(counts), "first_doc": ids[0],
                   "last_doc": ids[-1], "id_bytes": size, "dict_sha256": digest, "doc_ids": ids,
                   "offsets": [0, *np.cumsum(sizes).tolist()], "n_tokens": counts, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        held = 0
        for batch in text_slices(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), _ids(enc, batch.column("text").to_pylist(), end_id)):
                frame = press.compress(raw)
                ids.append(doc)
                frames.append(frame)
                counts.append(len(raw) // size)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    done, held, ids, frames, counts = done + sum(counts), 0, [], [], []
        if ids:
            yield block()

    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    # one row per part: as many as the write had tasks
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_block_tokens").alias("n")).collect()
    before, bases = 0, []
    for part, n in sorted((r.part, r.n) for r in sums):
        bases.append((part, before))
        before += n
    spark.createDataFrame(bases, "part int, part_start long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/parts")


BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("token_start", pa.int64()), ("n_block_tokens", pa.int64()), ("first_doc", pa.int64()),
    ("last_doc", pa.int64()), ("id_bytes", pa.int32()), ("dict_sha256", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("payload", pa.binary())])


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_sha256:
        raise ValueError(f"{path}: the dictionary does not match its hash")
    return row.dict_sha256, bytes(row.dictionary)


def read_token_files(spark: SparkSession, path: str, *, with_ids: bool = False,
                     doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document, or of ``doc_ids`` alone.

    With ``doc_ids`` only blocks whose range can hold one of them are read and only their frames are opened.
    """
    digest, dictionary = _dictionary(spark, path)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    if wanted is not None:
        hit = F.lit(False)
        for d in sorted(wanted):
            hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
        blocks = blocks.filter(hit)
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_frame = _decompressor(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, out = row["part_start"] + row["token_start"], []
                kind = np.dtype(f"<u{row['id_bytes']}")
                view = memoryview(row["payload"])
                for doc, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], row["offsets"][1:]):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(open_frame.decompress(view[a:b]), kind).astype("<u4")
                        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                    at += n
                if out:
                    cols = dict(zip(["doc_id", "start", "n_tokens", "ids_crc32", "ids"], zip(*out)))
                    if not with_ids:
                        cols.pop("ids")
                    yield pa.record_batch({k: pa.array(v, pa.list_(pa.int64()) if k == "ids" else pa.int64())
                                           for k, v in cols.items()})

    parts = spark.read.parquet(f"{path}/parts")
    return blocks.join(F.broadcast(parts), "part").mapInArrow(run, fields)
