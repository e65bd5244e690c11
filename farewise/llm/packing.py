"""Packing documents into fixed windows: best-fit decreasing over remaining capacities.

A document's ids (with one end id) are first cut into full windows; what is left of it is a piece shorter than a
window. Pieces are dealt into groups of about ``group_pieces`` by row number (so a document repeated any number of
times is spread too) and each group is packed longest piece first: a segment tree over the remaining capacities
0..window finds the open window with the least room that still takes the piece. Only piece descriptions move; ids
are summed up (crc32) where they are made, or kept beside the piece with ``with_ids``.

Null and empty texts hold the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm import common, words
from farewise.llm.common import id_text, text_slices
from farewise.session import materialize

WINDOW = 2048
END_ID = 1
#: Pieces packed together; at the usual lengths a group leaves less than 0.1 % of its windows as padding.
GROUP_PIECES = 20_000


class OpenWindows:
    """Open windows by remaining capacity, as a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``least`` room, taken out; None if none has."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:  # a right child: go up to where a right neighbour exists
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        which = self.open[room].pop()
        self._add(room, -1)
        return room, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each length; ``lengths`` must be in descending order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for k, n in enumerate(lengths.tolist()):
        found = tree.take(n) if n < window else None
        if found is None:
            room, which = window, opened
            opened += 1
        else:
            room, which = found
        where[k], offset[k] = which, window - room
        if room > n:
            tree.put(room - n, which)
    return where, offset


def cut_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every row: ``doc_id, start, length, ids_crc32, doc_tokens[, ids]``."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = words.encoder(path)
        for batch in text_slices(batches):
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(raw, enc.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a:a + window].tobytes()
                    rows.append((doc, a, len(part) // 4, zlib.crc32(part), len(ids), part)[:5 + with_ids])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:5 + with_ids]
            yield pa.record_batch({n: pa.array(x, pa.binary() if n == "ids" else pa.int64())
                                   for n, x in zip(names, zip(*rows))})

    return id_text(docs, id_col, text_col).mapInArrow(common.released(run, words.encoder, words.load), fields)


def pack_pieces(pieces: DataFrame, *, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id, offset``. ``pieces`` is read twice, so pass a written table."""
    groups = max(1, -(-pieces.count() // group_pieces))
    extra = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra) + ", sequence_id long, `offset` long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="group_no").assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    # row numbers of a written table: the same whenever a task is run again
    dealt = pieces.withColumn("group_no", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group_no").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    pieces = materialize(cut_pieces(docs, path, id_col=id_col, text_col=text_col, window=window, end_id=end_id,
                                    with_ids=with_ids), "pieces")
    out = pack_pieces(pieces, window=window, group_pieces=group_pieces)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*names, *["ids"] * with_ids)
