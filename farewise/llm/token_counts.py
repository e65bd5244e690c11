"""Token counts of whole texts; huge documents by overlap resynchronisation.

A document of more than ``huge_chars`` characters is encoded as overlapping chunks with offsets, so that the
library never holds the encoding of more than a few chunks. Neighbouring chunks are spliced at a boundary that
both encodings have and that is proven stable: a place just after ASCII white space and before other text, where
no match of the pre-tokenizer and no normalisation reaches across (``words`` states why). The token that starts
there must have the same id in both encodings. If an overlap holds no such place, it is doubled until it does or
the chunk reaches the end of the text. Tokens of a chunk are those from its left splice to its right splice.

Shorter documents are encoded in one piece by ``PieceEncoder``.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows give one row each. A tokenizer file whose rules are
not proven to be cut safely is always applied to the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm import words
from farewise.llm.common import id_text, text_slices

HUGE_CHARS = 32_768
CHUNK_CHARS = 8_192
OVERLAP_CHARS = 128
CHUNKS_AT_ONCE = 16
TOKEN_LIMIT = 2048

#: After white space that no tokenizer drops half of, before other text: cuts of either set of rules.
_STABLE = {"spaced": re.compile(r"(?<=[ \n\t])(?=\S)"), "byte": re.compile(r"(?<=\S)(?= \S)")}

#: Special strings, and characters that are white space to one library only: their offsets are not trusted.
_ODD = re.compile("<\\||[\x00\x1c-\x1f\x85\u180e]")


class Chunks:
    """Overlapping chunks of one text and the splices between them."""

    def __init__(self, tok, mode: str, text: str, chunk: int, overlap: int):
        self.tok, self.text, self.stable = tok, text, _STABLE[mode]
        self.step, self.overlap = max(chunk, 1), max(overlap, 1)
        self.widened = 0

    def _encode(self, spans: list[tuple[int, int]]) -> list:
        return self.tok.encode_batch([self.text[a:b] for a, b in spans], add_special_tokens=False)

    @staticmethod
    def _start(enc, base: int, at: int) -> int | None:
        """Index of the token that starts at ``at``; None if there is none."""
        i = enc.char_to_token(at - base)
        if i is None or enc.token_to_chars(i)[0] != at - base:
            return None
        while i and enc.token_to_chars(i - 1)[0] == at - base:
            i -= 1
        return i

    def _splice(self, left, right) -> tuple[int, int] | None:
        """Token indexes in both encodings at the first common stable boundary of their overlap."""
        (a, b, enc_a), (c, _, enc_c) = left, right
        for m in self.stable.finditer(self.text, c + 1, b):
            i, j = self._start(enc_a, a, m.start()), self._start(enc_c, c, m.start())
            # the last token of the left chunk may be cut short by the chunk's end
            if i is not None and j is not None and i + 1 < len(enc_a) and enc_a.ids[i] == enc_c.ids[j]:
                return i, j
        return None

    def ids(self) -> Iterator[list[int]]:
        """Ids of the text, part by part in order."""
        n = len(self.text)
        starts = list(range(0, n, self.step))
        left, first = None, 0
        for lo in range(0, len(starts), CHUNKS_AT_ONCE):
            spans = [(s, min(n, s + self.step + self.overlap)) for s in starts[lo:lo + CHUNKS_AT_ONCE]]
            for (c, d), enc in zip(spans, self._encode(spans)):
                if left is None:
                    left = (c, d, enc)
                    continue
                if left[1] >= n:  # a widened chunk already reached the end
                    break
                right, wide = (c, d, enc), self.overlap
                cut = self._splice(left, right)
                while cut is None and max(left[1], right[1]) < n:
                    # widen: both sides see more text after the common start
                    self.widened += 1
                    wide *= 2
                    a, end = left[0], min(n, c + wide)
                    left = (a, end, self._encode([(a, end)])[0])
                    if end > right[1]:
                        right = (c, min(n, end + self.overlap), self._encode([(c, min(n, end + self.overlap))])[0])
                    cut = self._splice(left, right)
                if cut is None:  # no stable boundary up to the end: the left chunk takes the rest
                    left = (left[0], n, self._encode([(left[0], n)])[0])
                    break
                yield left[2].ids[first:cut[0]]
                left, first = right, cut[1]
        if left is not None:
            yield left[2].ids[first:]


def count_text(path: str, text: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS,
               overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of one text."""
    enc = words.encoder(path)
    if len(text) <= huge or enc.mode == "whole" or _ODD.search(text):
        return len(enc.encode([text])[0]) // enc.dtype.itemsize
    return sum(len(part) for part in Chunks(enc.tok, enc.mode, text, chunk, overlap).ids())


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT, huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks`` for every row; no shuffle.

    ``n_chunks`` is the number of chunks a document was cut into (1: encoded in one piece). Nulls, empty texts and
    repeated rows: see the module.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = words.encoder(path)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            huge = [len(t) > huge_chars for t in texts]
            short = iter(enc.encode([t for t, h in zip(texts, huge) if not h]))
            counts = [count_text(path, t, huge_chars, chunk_chars, overlap_chars) if h
                      else len(next(short)) // enc.dtype.itemsize for t, h in zip(texts, huge)]
            chunks = [-(-len(t) // chunk_chars) if h else 1 for t, h in zip(texts, huge)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                                   "n_tokens": pa.array(counts, pa.int64()),
                                   "n_chunks": pa.array(chunks, pa.int32())})

    rows = id_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chunks int")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
