"""Cross-tokenizer alignment, each distinct text once.

1. Texts are shuffled whole and counted, so that every distinct text is tokenised and aligned by one task once, however many
   documents bear it; its multiplicity weighs its pair counts.
2. Both tokenizers see the text with one leading space (B adds it itself). Where both have a token that ends at the same byte,
   the text is cut into groups, and the two tokens that end there are linked. Tokens are never empty, so a group has one link.
   A slice of texts is aligned at once: its tokens' ends are running sums over both id arrays, its common ends a look-up.
3. A text of more than ``SEGMENT_CHARS`` is given to B in segments that start at a space after other text, so that B never
   holds more: B has no piece with a space mark after other text (tested when the file is loaded), so its merges never reach across.
4. Tasks sum their pair counts, weighted; Spark sums them over tasks. Two tokens that end together have one's bytes at the
   end of the other's, so there are at most as many pairs as the two vocabularies have bytes (times the ids that share their bytes):
   this table, whose size does not depend on the corpus, goes to all tasks.
5. The links of each distinct text, kept from step 2, are looked up in it, and the measures join the documents by the SHA-256 of the text.

Null and empty texts, and texts whose joined tokens of A or B are not the text with its space (B writes spaces for U+2581), have no
tokens: zeros and an empty ``groups_sha256``. Strings of special tokens are plain text. Texts of any length are aligned whole. Repeated rows,
and rows with a null doc_id, give one row each and count each. An empty table gives an empty result. Only ``id_col`` and ``text_col`` are
read, so other columns may bear any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.llm import words
from farewise.llm.common import id_text, text_slices
from farewise.session import materialize

#: Pieces that A's encoder remembers per Python worker.
CACHE_PIECES = 300_000
#: Characters of a text given to B at once (and the rest up to the next cut).
SEGMENT_CHARS = 32_768
#: Text aligned at once; the arrays of a slice take some eighty times as much.
SLICE_BYTES = 1 << 20
#: Entries of a task's pair counts held before they are summed.
HELD_PAIRS = 1_000_000
MARK = "\u2581"

_CUT = re.compile(r"(?<=[^\s\u2581]) (?=.)", re.DOTALL)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabulary:
    """Bytes of the ids of a tokenizer, one after another."""

    def __init__(self, tokens: list[bytes]):
        if not all(tokens):
            raise ValueError("a vocabulary holds an empty token")
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


def vocabulary_a(path: str) -> Vocabulary:
    """A byte-level vocabulary; other entries are written as they are."""
    tok, symbols = words.load(path), words.byte_symbols()
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
    return Vocabulary(out)


def vocabulary_b(model) -> Vocabulary:
    """A piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Vocabulary([bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces])


def group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes from ids and the marks of each group's last tokens; and where each token of B ends."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_a, before_b = (np.append(0, np.flatnonzero(x) + 1) for x in (last_a, last_b))
    slot_a, slot_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[slot_a], ids[slot_b] = a, b
    mark[slot_a], mark[slot_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits, most = np.ones(len(ids), np.int64), int(ids.max())
    power = 10
    while power <= most:
        digits += ids >= power
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1], np.uint8)
    out[ends - 1] = mark
    at, left = ends - 2, ids
    while len(at):
        out[at] = 48 + left % 10
        left = left // 10
        more = left > 0
        at, left = at[more] - 1, left[more]
    return out, ends[slot_b]


class Aligner:
    """Groups and links of whole texts under two tokenizer files."""

    def __init__(self, path_a: str, path_b: str, cache_pieces: int = CACHE_PIECES, segment_chars: int = SEGMENT_CHARS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.enc = words.PieceEncoder(path_a, cache_pieces)
        plain = Tokenizer.from_file(path_a)
        plain.no_truncation()
        plain.no_padding()
        plain.encode_special_tokens = True  # their strings are ordinary text
        self.enc.tok = plain
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a, self.b = vocabulary_a(path_a), vocabulary_b(self.model)
        self.segment = segment_chars
        inner = any(b" " in t.lstrip(b" ") for t in self.b.tokens)
        self.cuts = not inner and self.model.encode("x  y z") == [i for t in ("x", " y", "z") for i in self.model.encode(t)]

    def segments(self, text: str) -> list[str]:
        """Parts of a text between spaces that B's merges do not cross; the spaces are those B puts before each part."""
        out, lo = [], 0
        while self.cuts and len(text) - lo > self.segment and (cut := _CUT.search(text, lo + self.segment)):
            out.append(text[lo:cut.start()])
            lo = cut.end()
        return [*out, text[lo:]]

    def _ids_b(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.segments(t) for t in texts]
        flat = [p for some in parts for p in some]
        made: list[np.ndarray] = []
        for lo in range(0, len(flat), 64):
            made += [np.array(x, np.int64) for x in self.model.encode(flat[lo:lo + 64], num_threads=1)]
        ids = iter(made)
        return [np.concatenate([next(ids) for _ in some]) for some in parts]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Per text its tokens of A, of B and groups, and the digest of its groups; all links in order as ``a << 32 | b``."""
        counts, digests = np.zeros((len(texts), 3), np.int64), [""] * len(texts)
        live = [i for i, t in enumerate(texts) if t]
        ids_a = [np.frombuffer(x, self.enc.dtype).astype(np.int64) for x in self.enc.encode([" " + texts[i] for i in live])]
        kept, all_a, all_b = [], [], []
        for i, a, b in zip(live, ids_a, self._ids_b([texts[i] for i in live])):
            whole = (" " + texts[i]).encode()
            if self.a.joined(a) == whole and self.b.joined(b) == whole:
                kept.append(i)
                all_a.append(a)
                all_b.append(b)
        if not kept:
            return counts, digests, np.zeros(0, np.uint64)
        counts[kept, 0], counts[kept, 1] = [len(a) for a in all_a], [len(b) for b in all_b]
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.zeros((2, end_a[-1] + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]
        counts[kept, 2] = np.add.reduceat(last_a, np.append(0, np.cumsum(counts[kept, 0])[:-1]), dtype=np.int64)
        written, stops = group_texts(a, b, last_a, last_b)
        lo, view = 0, memoryview(written)
        for i, hi in zip(kept, stops[np.cumsum(counts[kept, 1]) - 1].tolist()):
            digests[i] = hashlib.sha256(view[lo:hi - 1]).hexdigest()
            lo = hi
        return counts, digests, a[last_a].astype(np.uint64) << np.uint64(32) | b[last_b].astype(np.uint64)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of files."""
    return Aligner(path_a, path_b)


class PairCounts:
    """Weighted counts of packed pairs, summed whenever many have gathered."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HELD_PAIRS:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([*self.keys, np.zeros(0, np.uint64)])
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, counts)
        self.keys, self.counts, self.held = [keys], [sums], 0
        return keys, sums


def _align_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per distinct text its measures and links; per task, with a null ``text_key``, its weighted pair counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, pairs = aligner(path_a, path_b), PairCounts()
        for batch in text_slices(batches, limit=SLICE_BYTES):
            counts, digests, links = both.align(batch.column("text").to_pylist())
            pairs.add(links, np.repeat(batch.column("copies").to_numpy(), counts[:, 2]))
            stops = np.cumsum(counts[:, 2]).tolist()
            packed = [links[lo:hi].tobytes() for lo, hi in zip([0, *stops], stops)]
            yield pa.record_batch({
                "text_key": batch.column("text_key"), **{c: pa.array(counts[:, j]) for j, c in enumerate(("n_a", "n_b", "n_groups"))},
                "groups_sha256": pa.array(digests, pa.string()), "links": pa.array(packed, pa.binary()),
                "counts": pa.nulls(len(packed), pa.binary())})
        keys, sums = pairs.total()
        if len(keys):
            yield pa.record_batch({
                "text_key": pa.nulls(1, pa.binary()), **{c: pa.array([0], pa.int64()) for c in ("n_a", "n_b", "n_groups")},
                "groups_sha256": pa.array([""]), "links": pa.array([keys.tobytes()], pa.binary()),
                "counts": pa.array([sums.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "text_key binary, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, "
                                 "counts binary")


def pair_counts(made: DataFrame) -> DataFrame:
    """``a, b, n``: how many links of the corpus hold each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sums in zip(batch.column("links").to_pylist(), batch.column("counts").to_pylist()):
                keys = np.frombuffer(keys, np.uint64)
                yield pa.record_batch({"a": pa.array((keys >> np.uint64(32)).astype(np.int32)),
                                       "b": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int32)),
                                       "n": pa.array(np.frombuffer(sums, np.int64))})

    sums = made.filter("text_key is null").select("links", "counts").mapInArrow(run, "a int, b int, n long")
    return sums.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    text_key = F.unhex(F.sha2("text", 256))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    made = materialize(_align_texts(texts.withColumn("text_key", text_key), path_a, path_b), "aligned")
    found = pair_counts(made).toArrow()  # bounded by the vocabularies, see the module
    keys = found.column("a").to_numpy().astype(np.uint64) << np.uint64(32) | found.column("b").to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    keys, n = keys[order], found.column("n").to_numpy()[order]
    ids_b = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.zeros(int(ids_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, ids_b, n)
    shared = spark.sparkContext.broadcast((keys, n, n == most[ids_b]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            cols = {c: batch.column(c) for c in ("text_key", "n_a", "n_b", "n_groups", "groups_sha256")}
            n_best, total = [], []
            for links in batch.column("links").to_pylist():
                at = np.searchsorted(known, np.frombuffer(links, np.uint64))
                n_best.append(int(np.count_nonzero(best[at])))
                total.append(int(count[at].sum()))
            yield pa.record_batch(cols | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())})

    measures = made.filter("text_key is not null").mapInArrow(
        measure, "text_key binary, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    full = rows.filter("text <> ''").select("doc_id", text_key.alias("text_key")).join(measures, "text_key") \
        .withColumn("n_links", F.col("n_groups")).select(*names)
    zero = [F.lit(0).cast("long").alias(c) for c in names[1:-1]]
    return full.unionByName(rows.filter("text = ''").select("doc_id", *zero, F.lit("").alias("groups_sha256")))
