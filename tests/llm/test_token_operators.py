"""Token counts, packing and token files against the tokenizer library itself."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from farewise.llm import packing, queries, token_counts, token_files, words
from farewise.session import scratch_path

SPACED, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "é", "É", "ß", "İ", "ς", "Σ", "'s", "'", "1", "½", "٣", "。", "中", "!",
            "...", "́", " ", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "Ħ", "the", "ing", "᠎", "🙂", "\x00",
            "ﬁ", "Ⅷ", "ª", "_", "-", "\r\n", "​"]


def library(name):
    return words.load(words.tokenizer_path(name))


@pytest.mark.parametrize("name", [SPACED, BYTE])
def test_piece_encoder_equals_library(name):
    rng = random.Random(5)
    enc, tok = words.PieceEncoder(words.tokenizer_path(name), cache_pieces=50), library(name)
    assert enc.ranks is not None
    for _ in range(1500):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 30)))
        got = np.frombuffer(enc.encode([text])[0], enc.dtype).tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", [SPACED, BYTE])
def test_columns_of_words_equal_library(name, monkeypatch):
    """Many texts at once, mostly words and marks, cut anywhere once they are long."""
    monkeypatch.setattr(words, "SLICE_BYTES", 300)
    rng = random.Random(7)
    enc, tok = words.PieceEncoder(words.tokenizer_path(name), cache_pieces=50), library(name)
    parts = ALPHABET + ["The", "wordy", "ing", "don't", "naïve", "café", "Über", ", ", ". ", "! ", "; and", ".\n", ",\n", " \n", "\n ", ".", ",", "?!",
                        "A", "zz", "ÀÉ×÷ß", "ÄÖÜ", "straße,", "÷", "Þorn.", "œuvre", "Ÿ", "e\u0301tat", "3,5", "x:y", "<|startoftext|>"]
    weights = [1] * len(ALPHABET) + [6] * (len(parts) - len(ALPHABET))
    texts = [(" " if rng.random() < 0.6 else "").join(rng.choices(parts, weights, k=rng.choice([0, 1, 3, 12, 60, 400]))) for _ in range(600)]
    for lo in range(0, len(texts), 37):
        column = pa.array(texts[lo:lo + 40], pa.string()).slice(3)
        ids, counts = enc.encode_column(column)
        want = [tok.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", [SPACED, BYTE])
def test_chunks_resynchronise_and_widen(name):
    rng, tok, widened = random.Random(6), library(name), 0
    mode = words.rules(words.tokenizer_path(name))
    plain = [x for x in ALPHABET if "<|" not in x and not token_counts._ODD.search(x)]
    for k in range(400):
        text = "".join(rng.choices(plain + ["x"] * 60 + [" "] * (k % 7), k=rng.randint(1, 200)))
        chunks = token_counts.Chunks(tok, mode, text, rng.choice([5, 17, 40]), rng.choice([1, 3, 9]))
        assert [i for part in chunks.ids() for i in part] == tok.encode(text, add_special_tokens=False).ids
        widened += chunks.widened
    assert widened


def edge_docs(spark):
    long = ("abc defg, " * 9000) + "x" * 20000 + " end"
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (3, "", "y"), (None, "no id", "z"),
            (5, long, "w"), (6, "<|endoftext|> a", "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_counts_edge_rows(spark):
    tok = library(SPACED)
    got = token_counts.token_counts(edge_docs(spark), words.tokenizer_path(SPACED)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False)))
            for r in edge_docs(spark).collect()]
    assert sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got)) == sorted((a or -1, b, c) for a, b, c in want)
    assert {r.n_chunks > 1 for r in got if r.doc_id == 5} == {True}
    assert token_counts.token_counts(edge_docs(spark).limit(0), words.tokenizer_path(SPACED)).count() == 0


def test_op1_equals_library(spark):
    tok = library(SPACED)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r.doc_id: (len(r.text.encode()), len(tok.encode(r.text, add_special_tokens=False))) for r in docs}
    got = queries.op1_token_counts(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def brute_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            left = min(fits) - n
        else:
            left = window - n
        out.append(left)
        if left:
            rooms.append(left)
    return out


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(1)
    for window in (7, 64, 100):
        lengths = np.array(sorted((rng.randint(1, window) for _ in range(200)), reverse=True))
        where, offset = packing.best_fit_decreasing(lengths, window)
        assert [window - o - n for o, n in zip(offset, lengths)] == brute_best_fit(lengths.tolist(), window)


def assert_packed(rows, texts, window=2048):
    tok = library(BYTE)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by_seq))


def test_op5_packs_every_id_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    fill = assert_packed(queries.op5_packing(spark, SF_SMALL).collect(), {r.doc_id: r.text for r in docs})
    assert fill > 0.97


def test_packing_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "word " * 9000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, words.tokenizer_path(BYTE), group_pieces=2, with_ids=True)
    assert_packed(rows.collect(), {r.doc_id: r.text for r in docs.collect()})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows.collect())
    assert packing.pack_documents(docs.limit(0), words.tokenizer_path(BYTE)).count() == 0
    twice = packing.pack_documents(docs.unionAll(docs), words.tokenizer_path(BYTE)).collect()
    assert len(twice) == 2 * rows.count()


def test_op9_round_trip(spark):
    tok = library(SPACED)
    docs = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, SF_SMALL).collect()}
    at = 0
    for r in docs:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(r.doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_token_files_edge_rows_and_single_document_access(spark):
    path, tokenizer = scratch_path(spark, "t"), words.tokenizer_path(SPACED)
    docs = edge_docs(spark)
    token_files.write_token_files(docs, path, tokenizer)
    rows = token_files.read_token_files(spark, path, with_ids=True).collect()
    assert len(rows) == 7 and [r.start for r in rows if r.doc_id is None] == [0]
    tok = library(SPACED)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.ids == [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1] for r in rows)
    one = token_files.read_token_files(spark, path, doc_ids=[5]).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in one] == [(r.doc_id, r.start, r.n_tokens)
                                                             for r in rows if r.doc_id == 5]
    held = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks").select("dict_sha256").distinct().collect()
    assert [b.dict_sha256 for b in blocks] == [hashlib.sha256(bytes(held.dictionary)).hexdigest()]
    empty = scratch_path(spark, "t")
    token_files.write_token_files(docs.limit(0), empty, tokenizer)
    assert token_files.read_token_files(spark, empty).count() == 0
