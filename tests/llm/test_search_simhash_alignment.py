"""Ranked search, SimHash near-duplicates and cross-tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewise.llm import alignment, queries, ranked, simhash, words

ODD_TEXTS = [None, "", " ", "\t\n", "one", "two words", "One, TWO; three-four", "x" * 3000, "Ärger über Öl ÄRGER", "naïve space",
             "a\x00b \x1c c\x85d", "tabs\tand\nlines\r\nand  two", "<|endoftext|> in a text", "▁ mark", "日本語 のテキスト です",
             "emoji 👩‍👩‍👧 zwj", "trailing space ", "  leading", "a b", "it's they'll 1234 5.67", "﻿bom", "end\n\n\n"]


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def texts_of(spark):
    return {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}


def frame(spark, texts, **clash):
    """Rows (doc_id, text) with extra columns of the names the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    for name in ("n", "terms", "score", "query", "rank", "point", "cell", "component_id", "links", "text_key", "copies", "n_a", "lang"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# -- ranked search -------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for doc, bag in bags:
            score = 0
            for term, c in asked.items():
                if bag[term]:
                    m = 75 + 25 * sum(bag.values()) * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += c * w * (1000000000 * bag[term] // (1000 * bag[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(scored)[:k])]
    return out


def key(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def test_op11_against_duckdb(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = [tuple(r) for r in queries.op11_ranked_search(spark, SF_SMALL).collect()]
    assert got and sorted(got) == sorted(con.sql(ranked.ORACLE).fetchall())


@pytest.mark.parametrize("leaf,shard,step", [(128, 8192, 16), (2, 64, 3), (1, 7, 1)])
def test_search_against_brute_force(spark, monkeypatch, leaf, shard, step):
    for name, value in (("LEAF", leaf), ("SHARD_DOCS", shard), ("STEP", step), ("SLICE_BYTES", 64)):
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(leaf)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    docs += [(300 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(5, docs[5][1]), (5, docs[9][1]), (None, docs[7][1]), (None, None)]
    docs += [(400, " ".join(rng.choices(vocab, k=60_000)))]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, docs[7][1]), (54, docs[7][1]), (None, items[2][1]), (55, "W1 w1, W1!"),
              (56, "Ärger ärger")]
    got = ranked.search(frame(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string")
                        .withColumn("query", F.lit(1)).withColumn("doc_id", F.lit(2)), k=5, block_queries=6)
    assert key(tuple(r) for r in got.collect()) == key(brute_search(docs, items, 5))


def test_search_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(docs, items).collect()] == [(1, 1, 1)]


def test_interval_bounds_hold(spark):
    rng = np.random.default_rng(5)
    packed = [np.stack([t := np.sort(rng.choice(20, rng.integers(1, 9), replace=False)), rng.integers(1, 9, len(t))])
              .astype("<u4").tobytes() for _ in range(200)]
    sizes = rng.integers(10, 90, 200)
    shard = ranked.Shard(list(range(200)), sizes, packed, rng.integers(1, 5000, 20), 200, int(sizes.sum()))
    term, times = np.array([1, 4, 7, 11]), np.array([2, 1, 1, 3])
    _, every = shard.scores(term, times, np.array([0]), np.array([199]))
    places, _ = shard.scores(term, times, np.array([0]), np.array([199]))
    full = np.zeros(200, np.int64)
    full[places] = every
    for _ in range(200):
        lo, hi = np.sort(rng.integers(0, 200, 2))
        bound, at = shard.bounds(term, times, np.array([lo]), np.array([hi]))
        assert bound[0] >= full[lo:hi + 1].max()
        assert not bound[0] or lo <= at[0] <= hi


# -- SimHash -------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").translate(LOWER).encode()) if x]
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=3):
    """Least index reachable, per index."""
    label = list(range(len(points)))
    x = np.array(points, np.uint64)
    changed = True
    near = [np.flatnonzero(np.bitwise_count(x ^ p) <= radius) for p in x]
    while changed:
        changed = False
        for i, some in enumerate(near):
            least = min(label[j] for j in some)
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_op12_against_brute_force(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    points = [brute_fingerprint(texts[i]) for i in ids]
    want = sorted((i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, points, brute_components(points)))
    got = [tuple(r) for r in queries.op12_simhash(spark, SF_SMALL).collect()]
    assert sorted(got) == want and len({c for _, _, c in want}) < len(want)


def test_simhash_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE_BYTES", 50)
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(10 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "Three Words here"), (3, "other text of its own"), (4, "three  words\nHERE"),
            (None, "three words here"), (None, "lonely null row text"), (7, long), (8, long + " more")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    points = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(points)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    assert key(tuple(r) for r in got) == key((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, points, label))
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_slices_change_no_shingle():
    text = " ".join(f"w{i}" for i in range(500)).encode()
    whole = [x for some in simhash.shingle_hashes(text) for x in some]
    for size in (1, 2, 7, 64, 1000):
        assert [x for some in simhash.shingle_hashes(text, slice_bytes=size) for x in some] == whole
    big = np.array(whole * 40, np.uint64)
    assert simhash.majority(big, np.array([len(big)]))[0] == simhash.majority(np.array(whole, np.uint64), np.array([len(whole)]))[0]


@pytest.mark.parametrize("width,groups", [(2, 6), (1, 8), (1, 16)])
def test_embedding_is_a_lower_bound(width, groups):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**64, (2, 2000), np.uint64)
    far = np.bitwise_count(x ^ y)
    bound = np.bitwise_count(simhash.embed(x, width) ^ simhash.embed(y, width))
    counts = [[bin(int(v) >> s & (1 << width) - 1).count("1") for s in range(0, 64, width)] for v in (x[0], y[0])]
    assert (bound <= far).all() and bound[0] == sum(abs(a - b) for a, b in zip(*counts))
    masks = simhash.group_masks(groups, width)
    assert sum(masks) == 2**64 - 1 and all((a & b) == 0 for a in masks for b in masks if a != b)


@pytest.mark.parametrize("cell_points", [8192, 40, 4])
def test_range_join_keeps_every_component(spark, cell_points):
    """One dense group of near copies, chains of single bits and noise; small cells force the finer grids."""
    rng = np.random.default_rng(cell_points)
    centre = rng.integers(0, 2**64, 1, np.uint64)[0]
    points = {int(v) for v in rng.integers(0, 2**64, 300, np.uint64)}
    for _ in range(400):
        flips = rng.choice(64, rng.integers(0, 6), replace=False)
        points.add(int(centre) ^ sum(1 << int(b) for b in flips))
    step = int(rng.integers(0, 2**63))
    for i in range(12):
        step ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        points.add(step)
    points = sorted(points)
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "point long")
    links = simhash.range_join(df, cell_points=cell_points).collect()
    at = {simhash._signed(p): i for i, p in enumerate(points)}
    assert all(bin(points[at[r.u]] ^ points[at[r.v]]).count("1") <= 3 for r in links)
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in links:
        a, b = root(at[r.u]), root(at[r.v])
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(points))] == brute_components(points)
    assert len(links) < 6 * len(points)


# -- alignment -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def files():
    return words.tokenizer_path("byte_bpe_50k.json"), words.tokenizer_path("piece_bpe_32k.model")


def brute_align(text, tok, model, bytes_a, bytes_b):
    """(tokens of A, of B, groups, links) of one text, by the libraries on the whole text."""
    if not text:
        return [], [], [], []
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
        return [], [], [], []
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((bytes_a, a), (bytes_b, b)))
    cuts = sorted(set(ends_a) & set(ends_b))
    groups, lo = [], 0
    for hi in cuts:
        groups.append("|".join(",".join(map(str, ids[bisect_right(ends, lo):bisect_right(ends, hi)]))
                               for ids, ends in ((a, ends_a), (b, ends_b))))
        lo = hi
    end_a, end_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
    links = [(end_a[c], end_b[c]) for c in cuts]
    return a, b, groups, links


def brute_measures(rows, files):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(files[0])
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=files[1])
    bytes_a, bytes_b = alignment.vocabulary_a(files[0]).tokens, alignment.vocabulary_b(model).tokens
    made = [(i, *brute_align(t, tok, model, bytes_a, bytes_b)) for i, t in rows]
    count = Counter(x for *_, links in made for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, groups, links in made]


def test_op13_against_brute_force(spark, files):
    got = [tuple(r) for r in queries.op13_alignment(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(brute_measures(texts_of(spark).items(), files))


def test_alignment_edge_rows(spark, files):
    some = [t for t in texts_of(spark).values() if t][:6]
    rows = [(10 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(50 + i, t) for i, t in enumerate(some)]
    rows += [(50, some[0]), (51, some[0]), (None, some[0]), (None, None), (60, "long " + "word, other; " * 20_000)]
    got = alignment.align_documents(frame(spark, rows).repartition(4), *files).collect()
    assert key(tuple(r) for r in got) == key(brute_measures(rows, files))
    assert alignment.align_documents(frame(spark, rows).limit(0), *files).count() == 0


def test_pieces_align_as_whole_texts(files):
    """Random strings of the characters that the cuts could go wrong at."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(files[0])
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=files[1])
    both = alignment.Aligner(*files, cache_pieces=50, segment_chars=3)
    assert both.cuts
    rng = random.Random(11)
    parts = ["a", "the", "'s", "'", " ", "  ", "\n", "\t", "1", "23", ".", ",", "é", "ß", "日本", "👩", "\u2003", "\u200b", "\u0301", "-", "_",
             "<s>", "<|endoftext|>", "\r\n", "Ing", "tion", "\u2581", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rng.choices(parts, weights=[4 if p in (" ", "the", "a") else 1 for p in parts], k=rng.randint(1, 25)))
             for _ in range(1500)] + ["", " ", "a ", " a"]
    assert sum(len(both.segments(t)) > 1 for t in texts) > 500
    counts, digests, links = both.align(texts)
    lo = 0
    for text, (n_a, n_b, n), digest in zip(texts, counts.tolist(), digests):
        a, b, want, pairs = brute_align(text, tok, model, both.a.tokens, both.b.tokens)
        assert (n_a, n_b, n) == (len(a), len(b), len(want)), repr(text)
        assert digest == (hashlib.sha256(";".join(want).encode()).hexdigest() if a else "")
        packed = links[lo:lo + n].tolist()
        assert [(x >> 32, x & 0xFFFFFFFF) for x in packed] == pairs
        lo += n
    assert lo == len(links)


def test_pair_table_is_bounded_by_the_vocabularies(files):
    """Linked tokens share their last bytes, the bound of the table that goes to all tasks."""
    both = alignment.Aligner(*files)
    _, _, links = both.align(["Wordings of sundry unusual compositions, 1234 times over; naïveté"])
    assert len(links) > 10
    for x in links.tolist():
        a, b = both.a.tokens[x >> 32], both.b.tokens[x & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)
