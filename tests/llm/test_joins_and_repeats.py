"""Top-k, Jaccard classes, repeats, toxicity, mixing and the pipeline against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from farewise.llm import jaccard, mixing, queries, repeats, suffixes, topk, toxicity
from farewise.session import materialize


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


# -- top-k ---------------------------------------------------------------------------------------------------------

def test_op2_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = [tuple(r) for r in queries.op2_maxscore(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(con.sql(topk.ORACLE).fetchall())


def test_top_k_edge_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 0, 0, 1, -2])) for _ in range(12)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, [float("inf")]), (None, [1.0]), (5, rows[5][1]),
             (64, [3e15, 1.0]), (65, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, k=3, scale=1, query_block=4, shard_rows=16).collect()
    live = {i: [int(np.floor(x)) for x in v] + [0] * (12 - len(v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in live if i % 4 == 0):
        scores = sorted((-sum(a * b for a, b in zip(live[q], live[c])), c) for c in live if c != q)[:3]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted((q, r, c, min(s, 2**63 - 1)) for q, r, c, s in want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


@pytest.mark.parametrize("others", [[[0.0, -1.0]], [[0.0, 0.0]]])
def test_zero_vectors_compete_below_a_floor_of_zero(spark, others):
    # the first shard fills the list with scores of -1 or 0, later ones hold zero vectors of smaller ids
    rows = [(100 + i, [0.0] * 7 + [1.0]) for i in range(4)] + [(i, [0.0] * 8) for i in range(1, 4)] \
        + [(50 + i, [0.0] * 6 + others[0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 100, k=2, scale=1, shard_rows=2).collect()
    want = sorted((-(v[7]), i) for i, v in rows if i != 100)[:2]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, -s) for s, i in want]
    low = topk.top_k(df.filter("vec_id < 100 or vec_id = 100"), F.col("vec_id") == 100, k=2, scale=1, shard_rows=2).collect()
    assert [r.vec_id for r in sorted(low, key=lambda r: r.rank)] == [1, 2]


# -- Jaccard classes -----------------------------------------------------------------------------------------------

def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op4_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, SF_SMALL).collect()}
    assert got == brute_classes(texts)


def test_a_pair_apart_is_passed_on_by_one_list_only(spark):
    sig = bytes(8)
    rows = [(lst, 3, name, 10, True, sig, name, [x for x in (11, 12, 13) if x < lst])
            for lst in (11, 12, 13) for name in (1, 2, 3)]
    rows += [(12, 3, 4, 10, True, sig, 4, []), (13, 3, 4, 10, True, sig, 4, [12])]
    tiles = spark.createDataFrame(rows, "list long, band int, name long, n long, home boolean, signature binary, label long, "
                                        "before array<long>")
    # a signature of no bits bounds nothing away
    pairs = [(r.a, r.b) for r in jaccard._tile_pairs(tiles, 75, -1).collect()]
    assert sorted(pairs) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_lists_end_at_gaps_of_size(spark):
    texts = [(k, " ".join(f"w{i}" for i in range(k))) for k in (14, 16, 60, 64, 70, 400, 420)]  # nested, so all share shingles
    rows = jaccard.id_text(spark.createDataFrame(texts, "doc_id long, text string"))
    lists = {}
    for r in jaccard._lists(rows, 6, 75, np.zeros(1 << jaccard.FILTER_BITS, bool)).collect():
        lists.setdefault(r.list, []).append(r.n)
    assert any(max(n) == 416 for n in lists.values()) and any(max(n) == 66 for n in lists.values())
    for n in lists.values():
        n.sort()
        assert len(n) > 1 and all(100 * a >= 75 * b for a, b in zip(n, n[1:]))


def test_tiles_name_sets_without_partners_and_mark_what_is_left(spark):
    fields = "list long, band int, name long, n long, home boolean, signature binary, label long, before array<long>"
    near, far = bytes(8), b"\xff" * 8
    rows = [(11, 3, 1, 10, True, near, 1, None), (11, 3, 2, 10, True, near, 2, None), (11, 3, 3, 10, True, far, 3, None),
            (12, 3, 1, 10, True, near, 1, None), (12, 3, 3, 10, True, far, 3, None)]
    got = jaccard._tile_pairs(spark.createDataFrame(rows, fields), 75, 0, alone=True).collect()
    assert sorted((r.a, r.b) for r in got if r.list is None) == [(1, 2)]
    assert sorted((r.list, r.band, r.a) for r in got if r.list is not None) == [(11, 3, 3), (12, 3, 1), (12, 3, 3)]
    rows = [(lst, 3, k, 10, True, near, k, []) for lst, most in ((11, 3 * jaccard.FEW_APART), (12, 3)) for k in range(most)]
    got = jaccard._tile_pairs(spark.createDataFrame(rows, fields), 75, 1).collect()
    assert [(r.list, r.band) for r in got if r.a == r.b] == [(11, 3)]
    assert {(0, 1), (0, 2), (1, 2)} <= {(r.a, r.b) for r in got}


def test_jaccard_large_group_and_edge_rows(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = {1: None, 2: "", 3: "one two", 4: "One  TWO", 5: " \n", 6: "É é a b c d", 7: "é É a b c d"}
    for i in range(10, 110):  # near copies at about the threshold, so that forests fail and rounds follow
        words = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 1, 2, 2])):
            words[k] = f"x{rng.randint(0, 9)}"
        texts[i] = " ".join(words)
    texts[200] = "to to to to to of of of of of to to to to to"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("name", F.lit("clash"))
    got = jaccard.jaccard_classes(df.repartition(3), common_above=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(texts)
    assert len(jaccard.jaccard_classes(df.unionAll(df)).collect()) == 2 * len(texts)
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


# -- repeats -------------------------------------------------------------------------------------------------------

def brute_repeats(texts, length):
    raw = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(t[p:p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        hit = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                hit[p:p + length] = b"\x01" * length
        spans = sum(1 for k in range(len(t)) if hit[k] and (not k or not hit[k - 1]))
        kept = bytes(x for x, h in zip(t, hit) if not h)
        out.append((i, len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order_equals_sorting():
    rng = random.Random(2)
    for _ in range(300):
        most = rng.choice([1, 2, 3, 10])
        t = []
        for _ in range(rng.randint(1, 4)):
            t += [rng.randint(1, most) for _ in range(rng.randint(1, 40))] + [0]
        keys = [tuple(t[i:i + 20]) for i in suffixes.suffix_order(np.array(t), most + 1, 20)]
        assert len(keys) == len(t) and keys == sorted(keys)


def test_op8_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = queries.op8_repeats(spark, SF_SMALL).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows, 200)


def test_repeats_edge_rows(spark):
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdé\x00 ", k=40))
    rows = [(1, None), (2, ""), (3, "a" * 90), (3, "a" * 90), (4, shared + "x" + shared), (5, "y" + shared[:30]),
            (6, "".join(rng.choices("abc", k=500))), (None, "zz" + shared), (8, "short"), (8, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = repeats.remove_repeats(df, length=12, gram=5).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows, 12)
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    cut = repeats.without_repeats(df, length=12, gram=5)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert {r.text for r in cut.collect() if r.doc_id in (3, 8)} == {"", "short"}


def test_heavy_anchors_are_dealt_by_windows(spark, monkeypatch):
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh", k=60))
    rows = [(i, "".join(rng.choices("abcdefgh", k=rng.randint(0, 40))) + passage[:rng.randint(30, 60)]
             + "".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(250)]
    rows += [(i, "zz" * 30 + passage * 2) for i in (900, 901)] + [(910, "ab" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 24)
    for heavy in (0, 2000, 1 << 40):  # every anchor, those of the passage, none
        got = repeats.remove_repeats(df, length=24, gram=8, heavy_bytes=heavy).collect()
        assert sorted([tuple(r) for r in got], key=str) == want
    sorted_at_once = []
    plain = repeats._windows
    monkeypatch.setattr(repeats, "_windows", lambda s, n: sorted_at_once.append(s) or plain(s, n))
    repeats.remove_repeats(df, length=24, gram=8, heavy_bytes=2000).collect()
    size = F.sum(F.octet_length("segment") + F.size("keys") * 16)
    assert all(r.n <= 2000 for r in sorted_at_once[0].groupBy("anchor").agg(size.alias("n")).collect())


def test_texts_with_heavy_anchors_are_cut(spark, monkeypatch):
    passage = "".join(random.Random(12).choices("abcdefgh", k=60))
    rows = [(i, chr(65 + i) * 3 + passage + chr(65 + i) * 2) for i in range(20)] + [(30, "short"), (31, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = repeats.heavy_anchors
    monkeypatch.setattr(repeats, "heavy_anchors", lambda segments, _: plain(segments, 0))
    got = {r.doc_id: r.text for r in repeats.without_repeats(df, length=24, gram=8).collect()}
    assert got == {i: chr(65 + i) * 5 for i in range(20)} | {30: "short", 31: None}


# -- toxicity ------------------------------------------------------------------------------------------------------

def test_machine_learns_an_interaction():
    rng = random.Random(1)
    docs, labels = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = {rng.choice("abcdefgh") * 2 for _ in range(4)} | ({"insult"} if insult else {"praise"}) \
            | ({"group"} if group else {"object"})
        docs.append(words)
        labels.append(int(insult == group))  # no single word says anything
    hashes_kept = toxicity.MIN_Z
    toxicity.MIN_Z = 0.0
    try:
        m = toxicity.fit(docs[:1000], labels[:1000])
    finally:
        toxicity.MIN_Z = hashes_kept
    index = {int(h): i for i, h in enumerate(m.hashes)}
    z = [m.logit(np.array(sorted({index[h] for w in d for h in toxicity.term_hashes(w) if h in index})))
         for d in docs[1000:]]
    assert np.mean([(a > 0) == (b == 1) for a, b in zip(z, labels[1000:])]) > 0.9


def test_machine_learns_an_interaction_with_production_constants():
    rng = random.Random(5)
    docs, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append({f"w{rng.randrange(300)}q" for _ in range(40)} | ({"insult"} if insult else {"praise"})
                    | ({"group"} if group else {"object"}))
        labels.append(int(insult == group))  # no single word says anything
    m = toxicity.fit(docs[:2000], labels[:2000])
    index = {int(h): i for i, h in enumerate(m.hashes)}
    assert {toxicity.term_hashes(w)[0] for w in ("insult", "praise", "group", "object")} <= set(index)
    z = [m.logit(np.array(sorted({index[h] for w in d for h in toxicity.term_hashes(w) if h in index}), np.int64))
         for d in docs[2000:]]
    assert np.mean([(a > 0) == (b == 1) for a, b in zip(z, labels[2000:])]) > 0.9


def test_machine_without_telling_terms_has_the_share_of_toxic_rows():
    m = toxicity.fit([{f"w{i % 7}"} for i in range(140)], [int(i < 70) for i in range(140)])
    assert not len(m.hashes) and abs(m.logit(np.zeros(0, np.int64))) < 1


def test_fit_holds_each_word_once():
    rng = random.Random(9)
    words = [f"{rng.getrandbits(40):x}" for _ in range(4000)]
    docs = [[*rng.sample(words, 300), "insult" if i % 2 else "praise"] for i in range(600)]
    labels = [i % 2 for i in range(600)]
    toxicity.fit([{"a"}, {"b"}], [0, 1])  # what is loaded at first use does not count
    tracemalloc.start()
    try:
        m = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * 600 * 301  # bytes for each word of a row; held as lists of hashes, rows took 110
    index = {int(h): i for i, h in enumerate(m.hashes)}
    assert {toxicity.term_hashes(w)[0] for w in ("insult", "praise")} <= set(index)
    z = [m.logit(np.array(sorted({index[h] for w in d for h in toxicity.term_hashes(w) if h in index}), np.int64)) for d in docs]
    assert [x > 0 for x in z] == [t == 1 for t in labels]


def test_machine_is_the_same_for_numbers_in_any_order():
    rng = random.Random(3)
    docs = [{f"w{rng.randrange(200)}" for _ in range(30)} | {"bad" if i % 3 == 0 else "good"} for i in range(400)]
    labels = [int(i % 3 == 0) for i in range(400)]
    first, again = toxicity.fit(docs, labels), toxicity.fit([sorted(d) for d in docs], labels)
    assert len(first.hashes) and first.bias == again.bias
    assert all((getattr(first, c) == getattr(again, c)).all() for c in ("hashes", "weights", "factors"))


def test_op3_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    # a few hundred toxic training rows: terms of the rest are not known (0.99 recall with 20,000 labelled rows)
    toxic, other = ([r.score for r in held if r.toxic == t] for t in (1, 0))
    a, b = np.array(toxic)[:, None], np.array(other)[None, :]
    assert np.mean(a > b) + np.mean(a == b) / 2 > 0.95
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.8
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.01


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs.withColumn("score", F.lit("clash")), none).collect()
    assert len(got) == 4 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


# -- mixing --------------------------------------------------------------------------------------------------------

def mixed_docs(spark):
    rows = [(i, "w " * 10, "big" if i < 600 else f"s{i % 3}") for i in range(1000)] + [(2000, None, "none"), (2001, "a", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_meets_repetition_limit_and_loses_nothing(spark):
    docs = mixed_docs(spark).filter("source <> 'none' and source is not null")
    rows = mixing.mix_sources(docs, max_repetition=2.0, block_tokens=400).collect()
    count = Counter(r.doc_id for r in rows)
    assert set(count) == set(range(1000)) and set(count.values()) <= {1, 2}
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.mix_tokens
    assert tokens["big"] == 6000
    assert all(abs(tokens[f"s{k}"] / (10 * sum(i % 3 == k for i in range(600, 1000))) - 2) < 0.02 for k in range(3))


def test_mixing_meets_entropy_and_budget(spark):
    docs = mixed_docs(spark).filter("source <> 'none' and source is not null")
    rows = mixing.mix_sources(docs, entropy_share=0.95, budget_tokens=5000, block_tokens=400).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.mix_source] += r.mix_tokens
    p = np.array(list(tokens.values())) / sum(tokens.values())
    assert abs(sum(tokens.values()) - 5000) <= 4 * 10
    assert abs(-(p * np.log(p)).sum() / np.log(4) - 0.95) < 0.01
    again = mixing.mix_sources(docs.repartition(7), entropy_share=0.95, budget_tokens=5000, block_tokens=400)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again.collect()))


def test_mixing_edge_rows(spark):
    docs = mixed_docs(spark)
    ids = Counter(r.doc_id for r in mixing.mix_sources(docs, max_repetition=1.5).collect())
    assert {2000, 2001} <= set(ids)
    assert mixing.mix_sources(docs.limit(0), max_repetition=1.5).count() == 0
    blank = docs.filter("doc_id = 2000")
    assert mixing.mix_sources(blank, max_repetition=1.5).count() == 1


def test_mixing_takes_any_column_names(spark):
    docs = mixed_docs(spark)
    odd = ["rest", "epochs", "n_blocks", "room", "cut", "taken", "mix_weight", "MIX_block", "mix_id", "mix_0", "source_tokens", "block_tokens"]
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in odd})
    plain = mixing.mix_sources(docs, max_repetition=1.5)
    got = mixing.mix_sources(clash, max_repetition=1.5)
    assert Counter(map(tuple, got.select(*plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert got.filter("rest <> 'own rest' or mix_0 <> 'own mix_0'").count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "suffix_dedup", "source_mixing", "packing"]
    clean = stages["toxicity"](spark, docs, SF_SMALL)
    verdict = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, SF_SMALL).collect()}
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, p in verdict.items() if not p}
    one = stages["ngram_jaccard_join"](spark, clean, SF_SMALL)
    classes = brute_classes({r.doc_id: r.text for r in clean.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in classes.items() if c == i)
    cut = stages["suffix_dedup"](spark, one, SF_SMALL)
    want = {r[0]: r[2] for r in brute_repeats([(r.doc_id, r.text) for r in one.collect()], 200)}
    before = {r.doc_id: r.text for r in one.collect()}
    for r in cut.collect():
        lost = len(before[r.doc_id].encode()) - len(r.text.encode())
        assert want[r.doc_id] <= lost <= want[r.doc_id] + 6 and r.n_chars == len(r.text)
        assert lost or r.text == before[r.doc_id]
    mixed = stages["source_mixing"](spark, cut, SF_SMALL)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in cut.collect()}
    rows = stages["packing"](spark, mixed, SF_SMALL)
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_takes_any_column_names(spark):
    docs = documents(spark).limit(40)
    odd = ["score", "predicted", "held_out", "repeats_key", "repeats_kept", "rest", "mix_weight", "mix_epoch", "row_key", "key", "kept"]
    docs = materialize(docs.withColumns({c: F.lit(f"own {c}") for c in odd}), "odd")
    names, changed = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        changed = materialize(stage(spark, changed, SF_SMALL), name)
        assert changed.columns == names
        assert changed.filter(" or ".join(f"{c} <> 'own {c}'" for c in odd)).count() == 0
    assert changed.count() > 0


def test_rows_of_one_id_with_unlinked_texts_stay(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(7, a), (7, b), (7, b), (9, a), (8, c), (5, b), (None, a), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit(1))
    kept = corpus_pipeline.keep_one_of_each(spark, materialize(docs, "rows"), SF_SMALL).collect()
    # b stays in row 5 (the least id), a in row 7 and as the text without an id
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(7, a), (8, c), (5, b), (0, a), (3, ""), (3, "")])


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_edge_rows(spark, empty):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "x y " * 100, None, "a", 400),
            (4, "x y " * 100, None, "b", 400), (None, "q r s t u v", "en", "b", 11)]
    docs = spark.createDataFrame([] if empty else rows, documents(spark).schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).cache()
    ids = {r.doc_id for r in docs.collect()}
    assert ids == (set() if empty else {1, 2, 3, None})
