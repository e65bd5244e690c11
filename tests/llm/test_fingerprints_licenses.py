"""Fingerprints against plain Python; licence scans against DuckDB and small texts."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewise.llm import fingerprints as fp
from farewise.llm import licenses, queries


def edited(texts):
    """doc_id -> edited text, by the contract, with plain string slices."""
    order = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        third = len(t) // 3
        out[d] = t[:len(t) - third] + nxt[:third]
    return out


def true_jaccard(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    x, y = shingles(a.lower()), shingles(b.lower())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_op7_against_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want, rows = edited(texts), queries.op7_fingerprints(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    errors = []
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors.append(abs(r.near_edited - true_jaccard(texts[r.doc_id], want[r.doc_id])))
    assert sum(errors) / len(errors) < 0.05


def test_fingerprint_edge_rows(spark):
    rows = [(1, "Same text here"), (2, "same TEXT  here"), (3, None), (4, ""), (4, ""), (5, "é" * 9 + " a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit("clash"))
    got = fp.fingerprints(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6
    assert by[1].fingerprint == by[2].fingerprint != ""
    assert by[3].fingerprint == by[4].fingerprint == "" and by[4].near_next == 1.0 and by[2].near_next == 1.0
    assert by[5].edited_sha256 == hashlib.sha256(("é" * 9 + " a b c d e f")[:14].encode() + b"").hexdigest()
    first = next(r for r in got if r.doc_id == 1)  # the last in order takes the first row's text
    assert first.edited_sha256 == hashlib.sha256(("Same text here"[:10] + "é" * 4).encode()).hexdigest()
    assert fp.fingerprints(docs.limit(0)).count() == 0
    one = fp.fingerprints(docs.filter("doc_id = 1")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"Same text Same").hexdigest() and one[0].near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    df = spark.range(1).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("w"), i)), " ").alias("t"))
    df = df.withColumn("half", F.array_join(F.slice(F.split("t", " "), 1, 1502), " ")) \
        .withColumn("rest", F.array_join(F.slice(F.split("t", " "), 1499, 1502), " "))
    s = fp.sketches(df, {"t": "a", "half": "b", "rest": "c"})
    r = s.select("a", fp.merge(F.col("b"), F.col("c")).alias("m"), fp.containment(F.col("b"), F.col("a")).alias("in_a"),
                 fp.distinct_shingles(F.col("a")).alias("n"), fp.resemblance(F.col("a"), F.col("b")).alias("j")).first()
    assert r.a == r.m
    assert abs(r.n - 2996) < 1000 and abs(r.j - 0.5) < 0.2 and r.in_a > 0.7


def test_op10_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = sorted(map(str, con.sql(licenses.oracle()).fetchall()))
    got = [(r.doc_id, r.digest, r.license_id, r.notice_ids) for r in queries.op10_license_scan(spark, SF_SMALL).collect()]
    assert sorted(map(str, got)) == want
    assert any(r[3] for r in got)


def test_license_edge_rows(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    body = next(t for i, t in licenses.KNOWN if t.startswith("Permission is hereby"))
    rows = [(1, "MIT LICENSE\n\nCopyright (c) 2019 Some One\nAll rights reserved.\n\n" + body.replace("\n", "  ")),
            (2, body.replace('"', "”")), (3, None), (4, ""), (5, "..!"), (6, "text\nReleased under the MIT licence\nmore"),
            (6, "text\nReleased under the MIT licence\nmore"), (7, mit + " extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = licenses.license_scan(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    assert by[1].license_id == by[2].license_id == "MIT"
    assert [by[i].digest for i in (3, 4, 5)] == [None] * 3
    assert by[6].license_id is None and by[6].notice_ids == "MIT" and by[7].license_id is None
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_whole_texts_and_lines_without_the_word(spark):
    text = lambda name: (licenses.TEXTS / name).read_text(encoding="utf-8")
    files = {"Apache-2.0": "Apache-2.0.txt", "BSD-2-Clause": "BSD-2-Clause.txt", "BSD-3-Clause": "BSD-3-Clause.txt",
             "GPL-2.0": "GPL-2.0.txt", "GPL-3.0": "GPL-3.0.txt", "LGPL-2.1": "LGPL-2.1.txt", "LGPL-3.0": "LGPL-3.0.txt",
             "MPL-2.0": "MPL-2.0.txt", "Unlicense": "Unlicense.txt", "CC0-1.0": "CC0-1.0.txt", "CC-BY-SA-4.0": "CC-BY-SA-4.0.txt"}
    rows = [(i, text(f).upper(), n) for i, (n, f) in enumerate(files.items())]
    gpl = text("GPL-3.0.txt")
    rows += [(20, gpl[gpl.index("Everyone is permitted"):], "GPL-3.0"),
             (21, "Copyright 2020 Some One\n\n" + text("Apache-2.0~notice.txt"), "Apache-2.0"),
             (22, "BSD 2-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n"
              + text("BSD-2-Clause.txt").split("\n", 2)[2], "BSD-2-Clause")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.license_scan(docs).collect()}
    assert got == {i: n for i, _, n in rows}
    lines = spark.createDataFrame([(1, "a\n" + licenses._ISC.replace("\n", " ") + "\nb"), (2, "x\nAll mine, ask me\n")],
                                  "doc_id long, text string")
    assert {r.doc_id: r.notice_ids for r in licenses.license_scan(lines).collect()} == {1: "ISC", 2: None}
    own = spark.createDataFrame([("own", "All mine: ask me!")], "license_id string, text string")
    assert {r.doc_id: r.notice_ids for r in licenses.license_scan(lines, own).collect()} == {1: None, 2: "own"}


def test_no_line_is_lost_by_its_first_word(spark):
    """Lines that equal a known text only after a spelling, a mark or a rights line is rewritten."""
    known = spark.createDataFrame([("L1", "Sublicense it."), ("L2", "version 2 only"), ("L3", "License: X"), ("L4", "released freely")],
                                  "license_id string, text string")
    lines = ["sub licence IT!", "“sub license” it", "  -- v2 only", "V2  ONLY.", "licence x", " LICENSE - x", "(License:) X?",
             "All rights reserved.\rReleased freely", "all released freely", "v3 only", "sub it", "", "…", "released, freely"]
    docs = spark.createDataFrame([(i, f"prose before\n{t}\nprose after") for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.notice_ids for r in licenses.license_scan(docs, known).collect()}
    digests = {r.digest: r.license_id for r in licenses.known_digests(known).collect()}
    plain = spark.createDataFrame(list(enumerate(lines)), "doc_id long, line string")
    want = {r.doc_id: digests.get(r.digest) for r in plain.select("doc_id", licenses.digest(F.col("line")).alias("digest")).collect()}
    assert got == want and sum(v is not None for v in want.values()) >= 9
