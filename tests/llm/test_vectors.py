"""Whitening, vector codes and MinHash fingerprints against brute force, and odd tables of them."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import minhash, minhash_query, textvec, vectorcodes, vectorcodes_query, vectors, whitening, whitening_query

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, deviation long, whitened double"


def table(spark, vectors_, ids=None):
    ids = list(range(len(vectors_))) if ids is None else ids
    return spark.createDataFrame([(i, v, None if i is None or i % 3 == 0 else i % 2, "c", 7, 7, 0.5) for i, v in zip(ids, vectors_, strict=True)], SCHEMA)


ODD = [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], None, [1.0, None, 3.0, 4.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [-1.5, 0.25], [], [0.5, -0.001, 7.0, -3.0], [2.0, 2.0, 1.0, 0.0]]


# --- whole numbers ---


def test_whole_drops_and_pads():
    keep, x = vectors.whole(pa.array(ODD, pa.list_(pa.float32())), 256)
    assert keep.tolist() == [True, True, False, False, False, False, True, True, True, True]
    assert x.tolist()[2:5] == [[-384, 64, 0, 0], [0, 0, 0, 0], [128, -1, 1792, -768]]
    sliced = pa.array(ODD, pa.list_(pa.float32())).slice(6, 3)
    assert vectors.whole(sliced, 256, 4)[1].tolist() == x.tolist()[2:5]
    far, y = vectors.whole(pa.array([[1e30, -1e30, 0.1]], pa.list_(pa.float64())), 1024)
    assert far.tolist() == [True] and y.tolist() == [[2**63 - 1, -(2**63), 102]]


# --- whitening ---


def test_residues_give_the_exact_scatter():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**40), 2**40, (30, 5))
    centre = [int(c) for c in x.mean(0)]
    moduli = whitening.primes(30 * (2**41) ** 2)
    assert math.prod(moduli) > 2 * 30 * (2**41) ** 2 and all(p < 2**21 for p in moduli)
    into = np.zeros((len(moduli), 5, 5), np.int64)
    whitening.residue_scatter(x[:11], centre, moduli, into)
    whitening.residue_scatter(x[11:], centre, moduli, into)
    y = x.astype(object) - np.array(centre, object)
    assert whitening.remaindered(into.reshape(len(moduli), -1), moduli) == [int(v) for v in (y.T @ y).ravel()]


def test_whitening_equals_numpy_on_whole_table(spark):
    got = whitening_query.query(spark, FOLDER).toPandas()
    e = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    x = np.floor(256 * np.stack(e.embedding).astype(float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    values, base = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    assert (got.n == n).all() and (got.identity_error < 1e-9).all() and len(got) == 4 * len(e)
    for k in range(4):
        own = got[got.component == k + 1].set_index("vec_id").loc[e.vec_id]
        want = (x - s / n) @ base[:, -1 - k] / math.sqrt(values[-1 - k])
        assert min(np.abs(own.whitened - want).max(), np.abs(own.whitened + want).max()) < 1e-9
        assert own.deviation.tolist() == ((n * x - s) ** 2).sum(1).tolist()
        assert abs(own.explained.iloc[0] / (values[-1 - k] / values.sum()) - 1) < 1e-9


def test_whitening_of_odd_tables(spark):
    rows = table(spark, ODD + [ODD[0]], [0, 1, 2, 3, 4, 5, 6, 7, None, 9, 0])
    model = whitening.fit(rows)
    x = [[256, 512, 768, 1024], [-384, 64, 0, 0], [0, 0, 0, 0], [128, -1, 1792, -768], [512, 512, 256, 0]]
    assert model.n == 5 and list(model.sums) == np.sum(x, 0).tolist()
    y = [[Fraction(v) - Fraction(sum(c), 5) for v, c in zip(r, zip(*x, strict=True), strict=True)] for r in x]
    assert model.covariance.tolist() == [[float(sum(r[a] * r[b] for r in y) / 5) for b in range(4)] for a in range(4)]
    got = whitening.whiten(rows, model).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, i) for i in (0, 0, 1, 6, 7, 9)] + [(True, 0)]
    assert all(len(r.whitened) == 4 for r in got) and model.identity_error < 1e-9
    assert whitening.fit(rows.limit(0)) is None and whitening.whiten(rows, None).count() == 0
    assert whitening.fit(table(spark, [None, [None]])) is None


def test_whitening_without_variance_and_of_huge_numbers(spark, tmp_path):
    same = table(spark, [[1.0, 2.0]] * 3)
    model = whitening.fit(same)
    assert (model.n, model.identity_error, model.explained(0)) == (1, None, None)
    assert [r.whitened for r in whitening.whiten(same, model).collect()] == [[None, None]] * 3
    line = whitening.fit(table(spark, [[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]]))
    assert line.explained(0) == pytest.approx(1) and whitening.whiten(same, line).first().whitened[1] is None
    huge = table(spark, [[1e15, 0.0], [-1e15, 3.0], [5.0, 1.0]])
    model = whitening.fit(huge)
    assert model.identity_error < 1e-6 and [r.deviation for r in whitening.whiten(huge, model).collect()].count(None) >= 2
    same.limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening_query.query(spark, str(tmp_path)).count() == 0 and vectorcodes_query.query(spark, str(tmp_path)).count() == 0


def test_sums_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 2)
    parts = spark.createDataFrame([(k, 0, t, np.array([t, 1], np.int64).tobytes()) for k in (0, 1) for t in range(9)], vectors.CELLS)
    rows = vectors.summed(parts, 9).collect()
    assert sorted((r.kind, np.frombuffer(r.part, np.int64).tolist()) for r in rows) == [(0, [36, 9]), (1, [36, 9])]


# --- codes ---


def slow_codes(x, parts, entries, rounds):
    """Codebooks and codes by plain Python numbers; rows are in the order of their ids."""
    width = len(x[0]) // parts
    cut = [[r[p * width : (p + 1) * width] for r in x] for p in range(parts)]
    books = [rows[:entries] for rows in cut]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    near = lambda r, book: min(range(len(book)), key=lambda k: (far(r, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in cut[p]:
                own.setdefault(near(r, books[p]), []).append(r)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else b for k, b in enumerate(books[p])]
    codes = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(x))]
    return books, codes, [sum(far(cut[p][i], books[p][c]) for p, c in enumerate(code)) for i, code in enumerate(codes)]


def test_codes_equal_sql_on_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    found = vectorcodes_query.query(spark, FOLDER)
    want = con.sql(vectorcodes_query.SQL)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("most", [3, 500, 1 << 40])
def test_codes_equal_brute_force(spark, most):
    rng = np.random.default_rng(most % 97)
    x = rng.integers(-most, most, (60, 8))
    x[40:] = x[:20]  # repeated rows, and ties between equal entries
    rows = spark.createDataFrame([(i, [float(v) / 1024 for v in r]) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    books = vectorcodes.learn(rows, 4, 16, 3)
    want, codes, errors = slow_codes(x.tolist(), 4, 16, 3)
    assert books.entries.tolist() == want and books.wide == (most > 1 << 30)
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.encode(rows, books).collect()}
    assert got == {i: ("".join(f"{c:02x}" for c in code), e if e < 1 << 63 else None) for i, (code, e) in enumerate(zip(codes, errors, strict=True))}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.sampled_from([1, 7, 1 << 20, 1 << 27]), st.integers(0, 1 << 30))
def test_screening_never_loses_the_nearest(width, most, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most + 1, (12, width))
    entries[6:9] = entries[:3]
    x = np.concatenate([entries, entries + rng.integers(-1, 2, entries.shape), rng.integers(-most, most + 1, (9, width))])
    at, far = vectorcodes.nearest(x, entries)
    exact = [[sum((int(u) - int(v)) ** 2 for u, v in zip(r, e, strict=True)) for e in entries] for r in x]
    assert at.tolist() == [d.index(min(d)) for d in exact] and far.tolist() == [min(d) for d in exact]


def test_codes_of_odd_tables(spark):
    rows = table(spark, ODD + [ODD[8]], [5, 4, 2, 3, 4, 5, 6, 7, None, 9, 4])
    books = vectorcodes.learn(rows)
    assert books.entries.shape == (4, 7, 1)  # fewer vectors than entries
    got = vectorcodes.with_label_errors(vectorcodes.encode(rows, books, also=("label",))).collect()
    assert len(got) == 7 and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}
    uneven = vectorcodes.learn(table(spark, [[1.0, 2.0, 3.0]]))
    assert uneven.entries.tolist() == [[[1024]], [[2048]], [[3072]], [[0]]]
    none = vectorcodes.learn(rows.limit(0))
    assert vectorcodes.encode(rows, none).count() == 0 and none.sha256() == hashlib.sha256(b"").hexdigest()


# --- fingerprints ---


def test_fingerprints_on_whole_table(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    got = minhash_query.query(spark, FOLDER).toPandas().set_index("doc_id").loc[docs.doc_id]
    edits = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    sets = lambda all_: [set(g[a:b].tolist()) for g, at in [minhash.shingled(pa.array(all_))] for a, b in zip(at[:-1], at[1:], strict=True)]
    own, theirs = sets(texts), sets(edits)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    exact = np.array([alike(a, b) for a, b in zip(own, theirs, strict=True)])
    assert np.abs(got.near_edited - exact).mean() < 0.045 and np.abs(got.near_edited - exact).max() < 0.25  # 0.034 is to be expected of 125 values at 0.33
    shown = got.jaccard_edited.notna()
    assert np.allclose(got.jaccard_edited[shown], exact[shown.to_numpy()])
    decoded = lambda f: np.frombuffer(bytes.fromhex(f), ">u2")
    assert all((decoded(a) == decoded(b)).mean() == n for a, b, n in zip(got.fingerprint, got.edited_fingerprint, got.near_edited, strict=True))
    assert all((decoded(a) == decoded(b)).mean() == n for a, b, n in zip(got.fingerprint, np.roll(got.fingerprint, -1), got.near_next, strict=True))
    assert len({(t, f) for t, f in zip(texts, got.fingerprint, strict=True)}) == len(set(texts))


def test_values_are_least_values_of_permutations():
    grams, at = minhash.shingled(pa.array(["one two three four five six seven", "", "a b"]))
    values = minhash.signatures(grams, at)
    for k in (0, 17, minhash.PERMUTATIONS - 1):
        low = min((int(g) * int(minhash._FACTORS[k]) + int(minhash._SHIFTS[k])) % 2**64 for g in grams[at[0] : at[1]])
        assert values[0, k] == int(textvec.mixed(np.array([low], np.uint64))[0]) >> 48
    assert (values[1] == minhash.BLANK).all() and at.tolist() == [0, 3, 3, 4]


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_order_of_odd_tables(spark, buckets):
    texts = {7: "seven a", 3: "three " * 9, 11: "", 2: None, 5: "five b c d e f"}
    rows = [(i, t, "x") for i, t in texts.items()] + [(5, "another five", "x"), (None, "lost one", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)
    got = [(r.bucket, r.guest, r.doc_id, r.text) for r in minhash.in_order(docs, buckets).collect()]
    hashes = {r.t: r.h for r in spark.sql("select t, xxhash64(t) as h from values ('lost one'), ('') as v(t)").collect()}
    order = sorted(((i is None, i or 0, hashes[t or ""] if i is None else 0, t or "") for i, t, _ in rows))
    flat = [(None if none else i, t) for none, i, _, t in order]
    following = {flat[k]: flat[(k + 1) % len(flat)] for k in range(len(flat))}
    found = {}
    for b in {g[0] for g in got}:
        own = [g for g in got if g[0] == b]
        chain = [g for g in own if not g[1]] + [g for g in own if g[1]][:1]
        found |= {(a[2], a[3]): (n[2], n[3]) for a, n in zip(chain, chain[1:], strict=False)}
    assert found == following


def test_fingerprints_of_odd_tables(spark):
    one = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    r = minhash.compared(one).first()
    assert (r.edited, r.n_chars, r.near_next) == ("ab ab", 5, 1.0)
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "x"), (4, "\U0001f600é" * 3), (None, "x"), (5, "long " * 60_000)], "doc_id long, text string")
    rows = minhash.compared(docs).collect()
    assert len(rows) == 7 and {r.near_edited for r in rows if r.n_chars < 2} == {1.0}
    assert [r.edited for r in rows if r.doc_id == 4] == ["\U0001f600é\U0001f600lon"]
    assert minhash.compared(docs.limit(0)).count() == 0


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = docs.where("doc_id is not null").toPandas().sort_values("doc_id")
    grams, at = minhash.shingled(pa.array(rows.text.fillna("").tolist()))
    sets = [set(grams[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    ids, links, root = rows.doc_id.tolist(), {}, {}
    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.setdefault(ids[a], set()).add(ids[b])
                links.setdefault(ids[b], set()).add(ids[a])
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (root[i], len(links.get(i, ()))) for i in ids}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
