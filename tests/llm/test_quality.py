"""Held-out accuracy, and results against brute force over whole small tables."""

from collections import Counter

import regex

from lakewarden.llm import queries

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = queries.queries()


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").collect() if r.lang}
    rows = [r for r in QUERIES["op4_langid"](spark, MORE).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_toxicity_of_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in QUERIES["op1_toxicity"](spark, MORE).collect() if r.doc_id in truth]
    seen = Counter((r.held_out, truth[r.doc_id], r.predicted) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    for held in (True, False):  # those that were not learned from, and the others
        assert seen[held, 1, 1] > seen[held, 1, 0] and seen[held, 0, 1] <= 0.05 * seen[held, 0, 0]


def test_jaccard_against_all_pairs(spark):
    docs = {r.doc_id: regex.findall(r"[\p{L}\p{M}\p{N}]+", (r.text or "").lower()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in docs.items()}
    links = {d: [e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])] for d in sets}
    root = {d: d for d in sets}
    for _ in sets:
        new = {d: min([root[d], *(root[e] for e in links[d])]) for d in sets}
        if new == root:
            break
        root = new
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op7_jaccard"](spark, SMALL).collect()}
    assert got == {d: (root[d], len(links[d])) for d in sets}


def test_packing_is_whole_and_tight(spark):
    rows = QUERIES["op3_packing"](spark, SMALL).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // 2048) + 1
    for _, g in rows.groupby("doc_id"):
        g = g.sort_values("piece")
        assert list(g.start) == [0, *g.length.cumsum()[:-1]]
