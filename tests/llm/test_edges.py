"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from lakewarden.llm import decontaminate, jaccard, langid, licenses, media, packing, pii, render, store, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits long, key string, rep long, pii_email string, lang_pred string"
ENGLISH = "the cat and the dog are on the mat with a hat, and that is what they do every day of the week"
GERMAN = "der hund und die katze sind auf der matte und das ist was sie jeden tag der woche machen wollen"


def rows():
    texts = [None, "", " \n", "!!! 123", "x", ENGLISH, ENGLISH, GERMAN, (ENGLISH + " ") * 2000, "日本語 のテキスト", "a\u0000b \U0001f600 mail me@x.org"]
    made = [(i, t, "en" if t == ENGLISH else "de" if t == GERMAN else None, "s", None, 1.5, 7, "k", 3, "p", "q") for i, t in enumerate(texts)]
    return [*made, made[5], (None, ENGLISH, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    return spark.createDataFrame(rows() if request.param == "odd" else [], SCHEMA)


def same_rows(docs, out):
    assert out.columns == docs.columns
    return {r.doc_id for r in out.collect()}


def test_language(docs):
    profile = langid.Profile((("de", GERMAN * 20), ("en", ENGLISH * 20)))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, profile).collect()}
    if docs.count():
        assert [got[i] for i in (0, 1, 2, 3)] == ["und"] * 4
        assert (got[5], got[7], got[8], got[None]) == ("en", "de", "en", "en")
        assert same_rows(docs, langid.accepted(docs, profile)) == {None, *range(4, 11)}
    assert langid.predict(docs, langid.Profile(())).where("lang_pred <> 'und'").count() == 0
    assert langid.learn(docs).samples is not None


def test_toxicity(docs, spark):
    lexicon = toxicity.Lexicon((("mat", 5.0, 0.0),), ("trash can",), (-3.0, 2.0, 0.1, 0.1))
    got = {r.doc_id: (r.hits, r.score) for r in toxicity.score(docs, lexicon).collect()}
    if got:
        assert got[0] == got[1] and got[0][0] == 0 and 0 < got[0][1] < 0.3 < got[5][1]
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).stems == ()
    assert toxicity.score(docs, toxicity.Lexicon()).where("score <> 0").count() == 0


def test_toxicity_folds_and_excuses():
    lexicon = toxicity.Lexicon((("idiot", 5.0, 0.0), ("trash", 5.0, 0.0)), ("trash can",))
    assert toxicity.matched(lexicon, " you idiot ") == (1, 5.0, 0.0)
    assert toxicity.matched(lexicon, " a trash can here ") == (0, 0, 0)
    assert toxicity.matched(lexicon, " a trash can trashy ") == (1, 5.0, 0.0)


def test_folding(spark):
    got = spark.createDataFrame([("YOU 1D10T!",), ("іdіоt",), (None,)], "text string").select(toxicity.folded(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == [" you idiot ", " idiot ", " "]
    for form in ("stúpid", "ｓｔｕｐｉｄ", "𝐬𝐭𝐮𝐩𝐢𝐝", "stu\u200bpid", "stu\u00adpid", "S\u0336t\u0336u\u0336p\u0336i\u0336d\u0336", "ЅТUРІD", "ѕтυріԁ", "5TUP1D", "ꜱᴛᴜᴘɪᴅ", "ⓢⓣⓤⓟⓘⓓ", "stu\ufe0fpid"):
        assert toxicity.fold(form) == " stupid ", form
    assert toxicity.fold("Straße, 12 Uhr\u3000日本") == " straße i uhr 日本 "


def test_toxicity_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "m", "you idiot", 3.0)], "doc_id long, __text string, text string, score double")
    got = toxicity.score(rows, toxicity.Lexicon((("idiot", 5.0, 0.0),), (), (-3.0, 2.0, 0.1, 0.1))).first()
    assert (got["__text"], got.hits, got.text) == ("m", 1, "you idiot")


def test_pii(docs):
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert docs.count() == 0 or (got[10].n_email, got[10].spans, got[0].spans) == (1, "email:11:19", "")
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert docs.count() == 0 or {r.doc_id: r.text for r in out.collect()}[10] == "a\u0000b \U0001f600 mail [EMAIL]"


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.join(docs.select("doc_id", "text")).collect()}
    if docs.count():
        assert jaccard.join(docs).count() == docs.count()
        assert (got[5].class_id, got[6].class_id, got[6].n_links, got[6].n_texts) == (5, 5, 3, 1)  # the long text repeats it: 18 of 22 n-grams
        assert (got[0].class_id, got[1].class_id, got[1].n_links, got[None].class_id) == (0, 1, 0, None)
    assert same_rows(docs, jaccard.kept(docs)) == ({*range(11), None} - {6, 8} if docs.count() else set())


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(1, ENGLISH), (2, None), (3, ""), (4, "x"), (None, GERMAN), (1, ENGLISH)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items).collect()}
    assert got == ({(d, 1) for d in (5, 6, 8, None)} | {(4, 4)} if docs.count() else set())
    assert decontaminate.search(docs, items.limit(0)).count() == 0


def test_packing(docs):
    got = packing.pack(docs, PATH, 32, keep_ids=True).toPandas()
    assert len(got) == 0 or got.doc_id.nunique(dropna=False) == 12
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 32
    assert all(len(i) == n for i, n in zip(got.ids, got.length, strict=True))


def test_media(docs):
    got = {r.doc_id: r for r in media.columns(docs).collect()}
    assert len(got) == (12 if docs.count() else 0)
    if got:
        assert got[0].payload_sha256 == got[1].payload_sha256 and got[0].payload_bytes == 64 and got[5].shard == got[6].shard


def test_licenses(docs, spark):
    assert licenses.scan(docs).count() == 0
    some = spark.createDataFrame([(1, "Ärger\nLICENSED under the Apache License,\nVersion 2.0. All rights reserved!"), (1, "All rights reserved.")], "doc_id long, text string")
    assert sorted((r.license, r.coverage, r.spans) for r in licenses.scan(some).collect()) == [("All-Rights-Reserved", 1.0, "0:19"), ("All-Rights-Reserved", 1.0, "54:73"), ("Apache-2.0-notice", 1.0, "6:52")]


def test_render(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>a<p>b"), (3, "u", "<p>a<p>b")], "page_id long, text string, html string")
    got = sorted((r.page_id, r.text) for r in render.render(pages).collect())
    assert got == [(1, ""), (2, ""), (3, "a\n\nb"), (3, "a\n\nb")]
    assert render.render(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, "v", "<p>é" * 50)], "page_id long, url string, html string")
    for table, files in ((pages, True), (pages.limit(0), False)):
        folder, copy = store.new_path(spark, "a"), store.new_path(spark, "b")
        manifest = warc.write(table, folder)
        warc.replicate(manifest, folder, copy)
        ours, theirs = (warc.tree(rows, warc.sizes(spark, at)) for rows, at in ((manifest, folder), (warc.hashed(manifest, copy), copy)))
        assert manifest.count() == table.count() and warc.audit(ours, theirs).count() == 0 and ours[0].count() == table.count()


class Strict:
    """A store that does not replace files, in which another attempt may put its own meanwhile."""

    def __init__(self, files, meanwhile=()):
        self.files, self.meanwhile = dict(files), list(meanwhile)

    def move(self, draft, name):
        if self.meanwhile:
            self.files[name] = self.meanwhile.pop()
        if name in self.files:
            raise OSError("it is there")
        self.files[name] = self.files.pop(draft)

    def get_file_info(self, name):
        return fs.FileInfo(name, fs.FileType.File if name in self.files else fs.FileType.NotFound)

    def delete_file(self, name):
        del self.files[name]


def test_warc_files_of_attempts_before():
    for before, meanwhile in (({}, ()), ({"a": "old"}, ()), ({"a": "old"}, ("x", "y", "z"))):
        store_ = Strict(before | {"draft": "new"}, meanwhile)
        warc.put(store_, "draft", "a")
        assert store_.files == {"a": "x" if meanwhile else "new"}
    with pytest.raises(KeyError):
        warc.put(Strict({}), "draft", "a")


def test_warc_twice_in_one_folder(spark):
    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(9)], "page_id long, url string, html string")
    folder, copy = store.new_path(spark, "a"), store.new_path(spark, "b")
    first, again = (sorted(map(tuple, warc.write(pages, folder).collect())) for _ in range(2))
    assert first == again
    for _ in range(2):
        warc.replicate(warc.write(pages, folder), folder, copy)
    assert sorted(warc.sizes(spark, copy).collect()) == sorted(warc.sizes(spark, folder).collect())


def test_pipeline_stages_keep_columns(docs, spark, tmp_path):
    spark.createDataFrame([(1, GERMAN)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
