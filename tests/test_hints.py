"""What a pass over bytes tells of texts, against the same told by plain searches, a detector at a time."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakewarden.functions import hints
from lakewarden.functions import text as texts
from lakewarden.functions.catalogue import DETECTORS
from lakewarden.functions.detector import PROPERTIES, Detector, needs, words
from lakewarden.operators import scan

OWN = (Detector("OWN_WIDE", "W", "CONTACT_PII", "LOW", "(?:паспорт|x)[0-9]", literal="паспорт"), Detector("OWN_ALL", "A", "CONTACT_PII", "LOW", ".x?"))


def plainly(text, detectors):
    low = text.lower()
    return [k for k, d in enumerate(detectors, 1) if d.literal in low and (not words(d) or any(w in low for w in words(d))) and all(re.search(PROPERTIES[p], low) for p in needs(d))]


def made(count):
    """Texts of pieces of what detectors look for, next to each other, cut, in capitals, and among other characters."""
    dice = random.Random(5)
    known = sorted({w for d in DETECTORS for w in (d.literal, *words(d), d.sample) if w})
    odd = ["Key-", "İban", "ПАСПОРТ7", "é", "​", "a­b", "­", "é", "😀", "\0", "=", "@", "1234", "12345", "123456", "a" * 15, "b" * 16, "-c~" * 8, ":af-", "-0G:", "\n", ""]
    out = [None, "", "a", "ab", *odd, *known]
    for _ in range(count):
        piece = lambda: dice.choice(known if dice.random() < 0.6 else odd)
        cut = lambda w: w[dice.randrange(3) :] if dice.random() < 0.3 else w.upper() if dice.random() < 0.3 else w
        out.append(dice.choice(("", " ", "x")).join(cut(piece()) for _ in range(dice.randrange(1, 6))))
    return out


@pytest.mark.parametrize("portion", [1, 300, 1 << 20])
def test_detectors_that_may_match_are_those_whose_needs_a_text_has(monkeypatch, portion):
    monkeypatch.setattr(hints, "PORTION", portion)
    some = made(1500 if portion > 1 else 60)
    for detectors in (DETECTORS, DETECTORS + OWN):
        told = hints.teller(detectors, True)(pa.array(some, pa.string())).to_pylist()
        for text, r in zip(some, told, strict=True):
            normal = unicodedata.normalize("NFC", text or "").translate(dict.fromkeys(map(ord, texts.ZERO_WIDTH)))
            assert (r["normal"] if r["normal"] is not None else text or "") == normal
            assert r["possible"] == plainly(normal, detectors), text
    assert hints.teller(DETECTORS, False)(pa.array([], pa.string())).to_pylist() == []
    assert hints.teller(OWN, False)(pa.array(["é"])).to_pylist() == [{"normal": None, "possible": [2]}]


def test_findings_are_those_of_gates_that_look_for_words_one_by_one(spark):
    docs = spark.createDataFrame(list(enumerate(made(400))), "id long, text string")
    on = [(k, d) for k, d in enumerate(DETECTORS) if d.on]
    ready = scan.prepared(texts.normalized(docs, "text", "scanned"))
    want = ready.select("id", "scanned", F.transform(scan.candidates("scanned", "__lower", on), lambda c: c["d"]["rule_id"]).alias("ids"))
    told = F.arrow_udf(hints.teller([d for _, d in on], True), hints.TOLD)
    rows = scan.scan(docs)
    assert rows.columns == ["id", "text", "scanned", "findings", "truncated"]
    got = docs.withColumn("t", told("text")).withColumns({"scanned": F.coalesce("t.normal", "text"), "p": F.when(F.col("text").isNotNull(), F.col("t.possible"))})
    got = got.select("id", "scanned", F.transform(scan.candidates("scanned", None, on, possible="p"), lambda c: c["d"]["rule_id"]).alias("ids"))
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert ", sk-ant-)" not in rows._jdf.queryExecution().optimizedPlan().toString()  # no word is looked for by itself
