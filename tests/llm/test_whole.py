"""Cases in which an operator once did less than its whole job."""

import random
import unicodedata

import pyarrow as pa

from lakewarden.llm import decontaminate, jaccard, licenses, textvec


def similarity(item, words):
    """Smith-Waterman cell by cell, without seeds, over the score of the whole item."""
    best, row = 0, [0] * (len(words) + 1)
    for a in item:
        new = [0]
        for k, b in enumerate(words):
            new.append(max(0, row[k] + (2 if a == b else -1), row[k + 1] - 1, new[k] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(item))


def grams(words):
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}


def test_decontamination_against_unseeded_alignment(spark):
    rng = random.Random(5)
    items = {k: [f"w{rng.randrange(4000)}" for _ in range(16 if k % 2 else 36)] for k in range(8)}
    docs = {}
    for k, item in items.items():
        # n-grams of an item are held by different numbers of documents, the fewest in its middle
        for g in range(len(item) - 2):
            for _ in range(abs(g - len(item) // 2 + 1)):
                docs[len(docs)] = [f"f{rng.randrange(10**6)}", *item[g : g + 3], f"f{rng.randrange(10**6)}"]
        middle = len(item) // 2
        docs[len(docs)] = [*item[:middle], "edited", *item[middle + 1 :]]
        for share in (0.1, 0.15, 0.2, 0.25) * 3:
            docs[len(docs)] = ["before", *(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in item), "after"]
        for step in (4, 5):  # a word put in after every few
            docs[len(docs)] = [v for n, w in enumerate(item) for v in ((w, "more") if n % step == step - 1 else (w,))]
        docs[len(docs)] = [*item[:6], *["far"] * (len(item) // 3), *item[6:]]
    want = {(d, k): round(similarity(item, words), 6) for d, words in docs.items() for k, item in items.items() if grams(words) & grams(item)}
    want = {pair: s for pair, s in want.items() if s >= 0.5}
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = decontaminate.search(table, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    assert len(want) > 80 and {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == want


def tokens(text):
    """Words by the names and categories of characters, one character at a time."""
    out, joins = [], False  # whether the next letter goes on with the last word
    at_word = False
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind not in "LMN":
            joins = at_word = False
        elif kind == "M" and at_word:
            out[-1] += c
        elif kind != "M" and any(s in unicodedata.name(c, "") for s in ("CJK", "HIRAGANA", "KATAKANA", "THAI ")):
            out.append(c)
            joins, at_word = False, True
        elif joins:
            out[-1] += c
        else:
            out.append(c)
            joins = at_word = True
    return out


def test_words_of_all_scripts():
    texts = ["", "word—word “quoted”… naïve cóte", "a　b。c，日本語abcの x9", "ภาษาไทยที่ดี ok", "́start", "привет, мир! ١٢٣ हिन्दी", "日", "日本", "", "é", "x\U0001f600y 𠀀𠀁z", "한국어 문장", "日", "\u0301ab", "“", "がx́y"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab9 é—́日の。กั“\U0001f600𠀀ж") for _ in range(rng.randrange(30))) for _ in range(300)]
    data = pa.array(texts, pa.string())
    raw = b"".join(t.encode() for t in texts)
    hashes, starts, ends, at = textvec.words(data)
    got = [[raw[starts[k] : ends[k]].decode() for k in range(a, b)] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [tokens(t) for t in texts]
    assert len(set(hashes.tolist())) == len({w for t in got for w in t})


def test_near_copies_and_passages_without_spaces(spark):
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(400))
    other = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(400))
    english = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = [(1, text), (2, text[:200] + "。" + text[201:]), (3, other), (4, other[:100] + text[:60] + other[100:160]), (5, " ".join(english)), (6, "—".join(english)), (7, " ".join(f"“{w}”" for w in english))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    links = {r.doc_id: r.class_id for r in jaccard.join(table).collect()}
    assert links == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5}
    items = spark.createDataFrame([(1, text[:60]), (2, " ".join(english[50:80]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.search(table, items).collect()}
    assert found == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 2), (7, 2)}
    notice = spark.createDataFrame([(1, "“Licensed—under the Apache License…Version 2.0”")], "doc_id long, text string")
    assert [(r.license, r.coverage) for r in licenses.scan(notice).collect()] == [("Apache-2.0-notice", 1.0)]
