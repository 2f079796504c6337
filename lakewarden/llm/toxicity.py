"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding takes a text's compatibility decomposition (wide, bold and other forms
of letters become plain ones), drops marks and characters without width, which
may stand inside of words, lower-cases it, maps look-alike characters of other
scripts and digits that stand for letters to Latin letters, and turns every
other character that is no letter into a space. The lexicon holds beginnings of
words (stems); each has a weight for texts with one word that begins so and a
weight for texts with two different ones, both learned from labelled rows. All
stems are found in one pass of an automaton. A word inside an exception
phrase, such as ``trash can``, does not count. The weights of what was found,
as a sum and as a rate by the text's number of words, give a probability.

Bounds: the lexicon is learned from at most :data:`SAMPLE_ROWS` labelled rows
outside the held-out quarter (those with the least hash of their id), all of
whose stems with enough support and weight are kept; everything else covers
every row and whole texts. A stem has at most :data:`LONGEST` letters and finds
longer words by their beginning.

Defined results: null and empty texts have no hits and get the score of a text
without hits. A row whose label is null is not learned from. Without labelled
rows of both classes, or without stems, every score is 0. Repeated rows get
equal results.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm import store, textvec

SAMPLE_ROWS = 24_000
#: Lengths of stems in letters, and the least number of toxic rows that hold one.
SHORTEST, LONGEST, SUPPORT = 4, 9, 8
#: The least log-odds of a stem that is kept.
LEAST_WEIGHT = 2.5
PREDICT_AT = 0.3
#: Greater rates count as this one.
MOST_RATE = 20.0
#: Phrases in which a stem is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid simple", "pathetic fallacy", "pond scum")
#: Characters that look like a Latin letter, by the letter; then digits and signs in place of letters.
LOOKALIKES = {
    "a": "аɑαᴀ", "b": "вʙьβ", "c": "сᴄϲ", "d": "ԁᴅđɗ", "e": "еᴇεɛҽєə", "f": "ꜰƒ", "g": "ɡɢց", "h": "нһʜħհ", "i": "іιıɪɩ", "j": "јᴊյ", "k": "кᴋκ", "l": "ӏʟłⅼ", "m": "мᴍ", "n": "ոɴηпŋ",
    "o": "оοօᴏøσ", "p": "рρᴘ", "q": "ԛգ", "r": "гʀ", "s": "ѕꜱʂ", "t": "тτᴛŧ", "u": "υսᴜʊ", "v": "νѵᴠ", "w": "ԝѡᴡω", "x": "хχ", "y": "уʏγү", "z": "ᴢʐ",
}
SUBSTITUTES = ("013457@$", "oieastas")
_TABLE = str.maketrans({c: letter for letter, like in LOOKALIKES.items() for c in like} | dict(zip(*SUBSTITUTES, strict=True)))
_PLAIN = str.maketrans(*SUBSTITUTES)
_DROPPED, _GAPS, _ASCII_GAPS = regex.compile(r"[\p{M}\p{Default_Ignorable_Code_Point}]+"), regex.compile(r"[^\p{L}]+"), regex.compile("[^a-z]+")


def fold(text: str) -> str:
    """A folded text between spaces."""
    if text.isascii():
        return _ASCII_GAPS.sub(" ", f" {text.lower().translate(_PLAIN)} ")
    plain = _DROPPED.sub("", unicodedata.normalize("NFKD", text))
    return _GAPS.sub(" ", f" {_DROPPED.sub('', plain.lower()).translate(_TABLE)} ")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


def folded(text: Column) -> Column:
    """Folded text; null counts as empty."""
    return _folded(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Lexicon:
    """Stems with their weights for one and for two words, exception phrases, and the logistic curve over (weight, repeat, rate)."""

    stems: tuple[tuple[str, float, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = field(default=(-20.0, 0.0, 0.0, 0.0))


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    return store.held("toxicity", lexicon, lambda: _made(lexicon))


def _made(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """Patterns with the space before them: (is an exception, length, number of the stem)."""
    found = ahocorasick.Automaton()
    for k, (stem, _, _) in enumerate(lexicon.stems):
        found.add_word(f" {stem}", (False, len(stem) + 1, k))
    for phrase in lexicon.exceptions:
        found.add_word(f" {phrase} ", (True, len(phrase) + 2, -1))
    if not len(found):
        return None
    found.make_automaton()
    return found


def matched(lexicon: Lexicon, text: str) -> tuple[int, float, float]:
    """What a folded text holds of the lexicon.

    The number of different words that begin with a stem; the sum over them of
    their heaviest stem's weight; and the greatest, over stems, of the weight
    for two words times the logarithm of how many different words begin so.
    """
    machine = _automaton(lexicon)
    if machine is None:
        return 0, 0.0, 0.0
    places: list[tuple[int, int]] = []
    excused: list[tuple[int, int]] = []
    for end, (exception, size, stem) in machine.iter(text):
        if exception:
            excused.append((end + 1 - size, end))
        else:
            places.append((end + 1 - size, stem))
    if not places:
        return 0, 0.0, 0.0
    excused.sort()
    furthest = list(accumulate((high for _, high in excused), max))  # the end of what the exceptions up to each cover
    by_stem: dict[int, set[str]] = {}
    by_word: dict[str, float] = {}
    for start, stem in places:
        k = bisect.bisect_right(excused, (start, len(text))) - 1
        if k < 0 or start >= furthest[k]:
            word = text[start + 1 : text.index(" ", start + 1)]
            by_stem.setdefault(stem, set()).add(word)
            by_word[word] = max(by_word.get(word, 0.0), lexicon.stems[stem][1])
    repeat = max((lexicon.stems[stem][2] * math.log(len(words)) for stem, words in by_stem.items()), default=0.0)
    return len(by_word), sum(by_word.values()), repeat


def features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``hits``, ``weight`` and ``repeat`` as :func:`matched` has them, and ``rate``, the sum of both by 100 words. Columns of these names are replaced."""
    source = F.coalesce(docs[text], F.lit(""))
    own = [c for c in docs.columns if c not in ("hits", "weight", "repeat", "rate", "score")]
    raw = "__text"
    while raw in own:
        raw += "_"
    ready = docs.select(*(docs[c] for c in own), source.alias(raw))
    added = [T.StructField("hits", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("weight", "repeat", "rate"))]
    schema = T.StructType([*ready.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            texts = [fold(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            got = np.array([matched(lexicon, t) for t in texts], np.float64)
            words = np.array([max(1, t.count(" ") - 1) for t in texts])
            rate = 100 * (got[:, 1] + got[:, 2]) / words
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got[:, 0].astype(np.int64)), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(rate)], names=schema.names)

    return store.mapped(ready, run, schema, "toxicity")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (toxic, folded text): how many texts hold each stem in one word at least, and in two different words."""
    for batch in textvec.portions(batches, 1):
        once: Counter = Counter()
        twice: Counter = Counter()
        for text in batch.column(1).to_pylist():
            stems = Counter(w[:k] for w in set(text.split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            once.update(stems.keys())
            twice.update(stem for stem, n in stems.items() if n > 1)
        for times, counts in ((1, once), (2, twice)):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([times] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["stem", "times", "n"])


def _pruned(stems: list[tuple[str, int, float]]) -> dict[str, float]:
    """Keeps of stems that find about the same texts the longest, and no longer one that hardly adds to a kept shorter one."""
    support = {stem: n for stem, n, _ in stems}
    full = [x for x in stems if not any(support.get(other, 0) >= 0.9 * x[1] for other in support if len(other) > len(x[0]) and other.startswith(x[0]))]
    kept: dict[str, float] = {}
    for stem, _, weight in sorted(full, key=lambda x: (len(x[0]), x[0])):
        shorter = [kept[stem[:k]] for k in range(SHORTEST, len(stem)) if stem[:k] in kept]
        if not shorter or weight > max(shorter) + 1:
            kept[stem] = weight
    return kept


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 0.5 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(round(float(b), 9) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learns stems and the curve from a bounded sample of labelled rows outside the held-out quarter.

    A document that has several labels is toxic if one of them says so.
    """
    known = labels.where(labels.toxic.isNotNull() & labels.doc_id.isNotNull() & ~held_out(labels.doc_id))
    sample = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id", "toxic").limit(rows)
    sample = store.written(sample.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "toxicity-labels")
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    train = store.written(train.select("toxic", folded(F.col("text")).alias("folded"), "text"), "toxicity-sample")
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon()

    def counted(toxic: int) -> DataFrame:
        rows = train.where(train.toxic == toxic).select("toxic", "folded")
        return store.mapped(rows, _stem_counts, "stem string, times int, n long").groupBy("stem", "times").agg(F.sum("n").alias("n"))

    frequent = store.written(counted(1).where(F.col("n") >= SUPPORT), "toxicity-stems")
    clean = counted(0).withColumnRenamed("n", "m")
    odds = F.log((F.col("n") + 0.1) / (sizes[1] + 1.0)) - F.log((F.coalesce("m", F.lit(0)) + 0.1) / (sizes[0] + 1.0))
    scored = frequent.join(clean, ["stem", "times"], "left").select("stem", "times", "n", odds.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    top = scored.orderBy("stem", "times").collect()  # of a bounded sample, each in enough of its rows
    one, two = (_pruned([(r.stem, r.n, round(r.weight, 6)) for r in top if r.times == times]) for times in (1, 2))
    lexicon = Lexicon(tuple((stem, one.get(stem, 0.0), two.get(stem, 0.0)) for stem in sorted(one.keys() | two.keys())))
    names = ["weight", "repeat", "rate"]
    seen = features(train.select("toxic", "text"), lexicon).select("toxic", *names).toPandas().sort_values(["toxic", *names])
    x = np.column_stack([np.log1p(seen.weight), seen["repeat"], np.minimum(seen.rate, MOST_RATE)])
    return Lexicon(lexicon.stems, lexicon.exceptions, _fitted(x, seen.toxic.to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``hits``, ``weight``, ``repeat``, ``rate`` and ``score``, the probability that a text is toxic."""
    base, by_weight, by_repeat, by_rate = lexicon.curve
    z = base + by_weight * F.log1p("weight") + by_repeat * F.col("repeat") + by_rate * F.least(F.col("rate"), F.lit(MOST_RATE))
    return features(docs, lexicon, text).withColumn("score", 1 / (1 + F.exp(-z)) if lexicon.stems else F.lit(0.0))
