"""MinHash fingerprints of texts, and near duplicates by their bands.

A text is lower-cased; its shingles are its runs of ``n`` words
(:mod:`textvec`). :data:`PERMUTATIONS` universal hash permutations of 64-bit
values, x to a * x + b with odd a, go over all shingles of a batch of texts at
once; a fingerprint has, for each, 16 bits of the mixed least value (b-bit
MinHash), four hexadecimal digits. The share of equal values tells how alike
two sets of shingles are: two different values are equal by chance once in
65,536.

:func:`near_duplicates` cuts the values into bands. Texts that share a band are
brought together by a join on (band, value) in Spark and their Jaccard
similarity is verified exactly: a pair at the threshold of 0.8 shares one of
:data:`BANDS` bands of :data:`ROWS` values with probability 0.99995.

:func:`compared` puts the documents in the order of their ids without a window
over the whole table: ids alone give bounds of buckets of about equal numbers
of rows, and the texts are shuffled once, to their bucket; the first row of
each bucket is sent to the one before it too.

Defined results: a null text counts as empty. A text without words has a
fingerprint of all ones, and is 1.0 like another such text; one of fewer than
``n`` words has one shingle. Rows with equal ids follow each other in the order
of their texts, in one bucket. Rows without an id come after all others, in the
order of a hash of their texts. A single row is followed by itself. Repeated
rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm import jaccard, store, textvec

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
PERMUTATIONS = BANDS * ROWS
#: Of a text without words.
BLANK = 0xFFFF

_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)


def least(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 16-bit MinHash values (rows: texts) of runs of shingle hashes that begin at given places; no run may be empty."""
    out = np.empty((len(starts), PERMUTATIONS), np.uint16)
    room = np.empty_like(grams)
    for k in range(PERMUTATIONS):
        np.multiply(grams, _FACTORS[k], out=room)
        room += _SHIFTS[k]
        out[:, k] = (textvec.mixed(np.minimum.reduceat(room, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def shingled(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts, and the offsets by text."""
    hashes, _, _, at = textvec.words(pc.utf8_lower(texts))
    return textvec.shingles(hashes, at, n)


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprints' values of texts (rows) from :func:`shingled`."""
    out = np.full((len(at) - 1, PERMUTATIONS), BLANK, np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = least(grams, at[some])
    return out


def fingerprints(values: np.ndarray) -> pa.Array:
    """Fingerprints as texts: four hexadecimal digits a value."""
    return pa.array([v.tobytes().hex() for v in values.astype(">u2")], pa.string())


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (columns) of fingerprints' values (rows)."""
    parts = values[:, : BANDS * ROWS].astype(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS))
    for k in range(ROWS):
        key = textvec.mixed(key * np.uint64(0x100000001B3) + parts[:, :, k])
    return key


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_texts) for every row of ``docs`` (doc_id, text), as :func:`jaccard.join` has them, of pairs that share a band and are at least ``threshold`` alike."""

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        return band_keys(least(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])))

    return jaccard.linked(docs, jaccard.signatures(docs.where("doc_id is not null"), n, BANDS, keys), 1, n, threshold)


def _bounds(ids: DataFrame, buckets: int) -> tuple[list[int], dict[int, int], bool]:
    """Ids at which buckets begin, the least id of each bucket that holds any, and whether there are rows without an id."""
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    cuts = sorted({int(c) for c in cuts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        lost = False
        for batch in batches:
            known = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            lost |= len(known) < batch.num_rows
            low = pd.Series(known).groupby(np.searchsorted(cuts, known, "right")).min() if len(known) else {}
            for b, i in low.items():
                first[int(b)] = min(int(i), first.get(int(b), int(i)))
        rows = [*first.items(), *([(-1, 0)] if lost else [])]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([i for _, i in rows], pa.int64())], names=["bucket", "id"])

    found = {r.bucket: r.id for r in store.mapped(ids, run, "bucket int, id long", "minhash").groupBy("bucket").agg(F.min("id").alias("id")).collect()}
    lost = found.pop(-1, None) is not None
    return cuts, found, lost


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, guest, doc_id, mark, text), each bucket's rows in one partition and in order: its own rows, then as a guest the first row of the next bucket that has any (after the last one: of the first)."""
    spark = docs.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts, first, lost = _bounds(rows.select("doc_id"), buckets)
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    low: dict[int, int] = {}
    base = len(cuts) + 1  # buckets of rows without an id come after all others, by ranges of the hash
    if lost:
        spots = F.floor((mark / 2.0**64 + 0.5) * buckets).cast("int") + base
        nameless = rows.where("doc_id is null").select(spots.alias("bucket"), mark.alias("mark"))
        low = {r.bucket: r.mark for r in nameless.groupBy("bucket").agg(F.min("mark").alias("mark")).collect()}
    order = sorted(first) + sorted(low)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    heads = {first[b]: before[b] for b in first}
    least_mark = {low[b]: before[b] for b in low}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, marks: pd.Series) -> pd.Series:
        none = ids.isna().to_numpy()
        known = ids.fillna(0).astype(np.int64).to_numpy()
        spot = np.where(none, np.floor((marks.to_numpy() / 2.0**64 + 0.5) * buckets).astype(np.int64) + base, np.searchsorted(cuts, known, "right"))
        also = [(least_mark.get(m) if u else heads.get(i)) for u, i, m in zip(none.tolist(), known.tolist(), marks.tolist(), strict=True)]
        return pd.Series([[int(s)] if a is None else [int(s), -1 - a] for s, a in zip(spot.tolist(), also, strict=True)])

    dealt = rows.withColumn("mark", mark).withColumn("place", F.explode(places("doc_id", "mark")))
    guest = F.col("place") < 0
    dealt = dealt.select(F.when(guest, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), guest.alias("guest"), "doc_id", "mark", "text")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_last("doc_id"), "mark", "text")


def edited(text: str, following: str) -> str:
    """A text whose last half (of an odd number, the smaller half) is replaced by the first as many characters of another, or all if it has fewer."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def compared(docs: DataFrame, n: int = WORDS, keep_text: bool = True) -> DataFrame:
    """Each document (doc_id, text) beside its edited text and the next document.

    ``near_edited`` and ``near_next`` are the shares of equal values of the
    fingerprints. Where a band is shared, ``jaccard_edited`` and
    ``jaccard_next`` are the exact similarities. ``edited`` is the edited text,
    or its digest if ``keep_text`` is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, guest, id, text, shingles, values) of the row before
        for batch in textvec.portions(batches, size=1 << 20):
            buckets, guests, ids, texts = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            grams, at = shingled(batch.column(4), n)
            values = signatures(grams, at)
            rows = [(b, g, i, t, grams[at[k] : at[k + 1]], values[k]) for k, (b, g, i, t) in enumerate(zip(buckets, guests, ids, texts, strict=True))]
            chain = rows if last is None else [last, *rows]
            last = (*chain[-1][:4], chain[-1][4].copy(), chain[-1][5].copy())
            pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if not a[1] and a[0] == b[0]]
            for low in range(0, len(pairs), 256):
                yield _compared(pairs[low : low + 256], n, keep_text)

    return store.mapped(in_order(docs), run, SCHEMA, "minhash")


def _compared(pairs: list[tuple], n: int, keep_text: bool) -> pa.RecordBatch:
    made = [edited(a[3], b[3]) for a, b in pairs]
    grams, at = shingled(pa.array(made, pa.string()), n)
    values = signatures(grams, at)
    own, following = np.stack([a[5] for a, _ in pairs]), np.stack([b[5] for _, b in pairs])
    bands = band_keys(own)
    verified = [
        [_jaccard(pairs[k][0][4], other) if hit else None for k, (hit, other) in enumerate(zip((bands == band_keys(theirs)).any(1), sets, strict=True))]
        for theirs, sets in ((values, [grams[at[k] : at[k + 1]] for k in range(len(pairs))]), (following, [b[4] for _, b in pairs]))
    ]
    columns = [
        pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
        pa.array(made if keep_text else [hashlib.sha256(t.encode()).hexdigest() for t in made], pa.string()), fingerprints(own), fingerprints(values),
        pa.array((own == values).mean(1)), pa.array((own == following).mean(1)), *(pa.array(v, pa.float64()) for v in verified),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])
