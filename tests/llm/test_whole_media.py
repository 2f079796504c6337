"""Rows that repeat an id with another text keep their payloads."""

from lakewarden.llm import media


def test_repeated_ids_with_different_texts(spark):
    rows = [(3, "B"), (5, "A"), (5, "B"), (5, "A"), (None, "A"), (None, "C"), (7, None), (7, "A")]
    got = media.columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.payload_sha256) for r in got) == sorted((d or -1, r.digest) for d, t in rows for r in [next(r for r in got if r.n_bytes == len(t or "") and r.digest == media.hashlib.sha256(media.padded(t or "")).hexdigest())])
    assert len(got) == len(rows)
