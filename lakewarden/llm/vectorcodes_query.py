"""op13_vectorcodes: codes of all ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import vectorcodes

_ROUNDS = 4


def _assigned(k: int) -> str:
    """The nearest entry of each part in one round: distances of whole numbers, exact in doubles at the tables' sizes."""
    return f"""a{k} AS (SELECT i, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.i, x.p, x.v, b.e, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS d FROM x JOIN b{k} b USING (p)) GROUP BY ALL)"""


def _round(k: int) -> str:
    return f"""{_assigned(k)}, m{k} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, floor(sum(c) / count(*)) AS m FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""


SQL = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS i FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT i, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM k, (SELECT unnest(range(4)) AS p)),
b0 AS (SELECT p, i - 1 AS e, v FROM x WHERE i <= 256), {", ".join(_round(k) for k in range(_ROUNDS))}, {_assigned(_ROUNDS)},
c AS (SELECT i, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{_ROUNDS} GROUP BY i),
s AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM b{_ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (i), s"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = vectorcodes.learn(rows)
    coded = vectorcodes.with_label_errors(vectorcodes.encode(rows, books, also=("label",)))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
