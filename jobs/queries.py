"""The jobs as registered queries: each runs twice into a new folder under spark.checkpoint.dir, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs import critical_catalogue, symbol_survey
from swirlframe.plans.checkpoints import scratch
from swirlframe.queries import FACES_SQL, TYPE_SQL, ZERO, rounded
from swirlframe.source_queries import COORDS_SQL, located_sql


def job1_critical_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All critical points of the embeddings' field, by a second run that finds nothing new."""
    out = scratch(spark, "critical-catalogue")
    for _ in range(2):
        critical_catalogue.run(spark, f"{sf_dir}/embeddings.parquet", out)
    return rounded(critical_catalogue.catalogue(spark, out))


def job2_symbol_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents by language, by a second run that finds nothing new."""
    out = scratch(spark, "symbol-survey")
    for _ in range(2):
        symbol_survey.run(spark, f"{sf_dir}/documents.parquet", f"{out}/table", f"{out}/checkpoint")
    return rounded(symbol_survey.survey(spark, f"{out}/table", T.StructField("lang", T.StringType())))


QUERIES = {f.__name__: f for f in (job1_critical_catalogue, job2_symbol_survey)}

SHIFT, CHUNK = (critical_catalogue.settings(critical_catalogue.NAME)[k] for k in ("shift", "frames_per_chunk"))

SQL = {
    "job1_critical_catalogue": f"""
        WITH {FACES_SQL.replace("(1::BIGINT << shift)", f"(1::BIGINT << {SHIFT})")}, zf AS (SELECT * FROM fa WHERE {ZERO}), {TYPE_SQL},
        m AS (SELECT *, vid * 12 + tmpl - 1 AS face, {COORDS_SQL}, ub::DOUBLE * vc - uc::DOUBLE * vb AS m0, uc::DOUBLE * va - ua::DOUBLE * vc AS m1, ua::DOUBLE * vb - ub::DOUBLE * va AS m2 FROM ty),
        g AS (SELECT *, m0 + m1 + m2 AS m FROM m)
        SELECT face, t, i, j, tmpl, cls, CASE WHEN tmpl <= 2 THEN type END AS type, round({located_sql("j")}, 6) AS x, round({located_sql("i")}, 6) AS y, round({located_sql("t")}, 6) AS time, (t // {CHUNK})::BIGINT AS chunk FROM g""",
    "job2_symbol_survey": """
        WITH RECURSIVE d AS (SELECT lang, regexp_extract_all(hex(text), '..') AS bytes FROM documents WHERE text <> ''),
        b AS (SELECT lang, unnest(list_prepend('', bytes[: len(bytes) - 1])) AS before, unnest(bytes) AS sym FROM d),
        pr AS (SELECT lang, before, sym, count(*) AS n FROM b GROUP BY ALL),
        o AS (SELECT lang, sum(-n * log2(n::DOUBLE / total)) AS bits FROM (SELECT lang, n, sum(n) OVER (PARTITION BY lang, before) AS total FROM pr) GROUP BY lang),
        s AS (SELECT lang, sym, sum(n)::BIGINT AS n FROM pr GROUP BY ALL),
        e AS (SELECT lang, sum(n)::BIGINT AS n_bytes, count(*) AS n_symbols, sum(-n * log2(n::DOUBLE / total)) AS bits FROM (SELECT lang, n, sum(n) OVER (PARTITION BY lang) AS total FROM s) GROUP BY lang),
        hf(lang, counts, size) AS (SELECT lang, list_sort(list(n)), 0::BIGINT FROM s GROUP BY lang UNION ALL SELECT lang, list_sort(list_prepend(counts[1] + counts[2], counts[3:])), size + counts[1] + counts[2] FROM hf WHERE len(counts) > 1)
        SELECT e.lang AS lang, (SELECT coalesce(sum(n), 0) FROM pr WHERE pr.lang IS NOT DISTINCT FROM e.lang AND before = '')::BIGINT AS n_texts, n_bytes,
               (n_bytes - (SELECT coalesce(sum(n), 0) FROM pr WHERE pr.lang IS NOT DISTINCT FROM e.lang AND before = sym))::BIGINT AS n_runs, n_symbols,
               round(e.bits / n_bytes, 6) AS entropy_bits, round(o.bits / n_bytes, 6) AS order1_bits, hf.size AS huffman_bits, coalesce('=' || e.lang, 'null') AS part
        FROM e JOIN o ON e.lang IS NOT DISTINCT FROM o.lang JOIN hf ON e.lang IS NOT DISTINCT FROM hf.lang AND len(counts) = 1""",
}
