"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import (
    decontaminate,
    html_extract,
    line_dedup,
    media,
    quality,
    secret_scan,
    sentencepiece_lattice,
    sharding,
    simhash,
    url_filter,
)
from inkloom.llm._shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(spark, table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spark, table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_sentencepiece,
        op3_decontaminate,
        op4_url_filter,
        op5_quality,
        op6_html_extract,
        op7_line_dedup,
        op8_media_columns,
        op9_sharding,
        op10_simhash,
    )
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, 10 AS k, array_to_string(w[p : p + 9], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10)
            UNION
            SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM i WHERE len(w) BETWEEN 1 AND 9
        ),
        sizes AS (SELECT DISTINCT k FROM win),
        cut AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes)),
        hits AS (SELECT r, k, p, item_id FROM cut JOIN win USING (k, s)),
        words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
        names AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
               sha256(coalesce(names.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)""",
    "op7_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, coalesce(source, '') AS site, p, line, trim(line, ' ') AS t
            FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)
        ),
        wide AS (SELECT t, min(doc_id) AS keeper FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {line_dedup.SITES}),
        marked AS (
            SELECT doc_id, p, line, wide.t IS NOT NULL AND NOT (doc_id = keeper AND row_number() OVER (PARTITION BY doc_id, lines.t ORDER BY p) = 1) AS gone
            FROM lines LEFT JOIN wide ON lines.t = wide.t
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY doc_id""",
}
