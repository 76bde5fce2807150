"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import SQL as CODE_SQL
from .codes import vector_codes
from .decontaminate import contamination
from .html import extract
from .language import identify
from .licenses import SQL as LICENSE_SQL
from .licenses import license_labels
from .lm import pseudo_likelihood
from .mixing import mix
from .neighbours import SQL as NEIGHBOUR_SQL
from .neighbours import embedding_groups
from .ranking import SQL as RANKING_SQL
from .ranking import ranked_documents
from .repeats import repeat_digest
from .simhash import simhash_groups
from .topk import SQL as TOPK_SQL
from .topk import top_k
from .urls import SQL as URL_SQL
from .urls import url_verdicts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_read(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_read(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_read(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_read(spark, sf_dir, "embeddings"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_lm": op3_lm,
    "op4_urls": op4_urls,
    "op5_licenses": op5_licenses,
    "op6_html": op6_html,
    "op7_repeats": op7_repeats,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_neighbours": op11_neighbours,
    "op12_codes": op12_codes,
    "op13_ranking": op13_ranking,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_topk": TOPK_SQL,
    "op4_urls": URL_SQL,
    "op5_licenses": LICENSE_SQL,
    "op11_neighbours": NEIGHBOUR_SQL,
    "op12_codes": CODE_SQL,
    "op13_ranking": RANKING_SQL,
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k)),
o AS (SELECT DISTINCT r, s, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.t = iw.t),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM o) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)
""",
    # texts in hexadecimal, cut into overlapping parts of 1000 bytes, so that a passage is found without going through a long text
    "op7_repeats": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
c AS (SELECT r, doc_id, pos, substr(h, 2 * pos + 1, 2098) AS part, len(h) // 2 AS n
      FROM (SELECT *, unnest(range(0, greatest(0, len(h) // 2 - 49), 1000)) AS pos FROM d)),
w AS (SELECT r, doc_id, pos + k AS s, substr(part, 2 * k + 1, 100) AS p
      FROM (SELECT *, unnest(range(0, least(1000, n - 49 - pos))) AS k FROM c)),
f AS (SELECT p, min(doc_id) AS least FROM w WHERE doc_id IS NOT NULL GROUP BY p HAVING min(doc_id) < max(doc_id)),
x AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 50, true) AS fresh
      FROM w JOIN f USING (p) WHERE doc_id > least),
g AS (SELECT r, s, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY s) AS g FROM x),
i AS (SELECT r, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY r, g),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM i),
m AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
      FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN m USING (r)
""",
}
