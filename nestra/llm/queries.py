"""One query per operator, over its whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_content, language, licenses, mixing, ogg, perplexity, pii, simhash
from .common import read


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr("cast(-1 as bigint) conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{said}' text")
    return chat.digest(chat.expand(conversations.unionByName(probe)))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(read(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(ogg.media(read(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS t
        FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
spot AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, spot.n, item FROM spot JOIN win USING (n, t)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

_OP10 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS rank FROM sized GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM src),
ratio AS (SELECT *, CAST(cap AS DOUBLE) / weight AS full_at FROM w),
-- with the sources in the order in which they fill up, the level is the first that does not fill the next one
ordered AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                   sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM ratio),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE - caps::DOUBLE) / open_weight::DOUBLE AS level FROM ordered),
level AS (SELECT (array_agg(level ORDER BY full_at, rank) FILTER (WHERE level < full_at))[1] AS level FROM levels),
aim AS (SELECT source, source_size, CASE WHEN level IS NULL OR weight * level >= cap THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM w, level),
rep AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aim),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target - whole * source_size) AS BIGINT) ELSE 0 END AS rest FROM rep),
tied AS (SELECT source, key, doc_id, size, count(*) AS n, sum(size) AS s FROM sized GROUP BY ALL),
run AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied)
SELECT d.doc_id, d.size, rest.source_size, rest.target,
       CAST(rest.whole * d.size + greatest(0, least(d.size, floor((rest.rest - run.before) / run.n))) AS BIGINT) AS taken
FROM sized d JOIN run ON d.source IS NOT DISTINCT FROM run.source AND d.key = run.key AND d.doc_id IS NOT DISTINCT FROM run.doc_id AND d.size = run.size
JOIN rest ON d.source IS NOT DISTINCT FROM rest.source
"""


_OP1 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, length(role) + length(text) + 23
             + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?INST\]|/?s>|</?SYS>>)')) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?INST\]|/?s>|</?SYS>>)')) AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_examples
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _OP1, "op2_decontaminate": _OP2, "op10_mixing": _OP10}
