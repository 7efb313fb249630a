"""Issue-shaped inputs derived from the driver's tables.

The driver ships generic tables (``documents``, ``events``, ``embeddings`` ...).
The views below turn them into what this engine consumes -- closed issues with
labels, webhook payloads, model logits, repository label pages -- with one SQL
body per view that runs unchanged on Spark and on DuckDB. Only table names and
two list functions differ; they are written as tokens and rendered per engine:

* ``@name``         -> the table (a parquet path for Spark, a view for DuckDB)
* ``__LIST__(``     -> ``array(`` / ``list_value(``
* ``__AT__(``       -> ``element_at(`` / ``list_extract(`` (1-based)

Every view keeps all rows of its source table; ``%`` only picks which variant
of markup or metadata a row receives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ticketlens.fixed_values import LABEL_CATALOG

FOREIGN_LABEL = "priority/important-soon"
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def catalog_values_sql() -> str:
    """The label catalog as an inline VALUES table (ord, label, taxonomy, threshold)."""
    rows = ",\n    ".join(
        f"({i}, {_sql_str(label)}, {_sql_str(tax)}, CAST('{thr!r}' AS DOUBLE))"
        for i, (label, tax, thr) in enumerate(LABEL_CATALOG)
    )
    return f"SELECT * FROM (VALUES\n    {rows}) AS t(ord, label, taxonomy, threshold)"


def catalog_list_sql() -> str:
    return "__LIST__(" + ", ".join(_sql_str(label) for label, _, _ in LABEL_CATALOG) + ")"


# Closed issues: number, title (first line), body with injected markup,
# creation/closing time strings, URL (sometimes missing), PR flag and labels.
ISSUES = f"""
WITH base AS (
  SELECT doc_id AS number,
         split_part(text, chr(10), 1) AS first_line,
         text,
         doc_id % 8 AS k,
         DATE '2024-01-01' + CAST((doc_id * 7919) % 330 AS INT) AS created_day,
         (doc_id * 104729) % 86400 AS sec
  FROM @documents)
SELECT number,
  CASE WHEN k = 7 THEN concat('[sig-node] ', first_line) ELSE first_line END AS title,
  CASE WHEN k = 0 AND instr(text, chr(10)) = 0 THEN NULL
       WHEN k = 1 THEN concat('/sig node', chr(10), text)
       WHEN k = 2 THEN concat('> - `/kind bug`', chr(10), text, chr(10), 'Fixes #', CAST(number AS STRING))
       WHEN k = 3 THEN concat('<!-- template -->', text, '<br/>see https://example.test/a(b)')
       WHEN k = 4 THEN concat('[log](https://example.test/x) ![shot](u.png) ', text)
       WHEN k = 5 THEN concat('about  sig/node  and  kind_bug  here', chr(13), chr(10), text)
       WHEN k = 6 THEN concat('<details>', text, '</details> [ ] ()')
       ELSE text END AS body,
  concat(CAST(created_day AS STRING), 'T',
         lpad(CAST(CAST(floor(sec / 3600) AS BIGINT) AS STRING), 2, '0'), ':',
         lpad(CAST(CAST(floor((sec % 3600) / 60) AS BIGINT) AS STRING), 2, '0'), ':',
         lpad(CAST(sec % 60 AS STRING), 2, '0'), 'Z') AS created_at,
  CASE WHEN number % 17 = 0 THEN NULL
       ELSE concat(CAST(created_day + CAST(number % 50 AS INT) AS STRING), 'T23:59:59Z') END AS closed_at,
  CASE WHEN number % 9 = 0 THEN NULL
       ELSE concat('https://github.com/kubernetes/kubernetes/issues/', CAST(number AS STRING)) END AS html_url,
  number % 13 = 0 AS is_pull_request,
  __LIST__(
    CASE WHEN number % 11 <> 0 THEN __AT__({catalog_list_sql()}, CAST(number % 30 AS INT) + 1) END,
    CASE WHEN number % 11 <> 0 THEN __AT__({catalog_list_sql()}, CAST((number * 7) % 30 AS INT) + 1) END,
    CASE WHEN number % 5 = 0 THEN '{FOREIGN_LABEL}' END) AS labels
FROM base
"""

# Webhook payloads, one JSON text per event, with every triage outcome.
EVENT_PAYLOADS = """
SELECT event_id, CASE
  WHEN event_id % 20 = 0 THEN 'not json'
  WHEN event_id % 20 = 1 THEN '[]'
  WHEN event_id % 20 = 2 THEN '{"action":"opened"}'
  WHEN event_id % 20 = 3 THEN '{"action":"opened","issue":{"number":true,"title":"t","body":null,"html_url":"u"},"repository":{"name":"r","owner":{"login":"o"}}}'
  WHEN event_id % 20 = 4 THEN '{"action":"opened","issue":{"number":1,"title":"t","body":["x"],"html_url":"u"},"repository":{"name":"r","owner":{"login":"o"}}}'
  ELSE concat('{"action":"', CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'edited' WHEN 'signup' THEN 'reopened' WHEN 'error' THEN 'closed' ELSE 'opened' END,
   '","issue":{"number":', CAST(event_id AS STRING), ',"title":"', event_type, ' kubelet bug","body":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"kubectl scheduler fails"' END,
   ',"html_url":"https://example.test/', CAST(event_id AS STRING), '"', CASE WHEN event_id % 7 = 0 THEN ',"pull_request":null' ELSE '' END,
   ',"user":{"type":"', CASE WHEN user_id % 10 = 0 THEN 'Bot' ELSE 'User' END, '"}}',
   CASE WHEN user_id % 10 = 1 THEN ',"sender":{"type":"Bot"}' ELSE '' END,
   ',"repository":{"name":"repo', CAST(user_id % 5 AS STRING), '","owner":{"login":"org"}}}') END AS payload
FROM @events
"""

# Free text for the per-stage cleaning queries: issue bodies and titles, and
# raw web pages (real markup: comments, <br>, tags, URLs, entities).
TEXTS = f"""
SELECT 'body' AS src, number AS id, body AS text FROM ({ISSUES}) AS issues
UNION ALL SELECT 'title' AS src, number AS id, title AS text FROM ({ISSUES}) AS issues
UNION ALL SELECT 'page' AS src, page_id AS id, html AS text FROM @pages
"""

# Compatibility forms for NFKC, built by rule from the documents: printable
# ASCII shifted to the full-width block, fi/ff ligatures, no-break spaces.
# The backslash is left out: Spark SQL literals treat it as an escape.
_SHIFTED = [c for c in range(0x21, 0x7F) if c != 0x5C]
ASCII_PRINTABLE = "".join(chr(c) for c in _SHIFTED)
FULL_WIDTH = "".join(chr(c - 0x21 + 0xFF01) for c in _SHIFTED)
LIGATURES = (("fi", "\ufb01"), ("ff", "\ufb00"))
NBSP = "\u00a0"


def _compat_sql() -> str:
    lig = "text"
    for plain, joined in LIGATURES:
        lig = f"replace({lig}, {_sql_str(plain)}, {_sql_str(joined)})"
    return f"""
SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN text
  WHEN 1 THEN translate(text, {_sql_str(ASCII_PRINTABLE)}, {_sql_str(FULL_WIDTH)})
  WHEN 2 THEN {lig}
  ELSE replace(text, ' ', {_sql_str(NBSP)}) END AS text
FROM @documents
"""


COMPAT_TEXTS = _compat_sql()

# Model outputs: the embedding, whose entries fold onto the catalog's positions (``logits``).
LOGITS = """
SELECT vec_id, label AS true_class, embedding FROM @embeddings
"""

# Word tokens of every document (whole text).
TOKENS = """
SELECT doc_id, split(text, ' ') AS tokens FROM @documents
"""


_TABLE_TOKEN = re.compile(r"@(" + "|".join(BASE_TABLES) + r")\b")


def render(sql: str, engine: str, sf_dir: str | None = None) -> str:
    """Render table tokens and list functions for ``spark`` or ``duckdb``."""
    if engine == "spark":
        sql = sql.replace("__LIST__(", "array(").replace("__AT__(", "element_at(")
        return _TABLE_TOKEN.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql)
    if engine == "duckdb":
        sql = sql.replace("__LIST__(", "list_value(").replace("__AT__(", "list_extract(")
        return _TABLE_TOKEN.sub(lambda m: m.group(1), sql)
    raise ValueError(f"unknown engine {engine!r}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(render(sql, "spark", sf_dir))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ISSUES)


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENT_PAYLOADS)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOGITS)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TOKENS)


def duck_cte(**views: str) -> str:
    """``WITH a AS (...), b AS (...)`` for an oracle, from view bodies."""
    parts = [f"{name} AS ({render(body, 'duckdb')})" for name, body in views.items()]
    return "WITH " + ",\n".join(parts) + "\n"
