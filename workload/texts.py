"""App files and whole texts: streams, headers, hidden metadata, name tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.operators import catalog as cat
from tallyloom.operators.tokens import candidates, token_scan
from tallyloom.sources.app_files import base64_objects, headers, inflate
from workload.derive import read
from workload.derive_files import document_app_files
from workload.registry import query


@query("corpus_blobs", "SELECT doc_id AS app, text FROM documents")
def _blobs(spark, sf_dir):
    streams = inflate(document_app_files(spark, sf_dir), "doc_id")
    scripts = cat.classify(streams).where("kind = 'script'")
    return scripts.select("app", F.get_json_object("text", "$.qScript").alias("text"))


@query("corpus_headers", "SELECT doc_id AS app, '1.' || doc_id AS version, lang AS build FROM documents")
def _headers(spark, sf_dir):
    found = headers(document_app_files(spark, sf_dir), "doc_id")
    return found.select("app", "version", F.get_json_object("header", "$.buildno").alias("build"))


@query("corpus_base64", "SELECT doc_id AS app, source, text FROM documents")
def _base64(spark, sf_dir):
    found = base64_objects(document_app_files(spark, sf_dir), "doc_id")
    return found.select("app", *[F.get_json_object("object", f"$.{n}").alias(n) for n in ("source", "text")])


def _tokens_sql(table: str, key: str, text: str) -> str:
    return f"""SELECT app, token, min(i) AS i FROM (
        SELECT {key} AS app, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM (
          SELECT {key}, list_filter(regexp_extract_all({text}, '[A-Za-z0-9_]+'), lambda w: length(w) BETWEEN 4 AND 30 AND regexp_matches(w, '^[A-Za-z]')) AS ws FROM {table}))
        GROUP BY 1, 2"""


@query(
    "token_scan",
    f"""SELECT app, token, CAST(row_number() OVER (PARTITION BY app ORDER BY i) - 1 AS INTEGER) AS pos
        FROM ({_tokens_sql("documents", "doc_id", "text")})""",
)
def _token_scan(spark, sf_dir):
    return token_scan(read(spark, sf_dir, "documents"), "doc_id", "text")


_RESERVED = ", ".join(f"'{w}'" for w in fixed.RESERVED_TOKENS)


@query(
    "token_candidates",
    f"""WITH words AS (SELECT app, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
           SELECT page_id AS app, list_filter(regexp_split_to_array(url, '[^a-zA-Z0-9]'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_RESERVED})) AS ws FROM pages)),
       titled AS (SELECT app, upper(w[1]) || lower(w[2:]) AS w, min(i) AS i FROM words GROUP BY 1, 2),
       named AS (SELECT app, i, unnest([w, w || '_ID', w || '_Category', w || '_Rating']) AS name, unnest(range(4)) AS k FROM titled),
       counted AS (SELECT app, count(*) AS n FROM named GROUP BY 1),
       firsts AS (SELECT app, lower(token) AS l, first(token ORDER BY i) AS name, min(i) AS i FROM ({_tokens_sql("pages", "page_id", "html")})
                  WHERE lower(token) NOT IN ({_RESERVED}) GROUP BY 1, 2),
       fresh AS (SELECT f.app, f.name, f.i, row_number() OVER (PARTITION BY f.app ORDER BY f.i) AS r FROM firsts f
                 WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.app = f.app AND lower(n.name) = f.l)),
       chosen AS (SELECT app, name, 0 AS part, i * 4 + k AS place FROM named
                  UNION ALL SELECT f.app, f.name, 1, f.i FROM fresh f LEFT JOIN counted c ON c.app = f.app WHERE f.r <= greatest(16 - coalesce(c.n, 0), 0))
       SELECT app, CAST(row_number() OVER (PARTITION BY app ORDER BY part, place) - 1 AS INTEGER) AS pos, name FROM chosen""",
)
def _token_candidates(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("app"), F.posexplode(candidates(F.col("url"), F.col("html"))).alias("pos", "name"))
