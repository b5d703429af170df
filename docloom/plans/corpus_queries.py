"""Queries over file facts, pages, ranks, domain signals and the interactive report."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions import paths as P
from docloom.functions import text as T
from docloom.operators import dashboard, references, report
from docloom.sources import files
from docloom.streaming import ingest

from .views import DOC_VIEW, doc_view, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# paths and dates


@query("file_facts", f"WITH {DOC_VIEW} SELECT doc_id, filename, extension, len(string_split(path, '/')) - 1 AS depth, string_split(path, '/')[1] AS first_dir FROM doc_view")
def file_facts(spark, sf_dir):
    d = doc_view(spark, sf_dir)
    p = F.col("path")
    return d.select("doc_id", P.filename(p).alias("filename"), P.extension(p).alias("extension"), P.depth(p).cast("long").alias("depth"), F.get(P.segments(p), F.lit(0)).alias("first_dir"))


@query(
    "normalized_names",
    f"""WITH {DOC_VIEW} SELECT DISTINCT filename, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[^.]+$', ''), '[_\\-.\\s]+', ' ', 'g'), 'v?\\d+(\\.\\d+)*', ''), '\\s+', ' ', 'g')) AS name FROM doc_view""",
)
def normalized_names(spark, sf_dir):
    return doc_view(spark, sf_dir).select("filename", P.normalized_name(F.col("filename")).alias("name")).distinct()


@query(
    "category_of_path",
    f"WITH {DOC_VIEW} SELECT doc_id, CASE WHEN path LIKE '%/rfq/%' THEN 'rfq' WHEN path LIKE '%/quotations/%' THEN 'quotation' END AS category FROM doc_view",
)
def category_of_path(spark, sf_dir):
    return doc_view(spark, sf_dir).select("doc_id", P.category(P.directories(F.col("path"))).alias("category"))


@query("documents_by_year", f"WITH {DOC_VIEW} SELECT CAST(year(best_date) AS INTEGER) AS year, count(*) AS documents, year(best_date) <= 2025 - 3 AS stale FROM doc_view GROUP BY 1, 3")
def documents_by_year(spark, sf_dir):
    return report.freshness(doc_view(spark, sf_dir), 2025)


@query("category_pivot", f"WITH {DOC_VIEW} SELECT project, count(*) FILTER (WHERE category = 'rfq') AS rfq, count(*) FILTER (WHERE category = 'quotation') AS quotation, count(*) FILTER (WHERE category IS NULL) AS uncategorized, count(*) AS total FROM doc_view GROUP BY 1")
def category_pivot(spark, sf_dir):
    return report.category_pivot(doc_view(spark, sf_dir))


@query("count_by_extension", f"WITH {DOC_VIEW} SELECT extension, count(*) AS n FROM doc_view GROUP BY 1")
def count_by_extension(spark, sf_dir):
    return report.count_by(doc_view(spark, sf_dir), "extension")


@query("count_by_language", f"WITH {DOC_VIEW} SELECT language, count(*) AS n FROM doc_view GROUP BY 1")
def count_by_language(spark, sf_dir):
    return report.count_by(doc_view(spark, sf_dir), "language")


@query(
    "conditional_counts",
    f"WITH {DOC_VIEW} SELECT count(*) FILTER (WHERE NOT parse_success) AS failures, count(*) FILTER (WHERE date_source = 'mtime') AS undated, count(*) FILTER (WHERE customer IS NULL) AS no_customer FROM doc_view",
)
def conditional_counts(spark, sf_dir):
    return report.conditional_counts(doc_view(spark, sf_dir), failures=~F.col("parse_success"), undated=F.col("date_source") == "mtime", no_customer=F.col("customer").isNull())


@query(
    "folder_tree",
    f"""WITH {DOC_VIEW}, s AS (SELECT string_split(path, '/') AS p FROM doc_view), x AS (SELECT p, unnest(range(1, len(p))) AS i FROM s)
    SELECT array_to_string(p[1:i], '/') AS directory, count(*) AS files FROM x GROUP BY 1""",
)
def folder_tree(spark, sf_dir):
    return report.folder_tree(doc_view(spark, sf_dir))


@query("page_count_histogram", f"WITH {DOC_VIEW} SELECT '1-10' AS range, count(*) AS n FROM doc_view UNION ALL SELECT unnest(['11-50', '51-100', '101-200', '200+']), 0")
def page_count_histogram(spark, sf_dir):
    return report.histogram(doc_view(spark, sf_dir), "page_count", report.PAGE_RANGES)


# pages


@query(
    "html_headings",
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>|<h2[^>]*>(.*?)</h2>|<h3[^>]*>(.*?)</h3>|<h4[^>]*>(.*?)</h4>|<h5[^>]*>(.*?)</h5>|<h6[^>]*>(.*?)</h6>')) AS x FROM pages)
    SELECT page_id, count(*) AS headings FROM h WHERE length(trim(regexp_replace(x, '<[^>]+>', '', 'g'))) >= 3 GROUP BY 1""",
)
def html_headings(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.size(files.html_headings(F.col("html"))).cast("long").alias("headings"))
    return p.where("headings > 0")


@query("html_table_counts", "SELECT page_id, len(regexp_extract_all(html, '(?i)<table')) AS tables FROM pages")
def html_table_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_tables(F.col("html")).cast("long").alias("tables"))


@query("html_text", "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(files.html_text(F.col("html"))).alias("digest"))


@query("url_segments", "SELECT page_id, len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS segments FROM pages")
def url_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(P.segments(F.col("url"))).cast("long").alias("segments"))


# joins and ranks


@query("labels_of_documents", "SELECT quality, toxic, count(*) AS documents, sum(n_chars) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def labels_of_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query(
    "longest_by_source",
    "SELECT source, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3",
)
def longest_by_source(spark, sf_dir):
    return references.rank_within(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "rank")


@query("event_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_counts(spark, sf_dir):
    return ingest.event_counts(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query(
    "name_similarity",
    f"""WITH {DOC_VIEW}, n AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[^.]+$', ''), '[_\\-.\\s]+', ' ', 'g'), 'v?\\d+(\\.\\d+)*', ''), '\\s+', ' ', 'g')) AS x FROM doc_view),
    g AS (SELECT x, list_distinct([substr(x, i, 3) for i in range(1, length(x) - 1)]) AS g FROM n)
    SELECT a.x AS a, b.x AS b, round(CASE WHEN len(a.g) + len(b.g) = 0 THEN 0 ELSE len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) END, 6) AS similarity
    FROM g a JOIN g b ON substr(a.x, 4, 5) = substr(b.x, 4, 5) AND a.x < b.x""",
)
def name_similarity(spark, sf_dir):
    n = doc_view(spark, sf_dir).select(P.normalized_name(F.col("filename")).alias("x")).distinct().withColumn("k", F.substring("x", 4, 5))
    pairs = n.withColumnRenamed("x", "a").join(n.withColumnRenamed("x", "b"), "k").where("a < b")
    return pairs.select("a", "b", F.round(T.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# domain, checks, scores


def _domain_sql() -> str:
    from docloom.operators import domain

    cols = [f"CAST(sum(len(regexp_extract_all(t, {rx.re2(*p)}))) AS BIGINT) AS {n}" for n, p in domain.DETECTORS.items()]
    return f"WITH s AS (SELECT substr(text, 1, 8000) AS t FROM documents) SELECT {', '.join(cols)} FROM s"


@query("domain_signals", _domain_sql())
def domain_signals(spark, sf_dir):
    from docloom.operators import domain

    s = domain.signals(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_content")))
    return s.agg(*[F.sum(n).cast("long").alias(n) for n in domain.DETECTORS])


# the interactive report


@query(
    "kpi_cards",
    f"""WITH {DOC_VIEW}, k AS (SELECT CAST(count(*) AS DOUBLE) AS d, avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS r, CAST(sum(page_count) AS DOUBLE) AS p, CAST(count(DISTINCT language) AS DOUBLE) AS l FROM doc_view)
    SELECT 'documents' AS card, d AS value, 'blue' AS colour FROM k UNION ALL SELECT 'parse_rate', round(r, 6), CASE WHEN r >= 0.95 THEN 'green' WHEN r >= 0.8 THEN 'amber' ELSE 'red' END FROM k
    UNION ALL SELECT 'pages', p, 'blue' FROM k UNION ALL SELECT 'languages', l, 'blue' FROM k""",
)
def kpi_cards(spark, sf_dir):
    return dashboard.kpi_cards(doc_view(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("parse_health", f"WITH {DOC_VIEW} SELECT extension, count(*) FILTER (WHERE parse_success) AS parsed, count(*) FILTER (WHERE NOT parse_success) AS failed FROM doc_view GROUP BY 1")
def parse_health(spark, sf_dir):
    return dashboard.parse_health(doc_view(spark, sf_dir))


@query(
    "progress_statistics",
    f"WITH {DOC_VIEW}, e AS (SELECT count(*) AS documents, count(*) FILTER (WHERE parse_success AND char_count >= 200) AS eligible FROM doc_view) SELECT *, CAST(eligible * (eligible - 1) // 2 AS BIGINT) AS pairs FROM e",
)
def progress_statistics(spark, sf_dir):
    return dashboard.progress(doc_view(spark, sf_dir))


@query(
    "line_count_chart",
    f"""WITH {DOC_VIEW}, n AS (SELECT len(string_split(text_content, chr(10))) AS h FROM doc_view)
    SELECT r AS range, (SELECT count(*) FROM n WHERE h BETWEEN lo AND hi) AS n FROM (VALUES ('0', 0, 0), ('1-5', 1, 5), ('6-10', 6, 10), ('11-20', 11, 20), ('21+', 21, 1000000000)) AS v(r, lo, hi)""",
)
def line_count_chart(spark, sf_dir):
    d = doc_view(spark, sf_dir).select(F.size(F.split("text_content", "\n", -1)).alias("headings"))
    return dashboard.heading_counts(d)


