"""Chunkers called from SQL, as table functions over whole texts."""

from __future__ import annotations

from docloom.operators import table_functions

from . import text_queries
from .text_queries import doc_view
from .views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("sliding_chunks_in_sql", text_queries.SQL["sliding_chunks"])
def sliding_chunks_in_sql(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql(
        """SELECT d.doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, length(c.content) AS chars, md5(c.content) AS digest
           FROM {docs} d, LATERAL text_chunks(d.text, NULL) c""",
        docs=table(spark, sf_dir, "documents").select("doc_id", "text"),
    )


@query("sentence_counts_in_sql", text_queries.SQL["sentence_counts"])
def sentence_counts_in_sql(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql(
        "SELECT d.doc_id, count(*) AS sentences FROM {docs} d, LATERAL text_sentences(d.text) s GROUP BY d.doc_id",
        docs=table(spark, sf_dir, "documents").select("doc_id", "text"),
    )


@query("mixed_chunks_in_sql")
def mixed_chunks_in_sql(spark, sf_dir):
    table_functions.register(spark)
    docs = doc_view(spark, sf_dir).select("doc_id", "extension", "text_content")
    return spark.sql(
        """SELECT d.doc_id, d.extension, c.chunk_index, c.content, c.is_table
           FROM {docs} d, LATERAL text_chunks(d.text_content, d.extension) c""",
        docs=docs,
    )


@query("packed_chunks_in_sql")
def packed_chunks_in_sql(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql(
        """WITH s AS (SELECT d.doc_id, s.n, s.sentence FROM {docs} d, LATERAL text_sentences(d.text) s)
           SELECT id AS doc_id, chunk_index, content FROM packed_chunks(TABLE(s) PARTITION BY doc_id ORDER BY n)""",
        docs=table(spark, sf_dir, "documents").select("doc_id", "text"),
    )
