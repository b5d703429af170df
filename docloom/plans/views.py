"""The documents table with the file facts that it lacks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer partitions than cores, dealt to all of them by its key; any other as it is.

    Work on texts costs far more than moving a small table once.  A file of one row group is one task
    whatever the cores; tables of a cluster's size have more partitions than cores and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def doc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with id, extension, path, customer, dates and language, all derived from doc_id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".docx", ".xlsx", ".pptx", ".pdf"))), (i % 4 + 1).cast("int"))
    cat = F.element_at(F.array(*map(F.lit, ("rfq", "quotations", "misc"))), (i % 3 + 1).cast("int"))
    name = F.concat(F.col("lang"), F.lit("_spec_"), (i % 50).cast("string"), F.lit("_v"), (i % 3).cast("string"), F.lit(".0"), ext)
    language = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in (("de", "deu"), ("en", "eng"), ("fr", "fra"), ("es", "spa")) for x in p]), F.col("lang")),
        F.lit("und"),
    )
    return d.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.lpad((i + 1).cast("string"), 6, "0")).alias("id"),
        F.col("source").alias("project"),
        "lang",
        language.alias("language"),
        F.col("text").alias("text_content"),
        F.length("text").alias("char_count"),
        ext.alias("extension"),
        F.concat_ws("/", F.col("source"), cat, name).alias("path"),
        name.alias("filename"),
        F.when(cat == "misc", None).otherwise(F.when(cat == "rfq", "rfq").otherwise("quotation")).alias("category"),
        F.when(i % 5 == 0, "BMW").when(i % 5 == 1, "Audi").alias("customer"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 1500).cast("int")).alias("best_date"),
        F.when(i % 2 == 0, "filename").otherwise("mtime").alias("date_source"),
        (F.length("text") > 100).alias("parse_success"),
        (i % 7 + 1).cast("int").alias("page_count"),
    )


DOC_VIEW = """doc_view AS (
  SELECT doc_id, 'doc-' || lpad(CAST(doc_id + 1 AS VARCHAR), 6, '0') AS id, source AS project, lang,
    CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'und' END AS language,
    text AS text_content, length(text) AS char_count, ext AS extension,
    source || '/' || cat || '/' || name AS path, name AS filename,
    CASE cat WHEN 'rfq' THEN 'rfq' WHEN 'quotations' THEN 'quotation' END AS category,
    CASE doc_id % 5 WHEN 0 THEN 'BMW' WHEN 1 THEN 'Audi' END AS customer,
    DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS best_date,
    CASE WHEN doc_id % 2 = 0 THEN 'filename' ELSE 'mtime' END AS date_source,
    length(text) > 100 AS parse_success, CAST(doc_id % 7 + 1 AS INTEGER) AS page_count
  FROM (SELECT *, lang || '_spec_' || (doc_id % 50) || '_v' || (doc_id % 3) || '.0' || ext AS name
        FROM (SELECT *, ['.docx', '.xlsx', '.pptx', '.pdf'][doc_id % 4 + 1] AS ext, ['rfq', 'quotations', 'misc'][doc_id % 3 + 1] AS cat FROM documents)))"""


def sql_tokens(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 0 THEN CAST(ceil((length(regexp_replace({x}, '\\s+', '', 'g')) + CAST(0.5 AS DOUBLE)"
        f" * len(regexp_extract_all({x}, '\\S+'))) / CAST(4.5 AS DOUBLE)) AS BIGINT) ELSE 0 END"
    )


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_boilerplate(x: str) -> str:
    from docloom.functions import jsregex as rx
    from docloom.functions.text import BOILERPLATE

    return "(" + " OR ".join(f"regexp_matches({x}, {rx.re2(p, f)})" for p, f in BOILERPLATE) + ")"


def sql_block_class(t: str, blanks: int = 3) -> str:
    from docloom.functions import jsregex as rx
    from docloom.functions.text import SPEC_VALUE

    return f"""CASE WHEN {sql_boilerplate(t)} THEN 'boilerplate'
      WHEN length({t}) < 100 AND (regexp_matches({t}, '^\\d+(\\.\\d+)*\\s+\\S') OR regexp_matches({t}, '^[A-ZÄÖÜ][A-ZÄÖÜ\\s]{{5,}}$')
        OR (regexp_matches({t}, '^[A-ZÄÖÜ]') AND {t} LIKE '%:')) THEN 'header'
      WHEN length({t}) < 300 AND regexp_matches({t}, {rx.re2(*SPEC_VALUE)}) THEN 'spec_value'
      WHEN contains({t}, chr(9)) OR contains({t}, '|') OR contains({t}, '{" " * blanks}') THEN 'table_row' ELSE 'prose' END"""


def sql_filter_reason(t: str) -> str:
    total = f"greatest(length(regexp_replace({t}, '\\s', '', 'g')), 1)"
    return f"""CASE WHEN length({t}) < 20 THEN 'too_short'
      WHEN len(regexp_extract_all({t}, '\\p{{L}}')) < 0.25 * {total} THEN 'low_letter_ratio'
      WHEN len(regexp_extract_all({t}, $rx$[.,;:!?()\\[\\]{{}}"']$rx$)) > 0.4 * {total} THEN 'high_punctuation' END"""


def sql_normalize(x: str) -> str:
    """The steps of ``text.normalize`` for tables without Unicode blanks."""
    t = f"regexp_replace({x}, '[\\x{{FFFD}}\\x{{FFFE}}\\x{{FFFF}}\\x{{AD}}]', '', 'g')"
    t = f"regexp_replace({t}, '(\\p{{L}})-\\r?\\n\\s*(\\p{{L}})', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    return sql_trim(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
