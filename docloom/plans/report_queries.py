"""Queries over the parse stage, checks, decisions, versions, sketches and filters of the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import jsregex as rx
from docloom.functions import sketch
from docloom.functions import text as T
from docloom.operators import boilerplate, checks, dashboard, domain, graph, parse, projection, quality, references, report, requirements, versions
from docloom.sources import files

from . import planted as X
from . import planted_queries as Q
from . import text_queries as TQ
from .language_queries import gated_sql, languages_sql
from .planted import PLANTED, planted, quote
from .views import DOC_VIEW, doc_view, sql_tokens, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# the parse stage

_EXTRACTED = f"""{Q._LINES}, ex AS (SELECT p.*, text_content AS t, m.strategy AS heading_source, CASE WHEN m.strategy = 'union' THEN list_distinct(m.every) ELSE m.every END AS merged, len(m.numbered) AS n_numbered
  FROM planted p JOIN merged m USING (doc_id)),
  pg AS (SELECT *, length(t) AS chars, length(t) >= 50 AND len(regexp_extract_all(substr(t, 1, 5000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) > 0.01 * length(substr(t, 1, 5000)) AS garbled FROM ex),
  {languages_sql('SELECT doc_id AS key, t AS text FROM pg')}"""


@query(
    "parsed_documents",
    f"""WITH {_EXTRACTED} SELECT doc_id, CAST(chars AS INTEGER) AS char_count, chars > 100 AND NOT garbled AS parse_success,
      CASE WHEN NOT (chars > 100 AND NOT garbled) THEN CASE WHEN garbled THEN 'garbled_encoding' ELSE 'empty_extraction' END END AS parse_failure_reason,
      {gated_sql('t', 'told.language')} AS language,
      CASE WHEN extension <> '.pdf' THEN 'not_pdf' WHEN chars / CAST(page_count AS DOUBLE) < 10 THEN 'fully_scanned' WHEN chars / CAST(page_count AS DOUBLE) < 200 AND {Q._IMAGES} > page_count THEN 'hybrid' ELSE 'native' END AS pdf_class,
      CASE WHEN garbled OR chars = 0 THEN NULL ELSE md5(t) END AS digest FROM pg LEFT JOIN told ON key = doc_id""",
)
def parsed_documents(spark, sf_dir):
    p = parse.parse(_extracted(spark, sf_dir))
    return p.select("doc_id", "char_count", "parse_success", "parse_failure_reason", "language", "pdf_class", F.md5("text_content").alias("digest"))


@query(
    "parsed_headings",
    f"""WITH {Q._LINES} SELECT doc_id, strategy AS heading_source, len(numbered) > 2 AS numbered, CAST(CASE WHEN strategy = 'union' THEN len(list_distinct(every)) ELSE len(every) END AS BIGINT) AS headings FROM merged""",
)
def parsed_headings(spark, sf_dir):
    p = parse.parse(_extracted(spark, sf_dir))
    return p.select("doc_id", "heading_source", "numbered", F.size("headings").cast("long").alias("headings"))


def _extracted(spark, sf_dir):
    i = F.col("doc_id")
    return planted(spark, sf_dir).select(
        "doc_id", "path", "filename", "extension", F.col("text_content").alias("text"), F.col("headings").alias("structure"), "page_count",
        (i % 7).cast("int").alias("table_count"), (i % 13).cast("int").alias("image_count"), F.lit(None).cast("date").alias("meta"),
        F.col("best_date").alias("created"), F.col("best_date").alias("modified"),
    )


# checks, scores and decisions over one row per document

_PARSED = f"""{Q._TYPES}, {Q._OEM}, parsed AS (SELECT doc_id, project, extension, language, page_count, CAST(ceil(length(text_content) / CAST(4.2 AS DOUBLE)) AS BIGINT) AS tokens, len(headings) AS headings,
  doc_type, oem, oem_source, (doc_id % 10) / 10.0::DOUBLE AS scanned_ratio, parse_success, {Q._STRATEGY} AS strategy, {Q._CONFIDENCE} AS strategy_confidence, best_date AS mtime, category,
  {Q._PDF} AS pdf_class, doc_type IN {Q._IN(C.RELIABLE_TYPES)} AND extension <> '.xlsx' AS reliable, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'external' END AS origin, filename, date_source, {Q._ALTERNATIVE} AS alternative FROM oem)"""
# chunks of whole texts; the vectors of a label stand for those of the document with that number
_QUALITY = f"""quality AS (WITH {TQ._CONTENT}, per AS (SELECT doc_id, avg(v) AS index_mean, count(*) AS chunks, avg(boundary_quality) AS boundary_quality FROM ix GROUP BY 1),
  coherent AS ({TQ.SQL['cosine_neighbours_by_label']})
  SELECT index_mean, chunks, boundary_quality, mean AS coherence FROM per LEFT JOIN coherent ON label = per.doc_id)"""


def _parsed(spark, sf_dir):
    i = F.col("doc_id")
    kind, plan = Q._plan()
    d = planted(spark, sf_dir).withColumns({"doc_type": Q._doc_type(), "_oem": Q._oem(), "_plan": plan, "pdf_class": kind})
    return d.select(
        "doc_id", "project", "extension", "language", "page_count", T.tokens_by_length(F.col("text_content")).alias("tokens"), F.size("headings").alias("headings"), "doc_type",
        F.col("_oem.oem").alias("oem"), F.col("_oem.source").alias("oem_source"), ((i % 10) / 10).alias("scanned_ratio"), "parse_success", F.col("_plan.strategy").alias("strategy"),
        F.col("_plan.confidence").alias("strategy_confidence"), F.col("best_date").alias("mtime"), "category", "pdf_class",
        C.requirement_reliable(F.col("doc_type"), F.col("extension")).alias("reliable"), F.when(i % 4 == 0, "unknown").otherwise("external").alias("origin"),
        "filename", "date_source", F.col("_plan.alternative").alias("alternative"),
    )


def _quality(spark, sf_dir):
    per = quality.per_document(quality.composite(TQ._scored(spark, sf_dir)))
    near = quality.coherence_drop(table(spark, sf_dir, "embeddings"), "label", "vec_id").select(F.col("label").cast("long").alias("doc_id"), F.round("mean", 6).alias("coherence"))
    return graph.checkpoint(per.select("doc_id", "index_mean", "chunks", "boundary_quality").join(near, "doc_id", "left").drop("doc_id"))


def _row(name: str, value: str, threshold: float, passed: str, severity: str, source: str) -> str:
    return f"SELECT {quote(name)} AS name, {passed} AS passed, CAST({value} AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold, {severity} AS severity FROM {source}"


def _none(name: str, bad: str, severity: str, source: str) -> str:
    return _row(name, "n", 0, "n = 0", f"CASE WHEN n > 0 THEN {quote(severity)} ELSE 'INFO' END", f"(SELECT count(*) FILTER (WHERE {bad}) AS n FROM {source})")


_INTERNAL = f"type IN {Q._IN(references.INTERNAL)}"
_EARLY = [
    _none("sectionSizeEstimate", "headings > 0 AND tokens / CAST(nullif(headings, 0) AS DOUBLE) > 5000", "INFO", "parsed"),
    "SELECT 'versionPairSymmetry', true, 0.0::DOUBLE, 0.0::DOUBLE, 'INFO'",
    _row("referenceResolutionRate", "v", 0.4, "v >= 0.4", "CASE WHEN v < 0.4 AND n > 0 THEN 'WARNING' ELSE 'INFO' END",
         f"(SELECT count(*) FILTER (WHERE {_INTERNAL}) AS n, coalesce(count(*) FILTER (WHERE {_INTERNAL} AND method IN ('exact', 'fuzzy')) / CAST(nullif(count(*) FILTER (WHERE {_INTERNAL}), 0) AS DOUBLE), 1) AS v FROM resolved)"),
    _row("requirementDensityRange", "density", 0, "false", "CASE WHEN density < 0.5 THEN 'INFO' ELSE 'WARNING' END", "odd").replace("CAST(0 AS DOUBLE) AS threshold", "CAST(CASE WHEN density < 0.5 THEN 0.5 ELSE 15 END AS DOUBLE) AS threshold"),
    "SELECT 'requirementDensityRange', true, 0.0::DOUBLE, 15.0::DOUBLE, 'INFO' WHERE (SELECT count(*) FROM odd) = 0",
    "SELECT 'parserDivergenceRate', true, 0.0::DOUBLE, 0.3::DOUBLE, 'INFO'",
    _row("scannedPdfRate", "f + p", 0, "f + p = 0", "CASE WHEN f > 0 THEN 'CRITICAL' WHEN p > 0 THEN 'WARNING' ELSE 'INFO' END",
         "(SELECT count(*) FILTER (WHERE scanned_ratio > 0.5) AS f, count(*) FILTER (WHERE scanned_ratio > 0.1 AND scanned_ratio <= 0.5) AS p FROM parsed WHERE extension = '.pdf')"),
    _none("oemConsistency", "k > 1", "WARNING", "(SELECT coalesce(project, 'unknown') AS p, count(DISTINCT oem) AS k FROM parsed WHERE oem <> 'unknown' GROUP BY 1)"),
    _row("languageMixRate", "v", 0.3, "true", "'INFO'", "(SELECT avg(CASE WHEN language IN ('deu', 'und') THEN 0 ELSE 1 END) AS v FROM parsed)"),
    _row("entityCoverage", "v", 0.7, "v >= 0.7", "CASE WHEN v < 0.7 THEN 'WARNING' ELSE 'INFO' END",
         "(SELECT coalesce(avg(CASE WHEN raw_text IN (SELECT raw_text FROM ids WHERE doc_type = 'abweichliste') THEN 1 ELSE 0 END), 1) AS v FROM (SELECT DISTINCT raw_text FROM ids WHERE doc_type = 'lastenheft')) WHERE (SELECT bool_or(doc_type = 'lastenheft') AND bool_or(doc_type = 'abweichliste') FROM parsed)"),
    _row("llmValidationDelta", "v", 0.2, "v <= 0.2", "CASE WHEN v > 0.2 THEN 'WARNING' ELSE 'INFO' END", f"(SELECT avg({Q._OFF}) AS v FROM ({Q._SAMPLED}))"),
    _row("parseSuccessRate", "v", 0.85, "v >= 0.85", "CASE WHEN v < 0.7 THEN 'CRITICAL' WHEN v < 0.85 THEN 'WARNING' ELSE 'INFO' END", "(SELECT avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS v FROM parsed)"),
    _none("chunkStrategyConfidence", "strategy = 'heading_sections' AND strategy_confidence < 0.70", "WARNING", "parsed"),
    _none("oemSourceConflict", "oem_source = 'reconciled'", "WARNING", "parsed"),
    _row("uniformTimestamps", "CASE WHEN k = 1 THEN n ELSE k END", 1, "k <> 1", "CASE WHEN k = 1 THEN 'WARNING' ELSE 'INFO' END", "(SELECT count(*) AS n, count(DISTINCT mtime) AS k FROM parsed) WHERE n >= 5"),
]
_LATE = [
    _row("actionabilityMatrix", "crit + 0.5 * warn", 0, "rate >= 0.85 AND crit = 0 AND warn <= 2", "CASE WHEN crit > 0 THEN 'CRITICAL' WHEN warn > 2 THEN 'WARNING' ELSE 'INFO' END",
         "(SELECT count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS crit, count(*) FILTER (WHERE NOT passed AND severity = 'WARNING') AS warn, coalesce(max(value) FILTER (WHERE name = 'parseSuccessRate'), 1) AS rate FROM early)"),
    _row("ORIGIN_CLASSIFICATION_COVERAGE", "v", 0.7, "v >= 0.7", "'WARNING'", "(SELECT avg(CASE WHEN origin <> 'unknown' THEN 1 ELSE 0 END) AS v FROM parsed)"),
    _row("chunkQualityIndex", "v", 0.5, "v >= 0.5", "CASE WHEN v < 0.35 THEN 'CRITICAL' WHEN v < 0.5 THEN 'WARNING' ELSE 'INFO' END", "(SELECT sum(index_mean * chunks) / sum(chunks) AS v FROM quality)"),
    _row("chunkBoundaryHealth", "v", 0.6, "v >= 0.6", "'INFO'", "(SELECT avg(coalesce(boundary_quality, 0)) AS v FROM quality)"),
    _row("chunkCoherenceHealth", "v", 0.55, "v >= 0.55", "CASE WHEN v < 0.55 THEN 'WARNING' ELSE 'INFO' END", "(SELECT avg(coherence) AS v FROM quality)"),
]


def _checks_sql() -> str:
    resolved = Q._RESOLVED.removeprefix(PLANTED + ", ")
    needs = Q._REQUIREMENTS.removeprefix(PLANTED + ",")
    return f"""WITH {_PARSED}, {resolved}, {needs}, {_QUALITY},
      odd AS (SELECT d.doc_id, n / CAST(greatest(coalesce(page_count, 1), 1) AS DOUBLE) AS density FROM (SELECT p.*, coalesce(n, 0) AS n FROM parsed p LEFT JOIN (SELECT doc_id, count(*) AS n FROM requirements GROUP BY 1) USING (doc_id)) d
        WHERE (n / CAST(greatest(coalesce(page_count, 1), 1) AS DOUBLE) < 0.5 AND doc_type = 'lastenheft') OR n / CAST(greatest(coalesce(page_count, 1), 1) AS DOUBLE) > 15),
      ids AS (SELECT raw_text, doc_type FROM resolved r JOIN parsed p USING (doc_id) WHERE r.type IN ('fikb', 'kb_master')),
      early AS ({' UNION ALL '.join(_EARLY)}), every AS (SELECT * FROM early UNION ALL {' UNION ALL '.join(_LATE)})
    SELECT name, passed, round(value, 6) AS value, threshold, severity FROM every"""


def _checked(spark, sf_dir, parsed=None, refs=None):
    """The checks; rows of documents and resolved references may be known, written already."""
    parsed = graph.checkpoint(_parsed(spark, sf_dir)) if parsed is None else parsed
    refs = graph.checkpoint(Q._resolved(spark, sf_dir)) if refs is None else refs
    pairs = versions.high_pairs(_fingerprints(spark, sf_dir).where("doc_id < 0"))  # the check of pairs is vacuous
    return checks.corpus_checks(
        parsed, pairs, refs, graph.checkpoint(Q._requirements(spark, sf_dir).select("doc_id")), _quality(spark, sf_dir), requirements.validation(Q._sampled(spark, sf_dir)), with_origin=True
    )


@query("consistency_checks", _checks_sql())
def consistency_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("name", "passed", F.round("value", 6).alias("value"), "threshold", "severity")


_SHOWN = "row_number() OVER (ORDER BY passed, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, ord)"


@query(
    "failed_checks_first",
    f"""WITH {DOC_VIEW}, p AS (SELECT avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS v, count(DISTINCT best_date) AS k, count(*) AS n FROM doc_view),
    c AS (SELECT 'parseSuccessRate' AS name, v >= 0.999 AS passed, CASE WHEN v < 0.999 THEN 'CRITICAL' ELSE 'INFO' END AS severity, 1 AS ord FROM p
      UNION ALL SELECT 'uniformTimestamps', k <> 1, CASE WHEN k = 1 THEN 'WARNING' ELSE 'INFO' END, 2 FROM p UNION ALL SELECT 'alwaysWarns', false, 'WARNING', 3 UNION ALL SELECT 'info', false, 'INFO', 0)
    SELECT name, CAST({_SHOWN} AS INTEGER) AS place FROM c""",
)
def failed_checks_first(spark, sf_dir):
    p = doc_view(spark, sf_dir).agg(F.avg(F.col("parse_success").cast("int")).alias("v"), F.count_distinct("best_date").alias("k"))
    bad = F.col("v") < 0.999
    row = lambda n, ok, severity, k: F.struct(F.lit(n).alias("name"), ok.alias("passed"), severity.alias("severity"), F.lit(k).alias("ord"))
    rows = F.array(
        row("parseSuccessRate", ~bad, F.when(bad, "CRITICAL").otherwise("INFO"), 1),
        row("uniformTimestamps", F.col("k") != 1, F.when(F.col("k") == 1, "WARNING").otherwise("INFO"), 2),
        row("alwaysWarns", F.lit(False), F.lit("WARNING"), 3),
        row("info", F.lit(False), F.lit("INFO"), 0),
    )
    ordered = dashboard.severity_order(p.select(F.explode(rows).alias("x")).select("x.*"))
    return ordered.agg(F.collect_list("name").alias("names")).select(F.posexplode("names").alias("p", "name")).select("name", (F.col("p") + 1).alias("place"))  # four rows


@query(
    "checks_of_few_documents",
    f"""WITH {_PARSED} SELECT 'none' AS corpus, 'CORPUS_EMPTY' AS name, false AS passed, 0.0::DOUBLE AS value, 'CRITICAL' AS severity
    UNION ALL SELECT 'few', 'CORPUS_TOO_SMALL', false, CAST(count(*) AS DOUBLE), 'WARNING' FROM parsed WHERE doc_id < 3 HAVING count(*) BETWEEN 1 AND 4""",
)
def checks_of_few_documents(spark, sf_dir):
    parsed = graph.checkpoint(_parsed(spark, sf_dir))
    none = checks.corpus_checks(parsed.where("doc_id < 0")).withColumn("corpus", F.lit("none"))
    few = checks.corpus_checks(parsed.where("doc_id < 3")).where("name LIKE 'CORPUS%'").withColumn("corpus", F.lit("few"))
    return none.unionByName(few).select("corpus", "name", "passed", "value", "severity")


@query(
    "parse_checks",
    f"""WITH {DOC_VIEW}, p AS (SELECT avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS v, avg(CASE WHEN language IN ('deu', 'und') THEN 0 ELSE 1 END) AS m, count(DISTINCT best_date) AS k FROM doc_view)
    SELECT 'parseSuccessRate' AS name, v >= 0.85 AS passed, round(v, 6) AS value FROM p UNION ALL SELECT 'languageMixRate', true, round(m, 6) FROM p UNION ALL SELECT 'uniformTimestamps', k > 1, CAST(k AS DOUBLE) FROM p""",
)
def parse_checks(spark, sf_dir):
    c = checks.corpus_checks(_parsed(spark, sf_dir))
    return c.where(F.col("name").isin("parseSuccessRate", "languageMixRate", "uniformTimestamps")).select("name", "passed", F.round("value", 6).alias("value"))


@query(
    "metadata_score",
    f"""WITH {_PARSED}, s AS (SELECT avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS a, avg(CASE WHEN headings > 0 THEN 1 ELSE 0 END) AS b, coalesce(avg(CASE WHEN pdf_class IN ('fully_scanned', 'hybrid') THEN 1 ELSE 0 END) FILTER (WHERE extension = '.pdf'), 0) AS o FROM parsed),
    t AS (SELECT *, CAST(floor(a * 30 + b * 20 + 0.75 * 20 + (1 - o) * 30 + 0.5) AS INTEGER) AS score FROM s)
    SELECT score, round(a, 6) AS success, round(b, 6) AS with_headings, round(o, 6) AS ocr, CASE WHEN score >= 80 THEN 'reliable' WHEN score >= 60 THEN 'use with caution' ELSE 'not a base for decisions' END AS interpretation FROM t""",
)
def metadata_score(spark, sf_dir):
    return report.metadata_score(_parsed(spark, sf_dir), 0.25, 10).withColumns({c: F.round(c, 6) for c in ("success", "with_headings", "ocr")})


_NEEDS = Q._REQUIREMENTS.removeprefix(PLANTED + ",")


@query(
    "type_breakdown",
    f"""WITH {_PARSED}, {_NEEDS}, cf AS (SELECT doc_id, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM requirements GROUP BY 1),
    st AS (SELECT doc_type, strategy, row_number() OVER (PARTITION BY doc_type ORDER BY count(*) DESC, strategy) AS r FROM parsed GROUP BY 1, 2)
    SELECT p.doc_type, count(*) AS documents, round(avg(page_count), 6) AS avg_pages, round(avg(CASE WHEN language = 'deu' THEN 1 ELSE 0 END), 6) AS german_share, round(avg(CASE WHEN headings > 0 THEN 1 ELSE 0 END), 6) AS heading_share,
      round(avg(coalesce(confirmed, 0)), 6) AS avg_confirmed, round(avg(CASE WHEN pdf_class IN ('fully_scanned', 'hybrid') THEN 1 ELSE 0 END), 6) AS scanned_share, count(*) FILTER (WHERE reliable) AS reliable, any_value(st.strategy) AS strategy
    FROM parsed p LEFT JOIN cf USING (doc_id) JOIN st ON p.doc_type = st.doc_type AND st.r = 1 GROUP BY 1""",
)
def type_breakdown(spark, sf_dir):
    confirmed = requirements.quality_by_document(Q._requirements(spark, sf_dir)).select("doc_id", "confirmed")
    b = report.type_breakdown(_parsed(spark, sf_dir).join(confirmed, "doc_id", "left"))
    return b.withColumns({c: F.round(c, 6) for c in ("avg_pages", "german_share", "heading_share", "avg_confirmed", "scanned_share")})


@query(
    "config_decisions",
    f"""WITH {_PARSED}, {Q._RESOLVED.removeprefix(PLANTED + ', ')}, a AS (SELECT count(*) FILTER (WHERE category IS NOT NULL) AS categorised, count(*) FILTER (WHERE strategy = 'heading_sections' AND strategy_confidence < 0.7) AS weak,
      count(*) FILTER (WHERE scanned_ratio > 0.5) AS full_ocr, count(*) FILTER (WHERE scanned_ratio > 0.1 AND scanned_ratio <= 0.5) AS part_ocr, count(*) FILTER (WHERE extension = '.pdf') AS pdfs, count(*) FILTER (WHERE language NOT IN ('deu', 'und')) AS foreign_docs,
      count(*) FILTER (WHERE reliable) AS reliable FROM parsed), st AS (SELECT strategy FROM parsed GROUP BY 1 ORDER BY count(*) DESC, strategy LIMIT 1),
    r AS (SELECT count(*) FILTER (WHERE {_INTERNAL}) AS internal, count(*) FILTER (WHERE {_INTERNAL} AND method IN ('exact', 'fuzzy')) AS hit, count(*) FILTER (WHERE classification = 'likely_missing_from_corpus') AS missing FROM resolved)
    SELECT decision, recommended, confidence FROM (
      SELECT 'DEC-CATEGORY' AS decision, CASE WHEN categorised > 0 THEN 'one namespace per category' ELSE 'not required' END AS recommended, CASE WHEN categorised > 0 THEN 'HIGH' ELSE 'N/A' END AS confidence FROM a
      UNION ALL SELECT 'DEC-CHUNK', 'per document; mostly ' || (SELECT strategy FROM st), CASE WHEN weak = 0 THEN 'HIGH' ELSE 'MEDIUM' END FROM a
      UNION ALL SELECT 'DEC-OCR', CASE WHEN full_ocr > 0 THEN 'full OCR' WHEN part_ocr > 0 THEN 'partial OCR' ELSE 'none' END, CASE WHEN pdfs > 0 THEN 'MEDIUM' ELSE 'HIGH' END FROM a
      UNION ALL SELECT 'DEC-DEDUP', 'precaution only', 'LOW' UNION ALL SELECT 'DEC-EMBED', CASE WHEN foreign_docs > 0 THEN 'multilingual model' ELSE 'German model' END, 'HIGH' FROM a
      UNION ALL SELECT 'DEC-METADATA', CASE WHEN reliable > 0 THEN 'filter by requirement type' ELSE 'no filter' END, 'LOW' FROM a UNION ALL SELECT 'DEC-PARSER', 'native parsers', 'HIGH'
      UNION ALL SELECT 'DEC-REFS', CASE WHEN internal > 0 AND hit / CAST(internal AS DOUBLE) < 0.4 THEN 'ask for ' || missing || ' missing document(s)' ELSE 'reference graph is usable' END,
        CASE WHEN internal = 0 THEN 'N/A' WHEN hit / CAST(internal AS DOUBLE) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END FROM r)""",
)
def config_decisions(spark, sf_dir):
    none = versions.high_pairs(_fingerprints(spark, sf_dir).where("doc_id < 0"))
    chains = spark.createDataFrame([], "component long, chain array<long>")
    return report.decisions(_parsed(spark, sf_dir), none, chains, graph.checkpoint(Q._resolved(spark, sf_dir)))


@query(
    "zero_output_documents",
    f"""WITH {Q._RAW}, z AS (SELECT doc_id, doc_id % 6 * 100 AS raw, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE (doc_id % 8) / 10.0::DOUBLE END AS retention FROM documents), n AS (SELECT DISTINCT doc_id FROM raw WHERE call = 'norms')
    SELECT doc_id, CASE WHEN raw = 0 THEN 'no text' WHEN retention < 0.1 THEN 'low retention' ELSE 'no pattern hit' END AS cause FROM z LEFT JOIN (SELECT doc_id, true AS hit FROM n) USING (doc_id) WHERE hit IS NULL OR retention < 0.1""",
)
def zero_output_documents(spark, sf_dir):
    i = F.col("doc_id")
    p = table(spark, sf_dir, "documents").select("doc_id", (i % 6 * 100).alias("raw"), F.when(i % 6 == 0, 0.0).otherwise((i % 8) / 10).alias("retention"))
    refs = references.extract(planted(spark, sf_dir)).where("call = 'norms'")
    return report.zero_output(p, refs, refs.where("doc_id < 0"))


@query(
    "validation_sample_sizes",
    f"""WITH {PLANTED}, p AS (SELECT coalesce(category, 'none') AS doc_type, least(50, count(*)) AS n FROM planted WHERE length(text_content) > 200 GROUP BY 1)
    SELECT doc_type, n AS pool, greatest(2, 0) <= n AS two FROM p""",
)
def validation_sample_sizes(spark, sf_dir):
    """Pool by type, and that two of each are sampled; the whole sample has the asked rate (see the test)."""
    d = planted(spark, sf_dir).select("doc_id", F.lit(0).alias("section"), F.coalesce("category", F.lit("none")).alias("doc_type"), F.length("text_content").alias("chars"))
    taken = requirements.sample_for_validation(d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("taken"))
    pools = d.where("chars > 200").groupBy("doc_type").agg(F.least(F.lit(50), F.count(F.lit(1))).alias("pool"))
    return pools.join(taken, "doc_type").select("doc_type", "pool", (F.col("taken") >= 2).alias("two"))


# domain profile and recommendations


def _top_sql(names: dict) -> str:
    best = f"greatest({', '.join(names)})"
    return X.case([(f"{best} > 0 AND {n} = {best}", quote(n)) for n in names], "'none'")


def _profile_sql() -> str:
    one = ", ".join(f"sum(len(regexp_extract_all(t, {rx.re2(*p)}))) AS {n}, count(*) FILTER (WHERE regexp_matches(t, {rx.re2(*p)})) AS docs_{n}" for n, p in domain.DETECTORS.items())
    share = lambda names, c: X.case([(f"{c} = {quote(n)}", f"docs_{n} / CAST(samples AS DOUBLE)") for n in names], "0.0")
    return f"""WITH {PLANTED}, s AS (SELECT count(*) AS samples, {one} FROM (SELECT substr(text_content, 1, 8000) AS t FROM planted)),
      l AS (SELECT language FROM planted GROUP BY 1 ORDER BY count(*) DESC, language DESC LIMIT 1),
      f AS (SELECT *, {_top_sql(domain.REQUIREMENT)} AS requirement_family, {_top_sql(domain.UNIT)} AS unit_family, CASE substr((SELECT language FROM l), 1, 2) WHEN 'de' THEN 'de' WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' ELSE 'mixed' END AS language FROM s),
      rf AS (SELECT string_agg(name || ':' || m || ':' || d, ',' ORDER BY m DESC, k) AS formats FROM (
        {' UNION ALL '.join(f"SELECT {k} AS k, {quote(n)} AS name, {n} AS m, docs_{n} AS d FROM s" for k, n in enumerate(domain.REFERENCE))}) WHERE m > 0)
      SELECT language, requirement_family, round({share(domain.REQUIREMENT, 'requirement_family')}, 6) AS requirement_coverage, unit_family, round({share(domain.UNIT, 'unit_family')}, 6) AS unit_coverage, coalesce(formats, '') AS formats,
        CASE WHEN requirement_family = 'german_modal' AND unit_family = 'mechanical' AND language = 'de' THEN 'automotive_de' WHEN language = 'de' THEN 'generic_de' WHEN language = 'en' THEN 'generic_en' ELSE 'adapted' END AS scorer_profile FROM f, rf"""


@query("domain_profile", _profile_sql())
def domain_profile(spark, sf_dir):
    d = planted(spark, sf_dir)
    p = domain.profile(domain.signals(d), d)
    formats = F.array_join(F.transform("reference_formats", lambda x: F.format_string("%s:%d:%d", x["pattern"], x["matches"], x["documents"])), ",")
    return p.select("language", "requirement_family", F.round("requirement_coverage", 6).alias("requirement_coverage"), "unit_family", F.round("unit_coverage", 6).alias("unit_coverage"), formats.alias("formats"), "scorer_profile")


@query(
    "config_recommendations",
    f"""WITH {TQ._PROJECT_VIEW}, av AS (SELECT after_cleaning / 3.0::DOUBLE AS v FROM px WHERE parse_success AND extension = '.pdf'), ps AS (SELECT list_sort(list(v)) AS p FROM av WHERE v > 0),
      sz AS (SELECT (SELECT count(*) FROM av) AS n, CAST(ceil(p[len(p) // 2 + 1] * 1.15::DOUBLE / 64) * 64 AS BIGINT) AS size FROM ps),
      bp AS ({TQ.SQL['boilerplate_discovery'].replace('WITH l AS', 'WITH bl0 AS').replace('FROM l)', 'FROM bl0)')}), nw AS (SELECT count(*) AS n, max(documents) AS docs FROM bp WHERE NOT covered AND documents >= 5)
    SELECT 'CHUNK_SIZE' AS parameter, CAST(greatest(256, least(1024, size)) AS VARCHAR) AS recommended, CASE WHEN n >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, n AS evidence FROM sz WHERE n >= 3 AND size <> 512
    UNION ALL SELECT 'BOILERPLATE_PATTERNS', 'Add ' || n || ' new pattern(s)', 'HIGH', docs FROM nw WHERE n > 0""",
)
def config_recommendations(spark, sf_dir):
    d = doc_view(spark, sf_dir).select(
        "doc_id", "text_content", "parse_success", F.when(F.col("extension") == ".pdf", "heading_sections").otherwise("sliding_window").alias("strategy"), F.lit(3).alias("headings"), F.lit(0).alias("tables")
    )
    return projection.recommendations(projection.project(d), d, boilerplate.discover(doc_view(spark, sf_dir)))


# sketches and versions

_M32 = "4294967295::UBIGINT"
_SEEDS = ", ".join(str(int(s)) for s in sketch.seeds())


def _hash_sql(units: str, seed: str) -> str:
    """The seeded hash of a list of code units."""
    mixed = f"((xor(h, u) * 1540483477::UBIGINT) & {_M32})"
    fold = f"list_reduce({units}, lambda h, u: xor({mixed}, {mixed} >> 15), xor({seed}, 2538058380::UBIGINT))"
    last = f"list_transform([(xor({fold}, {seed}) * 3432918353::UBIGINT) & {_M32}], lambda x: xor(x, x >> 13))[1]"
    return f"({last} * 461845907::UBIGINT) & {_M32}"


def _signatures(rows: str) -> str:
    """CTEs from ``rows`` (key, tokens) to ``signatures`` (key, signature)."""
    return f"""tk0 AS (SELECT key, unnest(tokens) AS token FROM ({rows})), tk AS (SELECT key, trim(lower(token)) AS token FROM tk0 WHERE trim(lower(token)) <> ''),
      sd AS (SELECT unnest([{_SEEDS}]::UBIGINT[]) AS seed, unnest(range(1, 129)) AS pos),
      tu AS MATERIALIZED (SELECT token, list_transform(range(1, length(token) + 1), lambda i: CAST(unicode(substr(token, i, 1)) AS UBIGINT)) AS units FROM (SELECT DISTINCT token FROM tk)),
      hs AS (SELECT token, pos, {_hash_sql('units', 'seed')} AS h FROM tu CROSS JOIN sd),
      mn AS (SELECT key, pos, min(h) AS h FROM tk JOIN hs USING (token) GROUP BY 1, 2),
      sg0 AS (SELECT key, list(CAST(h AS BIGINT) ORDER BY pos) AS signature FROM mn GROUP BY 1),
      signatures AS (SELECT r.key, coalesce(signature, list_transform(range(0, 128), lambda i: 4294967295)) AS signature FROM ({rows}) r LEFT JOIN sg0 USING (key))"""


@query("sketch_of_headings", f"WITH {PLANTED}, {_signatures('SELECT doc_id AS key, headings AS tokens FROM planted')} SELECT key AS doc_id, md5(array_to_string(signature, ',')) AS digest FROM signatures")
def sketch_of_headings(spark, sf_dir):
    p = planted(spark, sf_dir).select("doc_id", sketch.minhash(F.col("headings")).alias("signature"))
    return p.select("doc_id", F.md5(F.array_join("signature", ",")).alias("digest"))


@query(
    "sketch_similarities",
    f"""WITH {PLANTED}, {_signatures('SELECT doc_id AS key, headings AS tokens FROM planted')} SELECT a.key AS a, b.key AS b,
    len(list_filter(range(1, 129), lambda i: a.signature[i] = b.signature[i])) / 128.0::DOUBLE AS similarity FROM signatures a JOIN signatures b ON b.key = a.key + 3""",
)
def sketch_similarities(spark, sf_dir):
    p = planted(spark, sf_dir).select("doc_id", sketch.minhash(F.col("headings")).alias("signature"))
    other = p.select((F.col("doc_id") - 3).alias("doc_id"), F.col("doc_id").alias("b"), F.col("signature").alias("_s"))
    # signatures that are alike shrink in a shuffle, so its size would call for a broadcast of all of them
    return p.join(other.hint("merge"), "doc_id").select(F.col("doc_id").alias("a"), "b", sketch.minhash_similarity(F.col("signature"), F.col("_s")).alias("similarity"))


def _fingerprints(spark, sf_dir, of_lines: bool = True):
    """Documents with their planted headings, or with all lines of their text in place of headings."""
    lines = F.filter(F.transform(F.split("text_content", "\n"), rx.trim), lambda x: F.length(x) >= 3)
    d = doc_view(spark, sf_dir).withColumn("headings", lines) if of_lines else planted(spark, sf_dir)
    nodes = C.heading_nodes(F.col("headings"))
    density = C.requirement_density(F.col("text_content"), F.col("page_count"))
    return d.select(
        "doc_id", "path", "filename", "extension", "customer", "best_date", "date_source", "parse_success", "char_count",
        F.lit(False).alias("numbered"), C.level_counts(nodes).alias("levels"), sketch.minhash(F.col("headings")).alias("signature"),
        F.lit(None).cast("array<float>").alias("embedding"), density["mandatory"].alias("mandatory"), density["recommended"].alias("recommended"),
    )


_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(filename), '\\.[^.]+$', ''), '[_\\-.\\s]+', ' ', 'g'), 'v?\\d+(\\.\\d+)*', ''), '\\s+', ' ', 'g'))"
_ALL_LINES = "list_filter(list_transform(string_split(text_content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 3)"
_RATIO = lambda a, b: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE least({a}, {b}) / CAST(greatest({a}, {b}) AS DOUBLE) END"


def _pairs_sql(view: str, name: str, lines: str) -> str:
    """CTEs up to ``pairs``: all comparable pairs by a product, scored."""
    return f"""{view}, el AS (SELECT *, {lines} AS lines FROM {name} WHERE parse_success AND char_count >= 200), {_signatures('SELECT doc_id AS key, lines AS tokens FROM el')},
  lv AS (SELECT doc_id, path, extension, customer, best_date, date_source, {_NAME} AS name, signature, len(lines) AS total,
    len(list_filter(lines, lambda h: {Q._LEVEL} = 1)) AS h1, len(list_filter(lines, lambda h: {Q._LEVEL} = 2)) AS h2, len(list_filter(lines, lambda h: {Q._LEVEL} = 3)) AS h3, ({X.count('text_content', Q.PATTERNS['must'])} + {X.count('text_content', Q.PATTERNS['should'])}) / CAST(page_count AS DOUBLE) AS dense
    FROM el JOIN signatures ON key = doc_id),
  ng AS (SELECT x, list_distinct([substr(x, i, 3) for i in range(1, length(x) - 1)]) AS g FROM (SELECT DISTINCT name AS x FROM lv)),
  nn AS (SELECT a.x AS na, b.x AS nb, CASE WHEN a.x = b.x THEN 1.0::DOUBLE WHEN len(a.g) + len(b.g) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) END AS fs FROM ng a CROSS JOIN ng b),
  pr0 AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.name AS na, b.name AS nb, a.total > 0 AND b.total > 0 AND ({_RATIO('a.h2', 'b.h2')}) >= 0.6 AND ({_RATIO('a.total', 'b.total')}) >= 0.6 AS structural_match,
      a.signature AS sa, b.signature AS sb, regexp_replace(a.path, '/?[^/]*$', '') = regexp_replace(b.path, '/?[^/]*$', '') AS same_directory, abs(date_diff('day', a.best_date, b.best_date)) AS days,
      a.date_source = 'mtime' AND b.date_source = 'mtime' AS both_mtime, a.best_date > b.best_date AS later, a.dense AS da, b.dense AS db
    FROM lv a JOIN lv b ON a.doc_id < b.doc_id AND (a.extension = b.extension OR coalesce(a.customer = b.customer, false) OR ({_RATIO('(a.h1 + a.h2)', '(b.h1 + b.h2)')}) >= 0.4)),
  pr1 AS (SELECT *, len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS minhash FROM pr0 JOIN nn USING (na, nb)),
  pr2 AS (SELECT *, CASE WHEN fs >= 0.8 THEN 2 WHEN fs >= 0.5 THEN 1 ELSE 0 END + CASE WHEN structural_match THEN 2 ELSE 0 END + CASE WHEN minhash >= 0.7 THEN 3 WHEN minhash >= 0.4 THEN 2 WHEN minhash >= 0.2 THEN 1 ELSE 0 END
    + CASE WHEN same_directory THEN 1 ELSE 0 END + CASE WHEN NOT both_mtime AND days <= 365 THEN 1 ELSE 0 END AS score FROM pr1),
  pairs AS (SELECT *, CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN NOT both_mtime AND days > 1 THEN CASE WHEN later THEN 'A' ELSE 'B' END WHEN abs(da - db) > 0.5 THEN CASE WHEN da > db THEN 'A' ELSE 'B' END ELSE 'UNKNOWN' END AS likely_newer FROM pr2 WHERE score >= 3)"""


# one distinct line costs 128 hashes in SQL: the two queries that need lines have them, the others planted headings
_PAIRS = _pairs_sql(DOC_VIEW, "doc_view", _ALL_LINES)
_HEADED = _pairs_sql(PLANTED, "planted", "headings")
_PAIR_COLUMNS = "doc_a, doc_b, round(fs, 6) AS filename_similarity, structural_match, minhash, same_directory, CAST(days AS INTEGER) AS days, CAST(score AS INTEGER) AS score, confidence, likely_newer"


def _shown(pairs):
    return pairs.select("doc_a", "doc_b", F.round("filename_similarity", 6).alias("filename_similarity"), "structural_match", "minhash", "same_directory", "days", "score", "confidence", "likely_newer")


@query("version_pairs_high", f"WITH {_PAIRS} SELECT {_PAIR_COLUMNS} FROM pairs WHERE confidence = 'HIGH'")
def version_pairs_high(spark, sf_dir):
    return _shown(versions.high_pairs(_fingerprints(spark, sf_dir)))


_CLASSES = "cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY extension, customer, h1, h2, h3, total, name, signature) AS class_id FROM lv)"


def _classes(spark, sf_dir):
    return versions.classes(_fingerprints(spark, sf_dir, False))


@query("version_pairs", f"WITH {_HEADED} SELECT {_PAIR_COLUMNS} FROM pairs")
def version_pairs(spark, sf_dir):
    """Pairs of documents of every confidence; classes are compared once, then every pair behind them is listed."""
    d = graph.checkpoint(_fingerprints(spark, sf_dir, False))
    of = versions.classes(d)
    return _shown(versions.listed_pairs(versions.class_pairs(of), of.members, d))


@query("version_classes", f"WITH {_HEADED}, {_CLASSES} SELECT doc_id, class_id FROM cl")
def version_classes(spark, sf_dir):
    return _classes(spark, sf_dir).members.select("doc_id", "class_id")


@query(
    "version_chains",
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT doc_a AS a, doc_b AS b FROM pairs WHERE confidence = 'HIGH'), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT r.node, x.b FROM reach r JOIN both_ x ON r.other = x.a),
      comp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
    SELECT component, array_to_string(list(node ORDER BY best_date, node), ',') AS chain FROM comp JOIN doc_view ON doc_id = node GROUP BY 1""",
)
def version_chains(spark, sf_dir):
    d = graph.checkpoint(_fingerprints(spark, sf_dir))
    return versions.chains(versions.high_pairs(d), d).select("component", F.array_join("chain", ",").alias("chain"))


@query("version_histogram", f"WITH {_HEADED} SELECT r AS range, (SELECT count(*) FROM pairs WHERE score BETWEEN lo AND hi) AS pairs FROM (VALUES ('10-12', 10, 12), ('7-9', 7, 9), ('5-6', 5, 6), ('3-4', 3, 4), ('0-2', 0, 2)) AS v(r, lo, hi)")
def version_histogram(spark, sf_dir):
    return versions.histogram(versions.class_pairs(_classes(spark, sf_dir)))


@query("version_audit", f"WITH {_HEADED} SELECT doc_a, string_agg(doc_b || ':' || score, ',' ORDER BY doc_b) AS partners FROM pairs WHERE score >= 5 GROUP BY 1")
def version_audit(spark, sf_dir):
    of = _classes(spark, sf_dir)
    a = versions.audit_documents(versions.class_pairs(of), of.members)
    return a.select("doc_a", F.array_join(F.transform("pairs", lambda x: F.concat_ws(":", x["doc_b"], x["score"])), ",").alias("partners"))


@query("medium_pairs", f"WITH {_HEADED} SELECT doc_a, doc_b FROM pairs WHERE confidence = 'MEDIUM'")
def medium_pairs(spark, sf_dir):
    of = _classes(spark, sf_dir)
    return versions.expand(dashboard.filter_pairs(versions.class_pairs(of), "MEDIUM"), of.members).select("doc_a", "doc_b")


# filters, cohesion, one embedding per text


@query(
    "filtered_file_list",
    f"""WITH {Q._TYPES} SELECT doc_id, filename FROM typed WHERE extension = '.pdf' AND doc_type = 'other' AND contains(lower(concat_ws(' ', filename, path, customer, project)), 'rfq')""",
)
def filtered_file_list(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("doc_type", Q._doc_type())
    return dashboard.filter_files(d, ".pdf", "other", "RFQ").select("doc_id", "filename")


def _toy_vector(text):
    """A stand-in for an embedding model: three character counts at length 1."""
    count = lambda c: F.regexp_count(text, F.lit(c)).cast("double") + 1
    return quality.normalize_vector(F.array(count("e"), count("n"), count("t")))


def _toy_sql(t: str) -> str:
    return "[" + ", ".join(f"len(regexp_extract_all({t}, '{c}')) + 1.0::DOUBLE" for c in "ent") + "]"


@query(
    "intra_chunk_cohesion",
    f"""WITH {TQ._WINDOWS}, m AS (SELECT doc_id, content, length(content) // 2 AS mid FROM w WHERE {sql_tokens('content')} >= 100),
      s AS (SELECT *, length(regexp_extract(substr(content, mid + 1, 30), '(?s)^(\\S*)\\s', 1)) AS skip, regexp_matches(substr(content, mid + 1, 30), '\\s') AS blank FROM m),
      h AS (SELECT doc_id, substr(content, 1, CAST(mid + CASE WHEN blank THEN skip ELSE 0 END AS BIGINT)) AS a, substr(content, CAST(mid + CASE WHEN blank THEN skip ELSE 0 END + 1 AS BIGINT)) AS b FROM s),
      c AS (SELECT doc_id, greatest(-1, least(1, list_cosine_similarity({_toy_sql('a')}, {_toy_sql('b')}))) AS v FROM h)
    SELECT doc_id, round(avg(v), 5) AS mean, round(list_sort(list(v))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1], 5) AS p10, count(*) AS measurable FROM c GROUP BY 1""",
)
def intra_chunk_cohesion(spark, sf_dir):
    out = quality.intra_chunk_cohesion(TQ._windows(spark, sf_dir), _toy_vector)
    return out.select("doc_id", F.round("mean", 5).alias("mean"), F.round("p10", 5).alias("p10"), "measurable")


@query("embedded_once", f"SELECT doc_id, round({_toy_sql('text')}[1] / sqrt(list_dot_product({_toy_sql('text')}, {_toy_sql('text')})), 6) AS x FROM documents")
def embedded_once(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return quality.embed_once(d, _toy_vector).select("doc_id", F.round(F.get("embedding", F.lit(0)), 6).alias("x"))


@query(
    "html_heading_texts",
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>|<h2[^>]*>(.*?)</h2>|<h3[^>]*>(.*?)</h3>|<h4[^>]*>(.*?)</h4>|<h5[^>]*>(.*?)</h5>|<h6[^>]*>(.*?)</h6>')) AS x FROM pages)
    SELECT page_id, trim(regexp_replace(x, '<[^>]+>', '', 'g')) AS heading FROM h WHERE length(trim(regexp_replace(x, '<[^>]+>', '', 'g'))) >= 3""",
)
def html_heading_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(files.html_headings(F.col("html"))).alias("heading"))
