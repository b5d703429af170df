"""Queries over the inputs of the narrative report, model inputs and model ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import graph, narrative, parse, quality, report, requirements, versions
from docloom.operators.references import EXTERNAL, INTERNAL
from docloom.sources import models

from . import planted_queries as Q
from . import report_queries as R
from . import text_queries as TQ
from .planted import PLANTED, planted
from .views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

THIS_YEAR = 2026
DELTA, SAMPLED = 0.25, 10


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _figure(metric: str, value: str, source: str, key: str = "''") -> str:
    return f"SELECT '{metric}' AS metric, {key} AS key, CAST({value} AS DOUBLE) AS value FROM {source}"


def _figures(source: str, **values: str) -> str:
    return " UNION ALL ".join(_figure(m, v, source) for m, v in values.items())


def _by(metric: str, column: str, source: str, value: str = "count(*)") -> str:
    return f"SELECT '{metric}', coalesce({column}, 'unknown'), CAST({value} AS DOUBLE) FROM {source} GROUP BY 2"


def _rounded(sql: str) -> str:
    head, _, body = sql.partition("\nSELECTED\n")
    return f"{head} SELECT metric, key, round(value, 6) AS value FROM ({body})"


def _parsed(spark, sf_dir):
    """One pass over the texts; the figures read its rows, which hold none."""
    return graph.checkpoint(R._parsed(spark, sf_dir))


def _shown(df):
    return df.select("metric", "key", F.round("value", 6).alias("value"))


_STALE = f"year(mtime) <= {THIS_YEAR - narrative.STALE_YEARS}"
_SCORE = f"(SELECT score FROM ({R.SQL['metadata_score']}))"


@query(
    "narrative_overview",
    _rounded(
        f"WITH {R._PARSED}\nSELECTED\n"
        + _figures(
            "parsed",
            documents="count(*)",
            parse_failures="count(*) FILTER (WHERE NOT parse_success)",
            scanned="count(*) FILTER (WHERE pdf_class = 'fully_scanned')",
            hybrid="count(*) FILTER (WHERE pdf_class = 'hybrid')",
            stale=f"count(*) FILTER (WHERE {_STALE})",
            dated_inside="count(*) FILTER (WHERE date_source <> 'mtime')",
        )
        + f" UNION ALL {_figure('metadata_score', _SCORE, '(SELECT 1)')} UNION ALL SELECT 'folder_confidence', pattern, confidence FROM ({Q.SQL['folder_inference']})"
        + "".join(f" UNION ALL {_by(m, c, 'parsed')}" for m, c in (("type", "doc_type"), ("language", "language"), ("customer", "oem")))
    ),
)
def narrative_overview(spark, sf_dir):
    return _shown(narrative.corpus_overview(_parsed(spark, sf_dir), Q.folder_inference(spark, sf_dir), THIS_YEAR, DELTA, SAMPLED))


def _planted_pairs(spark, sf_dir):
    return versions.class_pairs(R._classes(spark, sf_dir))


@query(
    "narrative_pairs",
    _rounded(
        f"WITH {R._HEADED}\nSELECTED\n"
        + _figures("pairs", pairs="count(*)", **{c.lower(): f"count(*) FILTER (WHERE confidence = '{c}')" for c in ("HIGH", "MEDIUM", "LOW")}, semantic="0 * count(*)")
    ),
)
def narrative_pairs(spark, sf_dir):
    return _shown(narrative.version_pairs(_planted_pairs(spark, sf_dir)))


@query(
    "narrative_top_pairs",
    f"""WITH {R._HEADED}, top AS (SELECT * FROM pairs WHERE confidence IN ('HIGH', 'MEDIUM') ORDER BY score DESC, doc_a, doc_b LIMIT {narrative.SHOWN})
    SELECT doc_a, doc_b, substr(a.filename, 1, 50) AS name_a, substr(b.filename, 1, 50) AS name_b, CAST(score AS INTEGER) AS score, confidence, likely_newer, round(minhash, 6) AS minhash, a.date_source AS date_source_a, b.date_source AS date_source_b
    FROM top JOIN planted a ON a.doc_id = doc_a JOIN planted b ON b.doc_id = doc_b""",
)
def narrative_top_pairs(spark, sf_dir):
    docs = R._fingerprints(spark, sf_dir, False)
    of = versions.classes(docs)
    top = narrative.top_pairs(versions.class_pairs(of), of.members, docs)
    return top.select("doc_a", "doc_b", "name_a", "name_b", "score", "confidence", "likely_newer", F.round("minhash", 6).alias("minhash"), "date_source_a", "date_source_b")


_NEEDS = Q._REQUIREMENTS.removeprefix(PLANTED + ",")
_VALID = f"SELECT avg(o) AS d, 1.96 * coalesce(stddev_samp(o), 0) / sqrt(count(*)) AS half FROM (SELECT {Q._OFF} AS o FROM ({Q._SAMPLED}))"


@query(
    "narrative_requirements",
    _rounded(
        f"WITH {R._PARSED}, {_NEEDS}, va AS ({_VALID})\nSELECTED\n"
        + _figures("requirements", requirements="count(*)", safety="count(*) FILTER (WHERE safety)")
        + f" UNION ALL {_figures('parsed', reliable_documents='count(*) FILTER (WHERE reliable)')} UNION ALL {_by('type', 'type', 'requirements')} UNION ALL {_figures('va', delta='d', delta_low='d - half', delta_high='d + half')}"
    ),
)
def narrative_requirements(spark, sf_dir):
    valid = requirements.validation(Q._sampled(spark, sf_dir))
    needs = graph.checkpoint(Q._requirements(spark, sf_dir).select("type", "safety"))
    return _shown(narrative.requirement_figures(needs, R._parsed(spark, sf_dir), valid))


@query(
    "uncertain_documents",
    f"""WITH {R._PARSED}, {_NEEDS}, q AS ({Q.SQL['requirement_quality'].split('WITH ' + Q._REQUIREMENTS)[1]})
    SELECT doc_id, substr(filename, 1, 50) AS name, doc_type, confirmed, uncertain, negated, raw FROM q JOIN parsed USING (doc_id) WHERE uncertain > confirmed""",
)
def uncertain_documents(spark, sf_dir):
    return narrative.uncertain_documents(Q._requirements(spark, sf_dir), R._parsed(spark, sf_dir))


@query(
    "narrative_strategies",
    _rounded(
        f"WITH {R._PARSED}\nSELECTED\n{_figures('parsed', documents='count(*)')} UNION ALL {_by('strategy', 'strategy', 'parsed')} UNION ALL {_by('confidence', 'strategy', 'parsed', 'avg(strategy_confidence)')}"
    ),
)
def narrative_strategies(spark, sf_dir):
    return _shown(narrative.chunk_strategies(_parsed(spark, sf_dir)))


def _examples(kind: str, test: str) -> str:
    return f"""(SELECT '{kind}' AS kind, doc_id, substr(filename, 1, 50) AS name, doc_type, strategy, round(strategy_confidence, 6) AS strategy_confidence, CAST(headings AS INTEGER) AS headings, pdf_class, alternative
      FROM parsed WHERE {test} ORDER BY doc_id LIMIT {narrative.SHOWN})"""


@query("strategy_examples", f"WITH {R._PARSED} SELECT * FROM {_examples('low confidence', 'strategy_confidence < 0.7')} UNION ALL SELECT * FROM {_examples('alternative', 'alternative IS NOT NULL')}")
def strategy_examples(spark, sf_dir):
    return narrative.strategy_examples(_parsed(spark, sf_dir)).withColumn("strategy_confidence", F.round("strategy_confidence", 6))


@query(
    "narrative_parsers",
    _rounded(
        f"WITH {R._PARSED}\nSELECTED\n"
        + _figures(
            "parsed",
            office="count(*) FILTER (WHERE extension IN ('.docx', '.xlsx', '.pptx'))",
            pdf="count(*) FILTER (WHERE extension = '.pdf')",
            full_ocr="count(*) FILTER (WHERE scanned_ratio > 0.5)",
            part_ocr="count(*) FILTER (WHERE scanned_ratio > 0.1 AND scanned_ratio <= 0.5)",
        )
    ),
)
def narrative_parsers(spark, sf_dir):
    return _shown(narrative.parser_reliability(R._parsed(spark, sf_dir)))


@query(
    "first_parse_failures",
    f"""WITH {R._EXTRACTED} SELECT doc_id, substr(filename, 1, 50) AS name, CASE WHEN garbled THEN 'garbled_encoding' ELSE 'empty_extraction' END AS reason
    FROM pg WHERE NOT (chars > 100 AND NOT garbled) ORDER BY doc_id LIMIT {narrative.SHOWN}""",
)
def first_parse_failures(spark, sf_dir):
    return narrative.parse_failures(parse.parse(R._extracted(spark, sf_dir)))


_INTERNAL, _EXTERNAL = f"type IN {Q._IN(INTERNAL)}", f"type IN {Q._IN(EXTERNAL)}"
_OPEN = f"{_INTERNAL} AND method = 'unresolved'"


@query(
    "narrative_references",
    _rounded(
        f"WITH {Q._RESOLVED}\nSELECTED\n"
        + _figures(
            "resolved",
            references="count(*)",
            resolved_internal=f"count(*) FILTER (WHERE {_INTERNAL} AND method <> 'unresolved')",
            unresolved_internal=f"count(*) FILTER (WHERE {_OPEN})",
            external_norms="count(*) FILTER (WHERE method = 'external_norm')",
            missing="count(*) FILTER (WHERE classification = 'likely_missing_from_corpus')",
            matcher_failures="count(*) FILTER (WHERE classification = 'likely_matcher_failure')",
            resolution_rate=f"count(*) FILTER (WHERE {_INTERNAL} AND method <> 'unresolved') / CAST(greatest(count(*) FILTER (WHERE {_INTERNAL}), 1) AS DOUBLE)",
        )
        + f" UNION ALL {_by('type', 'type', 'resolved')}"
        + f" UNION ALL SELECT * FROM (SELECT 'norm', coalesce(normalized, raw_text) AS n, CAST(count(*) AS DOUBLE) AS c FROM resolved WHERE {_EXTERNAL} GROUP BY 2 ORDER BY c DESC, n LIMIT {narrative.NORMS_SHOWN})"
    ),
)
def narrative_references(spark, sf_dir):
    return _shown(narrative.reference_graph(graph.checkpoint(Q._resolved(spark, sf_dir))))


@query(
    "unresolved_by_document",
    f"WITH {Q._RESOLVED} SELECT substr(filename, 1, 50) AS name, count(*) AS unresolved FROM resolved JOIN planted USING (doc_id) WHERE {_OPEN} GROUP BY 1 ORDER BY unresolved DESC, name LIMIT {narrative.SHOWN}",
)
def unresolved_by_document(spark, sf_dir):
    return narrative.unresolved_by_document(Q._resolved(spark, sf_dir), planted(spark, sf_dir))


_CHECKS = f"({R.SQL['consistency_checks']})"
_HIGH = f"(SELECT count(*) FILTER (WHERE confidence = 'HIGH') AS high, count(*) AS n FROM (WITH {R._HEADED} SELECT confidence FROM pairs))"


@query(
    "narrative_synthesis",
    _rounded(
        f"""WITH {R._PARSED}, {Q._RESOLVED.removeprefix(PLANTED + ', ')}, ck AS (SELECT * FROM {_CHECKS}), hp AS {_HIGH},
        dd AS (SELECT avg(CASE WHEN parse_success THEN 1 ELSE 0 END) AS ok, count(*) FILTER (WHERE strategy_confidence < 0.7) AS low, count(*) FILTER (WHERE scanned_ratio > 0.5) AS full_ocr,
          avg(CASE WHEN language IN ('deu', 'und') THEN 0 ELSE 1 END) AS mix, avg(CASE WHEN {_STALE} THEN 1 ELSE 0 END) AS stale FROM parsed),
        rr AS (SELECT count(*) FILTER (WHERE {_INTERNAL} AND method IN ('exact', 'fuzzy')) / CAST(greatest(count(*) FILTER (WHERE {_INTERNAL}), 1) AS DOUBLE) AS rate, count(*) FILTER (WHERE classification = 'likely_missing_from_corpus') AS missing FROM resolved),
        cc AS (SELECT count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS crit, count(*) FILTER (WHERE NOT passed AND severity = 'WARNING') AS warn FROM ck)
        \nSELECTED\n"""
        + _figures("dd", parse_success_rate="ok", low_confidence="low", full_ocr="full_ocr", language_mix_rate="mix", stale_rate="stale")
        + f" UNION ALL {_figures('hp', high_pairs='high', has_pairs='CASE WHEN n > 0 THEN 1 ELSE 0 END')} UNION ALL {_figures('rr', resolution_rate='rate', missing='missing')}"
        + f" UNION ALL {_figures('cc', critical_checks='crit', warning_checks='warn')} UNION ALL {_figure('metadata_score', _SCORE, '(SELECT 1)')}"
        + f" UNION ALL {_figure('actionable', 'CASE WHEN crit > 0 OR full_ocr > 0 OR missing > 0 THEN 1 ELSE 0 END', 'dd, rr, cc')}"
        + " UNION ALL SELECT * FROM (SELECT 'dominant_strategy', strategy, CAST(count(*) AS DOUBLE) AS c FROM parsed GROUP BY 2 ORDER BY c DESC, strategy LIMIT 1)"
    ),
)
def narrative_synthesis(spark, sf_dir):
    docs, refs = _parsed(spark, sf_dir), graph.checkpoint(Q._resolved(spark, sf_dir))
    checks = graph.checkpoint(R._checked(spark, sf_dir, docs, refs))
    return _shown(narrative.retrieval_synthesis(docs, graph.checkpoint(_planted_pairs(spark, sf_dir)), refs, checks, THIS_YEAR, DELTA, SAMPLED))


@query(
    "first_failed_checks",
    f"""SELECT name, severity FROM (SELECT *, list_position(['CORPUS_EMPTY', 'CORPUS_TOO_SMALL', 'sectionSizeEstimate', 'versionPairSymmetry', 'referenceResolutionRate', 'requirementDensityRange', 'parserDivergenceRate', 'scannedPdfRate', 'oemConsistency',
      'languageMixRate', 'entityCoverage', 'llmValidationDelta', 'parseSuccessRate', 'chunkStrategyConfidence', 'oemSourceConflict', 'uniformTimestamps'], name) AS place FROM {_CHECKS}) WHERE NOT passed AND name <> 'requirementDensityRange' ORDER BY place LIMIT {narrative.SHOWN}""",
)
def first_failed_checks(spark, sf_dir):
    """One check has a row a document; it is left out here, its rows would fill the list."""
    return narrative.failed_checks(R._checked(spark, sf_dir).where("name <> 'requirementDensityRange'")).select("name", "severity")


@query(
    "narrative_chunk_quality",
    f"""WITH s AS ({TQ.SQL['chunk_quality_summary']}), w AS ({TQ.SQL['weakest_metrics']})
    {_figures('s', chunks='chunks', share_good='round(share_good, 2)', share_acceptable='round(share_acceptable, 2)', share_poor='round(share_poor, 2)', index_mean='round(index_mean, 3)')}
    UNION ALL {_figures(f"(SELECT count(*) AS n FROM (WITH {TQ._CONTENT} SELECT DISTINCT doc_id FROM ix))", documents='n')} UNION ALL SELECT 'weakest', metric, round(mean, 2) FROM w""",
)
def narrative_chunk_quality(spark, sf_dir):
    per = graph.checkpoint(quality.per_document(quality.composite(TQ._scored(spark, sf_dir))))
    return narrative.chunk_quality(per)


# model inputs and ranking


@query("document_embedding_inputs", f"WITH {PLANTED} SELECT doc_id, substr('HEADINGS: ' || array_to_string(headings[1:50], ' | '), 1, 1260) AS input FROM planted")
def document_embedding_inputs(spark, sf_dir):
    return models.document_inputs(planted(spark, sf_dir))


@query(
    "section_embedding_inputs",
    f"WITH {PLANTED} SELECT doc_id, CAST(position AS INTEGER) AS position, substr(h, 1, 80) AS path, substr(h, 1, 630) AS input FROM (SELECT doc_id, unnest(headings) AS h, generate_subscripts(headings, 1) - 1 AS position FROM planted)",
)
def section_embedding_inputs(spark, sf_dir):
    return models.section_inputs(planted(spark, sf_dir))


def _catalog(spark, sf_dir):
    size = (F.col("p_retailprice") * 100).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("size"), (F.col("p_size") % 30).alias("min_memory"), (F.col("p_partkey") % 7 == 0).alias("validated"))


def _ranked(memory: float, gpu: bool) -> str:
    fits = f"(min_memory = 0 OR ({str(gpu).lower()} AND min_memory <= {memory} * 0.85))"
    return f"""WITH c AS (SELECT *, {fits} AS fits FROM (SELECT p_partkey AS id, CAST(trunc(p_retailprice * 100) AS BIGINT) AS size, p_size % 30 AS min_memory, p_partkey % 7 = 0 AS validated FROM part)),
      b AS (SELECT id FROM c WHERE validated ORDER BY fits DESC, CASE WHEN fits THEN -size ELSE size END, id LIMIT 1), x AS (SELECT id FROM c WHERE validated AND NOT fits ORDER BY size, id LIMIT 1),
      p AS (SELECT *, id IN (SELECT id FROM b) AS recommended, CASE WHEN id IN (SELECT id FROM b) THEN 0 WHEN fits AND validated THEN 1 WHEN fits THEN 2 WHEN id IN (SELECT id FROM x) THEN 3 END AS place FROM c)
      SELECT CAST(row_number() OVER (ORDER BY place, size DESC, id) AS INTEGER) AS rank, id, size, fits, recommended FROM p WHERE place IS NOT NULL ORDER BY rank LIMIT 10"""


@query("ranked_models", _ranked(8.0, True))
def ranked_models(spark, sf_dir):
    return models.rank_models(_catalog(spark, sf_dir), True, 8.0)


@query("ranked_models_without_gpu", _ranked(0.0, False))
def ranked_models_without_gpu(spark, sf_dir):
    return models.rank_models(_catalog(spark, sf_dir), False, 0.0)
