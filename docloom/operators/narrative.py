"""Inputs of the narrative report: eight content-safe aggregates, and the report that a model writes from them.

Figures come as rows (metric, key, value); key is '' unless a metric has one row a key.
Examples come as rows of their own: a few documents or pairs, in a defined order, names cut.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import graph, quality, report, versions
from docloom.operators.references import EXTERNAL, INTERNAL
from docloom.sources.models import strip_fences

#: Characters of a file name, examples, norms shown, least confidence, least answer.
NAME_CHARS = 50
SHOWN = 5
NORMS_SHOWN = 8
LEAST_CONFIDENCE = 0.7
LEAST_ANSWER = 100
STALE_YEARS = 3


def shown_name(name: Column) -> Column:
    return F.substring(name, 1, NAME_CHARS)


def _figures(one_row: DataFrame) -> DataFrame:
    """The columns of one row as (metric, '', value)."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.explode(rows).alias("x")).select("x.*")


def _by(df: DataFrame, column: str, metric: str, value: Column | None = None) -> DataFrame:
    """(metric, key, value): rows, or an aggregate of them, by a column."""
    grouped = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("key"))
    value = F.count(F.lit(1)) if value is None else value
    return grouped.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0.0))


def _stale(this_year: int) -> Column:
    return F.year("mtime") <= this_year - STALE_YEARS


def corpus_overview(docs: DataFrame, folders: DataFrame, this_year: int, delta: float | None = None, sampled: int = 0) -> DataFrame:
    """Figures of ``docs`` by type, language and customer, of failures, scans, dates and the metadata score.

    ``folders`` is the one row of ``report.folder_inference``; its pattern is the key of its confidence.
    """
    one = docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~F.col("parse_success")).alias("parse_failures"),
        F.count_if(F.expr("pdf_class = 'fully_scanned'")).alias("scanned"),
        F.count_if(F.expr("pdf_class = 'hybrid'")).alias("hybrid"),
        F.count_if(_stale(this_year)).alias("stale"),
        F.count_if(F.expr("date_source <> 'mtime'")).alias("dated_inside"),
    )
    score = report.metadata_score(docs, delta, sampled).select(F.col("score").alias("metadata_score"))
    folder = folders.select(F.lit("folder_confidence").alias("metric"), F.col("pattern").alias("key"), F.col("confidence").alias("value"))
    return _union(_figures(one), _figures(score), folder, _by(docs, "doc_type", "type"), _by(docs, "language", "language"), _by(docs, "oem", "customer"))


def version_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of documents by confidence, and whether vectors had a part in any; from class pairs."""
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("pairs"))), F.lit(0))
    named = [total(F.col("confidence") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")]
    semantic = F.coalesce(F.max((F.col("semantic") > 0).cast("int")), F.lit(0))
    return _figures(pairs.agg(total(F.lit(True)).alias("pairs"), *named, semantic.alias("semantic")))


def top_pairs(pairs: DataFrame, members: DataFrame, docs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The HIGH and MEDIUM pairs of the highest score, with names and date sources of both sides.

    ``pairs`` are class pairs, ``members`` their documents, ``docs`` the rows that pairs are scored from.
    """
    ids = versions.first_pairs(pairs.where(F.col("confidence").isin("HIGH", "MEDIUM")), members, n)
    top = versions.pairs_of(ids, docs)
    out = top = graph.checkpoint(top)  # n rows, read three times
    ids = top.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    named = docs.select("doc_id", shown_name(F.col("filename")).alias("name"), "date_source").join(F.broadcast(ids), "doc_id")
    for side in ("a", "b"):
        other = named.select(F.col("doc_id").alias(f"doc_{side}"), F.col("name").alias(f"name_{side}"), F.col("date_source").alias(f"date_source_{side}"))
        out = out.join(other, f"doc_{side}", "left")
    shown = [F.coalesce(f"name_{s}", F.col(f"doc_{s}").cast("string")).alias(f"name_{s}") for s in "ab"]
    sources = [F.coalesce(f"date_source_{s}", F.lit("unknown")).alias(f"date_source_{s}") for s in "ab"]
    return out.select("doc_a", "doc_b", *shown, "score", "confidence", "likely_newer", "filename_similarity", "structural_match", "minhash", "semantic", *sources, "flag")


def requirement_figures(requirements: DataFrame, docs: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """Requirements by type, safety ones, reliable documents, and the delta of a validation of three documents or more."""
    one = requirements.agg(F.count(F.lit(1)).alias("requirements"), F.count_if("safety").alias("safety"))
    parts = [_figures(one), _figures(docs.agg(F.count_if("reliable").alias("reliable_documents"))), _by(requirements, "type", "type")]
    if validation is not None:
        parts.append(_figures(validation.where("documents >= 3").select("delta", F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))))
    return _union(*parts)


def uncertain_documents(requirements: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of more uncertain than confirmed requirements."""
    from docloom.operators.requirements import quality_by_document

    bad = quality_by_document(requirements).where("uncertain > confirmed")
    named = docs.select("doc_id", shown_name(F.col("filename")).alias("name"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"))
    return bad.join(named, "doc_id").select("doc_id", "name", "doc_type", "confirmed", "uncertain", "negated", "raw")


def chunk_strategies(docs: DataFrame) -> DataFrame:
    """Documents and mean confidence by strategy."""
    total = _figures(docs.agg(F.count(F.lit(1)).alias("documents")))
    return _union(total, _by(docs, "strategy", "strategy"), _by(docs, "strategy", "confidence", F.avg("strategy_confidence")))


def strategy_examples(docs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first documents of low confidence and the first with an alternative, by doc_id."""
    row = ("doc_id", shown_name(F.col("filename")).alias("name"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), "strategy", "strategy_confidence", "headings", "pdf_class", "alternative")
    first = lambda kind, test: docs.where(test).orderBy("doc_id").limit(n).select(F.lit(kind).alias("kind"), *row)
    return first("low confidence", F.col("strategy_confidence") < LEAST_CONFIDENCE).unionByName(first("alternative", F.col("alternative").isNotNull()))


def _full_ocr() -> Column:
    return F.col("scanned_ratio") > 0.5


def parser_reliability(docs: DataFrame) -> DataFrame:
    """Office files, PDFs and how many of all need optical recognition, whole or in part."""
    one = docs.agg(
        F.count_if(F.col("extension").isin(".docx", ".xlsx", ".pptx")).alias("office"),
        F.count_if(F.expr("extension = '.pdf'")).alias("pdf"),
        F.count_if(_full_ocr()).alias("full_ocr"),
        F.count_if(F.expr("scanned_ratio > 0.1 AND scanned_ratio <= 0.5")).alias("part_ocr"),
    )
    return _figures(one)


def parse_failures(docs: DataFrame, n: int = SHOWN) -> DataFrame:
    bad = docs.where(~F.col("parse_success")).orderBy("doc_id").limit(n)
    return bad.select("doc_id", shown_name(F.col("filename")).alias("name"), F.coalesce("parse_failure_reason", F.lit("unknown")).alias("reason"))


def reference_graph(references: DataFrame) -> DataFrame:
    """References by type, resolved and unresolved internal ones, external norms, causes, and the norms used most."""
    internal, unresolved = F.col("type").isin(*INTERNAL), F.col("method") == "unresolved"
    one = references.agg(
        F.count(F.lit(1)).alias("references"),
        F.count_if(internal & ~unresolved).alias("resolved_internal"),
        F.count_if(internal & unresolved).alias("unresolved_internal"),
        F.count_if(F.expr("method = 'external_norm'")).alias("external_norms"),
        F.count_if(F.expr("classification = 'likely_missing_from_corpus'")).alias("missing"),
        F.count_if(F.expr("classification = 'likely_matcher_failure'")).alias("matcher_failures"),
    )
    rate = F.col("resolved_internal") / F.greatest(F.col("resolved_internal") + F.col("unresolved_internal"), F.lit(1))
    norms = references.where(F.col("type").isin(*EXTERNAL)).withColumn("norm", F.coalesce("normalized", "raw_text"))
    top = _by(norms, "norm", "norm").orderBy(F.desc("value"), "key").limit(NORMS_SHOWN)
    return _union(_figures(one.withColumn("resolution_rate", rate)), _by(references, "type", "type"), top)


def unresolved_by_document(references: DataFrame, docs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The file names with most unresolved internal references; documents of one shown name count together."""
    open_ = references.where(F.col("type").isin(*INTERNAL) & (F.col("method") == "unresolved"))
    per = open_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(docs.select("doc_id", shown_name(F.col("filename")).alias("name")), "doc_id", "left")
    grouped = named.groupBy(F.coalesce("name", F.col("doc_id").cast("string")).alias("name")).agg(F.sum("n").alias("unresolved"))
    return grouped.orderBy(F.desc("unresolved"), "name").limit(n)


def retrieval_synthesis(docs: DataFrame, pairs: DataFrame, references: DataFrame, checks: DataFrame, this_year: int, delta: float | None = None, sampled: int = 0) -> DataFrame:
    """What a retrieval project has to know: rates, repairs that are due, and whether any is."""
    d = docs.agg(
        _share(F.col("parse_success")).alias("parse_success_rate"),
        F.count_if(F.col("strategy_confidence") < LEAST_CONFIDENCE).alias("low_confidence"),
        F.count_if(_full_ocr()).alias("full_ocr"),
        _share(~F.col("language").isin("deu", "und")).alias("language_mix_rate"),
        _share(_stale(this_year)).alias("stale_rate"),
    )
    p = pairs.agg(F.coalesce(F.sum(F.when(F.col("confidence") == "HIGH", F.col("pairs"))), F.lit(0)).alias("high_pairs"), (F.count(F.lit(1)) > 0).cast("int").alias("has_pairs"))
    internal = F.col("type").isin(*INTERNAL)
    hit = internal & F.col("method").isin("exact", "fuzzy")
    r = references.agg(
        (F.count_if(hit) / F.greatest(F.count_if(internal), F.lit(1))).alias("resolution_rate"),
        F.count_if(F.expr("classification = 'likely_missing_from_corpus'")).alias("missing"),
    )
    c = checks.agg(*[F.count_if(~F.col("passed") & (F.col("severity") == s)).alias(f"{s.lower()}_checks") for s in ("CRITICAL", "WARNING")])
    score = report.metadata_score(docs, delta, sampled).select(F.col("score").alias("metadata_score"))
    one = d
    for other in (p, r, c, score):  # one row each
        one = one.crossJoin(F.broadcast(other))
    due = (F.col("critical_checks") > 0) | (F.col("full_ocr") > 0) | (F.col("missing") > 0)
    strategy = docs.groupBy("strategy").agg(F.count(F.lit(1)).cast("double").alias("value")).orderBy(F.desc("value"), "strategy").limit(1)
    dominant = strategy.select(F.lit("dominant_strategy").alias("metric"), F.col("strategy").alias("key"), "value")
    return _union(_figures(one.withColumn("actionable", due.cast("int"))), dominant)


def failed_checks(checks: DataFrame, n: int = SHOWN) -> DataFrame:
    """Names of the first failed checks in order of the checks; their texts are clamped already."""
    return checks.where(~F.col("passed")).orderBy("ord", "name").limit(n).select("name", "severity", "interpretation")


def chunk_quality(documents: DataFrame) -> DataFrame:
    """Rounded figures of ``quality.per_document``: chunks, index, bucket shares and the weakest metrics."""
    s = quality.corpus_summary(documents)
    rounded = s.select("chunks", *[F.round(f"share_{b}", 2).alias(f"share_{b}") for b in ("good", "acceptable", "poor")], F.round("index_mean", 3).alias("index_mean"))
    weakest = quality.weakest_metrics(documents).select(F.lit("weakest").alias("metric"), F.col("metric").alias("key"), F.round("mean", 2).alias("value"))
    return _union(_figures(rounded), _figures(documents.agg(F.count(F.lit(1)).alias("documents"))), weakest)


def placeholder(reason: str) -> str:
    return f"> **No narrative:** {reason}"


def write(sections: dict[str, tuple[str, list[DataFrame]]], complete: Callable[[str], str]) -> str:
    """The report in Markdown: per title an instruction and its small inputs, which a model turns into text.

    Strings are clamped and guarded before they leave; the inputs are aggregates and examples, small by
    construction.  A failed call or an answer under ``LEAST_ANSWER`` characters leaves a placeholder there,
    and the other sections go on.
    """
    out = []
    for title, (instruction, inputs) in sections.items():
        try:
            rows = []
            for df in inputs:
                safe = report.clamp_strings(df)
                report.leak_guard(safe)
                rows.append([json.loads(r) for r in safe.toJSON().collect()])
            answer = strip_fences(complete(f"{instruction}\n{json.dumps(rows, ensure_ascii=False)}"))
            text = answer if len(answer) >= LEAST_ANSWER else placeholder("the answer was too short")
        except Exception as e:  # one section without text, not a lost report
            text = placeholder(f"{type(e).__name__}")
        out += [f"## {title}", "", text, ""]
    return "\n".join(out)
