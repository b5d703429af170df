"""Aggregates and filters of the interactive report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions.profile import PATTERNS
from docloom.operators.references import EXTERNAL
from docloom.operators.report import histogram

HEADING_RANGES = [("0", 0, 0), ("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21+", 21, float("inf"))]
TOKEN_RANGES = [("0-100", 0, 100), ("101-300", 101, 300), ("301-600", 301, 600), ("601+", 601, float("inf"))]


def heading_counts(docs: DataFrame) -> DataFrame:
    """Documents of ``docs(headings int)`` by range of headings."""
    return histogram(docs, "headings", HEADING_RANGES)


def heading_depths(docs: DataFrame) -> DataFrame:
    """Headings of ``docs(nodes)`` by level."""
    return docs.select(F.explode("nodes").alias("h")).groupBy("h.level").agg(F.count(F.lit(1)).alias("headings"))


def section_tokens(docs: DataFrame) -> DataFrame:
    """Documents with headings by tokens a section; fractional means between ranges are not counted."""
    means = docs.where("headings > 0").select((F.col("tokens") / F.col("headings")).alias("v"))
    return histogram(means, "v", TOKEN_RANGES)


def kpi_cards(docs: DataFrame) -> DataFrame:
    """(card, value, colour): documents, parse rate, pages, languages; thresholds 95 % and 80 %."""
    k = docs.agg(
        F.count(F.lit(1)).cast("double").alias("documents"),
        F.coalesce(F.avg(F.col("parse_success").cast("int")), F.lit(0.0)).alias("parse_rate"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("double").alias("pages"),
        F.count_distinct("language").cast("double").alias("languages"),
    )
    colour = F.when(F.col("x.value") >= 0.95, "green").when(F.col("x.value") >= 0.80, "amber").otherwise("red")
    rows = F.array(*[F.struct(F.lit(c).alias("card"), F.col(c).alias("value")) for c in ("documents", "parse_rate", "pages", "languages")])
    return k.select(F.explode(rows).alias("x")).select("x.card", "x.value", F.when(F.col("x.card") == "parse_rate", colour).otherwise("blue").alias("colour"))


def parse_health(docs: DataFrame) -> DataFrame:
    """Successes and failures by extension."""
    return docs.groupBy("extension").agg(F.count_if("parse_success").alias("parsed"), F.count_if(~F.col("parse_success")).alias("failed"))


def norm_families(references: DataFrame) -> DataFrame:
    """References and distinct norms by family."""
    norms = references.where(F.col("type").isin(*EXTERNAL))
    return norms.groupBy("type").agg(F.count(F.lit(1)).alias("references"), F.count_distinct(F.coalesce("normalized", "raw_text")).alias("norms"))


def shown_resolution_rate(references: DataFrame) -> DataFrame:
    """The display's rate: external norms count as resolved here."""
    return references.agg(F.coalesce(F.avg(F.col("method").isin("exact", "fuzzy", "external_norm").cast("int")), F.lit(0.0)).alias("rate"))


def progress(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """One row: documents, eligible ones and the pairs among them, n (n - 1) / 2."""
    e = F.count_if(F.col("parse_success") & (F.col("char_count") >= min_chars))
    return docs.agg(F.count(F.lit(1)).alias("documents"), e.alias("eligible")).withColumn("pairs", (F.col("eligible") * (F.col("eligible") - 1) / 2).cast("long"))


def severity_order(checks: DataFrame) -> DataFrame:
    """Failed checks first, by severity, then the passed ones."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return checks.orderBy("passed", rank, "ord")


def filter_files(docs: DataFrame, extension: str = "ALL", kind: str = "ALL", text: str = "", limit: int | None = None) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "filename", "path", "customer", "project"))
    out = docs.where(_equals("extension", extension) & _equals("doc_type", kind) & F.contains(hay, F.lit(text.lower())))
    return out.orderBy("doc_id").limit(limit) if limit else out


def filter_requirements(rows: DataFrame, kind: str = "ALL", safety_only: bool = False, text: str = "") -> DataFrame:
    hit = F.contains(F.lower(F.concat_ws(" ", "heading", "type", "category")), F.lit(text.lower()))
    return rows.where(_equals("type", kind) & (F.col("safety") | F.lit(not safety_only)) & hit)


def filter_pairs(pairs: DataFrame, confidence: str = "ALL") -> DataFrame:
    return pairs.where(_equals("confidence", confidence))


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows any of whose values contains the text."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])), F.lit(text.lower())))


def _equals(column: str, value: str) -> Column:
    return F.lit(True) if value == "ALL" else F.coalesce(F.col(column) == value, F.lit(False))


def type_signals(filename: Column, headings: Column, sample: Column) -> Column:
    """What a decision about the document type saw: booleans for an audit."""
    name = F.lower(filename)
    content = F.lower(F.concat_ws(" ", F.array_join(headings, " "), sample))
    both = lambda a, b: rx.test(name, a, "i") | rx.test(content, b, "i")
    return F.struct(
        F.size(headings).alias("heading_count"),
        both(r"\bfmea\b", r"\bfmea\b").alias("fmea"),
        both(r"\b(srs|irs|lastenheft|anforderung|requirement)\b", r"lastenheft|anforderung|requirement").alias("lastenheft"),
        both(r"testbericht|ergebnisbericht|prüfbericht", r"testbericht|ergebnisbericht").alias("testbericht"),
        both(r"abweichliste", r"abweichliste|abweichungsliste").alias("abweichliste"),
        rx.test(content, r"iso\s*\d|din\s*\d|en\s*\d|\bnorm\b", "i").alias("norm"),
    )


def oem_signals(text: Column) -> Column:
    hit = lambda p: rx.test(text, *PATTERNS[p])
    word = lambda p: rx.test(text, p, "i")
    return F.struct(
        hit("fikb").alias("fikb"), hit("kb_master").alias("kb_master"), hit("quality_spec").alias("quality_spec"),
        word(r"\bmerced(es|benz)\b").alias("mercedes"), word(r"\bbmw\b").alias("bmw"), word(r"\baudi\b").alias("audi"),
    )
