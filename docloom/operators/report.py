"""Aggregates of reports, content-safe sinks and their guards."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

LIMIT = 120


def count_by(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def folder_inference(files: DataFrame) -> DataFrame:
    """One row of ``files(depth, customer, project, category)``: likely pattern and confidence."""
    names = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    s = files.agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.avg("depth").alias("mean"), names("customer"), names("project"), names("category"))
    rules = (
        (F.col("n") == 0, "empty", 0.0),
        ((F.col("hi") - F.col("lo") <= 1) & (F.col("mean") <= 2), "flat", 0.7),
        ((F.size("categorys") > 0) & (F.size("projects") > 0), "project/doc-category/docs", 0.85),
        ((F.size("customers") > 0) & (F.size("projects") > 0), "customer/project/offer-version/docs", 0.75),
        (F.col("mean") >= 3, "deep-nested", 0.5),
    )
    pattern, confidence = F.lit("unknown"), F.lit(0.3)
    for test, name, c in reversed(rules):
        pattern, confidence = F.when(test, name).otherwise(pattern), F.when(test, c).otherwise(confidence)
    return s.select(pattern.alias("pattern"), confidence.cast("double").alias("confidence"), "customers", "projects", F.col("categorys").alias("categories"))


def category_pivot(docs: DataFrame) -> DataFrame:
    """Documents by project: rfq, quotation, uncategorized, total."""
    return docs.groupBy(F.coalesce("project", F.lit("unknown")).alias("project")).agg(
        F.count_if(F.col("category") == "rfq").alias("rfq"),
        F.count_if(F.col("category") == "quotation").alias("quotation"),
        F.count_if(F.col("category").isNull()).alias("uncategorized"),
        F.count(F.lit(1)).alias("total"),
    )


def freshness(docs: DataFrame, this_year: int) -> DataFrame:
    """Documents by year, and whether that is stale."""
    years = docs.groupBy(F.year("best_date").alias("year")).agg(F.count(F.lit(1)).alias("documents"))
    return years.withColumn("stale", F.col("year") <= this_year - 3)


def type_breakdown(docs: DataFrame) -> DataFrame:
    """Means and shares by document type; ``confirmed`` counts the confirmed requirements of a document."""
    dominant = F.mode("strategy", True)
    return docs.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("page_count").alias("avg_pages"),
        F.avg((F.col("language") == "deu").cast("int")).alias("german_share"),
        F.avg((F.col("headings") > 0).cast("int")).alias("heading_share"),
        F.avg(F.coalesce("confirmed", F.lit(0))).alias("avg_confirmed"),
        F.avg(F.col("pdf_class").isin("fully_scanned", "hybrid").cast("int")).alias("scanned_share"),
        F.count_if("reliable").alias("reliable"),
        dominant.alias("strategy"),
    )


def metadata_score(docs: DataFrame, delta: float | None = None, sampled: int = 0) -> DataFrame:
    """One row: 30 success + 20 headings + 20 requirements + 30 OCR, rounded; 0 for no documents."""
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    req = 1 - min(delta, 1.0) if delta is not None and sampled >= 3 else 0.5
    pdf = F.when(F.col("extension") == ".pdf", F.col("pdf_class").isin("fully_scanned", "hybrid").cast("int"))
    s = docs.agg(F.count(F.lit(1)).alias("n"), share(F.col("parse_success")).alias("success"), share(F.col("headings") > 0).alias("with_headings"), F.coalesce(F.avg(pdf), F.lit(0.0)).alias("ocr"))
    score = F.floor(F.col("success") * 30 + F.col("with_headings") * 20 + F.lit(req) * 20 + (1 - F.col("ocr")) * 30 + 0.5)
    total = F.when(F.col("n") == 0, 0).otherwise(score).cast("int")
    text = F.when(F.col("n") == 0, "unavailable").when(total >= 80, "reliable").when(total >= 60, "use with caution").otherwise("not a base for decisions")
    return s.select(total.alias("score"), "success", "with_headings", "ocr", text.alias("interpretation"))


def histogram(df: DataFrame, column: str, edges: list[tuple[str, float, float]]) -> DataFrame:
    """Rows by named inclusive range; empty ranges are kept, values between ranges are not counted."""
    c = df.agg(*[F.count_if(F.col(column).between(a, b)).alias(n) for n, a, b in edges])
    return c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.col(f"`{n}`").alias("n")) for n, _, _ in edges])).alias("x")).select("x.*")


PAGE_RANGES = [("1-10", 1, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-200", 101, 200), ("200+", 201, float("inf"))]


def folder_tree(files: DataFrame) -> DataFrame:
    """Files in the whole subtree of every directory of ``files(path)``."""
    parts = F.filter(F.split("path", r"[/\\]"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("directory"))
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def pattern_coverage(docs: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Matches, documents and whether there are none, for every pattern."""
    from docloom.functions import jsregex as rx

    counts = docs.select(*[rx.count(F.col("text_content"), *p).alias(n) for n, p in patterns.items()])
    sums = counts.agg(*[F.sum(n).alias(f"s_{n}") for n in patterns], *[F.count_if(F.col(n) > 0).alias(f"d_{n}") for n in patterns])
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.col(f"s_{n}"), F.lit(0)).alias("matches"), F.col(f"d_{n}").alias("documents")) for n in patterns])
    return sums.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.matches") == 0).alias("zero"))


def zero_output(projection: DataFrame, references: DataFrame, requirements: DataFrame) -> DataFrame:
    """Documents without references and requirements, or of retention below a tenth."""
    some = references.select("doc_id").union(requirements.select("doc_id")).distinct().withColumn("_some", F.lit(True))
    d = projection.join(some, "doc_id", "left")
    low = F.col("retention") < 0.10
    return d.where(F.col("_some").isNull() | low).select("doc_id", F.when(F.col("raw") == 0, "no text").when(low, "low retention").otherwise("no pattern hit").alias("cause"))


def decisions(docs: DataFrame, pairs: DataFrame, chains: DataFrame, references: DataFrame) -> DataFrame:
    """(decision, recommended, confidence): what the counts suggest for retrieval."""
    from docloom.operators.references import INTERNAL, resolution_rate

    d = docs.agg(
        F.count_if(F.col("category").isNotNull()).alias("categorised"),
        F.count_if((F.col("strategy") == "heading_sections") & (F.col("strategy_confidence") < 0.70)).alias("weak"),
        F.count_if(F.expr("scanned_ratio > 0.5")).alias("full_ocr"),
        F.count_if(F.expr("scanned_ratio > 0.1 AND scanned_ratio <= 0.5")).alias("part_ocr"),
        F.count_if(F.expr("extension = '.pdf'")).alias("pdfs"),
        F.count_if(~F.col("language").isin("deu", "und")).alias("foreign"),
        F.count_if(F.col("reliable")).alias("reliable"),
        F.mode("strategy", True).alias("strategy"),
    )
    high = pairs.agg(F.count_if(F.expr("confidence = 'HIGH'")).alias("high"))
    n_chains = chains.agg(F.count(F.lit(1)).alias("chains"))
    missing = references.where(F.col("type").isin(*INTERNAL)).agg(F.count_if(F.expr("classification = 'likely_missing_from_corpus'")).alias("missing"))
    one = d
    for other in (high, n_chains, resolution_rate(references), missing):  # one row each
        one = one.crossJoin(F.broadcast(other))
    c = F.col
    rows = (
        ("DEC-CATEGORY", F.when(c("categorised") > 0, "one namespace per category").otherwise("not required"), F.when(c("categorised") > 0, "HIGH").otherwise("N/A")),
        ("DEC-CHUNK", F.concat(F.lit("per document; mostly "), F.coalesce("strategy", F.lit("heading_sections"))), F.when(c("weak") == 0, "HIGH").otherwise("MEDIUM")),
        ("DEC-OCR", F.when(c("full_ocr") > 0, "full OCR").when(c("part_ocr") > 0, "partial OCR").otherwise("none"), F.when(c("pdfs") > 0, "MEDIUM").otherwise("HIGH")),
        ("DEC-DEDUP", F.when(c("high") > 0, F.format_string("index the latest of %d chain(s)", "chains")).otherwise("precaution only"), F.when(c("high") > 0, "MEDIUM").otherwise("LOW")),
        ("DEC-EMBED", F.when(c("foreign") > 0, "multilingual model").otherwise("German model"), F.lit("HIGH")),
        ("DEC-METADATA", F.when(c("reliable") > 0, "filter by requirement type").otherwise("no filter"), F.lit("LOW")),
        ("DEC-PARSER", F.lit("native parsers"), F.lit("HIGH")),
        ("DEC-REFS", F.when((c("rate") < 0.40) & (c("internal") > 0), F.format_string("ask for %d missing document(s)", "missing")).otherwise("reference graph is usable"),
         F.when(c("internal") == 0, "N/A").when(c("rate") >= 0.40, "MEDIUM").otherwise("LOW")),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("decision"), r.alias("recommended"), k.alias("confidence")) for n, r, k in rows])).alias("x")).select("x.*")


def clamp_strings(df: DataFrame, limit: int = LIMIT, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Every string of every column, however nested, cut to ``limit`` characters."""

    def cut(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.substring(c, 1, limit)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: cut(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: cut(v, kind.valueType))
        if isinstance(kind, T.StructType):
            fields = [(c[f.name] if f.name in exempt else cut(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        return c

    return df.select(*[F.col(f"`{f.name}`") if f.name in exempt else cut(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def leak_guard(df: DataFrame, limit: int = LIMIT, mean_limit: int = 80, exempt: tuple[str, ...] = ()) -> None:
    """Raise if a string is longer than ``limit`` or an array's strings are ``mean_limit`` on average."""
    bad = []

    def walk(c: Column, kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StringType):
            bad.append((path, F.max(F.length(c)) > limit))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            total = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
            bad.append((path, F.max(F.array_max(F.transform(c, lambda x: F.length(x)))) > limit))
            bad.append((path, F.max(F.try_divide(total, F.size(c))) > mean_limit))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                if f.name not in exempt:
                    walk(c[f.name], f.dataType, f"{path}.{f.name}")

    for f in df.schema.fields:
        if f.name not in exempt:
            walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    if bad:
        row = df.agg(*[t.alias(f"c{k}") for k, (_, t) in enumerate(bad)]).first()
        found = [p for k, (p, _) in enumerate(bad) if row[f"c{k}"]]
        if found:
            raise ValueError(f"text would leave the corpus through {found}")


def write_json_report(sections: dict[str, DataFrame], path: str, limit: int = LIMIT, exempt: tuple[str, ...] = ("regex",)) -> dict:
    """Small aggregates as one JSON document; strings are clamped and then guarded."""
    out = {}
    for name, df in sections.items():
        safe = clamp_strings(df, limit, exempt)
        leak_guard(safe, limit, exempt=exempt)
        out[name] = [json.loads(r) for r in safe.toJSON().collect()]
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2))
    return out


def write_markdown_report(sections: dict[str, DataFrame], path: str, max_line: int = 500) -> str:
    """Small aggregates as Markdown tables; a line of more than ``max_line`` characters is refused."""
    lines: list[str] = []
    for name, df in sections.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in clamp_strings(df).collect()] + [""]
    if any(len(x) > max_line for x in lines):
        raise ValueError("a line of the report is too long")
    Path(path).write_text("\n".join(lines))
    return path
