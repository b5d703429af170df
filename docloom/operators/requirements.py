"""Sections, requirements and their sampled validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import jsregex as rx
from docloom.functions import text as T
from docloom.functions.profile import AUTOMOTIVE_DE, FOLDED, NEARER, Pattern, SectorProfile
from docloom.operators import graph, selection

FIRST_SECTION = "Einleitung"
#: A section that is sampled for validation has more characters.
SAMPLED_CHARS = 200


def sections(text: Column, headings: Column) -> Column:
    """array<struct<heading, text>>: lines that equal a known heading start a section.

    Sections are slices of the lines between the starting ones; those without lines are dropped.
    """
    known = F.transform(headings, lambda h: F.lower(rx.trim(h)))
    section = lambda heading, body: F.struct(heading.alias("heading"), body.alias("text"))
    whole = F.array(section(F.lit(FIRST_SECTION), text))

    def cut(lines: Column, starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            last = F.coalesce(F.get(starts, k), F.size(lines))
            heading = F.when(start < 0, FIRST_SECTION).otherwise(F.substring(rx.trim(F.get(lines, start)), 1, 120))
            return F.when(last > start + 1, section(heading, F.array_join(F.slice(lines, start + 2, last - start - 1), "\n")))

        return F.filter(F.transform(F.concat(F.array(F.lit(-1)), starts), one), lambda x: x.isNotNull())

    def of(names: Column, lines: Column) -> Column:
        starts = lambda line: T.bind(rx.trim(line), lambda t: F.length(t).between(3, 150) & F.array_contains(names, F.lower(t)))
        marks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: starts(F.get(lines, i)))
        return T.bind(marks, lambda m: F.when(F.size(m) == 0, whole).otherwise(cut(lines, m)))

    split = T.bind(known, lambda names: T.bind(F.split(text, "\n"), lambda lines: of(names, lines)))
    return F.when(text.isNull(), None).when(F.coalesce(F.size(headings), F.lit(0)) > 0, split).otherwise(whole)


def section_signals(text: Column) -> Column:
    parts = F.filter(F.split(text, rx.java(r"(?<=[.!?])\s+")), lambda s: rx.trim(s) != "")
    return F.struct(
        rx.count(text, r"[^\s]+").alias("words"),
        rx.count(text, r"\b(?:muss|müssen|soll|sollen|kann|können|shall|must|should)\b", "i").alias("modals"),
        F.greatest(F.lit(1), F.size(parts)).alias("sentences"),
        rx.test(text, r"\d+[,.]?\d*\s*(?:mm|cm|m\b|kg|g\b|°C|K\b|N\b|MPa|kN|%|bar|kPa|µm)", "i").alias("has_quantity"),
        F.lit(1).alias("regex_count"),
    )


def requirement_sentence(text: Column, kind: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """The first sentence that the type's pattern hits, else the whole text."""
    return C.with_folded(text, lambda t, low: T.bind(kind, lambda k: F.coalesce(_sentence(t, low, k, profile), t)))


def type_and_status(text: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """Struct(type, status): requirement type, and status of its sentence; the text is folded once for both."""
    sentence = lambda t, low, hit: F.struct(F.coalesce(hit, t).alias("text"), F.when(hit.isNull(), low).otherwise(rx.folded(hit)).alias("low"))
    status = lambda t, low, k: T.bind(_sentence(t, low, k, profile), lambda hit: T.bind(sentence(t, low, hit), lambda s: C.status_of(s["text"], s["low"], profile)))
    return C.with_folded(text, lambda t, low: T.bind(C.type_of(t, low, profile), lambda k: F.struct(k.alias("type"), status(t, low, k).alias("status"))))


def _sentence(text: Column, low: Column, kind: Column, profile: SectorProfile) -> Column:
    """The first sentence that the type's pattern hits, null if there is none."""
    hit = F.lit(None).cast("string")
    for name, pattern in profile.requirement_patterns.items():
        hit = F.when(kind == name, _around(text, low, pattern) if pattern in FOLDED else _first_part(text, NEARER.get(pattern, pattern))).otherwise(hit)
    return hit


def _first_part(text: Column, pattern: Pattern) -> Column:
    return F.get(F.filter(F.split(text, rx.java(r"(?<=[.!?])\s+")), lambda s: rx.test(s, *pattern)), F.lit(0))


def _around(text: Column, low: Column, pattern: Pattern) -> Column:
    """``_first_part`` for a pattern of ``FOLDED``: what stands around its first match, the rest is not cut.

    The folded text has as many characters as the text.
    """
    before = lambda n: F.regexp_extract(F.substring(text, F.lit(1), n), rx.java(r"^(?:.*[.!?]\s+)?(.*)\z", "s"), 1)
    after = lambda n: F.regexp_extract(F.substring(text, n + 1, F.length(text)), rx.java(r"^.*?(?=(?<=[.!?])\s|\z)", "s"), 0)
    return T.bind(C.before_hit(low, pattern), lambda n: F.when(n < F.length(text), F.concat(before(n), after(n))))


def extract(docs: DataFrame, profile: SectorProfile = AUTOMOTIVE_DE) -> DataFrame:
    """One requirement per section of ``docs(doc_id, text_content, headings)`` that has a type."""
    rows = docs.where("text_content <> ''").select("doc_id", F.posexplode(sections(F.col("text_content"), F.col("headings"))).alias("section", "x"))
    typed = rows.select("doc_id", "section", "x.heading", "x.text", type_and_status(F.col("x.text"), profile).alias("_t"))
    out = typed.withColumn("_q", C.quantities(F.col("text")))
    return out.select(
        "doc_id",
        "section",
        "heading",
        "_t.type",
        C.requirement_category(F.col("text"), profile).alias("category"),
        (F.col("_q.count") > 0).alias("has_quantity"),
        F.col("_q.count").alias("quantity_count"),
        F.col("_q.units").alias("units"),
        F.substring(rx.first(F.col("text"), *profile.norm_pattern), 1, 30).alias("linked_norm"),
        C.linked_entity(F.col("text"), profile).alias("linked_entity"),
        C.with_folded(F.col("text"), lambda t, low: C.hits(t, low, profile.safety)).alias("safety"),
        "_t.status",
        section_signals(F.col("text")).alias("signals"),
    )


def quality_by_document(requirements: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return requirements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("raw"), count("confirmed"), count("negated"), count("uncertain"))


def sample_for_validation(sections_: DataFrame, rate: float = 0.1, per_type: int = 2, pool: int = 50, seed: int = 7) -> DataFrame:
    """Two sections of every document type, then more up to ``rate`` of the pool; seeded.

    ``sections_(doc_id, section, doc_type, chars)``; a pool holds at most ``pool`` sections of a
    type, of more than ``SAMPLED_CHARS`` characters each.
    """
    key = ["doc_id", "section"]
    long_ = sections_.where(F.col("chars") > SAMPLED_CHARS)
    pooled = graph.checkpoint(selection.first_by_hash(long_, ["doc_type"], F.lit(pool), key, seed))
    sure = graph.checkpoint(selection.first_by_hash(pooled, ["doc_type"], F.lit(per_type), key, seed))
    more = math.ceil(pooled.count() * rate - 1e-9) - sure.count()
    return sure.unionByName(selection.first_by_hash(pooled.join(sure, key, "left_anti"), [], F.lit(more), key, seed))


def validation(sampled: DataFrame) -> DataFrame:
    """One row of ``sampled(doc_type, doc_id, regex_count, model_count)``: delta and its 95 % interval."""
    off = F.abs(F.col("model_count") - F.col("regex_count")) / F.greatest("model_count", "regex_count", F.lit(1))
    out = sampled.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("delta"), F.stddev_samp(off).alias("_s"), F.count_distinct("doc_id").alias("documents"))
    half = F.lit(1.96) * F.coalesce(F.col("_s"), F.lit(0.0)) / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    return out.select("n", "documents", "delta", (F.col("delta") - half).alias("low"), (F.col("delta") + half).alias("high"))


def validation_by_type(sampled: DataFrame) -> DataFrame:
    off = F.abs(F.col("model_count") - F.col("regex_count")) / F.greatest("model_count", "regex_count", F.lit(1))
    return sampled.groupBy("doc_type").agg(F.count(F.lit(1)).alias("sampled"), F.avg(off).alias("avg_delta"))
