"""Path, file-name and date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsregex as rx
from .profile import PATTERNS

#: Fixed values: (customer, token of a path segment), the first segment and then the first token wins.
CUSTOMERS = (
    ("Mercedes", r"\bmerced(es|benz)\b"),
    ("BMW", r"\bbmw\b"),
    ("Audi", r"\baudi\b"),
    ("VW", r"\bvw\b|\bvolkswagen\b"),
    ("Porsche", r"\bporsche\b"),
    ("Daimler", r"\bdaimler\b"),
    ("Stellantis", r"\bstellantis\b"),
)
PLATFORM_CODE = (r"^G\d{1,2}X$|^G\d{2,3}$|^F\d{2}X?$", "i")
RFQ = (r"^rfq$", "i")
QUOTATION = (r"^quot(?:ation)?s?$|^angebot[e]?$", "i")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda x: x != "")


def directories(path: Column) -> Column:
    s = segments(path)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def filename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(segments(path)) - 1


def same_directory(a: Column, b: Column) -> Column:
    parent = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    return parent(a) == parent(b)


def customer(dirs: Column) -> Column:
    """Customer of the first segment that names one; else an OEM name; else BMW by platform code."""

    def token(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(CUSTOMERS):
            out = F.when(rx.test(s, pattern, "i"), name).otherwise(out)
        return out

    named = F.filter(F.transform(dirs, token), lambda x: x.isNotNull())
    verbatim = F.filter(F.transform(dirs, lambda s: rx.first(s, *PATTERNS["oem_names"])), lambda x: x.isNotNull())
    return F.coalesce(
        F.get(named, F.lit(0)), F.get(verbatim, F.lit(0)), F.when(F.exists(dirs, lambda s: rx.test(s, *PLATFORM_CODE)), "BMW")
    )


def project(dirs: Column) -> Column:
    """The segment after the one that names the customer; without such a segment the first one."""

    def position(test) -> Column:
        hits = F.filter(F.transform(dirs, lambda s, i: F.when(test(s), i + 1)), lambda x: x.isNotNull())
        return F.get(hits, F.lit(0))

    token = "|".join(p for _, p in CUSTOMERS)
    at = F.coalesce(position(lambda s: rx.test(s, token, "i")), position(lambda s: rx.test(s, *PATTERNS["oem_names"])), F.lit(0))
    return F.get(dirs, at)


def category(dirs: Column) -> Column:
    """rfq or quotation, whichever segment comes first."""
    kind = lambda s: F.when(rx.test(s, *RFQ), "rfq").when(rx.test(s, *QUOTATION), "quotation")
    return F.get(F.filter(F.transform(dirs, kind), lambda x: x.isNotNull()), F.lit(0))


def date_in_name(name: Column) -> Column:
    """YYYY-MM-DD or YYYY_MM_DD; else YYYYMMDD of 2000 to 2030; impossible days give null."""
    dashed = F.try_to_date(F.regexp_replace(rx.first(name, r"(\d{4})[-_](\d{2})[-_](\d{2})"), "_", "-"), "yyyy-MM-dd")
    packed = F.try_to_date(rx.first(name, r"(\d{4})(\d{2})(\d{2})"), "yyyyMMdd")
    return F.coalesce(dashed, F.when(F.year(packed).between(2000, 2030), packed))


DATE_LABEL = (
    r"\b(Stand|Revision|Datum|Erstellt am|Geändert am|Änderungsdatum|Änderungsstand)\s*:?\s*(\d{1,2})\.(\d{1,2})\.(\d{4})\b",
    "i",
)


def date_in_text(text: Column) -> Column:
    """Struct(date, source) of a labelled German date in the first 3000 characters."""
    sample = F.substring(text, 1, 3000)
    part = lambda g: rx.first(sample, *DATE_LABEL, group=g)
    padded = F.concat_ws("-", part(4), F.lpad(part(3), 2, "0"), F.lpad(part(2), 2, "0"))
    day = F.try_to_date(padded, "yyyy-MM-dd")
    source = F.when(rx.test(part(1), r"\bStand\b", "i"), "stand_pattern").otherwise("revision_pattern")
    return F.when(F.year(day).between(2000, 2035), F.struct(day.alias("date"), source.alias("source")))


def date_signals(meta: Column, name: Column, text: Column, created: Column, modified: Column, ext: Column) -> Column:
    """Struct of mtime, ctime, mtime_reliable, document_internal_date, internal_date_source, best_date."""
    from_meta, from_name, from_text = F.to_date(meta), date_in_name(name), date_in_text(text)
    source = (
        F.when(from_meta.isNotNull(), F.when(ext == ".docx", "docx_core_xml").otherwise("pdf_metadata"))
        .when(from_name.isNotNull(), "filename")
        .otherwise(from_text["source"])
    )
    internal = F.coalesce(from_meta, from_name, from_text["date"])
    return F.struct(
        F.to_date(modified).alias("mtime"),
        F.to_date(created).alias("ctime"),
        (modified != created).alias("mtime_reliable"),
        internal.alias("document_internal_date"),
        source.alias("internal_date_source"),
        F.coalesce(internal, F.to_date(created)).alias("best_date"),
    )


def date_source(internal_source: Column) -> Column:
    """docx_core_xml, pdf_metadata, filename (any other internal source), mtime."""
    return (
        F.when(internal_source.isNull(), "mtime")
        .when(internal_source.isin("docx_core_xml", "pdf_metadata"), internal_source)
        .otherwise("filename")
    )


def normalized_name(name: Column) -> Column:
    """Lower-case name without extension, separators and its first version number."""
    t = F.regexp_replace(F.lower(name), r"\.[^.]+$", "")
    t = F.regexp_replace(t, r"[_\-.\s]+", " ")
    t = F.regexp_replace(t, r"^(.*?)v?\d+(\.\d+)*", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def staleness(best_date: Column, this_year: int) -> Column:
    """Whether the best date is three or more years before ``this_year``."""
    return F.year(best_date) <= this_year - 3
