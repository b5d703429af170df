"""Ordered rule tables: document type, OEM, chunk strategy, headings, requirement types."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsregex as rx
from . import text as T
from .profile import AUTOMOTIVE_DE, FOLDED, NEARER, PATTERNS, PLAINER, WORDS, Pattern, SectorProfile

#: Fixed values: (document type, pattern of the lower-cased file name), the first that hits wins.
TYPE_BY_NAME = (
    ("fmea", r"\bfmea\b"),
    ("audit", r"\baudit\b"),
    ("lastenheft", r"\b(srs|irs|lastenheft|anforderung|requirement)\b"),
    ("testbericht", r"\b(testbericht|test[_\s-]?report|ergebnisbericht|prüfbericht)\b"),
    ("abweichliste", r"\b(abweichliste|abweichung|deviationslist)\b"),
    ("pruefspezifikation", r"\b(pruefspec|prüfspec|testspec|pruefspezifikation|prüfspezifikation|prüfvorschrift)\b"),
    ("planning", r"\b(milestones?|risk[_\s-]?register|issue[_\s-]?tracker|planning?)\b"),
    ("sla", r"\b(sla|service[_\s-]?level)\b"),
    ("lessons_learned", r"\blessons?[_\s-]?learned\b"),
    ("angebot", r"\b(angebot|proposal|offer)\b"),
    ("8d_report", r"\b8d[-_\s]?(bericht|report)\b"),
    ("empb", r"\b(empb|erstmuster|isir)\b"),
    ("aenderungsantrag", r"([äa]nderung)(santrag|sauftrag|sbekanntmachung)|change[-_\s]?request|\becr\b|\becn\b"),
    ("kontrollplan", r"\b(kontrollplan|pr[üu]fplan|control[-_\s]?plan)\b"),
    ("serienfreigabe", r"\bserien(liefer)?freigabe\b|\bslf\b"),
    ("reklamation", r"\b(reklamation|beanstandung|warranty[-_\s]?claim)\b"),
    ("arbeitsanweisung", r"\b(arbeits|verfahrens)anweisung\b|\barbeitsvorschrift\b|work[-_\s]?instruction"),
    ("protokoll", r"\b(sitzungs|besprechungs)?protokoll\b|meeting[-_\s]?minutes"),
    ("handbuch", r"\b(lieferanten)?handbuch\b|\bsupplier[-_\s]?manual\b|\bleitfaden\b"),
)
#: Fixed values: (document type, pattern of headings and first 2000 characters).
TYPE_BY_CONTENT = (
    ("lessons_learned", r"lessons?\s*learned"),
    ("sla", r"service\s*level|\bsla\b"),
    ("fmea", r"\bfmea\b"),
    ("testbericht", r"testbericht|ergebnisbericht|prüfbericht|\bn\.i\.o\.\b"),
    ("pruefspezifikation", r"prüfspezifikation|prüfvorschrift|test\s*spec"),
    ("abweichliste", r"abweichliste|abweichungsliste"),
    ("norm", r"\bnorm\b"),
    ("angebot", r"angebot|proposal|\boffer\b"),
    ("lastenheft", r"lastenheft|spezifikation|anforderung|requirement"),
    ("8d_report", r"\b8d[-_\s]?(bericht|report)\b"),
    ("empb", r"erstmusterpr[üu]fbericht|\bempb\b|\bisir\b|first\s+article\s+inspection"),
    ("aenderungsantrag", r"[äa]nderungsantrag|[äa]nderungsauftrag|engineering\s+change\s+request"),
    ("kontrollplan", r"kontrollplan|pr[üu]fplan|control\s*plan"),
    ("serienfreigabe", r"serien(liefer)?freigabe|produktionsfreigabe"),
    ("reklamation", r"\breklamation\b|\bbeanstandung\b|warranty\s+claim"),
    ("arbeitsanweisung", r"arbeitsanweisung|verfahrensanweisung|\barbeitsvorschrift\b|work\s+instruction"),
    ("protokoll", r"sitzungsprotokoll|besprechungsprotokoll|\bprotokoll\b"),
    ("handbuch", r"lieferantenhandbuch|supplier\s+manual|qualit[äa]tshandbuch"),
)
#: Words one of which, in lower case, is wherever the content rule hits.
CONTENT_WORDS = {
    "lessons_learned": ("lesson",),
    "sla": ("sla", "service"),
    "fmea": ("fmea",),
    "testbericht": ("bericht", "n.i.o."),
    "pruefspezifikation": ("prüf", "test"),
    "abweichliste": ("abweich",),
    "norm": ("norm",),
    "angebot": ("angebot", "proposal", "offer"),
    "lastenheft": ("lastenheft", "spezifikation", "anforderung", "requirement"),
    "8d_report": ("8d",),
    "empb": ("erstmuster", "empb", "isir", "inspection"),
    "aenderungsantrag": ("nderungsa", "engineering"),
    "kontrollplan": ("plan",),
    "serienfreigabe": ("freigabe",),
    "reklamation": ("reklamation", "beanstandung", "warranty"),
    "arbeitsanweisung": ("anweisung", "arbeitsvorschrift", "instruction"),
    "protokoll": ("protokoll",),
    "handbuch": ("handbuch", "manual"),
}
#: The norm rule of the content table also looks at the file name.
NORM_IN_NAME = r"qv[-\s]?\d|iso\s*\d|din\s*\d|en\s*\d"
RELIABLE_TYPES = ("lastenheft", "pruefspezifikation", "testbericht", "norm")


def ordered(rules, test, default: Column) -> Column:
    """The label of the first rule whose test holds."""
    out = default
    for label, pattern in reversed(rules):
        out = F.when(test(label, pattern), label).otherwise(out)
    return out


def hits(text: Column, low: Column, pattern: Pattern) -> Column:
    """``rx.test``; the pattern is only tried where ``low``, the folded text, leaves it a chance, and on ``low`` if it can."""
    if pattern in FOLDED:
        return reduce(or_, (F.contains(low, F.lit(word)) & reduce(and_, (rx.test(low, p) for p in found)) for word, found in FOLDED[pattern]))
    test = rx.test(text, *NEARER.get(pattern, pattern))
    if pattern in WORDS:
        return rx.may_hit(low, WORDS[pattern]) & test
    if pattern in PLAINER:
        return rx.test(low, PLAINER[pattern]) & test
    return test


def before_hit(low: Column, pattern: Pattern) -> Column:
    """Characters before the first match of a pattern of ``FOLDED``; null, or all of them, if there is none."""

    def of(word: str, found: tuple[str, ...]) -> Column:
        near = reduce(and_, (rx.test(low, p) for p in found[:-1]), F.contains(low, F.lit(word)))
        return F.when(near, F.length(rx.replace(low, found[-1] + "(?s:.*)", "")))

    return F.least(*[of(word, found) for word, found in FOLDED[pattern]])


def with_folded(text: Column, body) -> Column:
    """``body(text, folded text)``, each evaluated once per row."""
    return T.bind(text, lambda t: T.bind(rx.folded(t), lambda low: body(t, low)))


def document_type(filename: Column, headings: Column, sample: Column) -> Column:
    """The type that the file name tells, else headings and sample; both are lower-cased once."""

    def of_content(content: Column, low: Column, name: Column) -> Column:
        def test(label: str, pattern: str) -> Column:
            hit = rx.may_hit(low, CONTENT_WORDS[label]) & rx.test(content, pattern, "i")
            return hit | rx.test(name, NORM_IN_NAME, "i") if label == "norm" else hit

        return ordered(TYPE_BY_CONTENT, test, F.lit("other"))

    def of_name(name: Column) -> Column:
        content = F.lower(F.concat_ws(" ", F.array_join(headings, " "), sample))
        by_content = T.bind(content, lambda c: T.bind(rx.even(c), lambda low: of_content(c, low, name)))
        return ordered(TYPE_BY_NAME, lambda _, p: rx.test(name, p, "i"), by_content)

    return T.bind(F.lower(filename), of_name)


def requirement_reliable(kind: Column, extension: Column) -> Column:
    return kind.isin(*RELIABLE_TYPES) & (extension != ".xlsx")


def oem_of(text: Column) -> Column:
    """mercedes, bmw, audi or unknown, by ids and names in that order."""

    def of(t: Column, low: Column) -> Column:
        named = lambda word, pattern: rx.may_hit(low, (word,)) & rx.test(t, pattern, "i")
        return (
            F.when(hits(t, low, PATTERNS["fikb"]) | named("merced", r"\bmerced(es|benz)\b"), "mercedes")
            .when(hits(t, low, PATTERNS["quality_spec"]) | named("bmw", r"\bbmw\b"), "bmw")
            .when(hits(t, low, PATTERNS["kb_master"]) | named("audi", r"\baudi\b"), "audi")
            .otherwise("unknown")
        )

    return with_folded(text, of)


def detect_oem(sample: Column, headings: Column, segments: Column) -> Column:
    """Struct(oem, source): the document outranks its folder; a conflict is ``reconciled``."""
    doc = oem_of(F.concat_ws(" ", sample, F.array_join(headings, " ")))
    folder = oem_of(F.array_join(segments, " "))

    def outranked(x: Column) -> Column:
        doc, folder = x["doc"], x["folder"]
        source = F.when(doc == "unknown", "folder").when((folder != "unknown") & (folder != doc), "reconciled").otherwise("document_internal")
        return F.struct(F.when(doc != "unknown", doc).otherwise(folder).alias("oem"), source.alias("source"))

    return T.bind(F.struct(doc.alias("doc"), folder.alias("folder")), outranked)


def numbered_headings(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), rx.trim)
    rule = r"^(\d+(?:\.\d+)*\.?)\s+(.{3,80})$"
    hits = F.filter(lines, lambda x: rx.test(x, rule))
    return F.transform(hits, lambda x: F.trim(F.regexp_replace(x, rx.java(rule), "$1 $2")))


def heuristic_headings(text: Column) -> Column:
    """Short lines without a full stop before a line of more than 80 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), rx.trim), lambda x: x != "")

    def pick(ls: Column) -> Column:
        fits = lambda x, i: (
            F.length(x).between(4, 80)
            & ~F.endswith(x, F.lit("."))
            & ~F.endswith(x, F.lit(","))
            & ~rx.test(x, r"^\d+$")
            & (F.coalesce(F.length(F.get(ls, i + 1)), F.lit(0)) > 80)
        )
        return F.filter(ls, fits)

    return T.bind(lines, pick)


def merge_headings(structure: Column, numbered: Column, heuristic: Column) -> Column:
    """Struct(headings, strategy): the first list of more than three, else all distinct ones."""
    union = F.array_distinct(F.concat(numbered, structure, heuristic))
    named = lambda c, n: F.struct(c.alias("headings"), F.lit(n).alias("strategy"))
    return (
        F.when(F.size(structure) > 3, named(structure, "structure"))
        .when(F.size(numbered) > 3, named(numbered, "numbered"))
        .when(F.size(heuristic) > 3, named(heuristic, "heuristic"))
        .otherwise(named(union, "union"))
    )


def heading_nodes(headings: Column) -> Column:
    def node(h: Column) -> Column:
        number = rx.first(h, r"^(\d+(?:\.\d+)*)")
        level = F.when(number.isNull(), 2).otherwise(F.least(F.lit(6), F.regexp_count(number, F.lit(r"\.")) + 1))
        return F.struct(
            level.cast("int").alias("level"),
            F.substring(h, 1, 120).alias("text"),
            number.alias("numbering"),
            F.lit(0).alias("child_count"),
            T.tokens_by_length(h).cast("int").alias("approximate_tokens"),
        )

    return F.transform(headings, node)


def level_counts(nodes: Column) -> Column:
    at = lambda t, n: F.size(F.filter(nodes, t)).alias(n)
    return F.struct(
        at(lambda h: h["level"] == 1, "h1"), at(lambda h: h["level"] == 2, "h2"), at(lambda h: h["level"] == 3, "h3"), at(lambda h: h["level"] > 3, "h4_plus")
    )


def chunk_strategy(extension: Column, nodes: Column, tables: Column, pdf_class: Column) -> Column:
    """Struct(strategy, confidence, alternative)."""
    n = F.size(nodes)
    deepest = F.coalesce(F.array_max(F.transform(nodes, lambda h: h["level"])), F.lit(0))
    by_headings = F.when((n >= 10) & (deepest > 2), 0.90).when(n >= 5, 0.78).otherwise(0.60)
    lowered = F.when(tables > 5, F.greatest(by_headings - 0.10, F.lit(0.50))).otherwise(by_headings)
    out = lambda s, c, a: F.struct(F.lit(s).alias("strategy"), c.cast("double").alias("confidence"), a.alias("alternative"))
    none = F.lit(None).cast("string")
    tabular = lambda least: F.when(tables > least, "table_rows")
    return (
        F.when(extension == ".xlsx", out("table_rows", F.lit(0.95), none))
        .when(n == 0, out("sliding_window", F.when(pdf_class == "fully_scanned", 0.90).otherwise(0.75), tabular(3)))
        .otherwise(out("heading_sections", lowered, tabular(5)))
    )


def pdf_class(chars: Column, pages: Column, images: Column) -> Column:
    per_page = chars / F.greatest(pages, F.lit(1))
    return F.when(per_page < 10, "fully_scanned").when((per_page < 200) & (images > pages), "hybrid").otherwise("native")


def requirement_type(text: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    return with_folded(text, lambda t, low: type_of(t, low, profile))


def type_of(text: Column, low: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """``requirement_type`` of a text whose folded text is known."""
    order = ("MANDATORY", "RECOMMENDED", "PERMITTED", "DECLARATIVE")
    rules = [(t, profile.requirement_patterns[t]) for t in order]
    return ordered(rules, lambda _, p: hits(text, low, p), F.lit("INFORMATIVE"))


def requirement_category(text: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    rules = (
        ("Safety", profile.safety),
        ("Material", PATTERNS["material"]),
        ("Tolerance", PATTERNS["tolerance"]),
        ("Testing", PATTERNS["testing"]),
        ("Packaging", PATTERNS["packaging"]),
        ("Delivery", profile.delivery),
    )
    return ordered(rules, lambda _, p: rx.test(text, *p), F.lit("Other"))


def quantities(text: Column) -> Column:
    """Struct(count, units): never the values; at most five distinct units."""
    hits = rx.find_all(text, *PATTERNS["quantity"])
    unit = lambda m: F.coalesce(rx.first(m, r"[a-zA-Z°%µ]+"), F.lit("?"))
    return T.bind(hits, lambda h: F.struct(F.size(h).alias("count"), F.slice(F.array_distinct(F.transform(h, unit)), 1, 5).alias("units")))


def linked_entity(text: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    return F.substring(F.coalesce(*[rx.first(text, *p) for _, p in profile.entity_ids]), 1, 30)


def sentence_status(sentence: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """negated, uncertain (no subject, or not 8 to 80 words) or confirmed."""
    return with_folded(sentence, lambda s, low: status_of(s, low, profile))


def status_of(sentence: Column, low: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """``sentence_status`` of a sentence whose folded text is known."""
    return T.bind(rx.trim(sentence), lambda t: _status(sentence, t, low, profile))


def _status(sentence: Column, t: Column, low: Column, profile: SectorProfile) -> Column:
    subject = (
        rx.test(t, r"^(?:Die|Das|Der|Ein|Eine|Alle|Jede[rs]?)\s+[A-ZÄÖÜ]")
        | rx.test(t, r"^(?:The|A|An|All|Each|Every)\s+[a-zA-Z]")
        | rx.test(t, r"^[A-Z].*\b(?:shall|must|should)\b")
        | rx.test(sentence, r"[A-Z]{2,}")
        | rx.test(sentence, r"[A-Z][a-z]+[A-Z][a-z]+")
    )
    many = rx.test(t, r"^\S*+(?:\s++\S++){80}")  # 81 words and more are too many, however many; a split reads them all
    few = F.size(F.split(t, rx.java(r"\s+"))) < 8
    negated = F.lit(False)
    if profile.requirement_family == "german_modal":
        negated = rx.may_hit(low, ("nicht",)) & rx.may_hit(low, ("muss", "soll")) & rx.test(low, r"(?=[nms])(?:nicht\s+muss|muss\s+nicht|nicht\s+soll|soll\s+nicht)")
    return F.when(negated, "negated").when(many | few | ~subject, "uncertain").otherwise("confirmed")


def requirement_density(text: Column, pages: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """Six counts by page."""
    per = lambda p: rx.count(text, *p) / F.greatest(pages, F.lit(1))
    patterns = profile.requirement_patterns
    return F.struct(
        per(patterns["MANDATORY"]).alias("mandatory"),
        per(patterns["RECOMMENDED"]).alias("recommended"),
        per(patterns["PERMITTED"]).alias("permitted"),
        per(PATTERNS["informative"]).alias("informative"),
        per(profile.norm_pattern).alias("norms"),
        per(PATTERNS["quantity"]).alias("quantities"),
    )


def norm_type(raw: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    return ordered(profile.norm_types, lambda _, p: rx.test(raw, p, "i"), F.lit(profile.default_norm_type))
