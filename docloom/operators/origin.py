"""Origin of documents: weighted signals of the own company against those of customers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

STOP_WORDS = ("gmbh", "ag", "ltd", "inc", "corp", "co", "plc", "se", "sa", "the", "and", "von", "der", "die", "das", "und")
#: Fixed values: (document types, signal, direction, weight).
TYPE_SIGNALS = (
    (
        ("arbeitsanweisung", "protokoll", "handbuch", "lessons_learned", "8d_report", "kontrollplan", "serienfreigabe", "empb", "aenderungsantrag", "reklamation", "fmea"),
        "doctype_internal", "internal", 2,
    ),
    (("lastenheft", "sla", "norm"), "doctype_external_strong", "external", 3),
    (("qualitätsvorgabe", "pruefspezifikation"), "doctype_external_weak", "external", 2),
)


@dataclass(frozen=True)
class CompanyIdentity:
    name: str
    aliases: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str) -> CompanyIdentity | None:
        """The identity of a JSON file (name, aliases); None without a file, valid JSON or a name."""
        try:
            given = json.loads(Path(path).read_text("utf-8"))
        except (OSError, ValueError):
            return None
        name = given.get("name") if isinstance(given, dict) else None
        if not isinstance(name, str) or not name.strip():
            return None
        aliases = given.get("aliases")
        return cls(name.strip(), tuple(a for a in aliases if isinstance(a, str)) if isinstance(aliases, list) else ())

    def words(self) -> list[str]:
        """Distinct significant words of all names."""
        import re

        found = [w for n in (self.name, *self.aliases) for w in re.split(r"[\s\-_&,./\\]+", n.lower())]
        return list(dict.fromkeys(w for w in found if len(w) >= 3 and w not in STOP_WORDS))


def matches_company(text: Column, identity: CompanyIdentity) -> Column:
    """Whether any significant word is part of the text."""
    words = F.array(*[F.lit(w) for w in identity.words()]).cast("array<string>")
    return F.coalesce(F.exists(words, lambda w: F.contains(F.lower(text), w)), F.lit(False))


def mentions(text: Column, identity: CompanyIdentity) -> Column:
    out = F.lit(0)
    for w in identity.words():
        out = out + T.count_occurrences(F.lower(text), F.lit(w))
    return out


def signals(
    identity: CompanyIdentity, segments: Column, text: Column, kind: Column, customer: Column, category: Column, authors: Column | None = None, company: Column | None = None
) -> Column:
    """array<struct<signal, direction, weight>> in a fixed order."""
    own = F.array(*[F.lit(w) for w in identity.words()]).cast("array<string>")
    hit = lambda test, name, side, weight: F.when(test, F.struct(F.lit(name).alias("signal"), F.lit(side).alias("direction"), F.lit(weight).alias("weight")))
    dirs = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    in_path = F.exists(dirs, lambda s: F.arrays_overlap(T.significant_words(s, STOP_WORDS), own))
    sample = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    n = mentions(sample, identity)
    every = [
        hit(F.exists(authors, lambda a: matches_company(a, identity)), "metadata_author_match", "internal", 5) if authors is not None else None,
        hit(matches_company(company, identity), "metadata_company_match", "internal", 4) if company is not None else None,
        hit(in_path, "path_segment_match", "internal", 4),
        hit(n >= 3, "content_match_strong", "internal", 3),
        hit((n >= 1) & (n < 3), "content_match_weak", "internal", 1),
        *[hit(kind.isin(*types), name, side, weight) for types, name, side, weight in TYPE_SIGNALS],
        hit(customer.isNotNull(), "oem_folder_detected", "external", 3),
        hit(category.isin("rfq", "quotation"), "doc_category_rfq", "external", 2),
    ]
    return F.filter(F.array(*[e for e in every if e is not None]), lambda x: x.isNotNull())


def classify(found: Column) -> Column:
    """Struct(result, internal, external, confidence); internal asks for 4 points, external for 3."""
    total = lambda side: F.aggregate(F.filter(found, lambda x: x["direction"] == side), F.lit(0), lambda a, x: a + x["weight"])

    def verdict(s: Column) -> Column:
        i, e = s["i"], s["e"]
        result = F.when((i >= 4) & (i > e), "internal").when((e >= 3) & (e > i), "external").otherwise("unknown")
        best = F.when(result == "internal", i).otherwise(e)
        confidence = F.when(result == "unknown", "none").when(best >= 8, "high").when(best >= 5, "medium").otherwise("low")
        return F.struct(result.alias("result"), i.alias("internal"), e.alias("external"), confidence.alias("confidence"))

    return T.bind(F.struct(total("internal").alias("i"), total("external").alias("e")), verdict)
