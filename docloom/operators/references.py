"""Extraction, normalisation and resolution of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import jsregex as rx
from docloom.functions import text as T
from docloom.functions.profile import AUTOMOTIVE_DE, PATTERNS, PLAINER, WORDS, SectorProfile
from docloom.operators import fuzzy, graph

MAX_CHARS = 80
INTERNAL = ("doc_ref", "chapter_ref", "fikb", "kb_master")
EXTERNAL = ("iso_norm", "din_norm", "en_norm", "vda_norm", "iatf_norm")
NORM_PREFIXES = ("ISO", "DIN", "EN", "VDA", "IATF", "IEC")
#: (call, reference type) in order of emission; two calls may share a type and then repeat a text.
CALLS = (
    ("norms", None),
    ("quality_spec", "quality_spec"),
    ("fikb", "fikb"),
    ("kb_master", "kb_master"),
    ("chapter_refs", "chapter_ref"),
    ("doc_refs", "doc_ref"),
    ("corpus_ids", "doc_ref"),
    ("requirement_ids", "chapter_ref"),
)


def raw_references(text: Column, profile: SectorProfile = AUTOMOTIVE_DE, low: Column | None = None) -> dict[str, Column]:
    """Lists of matches by call; ``version_markers`` are extracted but never emitted.

    ``low`` is the folded text, if it is known: patterns are then only tried where it leaves them a chance.
    """

    def find(p: tuple[str, str]) -> Column:
        found = F.transform(rx.find_all(text, *p), lambda m: F.substring(m, 1, MAX_CHARS))
        if low is None or p not in WORDS and p not in PLAINER:
            return found
        chance = rx.may_hit(low, WORDS[p]) if p in WORDS else rx.test(low, PLAINER[p])
        return F.when(~chance, F.array().cast("array<string>")).otherwise(found)

    ids = F.filter(find(PATTERNS["intra_corpus_id"]), lambda m: ~F.upper(F.split_part(m, F.lit("-"), F.lit(1))).isin(*NORM_PREFIXES))
    entity = dict(profile.entity_ids)
    none = F.array().cast("array<string>")
    return {
        "norms": find(profile.norm_pattern),
        **{k: find(entity[k]) if k in entity else none for k in ("quality_spec", "fikb", "kb_master")},
        "chapter_refs": find(PATTERNS["chapter_ref"]),
        "doc_refs": find(PATTERNS["doc_ref"]),
        "corpus_ids": ids,
        "requirement_ids": find(PATTERNS["requirement_id"]),
        "version_markers": find(PATTERNS["version_marker"]),
    }


def extract(docs: DataFrame, profile: SectorProfile = AUTOMOTIVE_DE) -> DataFrame:
    """(doc_id, call, type, raw_text, section): distinct texts of every call, a narrow pass."""
    docs = T.once(docs.where("text_content <> ''"), "_low", rx.folded(F.col("text_content")))
    found = raw_references(F.col("text_content"), profile, F.col("_low"))
    section = F.coalesce(F.substring(F.get("headings", F.lit(0)), 1, MAX_CHARS), F.lit("unknown")) if "headings" in docs.columns else F.lit("unknown")
    lists = F.array(*[F.struct(F.lit(k).alias("call"), F.lit(t).cast("string").alias("type"), F.array_distinct(found[k]).alias("texts")) for k, t in CALLS])
    rows = docs.select("doc_id", section.alias("section"), F.explode(lists).alias("x"))
    flat = rows.select("doc_id", "section", "x.call", "x.type", F.explode("x.texts").alias("raw_text"))
    return flat.withColumn("type", F.coalesce("type", C.norm_type(F.col("raw_text"), profile)))


def canonical_norm(raw: Column, profile: SectorProfile = AUTOMOTIVE_DE) -> Column:
    """Exact key of the table, else the first key that the text starts with (any case)."""
    table = profile.norm_canonical
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), raw)
    keys = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])
    hit = F.get(F.filter(keys, lambda e: F.startswith(F.lower(raw), e["k"])), F.lit(0))
    return F.coalesce(exact, hit["v"])


def norm_parts(text: Column) -> Column:
    """Struct(base, version): ``base:yyyy`` or ``letters number.number``, else the whole."""
    year, dotted = r"^(.+?):\s*(\d{4})$", r"^([A-Za-z/\s]+)\s+(\d[\d.]*\d)$"
    pick = lambda p: F.struct(F.trim(rx.first(text, p, group=1)).alias("base"), rx.first(text, p, group=2).alias("version"))
    whole = F.struct(F.trim(text).alias("base"), F.lit(None).cast("string").alias("version"))
    return F.when(rx.test(text, year), pick(year)).when(rx.test(text, dotted), pick(dotted)).otherwise(whole)


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Versions that don't differ and bases of edit distance below 3."""
    x, y = norm_parts(a), norm_parts(b)
    differ = F.coalesce(x["version"] != y["version"], F.lit(False))
    return ~differ & (F.levenshtein(F.lower(x["base"]), F.lower(y["base"])) < 3)


def fuzzy_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(search, name, doc_id, equal): names that may be a text's by edit distance, and whether they are.

    ``texts(search)`` and ``names(name, doc_id)`` are distinct and in lower case.
    """
    base = lambda c: F.lower(norm_parts(F.col(c))["base"]).alias("base")
    met = fuzzy.candidates(texts.select("search", base("search")), names.select("name", base("name")), "search", "name", "base")
    return met.join(names, "name").select("search", "name", "doc_id", fuzzy_equal(F.col("name"), F.col("search")).alias("equal"))


def fuzzy_counts(refs: DataFrame, docs: DataFrame, profile: SectorProfile = AUTOMOTIVE_DE) -> DataFrame:
    """(search, candidates, matches): how many names every search text meets, and how many of them match."""
    texts = graph.checkpoint(search_texts(refs, profile).select("search").distinct())  # read twice, made from all texts
    names = docs.groupBy(F.lower("filename").alias("name")).agg(F.min("doc_id").alias("doc_id"))
    met = fuzzy_matches(texts, names).groupBy("search").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("equal").alias("matches"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.join(met, "search", "left").select("search", zero("candidates"), zero("matches"))


def search_texts(refs: DataFrame, profile: SectorProfile = AUTOMOTIVE_DE) -> DataFrame:
    """``refs`` with the canonical norm, and the lower-cased text that is searched for."""
    known = refs.withColumn("normalized", F.when(F.col("type").isin(*EXTERNAL, "quality_spec"), canonical_norm(F.col("raw_text"), profile)))
    return known.withColumn("search", F.lower(F.coalesce("normalized", "raw_text")))


def resolve(refs: DataFrame, docs: DataFrame, profile: SectorProfile = AUTOMOTIVE_DE) -> DataFrame:
    """``refs`` with normalized, resolved_to, method and classification.

    Only distinct search texts meet the file names.  Names are cut into character
    trigrams: a text of three characters or more that a name contains shares its first
    trigram, so containment is an equi-join; edit distance below 3 is an equi-join on what
    two deletions leave (``fuzzy``).  ``docs(doc_id, filename)``; the first by doc_id wins.
    """
    known = search_texts(refs, profile)
    texts = known.select("search").distinct()
    names = docs.groupBy(F.lower("filename").alias("name")).agg(F.min("doc_id").alias("doc_id"))
    grams = names.select("name", "doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - 2)), lambda i: F.substring(F.col("name"), i, F.lit(3))))).alias("gram"))
    exact = texts.withColumn("gram", F.substring("search", 1, 3)).join(grams, "gram").where(F.contains("name", F.col("search"))).groupBy("search").agg(F.min("doc_id").alias("exact_id"))
    near = fuzzy_matches(texts, names).where("equal").groupBy("search").agg(F.min("doc_id").alias("fuzzy_id"))
    joined = known.join(exact, "search", "left").join(near, "search", "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("fuzzy_id").isNotNull(), "fuzzy").when(F.col("type").isin(*EXTERNAL), "external_norm").otherwise("unresolved")
    out = joined.withColumns({"resolved_to": F.coalesce("exact_id", "fuzzy_id"), "method": method})
    open_ = out.where((F.col("method") == "unresolved") & F.col("type").isin(*INTERNAL)).select(F.lower("raw_text").alias("needle")).distinct()
    words = open_.select("needle", F.explode(F.filter(F.split("needle", r"[-_\s]+"), lambda w: F.length(w) > 2)).alias("word"))
    by_word = words.withColumn("gram", F.substring("word", 1, 3)).join(grams, "gram").where(F.contains("name", F.col("word"))).select("needle")
    heads = names.select(F.substring("name", 1, 30).alias("head")).distinct().withColumn("len", F.length("head"))
    short = open_.where(F.length("needle") < 20)
    by_edit = short.select("needle", F.explode(F.sequence(F.length("needle") - 5, F.length("needle") + 5)).alias("len")).join(heads, "len").where(F.levenshtein("head", "needle") < 6).select("needle")
    failures = by_word.union(by_edit).distinct().withColumn("_hit", F.lit(True))
    out = out.join(failures, F.lower("raw_text") == F.col("needle"), "left")
    kind = F.when(F.col("_hit"), "likely_matcher_failure").otherwise("likely_missing_from_corpus")
    internal = (F.col("method") == "unresolved") & F.col("type").isin(*INTERNAL)
    return out.select("doc_id", "call", "type", "raw_text", "normalized", "section", "resolved_to", "method", F.when(internal, kind).alias("classification"))


def edges(resolved: DataFrame) -> DataFrame:
    """The reference graph: an edge for every resolved reference, repeats kept."""
    return resolved.where("resolved_to IS NOT NULL").select(F.col("doc_id").alias("src"), F.col("resolved_to").alias("dst"))


def usage(resolved: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct norms by project, and norms that one project alone uses (the first 20)."""
    norms = resolved.where(F.col("type").isin(*EXTERNAL)).select("doc_id", F.coalesce("normalized", "raw_text").alias("norm"))
    used = norms.join(docs.select("doc_id", F.coalesce("project", F.lit("unknown")).alias("project")), "doc_id").select("project", "norm").distinct()
    per = used.groupBy("project").agg(F.count(F.lit(1)).alias("norms"))
    alone = used.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.first("project").alias("project")).where("n = 1")
    return per, alone.orderBy("norm").limit(20).select("norm", "project")


def most_referenced(resolved: DataFrame, n: int = 10) -> DataFrame:
    norms = resolved.where(F.col("type").isin(*EXTERNAL)).groupBy(F.coalesce("normalized", "raw_text").alias("norm"))
    return norms.agg(F.count(F.lit(1)).alias("references")).orderBy(F.desc("references"), "norm").limit(n)


def resolution_rate(resolved: DataFrame) -> DataFrame:
    """One row: internal references, resolved ones, their rate (1 if there are none), external norms."""
    internal = F.col("type").isin(*INTERNAL)
    hit = internal & F.col("method").isin("exact", "fuzzy")
    out = resolved.agg(F.count_if(internal).alias("internal"), F.count_if(hit).alias("resolved"), F.count_if(F.expr("method = 'external_norm'")).alias("external"))
    return out.withColumn("rate", F.coalesce(F.try_divide("resolved", "internal"), F.lit(1.0)))


def rank_within(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of every group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
