"""Queries over references, requirements, headings, names and dates of the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import paths as P
from docloom.functions import text as T
from docloom.functions.profile import AUTOMOTIVE_DE, NORM_CANONICAL, PATTERNS
from docloom.operators import dashboard, graph, origin, references, report, requirements, selection

from . import planted as X
from .planted import PLANTED, planted, quote
from .views import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# references

_FOUND = {
    "norms": PATTERNS["norm"],
    "quality_spec": PATTERNS["quality_spec"],
    "fikb": PATTERNS["fikb"],
    "kb_master": PATTERNS["kb_master"],
    "chapter_refs": PATTERNS["chapter_ref"],
    "doc_refs": PATTERNS["doc_ref"],
    "corpus_ids": PATTERNS["intra_corpus_id"],
    "requirement_ids": PATTERNS["requirement_id"],
}


def _call(name: str, kind: str | None) -> str:
    found = f"list_transform({X.all_of('text_content', _FOUND[name])}, lambda m: substr(m, 1, 80))"
    if name == "corpus_ids":
        found = f"list_filter({found}, lambda m: upper(split_part(m, '-', 1)) NOT IN ({', '.join(map(quote, references.NORM_PREFIXES))}))"
    kind = quote(kind) if kind else "NULL"
    return f"SELECT doc_id, coalesce(substr(headings[1], 1, 80), 'unknown') AS section, {quote(name)} AS call, {kind} AS type, unnest(list_distinct({found})) AS raw_text FROM planted"


_RAW = f"""{PLANTED}, calls AS ({' UNION ALL '.join(_call(n, k) for n, k in references.CALLS)}),
  raw AS (SELECT doc_id, section, call, coalesce(type, {X.norm_type('raw_text')}) AS type, raw_text FROM calls)"""
_IN = lambda kinds: "(" + ", ".join(map(quote, kinds)) + ")"
_CANON = (
    "c AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {quote(a)}, {quote(b)})" for k, (a, b) in enumerate(NORM_CANONICAL.items()))
    + ") AS v(ord, key, name)), canon AS (SELECT raw_text, coalesce(max(name) FILTER (WHERE key = raw_text), arg_min(name, ord) FILTER (WHERE starts_with(lower(raw_text), lower(key)))) AS name"
    " FROM (SELECT DISTINCT raw_text FROM raw) CROSS JOIN c GROUP BY 1)"
)


def _part(x: str, group: int) -> str:
    year, dotted = r"^(.+?):\s*(\d{4})$", r"^([A-Za-z/\s]+)\s+(\d[\d.]*\d)$"
    pick = lambda p: f"trim(regexp_extract({x}, {X.re2(p)}, {group}))"
    return X.case([(X.has(x, year), pick(year)), (X.has(x, dotted), pick(dotted))], f"trim({x})" if group == 1 else "NULL")


_RESOLVED = f"""{_RAW}, {_CANON},
  known AS (SELECT raw.*, CASE WHEN type IN {_IN((*references.EXTERNAL, 'quality_spec'))} THEN canon.name END AS normalized FROM raw LEFT JOIN canon USING (raw_text)),
  searched AS (SELECT *, lower(coalesce(normalized, raw_text)) AS search FROM known),
  texts AS (SELECT search, {_part('search', 1)} AS base, {_part('search', 2)} AS version FROM (SELECT DISTINCT search FROM searched)),
  names AS (SELECT name, doc_id, {_part('name', 1)} AS base, {_part('name', 2)} AS version FROM (SELECT lower(filename) AS name, min(doc_id) AS doc_id FROM planted GROUP BY 1)),
  hits AS (SELECT search, min(names.doc_id) FILTER (WHERE contains(name, search)) AS exact_id,
    min(names.doc_id) FILTER (WHERE NOT coalesce(texts.version <> names.version, false) AND levenshtein(lower(texts.base), lower(names.base)) < 3) AS fuzzy_id
    FROM texts CROSS JOIN names GROUP BY 1),
  tried AS (SELECT s.*, coalesce(exact_id, fuzzy_id) AS resolved_to, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN fuzzy_id IS NOT NULL THEN 'fuzzy'
    WHEN type IN {_IN(references.EXTERNAL)} THEN 'external_norm' ELSE 'unresolved' END AS method FROM searched s JOIN hits USING (search)),
  needles AS (SELECT DISTINCT lower(raw_text) AS needle FROM tried WHERE method = 'unresolved' AND type IN {_IN(references.INTERNAL)}),
  failures AS (SELECT DISTINCT needle FROM needles CROSS JOIN names WHERE len(list_filter(regexp_split_to_array(needle, '[-_\\s]+'), lambda w: length(w) > 2 AND contains(name, w))) > 0
    OR (length(needle) < 20 AND levenshtein(substr(name, 1, 30), needle) < 6)),
  resolved AS (SELECT doc_id, call, type, raw_text, normalized, section, resolved_to, method, CASE WHEN method = 'unresolved' AND type IN {_IN(references.INTERNAL)}
    THEN CASE WHEN lower(raw_text) IN (SELECT needle FROM failures) THEN 'likely_matcher_failure' ELSE 'likely_missing_from_corpus' END END AS classification FROM tried)"""


def _resolved(spark, sf_dir):
    d = planted(spark, sf_dir)
    refs = graph.checkpoint(references.extract(d.select("doc_id", "headings", "text_content")))
    return references.resolve(refs, d.select("doc_id", "filename"))


@query("raw_references", f"WITH {_RAW} SELECT doc_id, section, call, type, raw_text FROM raw")
def raw_references(spark, sf_dir):
    return references.extract(planted(spark, sf_dir)).select("doc_id", "section", "call", "type", "raw_text")


@query("canonical_norms", f"WITH {_RAW}, {_CANON} SELECT DISTINCT raw_text AS raw, name FROM canon JOIN raw USING (raw_text) WHERE call = 'norms'")
def canonical_norms(spark, sf_dir):
    norms = references.extract(planted(spark, sf_dir)).where("call = 'norms'").select(F.col("raw_text").alias("raw")).distinct()
    return norms.select("raw", references.canonical_norm(F.col("raw")).alias("name"))


@query("norm_parts", f"WITH {_RAW} SELECT DISTINCT raw_text AS raw, {_part('raw_text', 1)} AS base, {_part('raw_text', 2)} AS version FROM raw")
def norm_parts(spark, sf_dir):
    raws = references.extract(planted(spark, sf_dir)).select(F.col("raw_text").alias("raw")).distinct()
    return raws.withColumn("p", references.norm_parts(F.col("raw"))).select("raw", "p.base", "p.version")


@query(
    "fuzzy_norm_pairs",
    f"""WITH {_RAW}, t AS (SELECT raw_text AS x, {_part('raw_text', 1)} AS base, {_part('raw_text', 2)} AS version FROM (SELECT DISTINCT raw_text FROM raw WHERE call = 'norms'))
    SELECT a.x AS a, b.x AS b, levenshtein(lower(a.base), lower(b.base)) AS distance, NOT coalesce(a.version <> b.version, false) AND levenshtein(lower(a.base), lower(b.base)) < 3 AS fuzzy
    FROM t a JOIN t b ON a.x < b.x""",
)
def fuzzy_norm_pairs(spark, sf_dir):
    t = references.extract(planted(spark, sf_dir)).where("call = 'norms'").select(F.col("raw_text").alias("a")).distinct()
    pairs = t.join(t.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))  # the few distinct norms of a profile
    base = lambda c: F.lower(references.norm_parts(F.col(c))["base"])
    return pairs.select("a", "b", F.levenshtein(base("a"), base("b")).cast("long").alias("distance"), references.fuzzy_equal(F.col("a"), F.col("b")).alias("fuzzy"))


@query("resolved_references", f"WITH {_RESOLVED} SELECT doc_id, call, raw_text, normalized, resolved_to, method, classification FROM resolved")
def resolved_references(spark, sf_dir):
    return _resolved(spark, sf_dir).select("doc_id", "call", "raw_text", "normalized", "resolved_to", "method", "classification")


def _rests(base: str) -> str:
    """A text and what one or two deletions leave of it."""
    n = f"length({base})"
    without = lambda t, i: f"substr({t}, 1, {i} - 1) || substr({t}, {i} + 1)"
    one = f"[{without(base, 'i')} for i in range(1, {n} + 1)]"
    two = f"flatten([[{without(f'({without(base, chr(106))})', 'i')} for j in range(i + 1, {n} + 1)] for i in range(1, {n})])"
    return f"list_distinct(list_concat([{base}], {one}, {two}))"


@query(
    "fuzzy_candidates",
    f"""WITH {_RESOLVED}, fn AS (SELECT name, any_value(lower(base)) AS b, any_value(version) AS version FROM names GROUP BY 1), ft AS (SELECT search, lower(base) AS b, version FROM texts),
      fr AS (SELECT name, unnest({_rests('b')}) AS rest FROM fn), tr AS (SELECT search, unnest({_rests('b')}) AS rest FROM ft),
      met AS (SELECT DISTINCT search, name FROM tr JOIN fr USING (rest)),
      hit AS (SELECT search, count(*) AS candidates, count(*) FILTER (WHERE NOT coalesce(ft.version <> fn.version, false) AND levenshtein(ft.b, fn.b) < 3) AS matches FROM met JOIN ft USING (search) JOIN fn USING (name) GROUP BY 1)
    SELECT search, coalesce(candidates, 0) AS candidates, coalesce(matches, 0) AS matches FROM (SELECT DISTINCT search FROM texts) LEFT JOIN hit USING (search)""",
)
def fuzzy_candidates(spark, sf_dir):
    """How many names every searched text is compared with; ``resolved_references`` has the outcome."""
    p = planted(spark, sf_dir)
    return references.fuzzy_counts(references.extract(p), p)


@query("reference_edges", f"WITH {_RESOLVED} SELECT doc_id AS src, resolved_to AS dst FROM resolved WHERE resolved_to IS NOT NULL")
def reference_edges(spark, sf_dir):
    return references.edges(_resolved(spark, sf_dir))


_USED = f"used AS (SELECT DISTINCT coalesce(project, 'unknown') AS project, coalesce(normalized, raw_text) AS norm FROM resolved JOIN doc_view USING (doc_id) WHERE type IN {_IN(references.EXTERNAL)})"


@query("norms_by_project", f"WITH {_RESOLVED}, {_USED} SELECT project, count(*) AS norms FROM used GROUP BY 1")
def norms_by_project(spark, sf_dir):
    return references.usage(_resolved(spark, sf_dir), planted(spark, sf_dir))[0]


@query(
    "norms_of_one_project",
    f"WITH {_RESOLVED}, {_USED} SELECT norm, any_value(project) AS project FROM used GROUP BY 1 HAVING count(*) = 1 ORDER BY norm LIMIT 20",
)
def norms_of_one_project(spark, sf_dir):
    return references.usage(_resolved(spark, sf_dir), planted(spark, sf_dir))[1]


@query(
    "most_referenced_norms",
    f"WITH {_RESOLVED} SELECT coalesce(normalized, raw_text) AS norm, count(*) AS refs FROM resolved WHERE type IN {_IN(references.EXTERNAL)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def most_referenced_norms(spark, sf_dir):
    return references.most_referenced(_resolved(spark, sf_dir)).withColumnRenamed("references", "refs")


@query(
    "reference_resolution_rates",
    f"""WITH {_RESOLVED}, i AS (SELECT count(*) FILTER (WHERE type IN {_IN(references.INTERNAL)}) AS internal,
      count(*) FILTER (WHERE type IN {_IN(references.INTERNAL)} AND method IN ('exact', 'fuzzy')) AS resolved, count(*) FILTER (WHERE method = 'external_norm') AS external,
      avg(CASE WHEN method IN ('exact', 'fuzzy', 'external_norm') THEN 1 ELSE 0 END) AS shown FROM resolved)
    SELECT internal, resolved, external, round(coalesce(resolved / CAST(nullif(internal, 0) AS DOUBLE), 1), 6) AS rate, round(coalesce(shown, 0), 6) AS shown FROM i""",
)
def reference_resolution_rates(spark, sf_dir):
    r = graph.checkpoint(_resolved(spark, sf_dir))
    both = references.resolution_rate(r).crossJoin(F.broadcast(dashboard.shown_resolution_rate(r).withColumnRenamed("rate", "shown")))  # one row each
    return both.withColumns({"rate": F.round("rate", 6), "shown": F.round("shown", 6)})


@query("norm_families", f"WITH {_RESOLVED} SELECT type, count(*) AS refs, count(DISTINCT coalesce(normalized, raw_text)) AS norms FROM resolved WHERE type IN {_IN(references.EXTERNAL)} GROUP BY 1")
def norm_families(spark, sf_dir):
    return dashboard.norm_families(_resolved(spark, sf_dir)).withColumnRenamed("references", "refs")


_COVERED = ("norm", "quality_spec", "fikb", "kb_master", "chapter_ref", "doc_ref", "version_marker", "intra_corpus_id", "requirement_id", "must", "should", "may", "informative",
            "quantity", "safety", "material", "tolerance", "testing", "packaging", "delivery", "oem_names")


@query(
    "pattern_coverage",
    f"WITH {PLANTED}, n AS ("
    + " UNION ALL ".join(f"SELECT {quote(k)} AS pattern, {X.count('text_content', PATTERNS[k])} AS m FROM planted" for k in _COVERED)
    + ") SELECT pattern, CAST(sum(m) AS BIGINT) AS matches, count(*) FILTER (WHERE m > 0) AS documents, sum(m) = 0 AS zero FROM n GROUP BY 1",
)
def pattern_coverage(spark, sf_dir):
    return report.pattern_coverage(planted(spark, sf_dir), {k: PATTERNS[k] for k in _COVERED})


# requirements


def _status(s: str) -> str:
    t = X.trim(s)
    subject = " OR ".join(
        [
            X.has(t, r"^(?:Die|Das|Der|Ein|Eine|Alle|Jede[rs]?)\s+[A-ZÄÖÜ]"),
            X.has(t, r"^(?:The|A|An|All|Each|Every)\s+[a-zA-Z]"),
            X.has(t, r"^[A-Z].*\b(?:shall|must|should)\b"),
            X.has(s, r"[A-Z]{2,}"),
            X.has(s, r"[A-Z][a-z]+[A-Z][a-z]+"),
        ]
    )
    words = f"len(regexp_split_to_array({t}, '\\s+'))"
    negated = X.has(s, r"nicht\s+muss|muss\s+nicht|nicht\s+soll|soll\s+nicht", "i")
    return X.case([(negated, "'negated'"), (f"NOT ({subject}) OR {words} NOT BETWEEN 8 AND 80", "'uncertain'")], "'confirmed'")


_TYPED = AUTOMOTIVE_DE.requirement_patterns
_PARTS = "regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_SECTIONS = f"""{PLANTED},
  ln AS (SELECT doc_id, headings, unnest(string_split(text_content, chr(10))) AS line, generate_subscripts(string_split(text_content, chr(10)), 1) AS pos FROM planted),
  lt AS (SELECT *, {X.trim('line')} AS t FROM ln),
  ls AS (SELECT *, length(t) BETWEEN 3 AND 150 AND list_contains(list_transform(headings, lambda h: lower(h)), lower(t)) AS starts FROM lt),
  lg AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ls),
  sg AS (SELECT doc_id, g, coalesce(max(substr(t, 1, 120)) FILTER (WHERE starts), 'Einleitung') AS heading, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT starts) AS text FROM lg
    GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT starts) > 0),
  sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS section, heading, text FROM sg)"""
_REQUIREMENTS = f"""{_SECTIONS},
  rt AS (SELECT *, {X.requirement_type('text')} AS type, {_PARTS} AS parts, {X.all_of('text', PATTERNS['quantity'])} AS q FROM sections),
  rs AS (SELECT *, coalesce({X.case([(f"type = {quote(k)}", f"list_filter(parts, lambda x: {X.has('x', _TYPED[k])})[1]") for k in _TYPED])}, text) AS sentence FROM rt),
  requirements AS (SELECT doc_id, section, heading, text, type, {X.requirement_category('text')} AS category, len(q) AS quantity_count,
    list_distinct(list_transform(q, lambda m: coalesce(nullif(regexp_extract(m, '[a-zA-Z°%µ]+'), ''), '?'))) AS units,
    substr({X.first('text', PATTERNS['norm'])}, 1, 30) AS linked_norm,
    substr(coalesce({X.first('text', PATTERNS['quality_spec'])}, {X.first('text', PATTERNS['fikb'])}, {X.first('text', PATTERNS['kb_master'])}), 1, 30) AS linked_entity,
    {X.has('text', PATTERNS['safety'])} AS safety, sentence, {_status('sentence')} AS status FROM rs)"""


def _requirements(spark, sf_dir):
    return requirements.extract(planted(spark, sf_dir))


@query("text_sections", f"WITH {_SECTIONS} SELECT doc_id, section, heading, md5(text) AS digest FROM sections")
def text_sections(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", F.posexplode(requirements.sections(F.col("text_content"), F.col("headings"))).alias("section", "x"))
    return d.select("doc_id", F.col("section").cast("long").alias("section"), "x.heading", F.md5("x.text").alias("digest"))


@query(
    "requirements_of_sections",
    f"WITH {_REQUIREMENTS} SELECT doc_id, section, heading, type, category, quantity_count, array_to_string(list_sort(units), ',') AS units, linked_norm, linked_entity, safety, status FROM requirements",
)
def requirements_of_sections(spark, sf_dir):
    r = _requirements(spark, sf_dir)
    return r.select(
        "doc_id", F.col("section").cast("long").alias("section"), "heading", "type", "category", F.col("quantity_count").cast("long").alias("quantity_count"),
        F.array_join(F.array_sort("units"), ",").alias("units"), "linked_norm", "linked_entity", "safety", "status",
    )


@query("requirement_sentences", f"WITH {_REQUIREMENTS} SELECT doc_id, section, md5(sentence) AS digest FROM requirements")
def requirement_sentences(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", F.posexplode(requirements.sections(F.col("text_content"), F.col("headings"))).alias("section", "x"))
    sentence = requirements.requirement_sentence(F.col("x.text"), C.requirement_type(F.col("x.text")))
    return d.select("doc_id", F.col("section").cast("long").alias("section"), F.md5(sentence).alias("digest"))


@query(
    "section_signals",
    f"""WITH {_SECTIONS} SELECT doc_id, section, {X.count('text', r'[^\s]+')} AS words, {X.count('text', r'\b(?:muss|müssen|soll|sollen|kann|können|shall|must|should)\b', 'i')} AS modals,
    greatest(1, len(list_filter({_PARTS}, lambda x: regexp_matches(x, '\\S')))) AS sentences,
    {X.has('text', r'\d+[,.]?\d*\s*(?:mm|cm|m\b|kg|g\b|°C|K\b|N\b|MPa|kN|%|bar|kPa|µm)', 'i')} AS has_quantity FROM sections""",
)
def section_signals(spark, sf_dir):
    s = _requirements(spark, sf_dir).select("doc_id", F.col("section").cast("long").alias("section"), "signals.*")
    return s.select("doc_id", "section", *[F.col(c).cast("long").alias(c) for c in ("words", "modals", "sentences")], "has_quantity")


@query(
    "requirement_quality",
    f"WITH {_REQUIREMENTS} SELECT doc_id, count(*) AS raw, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("confirmed", "negated", "uncertain")) + " FROM requirements GROUP BY 1",
)
def requirement_quality(spark, sf_dir):
    return requirements.quality_by_document(_requirements(spark, sf_dir))


@query(
    "filtered_requirements",
    f"""WITH {_REQUIREMENTS} SELECT doc_id, section, heading FROM requirements WHERE type = 'MANDATORY' AND safety AND contains(lower(concat_ws(' ', heading, type, category)), 'safe')""",
)
def filtered_requirements(spark, sf_dir):
    r = dashboard.filter_requirements(_requirements(spark, sf_dir), "MANDATORY", True, "Safe")
    return r.select("doc_id", F.col("section").cast("long").alias("section"), "heading")


@query("searched_requirements", f"WITH {_REQUIREMENTS} SELECT doc_id, section FROM requirements WHERE contains(lower(concat_ws(' ', heading, type, category, status)), 'umfang mand')")
def searched_requirements(spark, sf_dir):
    rows = _requirements(spark, sf_dir).select("heading", "type", "category", "status", "doc_id", "section")
    return dashboard.search_rows(rows, "Umfang MAND").select("doc_id", F.col("section").cast("long").alias("section"))


@query("requirement_types", f"WITH {PLANTED}, l AS (SELECT doc_id, unnest(string_split(text_content, chr(10))) AS t FROM planted) SELECT doc_id, t, {X.requirement_type('t')} AS type, {X.requirement_category('t')} AS category FROM l")
def requirement_types(spark, sf_dir):
    lines = planted(spark, sf_dir).select("doc_id", F.explode(F.split("text_content", "\n")).alias("t"))
    return lines.select("doc_id", "t", C.requirement_type(F.col("t")).alias("type"), C.requirement_category(F.col("t")).alias("category"))


_DENSE = {"mandatory": "must", "recommended": "should", "permitted": "may", "informative": "informative", "norms": "norm", "quantities": "quantity"}


@query("requirement_density", f"WITH {PLANTED} SELECT doc_id, " + ", ".join(f"round({X.count('text_content', PATTERNS[p])} / CAST(page_count AS DOUBLE), 6) AS {n}" for n, p in _DENSE.items()) + " FROM planted")
def requirement_density(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", C.requirement_density(F.col("text_content"), F.col("page_count")).alias("r"))
    return d.select("doc_id", *[F.round(f"r.{c}", 6).alias(c) for c in _DENSE])


@query(
    "stratified_documents",
    "SELECT source, count(*) AS documents, least(count(*), greatest(2, CAST(ceil(count(*) * 0.1 - 1e-9) AS BIGINT))) AS sampled FROM documents GROUP BY 1",
)
def stratified_documents(spark, sf_dir):
    """A tenth of every source, two documents at least, by a seeded hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    some = selection.first_by_hash(d, ["source"], F.greatest(F.lit(2), F.ceil(F.col("n") * 0.1 - 1e-9)), ["doc_id"], 7)
    sampled = some.groupBy("source").agg(F.count(F.lit(1)).alias("sampled"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).join(sampled, "source")


_SAMPLED = "SELECT 'type ' || (doc_id % 3) AS doc_type, doc_id, CAST(doc_id % 5 AS INTEGER) AS regex_count, CAST(doc_id % 7 AS INTEGER) AS model_count FROM documents"
_OFF = "abs(model_count - regex_count) / CAST(greatest(model_count, regex_count, 1) AS DOUBLE)"


def _sampled(spark, sf_dir):
    i = F.col("doc_id")
    return planted(spark, sf_dir).select(F.concat(F.lit("type "), (i % 3).cast("string")).alias("doc_type"), "doc_id", (i % 5).cast("int").alias("regex_count"), (i % 7).cast("int").alias("model_count"))


@query(
    "validation_statistics",
    f"""WITH s AS (SELECT doc_id, {_OFF} AS off FROM ({_SAMPLED})), a AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS documents, avg(off) AS delta, coalesce(stddev_samp(off), 0) AS sd FROM s)
    SELECT n, documents, round(delta, 6) AS delta, round(delta - 1.96 * sd / sqrt(n), 6) AS low, round(delta + 1.96 * sd / sqrt(n), 6) AS high FROM a""",
)
def validation_statistics(spark, sf_dir):
    return requirements.validation(_sampled(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("delta", "low", "high")})


@query("validation_by_type", f"SELECT doc_type, count(*) AS sampled, round(avg({_OFF}), 6) AS avg_delta FROM ({_SAMPLED}) GROUP BY 1")
def validation_by_type(spark, sf_dir):
    return requirements.validation_by_type(_sampled(spark, sf_dir)).withColumn("avg_delta", F.round("avg_delta", 6))


# headings, types, OEM

_LINES = f"""{PLANTED}, hl AS (SELECT doc_id, unnest(string_split(text_content, chr(10))) AS line, generate_subscripts(string_split(text_content, chr(10)), 1) AS pos FROM planted),
  ht AS (SELECT doc_id, pos, {X.trim('line')} AS t FROM hl),
  hn AS (SELECT doc_id, list(trim(regexp_replace(t, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.{{3,80}})$', '\\1 \\2')) ORDER BY pos) AS numbered FROM ht WHERE regexp_matches(t, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.{{3,80}})$') GROUP BY 1),
  hx AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM ht WHERE t <> ''),
  hh AS (SELECT doc_id, list(t ORDER BY pos) AS heuristic FROM hx WHERE length(t) BETWEEN 4 AND 80 AND t NOT LIKE '%.' AND t NOT LIKE '%,' AND NOT regexp_matches(t, '^\\d+$') AND length(after) > 80 GROUP BY 1),
  hm AS (SELECT p.doc_id, p.headings AS structure, coalesce(numbered, CAST([] AS VARCHAR[])) AS numbered, coalesce(heuristic, CAST([] AS VARCHAR[])) AS heuristic FROM planted p LEFT JOIN hn USING (doc_id) LEFT JOIN hh USING (doc_id)),
  merged AS (SELECT *, CASE WHEN len(structure) > 3 THEN structure WHEN len(numbered) > 3 THEN numbered WHEN len(heuristic) > 3 THEN heuristic ELSE list_concat(numbered, structure, heuristic) END AS every,
    CASE WHEN len(structure) > 3 THEN 'structure' WHEN len(numbered) > 3 THEN 'numbered' WHEN len(heuristic) > 3 THEN 'heuristic' ELSE 'union' END AS strategy FROM hm)"""


@query(
    "merged_headings",
    f"""WITH {_LINES} SELECT doc_id, md5(array_to_string(numbered, '|')) AS numbered, md5(array_to_string(heuristic, '|')) AS heuristic, strategy,
    CAST(CASE WHEN strategy = 'union' THEN len(list_distinct(every)) ELSE len(every) END AS BIGINT) AS headings FROM merged""",
)
def merged_headings(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", "headings", C.numbered_headings(F.col("text_content")).alias("numbered"), C.heuristic_headings(F.col("text_content")).alias("heuristic"))
    m = d.withColumn("m", C.merge_headings(F.col("headings"), F.col("numbered"), F.col("heuristic")))
    digest = lambda c: F.md5(F.array_join(c, "|")).alias(c)
    return m.select("doc_id", digest("numbered"), digest("heuristic"), "m.strategy", F.size("m.headings").cast("long").alias("headings"))


_LEVEL = "CASE WHEN regexp_matches(h, '^\\d') THEN least(6, 1 + len(regexp_extract_all(regexp_extract(h, '^\\d+(?:\\.\\d+)*'), '\\.'))) ELSE 2 END"
_NODES = f"{PLANTED}, nodes AS (SELECT doc_id, h, {_LEVEL} AS level FROM (SELECT doc_id, unnest(headings) AS h FROM planted))"


@query(
    "heading_nodes",
    f"WITH {_NODES} SELECT doc_id, h AS text, CAST(level AS INTEGER) AS level, nullif(regexp_extract(h, '^(\\d+(?:\\.\\d+)*)', 1), '') AS numbering, CAST(ceil(length(h) / CAST(4.2 AS DOUBLE)) AS INTEGER) AS tokens FROM nodes",
)
def heading_nodes(spark, sf_dir):
    n = planted(spark, sf_dir).select("doc_id", F.explode(C.heading_nodes(F.col("headings"))).alias("x"))
    return n.select("doc_id", "x.text", "x.level", "x.numbering", F.col("x.approximate_tokens").alias("tokens"))


@query(
    "heading_levels",
    f"""WITH {_NODES} SELECT doc_id, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2, count(*) FILTER (WHERE level = 3) AS h3, count(*) FILTER (WHERE level > 3) AS h4_plus
    FROM planted LEFT JOIN nodes USING (doc_id) GROUP BY 1""",
)
def heading_levels(spark, sf_dir):
    n = planted(spark, sf_dir).select("doc_id", C.level_counts(C.heading_nodes(F.col("headings"))).alias("n"))
    return n.select("doc_id", *[F.col(f"n.{c}").cast("long").alias(c) for c in ("h1", "h2", "h3", "h4_plus")])


@query("heading_depth_chart", f"WITH {_NODES} SELECT CAST(level AS INTEGER) AS level, count(*) AS headings FROM nodes GROUP BY 1")
def heading_depth_chart(spark, sf_dir):
    return dashboard.heading_depths(planted(spark, sf_dir).select(C.heading_nodes(F.col("headings")).alias("nodes")))


@query(
    "section_token_chart",
    f"""WITH {PLANTED}, m AS (SELECT ceil(length(text_content) / CAST(4.2 AS DOUBLE)) / len(headings) AS v FROM planted WHERE len(headings) > 0)
    SELECT r AS range, (SELECT count(*) FROM m WHERE v BETWEEN lo AND hi) AS n FROM (VALUES ('0-100', 0, 100), ('101-300', 101, 300), ('301-600', 301, 600), ('601+', 601, 1000000000)) AS t(r, lo, hi)""",
)
def section_token_chart(spark, sf_dir):
    d = planted(spark, sf_dir).select(F.size("headings").alias("headings"), T.tokens_by_length(F.col("text_content")).alias("tokens"))
    return dashboard.section_tokens(d)


_TABLES, _IMAGES = "CAST(doc_id % 7 AS INTEGER)", "CAST(doc_id % 13 AS INTEGER)"
_PER_PAGE = "char_count / CAST(greatest(page_count, 1) AS DOUBLE)"
_PDF = f"CASE WHEN {_PER_PAGE} < 10 THEN 'fully_scanned' WHEN {_PER_PAGE} < 200 AND {_IMAGES} > page_count THEN 'hybrid' ELSE 'native' END"


def _plan():
    i = F.col("doc_id")
    kind = C.pdf_class(F.col("char_count"), F.col("page_count"), (i % 13).cast("int"))
    return kind, C.chunk_strategy(F.col("extension"), C.heading_nodes(F.col("headings")), (i % 7).cast("int"), kind)


_DEEPEST = f"coalesce(list_max(list_transform(headings, lambda h: {_LEVEL})), 0)"
_BY_HEADINGS = f"CASE WHEN len(headings) >= 10 AND {_DEEPEST} > 2 THEN 0.9::DOUBLE WHEN len(headings) >= 5 THEN 0.78::DOUBLE ELSE 0.6::DOUBLE END"
_STRATEGY = f"""CASE WHEN extension = '.xlsx' THEN 'table_rows' WHEN len(headings) = 0 THEN 'sliding_window' ELSE 'heading_sections' END"""
_CONFIDENCE = f"""CASE WHEN extension = '.xlsx' THEN 0.95 WHEN len(headings) = 0 THEN CASE WHEN {_PDF} = 'fully_scanned' THEN 0.9 ELSE 0.75 END
  WHEN {_TABLES} > 5 THEN greatest({_BY_HEADINGS} - 0.1::DOUBLE, 0.5::DOUBLE) ELSE {_BY_HEADINGS} END"""

_ALTERNATIVE = f"CASE WHEN extension <> '.xlsx' AND {_TABLES} > CASE WHEN len(headings) = 0 THEN 3 ELSE 5 END THEN 'table_rows' END"

@query(
    "chunk_strategies",
    f"""WITH {PLANTED} SELECT doc_id, {_PDF} AS pdf_class, {_STRATEGY} AS strategy, round({_CONFIDENCE}, 6) AS confidence,
    {_ALTERNATIVE} AS alternative FROM planted""",
)
def chunk_strategies(spark, sf_dir):
    kind, plan = _plan()
    d = planted(spark, sf_dir).select("doc_id", kind.alias("pdf_class"), plan.alias("p"))
    return d.select("doc_id", "pdf_class", "p.strategy", F.round("p.confidence", 6).alias("confidence"), "p.alternative")


_SAMPLE = "lower(concat_ws(' ', array_to_string(headings, ' '), substr(text_content, 1, 2000)))"


def _type_sql() -> str:
    name = "lower(filename)"
    by_content = [(f"({X.has('content', p, 'i')} OR {X.has(name, C.NORM_IN_NAME, 'i')})" if k == "norm" else X.has("content", p, "i"), quote(k)) for k, p in C.TYPE_BY_CONTENT]
    return X.case([*[(X.has(name, p, "i"), quote(k)) for k, p in C.TYPE_BY_NAME], *by_content], "'other'")


_TYPES = f"{PLANTED}, ct AS (SELECT *, {_SAMPLE} AS content FROM planted), typed AS (SELECT *, {_type_sql()} AS doc_type FROM ct)"


def _doc_type():
    return C.document_type(F.col("filename"), F.col("headings"), F.substring("text_content", 1, 2000))


@query("document_types", f"WITH {_TYPES} SELECT doc_id, doc_type, doc_type IN {_IN(C.RELIABLE_TYPES)} AND extension <> '.xlsx' AS reliable FROM typed")
def document_types(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", "extension", _doc_type().alias("doc_type"))
    return d.select("doc_id", "doc_type", C.requirement_reliable(F.col("doc_type"), F.col("extension")).alias("reliable"))


def _oem_sql(t: str) -> str:
    p = PATTERNS
    return X.case(
        [
            (f"({X.has(t, p['fikb'])} OR {X.has(t, chr(92) + 'bmerced(es|benz)' + chr(92) + 'b', 'i')})", "'mercedes'"),
            (f"({X.has(t, p['quality_spec'])} OR {X.has(t, chr(92) + 'bbmw' + chr(92) + 'b', 'i')})", "'bmw'"),
            (f"({X.has(t, p['kb_master'])} OR {X.has(t, chr(92) + 'baudi' + chr(92) + 'b', 'i')})", "'audi'"),
        ],
        "'unknown'",
    )


_OEM = f"""oem AS (SELECT *, CASE WHEN doc <> 'unknown' THEN doc ELSE folder END AS oem, CASE WHEN doc = 'unknown' THEN 'folder' WHEN folder <> 'unknown' AND folder <> doc THEN 'reconciled' ELSE 'document_internal' END AS oem_source
  FROM (SELECT *, {_oem_sql("concat_ws(' ', substr(text_content, 1, 2000), array_to_string(headings, ' '))")} AS doc, {_oem_sql("replace(concat_ws('/', customer, path), '/', ' ')")} AS folder FROM typed))"""


def _oem():
    return C.detect_oem(F.substring("text_content", 1, 2000), F.col("headings"), P.segments(F.concat_ws("/", "customer", "path")))


@query("oem_of_documents", f"WITH {_TYPES}, {_OEM} SELECT doc_id, oem, oem_source FROM oem")
def oem_of_documents(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", _oem().alias("o"))
    return d.select("doc_id", "o.oem", F.col("o.source").alias("oem_source"))


def _flag(both: str, content: str) -> str:
    return f"({X.has('lower(filename)', both, 'i')} OR {X.has('content', content, 'i')})"


@query(
    "audit_signals",
    f"""WITH {_TYPES}, t AS (SELECT *, concat_ws(' ', substr(text_content, 1, 2000), customer, path) AS x FROM typed) SELECT doc_id, CAST(len(headings) AS INTEGER) AS heading_count,
    {_flag(r'\bfmea\b', r'\bfmea\b')} AS fmea_type, {_flag(r'\b(srs|irs|lastenheft|anforderung|requirement)\b', 'lastenheft|anforderung|requirement')} AS lastenheft,
    {_flag('testbericht|ergebnisbericht|prüfbericht', 'testbericht|ergebnisbericht')} AS testbericht, {_flag('abweichliste', 'abweichliste|abweichungsliste')} AS abweichliste,
    {X.has('content', r'iso\s*\d|din\s*\d|en\s*\d|\bnorm\b', 'i')} AS norm, {X.has('x', PATTERNS['fikb'])} AS fikb, {X.has('x', PATTERNS['kb_master'])} AS kb_master,
    {X.has('x', PATTERNS['quality_spec'])} AS quality_spec, {X.has('x', r'\bmerced(es|benz)\b', 'i')} AS mercedes, {X.has('x', r'\bbmw\b', 'i')} AS bmw, {X.has('x', r'\baudi\b', 'i')} AS audi FROM t""",
)
def audit_signals(spark, sf_dir):
    sample = F.substring("text_content", 1, 2000)
    d = planted(spark, sf_dir).select(
        "doc_id", dashboard.type_signals(F.col("filename"), F.col("headings"), sample).alias("t"), dashboard.oem_signals(F.concat_ws(" ", sample, "customer", "path")).alias("o")
    )
    return d.select("doc_id", "t.heading_count", F.col("t.fmea").alias("fmea_type"), *[f"t.{c}" for c in ("lastenheft", "testbericht", "abweichliste", "norm")], "o.*")


# paths and dates

_DIRS = "list_filter(string_split(concat_ws('/', customer, path), '/'), lambda x: x <> '')"
_TOKENS = "|".join(p for _, p in P.CUSTOMERS)


@query(
    "customer_and_project",
    f"""WITH {PLANTED}, d AS (SELECT doc_id, list_slice({_DIRS}, 1, len({_DIRS}) - 1) AS dirs FROM planted),
    n AS (SELECT *, list_filter(list_transform(dirs, lambda s: {X.case([(X.has('s', p, 'i'), quote(k)) for k, p in P.CUSTOMERS])}), lambda x: x IS NOT NULL) AS named,
      list_filter(range(1, len(dirs) + 1), lambda i: {X.has('dirs[i]', _TOKENS, 'i')}) AS places FROM d)
    SELECT doc_id, named[1] AS customer, dirs[coalesce(places[1], 0) + 1] AS project FROM n""",
)
def customer_and_project(spark, sf_dir):
    dirs = P.directories(F.concat_ws("/", "customer", "path"))
    return planted(spark, sf_dir).select("doc_id", P.customer(dirs).alias("customer"), P.project(dirs).alias("project"))


@query(
    "folder_inference",
    f"""WITH {PLANTED}, s AS (SELECT count(*) AS n, min(len(string_split(path, '/')) - 1) AS lo, max(len(string_split(path, '/')) - 1) AS hi, avg(len(string_split(path, '/')) - 1) AS mean,
      list_sort(list(DISTINCT customer) FILTER (WHERE customer IS NOT NULL)) AS c, list_sort(list(DISTINCT project) FILTER (WHERE project IS NOT NULL)) AS p, list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)) AS k FROM planted)
    SELECT CASE WHEN n = 0 THEN 'empty' WHEN hi - lo <= 1 AND mean <= 2 THEN 'flat' WHEN len(k) > 0 AND len(p) > 0 THEN 'project/doc-category/docs' WHEN len(c) > 0 AND len(p) > 0 THEN 'customer/project/offer-version/docs' WHEN mean >= 3 THEN 'deep-nested' ELSE 'unknown' END AS pattern,
      CASE WHEN n = 0 THEN 0.0 WHEN hi - lo <= 1 AND mean <= 2 THEN 0.7 WHEN len(k) > 0 AND len(p) > 0 THEN 0.85 WHEN len(c) > 0 AND len(p) > 0 THEN 0.75 WHEN mean >= 3 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence,
      array_to_string(c, ',') AS customers, array_to_string(p, ',') AS projects, array_to_string(k, ',') AS categories FROM s""",
)
def folder_inference(spark, sf_dir):
    f = report.folder_inference(planted(spark, sf_dir).withColumn("depth", P.depth(F.col("path"))))
    return f.select("pattern", "confidence", *[F.array_join(c, ",").alias(c) for c in ("customers", "projects", "categories")])


# a name with a dashed and one with a packed date, possible and impossible ones
_DATED = """dated AS (SELECT *, 'spec_' || (2018 + doc_id % 15) || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '_' END || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS dashed,
  'v' || (1995 + doc_id % 50) || lpad(CAST(doc_id % 13 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 32 AS VARCHAR), 2, '0') AS packed,
  substr(text_content, 1, 40) || ' Stand: ' || (doc_id % 31) || '.' || (doc_id % 13) || '.' || (1998 + doc_id % 40) || ' ' || substr(text_content, 41) AS said,
  CASE WHEN doc_id % 3 = 0 THEN best_date END AS meta, best_date + 1 AS created, best_date + CAST(1 + doc_id % 2 AS INTEGER) AS modified FROM planted)"""


def _dated(spark, sf_dir):
    i = F.col("doc_id")
    two = lambda n: F.lpad((i % n).cast("string"), 2, "0")
    return planted(spark, sf_dir).withColumns(
        {
            "dashed": F.concat(F.lit("spec_"), (2018 + i % 15).cast("string"), F.when(i % 2 == 0, "-").otherwise("_"), two(14), F.lit("-"), two(33)),
            "packed": F.concat(F.lit("v"), (1995 + i % 50).cast("string"), two(13), two(32)),
            "said": F.concat(F.substring("text_content", 1, 40), F.format_string(" Stand: %d.%d.%d ", i % 31, i % 13, 1998 + i % 40), F.expr("substring(text_content, 41)")),
            "meta": F.when(i % 3 == 0, F.col("best_date")),
            "created": F.date_add("best_date", 1),
            "modified": F.date_add("best_date", (1 + i % 2).cast("int")),
        }
    )


def _name_date(n: str) -> str:
    dashed = f"CAST(try_strptime(replace(nullif(regexp_extract({n}, '\\d{{4}}[-_]\\d{{2}}[-_]\\d{{2}}'), ''), '_', '-'), '%Y-%m-%d') AS DATE)"
    packed = f"CAST(try_strptime(nullif(regexp_extract({n}, '\\d{{8}}'), ''), '%Y%m%d') AS DATE)"
    return f"coalesce({dashed}, CASE WHEN year({packed}) BETWEEN 2000 AND 2030 THEN {packed} END)"


_TEXT_DATE = r"""(CASE WHEN year(d) BETWEEN 2000 AND 2035 THEN d END)"""
_SAID = r"""said AS (SELECT *, CAST(try_strptime(regexp_extract(said, 'Stand\s*:?\s*(\d{1,2})\.(\d{1,2})\.(\d{4})', 3) || '-' || lpad(regexp_extract(said, 'Stand\s*:?\s*(\d{1,2})\.(\d{1,2})\.(\d{4})', 2), 2, '0') || '-' || lpad(regexp_extract(said, 'Stand\s*:?\s*(\d{1,2})\.(\d{1,2})\.(\d{4})', 1), 2, '0'), '%Y-%m-%d') AS DATE) AS d FROM dated)"""


@query("dates_in_names", f"WITH {PLANTED}, {_DATED} SELECT doc_id, {_name_date('dashed')} AS dashed, {_name_date('packed')} AS packed, {_name_date('filename')} AS named FROM dated")
def dates_in_names(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", *[P.date_in_name(F.col(c)).alias(a) for c, a in (("dashed", "dashed"), ("packed", "packed"), ("filename", "named"))])


@query("dates_in_texts", f"WITH {PLANTED}, {_DATED}, {_SAID} SELECT doc_id, {_TEXT_DATE} AS day, CASE WHEN {_TEXT_DATE} IS NOT NULL THEN 'stand_pattern' END AS source FROM said")
def dates_in_texts(spark, sf_dir):
    d = _dated(spark, sf_dir).select("doc_id", P.date_in_text(F.col("said")).alias("x"))
    return d.select("doc_id", F.col("x.date").alias("day"), "x.source")


@query(
    "date_signals",
    f"""WITH {PLANTED}, {_DATED}, {_SAID}, s AS (SELECT *, {_name_date('packed')} AS n, {_TEXT_DATE} AS t FROM said),
    i AS (SELECT *, CASE WHEN meta IS NOT NULL THEN CASE WHEN extension = '.docx' THEN 'docx_core_xml' ELSE 'pdf_metadata' END WHEN n IS NOT NULL THEN 'filename' WHEN t IS NOT NULL THEN 'stand_pattern' END AS source FROM s)
    SELECT doc_id, modified <> created AS mtime_reliable, coalesce(meta, n, t) AS internal, source, coalesce(meta, n, t, created) AS best,
      CASE WHEN source IS NULL THEN 'mtime' WHEN source IN ('docx_core_xml', 'pdf_metadata') THEN source ELSE 'filename' END AS date_source FROM i""",
)
def date_signals(spark, sf_dir):
    d = _dated(spark, sf_dir)
    s = d.select("doc_id", P.date_signals(F.col("meta"), F.col("packed"), F.col("said"), F.col("created"), F.col("modified"), F.col("extension")).alias("s"))
    return s.select(
        "doc_id", "s.mtime_reliable", F.col("s.document_internal_date").alias("internal"), F.col("s.internal_date_source").alias("source"), F.col("s.best_date").alias("best"),
        P.date_source(F.col("s.internal_date_source")).alias("date_source"),
    )


@query(
    "same_directories",
    f"""WITH {PLANTED} SELECT a.doc_id AS a, b.doc_id AS b, regexp_replace(a.path, '/[^/]*$', '') = regexp_replace(b.path, '/[^/]*$', '') AS same,
    abs(date_diff('day', a.best_date, b.best_date)) AS days FROM planted a JOIN planted b ON b.doc_id = a.doc_id + 60""",
)
def same_directories(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", "path", "best_date")
    other = d.select((F.col("doc_id") - 60).alias("doc_id"), F.col("doc_id").alias("b"), F.col("path").alias("_p"), F.col("best_date").alias("_d"))
    j = d.join(other, "doc_id")
    return j.select(F.col("doc_id").alias("a"), "b", P.same_directory(F.col("path"), F.col("_p")).alias("same"), F.abs(F.datediff("best_date", "_d")).cast("long").alias("days"))


# origin

_WHO = origin.CompanyIdentity("Nordwerk GmbH", ("src3 tools",))


def _origin_sql() -> str:
    words = _WHO.words()
    sample = "lower(substr(text_content, 1, 2000))"
    n = " + ".join(f"(length({sample}) - length(replace({sample}, {quote(w)}, ''))) // {len(w)}" for w in words)
    own = ", ".join(map(quote, words))
    stop = ", ".join(map(quote, origin.STOP_WORDS))
    in_path = f"len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda s: len(list_filter(regexp_split_to_array(lower(s), '[\\s\\-_.,&/]+'), lambda w: length(w) >= 3 AND w NOT IN ({stop}) AND w IN ({own}))) > 0)) > 0"
    side = lambda d: " + ".join(f"CASE WHEN doc_type IN {_IN(t)} THEN {w} ELSE 0 END" for t, _, x, w in origin.TYPE_SIGNALS if x == d)
    return f"""og AS (SELECT *, CASE WHEN {in_path} THEN 4 ELSE 0 END + CASE WHEN mentions >= 3 THEN 3 WHEN mentions >= 1 THEN 1 ELSE 0 END + {side('internal')} AS i,
      {side('external')} + CASE WHEN customer IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN category IN ('rfq', 'quotation') THEN 2 ELSE 0 END AS e FROM (SELECT *, {n} AS mentions FROM typed)),
    oc AS (SELECT *, CASE WHEN i >= 4 AND i > e THEN 'internal' WHEN e >= 3 AND e > i THEN 'external' ELSE 'unknown' END AS result FROM og),
    origins AS (SELECT *, CASE WHEN result = 'unknown' THEN 'none' WHEN (CASE WHEN result = 'internal' THEN i ELSE e END) >= 8 THEN 'high' WHEN (CASE WHEN result = 'internal' THEN i ELSE e END) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM oc)"""


def _origin(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("doc_type", _doc_type())
    found = origin.signals(_WHO, P.segments(F.col("path")), F.col("text_content"), F.col("doc_type"), F.col("customer"), F.col("category"))
    return d.withColumn("o", origin.classify(found))


@query("origins", f"WITH {_TYPES}, {_origin_sql()} SELECT doc_id, CAST(i AS INTEGER) AS internal, CAST(e AS INTEGER) AS external, result, confidence FROM origins")
def origins(spark, sf_dir):
    return _origin(spark, sf_dir).select("doc_id", "o.internal", "o.external", "o.result", "o.confidence")


@query("origin_counts", f"WITH {_TYPES}, {_origin_sql()} SELECT result, confidence, count(*) AS documents FROM origins GROUP BY 1, 2")
def origin_counts(spark, sf_dir):
    return _origin(spark, sf_dir).groupBy("o.result", "o.confidence").agg(F.count(F.lit(1)).alias("documents"))


# what is found in texts: marks, garbling, estimates


@query(
    "text_marks",
    f"""WITH {PLANTED}, x AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN replace(text_content, 'e', chr(1)) ELSE text_content END AS t FROM planted)
    SELECT doc_id, length(t) >= 50 AND len(regexp_extract_all(substr(t, 1, 5000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) > 0.01 * length(substr(t, 1, 5000)) AS garbled,
      substr(t, 1, CAST(floor(100 * 4.2) AS INTEGER)) = t AS fits_100_tokens, CASE WHEN length(t) > 0 THEN CAST(ceil(length(t) / 420.0) AS BIGINT) ELSE 0 END AS pieces_of_100_tokens,
      CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS clamped FROM x""",
)
def text_marks(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.replace("text_content", F.lit("e"), F.lit("\x01"))).otherwise(F.col("text_content")))
    t = F.col("t")
    return d.select(
        "doc_id", T.is_garbled(t).alias("garbled"), (T.truncate_to_tokens(t, 100) == t).alias("fits_100_tokens"), F.size(T.chunk_by_tokens(t, 100)).cast("long").alias("pieces_of_100_tokens"),
        T.clamp(t, 120, True).alias("clamped"),
    )


@query(
    "ratio_functions",
    """SELECT doc_id, round(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 OR b = 0 THEN 0 ELSE least(a, b) / CAST(greatest(a, b) AS DOUBLE) END, 6) AS ratio, floor(a / 7.0::DOUBLE * 1000 + 0.5) / 1000 AS rounded
    FROM (SELECT doc_id, doc_id % 7 AS a, doc_id % 5 AS b FROM documents)""",
)
def ratio_functions(spark, sf_dir):
    d = planted(spark, sf_dir).select("doc_id", (F.col("doc_id") % 7).alias("a"), (F.col("doc_id") % 5).alias("b"))
    return d.select("doc_id", F.round(T.safe_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), T.round3(F.col("a") / 7).alias("rounded"))
