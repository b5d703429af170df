"""Chunk quality: rules per chunk, similarities of vectors, and their summaries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions import text as T
from docloom.operators import graph, selection

#: Requirement families, unit families and part numbers.
REQUIREMENT = {
    "german_modal": (r"\b(soll|muss|darf\s+nicht|hat\s+sicherzustellen|muss\s+gewährleistet)\b", "i"),
    "rfc2119": (r"\b(MUST|SHALL|SHOULD|MAY|REQUIRED|RECOMMENDED)\b", ""),
    "legal": (r"\b(shall\s+not|is\s+obligated\s+to|warrants\s+that)\b", "i"),
    "french_modal": (r"\b(doit|devrait|peut)\b", "i"),
}
UNITS = {
    "mechanical": r"[\d,]+\s*(mm|cm|m|kg|g|°C|%|bar|N|kN|MPa|rpm|μm|±|∅)",
    "electrical": r"[\d,]+\s*(V|A|W|kWh|Ω|Hz|kV|mA)",
    "pharma": r"[\d,]+\s*(mg|mL|μg|ppm|mol\/L|ng|μL)",
    "financial": r"[\d,]+\s*(€|\$|£|%|bps|bp)",
    "logistics": r"[\d,]+\s*(pcs|TEU|kg\/m³|pallets|units)",
    "mixed": r"[\d,]+\s*[a-zA-Z°μ%€$£Ω±∅]{1,6}",
}
PART_NUMBER = r"\b([A-Z]{2,}-?\d{3,}|KB[-_]?\d{3,}|FIKB[-\s]?\d{3,})\b"
#: What every part number holds, and letters one of which every form of a requirement holds: told without look-around.
PART_HINT = "[A-Z][^A-Za-z0-9]?[0-9]{3}"
#: The long s is an s in any case, whatever lower case makes of it.
REQUIREMENT_HINTS = {"german_modal": ("soll", "muss", "darf", "erzu", "\u017f")}
REFERENCE = (r"\b(siehe|vgl\.|wie\s+oben|s\.o\.|s\.u\.|dort|dieser|diese|dieses|see\s+above|see\s+below|aforementioned)\b", "i")
ANTECEDENT = (r"\b(abschnitt|kapitel|section|chapter)\s+\d", "i")


def size_fit(content: Column, spaced: Column | None = None) -> Column:
    """1 for 200 to 550 tokens, down to 0.2 below 50 and above 900; ``spaced`` is the content with plain blanks, if it is known."""
    return T.bind(
        T.tokens(content, spaced),
        lambda t: F.when(t.between(200, 550), 1.0)
        .when((t < 50) | (t > 900), 0.2)
        .when(t < 200, F.lit(0.2).cast("double") + (t - 50) / 150 * F.lit(0.8).cast("double"))
        .otherwise(F.lit(1.0).cast("double") - (t - 550) / 350 * F.lit(0.8).cast("double")),
    )


def boundary_quality(content: Column, kind: Column) -> Column:
    """1, 0.5 or 0 by a capital at the start and a stop at the end; null for tables and blanks."""
    t = rx.trim(content)
    starts, ends = rx.test(t, r"^[A-ZÄÖÜ]"), rx.test(t, r"[.!?:;]$")
    return F.when((kind != "table_row") & (t != ""), (starts.cast("int") + ends.cast("int")) / 2)


def table_cut(content: Column, kind: Column, extension: Column) -> Column:
    """0 if the first or last row's columns differ by over 40 % from the median, else 1."""
    rows = F.filter(F.split(content, "\n"), lambda r: rx.trim(r) != "")
    separators = lambda r: F.greatest(F.regexp_count(r, F.lit("\t")), F.regexp_count(r, F.lit(r"\|")))

    def verdict(c: Column) -> Column:
        median = F.get(F.array_sort(c), F.floor(F.size(c) / 2).cast("int"))
        off = lambda x: F.abs(x - median) > median * F.lit(0.4).cast("double")
        cut = off(F.get(c, F.lit(0))) | off(F.element_at(c, -1))
        return F.when((F.size(c) >= 2) & (median > 0), F.when(cut, 0.0).otherwise(1.0))

    return F.when((kind == "table_row") & (extension != ".pdf"), T.bind(F.transform(rows, separators), verdict))


def cross_reference_cut(content: Column) -> Column:
    """0 if the first 80 characters refer to something that they don't name before, else 1."""
    head = F.substring(content, 1, 80)
    before = F.substring(content, F.lit(1), F.regexp_instr(head, F.lit(rx.java(*REFERENCE))) - 1)
    return F.when(rx.test(head, *REFERENCE) & ~rx.test(before, *ANTECEDENT), 0.0).otherwise(1.0)


def header_pollution(content: Column) -> Column:
    """1 up to a fifth of header lines, 0 from three fifths on."""
    lines = F.filter(F.transform(F.split(content, "\n"), rx.trim), lambda x: x != "")

    def score(ls: Column) -> Column:
        share = F.size(F.filter(ls, lambda x: T.classify_block(x, 4) == "header")) / F.size(ls)
        falls = F.lit(1.0).cast("double") - (share - F.lit(0.2).cast("double")) / F.lit(0.4).cast("double")
        return F.when(F.size(ls) == 0, 1.0).when(share <= 0.2, 1.0).when(share >= 0.6, 0.0).otherwise(falls)

    return T.bind(lines, score)


def density(text: Column, spaced: Column | None = None) -> Column:
    words = F.filter(F.split(F.lower(rx.spaced(text) if spaced is None else spaced), " +"), lambda w: F.length(w) > 2)
    return T.bind(
        words,
        lambda w: F.when(F.size(w) == 0, 0.0).otherwise(
            F.least(F.lit(1.0), F.size(F.array_distinct(w)) / F.size(w) / F.lit(0.7).cast("double")) * F.least(F.lit(1.0), F.size(w) / 30)
        ),
    )


def _required(text: Column, family: str) -> Column:
    """Whether a form of requirement occurs; texts without its letters are not searched."""
    hints = [F.contains(F.lower(text), F.lit(h)) for h in REQUIREMENT_HINTS.get(family, ())]
    found = rx.test(text, *REQUIREMENT[family])
    return reduce(or_, hints) & found if hints else found


def coherence(text: Column, family: str | None, spaced: Column | None = None) -> Column:
    parts = F.filter(F.split(rx.spaced(text) if spaced is None else spaced, r"[.!?]+"), lambda s: F.length(F.trim(s)) > 5)
    words = lambda s: F.regexp_count(s, F.lit(" +")) + 1
    # null without parts
    mean = T.bind(parts, lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0), lambda a, x: a + words(x)) / F.size(s)))
    bonus = F.when(_required(text, family), F.lit(0.15)).otherwise(0.0) if family in REQUIREMENT else F.lit(0.0)

    def score(m: Column) -> Column:
        by_length = F.when(m < 4, 0.2).when(m > 50, 0.4).otherwise(F.least(F.lit(1.0), m / 15))
        return F.when(m.isNull(), 0.3).otherwise(F.least(F.lit(1.0), by_length + bonus.cast("double")))

    return T.bind(mean, score)


def specificity(text: Column, units: str | None, spaced: Column | None = None) -> Column:
    hits = rx.count(text, UNITS[units], "i") if units in UNITS else F.lit(0)
    total = F.length(F.replace(rx.spaced(text) if spaced is None else spaced, F.lit(" "), F.lit("")))
    digits = F.when(total > 0, F.least(F.lit(0.2).cast("double"), F.regexp_count(text, F.lit("[0-9]")) / total * 2)).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        F.least(F.lit(0.4).cast("double"), hits * F.lit(0.1).cast("double"))
        + F.when(F.regexp_like(text, F.lit(PART_HINT)) & rx.test(text, PART_NUMBER), F.lit(0.2).cast("double")).otherwise(0.0)
        + digits
        + F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("|")), F.lit(0.1).cast("double")).otherwise(0.0),
    )


def content_score(text: Column, kind: Column, family: str | None = None, units: str | None = None, spaced: Column | None = None) -> Column:
    d = lambda x: F.lit(x).cast("double")
    score = F.least(F.lit(1.0), d(0.4) * density(text, spaced) + d(0.3) * coherence(text, family, spaced) + d(0.3) * specificity(text, units, spaced))
    return F.when(kind == "boilerplate", 0.1).when(kind == "header", F.least(score, d(0.35))).otherwise(T.round3(score))


RULES = ("size_fit", "boundary_quality", "cross_reference_cut", "table_cut", "header_pollution", "content_score")


def rules(chunks: DataFrame, family: str | None = None, units: str | None = None) -> DataFrame:
    """``chunks`` with the six rule metrics and their mean over the non-null ones (rule_mean)."""
    c, k, spaced = F.col("content"), F.col("chunk_type"), F.col("_spaced")
    chunks = T.once(chunks, "_spaced", rx.spaced(c))
    scores = {
        "size_fit": size_fit(c, spaced),
        "boundary_quality": boundary_quality(c, k),
        "cross_reference_cut": cross_reference_cut(c),
        "table_cut": table_cut(c, k, F.col("extension")),
        "header_pollution": header_pollution(c),
        "content_score": content_score(c, k, family, units, spaced),
    }
    # once: the metrics are read by their mean, by averages and by percentiles
    scored = T.once(chunks, "_m", F.struct(*[x.alias(m) for m, x in scores.items()])).withColumns({m: F.col(f"_m.{m}") for m in RULES}).drop("_m", "_spaced")
    values = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in RULES), F.lit(0.0))
    present = sum((F.col(m).isNotNull().cast("int") for m in RULES), F.lit(0))
    return scored.withColumn("rule_mean", values / present)


def p10(values: Column) -> Column:
    """The value at floor(n / 10) of the sorted ones (aggregate); nulls are left out."""
    v = F.array_sort(F.collect_list(values))
    return F.coalesce(F.get(v, F.floor(F.size(v) * 0.1).cast("int")), F.lit(0.0))


def bucket(index: Column) -> Column:
    return F.when(index >= 0.7, "good").when(index >= 0.4, "acceptable").otherwise("poor")


def composite(scored: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Chunk index: the rule mean, or half of it and half of the document's vector mean.

    ``vectors(doc_id, vector_mean)``; only rows with ``sampled`` use it.
    """
    if vectors is None:
        return scored.withColumn("chunk_index_value", F.col("rule_mean"))
    joined = scored.join(vectors, "doc_id", "left")
    sampled = F.col("sampled") if "sampled" in scored.columns else F.lit(True)
    mixed = F.when(sampled & F.col("vector_mean").isNotNull(), 0.5 * F.col("rule_mean") + 0.5 * F.col("vector_mean"))
    return joined.withColumn("chunk_index_value", F.coalesce(mixed, F.col("rule_mean")))


def per_document(scored: DataFrame) -> DataFrame:
    """Means of the metrics, index mean and p10, buckets and the weakest metric by document."""
    index = F.col("chunk_index_value")
    out = scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        *[F.avg(m).alias(m) for m in RULES],
        F.avg(index).alias("index_mean"),
        p10(index).alias("index_p10"),
        *[F.count_if(bucket(index) == b).alias(b) for b in ("good", "acceptable", "poor")],
    )
    order = ("size_fit", "boundary_quality", "cross_reference_cut", "header_pollution", "content_score", "table_cut")
    # a metric without a value counts as 0, but for table_cut, which is left out
    links = F.array(
        *[
            F.when(F.lit(m != "table_cut") | F.col(m).isNotNull(), F.struct(F.coalesce(F.col(m), F.lit(0.0)).alias("mean"), F.lit(k).alias("k"), F.lit(m).alias("metric")))
            for k, m in enumerate(order)
        ]
    )
    weakest = F.slice(F.array_sort(F.filter(links, lambda x: x.isNotNull())), 1, 3)
    return out.withColumn("weakest", F.transform(weakest, lambda x: F.format_string("%s: %.2f", x["metric"], x["mean"])))


def corpus_summary(documents: DataFrame) -> DataFrame:
    """One row: chunks, bucket shares and the chunk-weighted index."""
    total = F.sum("chunks")
    share = lambda b: F.coalesce(F.try_divide(F.sum(b), total), F.lit(0.0))
    return documents.agg(
        F.coalesce(total, F.lit(0)).alias("chunks"),
        *[share(b).alias(f"share_{b}") for b in ("good", "acceptable", "poor")],
        F.coalesce(F.try_divide(F.sum(F.col("index_mean") * F.col("chunks")), total), F.lit(0.0)).alias("index_mean"),
    )


def worst_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    return documents.orderBy("index_p10", "doc_id").limit(n).select("doc_id", "index_p10", F.get("weakest", F.lit(0)).alias("weakness"))


def weakest_metrics(documents: DataFrame, n: int = 3) -> DataFrame:
    """Metrics of the lowest mean of document means."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in RULES])).alias("x")
    means = documents.select(pairs).where("x.v IS NOT NULL").groupBy("x.metric").agg(F.avg("x.v").alias("mean"))
    return means.orderBy("mean", "metric").limit(n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without a norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def cosine_unit(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def normalize_vector(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return T.bind(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>")))


def norm_check(vectors: DataFrame, v: str = "embedding") -> DataFrame:
    """One row: vectors, whether all norms are within 0.001 of 1, the largest deviation."""
    off = F.abs(F.sqrt(dot(F.col(v), F.col(v))) - 1)
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.bool_and(off < 0.001).alias("all_unit"), F.max(off).alias("max_deviation"))


def coherence_drop(vectors: DataFrame, group: str, order: str, v: str = "embedding") -> DataFrame:
    """Similarity of adjacent vectors of a group: 1 - mean drop, and the tenth percentile.

    A group may hold all rows: neighbours and the percentile are found without it in one task.
    """
    near = selection.previous(vectors.select(group, order, v), [group], [order], v)
    drops = graph.checkpoint(near.where(F.col("previous").isNotNull()).select(group, (1 - cosine_unit(F.col(v), F.col("previous"))).alias("drop")))
    tenth = selection.nth(drops, [group], "drop", F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1))
    means = drops.groupBy(group).agg(F.avg("drop").alias("_mean"))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    found = selection.by_group(means, tenth, [group], tenth.count())
    return found.select(group, clamp(1 - F.col("_mean")).alias("mean"), clamp(1 - F.col("nth")).alias("p10"))


def centroids(vectors: DataFrame, group: str, v: str = "embedding") -> DataFrame:
    """(group, centroid): the mean vector at length 1, folded by component."""
    parts = vectors.select(group, F.posexplode(v).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    return whole.select(group, normalize_vector(F.transform("c", lambda e: e["x"])).alias("centroid"))


def centroid_distance(vectors: DataFrame, group: str, v: str = "embedding") -> DataFrame:
    """Mean and p10 of ``1 - min(1, |z| / 3)`` of the distances to the group's centroid."""
    centre = graph.checkpoint(centroids(vectors, group, v))
    n = centre.count()
    far = selection.by_group(vectors.select(group, v), centre, [group], n)
    far = graph.checkpoint(far.select(group, (1 - cosine_unit(F.col(v), F.col("centroid"))).alias("d")))
    spread = graph.checkpoint(far.groupBy(group).agg(F.avg("d").alias("_mean"), F.nullif(F.stddev_samp("d"), F.lit(0.0)).alias("_dev")))
    z = F.abs(F.col("d") - F.col("_mean")) / F.col("_dev")
    scored = selection.by_group(far, spread, [group], n).select(group, F.coalesce(1 - F.least(F.lit(1.0), z / 3), F.lit(1.0)).alias("s"))
    tenth = selection.nth(scored, [group], "s", F.floor(F.col("n") * 0.1))
    return selection.by_group(scored.groupBy(group).agg(F.avg("s").alias("mean")), tenth, [group], n).select(group, "mean", F.col("nth").alias("p10"))


def halves(content: Column) -> Column:
    """Struct(left, right): cut at the middle, moved right to a blank within 29 characters."""
    mid = F.floor(F.length(content) / 2).cast("int")
    after = F.substring(content, mid + 1, F.lit(30))
    skip = F.regexp_instr(after, F.lit(r"\s"))
    at = mid + F.when(skip > 0, skip - 1).otherwise(0)
    return F.struct(F.substring(content, F.lit(1), at).alias("left"), F.substring(content, at + 1, F.length(content)).alias("right"))


def intra_chunk_cohesion(chunks: DataFrame, embed, min_tokens: int = 100) -> DataFrame:
    """Cosine of the two halves of chunks of ``min_tokens`` or more, by document.

    ``embed(Column) -> Column`` is a pluggable vector function.
    """
    cut = chunks.where(T.tokens(F.col("content")) >= min_tokens).withColumn("_h", halves(F.col("content")))
    scored = cut.select("doc_id", cosine_unit(embed(F.col("_h.left")), embed(F.col("_h.right"))).alias("s"))
    return scored.groupBy("doc_id").agg(F.avg("s").alias("mean"), p10(F.col("s")).alias("p10"), F.count(F.lit(1)).alias("measurable"))


def embed_once(texts: DataFrame, embed, column: str = "content") -> DataFrame:
    """``texts`` with a vector, each distinct text embedded once (joined back by its hash)."""
    keyed = texts.withColumn("_sha", F.sha2(column, 256))
    distinct = keyed.select("_sha", column).dropDuplicates(["_sha"]).select("_sha", embed(F.col(column)).alias("embedding"))
    return keyed.join(distinct, "_sha").drop("_sha")
