"""Queries over texts of documents: tokens, lines, blocks, cleaning, chunks and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions import text as T
from docloom.operators import boilerplate, chunking, projection, quality

from . import views as V
from .views import doc_view, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query(
    "boilerplate_discovery",
    f"""WITH l AS (SELECT doc_id, pos, {V.sql_trim('line')} AS raw FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE length(text) > 100)),
    f AS (SELECT *, {V.sql_trim("regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\s+', ' ', 'g'), '\\b\\d{1,2}[.\\s]\\d{1,2}[.\\s]\\d{2,4}\\b', 'DATE', 'g'), '\\b\\d+\\b', 'N', 'g')")} AS form FROM l),
    g AS (SELECT form, count(*) AS occurrences, count(DISTINCT doc_id) AS documents, arg_min(raw, (doc_id, pos)) AS raw FROM f
      WHERE length(form) BETWEEN 4 AND 120 GROUP BY form HAVING count(DISTINCT doc_id) >= 3)
    SELECT substr(form, 1, 60) AS form, occurrences, documents,
      '^' || regexp_replace(regexp_replace(form, '[.*+?^${{}}()|\\[\\]\\\\]', '\\\\\\0', 'g'), '\\bN\\b', '\\\\d+', 'g') || '$' AS regex,
      {V.sql_boilerplate('form')} AS covered, {V.sql_tokens('raw')} * occurrences AS tokens_at_risk
    FROM g WHERE len(list_filter(regexp_split_to_array(form, '\\s+'), lambda w: length(regexp_replace(w, '[^a-zäöüß]', '', 'gi')) > 4
      AND lower(regexp_replace(w, '[^a-zäöüß]', '', 'gi')) NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_WORDS)}))) = 0""",
)
def boilerplate_discovery(spark, sf_dir):
    return boilerplate.discover(doc_view(spark, sf_dir))


@query("boilerplate_by_risk", SQL["boilerplate_discovery"] + " ORDER BY tokens_at_risk DESC, form LIMIT 20")
def boilerplate_by_risk(spark, sf_dir):
    return boilerplate.ranked(doc_view(spark, sf_dir), 20)


@query(
    "boilerplate_summary",
    f"""WITH l AS (SELECT doc_id, pos, {V.sql_trim('line')} AS raw FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE length(text) > 100)),
    f AS (SELECT *, {V.sql_trim("regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\s+', ' ', 'g'), '\\b\\d{1,2}[.\\s]\\d{1,2}[.\\s]\\d{2,4}\\b', 'DATE', 'g'), '\\b\\d+\\b', 'N', 'g')")} AS form FROM l),
    g AS (SELECT form, count(*) AS occurrences, arg_min(raw, (doc_id, pos)) AS raw FROM f
      WHERE length(form) BETWEEN 4 AND 120 GROUP BY form HAVING count(DISTINCT doc_id) >= 3),
    h AS (SELECT *, {V.sql_boilerplate('form')} AS covered, {V.sql_tokens('raw')} * occurrences AS risk,
      len(list_filter(regexp_split_to_array(form, '\\s+'), lambda w: length(regexp_replace(w, '[^a-zäöüß]', '', 'gi')) > 4
      AND lower(regexp_replace(w, '[^a-zäöüß]', '', 'gi')) NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_WORDS)}))) = 0 AS safe FROM g)
    SELECT count(*) AS candidates, count(*) FILTER (WHERE safe AND NOT covered) AS new_patterns, count(*) FILTER (WHERE NOT safe) AS suppressed,
      CAST(coalesce(sum(risk) FILTER (WHERE safe AND NOT covered), 0) AS BIGINT) AS recoverable FROM h""",
)
def boilerplate_summary(spark, sf_dir):
    return boilerplate.summary(doc_view(spark, sf_dir))


@query("tokens_by_length", "SELECT doc_id, CAST(ceil(length(text) / CAST(4.2 AS DOUBLE)) AS BIGINT) AS tokens FROM documents")
def tokens_by_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / F.lit(4.2).cast("double")).cast("long").alias("tokens"))


@query("tokens_by_words", f"SELECT doc_id, {V.sql_tokens('text')} AS tokens FROM documents")
def tokens_by_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


_BLOCKS = f"""b AS (SELECT doc_id, {V.sql_trim('p')} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}|\\n')) AS p FROM documents)
  WHERE {V.sql_trim('p')} <> '')"""


def _line_blocks(spark, sf_dir):
    """Lines stand in for paragraphs, which these documents lack."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.split("text", "\n")).alias("t")).select("doc_id", rx.trim(F.col("t")).alias("t")).where("t <> ''")


@query("block_classes", f"WITH {_BLOCKS} SELECT {V.sql_block_class('t')} AS kind, count(*) AS blocks FROM b GROUP BY 1")
def block_classes(spark, sf_dir):
    return _line_blocks(spark, sf_dir).groupBy(T.classify_block(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("blocks"))


@query(
    "typed_tokens",
    f"""WITH {_BLOCKS}, k AS (SELECT doc_id, {V.sql_block_class('t')} AS kind, {V.sql_tokens('t')} AS n FROM b)
    SELECT doc_id, kind, CAST(sum(ceil(n * CASE kind WHEN 'boilerplate' THEN CAST(0.7 AS DOUBLE) WHEN 'header' THEN CAST(0.8 AS DOUBLE) ELSE 1 END)) AS BIGINT) AS tokens FROM k GROUP BY 1, 2""",
)
def typed_tokens(spark, sf_dir):
    b = _line_blocks(spark, sf_dir).select("doc_id", "t", T.classify_block(F.col("t")).alias("kind"))
    return b.groupBy("doc_id", "kind").agg(F.sum(T.typed_tokens(F.col("t"), F.col("kind"))).alias("tokens"))


@query(
    "chunk_filter_reasons",
    f"WITH {_BLOCKS} SELECT coalesce({V.sql_filter_reason('t')}, 'passed') AS reason, count(*) AS blocks FROM b GROUP BY 1",
)
def chunk_filter_reasons(spark, sf_dir):
    b = _line_blocks(spark, sf_dir)
    return b.groupBy(F.coalesce(T.filter_reason(F.col("t")), F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("blocks"))


_CLEAN = f"""n AS (SELECT doc_id, text, {V.sql_normalize('text')} AS norm FROM documents WHERE length(text) > 100),
  ln AS (SELECT doc_id, unnest(string_split(norm, chr(10))) AS line, generate_subscripts(string_split(norm, chr(10)), 1) AS pos FROM n),
  lt AS (SELECT *, {V.sql_trim('line')} AS t FROM ln),
  lc AS (SELECT doc_id, t, count(*) AS c FROM lt WHERE length(t) > 3 AND length(t) < 120 GROUP BY 1, 2),
  lm AS (SELECT lt.*, CASE WHEN {V.sql_boilerplate('lt.t')} THEN 'b' WHEN lc.c >= 3 THEN 'r' END AS cut, {V.sql_tokens('line')} AS tok
         FROM lt LEFT JOIN lc ON lt.doc_id = lc.doc_id AND lt.t = lc.t),
  cl AS (SELECT n.doc_id, {V.sql_tokens('text')} AS raw, {V.sql_tokens('norm')} AS norm_tokens, lb, lr, {V.sql_trim("regexp_replace(coalesce(kept, ''), '\\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned
         FROM n JOIN (SELECT doc_id, CAST(coalesce(sum(tok) FILTER (WHERE cut = 'b'), 0) AS BIGINT) AS lb, CAST(coalesce(sum(tok) FILTER (WHERE cut = 'r'), 0) AS BIGINT) AS lr,
               string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE cut IS NULL) AS kept FROM lm GROUP BY 1) USING (doc_id))"""


@query(
    "clean_loss",
    f"""WITH {_CLEAN} SELECT doc_id, raw, greatest(0, raw - norm_tokens) AS normalization, lb AS boilerplate, lr AS repeated, length(cleaned) AS cleaned_chars FROM cl""",
)
def clean_loss(spark, sf_dir):
    d = doc_view(spark, sf_dir).where("parse_success").withColumn("composed", T.nfkc(F.col("text_content")))
    d = d.select("doc_id", projection.clean(F.col("text_content"), F.col("composed")).alias("c"))
    return d.select("doc_id", "c.raw", "c.normalization", "c.boilerplate", "c.repeated", F.length("c.cleaned").alias("cleaned_chars"))


def _projected(spark, sf_dir):
    d = doc_view(spark, sf_dir).select(
        "doc_id", "text_content", "parse_success", F.lit("sliding_window").alias("strategy"), F.lit(0).alias("headings"), F.lit(0).alias("tables"), F.col("category").alias("doc_type")
    )
    return projection.project(d), d


_PROJECT = f"""{_CLEAN},
  bl AS (SELECT doc_id, t, {V.sql_block_class('t')} AS kind, {V.sql_filter_reason('t')} AS reason, {V.sql_tokens('t')} AS tok
         FROM (SELECT doc_id, {V.sql_trim('p')} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(cleaned, '\\n{{2,}}')) AS p FROM cl)) WHERE t <> ''),
  bs AS (SELECT doc_id, CAST(sum(ceil(tok * CASE kind WHEN 'boilerplate' THEN CAST(0.7 AS DOUBLE) WHEN 'header' THEN CAST(0.8 AS DOUBLE) ELSE 1 END)) AS BIGINT) AS after_chunking,
         CAST(coalesce(sum(tok) FILTER (WHERE reason IS NOT NULL), 0) AS BIGINT) AS lost, count(*) FILTER (WHERE reason IS NOT NULL) AS filtered_chunks FROM bl GROUP BY 1),
  pj AS (SELECT d.doc_id, category, parse_success, coalesce(raw, 0) AS raw, coalesce(greatest(0, raw - norm_tokens), 0) AS ln, coalesce(lb, 0) AS lb, coalesce(lr, 0) AS lr,
         coalesce(after_chunking, 0) AS after_chunking, coalesce(lost, 0) AS lost, coalesce(filtered_chunks, 0) AS filtered_chunks
         FROM doc_view d LEFT JOIN cl USING (doc_id) LEFT JOIN bs USING (doc_id)),
  pr AS (SELECT *, greatest(0, raw - ln) AS after_normalization, greatest(0, greatest(0, raw - ln) - lb - lr) AS after_cleaning, greatest(0, after_chunking - lost) AS after_filter FROM pj),
  px AS (SELECT *, CASE WHEN raw > 0 THEN CAST(after_filter AS DOUBLE) / raw ELSE 0 END AS retention,
         CASE WHEN parse_success THEN greatest(1, CAST(ceil(after_cleaning / CAST(448 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS predicted_chunks FROM pr)"""


_PROJECT_VIEW = f"{V.DOC_VIEW}, {_PROJECT}".replace("SELECT d.doc_id, category,", "SELECT d.doc_id, category, extension,")


@query(
    "token_waterfall",
    f"WITH {V.DOC_VIEW}, {_PROJECT} SELECT doc_id, raw, after_normalization, after_cleaning, after_chunking, after_filter, predicted_chunks, filtered_chunks, round(retention, 6) AS retention FROM px",
)
def token_waterfall(spark, sf_dir):
    p, _ = _projected(spark, sf_dir)
    return p.select(
        "doc_id", "raw", "after_normalization", "after_cleaning", "after_chunking", "after_filter", "predicted_chunks", "filtered_chunks", F.round("retention", 6).alias("retention")
    )


@query(
    "corpus_loss_waterfall",
    f"""WITH {V.DOC_VIEW}, {_PROJECT}, s AS (SELECT sum(raw) AS raw, sum(ln) AS s1, sum(lb + lr) AS s2, sum(greatest(0, after_cleaning - after_chunking)) AS s3, sum(lost) AS s4 FROM px)
    SELECT stage, CAST(lost AS BIGINT) AS lost, round(lost / raw * 100, 6) AS percent_of_raw FROM (
      SELECT 'normalization' AS stage, s1 AS lost, raw FROM s UNION ALL SELECT 'boilerplate + repeated lines', s2, raw FROM s
      UNION ALL SELECT 'chunking compression', s3, raw FROM s UNION ALL SELECT 'content filter', s4, raw FROM s)""",
)
def corpus_loss_waterfall(spark, sf_dir):
    p, _ = _projected(spark, sf_dir)
    return projection.loss_waterfall(p).withColumn("percent_of_raw", F.round("percent_of_raw", 6))


@query(
    "retention_by_type",
    f"""WITH {V.DOC_VIEW}, {_PROJECT} SELECT coalesce(category, 'other') AS doc_type, count(*) AS documents, round(avg(retention), 6) AS retention,
    round(avg(predicted_chunks), 6) AS avg_chunks, 'sliding_window' AS strategy FROM px WHERE parse_success GROUP BY 1""",
)
def retention_by_type(spark, sf_dir):
    p, d = _projected(spark, sf_dir)
    return projection.by_type(p, d).withColumns({"retention": F.round("retention", 6), "avg_chunks": F.round("avg_chunks", 6)})


@query(
    "high_risk_documents",
    f"""WITH {V.DOC_VIEW}, {_PROJECT} SELECT doc_id, round(retention, 6) AS retention,
    CASE WHEN lb + lr > ln AND lb + lr > lost THEN 'boilerplate' WHEN lost > ln THEN 'filter' ELSE 'normalization' END AS cause FROM px WHERE retention < 0.5 AND raw > 0""",
)
def high_risk_documents(spark, sf_dir):
    p, _ = _projected(spark, sf_dir)
    return projection.high_risk(p).withColumn("retention", F.round("retention", 6))


@query("exact_duplicates", "SELECT sha256(text) AS sha, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha"))
    return d.agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


_WINDOWS = """w0 AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 448)) AS k FROM documents),
  w1 AS (SELECT *, substr(text, k + 483, 30) AS tail FROM w0 WHERE k = 0 OR k - 448 + 512 < n),
  w2 AS (SELECT *, length(regexp_extract(tail, '(?s)^(.*[ \\n\\t])', 1)) AS cut FROM w1),
  w3 AS (SELECT doc_id, k, substr(text, k + 1, CASE WHEN k + 512 >= n THEN n - k WHEN substr(text, k + 513, 1) IN (' ', chr(10), chr(9)) OR cut = 0 THEN 512 ELSE 482 + cut END) AS content FROM w2),
  w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, content FROM w3 WHERE NOT regexp_matches(content, '^\\s*$'))"""


def _windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sliding_windows(F.col("text"))).alias("chunk_index", "w"))
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("w.content").alias("content"))


@query("sliding_chunks", f"WITH {_WINDOWS} SELECT doc_id, chunk_index, length(content) AS chars, md5(content) AS digest FROM w")
def sliding_chunks(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "chunk_index", F.length("content").alias("chars"), F.md5("content").alias("digest"))


_SENTENCES = """sp AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{2,}')) AS p FROM documents),
  ss AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM sp)"""


@query("sentence_counts", f"WITH {_SENTENCES} SELECT doc_id, count(*) AS sentences FROM ss WHERE regexp_matches(s, '\\S') GROUP BY 1")
def sentence_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.sentences(F.col("text"))).cast("long").alias("sentences"))
    return d.where("sentences > 0")


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    d = doc_view(spark, sf_dir).select("doc_id", F.lit(".pdf").alias("extension"), F.col("text_content").alias("text"))
    return chunking.chunk(d).select("doc_id", "chunk_index", "content", "chunk_type")


@query("mixed_chunks")
def mixed_chunks(spark, sf_dir):
    d = doc_view(spark, sf_dir).select("doc_id", "extension", F.col("text_content").alias("text"))
    return chunking.chunk(d)


_SCORED = f"""{_WINDOWS},
  c AS (SELECT doc_id, chunk_index, content, {V.sql_trim('content')} AS t FROM w),
  k AS (SELECT *, {V.sql_block_class('t', 4)} AS chunk_type, {V.sql_tokens('content')} AS tok FROM c),
  hl AS (SELECT doc_id, chunk_index, count(*) AS lines, count(*) FILTER (WHERE kind = 'header') AS headers FROM (
    SELECT doc_id, chunk_index, {V.sql_block_class('l', 4)} AS kind FROM (SELECT doc_id, chunk_index, {V.sql_trim('x')} AS l FROM (
      SELECT doc_id, chunk_index, unnest(string_split(content, chr(10))) AS x FROM c)) WHERE l <> '') GROUP BY 1, 2),
  q AS (SELECT k.doc_id, k.chunk_index, content, chunk_type, tok,
    CASE WHEN tok BETWEEN 200 AND 550 THEN 1.0 WHEN tok < 50 OR tok > 900 THEN 0.2 WHEN tok < 200 THEN CAST(0.2 AS DOUBLE) + (tok - 50) / CAST(150 AS DOUBLE) * CAST(0.8 AS DOUBLE)
      ELSE 1 - (tok - 550) / CAST(350 AS DOUBLE) * CAST(0.8 AS DOUBLE) END AS size_fit,
    CASE WHEN chunk_type <> 'table_row' AND t <> '' THEN (CAST(regexp_matches(t, '^[A-ZÄÖÜ]') AS INTEGER) + CAST(regexp_matches(t, '[.!?:;]$') AS INTEGER)) / 2 END AS boundary_quality,
    CASE WHEN lines IS NULL OR headers / CAST(lines AS DOUBLE) <= 0.2 THEN 1 WHEN headers / CAST(lines AS DOUBLE) >= 0.6 THEN 0 ELSE 1 - (headers / CAST(lines AS DOUBLE) - 0.2) / 0.4 END AS header_pollution,
    CASE WHEN regexp_matches(substr(content, 1, 80), {rx.re2(*quality.REFERENCE)}) AND NOT regexp_matches(split_part(content, regexp_extract(substr(content, 1, 80), {rx.re2(*quality.REFERENCE)}), 1), {rx.re2(*quality.ANTECEDENT)}) THEN 0 ELSE 1 END AS cross_reference_cut
    FROM k LEFT JOIN hl USING (doc_id, chunk_index))"""


def _scored(spark, sf_dir):
    chunks = T.once(_windows(spark, sf_dir), "chunk_type", T.classify_block(F.col("content"), 4)).withColumn("extension", F.lit(".pdf"))
    return quality.rules(chunks, "german_modal", "mechanical")


@query(
    "chunk_rules",
    f"WITH {_SCORED} SELECT doc_id, chunk_index, chunk_type, round(size_fit, 6) AS size_fit, CAST(boundary_quality AS DOUBLE) AS boundary_quality, round(CAST(header_pollution AS DOUBLE), 6) AS header_pollution, CAST(cross_reference_cut AS DOUBLE) AS cross_reference_cut FROM q",
)
def chunk_rules(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "doc_id",
        "chunk_index",
        "chunk_type",
        F.round("size_fit", 6).alias("size_fit"),
        "boundary_quality",
        F.round("header_pollution", 6).alias("header_pollution"),
        "cross_reference_cut",
    )


_CONTENT = f"""{_SCORED},
  dn AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) > 2) AS dw,
    list_filter(regexp_split_to_array(content, '[.!?]+'), lambda x: length({V.sql_trim('x')}) > 5) AS sn, length(regexp_replace(content, '\\s', '', 'g')) AS tot FROM q),
  sc AS (SELECT *, CASE WHEN len(dw) = 0 THEN 0 ELSE least(1, len(list_distinct(dw)) / CAST(len(dw) AS DOUBLE) / CAST(0.7 AS DOUBLE)) * least(1, len(dw) / CAST(30 AS DOUBLE)) END AS density,
    list_sum([len(regexp_split_to_array(x, '\\s+')) for x in sn]) / CAST(len(sn) AS DOUBLE) AS avg_words,
    CASE WHEN regexp_matches(content, {rx.re2(*quality.REQUIREMENT['german_modal'])}) THEN CAST(0.15 AS DOUBLE) ELSE 0 END AS bonus,
    least(1, least(CAST(0.4 AS DOUBLE), len(regexp_extract_all(content, {rx.re2(quality.UNITS['mechanical'], 'i')})) * CAST(0.1 AS DOUBLE))
      + CASE WHEN regexp_matches(content, {rx.re2(quality.PART_NUMBER)}) THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      + CASE WHEN tot > 0 THEN least(CAST(0.2 AS DOUBLE), len(regexp_extract_all(content, '[0-9]')) / CAST(tot AS DOUBLE) * 2) ELSE 0 END
      + CASE WHEN contains(content, chr(9)) OR contains(content, '|') THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS specificity FROM dn),
  sd AS (SELECT *, least(1, CAST(0.4 AS DOUBLE) * density + CAST(0.3 AS DOUBLE) * CASE WHEN len(sn) = 0 THEN CAST(0.3 AS DOUBLE) ELSE least(1, CASE WHEN avg_words < 4 THEN CAST(0.2 AS DOUBLE) WHEN avg_words > 50 THEN CAST(0.4 AS DOUBLE) ELSE least(1, avg_words / 15) END + bonus) END
    + CAST(0.3 AS DOUBLE) * specificity) AS score FROM sc),
  cs AS (SELECT *, CASE WHEN chunk_type = 'boilerplate' THEN CAST(0.1 AS DOUBLE) WHEN chunk_type = 'header' THEN least(score, CAST(0.35 AS DOUBLE)) ELSE floor(score * 1000 + 0.5) / 1000 END AS content_score FROM sd),
  ix AS (SELECT *, (size_fit + cross_reference_cut + header_pollution + content_score + coalesce(boundary_quality, 0)) / (4 + CASE WHEN boundary_quality IS NULL THEN 0 ELSE 1 END) AS v FROM cs)"""


@query("content_score", f"WITH {_CONTENT} SELECT doc_id, chunk_index, round(content_score, 3) AS content_score FROM cs")
def content_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "chunk_index", F.round("content_score", 3).alias("content_score"))


@query(
    "chunk_index_by_document",
    f"""WITH {_CONTENT} SELECT doc_id, count(*) AS chunks, round(avg(v), 6) AS index_mean, round(list_sort(list(v))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1], 6) AS index_p10,
    count(*) FILTER (WHERE v >= 0.7) AS good, count(*) FILTER (WHERE v >= 0.4 AND v < 0.7) AS acceptable, count(*) FILTER (WHERE v < 0.4) AS poor FROM ix GROUP BY 1""",
)
def chunk_index_by_document(spark, sf_dir):
    per = quality.per_document(quality.composite(_scored(spark, sf_dir)))
    return per.select("doc_id", "chunks", F.round("index_mean", 6).alias("index_mean"), F.round("index_p10", 6).alias("index_p10"), "good", "acceptable", "poor")


@query(
    "chunk_quality_summary",
    f"""WITH {_CONTENT} SELECT count(*) AS chunks, round(count(*) FILTER (WHERE v >= 0.7) / CAST(count(*) AS DOUBLE), 6) AS share_good,
    round(count(*) FILTER (WHERE v >= 0.4 AND v < 0.7) / CAST(count(*) AS DOUBLE), 6) AS share_acceptable, round(count(*) FILTER (WHERE v < 0.4) / CAST(count(*) AS DOUBLE), 6) AS share_poor, round(avg(v), 6) AS index_mean FROM ix""",
)
def chunk_quality_summary(spark, sf_dir):
    s = quality.corpus_summary(quality.per_document(quality.composite(_scored(spark, sf_dir))))
    return s.select("chunks", *[F.round(c, 6).alias(c) for c in ("share_good", "share_acceptable", "share_poor", "index_mean")])


@query(
    "worst_documents",
    f"""WITH {_CONTENT} SELECT doc_id, round(list_sort(list(v))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1], 6) AS index_p10 FROM ix GROUP BY 1
    ORDER BY list_sort(list(v))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1], doc_id LIMIT 5""",
)
def worst_documents(spark, sf_dir):
    per = quality.per_document(quality.composite(_scored(spark, sf_dir)))
    return quality.worst_documents(per).select("doc_id", F.round("index_p10", 6).alias("index_p10"))


@query(
    "weakest_metrics",
    f"""WITH {_CONTENT}, d AS (SELECT doc_id, avg(size_fit) AS size_fit, avg(boundary_quality) AS boundary_quality, avg(cross_reference_cut) AS cross_reference_cut, avg(header_pollution) AS header_pollution, avg(content_score) AS content_score FROM ix GROUP BY 1)
    SELECT metric, round(avg(v), 5) AS mean FROM (UNPIVOT (SELECT * EXCLUDE (doc_id) FROM (SELECT doc_id, size_fit::DOUBLE AS size_fit, boundary_quality::DOUBLE AS boundary_quality, cross_reference_cut::DOUBLE AS cross_reference_cut, header_pollution::DOUBLE AS header_pollution, content_score::DOUBLE AS content_score FROM d))
      ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY 1 ORDER BY avg(v), metric LIMIT 3""",
)
def weakest_metrics(spark, sf_dir):
    return quality.weakest_metrics(quality.per_document(quality.composite(_scored(spark, sf_dir)))).withColumn("mean", F.round("mean", 5))


@query(
    "even_sample_chunks",
    f"""WITH {_WINDOWS}, n AS (SELECT doc_id, count(*) AS n, least(count(*), 30) AS t FROM w GROUP BY 1), s AS (SELECT sum(t) AS total FROM n),
    m AS (SELECT doc_id, n, CASE WHEN total > 2000 THEN greatest(1, CAST(floor(t * (CAST(2000 AS DOUBLE) / total)) AS BIGINT)) ELSE t END AS t FROM n, s),
    i AS (SELECT doc_id, unnest(range(0, t)) AS i, n, t FROM m)
    SELECT DISTINCT doc_id, CAST(CASE WHEN n <= t THEN i ELSE floor(i * n / CAST(t AS DOUBLE)) END AS BIGINT) AS chunk_index FROM i""",
)
def even_sample_chunks(spark, sf_dir):
    return chunking.even_sample(_windows(spark, sf_dir), "fast").select("doc_id", "chunk_index")


@query(
    "cosine_neighbours_by_label",
    """WITH e AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    d AS (SELECT label, 1 - greatest(-1, least(1, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[])))) AS d FROM e WHERE p IS NOT NULL)
    SELECT label, round(greatest(0, least(1, 1 - avg(d))), 6) AS mean, round(greatest(0, least(1, 1 - list_sort(list(d))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1])), 6) AS p10 FROM d GROUP BY 1""",
)
def cosine_neighbours_by_label(spark, sf_dir):
    out = quality.coherence_drop(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return out.select("label", F.round("mean", 6).alias("mean"), F.round("p10", 6).alias("p10"))


@query(
    "centroid_distance_by_label",
    """WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2),
    c AS (SELECT label, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM x GROUP BY 1),
    d AS (SELECT e.label, 1 - greatest(-1, least(1, list_dot_product(CAST(embedding AS DOUBLE[]), c) / n)) AS d FROM embeddings e JOIN c USING (label)),
    z AS (SELECT label, coalesce(1 - least(1, abs(d - avg(d) OVER (PARTITION BY label)) / nullif(stddev_samp(d) OVER (PARTITION BY label), 0) / 3), 1) AS s FROM d)
    SELECT label, round(avg(s), 5) AS mean, round(list_sort(list(s))[CAST(floor(0.1 * count(*)) AS BIGINT) + 1], 5) AS p10 FROM z GROUP BY 1""",
)
def centroid_distance_by_label(spark, sf_dir):
    out = quality.centroid_distance(table(spark, sf_dir, "embeddings"), "label")
    return out.select("label", F.round("mean", 5).alias("mean"), F.round("p10", 5).alias("p10"))


@query(
    "vector_norm_check",
    """WITH n AS (SELECT abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) AS d FROM embeddings)
    SELECT count(*) AS vectors, bool_and(d < 0.001) AS all_unit, round(max(d), 9) AS max_deviation FROM n""",
)
def vector_norm_check(spark, sf_dir):
    return quality.norm_check(table(spark, sf_dir, "embeddings")).withColumn("max_deviation", F.round("max_deviation", 9))
