"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Every text is scanned for *base* kinds (assign, access, hex), whose spans always
count, and for *candidate* kinds (provider keys, signed tokens, private keys, mixed
runs).  The value of every span is hashed with SHA-256; the hashes, never the values,
are aggregated over the corpus by distinct repository and distinct owner.  A value
that many owners and repositories hold is a copied example, and so is one in very many
repositories of a single owner; a value that stays with its owner and looks random is a
live credential, and so is a random value of a key kind (provider, jwt, pem) that is not
copied.  Candidate spans of live values join the base spans.

Positions come from Spark itself: ``split`` gives the pieces between the matches of
a pattern and ``regexp_extract_all`` the matches, so running sums of their lengths
are the spans, in code points.

Defined results: a null text is empty; one result row per input row, repeated rows
included; a null owner or repository is an owner or repository of its own; a very long
text takes time in proportion to its length and matches; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, prefixes

#: The base kinds in their order, (kind, pattern, group of the value, least characters of it).
BASE_KINDS = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # the two below need no group: a run that is too short never holds a longer one
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Candidate kinds: their spans count only where the corpus says that the value is live.
CANDIDATE_KINDS = (
    (
        "provider",
        r"(?:gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})",
        0,
        14,
    ),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\r\n ]{16,}", 0, 40),
    ("mixed", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{24,}", 0, 24),
)
KINDS = BASE_KINDS + CANDIDATE_KINDS
#: Candidate kinds whose form alone says that a random value is a key.
KEY_KINDS = ("provider", "jwt", "pem")
#: Values held by one owner are owner-specific; by so many owners and repositories, copied;
#: in so many repositories, copied even where one owner holds them all.
MAX_LIVE_OWNERS = 1
MIN_COPIED = 3
WIDELY_COPIED = 25
#: A live value has so many distinct characters.
MIN_DISTINCT_CHARS = 10

COUNTS = ("n_live", "n_copied", "n_owners", "n_repos")
_SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,base:boolean,hash:string,random:boolean>>"


def _spans_of(text: Column, kind_no: int) -> Column:
    """Spans of one kind: leftmost matches that don't overlap, the failing ones dropped."""
    kind, pattern, group, least = KINDS[kind_no]
    rx = F.lit(pattern)
    none = F.array().cast(_SPAN)

    def starts_of(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))

        def of(x: Column) -> Column:
            before = prefixes(F.transform(x, lambda e: e["gap"] + e["len"]), F.lit(0).cast("long"), lambda a, n: a + n)
            return F.zip_with(before, x, lambda p, e: p + e["gap"])

        return let(sizes, of)

    def spans(matches: Column, starts: Column, values: Column) -> Column:
        every = F.transform(
            matches,
            lambda x, i: F.struct(
                starts.getItem(i).alias("start"),
                F.lit(kind_no).alias("kind_no"),
                F.lit(kind).alias("kind"),
                (starts.getItem(i) + F.length(x)).alias("end"),
                F.lit(kind_no < len(BASE_KINDS)).alias("base"),
                F.when(F.length(values.getItem(i)) >= least, F.sha2(values.getItem(i), 256)).alias("hash"),
                (F.size(F.array_distinct(F.split(values.getItem(i), ""))) >= MIN_DISTINCT_CHARS).alias("random"),
            ),
        )
        return F.filter(every, lambda x: x["hash"].isNotNull()).cast(_SPAN)

    def build(matches: Column) -> Column:
        values = F.regexp_extract_all(text, rx, F.lit(group)) if group else matches
        return let(starts_of(matches), lambda s: let(values, lambda v: spans(matches, s, v)))

    # the extraction below runs only for the few texts that match at all
    return F.when(F.regexp_like(text, rx), let(F.regexp_extract_all(text, rx, F.lit(0)), build)).otherwise(none)


def scan(text: Column) -> Column:
    """All spans of a text, base and candidate, by start and then kind."""
    whole = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans_of(whole, k) for k in range(len(KINDS))]))


def ownership(spans: DataFrame) -> DataFrame:
    """Per hash of ``spans(hash, owner, repo)``: how many owners and repositories hold it.

    Pre-aggregated before every shuffle, so a value held by a third of all rows is one
    row per task and key.
    """
    held = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("hash").agg(
        F.count_distinct("owner").alias("n_owners"),
        F.count_distinct("repo").alias("n_repos"),
        F.sum("n").alias("n_spans"),
    )


def classify(stats: DataFrame) -> DataFrame:
    """``ownership`` with class: copied, shared or owned.

    Copied: by several owners and in several repositories, or in very many repositories
    whoever owns them.  Owned: by one owner, in not so many.
    """
    many = (F.col("n_owners") >= MIN_COPIED) & (F.col("n_repos") >= MIN_COPIED)
    copied = many | (F.col("n_repos") >= WIDELY_COPIED)
    return stats.withColumn(
        "class",
        F.when(copied, "copied").when(F.col("n_owners") <= MAX_LIVE_OWNERS, "owned").otherwise("shared"),
    )


def _judged(docs: DataFrame, owner: Column, repo: Column, keep: list[str], text: str) -> DataFrame:
    """(kept, spans, counts); ``kept`` is a struct, so no name of the input can clash."""
    scanned = checkpoint(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
            F.coalesce(owner.cast("string"), F.lit("\u0000null")).alias("owner"),
            F.coalesce(repo.cast("string"), F.lit("\u0000null")).alias("repo"),
            scan(F.col(text)).alias("found"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    empty = scanned.where(F.size("found") == 0).select(
        "kept",
        F.array().cast(_SPAN).alias("spans"),
        *[F.lit(0).cast("long").alias(c) for c in COUNTS],
    )
    holders = scanned.where(F.size("found") > 0)
    found = holders.select("row", "owner", "repo", F.explode("found").alias("span"))
    stats = classify(ownership(found.select(F.col("span.hash").alias("hash"), "owner", "repo"))).select("hash", "class", "n_owners", "n_repos")
    key = F.col("span.kind").isin(*KEY_KINDS) & (F.col("class") != "copied")
    live = ((F.col("class") == "owned") | key) & F.col("span.random")
    judged = found.join(stats, F.col("span.hash") == F.col("hash"))
    merged = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("span.base") | live, F.col("span")))).alias("spans"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("class") == "copied").alias("n_copied"),
        F.max("n_owners").alias("n_owners"),
        F.max("n_repos").alias("n_repos"),
    )
    return holders.select("row", "kept").join(merged, "row").drop("row").unionByName(empty)


def find_secrets(
    docs: DataFrame, owner: Column, repo: Column, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with their sorted ``spans``.

    ``spans`` holds the base spans and the candidate spans of live values; ``n_live``
    and ``n_copied`` count the spans whose value is live or copied, ``n_owners`` and
    ``n_repos`` are those of the row's most widely held values.
    """
    judged = _judged(docs, owner, repo, list(keep), text)
    return judged.select(*[F.col("kept").getField(c).alias(c) for c in keep], "spans", *COUNTS)


def _digest(spans: Column) -> Column:
    named = F.transform(
        spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    )
    return F.array_join(named, ",")


def op1_secrets(docs: DataFrame) -> DataFrame:
    """Digest of the scan: the owner is the source, and a text, however often it is copied, a repository."""
    found = find_secrets(docs.select("doc_id", "text", "source"), F.col("source"), F.xxhash64("text"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS],
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        *COUNTS,
    )


def redact(docs: DataFrame, owner: Column, repo: Column, text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``[SECRET]``; n_chars follows the text.

    Rows without a span pass as they are and are not shuffled.
    """
    cols = docs.columns
    has = F.lit(False)
    for kind in KINDS:
        has = has | F.coalesce(F.regexp_like(F.col(text), F.lit(kind[1])), F.lit(False))
    clean = docs.where(~has)
    judged = _judged(docs.where(has), owner, repo, cols, text)
    whole = F.col("kept").getField(text)
    # spans may overlap: a piece of text is kept only from the furthest end so far
    mark = F.encode(F.lit("x"), "UTF-32")
    wide = F.struct(F.encode(whole, "UTF-32").alias("codes"), F.length(whole).cast("long").alias("n"))  # positions without a walk from the start

    def piece(w: Column, start: Column, end: Column) -> Column:
        cut = F.substring(w["codes"], (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.substring(F.decode(F.concat(mark, cut), "UTF-32"), F.lit(2), (end - start).cast("int"))

    def pieces(w: Column, far: Column) -> Column:
        before = F.transform("spans", lambda x, i: F.struct(F.get(far, i).alias("from"), x["start"].alias("to")))
        kept = F.transform(F.filter(before, lambda x: x["to"] >= x["from"]), lambda x: piece(w, x["from"], x["to"]))
        last = F.greatest(F.element_at(far, -1), F.element_at("spans", -1)["end"])
        return F.array_join(F.concat(kept, F.array(piece(w, last, w["n"]))), "[SECRET]")

    far = prefixes(F.transform("spans", lambda x: x["end"]), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    cleaned = F.when(F.size("spans") > 0, let(wide, lambda w: let(far, lambda f: pieces(w, f)))).otherwise(whole)
    out = judged.select("kept", cleaned.alias("cleaned"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("cleaned").alias(c)
        if c == "n_chars":
            return F.length("cleaned").cast("long").alias(c)
        return F.col("kept").getField(c).alias(c)

    return clean.unionByName(out.select(*[column(c) for c in cols]))


def _sql_positions(alias: str, pattern: str, group: int) -> str:
    """DuckDB: the list of (start, end, value) of a pattern's matches in ``t``."""
    return f"""
  {alias}_m AS (SELECT rid, t, regexp_extract_all(t, $rx${pattern}$rx$) AS m, regexp_extract_all(t, $rx${pattern}$rx$, {group}) AS v,
              regexp_split_to_array(t, $rx${pattern}$rx$) AS g FROM d WHERE regexp_matches(t, $rx${pattern}$rx$)),
  {alias} AS (SELECT rid, i, m[i] AS whole, v[i] AS value,
              list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS s
            FROM (SELECT rid, m, v, g, unnest(generate_series(1, len(m))) AS i FROM {alias}_m))"""


def oracle_sql() -> str:
    """The whole result in DuckDB SQL, for texts without look-around matches (see CANDIDATE_KINDS: mixed)."""
    parts, unions = [], []
    for n, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "mixed":  # RE2 has no look-around: all runs, then the same tests on the run
            pattern = r"[A-Za-z0-9+/_=-]{24,}"
        parts.append(_sql_positions(f"k{n}", pattern, group))
        more = (
            "AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"
            if kind == "mixed"
            else ""
        )
        unions.append(
            f"SELECT rid, CAST(s AS BIGINT) AS s, CAST(s + length(whole) AS BIGINT) AS e, {n} AS kn, '{kind}' AS kind, {str(n < len(BASE_KINDS)).lower()} AS base,"
            f" sha256(value) AS h, len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT_CHARS} AS random FROM k{n} WHERE length(value) >= {least} {more}"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '\u0001null') AS o,"
        " coalesce(md5(text), '') AS r FROM documents),"
        + ",".join(parts)
        + ", a AS ("
        + " UNION ALL ".join(unions)
        + f"""),
 c AS (SELECT h, count(DISTINCT o) AS n_owners, count(DISTINCT r) AS n_repos FROM a JOIN d USING (rid) GROUP BY h),
 st AS (SELECT *, CASE WHEN (n_owners >= {MIN_COPIED} AND n_repos >= {MIN_COPIED}) OR n_repos >= {WIDELY_COPIED} THEN 'copied'
               WHEN n_owners <= {MAX_LIVE_OWNERS} THEN 'owned' ELSE 'shared' END AS class FROM c),
 j AS (SELECT a.*, class, n_owners, n_repos,
        random AND (class = 'owned' OR (kind IN ({', '.join(repr(k) for k in KEY_KINDS)}) AND class <> 'copied')) AS live FROM a JOIN st USING (h)),
 g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn) FILTER (WHERE base) AS b,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kn) FILTER (WHERE base OR live) AS spans,
        count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE class = 'copied') AS n_copied,
        max(n_owners) AS n_owners, max(n_repos) AS n_repos
       FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(n_owners, 0) AS n_owners, coalesce(n_repos, 0) AS n_repos
FROM d LEFT JOIN g USING (rid)"""
    )
