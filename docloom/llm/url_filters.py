"""URL filters: host and path rules, and a ratio of two character language models.

DataFrame functions only.  Rules decide first; the longest that fits wins.  The other
URLs are judged by two variable-order Markov models, one of accepted and one of
rejected URLs (those the rules decide): trigrams with Witten-Bell smoothing that fall
back to bigrams and unigrams where a context was seen too rarely.  Characters are
mapped to a fixed alphabet of ``SIZE``, so a model has ``SIZE**3`` entries however many URLs there
are, and the whole ratio is one array, a scalar subquery: scoring is a narrow pass without a join
or shuffle.

The threshold of the length-normalised log-likelihood difference is cross-fitted: the
decided URLs are dealt into ``FOLDS`` folds, and every accepted one is scored by models
that have seen the other folds only.  The threshold is the least of those scores that no more
than ``MAX_FALSE_BLOCKS`` of the accepted URLs to come exceed on average: of n
scores the one at place ceil((n + 1) * (1 - MAX_FALSE_BLOCKS)), which is there from 99 on.
With fewer no bound of one in a hundred can be given, and the models block nothing.

Defined results: null, empty and scheme-less URLs have empty host and path, no rule,
and are allowed; without rejected URLs or enough accepted ones the models allow
everything; a very long URL is scored whole;
repeated rows stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, table

#: Characters of the models, symbols from 1; symbol 0 is the start, the last any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-./?=&#_%:+"
SIZE = len(ALPHABET) + 2
#: A bigram context is used from so many sightings.
MIN_CONTEXT = 4
#: Folds of the decided URLs, and the share of accepted URLs that may be blocked.
FOLDS = 4
MAX_FALSE_BLOCKS = 0.01
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def trigrams(url: Column) -> Column:
    """Codes (below SIZE^3) of the trigrams of ``url``, two start symbols included."""
    chars = F.split(F.lower(F.coalesce(url, F.lit(""))), "")
    codes = F.concat(
        F.array(F.lit(0), F.lit(0)),
        F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(SIZE - 1))),
    )
    gram = lambda c, i: (c.getItem(i) * SIZE + c.getItem(i + 1)) * SIZE + c.getItem(i + 2)
    return let(
        codes,
        lambda c: F.when(
            F.size(c) > 2, F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: gram(c, i))
        ).otherwise(F.array().cast("array<int>")),
    )


def _log_probabilities(n3: Column) -> Column:
    """Dense log P(c | a, b) from the dense trigram counts of one class."""
    zero = F.lit(0).cast("long")
    add = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    seen = lambda xs: F.aggregate(xs, zero, lambda a, x: a + F.when(x > 0, 1).otherwise(0))
    row = lambda xs, i: F.slice(xs, i * SIZE + 1, SIZE)
    cells = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def with_bigrams(n2: Column) -> Column:
        def with_unigrams(n1: Column) -> Column:
            p1 = lambda total: F.transform(n1, lambda x: (x + 1) / (total + SIZE))

            def level2(p: Column) -> Column:
                ctx = F.transform(
                    cells(SIZE), lambda b: F.struct(add(row(n2, b)).alias("n"), seen(row(n2, b)).alias("t"))
                )

                def mix2(c: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        b = F.floor(i / SIZE).cast("int")
                        low = p.getItem(i % SIZE)
                        return F.when(c[b]["n"] > 0, (x + c[b]["t"] * low) / (c[b]["n"] + c[b]["t"])).otherwise(low)

                    return F.transform(n2, one)

                return let(ctx, mix2)

            def level3(p: Column) -> Column:
                ctx = F.transform(
                    cells(SIZE * SIZE), lambda ab: F.struct(add(row(n3, ab)).alias("n"), seen(row(n3, ab)).alias("t"))
                )

                def mix3(c: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        ab = F.floor(i / SIZE).cast("int")
                        low = p.getItem(i % (SIZE * SIZE))
                        mixed = (x + c[ab]["t"] * low) / (c[ab]["n"] + c[ab]["t"])
                        return F.log(F.when(c[ab]["n"] >= MIN_CONTEXT, mixed).otherwise(low))

                    return F.transform(n3, one)

                return let(ctx, mix3)

            return let(let(let(add(n1), p1), level2), level3)

        return let(F.transform(cells(SIZE), lambda c: add(F.transform(cells(SIZE), lambda b: n2[b * SIZE + c]))), with_unigrams)

    pairs = F.transform(
        cells(SIZE * SIZE), lambda bc: add(F.transform(cells(SIZE), lambda a: n3[a * SIZE * SIZE + bc]))
    )
    return let(pairs, with_bigrams)


def train(decided: DataFrame) -> DataFrame:
    """One row ``llr`` (SIZE^3 numbers): log P(rejected) - log P(accepted) by trigram, null if a class is missing.

    ``decided(url, verdict)``; every URL of it counts.
    """
    spark = decided.sparkSession
    grams = decided.select(
        F.explode(trigrams(F.col("url"))).alias("gram"),
        F.when(F.col("verdict") == "block", 1).otherwise(0).cast("long").alias("rej"),
    ).withColumn("acc", 1 - F.col("rej"))
    grid = spark.range(SIZE**3).select(
        F.col("id").cast("int").alias("gram"), F.lit(0).cast("long").alias("rej"), F.lit(0).cast("long").alias("acc")
    )
    sums = grams.unionByName(grid).groupBy("gram").agg(F.sum("rej").alias("rej"), F.sum("acc").alias("acc"))
    dense = sums.agg(F.sort_array(F.collect_list(F.struct("gram", "rej", "acc"))).alias("g")).select(
        F.transform("g", lambda x: x["rej"]).alias("rej"), F.transform("g", lambda x: x["acc"]).alias("acc")
    )
    dense = checkpoint(dense)
    both = F.exists("rej", lambda x: x > 0) & F.exists("acc", lambda x: x > 0)
    models = dense.select(
        both.alias("both"), _log_probabilities(F.col("rej")).alias("r"), _log_probabilities(F.col("acc")).alias("a")
    )
    return checkpoint(models.select(F.when(F.col("both"), F.zip_with("r", "a", lambda r, a: r - a)).alias("llr")))


def score(url: Column, llr: list[float] | Column | None) -> Column:
    """Length-normalised log-likelihood difference: above 0 is more like the rejected ones.

    A model as a column holds ``DataFrame.scalar()`` of the row that ``train`` gives: neither
    plans nor their descriptions, which the driver keeps for every execution, have its SIZE^3 numbers.
    """
    if llr is None:
        return F.lit(0.0)
    if not isinstance(llr, Column):
        llr = F.split(F.lit(",".join(map(repr, llr))), ",").cast("array<double>")  # a folded literal
    total = lambda s: F.aggregate(s["g"], F.lit(0.0), lambda a, x: a + s["m"].getItem(x)) / F.greatest(F.size(s["g"]), F.lit(1))
    return F.coalesce(let(F.struct(trigrams(url).alias("g"), llr.alias("m")), total), F.lit(0.0))


def threshold_of(decided: DataFrame) -> float:
    """Cross-fitted bound on the scores of accepted URLs; infinite if too few tell.

    ``decided(url, verdict)``; equal URLs are in one fold.
    """
    folded = checkpoint(decided.withColumn("fold", F.crc32(F.col("url").cast("binary")) % FOLDS))
    scores = None
    for fold in range(FOLDS):
        model = train(folded.where(F.col("fold") != fold)).scalar()
        own = folded.where((F.col("fold") == fold) & (F.col("verdict") == "allow")).withColumn("_llr", model)
        own = own.select(score(F.col("url"), F.col("_llr")).alias("s"))
        own = checkpoint(own)
        scores = own if scores is None else scores.unionByName(own)
    n = scores.count()
    place = math.ceil((n + 1) * (1 - MAX_FALSE_BLOCKS) - 1e-9)
    if place > n:
        return float("inf")
    return max(scores.agg(F.percentile_approx("s", F.lit(place / n - 1e-12), F.lit(10_000))).first()[0], 0.0)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and llr (null where a rule decides)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path}).withColumn(
        "_rule", match_rule(F.col("host"), F.col("path"), rules)
    )
    decided = parsed.where(F.col("_rule").isNotNull()).select(F.col(url).alias("url"), F.col("_rule.verdict").alias("verdict"))
    threshold = threshold_of(decided)
    model = train(decided).scalar()
    judged = parsed.withColumn("_llr", model).withColumn("llr", F.when(F.col("_rule").isNull(), score(F.col(url), F.col("_llr"))))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("llr") > threshold, "block").otherwise("allow"))
    return judged.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule", "_llr")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "llr")
