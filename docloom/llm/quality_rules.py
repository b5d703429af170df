"""Quality rules: base counters and a learned decision list (DataFrame functions only).

The learner is sequential covering.  Thresholds come from quantiles of the labelled
rows; every labelled row becomes a vector of threshold bins.  One rule grows by adding
the condition of highest FOIL gain, read from a histogram of (feature, bin, label) over
the rows the rule still covers; it is pruned to its best prefix on the fold that did
not grow it, and the rows it covers are removed.  Every step is one aggregation over
all labelled rows whose result has a fixed size (features x bins), so no rows reach the
driver.  The rules become one ordered ``when`` chain.

Defined results: a null text has no words and fails the base rules; several labels of
a document count as its worst; a very long text is folded in its row; without labels no rule is learned; repeated rows stay;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, let, table, words

#: Words in a window of the repetition counter.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
FEATURES = (
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "adjacent_share",
    "upper_share",
    "digit_share",
    "log_words",
)
#: Quantiles that give thresholds, for either label.
QUANTILES = tuple(x / 20 for x in range(1, 20)) + (0.01, 0.99)
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule needs this precision on both folds and so many rows on each.
MIN_PRECISION = 0.95
MIN_SUPPORT = 5
#: One labelled document in so many prunes; the others grow.
PRUNE_FOLDS = 3


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows whose hash comes twice or more; ``hashes`` are those of the words."""
    n = F.size(hashes)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[hashes.getItem(i + k) for k in range(WINDOW)]),
    )

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.sort_array(
                F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])
            )

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        distinct = F.size(F.array_distinct(w)) == F.size(w)
        return F.when(distinct, F.lit(0)).otherwise(let(let(ordered, positions), length))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def word_stats(text: Column) -> Column:
    """Struct of n_words, n_repeat_words, n_distinct, n_adjacent (long)."""

    def stats(h: Column) -> Column:
        adjacent = F.filter(h, lambda x, i: F.coalesce(F.get(h, i + 1) == x, F.lit(False)))
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            _repeat_words(h).alias("n_repeat_words"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            F.size(adjacent).cast("long").alias("n_adjacent"),
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), stats)


def counters(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base counters and the features of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    counted = docs.select(
        *keep,
        word_stats(t).alias("_w"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count(t, F.lit("[0-9]")).alias("_digit"),
    )
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    flat = counted.select(
        *keep,
        "_w.*",
        "word_chars",
        "n_symbols",
        F.col("_l.n").alias("n_lines"),
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        "_upper",
        "_digit",
    )
    return flat.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_adjacent", "n_words").alias("adjacent_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_digit", "word_chars").alias("digit_share"),
        F.log(F.col("n_words") + 1).alias("log_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects a row."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def column(self) -> Column:
        """Text of the first rule that holds, null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.column()
            out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _thresholds(labelled: DataFrame, features: tuple[str, ...]) -> dict[str, list[float]]:
    """Midpoints of distinct quantiles of either label, by feature: one aggregation of fixed size."""
    picks = [
        F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), list(QUANTILES), 1000).alias(f"{f}_{b}")
        for f in features
        for b in (0, 1)
    ]
    row = labelled.agg(*picks).first()
    values = {f: sorted({x for b in (0, 1) for x in (row[f"{f}_{b}"] or [])}) for f in features}
    return {f: [(x + y) / 2 for x, y in zip(v, v[1:])] for f, v in values.items()}


def learn(
    labelled: DataFrame,
    features: tuple[str, ...] = FEATURES,
    max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS,
    min_precision: float = MIN_PRECISION,
    min_support: int = MIN_SUPPORT,
) -> DecisionList:
    """Decision list for ``bad`` (0 or 1) from ``labelled(doc_id, bad, features...)``."""
    cuts = _thresholds(labelled, features)
    def bin_of(f: str) -> Column:
        if not cuts[f]:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[f]]), lambda t: t < F.col(f)))

    bins = [bin_of(f) for f in features]
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % PRUNE_FOLDS == 0).alias("prunes")
    rows = checkpoint(labelled.select("bad", fold, F.array(*bins).alias("bins")))

    def covers(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, b in rule:
            x = F.col("bins").getItem(f)
            out = out & (x > b if above else x <= b)
        return out

    def histogram(df: DataFrame) -> dict:
        found: dict = {}
        exploded = df.select("prunes", "bad", F.posexplode("bins").alias("f", "bin"))
        for r in exploded.groupBy("prunes", "bad", "f", "bin").count().collect():
            found.setdefault((r["prunes"], r["f"]), {}).setdefault(r["bin"], [0, 0])[r["bad"]] = r["count"]
        return found

    def totals(h: dict, prunes: bool) -> tuple[int, int]:
        per_bin = h.get((prunes, 0), {}).values()
        return sum(x[1] for x in per_bin), sum(x[0] for x in per_bin)

    def best(h: dict, p0: int, n0: int):
        top = (0.0, None)
        for f, name in enumerate(features):
            per_bin = h.get((False, f), {})
            for b in range(len(cuts[name])):
                low = [sum(x[k] for i, x in per_bin.items() if i <= b) for k in (1, 0)]
                for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                    if p >= min_support:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > top[0] + 1e-9:
                            top = (gain, (f, above, b))
        return top[1]

    out = DecisionList()
    remaining = rows
    for _ in range(max_rules):
        rule: list[tuple[int, bool, int]] = []
        trail = []  # per prefix: counts on the growing and the pruning fold
        while True:
            h = histogram(remaining.where(covers(rule)))
            grow, prune = totals(h, False), totals(h, True)
            trail.append((grow, prune))
            if len(rule) == max_conditions or grow[0] < min_support or grow[1] == 0 or not (step := best(h, *grow)):
                break
            rule.append(step)
        worth = [
            (
                (p - n) / (p + n) if p + n else -1.0,
                -k,
            )
            for k, (_, (p, n)) in enumerate(trail)
        ]
        keep = -max(worth[1:], default=(0, 0))[1]
        if not keep:
            break
        (gp, gn), (pp, pn) = trail[keep]
        if min(gp, pp) < min_support or gp < min_precision * (gp + gn) or pp < min_precision * (pp + pn):
            break
        rule = rule[:keep]
        out.rules.append(tuple(Condition(features[f], above, cuts[features[f]][b]) for f, above, b in rule))
        remaining = remaining.where(~covers(rule))
    return out


def judge(docs: DataFrame, labels: DataFrame, **learner) -> DataFrame:
    """Counters of every row of ``docs`` with the decision list's ``rule`` (null: kept)."""
    counted = checkpoint(counters(docs))
    truth = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    labelled = counted.join(truth, "doc_id").withColumn("bad", F.when(F.col("_q") > 0, 0).otherwise(1))
    rules = learn(labelled.where(~F.col("base_failed")), **learner)
    return counted.withColumn("rule", rules.column())


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Counters, the base verdict and the learned one, per document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
        "rule",
    )
