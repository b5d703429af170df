"""Order statistics, neighbours, samples and fuzzy candidates against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.operators import fuzzy, quality, selection


def grouped(rows):
    out = defaultdict(list)
    for g, v in rows:
        if v is not None:
            out[g].append(v)
    return {g: sorted(x) for g, x in out.items()}


@pytest.mark.parametrize("sorted_at_once", [1, 8, 4096])
def test_nth_against_sorting(spark, monkeypatch, sorted_at_once):
    monkeypatch.setattr(selection, "SORTED", sorted_at_once)
    monkeypatch.setattr(selection, "BUCKETS", 7)
    rng = random.Random(2)
    rows = [("wide", rng.choice([1e308, -1e308, 0.0, 5e-324, 1.5, -2.0])) for _ in range(300)] + [("ties", float(rng.randrange(3))) for _ in range(500)]
    rows += [("near", 1 + k * 2**-52) for k in range(40)] + [(None, rng.random()) for _ in range(100)] + [("one", 3.0), ("null", None), ("inf", float("inf")), ("some", None)]
    rows += [("ends", x) for x in [float("inf"), float("-inf"), 1.0, 2.0, 3.0, -4.0] * 20] + [("most", float("inf")), ("some", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    values = grouped(rows)
    for share in (0.0, 0.1, 0.5, 0.999):
        got = {r.g: r.nth for r in selection.nth(df, ["g"], "v", F.floor(F.col("n") * share)).collect()}
        assert got == {g: x[int(len(x) * share)] for g, x in values.items()}
    assert selection.nth(df, ["g"], "v", F.col("n")).count() == 0
    assert selection.nth(df.where("false"), ["g"], "v", F.lit(0)).count() == 0


def test_previous_over_partitions(spark):
    rng = random.Random(4)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 4}", i, None if i % 11 == 0 else rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(7)
    before, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = before.get(g)
        before[g] = v
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps small partitions apart
    try:
        out = selection.previous(df, ["g"], ["i"], "v")
        assert out.columns == ["g", "i", "v", "previous"]
        assert {r.i: r.previous for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_first_by_hash(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small") for i in range(3000)] + [(7000, "one")]
    df = spark.createDataFrame(rows, "i long, s string").withColumn("u", selection.seeded(9, "i"))
    order = defaultdict(list)
    for r in df.collect():
        order[r.s].append((r.u, r.i))
    for targets, n in ((F.ceil(F.col("n") * 0.1), lambda k: -(-k // 10)), (F.lit(2), lambda k: min(2, k)), (F.lit(0), lambda k: 0), (F.col("n") + 5, lambda k: k)):
        got = defaultdict(set)
        out = selection.first_by_hash(df.drop("u"), ["s"], targets, ["i"], 9)
        assert out.columns == ["i", "s"]
        for r in out.collect():
            got[r.s].add(r.i)
        assert got == {s: {i for _, i in sorted(x)[: n(len(x))]} for s, x in order.items() if n(len(x))}
    everything = sorted(x for v in order.values() for x in v)
    assert {r.i for r in selection.first_by_hash(df.drop("u"), [], F.lit(100), ["i"], 9).collect()} == {i for _, i in everything[:100]}
    assert selection.first_by_hash(df.drop("u").where("false"), [], F.lit(100), ["i"], 9).count() == 0


def test_one_label_over_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("label", F.lit(1))
    rows = [[float(x) for x in r.embedding] for r in df.orderBy("vec_id").collect()]
    drops = sorted(1 - max(-1.0, min(1.0, sum(a * b for a, b in zip(x, y)))) for x, y in zip(rows, rows[1:]))
    r = quality.coherence_drop(df, "label", "vec_id").collect()
    assert len(r) == 1 and abs(r[0].mean - max(0, min(1, 1 - sum(drops) / len(drops)))) < 1e-9
    assert abs(r[0].p10 - max(0.0, min(1.0, 1 - drops[int(len(drops) * 0.9)]))) < 1e-9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_rests_find_all_near_names(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(0, 9)))
    texts, names = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    a = spark.createDataFrame([(t,) for t in texts], "t string")
    b = spark.createDataFrame([(t,) for t in names], "n string")
    got = [tuple(r) for r in fuzzy.candidates(a.withColumn("k", F.col("t")), b.withColumn("k", F.col("n")), "t", "n", "k").collect()]
    assert len(got) == len(set(got))
    assert {(x, y) for x in texts for y in names if distance(x, y) <= 2} <= set(got)
    assert all(distance(x, y) <= 4 for x, y in got)
    size = spark.range(1).select(F.size(fuzzy.rests(F.lit("abcde"))).alias("n"), F.size(fuzzy.rests(F.lit(""))).alias("none"), F.size(fuzzy.rests(F.lit("aa"))).alias("same")).first()
    assert (size.n, size.none, size.same) == (1 + 5 + 10, 1, 3)


def test_alike_names_meet_few(spark):
    """Names of one length that differ by a number: the lengths are all equal, the rests are not."""
    a = spark.range(300).select(F.format_string("lastenheft_%05d", F.col("id") * 1111 % 99991).alias("t"))
    met = fuzzy.candidates(a.withColumn("k", F.col("t")), a.select(F.col("t").alias("n"), F.col("t").alias("k")), "t", "n", "k")
    assert met.count() < 300 * 300 / 10 and Counter(r.t == r.n for r in met.collect())[True] == 300


def test_small_tables_are_dealt_to_all_cores(spark):
    from docloom.functions import text as T
    from docloom.plans import views

    cores = spark.sparkContext.defaultParallelism
    small = spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1)
    assert views.spread(small, "doc_id").rdd.getNumPartitions() == 2 * cores and views.spread(small, "doc_id").count() == 100
    many = small.repartition(2 * cores + 1)
    assert views.spread(many, "doc_id").rdd.getNumPartitions() == 2 * cores + 1
    texts = [None, "", "  ", "a", " two  words here　 ", "﻿", "tab\tand\nline", "ﬁne ½", "Über ß", "é"]
    want = [0 if not t else -(-(2 * sum(len(w) for w in t.replace("﻿", " ").split()) + len(t.replace("﻿", " ").split())) // 9) for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", T.tokens(F.col("t")).alias("n"), T.nfkc(F.col("t")).alias("c")).orderBy("k").collect()
    import unicodedata

    assert [r.n for r in got] == want
    assert [r.c for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
