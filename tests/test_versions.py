"""Classes of version pairs, the join of vectors, and HIGH pairs that vectors make."""

import datetime
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import sketch
from docloom.operators import metric, versions

SCHEMA = (
    "doc_id long, path string, filename string, extension string, customer string, best_date date, date_source string, parse_success boolean, char_count int, numbered boolean, "
    "levels struct<h1:int,h2:int,h3:int,h4_plus:int>, signature array<long>, embedding array<float>, mandatory double, recommended double, doc_type string, oem string, entity_ids array<string>"
)
HEADINGS = ([], ["Scope"], ["Scope", "Terms", "Tests"], [f"Part {k}" for k in range(9)], [f"Part {k}" for k in range(3, 12)], ["Other"])
NAMES = ("spec_abc", "spec_abd", "spec_abcdef", "offer", "ab", "")


def fingerprints(spark, n, seed=1, vectors=False):
    """Documents of few kinds, so that classes are large; some share a vector or lie near another."""
    rng = random.Random(seed)
    np_rng = np.random.default_rng(seed)
    centres = np_rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        h = rng.choice(HEADINGS)
        levels = {"h1": min(1, len(h)), "h2": max(0, len(h) - 1), "h3": 0, "h4_plus": 0}
        vector = None
        if vectors and rng.random() < 0.9:
            c = centres[rng.randrange(6)]
            vector = [float(np.float32(x)) for x in (c if rng.random() < 0.4 else c + np_rng.normal(size=8) * rng.choice([0.2, 0.8, 1.5]))]
        day = rng.choice([None, datetime.date(2020, 1, 1), datetime.date(2020, 12, 31), datetime.date(2021, 1, 1), datetime.date(2023, 5, 5)])
        name = f"{rng.choice(NAMES)}_v{i % 4}{rng.choice(['.pdf', '.docx'])}"
        rows.append((
            i, f"{rng.choice('xy')}/{name}", name, "." + name.rpartition(".")[2], rng.choice([None, "BMW", "Audi"]), day, rng.choice(["mtime", "filename"]), i % 17 > 0, 500 if i % 13 else 100,
            rng.random() < 0.2, levels, [int(v) for v in sketch.signature(h)], vector, 0.0, float(i % 3), rng.choice(["norm", "fmea"]), rng.choice(["BMW", "unknown"]), rng.choice([[], ["A"], ["B"], ["A", "B"]]),
        ))
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted((r.doc_a, r.doc_b, r.score, r.confidence) for r in df.collect())


@pytest.mark.parametrize("penalty", [False, True])
def test_class_pairs_hold_all_pairs(spark, penalty):
    docs = fingerprints(spark, 160)
    want = listed(versions.all_pairs(docs, penalty))
    of = versions.classes(docs, penalty)
    pairs = versions.class_pairs(of, penalty)
    assert len(want) > 2000 and listed(versions.expand(pairs, of.members)) == want
    rows = pairs.collect()
    assert sum(r.pairs for r in rows) == len(want) > len(rows) and all(r.class_a <= r.class_b and r.pairs > 0 for r in rows)
    assert {r["range"]: r.pairs for r in versions.histogram(pairs).collect()}["3-4"] == sum(3 <= s <= 4 for _, _, s, _ in want)
    for n in (1, 7, 300):
        best = sorted((-s, a, b) for a, b, s, _ in want)[:n]
        assert sorted(versions.first_pairs(pairs, of.members, n)) == sorted((a, b) for _, a, b in best)
    few = listed(versions.pairs_of([(a, b) for a, b, _, _ in want[:5]], docs, penalty))
    assert few == want[:5]


def test_class_pairs_of_few_documents(spark):
    none = fingerprints(spark, 1)
    of = versions.classes(none)
    assert versions.class_pairs(of).count() == 0 and versions.first_pairs(versions.class_pairs(of), of.members, 5) == []
    assert versions.pairs_of([], none).count() == 0


def test_high_pairs_with_vectors_equal_all_pairs(spark):
    docs = fingerprints(spark, 220, 3, vectors=True)
    want = [x for x in listed(versions.all_pairs(docs)) if x[3] == "HIGH"]
    assert listed(versions.high_pairs(docs)) == want
    plain = [x for x in listed(versions.all_pairs(docs.withColumn("embedding", F.lit(None).cast("array<float>")))) if x[3] == "HIGH"]
    assert len(want) > len(plain) > 10  # vectors make more
    penal = [x for x in listed(versions.all_pairs(docs, True)) if x[3] == "HIGH"]
    assert listed(versions.high_pairs(docs, True)) == penal


def plain_near(rows, threshold):
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows}
    return sorted((a, b) for a, b in itertools.combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and sum(x * y for x, y in zip(unit[a], unit[b])) >= threshold)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 0.999])
def test_near_pairs_against_brute_force(spark, threshold, monkeypatch):
    """Many cells, chunks and passing parts."""
    monkeypatch.setattr(metric, "CELL", 20)
    monkeypatch.setattr(metric, "HELD", 17)
    monkeypatch.setattr(metric, "PASSING", 30)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    rows = [(int(i) * 3, [float(x) for x in (centres[rng.integers(9)] + rng.normal(size=12) * rng.choice([0.05, 0.4, 2])) * rng.uniform(0.1, 50)]) for i in range(400)]
    rows += [(5000 + i, [1.0 + i, 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    got = sorted(map(tuple, metric.near_pairs(df, threshold).collect()))
    assert got == plain_near(rows, threshold) and len(got) == len(set(got))


def test_unit_classes(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 0.0]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    assert sorted(map(tuple, metric.unit_classes(df).collect())) == [(1, 1), (2, 1), (7, 7)]
    assert metric.near_pairs(df.where("doc_id > 100"), 0.5).count() == 0


def test_near_pairs_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    for threshold in (0.5, 0.7):
        got = sorted(map(tuple, metric.near_pairs(df, threshold, "vec_id").collect()))
        assert got == plain_near(rows, threshold)
    assert Counter(map(type, itertools.chain(*got))).keys() <= {int}


def test_listed_pairs_are_high_pairs(spark):
    docs = fingerprints(spark, 160)
    of = versions.classes(docs)
    got = versions.listed_pairs(versions.class_pairs(of).where("confidence = 'HIGH'"), of.members, docs)
    want = versions.high_pairs(docs)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want) != []


def test_pair_queries_list_every_pair_of_documents(spark):
    """Documents of one class have texts and dates of their own, so their pairs are rows, with what each pair says."""
    from docloom.plans import report_queries as R

    sf = "/root/testdata/sf0.001"
    every = versions.all_pairs(R._fingerprints(spark, sf, False)).collect()
    shown = ("doc_a", "doc_b", "structural_match", "minhash", "same_directory", "days", "score", "confidence", "likely_newer")
    got = R.version_pairs(spark, sf).collect()
    assert len(got) > 1000 and sorted(str([r[c] for c in shown]) for r in got) == sorted(str([r[c] for c in shown]) for r in every)
    medium = R.medium_pairs(spark, sf).collect()
    assert sorted((r.doc_a, r.doc_b) for r in medium) == sorted((r.doc_a, r.doc_b) for r in every if r.confidence == "MEDIUM")
    partners: dict[int, list] = {}
    for r in sorted(every, key=lambda r: (r.doc_a, r.doc_b)):
        if r.score >= 5:
            partners.setdefault(r.doc_a, []).append(f"{r.doc_b}:{r.score}")
    assert {r.doc_a: r.partners for r in R.version_audit(spark, sf).collect()} == {a: ",".join(x) for a, x in partners.items()}
