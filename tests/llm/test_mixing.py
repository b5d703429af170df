from collections import defaultdict

from docloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, _u string"


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Iterated: clamp what is above its cap, share the excess by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: epochs * sizes[s] for s in over})


def rows_of(spec):
    out, i = [], 0
    for source, lengths in spec.items():
        for n in lengths:
            out.append((i, " ".join(["w"] * n) if n is not None else None, source, "en", "x"))
            i += 1
    return out


def check(spark, spec):
    rows = rows_of(spec)
    got = mixing.op8_mixing(spark.createDataFrame(rows, SCHEMA)).collect()
    again = mixing.op8_mixing(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(rows)
    sizes = {s: sum(n or 0 for n in ls) for s, ls in spec.items()}
    expected = brute_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - expected[s]) < 1e-6 * max(1, expected[s])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, ls in spec.items():
        assert abs(taken[s] - expected[s]) <= max([n or 0 for n in ls], default=0)
    return expected


def test_caps_are_reshared(spark):
    expected = check(spark, {"a": [10, 20, 5], "b": [300, 200, 50, 7], "c": [1000, 2000] * 5, None: [40, 30, 9]})
    assert expected["a"] == 3 * 35  # capped
    assert abs(sum(expected.values()) - (35 + 557 + 15000 + 79)) < 1e-6


def test_nulls_empties_and_one_source(spark):
    check(spark, {"only": [5, 0, None, 8]})
    check(spark, {"a": [0, None], "b": [10] * 20, "": [3] * 7})


def test_hot_source(spark):
    check(spark, {"hot": [17, 3, 250] * 40, "x": [11] * 9, "y": [4] * 30, "z": [90, 1]})


def test_empty_table(spark):
    assert mixing.op8_mixing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_stay(spark):
    rows = [(1, "a b c", "s", "en", "x")] * 4 + [(2, "a", "t", "en", "x")]
    assert mixing.op8_mixing(spark.createDataFrame(rows, SCHEMA)).count() == 5
