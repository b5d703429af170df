"""Work that a row costs: what is read once, and blocks that keep long texts linear."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.operators import chunking, quality


def test_windows_of_long_texts_come_from_blocks(spark):
    text = "".join(f"wort{k} " + ("\n" if k % 9 == 0 else "") for k in range(6000)) + "x" * 1300 + " ä" * 400
    rows = spark.createDataFrame([(0, text), (1, ""), (2, None), (3, " " * 900), (4, text[: chunking.BLOCK + 1])], "id int, text string")
    got = {r.id: [(w.start, w.content) for w in r.w] for r in rows.select("id", chunking.sliding_windows(F.col("text")).alias("w")).collect()}
    assert [c for _, c in got[0]] == chunking.cut_windows(text) and [c for _, c in got[4]] == chunking.cut_windows(text[: chunking.BLOCK + 1])
    assert got[1] == got[2] == got[3] == []
    # the whole text is cut once a block, not at every window
    assert len(re.findall(r"substring\(text,", str(chunking.sliding_windows(F.col("text"))))) == 1


def test_words_of_sentences_are_counted_once():
    assert str(quality.coherence(F.col("t"), "german_modal")).count("aggregate(") == 1


def test_hints_lose_no_requirement_and_no_part_number(spark):
    texts = ["Es SOLL sein", "eſ muſſ", "darf nicht", "hat sicherzustellen", "HAT SıCHERZUSTELLEN", "that is all", "AB-123", "KB_777", "FIKB 123", "xAB123", "AB12", "FIKB 12345 x"]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    required = quality._required(c, "german_modal").alias("a"), quality.rx.test(c, *quality.REQUIREMENT["german_modal"]).alias("b")
    parts = (F.regexp_like(c, F.lit(quality.PART_HINT)) & quality.rx.test(c, quality.PART_NUMBER)).alias("x"), quality.rx.test(c, quality.PART_NUMBER).alias("y")
    got = rows.select(*required, *parts).collect()
    assert all(r.a == r.b and r.x == r.y for r in got) and any(r.a for r in got) and any(r.x for r in got)


def test_signatures_are_never_broadcast(spark):
    from docloom.plans import report_queries as R

    near = R.sketch_similarities(spark, "/root/testdata/sf0.001")
    assert near.count() > 0
    plan = near._jdf.queryExecution().optimizedPlan().toString() + near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_high_pairs_without_vectors_equal_all_pairs(spark):
    from docloom.operators import versions
    from tests.test_versions import fingerprints, listed

    pairs = versions._position_pairs(versions.ALIKE)
    groups = {p: g for g in range(versions.ALIKE - 1) for p in range(g, 128, versions.ALIKE - 1)}
    assert len(pairs) == 103 and all(groups[a] == groups[b] for a, b in pairs)
    docs = fingerprints(spark, 220, 5)
    for penalty in (False, True):
        want = [x for x in listed(versions.all_pairs(docs, penalty)) if x[3] == "HIGH"]
        assert listed(versions.high_pairs(docs, penalty)) == want and (want or penalty)


def test_chunks_leave_some_documents_at_a_time():
    import pyarrow as pa

    n = 5 * chunking.ROWS + 3
    text = ["Ein Satz. " * 100 if k % 2 else None for k in range(n)]
    items = [None if k % 2 else ["Ein Satz."] * 100 for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([".pdf"] * n), pa.array(["x" if k % 2 else "semantic" for k in range(n)]), pa.array(text), pa.array(items)], names=list("abcde"))
    out = list(chunking.fold_batches(iter([batch])))
    assert len(out) == 6 and max(len(set(b.column(0).to_pylist())) for b in out) == chunking.ROWS
    assert [d for b in out for d in dict.fromkeys(b.column(0).to_pylist())] == list(range(n))


def test_types_read_the_lowered_sample_once(spark):
    from docloom.functions import classify as C

    kind = str(C.document_type(F.col("name"), F.col("headings"), F.col("sample")))
    assert kind.count("concat_ws(") == 1 and kind.count("contains(") > len(C.CONTENT_WORDS)
    assert str(C.detect_oem(F.col("sample"), F.col("headings"), F.col("segments"))).count("concat_ws(") == 1


def test_words_of_patterns_lose_no_match(spark):
    from docloom.functions import classify as C
    from docloom.functions import jsregex as rx
    from docloom.functions.profile import AUTOMOTIVE_DE, PLAINER, WORDS
    from docloom.operators import references

    texts = [
        "FİKB-77 Qv 123 KB-Maſter-Nummer 5 laut Kapitel 3.1 Anlage ZK-4455", "Stand: 2024-01 eſ MUſſ ſOLLEN Kann DıCHT Ist  zu REQ-123 ORBIT-SRS-014", "Es muß AB-CD-12", "MÜSSEN DÜRFEN KÖNNEN Doc QX 90817 ABW_123 NEED-777",
        "LEſſONS learned", "ſervice  level", "N.I.O. Test SPEC", "PRÜFVORSCHRIFT", "Firſt article InSPECTION", "ÄNDERUNGSAUFTRAG", "engineering change request", "PRÜFPLAN", "produktionsfreıgabe", "Warranty claim", "work instruction", "Supplier Manual",
        "Norm", "8D-Report", "ISIR", "FMEA", "PRÜFBERıCHT", "Abweıchliste", "Proposal", "Spezıfikation", "Protokoll", "nothing of all this", "",
    ]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tests = [(C.with_folded(c, lambda t, low, p=p: C.hits(t, low, p)), rx.test(c, *p)) for p in (*WORDS, *PLAINER)]
    content = F.lower(c)
    tests += [(rx.may_hit(rx.even(content), C.CONTENT_WORDS[k]) & rx.test(content, p, "i"), rx.test(content, p, "i")) for k, p in C.TYPE_BY_CONTENT]
    for r in rows.select(c, *[F.struct(a.alias("a"), b.alias("b")).alias(f"x{k}") for k, (a, b) in enumerate(tests)]).collect():
        assert all(x.a == x.b for x in r[1:]), r.t
    found = rows.select(*[F.max(b.cast("int")).alias(f"x{k}") for k, (_, b) in enumerate(tests)]).first()
    assert all(found), [k for k, x in enumerate(found) if not x]
    lists = [references.raw_references(c, AUTOMOTIVE_DE, low) for low in (rx.folded(c), None)]
    assert all(r.a == r.b for r in rows.select(*[F.to_json(F.struct(*[x[k].alias(k) for k in x])).alias(n) for n, x in zip("ab", lists)]).collect())


def test_many_words_are_not_split_all(spark):
    from docloom.functions import classify as C

    texts = {"Die Achse " + "x " * n: kind for n, kind in ((5, "uncertain"), (6, "confirmed"), (78, "confirmed"), (79, "uncertain"), (5000, "uncertain"))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.sentence_status(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == texts
    assert str(C.sentence_status(F.col("t"))).count("split(") == 1


def test_synthesis_reads_texts_once_for_each_input(spark, monkeypatch):
    from collections import Counter

    from docloom.plans import narrative_queries as N

    calls = Counter()
    for module, name in ((N.Q, "_resolved"), (N.R, "_parsed"), (N.Q, "_requirements"), (N.R, "_quality")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, made=made, name=name: calls.update([name]) or made(*a))
    rows = {r.metric: r.value for r in N.narrative_synthesis(spark, "/root/testdata/sf0.001").collect()}
    assert rows["has_pairs"] == 1 and set(calls.values()) == {1} and len(calls) == 4
