"""Stored embeddings, snapshots and streams against plain versions."""

import datetime
import hashlib
import random

from pyspark.sql import functions as F

from docloom.operators import selection, snapshots, store
from docloom.streaming import ingest


def _vector(text):
    return F.array(F.length(text).cast("double"), F.lit(1.0))


def test_store_embeds_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    vectors = store.EmbeddingStore(spark, f"{tmp_path}/v", counted)
    rows = [(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id long, content string")
    got, stats = vectors.lookup(df)
    assert stats == store.Stats(1, 3, 3)
    assert {r.id: r.embedding for r in got.collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None, 5: [0.0, 1.0]}
    assert got.columns == ["id", "content", "embedding"]
    before = calls.value
    more = spark.createDataFrame([(6, "aa"), (7, "ccc"), (8, "ccc")], "id long, content string")
    got, stats = store.EmbeddingStore(spark, f"{tmp_path}/v", counted).lookup(more)
    assert stats == store.Stats(2, 1, 4) and {r.id: r.embedding[0] for r in got.collect()} == {6: 2.0, 7: 3.0, 8: 3.0}
    assert calls.value - before <= 1 + 2  # the new text, and no stored one
    _, stats = store.EmbeddingStore(spark, f"{tmp_path}/v", counted).lookup(more)
    assert stats == store.Stats(3, 0, 4)
    assert store.EmbeddingStore(spark, f"{tmp_path}/none", _vector).lookup(df.where("false"))[1] == store.Stats(0, 0, 0)


def plain_compare(before, after):
    old, new, out = {p: (h, n, i) for p, h, n, i in before}, {p: (h, n) for p, h, n in after}, []
    for p in old.keys() & new.keys():
        out.append((p, p, "same" if old[p][:2] == new[p] else "changed", old[p][2], *new[p]))
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    for p in come[:]:
        match = next((q for q in gone if old[q][:2] == new[p]), None)
        if match:
            gone.remove(match)
            come.remove(p)
            out.append((p, match, "moved", old[match][2], *new[p]))
    out += [(q, q, "gone", old[q][2], *old[q][:2]) for q in gone]
    last = max((i for *_, i in before), default=0)
    return sorted(out + [(p, None, "added", last + k, *new[p]) for k, p in enumerate(come, 1)], key=repr)


def test_snapshots_against_plain_version(spark):
    rng = random.Random(3)
    sha = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    before = [(f"d{rng.randrange(3)}/f{i}", sha(i % 4 if i % 3 else i), 10, i + 1) for i in range(90)]
    after = [(p if rng.random() < 0.5 else f"n{rng.randrange(9)}/{p}", h if rng.random() < 0.7 else sha(p), n) for p, h, n, _ in before if rng.random() < 0.8]
    after += [(f"new/{k}", sha(k % 5), 10) for k in range(20)]
    b = spark.createDataFrame(before, "path string, sha256 string, size_bytes long, id long")
    a = spark.createDataFrame(after, "path string, sha256 string, size_bytes long")
    out = snapshots.compare(b, a)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == plain_compare(before, after) and {r[2] for r in got} == set(snapshots.STATES)
    now = snapshots.current(out)
    assert sorted(map(tuple, now.select("path", "sha256", "size_bytes").collect())) == sorted(after)
    assert now.select("id").distinct().count() == len(after)
    assert {r.state for r in snapshots.compare(now, a).collect()} == {"same"}
    first = snapshots.compare(b.where("false"), a).collect()
    assert sorted(r.id for r in first) == list(range(1, len(after) + 1)) and {r.state for r in first} == {"added"}
    assert {r.state for r in snapshots.compare(b, a.where("false")).collect()} == {"gone"}


def test_numbered_over_partitions(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 2 else f"g{i % 3}", i) for i in range(500)]
    want, seen = {}, {}
    for g, i in rows:
        seen[g] = want[i] = seen.get(g, 0) + 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = selection.numbered(spark.createDataFrame(rows, "g string, i long").repartition(6), ["g"], ["i"])
        assert {r.i: r.place for r in got.collect()} == want and got.columns == ["g", "i", "place"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _arriving(spark, rows, schema, folder, parts):
    """A table, written in ``parts`` files that a stream takes one by one."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drained(stream, tmp_path, mode):
    q = stream.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName(f"q{random.randrange(1 << 30)}").option("checkpointLocation", f"{tmp_path}/state")
    q = q.option("path", f"{tmp_path}/out") if mode == "append" else q
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """Rows arrive out of order and in several files; sessions end up as in a table."""
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(2000)), rng.randrange(4), float(k)) for k in range(300)]
    schema = "ts timestamp, user_id long, value double"
    last = [(start + datetime.timedelta(days=9), 99, 0.0)]  # moves the watermark past all of them
    whole = ingest.sessions(spark.createDataFrame(rows, schema), "30 minutes")
    stream = _arriving(spark, rows, schema, f"{tmp_path}/in", 6)
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    _drained(ingest.sessions(stream, "30 minutes", "10 days"), tmp_path, "append")
    _drained_rows = spark.read.parquet(f"{tmp_path}/out")
    assert _drained_rows.count() == 0  # nothing may close yet: any row may still come
    q = _drained(ingest.sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "30 minutes", "10 days"), f"{tmp_path}/whole", "complete")
    key = lambda df: sorted((r.user_id, r.start, r["last"], r.events, r.value) for r in df.where("user_id < 99").collect())
    assert key(spark.table(q.name)) == key(whole) and whole.count() > 20


def test_sessions_close_after_the_watermark(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda m: start + datetime.timedelta(minutes=m)
    rows = [(at(0), 1, 1.0), (at(20), 1, 1.0), (at(100), 1, 1.0), (at(10), 1, 1.0), (at(600), 2, 1.0), (at(1200), 3, 1.0)]
    schema = "ts timestamp, user_id long, value double"
    stream = _arriving(spark, rows, schema, f"{tmp_path}/in", 1)
    _drained(ingest.sessions(stream, "30 minutes", "1 hour"), tmp_path, "append")
    got = {(r.user_id, r.start): r.events for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, at(0)): 3, (1, at(100)): 1, (2, at(600)): 1}  # the session of user 3 may still grow


def test_first_arrivals_of_a_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "a").mkdir(parents=True)
    for name, content in (("x.docx", b"one"), ("y.pdf", b"two"), ("a/z.docx", b"one"), ("a/w.txt", b"three"), ("a/v.xlsx", b"")):
        (folder / name).write_bytes(content)
    stream = ingest.first_arrivals(ingest.with_hash(ingest.watch_folder(spark, str(folder))))
    _drained(stream.select("path", "sha256"), tmp_path, "append")
    got = [r.sha256 for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx,pptx,pdf}").load(str(folder))
    table = ingest.first_arrivals(ingest.with_hash(batch)).collect()
    assert sorted(got) == sorted(r.sha256 for r in table) and len(got) == 2  # the reader leaves out files without bytes
    (folder / "late.docx").write_bytes(b"two")
    (folder / "new.docx").write_bytes(b"four")
    _drained(stream.select("path", "sha256"), tmp_path, "append")  # goes on from its state
    assert sorted(r.sha256 for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([*got, hashlib.sha256(b"four").hexdigest()])


def test_ingest_hands_over_batches(spark, tmp_path):
    seen = []
    spark.createDataFrame([(1, "a")], "id long, t string").write.parquet(f"{tmp_path}/in")
    q = ingest.ingest(spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in"), lambda df, epoch: seen.append((epoch, df.count())), f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]
