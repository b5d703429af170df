"""Chunkers as table functions: equal to the DataFrame chunkers, with defined edge cases."""

import random

from pyspark.sql import functions as F

from docloom.operators import chunking, table_functions

EDGES = [None, "", " \n\t ", "A. B! C? d.", "x" * 1300, "Ä. Ö. Ü.\n\n\nNext. One", "a\tb\n" * 300, "no end " * 400]


def texts():
    rng = random.Random(5)
    words = ["Alpha.", "beta", "Gamma!", "delta?", "\n\n", "x|y\n", "a\tb\n", "Öl", "   ", " ", "omega;"]
    return EDGES + [" ".join(rng.choice(words) for _ in range(rng.randrange(600))) for _ in range(60)]


def test_chunks_by_row_equal_the_chunker(spark):
    extensions = [".pdf", ".docx", ".xlsx", ".pptx", None]
    rows = [(k, extensions[k % 5], t) for k, t in enumerate(t for t in texts() for _ in extensions)]
    docs = spark.createDataFrame(rows, "doc_id long, extension string, text string")
    table_functions.register(spark)
    sql = "SELECT d.doc_id, c.* FROM {docs} d, LATERAL text_chunks(d.text, d.extension) c"
    got = sorted((r.doc_id, r.chunk_index, r.content) for r in spark.sql(sql, docs=docs).collect())
    expected = sorted((r.doc_id, r.chunk_index, r.content) for r in chunking.chunk(docs).collect())
    assert got == expected and {d for d, *_ in got} < {k for k, *_ in rows}


def test_sentences_equal_the_expression(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    table_functions.register(spark)
    got = {}
    for r in spark.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL text_sentences(d.text) s ORDER BY doc_id, n", docs=docs).collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for r in docs.select("doc_id", chunking.sentences(F.col("text")).alias("s")).collect():
        assert got.get(r.doc_id, []) == (r.s or [])


def test_partitions_are_packed_in_order_and_apart(spark):
    rng = random.Random(8)
    groups = {k: [rng.choice(["w " * rng.randrange(1, 200), "s" * 900, "", None]) for _ in range(rng.randrange(40))] for k in range(9)}
    rows = [(k, n, s) for k, items in groups.items() for n, s in enumerate(items)]
    rng.shuffle(rows)
    table_functions.register(spark)
    sql = "SELECT * FROM packed_chunks(TABLE({rows}) PARTITION BY id ORDER BY n)"
    sentences = spark.createDataFrame(rows, "id long, n int, sentence string")
    got = {}
    for r in spark.sql(sql, rows=sentences).collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.content))
    for k, items in groups.items():
        assert sorted(got.get(k, [])) == list(enumerate(chunking.pack_sentences([s for s in items if s])))
    assert spark.sql(sql, rows=sentences.where("id < 0")).count() == 0


def test_long_tables_take_linear_time():
    import time

    began = time.time()
    assert chunking.table_chunks("\t\n" * 400_000) == []  # blank lines are prose, and blank prose is no chunk
    assert len(chunking.table_chunks("|\n" * 400_000)) > 1_000
    assert time.time() - began < 20
