"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from docloom.plans import registry

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert got == expected


#: Queries without SQL: each is compared with plain Python below.
PLAIN = {"semantic_chunks", "mixed_chunks", "mixed_chunks_in_sql", "packed_chunks_in_sql"}


def test_every_query_is_compared():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) | PLAIN


def windows_of(text):
    out, start = [], 0
    while start < len(text):
        end = start + 512
        if end >= len(text):
            end = len(text)
        elif text[end] not in " \n\t":
            for back in range(end - 1, end - 31, -1):
                if text[back] in " \n\t":
                    end = back + 1
                    break
        if text[start:end].strip():
            out.append(text[start:end])
        if start + 512 >= len(text):
            break
        start += 448
    return out


def sentences_of(text):
    return [s.strip() for p in re.split(r"\n{2,}", text) for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", p.strip()) if s.strip()]


def packed(text):
    chunks, held = [], []
    for s in sentences_of(text):
        if len(s) > 512 or len(" ".join([*held, s])) > 512:
            chunks += [" ".join(held)] if held else []
            held = []
        if len(s) > 512:
            chunks += windows_of(s)
        else:
            held.append(s)
    return chunks + ([" ".join(held)] if held else [])


def tabular(text):
    chunks, run, was = [], [], False

    def close():
        joined = "\n".join(run)
        if was and run:
            chunks.append(joined)
        elif joined.strip():
            chunks.extend(windows_of(joined.strip()))
        run.clear()

    for line in text.split("\n"):
        now = bool(line.strip()) and bool(re.search(r"\t|\||\s{3,}", line))
        if now != was:
            close()
            was = now
        run.append(line)
        if was and len("\n".join(run)) >= 512:
            close()
    close()
    return chunks


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_chunks_equal_plain_python(spark, duck, name):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {}
    for r in registry.QUERIES[name](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    kinds = [packed, tabular, windows_of, packed]  # .docx .xlsx .pptx .pdf
    for i, text in texts.items():
        expected = (kinds[i % 4] if name.startswith("mixed") else packed)(text)
        assert [c for _, c in sorted(got.get(i, []))] == expected, i
