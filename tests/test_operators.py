"""Scalar functions and folds against vectors, plain models and naive plans."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import jsregex as rx
from docloom.functions import paths as P
from docloom.functions import sketch
from docloom.functions import text as T
from docloom.functions.profile import PATTERNS, profile
from docloom.operators import chunking, graph, origin, projection, quality, references, report, requirements, versions
from docloom.plans import planted_queries, report_queries
from docloom.sources import files
from docloom.streaming import ingest


def evaluate(spark, value, *columns):
    """Values of expressions over one column ``x``."""
    row = spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return tuple(row) if len(columns) > 1 else row[0]


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """``X``: the column of ``evaluate``; expressions need a session."""
    global X
    X = F.col("x")


@pytest.mark.parametrize(
    "name, text, expected",
    [
        ("norm", "nach ISO 9001:2015 und", True),
        ("norm", "VDA 6.3", True),
        ("norm", "ISOLATION 12", False),
        ("norm", "ISO 9001abc", False),
        ("quality_spec", "QV 12345", True),
        ("quality_spec", "QV12", False),
        ("fikb", "FIKB-12", True),
        ("fikb", "PREFIX-FIKB-1", False),
        ("kb_master", "KB_Master Nummer: 7", True),
        ("chapter_ref", "siehe Kapitel 3.2", True),
        ("must", "Das Teil müssen wir prüfen", True),
        ("must", "ämuss", True),  # an umlaut is no word character
        ("must", "xmuss", False),
        ("quantity", "12,5 mm dick", True),
        ("quantity", "12 mmx", False),
        ("intra_corpus_id", "NOVA-SRS-001", True),
        ("requirement_id", "REQ_042", True),
        ("tolerance", "±3", True),
    ],
)
def test_patterns(spark, name, text, expected):
    assert evaluate(spark, text, rx.test(X, *PATTERNS[name])) is expected


def test_unknown_profile_is_the_default():
    assert profile("nope").id == profile().id == "automotive_de"


def test_normalize_and_classes(spark):
    assert evaluate(spark, "a­b wor-\n  d x\t\ty\n\n\n\nz\x01 ", T.normalize(X)) == "ab word x y\n\nz"
    for text, kind in (
        ("Seite 3 von 7", "boilerplate"), ("© 2024 X", "boilerplate"), ("1.2 Titel", "header"), ("WICHTIGE HINWEISE", "header"), ("Hinweis:", "header"),
        ("Druck 5 bar hier", "spec_value"), ("a\tb", "table_row"), ("Ein Satz ohne alles.", "prose"),
    ):
        assert evaluate(spark, text, T.classify_block(X)) == kind, text


def test_filter_and_tokens(spark):
    for text, reason in (("kurz", "too_short"), ("1234567890 1234567890 1", "low_letter_ratio"), ("a.b.c.d.e.f.g.h.i.j.k.!!!!!!", "high_punctuation"), ("ein ganz normaler Satz hier", None)):
        assert evaluate(spark, text, T.filter_reason(X)) == reason
    assert evaluate(spark, "", T.tokens(X)) == 0
    assert evaluate(spark, "abc defg", T.tokens(X), T.typed_tokens(X, F.lit("boilerplate")), T.typed_tokens(X, F.lit("header"))) == (2, 2, 2)
    assert evaluate(spark, "x" * 50 + "\x01" * 2, T.is_garbled(X)) is True
    assert evaluate(spark, "\x01" * 5, T.is_garbled(X)) is False


def test_dates_and_names(spark):
    assert evaluate(spark, "a_2023-04-05.pdf", P.date_in_name(X)) == datetime.date(2023, 4, 5)
    assert evaluate(spark, "a20240229b", P.date_in_name(X)) == datetime.date(2024, 2, 29)
    assert evaluate(spark, "a19990101b", P.date_in_name(X)) is None
    assert evaluate(spark, "x Stand: 3.4.2021 y", P.date_in_text(X)["date"], P.date_in_text(X)["source"]) == (datetime.date(2021, 4, 3), "stand_pattern")
    assert evaluate(spark, "Spec_v1.2_Final.docx", P.normalized_name(X)) == "spec 2 final"
    assert evaluate(spark, "in/merced benz/x/a.pdf", P.customer(P.directories(X))) == "benz"
    assert evaluate(spark, "in/BMW AG/G45/rfq/a.pdf", P.customer(P.directories(X)), P.project(P.directories(X)), P.category(P.directories(X))) == ("BMW", "G45", "rfq")
    assert evaluate(spark, "G45/quotations/a.pdf", P.customer(P.directories(X)), P.project(P.directories(X)), P.category(P.directories(X))) == ("BMW", "G45", "quotation")


def test_types_and_headings(spark):
    none = F.array().cast("array<string>")
    for name, kind in (("x fmea y.xlsx", "fmea"), ("8d_report.pdf", "8d_report"), ("8d report 1.pdf", "8d_report"), ("iso 9001.pdf", "norm"), ("plain.pdf", "other")):
        assert evaluate(spark, name, C.document_type(X, none, F.lit(""))) == kind, name
    assert evaluate(spark, "1. Scope\n1.1  Terms and\nx\n2 ab", C.numbered_headings(X)) == ["1. Scope", "1.1 Terms and"]
    assert evaluate(spark, "Intro\n" + "y" * 81 + "\nEnd.\n" + "z" * 90, C.heuristic_headings(X)) == ["Intro"]
    merged = C.merge_headings(F.array(F.lit("s")), F.array(F.lit("n"), F.lit("s")), F.array(F.lit("h")))
    assert evaluate(spark, "", merged["headings"], merged["strategy"]) == (["n", "s", "h"], "union")
    plan = C.chunk_strategy(F.lit(".pdf"), C.heading_nodes(F.array(*[F.lit(f"{k}.1.1 T") for k in range(10)])), F.lit(6), F.lit("native"))
    assert evaluate(spark, "", plan["strategy"], plan["confidence"], plan["alternative"]) == ("heading_sections", 0.8, "table_rows")
    assert evaluate(spark, "qv 123 FIKB 12", C.oem_of(X)) == "mercedes"


def test_sentences_of_requirements(spark):
    for s, status in (
        ("Das Teil muss nicht geprüft werden", "negated"),
        ("Der Lieferant muss alle Teile vor dem Versand genau prüfen", "confirmed"),
        ("er muss alle teile vor dem versand genau prüfen", "uncertain"),
        ("Der Lieferant muss prüfen", "uncertain"),
    ):
        assert evaluate(spark, s, C.sentence_status(X)) == status, s
    q = C.quantities(X)
    assert evaluate(spark, "3 mm, 4 bar und 5 mm.", q["count"], q["units"]) == (3, ["mm", "bar"])
    sections = requirements.sections(X, F.array(F.lit("A"), F.lit("Bcd")))
    assert [tuple(r) for r in evaluate(spark, "start\nbcd\nx\ny\nBCD\nz", sections)] == [("Einleitung", "start"), ("bcd", "x\ny"), ("BCD", "z")]


def test_windows_equal_the_model(spark):
    rng = random.Random(9)
    texts = ["", "x" * 511, "x" * 512, "x" * 513, "x" * 960, "x" * 961, " " * 600]
    texts += ["".join(rng.choice("abcdefg  \n\t") for _ in range(rng.randrange(1, 3000))) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: [w.content for w in r.w] for r in df.select("k", chunking.sliding_windows(F.col("t")).alias("w")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == chunking.cut_windows(t), k


def test_packing_and_tables():
    assert chunking.pack_sentences(["a" * 300, "b" * 211, "c" * 2]) == ["a" * 300 + " " + "b" * 211, "cc"]
    assert chunking.pack_sentences(["a", "b" * 600, "c"])[0] == "a"
    assert chunking.table_chunks("a|b\nc|d\nprose here\n\ne\tf") == [("a|b\nc|d", True), ("prose here", False), ("e\tf", True)]


def test_even_sample(spark):
    chunks = spark.range(250).selectExpr("id % 2 AS doc_id", "id AS chunk_index")
    kept = {r.chunk_index for r in chunking.even_sample(chunks, "fast").where("doc_id = 0").collect()}
    assert kept == {2 * (i * 125 // 30) for i in range(30)}
    assert chunking.even_sample(chunks, "full").count() == 250


def test_minhash_forms_agree(spark):
    lists = [["Scope", " Terms "], [], ["", "x"], ["äöü", "1.2 Title"]]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>")
    rows = df.select("t", sketch.minhash(F.col("t"), 16).alias("a"), sketch.minhash_column(F.col("t"), 16).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert rows[1].a == [0xFFFFFFFF] * 16
    assert list(sketch.signature(["Scope", "Terms"], 16)) == rows[0].a


def _fingerprint(i, rng, headings):
    levels = {"h1": 1, "h2": len(headings), "h3": 0, "h4_plus": 0} if headings else {"h1": 0, "h2": 0, "h3": 0, "h4_plus": 0}
    return (
        i, f"p{i % 2}/spec_{'abc'[i % 3]}_v{i}.pdf", f"spec_{'abc'[i % 3]}_v{i}.pdf", ".pdf", None, datetime.date(2020, 1, 1 + i % 28), "filename", True, 500, False, levels,
        [int(v) for v in sketch.signature(headings)], None, 0.0, 0.0,
    )


SCHEMA = (
    "doc_id long, path string, filename string, extension string, customer string, best_date date, date_source string, parse_success boolean, char_count int, numbered boolean, "
    "levels struct<h1:int,h2:int,h3:int,h4_plus:int>, signature array<long>, embedding array<float>, mandatory double, recommended double"
)


def test_blocked_pairs_equal_all_pairs(spark):
    rng = random.Random(11)
    pool = [f"Heading {k}" for k in range(12)]
    rows = [_fingerprint(i, rng, rng.sample(pool, rng.randrange(4, 9)) if i % 4 else []) for i in range(24)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: sorted((r.doc_a, r.doc_b, r.score) for r in df.collect())
    every = versions.all_pairs(docs)
    assert key(versions.high_pairs(docs)) == key(every.where("confidence = 'HIGH'"))
    assert every.where("score < 3").count() == 0 and key(versions.high_pairs(docs))


def _documents(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_fingerprints_of_all_lines(spark, tmp_path):
    line = lambda d, k: f"line {k} of text {d} with some words"
    first = [line(0, k) for k in range(8)]
    # 0 and 1 differ after line 8 alone; 4 is like 3, in another folder, with ids of both remainders
    texts = ["\n".join(first + [line(d, k) for k in range(8, 40)]) for d in (1, 2)]
    same = "\n".join(line(9, k) for k in range(20))
    rows = [(1, texts[0], "s"), (2, texts[1], "s"), (3, same, "s"), (4, same, "s"), (5, "", "s")]
    prints = {r.doc_id: r for r in report_queries._fingerprints(spark, _documents(spark, tmp_path, rows)).collect()}
    for i, text, _ in rows:
        assert prints[i].signature == [int(x) for x in sketch.signature(text.split("\n") if text else [])]
    assert set(prints[5].signature) == {sketch.EMPTY}
    alike = sum(x == y for x, y in zip(prints[1].signature, prints[2].signature)) / sketch.HASHES
    assert alike < 0.4 and prints[3].signature == prints[4].signature


def test_histogram_of_every_confidence(spark, tmp_path):
    line = lambda d, k: f"line {k} of text {d} with some words"
    rows = [(i, "\n".join(line(i % 5, k) for k in range(6 + i)), f"s{i % 2}") for i in range(24)]
    folder = _documents(spark, tmp_path, rows)
    docs = report_queries._fingerprints(spark, folder, False)
    product = versions.eligible(docs).select(F.struct("*").alias("a")).crossJoin(versions.eligible(docs).select(F.struct("*").alias("b")))
    naive = versions.score_pairs(product.where("a.doc_id < b.doc_id").where(versions._comparable())).collect()
    of = versions.classes(docs)
    pairs = versions.expand(versions.class_pairs(of), of.members).collect()
    assert sorted((r.doc_a, r.doc_b, r.score) for r in pairs) == sorted((r.doc_a, r.doc_b, r.score) for r in naive)
    assert sum(r.pairs for r in report_queries.version_pairs(spark, folder).collect()) == len(naive)
    counts = {r["range"]: r.pairs for r in report_queries.version_histogram(spark, folder).collect()}
    assert counts["3-4"] == sum(3 <= r.score <= 4 for r in naive) > 0 and counts["5-6"] == sum(5 <= r.score <= 6 for r in naive) > 0


def test_references_and_requirements_of_documents(spark, tmp_path):
    text = "Das Bauteil muss nach ISO 9001 mit 5 mm geprüft werden, siehe Kapitel 3.2 und Anlage ZX-987654."
    # ids whose plant is empty, so only the table's own text counts
    folder = _documents(spark, tmp_path, [(70, text, "s"), (78, "plain words", "s")])
    q = planted_queries
    assert {(r.doc_id, r.raw_text) for r in q.raw_references(spark, folder).collect()} >= {(70, "ISO 9001"), (70, "Anlage ZX-987654")}
    assert {r.doc_id for r in q.resolved_references(spark, folder).collect()} == {70}
    assert [r.refs for r in q.norm_families(spark, folder).collect()] == [1]
    assert {r["raw"] for r in q.canonical_norms(spark, folder).collect()} == {"ISO 9001"}
    assert {(r.doc_id, r.type) for r in q.requirement_types(spark, folder).collect() if r.t} == {(70, "MANDATORY"), (78, "INFORMATIVE")}
    assert 70 in {r.doc_id for r in q.requirements_of_sections(spark, folder).collect()}
    assert 70 in {r.doc_id for r in q.requirement_quality(spark, folder).collect()}
    assert {r.pattern: r.matches for r in q.pattern_coverage(spark, folder).collect()}["norm"] == 1


def test_text_is_composed_before_cleaning(spark):
    text = "Der ﬁnale Entwurf ｄｅｒ Anlage wiegt ５ kg und e\u0301tude.\n" * 3 + "x" * 120
    d = spark.createDataFrame([(1, text, True, "sliding_window", 0, 0), (2, None, True, "sliding_window", 0, 0)], "doc_id long, text_content string, parse_success boolean, strategy string, headings int, tables int")
    composed = {r.doc_id: r.t for r in d.select("doc_id", T.nfkc(F.col("text_content")).alias("t")).collect()}
    assert "finale Entwurf der Anlage wiegt 5 kg und étude." in composed[1] and composed[2] is None
    got = {r.doc_id: r for r in projection.project(d).collect()}
    plain = spark.createDataFrame([(1, composed[1], True, "sliding_window", 0, 0)], d.schema)
    assert got[1].after_cleaning == projection.project(plain).first().after_cleaning and got[2].raw == 0


def test_sample_has_two_of_each_type_and_the_asked_rate(spark):
    rows = [(i, 0, f"t{i % 3}", 300 if i % 5 else 100) for i in range(200)]
    taken = requirements.sample_for_validation(spark.createDataFrame(rows, "doc_id long, section int, doc_type string, chars int")).collect()
    per = {t: [r for r in taken if r.doc_type == t] for t in ("t0", "t1", "t2")}
    assert all(len(x) >= 2 for x in per.values()) and all(r.chars > 200 for r in taken)
    assert len(taken) >= 15  # a tenth of three pools of 50


def test_components(spark):
    labels = {r.node: r.label for r in graph.components(spark.createDataFrame([(1, 2), (3, 2), (8, 9), (5, 5)], "a long, b long")).collect()}
    assert labels[1] == labels[2] == labels[3] != labels[8] == labels[9]


def test_references(spark):
    docs = spark.createDataFrame([(1, "spec REQ-001 a.pdf"), (2, "anlage ab-123456.docx"), (3, "zzz.pdf")], "doc_id long, filename string")
    text = "Siehe Anlage AB-123456, REQ-001, REQ-001 und ISO 9001. Doc QQ 99999. NOVA-SRS-001."
    found = references.extract(spark.createDataFrame([(7, text)], "doc_id long, text_content string"))
    rows = {r.raw_text: r for r in references.resolve(found, docs).collect()}
    assert rows["REQ-001"].method == "exact" and rows["REQ-001"].resolved_to == 1
    assert rows["Anlage AB-123456"].resolved_to == 2
    assert rows["ISO 9001"].normalized == "ISO 9001:2015" and rows["ISO 9001"].method == "external_norm"
    assert rows["NOVA-SRS-001"].classification == "likely_missing_from_corpus" or rows["NOVA-SRS-001"].classification == "likely_matcher_failure"
    pairs = (("ISO 9001:2015", "ISO 9001:2008", False), ("ISO 9001:2015", "iso 9001:2015", True), ("ISO 9001:2015", "iso 9002", False), ("VDA 6.3", "VDA 6.1", False), ("abc", "abcd", True))
    for a, b, same in pairs:
        assert evaluate(spark, "", references.fuzzy_equal(F.lit(a), F.lit(b))) is same, (a, b)


def test_origin(spark):
    who = origin.CompanyIdentity("Acme Works GmbH", ("ACM",))
    assert who.words() == ["acme", "works", "acm"]
    found = origin.signals(who, F.split(X, "/"), F.lit("Acme, acme and ACME again"), F.lit("protokoll"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    o = origin.classify(found)
    assert evaluate(spark, "acme/x/a.pdf", o["result"], o["internal"], o["confidence"]) == ("internal", 9, "high")
    other = origin.classify(origin.signals(who, F.split(X, "/"), F.lit(""), F.lit("lastenheft"), F.lit("BMW"), F.lit("rfq")))
    assert evaluate(spark, "x/a.pdf", other["result"], other["external"], other["confidence"]) == ("external", 8, "high")


def test_quality_rules(spark):
    row = lambda *cs: evaluate(spark, "Siehe oben. Das ist gut.", *cs)
    assert row(quality.cross_reference_cut(X), quality.boundary_quality(X, F.lit("prose"))) == (0.0, 1.0)
    assert evaluate(spark, "Abschnitt 3: siehe dort", quality.cross_reference_cut(X)) == 1.0
    assert evaluate(spark, "a|b|c\nd|e|f\ng|h|i", quality.table_cut(X, F.lit("table_row"), F.lit(".docx"))) == 1.0
    assert evaluate(spark, "a\nd|e|f\ng|h|i", quality.table_cut(X, F.lit("table_row"), F.lit(".docx"))) == 0.0
    assert evaluate(spark, "a|b", quality.table_cut(X, F.lit("table_row"), F.lit(".pdf"))) is None
    assert evaluate(spark, "x", quality.content_score(X, F.lit("boilerplate"))) == 0.1


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x" * 300, ["y" * 200], ("z" * 150,))], "a string, b array<string>, c struct<d:string>")
    cut = report.clamp_strings(df).first()
    assert (len(cut.a), len(cut.b[0]), len(cut.c.d)) == (120, 120, 120)
    with pytest.raises(ValueError):
        report.leak_guard(df)
    with pytest.raises(ValueError):
        report.leak_guard(report.clamp_strings(df))  # the array's mean is above 80
    report.write_json_report({"s": spark.createDataFrame([(1, "k")], "n int, t string")}, f"{tmp_path}/r.json")
    report.write_markdown_report({"s": spark.createDataFrame([(1, "k")], "n int, t string")}, f"{tmp_path}/r.md")


def _zip(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_png", ".png"), data)
    return buffer.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>Text  here</w:t></w:r></w:p><w:tbl/></w:body></w:document>'
    docx = _zip(word__document_xml=body, docProps__core_xml="<x><dc:creator>Ann</dc:creator></x>", word__media__i_png="1")
    a, p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    slide = f'<p:sld {a} {p}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:t>Title</a:t></p:sp><p:sp><a:t>Body</a:t></p:sp></p:sld>'
    pptx = _zip(ppt__slides__slide1_xml=slide)
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/></row></sheetData></worksheet>'
    xlsx = _zip(xl__sharedStrings_xml=f"<sst {s}><si><t>a,b</t></si></sst>", xl__worksheets__sheet1_xml=sheet)
    (tmp_path / "sub").mkdir()
    for name, data in (("b.docx", docx), ("sub/c.pptx", pptx), ("d.xlsx", xlsx), ("e.docx", b"broken"), ("x.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    scanned = files.scan_folder(spark, str(tmp_path))
    rows = {r.filename: r for r in scanned.drop("content").collect()}
    assert sorted(rows) == ["b.docx", "c.pptx", "d.xlsx", "e.docx"] and rows["b.docx"].id == "doc-001"
    got = {r.id: r for r in files.parse_files(scanned).collect()}
    b, c, d, e = (got[rows[n].id] for n in ("b.docx", "c.pptx", "d.xlsx", "e.docx"))
    assert (b.text, b.headings, b.table_count, b.image_count, b.metadata["creator"]) == ("Scope Text here", ["Scope"], 1, 1, "Ann")
    assert (c.text, c.headings, c.page_count) == ("Title Body", ["Title"], 1)
    assert d.text == '"a,b",2' and e.error


def test_pdf_headings(spark):
    items = [(1, 0, "1 Introduction", 14.0, 700.0, "Bold"), (1, 1, "body text of the page that goes on", 10.0, 690.0, "Regular"), (1, 2, "more body", 10.0, 680.0, "Regular"), (1, 3, "ab", 20.0, 600.0, "Bold")]
    df = spark.createDataFrame(items, "doc_id long, index int, text string, size double, y double, font string")
    assert [r.text for r in files.pdf_headings(df).collect()] == ["1 Introduction"]
    assert evaluate(spark, "x" * 99, files.is_scanned_page(X)) and not evaluate(spark, "x" * 100, files.is_scanned_page(X))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    total = lambda df: sorted((str(r.start), r.event_type, r.events) for r in df.collect())
    assert total(spark.table("counts")) == total(ingest.event_counts(events))


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_boundaries_look_one_way_and_find_the_same(spark, monkeypatch):
    from docloom.functions import classify, jsregex
    from docloom.functions.profile import AUTOMOTIVE_DE, PATTERNS

    rules = [*PATTERNS.values(), *AUTOMOTIVE_DE.requirement_patterns.values(), *((p, "i") for _, p in classify.TYPE_BY_NAME + classify.TYPE_BY_CONTENT)]
    words = ["muss", "IST zu", "DIN EN 9001", "ISO 1:2", "1,5 mm", "6 °C.", "QV-123", "AB-CD-123", "REQ-0421", "Maß", "±", "sla", "änderungsantrag", "Doc AB 123", "\u017foll", "\u212ag", "n.i.o.", "Audi", "7 l", "EN 4102209839270622", "test report"]
    glue = ["", " ", "_", "x", "é", "1", "-", "\n", "ſ"]
    texts = [a + w + b for w in words for a in glue for b in glue] + ["".join(words), " ".join(words)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = [jsregex.java(*r) for r in rules]
    monkeypatch.setattr(jsregex, "_boundary", lambda pattern, k: jsregex.BOUNDARY)
    slow = [jsregex.java.__wrapped__(*r) for r in rules]
    assert sum(a != b for a, b in zip(fast, slow)) > 20
    assert not any(jsregex.BOUNDARY in p for p in fast[:3])  # norms, quality specifications
    same = [F.regexp_extract_all("t", F.lit(a), F.lit(0)) == F.regexp_extract_all("t", F.lit(b), F.lit(0)) for a, b in zip(fast, slow)]
    assert df.where(~F.forall(F.array(*same), lambda x: x)).collect() == []
