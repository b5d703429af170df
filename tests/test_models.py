"""Readers with a PDF library and a recogniser, model sources, the narrative report."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import narrative
from docloom.sources import files, models


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("--", "."), text)
    return out.getvalue()


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def slides(presentation):
    parts = {f"ppt/slides/slide{k}.xml": f"<p:sld {A}><a:t>text {k}</a:t></p:sld>" for k in (1, 2, 10)}
    return archive(**parts, **({"ppt/presentation.xml": presentation} if presentation else {}))


def test_order_of_slides():
    assert files.read_pptx(slides(None))["text"] == "text 1\n\ntext 2\n\ntext 10"
    assert files.read_pptx(slides("<x/>"))["text"] == "text 1\n\ntext 2\n\ntext 10"
    assert files.read_pptx(slides("ppt/slides/slide10.xml ppt/slides/slide1.xml ppt/slides/slide77.xml"))["text"] == "text 10\n\ntext 1"


def test_order_of_sheets():
    sheet = lambda v: f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    parts = {"xl/worksheets/sheet1.xml": sheet("one"), "xl/worksheets/sheet2.xml": sheet("two")}
    listed = {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet r:id="r2"/><sheet r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    }
    assert files.read_xlsx(archive(**parts))["text"] == "one\n\ntwo"
    assert files.read_xlsx(archive(**parts, **listed))["text"] == "two\n\none"


def fail(*_):
    raise OSError("no")


def test_recognised_images():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = archive(**{"word/document.xml": f"<w:document {w}><w:p><w:t>own text</w:t></w:p></w:document>", "word/media/a.png": "long", "word/media/b.png": "short"})
    said = {b"long": "recognised text of an image", b"short": "x" * 20}
    assert files.read_docx(data)["text"] == "own text"
    got = files.read_docx(data, ocr=said.get)
    assert got["text"] == "own text\n\nrecognised text of an image" and got["ocr_pages"] == 1 and got["image_count"] == 2
    assert files.read_docx(data, ocr=fail)["text"] == "own text"


ITEMS = [("1 Introduction", 14.0, 700.0, "Bold"), ("body text of the page that goes on", 10.0, 690.0, "Regular"), ("more body " * 9, 10.0, 680.0, "Regular"), ("ab", 20.0, 600.0, "Bold"), ("OVERVIEW", 14.0, 500.0, "x")]


def library(data):
    if data == b"bad":
        raise ValueError("not a PDF")
    page = files.PdfPage([files.PdfItem(*i) for i in ITEMS], images=2)
    scan = files.PdfPage([files.PdfItem("2 Heading", 30.0, 10.0, "Bold")], images=1, image=lambda: data)
    return {"Author": "A"}, [page, scan]


def test_pdf_files(spark):
    rows = [("a", ".pdf", b"image"), ("b", ".pdf", b"bad")]
    df = spark.createDataFrame(rows, "id string, extension string, content binary")
    got = {r.id: r for r in files.parse_files(df, files.readers(library, lambda image: "from the scan")).collect()}
    a = got["a"]
    assert a.text.endswith("OVERVIEW\n\nfrom the scan") and a.headings == ["1 Introduction", "OVERVIEW"]
    assert (a.page_count, a.image_count, a.scanned_ratio, a.ocr_pages, a.metadata) == (2, 3, 0.5, 1, {"Author": "A"})
    assert got["b"].error.startswith("ValueError")
    plain = files.parse_files(df, files.readers(library)).where("id = 'a'").first()
    assert plain.text.endswith("2 Heading") and plain.ocr_pages == 0
    items = spark.createDataFrame([(1, k, *i) for k, i in enumerate(ITEMS)], "doc_id long, index int, text string, size double, y double, font string")
    assert [r.text for r in files.pdf_headings(items).orderBy("index").collect()] == a.headings


def test_retries():
    calls, pauses = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert models.with_retries(flaky, 3, 1.0, pauses.append)(7) == 7
    assert pauses == [1.0, 2.0]
    with pytest.raises(OSError):
        models.with_retries(fail, 2, 1.0, pauses.append)(1)
    assert pauses == [1.0, 2.0, 1.0]


def test_embedding_source(spark):
    def model(text):
        if "bad" in text:
            raise OSError("down")
        return [float(len(text)), 1.0]

    docs = spark.createDataFrame([(k, ["x" * k]) for k in range(1, 13)] + [(13, ["bad"]), (14, [])], "doc_id long, headings array<string>").coalesce(1)
    got = {r.doc_id: r.embedding for r in models.fingerprint_embeddings(docs, model).collect()}
    assert got[3] == [13.0, 1.0] and got[10] is not None
    assert [k for k, v in got.items() if v is None] == [11, 12, 13, 14]  # the batch of the failed call
    texts = spark.createDataFrame([("a",), (None,), ("a",)], "t string")
    assert [r.embedding for r in models.embed(texts.coalesce(1), "t", model).collect()] == [[1.0, 1.0], None, [1.0, 1.0]]
    assert models.embed(texts.where("t = 'z'"), "t", model).count() == 0
    with pytest.raises(ValueError):
        models.embed(texts, "t", model, output="t")


def test_answers():
    assert models.parse_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert models.strip_fences("``` x ```") == "x"


def test_no_model_fits(spark):
    rows = [(1, 50, 8, True), (2, 30, 8, True), (3, 10, 0, False), (4, 20, 0, False)]
    df = spark.createDataFrame(rows, "id long, size long, min_memory int, validated boolean")
    ranked = [(r.id, r.recommended) for r in models.rank_models(df, False, 0.0).orderBy("rank").collect()]
    assert ranked == [(2, True), (4, False), (3, False)]
    assert [r.id for r in models.rank_models(df, True, 10.0).orderBy("rank").collect()] == [1, 2, 4, 3]
    assert models.rank_models(df.where("id < 0"), True, 1.0).count() == 0


def test_narrative(spark):
    figures = spark.createDataFrame([("documents", "", 2.0)], "metric string, key string, value double")
    seen = []

    def complete(prompt):
        seen.append(prompt)
        return {"A": "```\n" + "word " * 30 + "```", "B": "short"}.get(prompt[0]) or fail()

    text = narrative.write({"One": ("A", [figures]), "Two": ("B", [figures]), "Three": ("C", [])}, complete)
    assert text.startswith("## One\n\nword word") and text.count("No narrative") == 2 and "OSError" in text
    assert json.loads(seen[0].split("\n", 1)[1]) == [[{"metric": "documents", "key": "", "value": 2.0}]]
    long = figures.withColumn("key", F.repeat(F.lit("x"), 500))
    narrative.write({"One": ("A", [long])}, complete)
    assert "x" * 121 not in seen[-1]
