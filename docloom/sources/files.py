"""File scans, HTML helpers and readers of office files (standard library only)."""

from __future__ import annotations

import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.operators.graph import checkpoint

EXTENSIONS = ("docx", "xlsx", "pptx", "pdf")
#: A page of fewer characters is scanned; recognised text of an image is kept beyond this length.
SCANNED_CHARS = 100
OCR_CHARS = 20
#: A recogniser: the bytes of an image to its text.
Ocr = Callable[[bytes], str]


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with content, hash, size and times, in order of path.

    Ids are dense and ordered; they come from a sort of the paths, not of the contents.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
        .load(root)
    )
    named = files.select(
        F.col("path").alias("absolute_path"),
        F.regexp_replace("path", r"^.*/", "").alias("filename"),
        F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.col("modificationTime").alias("modified_at"),
        F.col("modificationTime").alias("created_at"),
        "content",
    )
    return named.join(dense_ids(named.select("absolute_path")), "absolute_path")


def dense_ids(paths: DataFrame) -> DataFrame:
    """(absolute_path, id): ``doc-001`` and so on in order of path.

    A distributed sort, then each partition's rows are numbered on from the rows of the
    partitions before it; only one row per partition meets in one task.
    """
    ordered = checkpoint(
        paths.orderBy("absolute_path").select(
            "absolute_path", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")
        )
    )
    parts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_p", "_first", before.alias("_before"))
    number = F.col("_before") + F.col("_m") - F.col("_first") + 1
    return ordered.join(offsets, "_p").select("absolute_path", F.format_string("doc-%03d", number).alias("id"))


def natural_order(name: Column) -> Column:
    """Sort key of a name: case does not matter, and runs of digits, whatever their length, compare as numbers."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_like(run, F.lit("^[0-9]"))
        number = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.struct((~digits).alias("word"), F.when(digits, F.length(number)).otherwise(0).alias("length"), F.when(digits, number).otherwise(run).alias("run"))

    return F.transform(runs, key)


def folder_listing(files: DataFrame, directory: str) -> DataFrame:
    """Sub-directories of ``directory`` with counts of supported files below, then its files, in natural order.

    ``directory`` is relative to the root of the paths; one that leads out of it is an error,
    one without files below has no rows.
    """
    inside = posixpath.normpath(directory or ".")
    if inside.startswith("/") or inside.split("/")[0] == "..":
        raise ValueError(f"{directory!r} is outside of the folder")
    prefix = "" if inside == "." else inside + "/"
    below = files.where(F.startswith("path", F.lit(prefix))).select(F.substring("path", len(prefix) + 1, 1 << 20).alias("rest"))
    head = F.split_part("rest", F.lit("/"), F.lit(1))
    kind = F.when(F.contains("rest", F.lit("/")), "directory").otherwise("file")
    rows = below.select(kind.alias("kind"), head.alias("name")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("files"))
    return rows.orderBy("kind", natural_order(F.col("name")), "name")


# HTML as expressions


def html_headings(html: Column) -> Column:
    """Texts of h1 to h6 without tags, three characters or more."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", ""))), lambda h: F.length(h) >= 3)


def html_tables(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<table"))


def html_text(html: Column) -> Column:
    """Tags become blanks, blanks collapse: no line breaks remain."""
    return rx.trim(rx.replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


# office files

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

RESULT = "text string, headings array<string>, table_count int, page_count int, image_count int, metadata map<string,string>, scanned_ratio double, ocr_pages int, error string"


def office_metadata(z: zipfile.ZipFile) -> dict[str, str]:
    out: dict[str, str] = {}
    fields = {
        "docProps/core.xml": (("creator", "dc:creator"), ("last_modified_by", "cp:lastModifiedBy"), ("created", "dcterms:created")),
        "docProps/app.xml": (("company", "Company"), ("pages", "Pages")),
    }
    for part, tags in fields.items():
        if part in z.namelist():
            xml = z.read(part).decode("utf-8", "replace")
            for key, tag in tags:
                m = re.search(rf"<{tag}[^>]*>([^<]+)</{tag}>", xml)
                if m:
                    out[key] = m[1].strip()
    return out


def recognised(image: bytes, ocr: Ocr | None) -> str:
    """What the recogniser reads in an image; empty if there is none or it fails."""
    if ocr is None:
        return ""
    try:
        return ocr(image) or ""
    except Exception:  # one unreadable image leaves the rest of its file
        return ""


def read_docx(data: bytes, ocr: Ocr | None = None) -> dict:
    """Text in one line, then a paragraph for every image whose recognised text is long enough."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = (name.get(f"{_W}val") if name is not None else "").lower()
        headings, texts = [], []
        for p in body.iter(f"{_W}p"):
            text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
            style = p.find(f"{_W}pPr/{_W}pStyle")
            named = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val").lower()) if style is not None else ""
            if re.fullmatch(r"heading\s*[1-6]", named) and len(text.strip()) >= 3:
                headings.append(text.strip())
            texts.append(text)
        media = [n for n in z.namelist() if re.match(r"word/media/.*\.(png|jpe?g|gif|bmp|tiff?)$", n, re.I)]
        parts = [t for t in (recognised(z.read(n), ocr) for n in media) if len(t) > OCR_CHARS] if ocr else []
        meta = office_metadata(z)
        native = re.sub(r"\s+", " ", " ".join(texts)).strip()
        return {
            "text": "\n\n".join(filter(None, [native, *parts])),
            "headings": headings,
            "table_count": sum(1 for _ in body.iter(f"{_W}tbl")),
            "page_count": int(meta.get("pages", 0)) or None,
            "image_count": len(media),
            "metadata": meta,
            "scanned_ratio": 0.0,
            "ocr_pages": len(parts),
        }


def read_pptx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        if "ppt/presentation.xml" in names:  # an order of paths that is given there goes before that of numbers
            given = re.findall(r"ppt/slides/slide\d+\.xml", z.read("ppt/presentation.xml").decode("utf-8", "replace"))
            slides = [n for n in given if n in names] or slides
        texts, headings, tables = [], [], 0
        for n in slides:
            root = ElementTree.fromstring(z.read(n))
            texts.append(" ".join(t.text for t in root.iter(f"{_A}t") if t.text))
            tables += sum(1 for _ in root.iter(f"{_A}tbl"))
            for shape in root.iter(f"{_P}sp"):
                ph = shape.find(f".//{_P}ph")
                title = "".join(t.text or "" for t in shape.iter(f"{_A}t")).strip()
                if ph is not None and ph.get("type") in ("title", "ctrTitle") and len(title) >= 3:
                    headings.append(title)
                    break
        images = {n for n in names if re.match(r"ppt/media/.*\.(png|jpe?g|gif|bmp|tiff?)$", n, re.I)}
        return {"text": "\n\n".join(texts), "headings": headings, "table_count": tables, "page_count": len(slides), "image_count": len(images), "metadata": office_metadata(z)}


def _sheets_in_order(z: zipfile.ZipFile, by_number: list[str]) -> list[str]:
    """Sheets as the workbook lists them; without such a list by number."""
    names = set(z.namelist())
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        return by_number
    target = {}
    for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        path = r.get("Target", "")
        target[r.get("Id")] = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
    listed = [target.get(x.get(f"{_R}id")) for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    return [n for n in listed if n in names] or by_number


def read_xlsx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_S}t")))
        sheets = _sheets_in_order(z, sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1])))
        parts = []
        for n in sheets:
            rows = []
            for row in ElementTree.fromstring(z.read(n)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    value = inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                    cells.append(f'"{value.replace(chr(34), chr(34) * 2)}"' if re.search(r'[",\n]', value) else value)
                if any(cells):
                    rows.append(",".join(cells))
            if rows:
                parts.append("\n".join(rows))
        return {"text": "\n\n".join(parts), "headings": [], "table_count": 0, "page_count": len(sheets), "image_count": 0, "metadata": office_metadata(z)}


@dataclass
class PdfItem:
    """A run of text on a page: size and baseline in points."""

    text: str
    size: float = 0.0
    y: float = 0.0
    font: str = ""


@dataclass
class PdfPage:
    """What a PDF library gives of a page; ``image`` renders it for a recogniser."""

    items: list[PdfItem]
    images: int = 0
    image: Callable[[], bytes] | None = None


#: A PDF library: bytes to (metadata, pages).
PdfLibrary = Callable[[bytes], tuple[dict[str, str], list[PdfPage]]]


def heading_items(items: list[PdfItem]) -> list[str]:
    """``pdf_headings`` for the items of one file."""
    sizes = sorted(i.size for i in items if i.size > 0)
    median = sizes[len(sizes) // 2] if sizes else 0.0
    out, before = [], None
    for i in items:
        t = i.text.strip()
        gap = abs(before - i.y) if before is not None else 0.0
        before = i.y
        score = (
            3 * bool(re.match(r"(\d+(\.\d+)*\.?\s+\S|(Anhang|Appendix|Anlage)\s)", t, re.I))
            + 3 * (median > 0 and i.size > 1.3 * median)
            + 2 * bool(re.search("bold|black|heavy", i.font, re.I))
            + 2 * (len(t) <= 80 and gap > 20)
            + bool(re.fullmatch(r"[A-ZÄÖÜ\s]{3,40}", t))
            + (gap > 50)
        )
        if 3 <= len(t) <= 200 and score >= 4:
            out.append(t)
    return out


def pdf_reader(library: PdfLibrary, ocr: Ocr | None = None) -> Callable[[bytes], dict]:
    """A reader of PDF files: items of a page in one line, pages as paragraphs.

    A page of few characters is scanned: it is rendered and recognised, and keeps its own
    text if that gives none; its items are no headings.
    """

    def read(data: bytes) -> dict:
        metadata, pages = library(data)
        texts, kept, scanned, ocr_pages = [], [], 0, 0
        for page in pages:
            text = re.sub(r"\s+", " ", " ".join(i.text for i in page.items)).strip()
            if len(text) < SCANNED_CHARS:
                scanned += 1
                found = recognised(page.image(), ocr) if ocr and page.image else ""
                ocr_pages += bool(found)
                texts.append(found or text)
            else:
                texts.append(text)
                kept += [i for i in page.items if i.text.strip()]
        return {
            "text": "\n\n".join(texts),
            "headings": heading_items(kept),
            "table_count": 0,
            "page_count": len(pages),
            "image_count": sum(p.images for p in pages),
            "metadata": metadata,
            "scanned_ratio": scanned / len(pages) if pages else 0.0,
            "ocr_pages": ocr_pages,
        }

    return read


#: Readers by extension that need the standard library alone.
READERS: dict[str, Callable[[bytes], dict]] = {".docx": read_docx, ".pptx": read_pptx, ".xlsx": read_xlsx}


def readers(pdf: PdfLibrary | None = None, ocr: Ocr | None = None) -> dict[str, Callable[[bytes], dict]]:
    """Readers for ``parse_files`` with a PDF library and a recogniser, where there are any."""
    table = READERS | {".docx": functools.partial(read_docx, ocr=ocr)}
    return table | {".pdf": pdf_reader(pdf, ocr)} if pdf else table


def parse_files(files: DataFrame, readers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """``files(id, extension, content)`` with text, headings, counts, metadata and error."""
    table = dict(READERS if readers is None else readers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.float64(), pa.int32(), pa.string()]
        fields = ["text", "headings", "table_count", "page_count", "image_count", "metadata", "scanned_ratio", "ocr_pages", "error"]
        for batch in batches:
            rows = []
            for ext, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    got = table[ext](content)
                    got["metadata"] = list(got["metadata"].items())
                except Exception as e:  # a broken file is a row with an error, not a failed job
                    got = {"error": f"{type(e).__name__}: {e}"[:120]}
                rows.append(got)
            columns = [pa.array([r.get(f) for r in rows], k) for f, k in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *fields])

    return files.select("id", "extension", "content").mapInArrow(run, f"id string, {RESULT}")


def pdf_headings(items: DataFrame) -> DataFrame:
    """(doc_id, index, text) of text items that score 4 or more as headings.

    ``items(doc_id, index, text, size, y, font)``: numbered or appendix 3, 1.3 times the
    median size 3, bold font 2, up to 80 characters and a gap over 20 2, capitals 1, gap over 50 1.
    """
    w = W.partitionBy("doc_id")
    counted = items.where("size > 0").groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(w.orderBy("size"))
    reached = counted.select("doc_id", "size", upto.alias("_upto"), F.floor(F.sum("_k").over(w) / 2).alias("_half")).where("_upto > _half")
    middle = reached.groupBy("doc_id").agg(F.min("size").alias("_median"))
    gap = F.abs(F.lag("y").over(w.orderBy("index")) - F.col("y"))
    t = rx.trim(F.col("text"))
    rows = items.join(middle, "doc_id", "left").withColumns({"_gap": F.coalesce(gap, F.lit(0.0)), "_t": t})
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    score = (
        points(rx.test(F.col("_t"), r"^(\d+(\.\d+)*\.?\s+\S|(Anhang|Appendix|Anlage)\s)", "i"), 3)
        + points(F.col("size") > 1.3 * F.col("_median"), 3)
        + points(rx.test(F.col("font"), r"bold|black|heavy", "i"), 2)
        + points((F.length("_t") <= 80) & (F.col("_gap") > 20), 2)
        + points(rx.test(F.col("_t"), r"^[A-ZÄÖÜ\s]{3,40}$"), 1)
        + points(F.col("_gap") > 50, 1)
    )
    return rows.where(F.length("_t").between(3, 200) & (score >= 4)).select("doc_id", "index", F.col("_t").alias("text"))


def is_scanned_page(text: Column) -> Column:
    return F.length(rx.trim(text)) < SCANNED_CHARS


def embedding_input(headings: Column, max_tokens: int = 300) -> Column:
    """What a document is embedded from: its first fifty headings."""
    text = F.concat(F.lit("HEADINGS: "), F.array_join(F.slice(headings, 1, 50), " | "))
    return F.substring(text, 1, int(max_tokens * 4.2))


def parse_model_json(text: Column, schema: str) -> Column:
    """JSON of a model's answer, code fences removed."""
    return F.from_json(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)
