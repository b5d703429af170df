"""The documents view with sentences, headings and names that the table lacks, in Spark and in SQL.

Every document keeps its whole text; a plant, chosen by doc_id, is appended to it, so the
queries over references, requirements and headings read the table and find something.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import jsregex as rx
from docloom.functions.profile import AUTOMOTIVE_DE, PATTERNS

from .views import DOC_VIEW, doc_view, sql_trim

#: (headings, appended text, file name or none): the plants.
PLANTS = (
    (["1 Umfang", "2 Lieferung", "3.1 Versuche"], "1 Umfang\nDie Baugruppe muss nach ISO 9001 geprüft werden und darf im Betrieb nicht lecken.\n2 Lieferung\nDer Partner soll die Verpackung nach VDA 4.1 bereitstellen, siehe Kapitel 5.1.\n3.1 Versuche\nThe Partner shall run 12,5 mm of Stahl and 7 kg per part with due care.", None),
    ([], "Das Gehäuse muss nicht lackiert werden. QV 45821 gilt, FIKB-7719 auch. Anlage ZK-445566 und REQ-042.", None),
    (["B", "C", "D", "E", "F.1"], "B\nDie Toleranz beträgt 8 mm. Version 2023-11-02. ORBIT-SRS-014 und ISO-XYZ-987. Stand: 5.3.2024", "Anlage ZK-445566 v2.docx"),
    ([], "Kann man DIN EN ISO 9001:2015 oder EN 10204 nutzen? KB_Master-Nummer 77. Doc QX 90817. Revision 31.12.2019", None),
    ([], "The cover must hold. IATF 16949 applies to COMET-IRS-031 and QV-612 v3. Audi bestellt.", "FIKB-7718"),
    (["Safety"], "Safety\nAlle Teile sind sicherheitsrelevant und müssen der Norm ISO 26262:2018 mit 4 bar genügen.\nSafety\nNoch ein Abschnitt kann 6 °C haben.", None),
    ([], "", "Lastenheft 2021-02-30 FMEA.xlsx"),
    ([f"{k}.2.{k} Punkt" for k in range(1, 12)], "Kurze Zeile davor\nDiese Zeile ist mit Absicht länger als achtzig Zeichen, damit die Zeile davor als Überschrift gilt, denn nur so greift die Regel.\nDas Lastenheft und die Abweichliste nennen FIKB-7719 noch einmal.", "Abweichliste_20220715.pdf"),
)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def planted(spark, sf_dir: str):
    """``doc_view`` with planted headings, text and file names."""
    d = doc_view(spark, sf_dir)
    at = (F.col("doc_id") % len(PLANTS) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*values), at)
    none = F.array().cast("array<string>")
    headings = pick([F.array(*map(F.lit, h)) if h else none for h, _, _ in PLANTS])
    extra = pick([F.lit(t) for _, t, _ in PLANTS])
    name = F.when(F.col("doc_id") % 40 < len(PLANTS), pick([F.lit(n).cast("string") for _, _, n in PLANTS]))
    return d.withColumns(
        {"text_content": F.concat("text_content", F.lit("\n"), extra), "headings": headings, "filename": F.coalesce(name, "filename")}
    )


def _array(h: list[str]) -> str:
    return f"CAST([{', '.join(map(quote, h))}] AS VARCHAR[])"


PLANTED = f"""{DOC_VIEW}, planted AS (
  SELECT * REPLACE (text_content || chr(10) || [{', '.join(quote(t) for _, t, _ in PLANTS)}][doc_id % {len(PLANTS)} + 1] AS text_content,
    coalesce(CASE WHEN doc_id % 40 < {len(PLANTS)} THEN [{', '.join(quote(n) if n else 'NULL' for _, _, n in PLANTS)}][doc_id % {len(PLANTS)} + 1] END, filename) AS filename),
    [{', '.join(_array(h) for h, _, _ in PLANTS)}][doc_id % {len(PLANTS)} + 1] AS headings FROM doc_view)"""


def re2(p: tuple[str, str] | str, flags: str = "") -> str:
    """A pattern for RE2 without its look-aheads: in these texts the greedy match ends where they hold."""
    pattern, flags = p if isinstance(p, tuple) else (p, flags)
    pattern = pattern.replace(r"(?!\w)", "").replace(r"(?=\s|[,;.)\n\r]|$)", r"(?:\s|[,;.)]|$)")
    return rx.re2(pattern, flags)


def has(text: str, p: tuple[str, str] | str, flags: str = "") -> str:
    return f"regexp_matches({text}, {re2(p, flags)})"


def all_of(text: str, p: tuple[str, str] | str, flags: str = "") -> str:
    return f"regexp_extract_all({text}, {re2(p, flags)})"


def count(text: str, p: tuple[str, str] | str, flags: str = "") -> str:
    return f"len({all_of(text, p, flags)})"


def first(text: str, p: tuple[str, str] | str, flags: str = "", group: int = 0) -> str:
    """The first match, null if there is none."""
    return f"CASE WHEN {has(text, p, flags)} THEN regexp_extract({text}, {re2(p, flags)}, {group}) END"


def case(rules, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {otherwise} END"


def requirement_type(t: str) -> str:
    p = AUTOMOTIVE_DE.requirement_patterns
    return case([(has(t, p[k]), quote(k)) for k in ("MANDATORY", "RECOMMENDED", "PERMITTED", "DECLARATIVE")], "'INFORMATIVE'")


def requirement_category(t: str) -> str:
    kinds = ("safety", "material", "tolerance", "testing", "packaging", "delivery")
    return case([(has(t, PATTERNS[k]), quote(k.capitalize())) for k in kinds], "'Other'")


def norm_type(t: str) -> str:
    return case([(has(t, p, "i"), quote(k)) for k, p in AUTOMOTIVE_DE.norm_types], quote(AUTOMOTIVE_DE.default_norm_type))


trim = sql_trim
