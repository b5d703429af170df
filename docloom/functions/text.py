"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jsregex as rx

#: Lines of no content.
BOILERPLATE = (
    (r"^seite\s+\d+\s*(von\s+\d+)?$", "i"),
    (r"^-\s*\d+\s*-$", ""),
    (r"^\d+\s*\/\s*\d+$", ""),
    (r"^vertraulich$", "i"),
    (r"^confidential$", "i"),
    (r"^intern$", "i"),
    (r"^propriet[äa]r$", "i"),
    (r"^alle\s+rechte\s+vorbehalten", "i"),
    (r"^©\s*\d{4}", ""),
    (r"^copyright\s+\d{4}", "i"),
    (r"^stand:\s*\d{2}\.\d{2}\.\d{4}$", "i"),
    (r"^(dokument|datei|version|revision)[-:\s]+[^\n]{0,30}$", "i"),
)
#: First characters of the patterns that start with a word.
BOILERPLATE_HEADS = ("seit", "vert", "conf", "inte", "prop", "alle", "copy", "stan", "doku", "date", "vers", "revi")
#: Share of a block's tokens that stays, by block type.
COMPRESSION = {"boilerplate": 0.7, "header": 0.8}
SPEC_VALUE = (r"[\d,]+\s*(mm|cm|m|kg|g|°C|°F|%|bar|N|kN|MPa|V|A|W|Hz|rpm|μm|±|∅)", "i")
#: Words that a boilerplate form may show.
COMMON_WORDS = (
    "seite", "von", "und", "der", "die", "das", "des", "dem", "den", "ein", "eine", "eines", "einer", "einem", "einen",
    "page", "of", "the", "and", "a", "an", "for", "in", "is", "it", "to", "with", "from", "this", "that",
    "stand", "datum", "version", "revision", "intern", "confidential", "vertraulich",
)


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once per row."""
    return F.transform(F.array(value), body).getItem(0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer neither copies nor moves filters below.

    For costly expressions that later filters and columns read in several places.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def round3(x: Column) -> Column:
    """Half-up to three decimals."""
    return F.floor(x * 1000 + 0.5) / 1000


def nbsp_to_space(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(" "))


def is_garbled(text: Column) -> Column:
    """50 or more characters, and control characters above 1 % of the first 5000."""
    sample = F.substring(text, 1, 5000)
    controls = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return (F.length(text) >= 50) & (controls > 0.01 * F.length(sample))


def tokens_by_length(text: Column) -> Column:
    """Characters by 4.2, rounded up."""
    return F.ceil(F.length(text) / 4.2).cast("long")


def tokens(text: Column, spaced: Column | None = None) -> Column:
    """Non-blank characters and half a character per word, by 4.5, rounded up; ``spaced`` is the text with plain blanks, if it is known."""
    # blanks as one blank each: what is left tells words and characters alike
    single = F.trim(F.regexp_replace(rx.spaced(text) if spaced is None else spaced, " {2,}", " "))

    def estimate(t: Column) -> Column:
        letters = F.length(F.replace(t, F.lit(" "), F.lit("")))
        words = F.when(letters > 0, F.length(t) - letters + 1).otherwise(0)
        return F.ceil((letters + words * F.lit(0.5).cast("double")) / F.lit(4.5).cast("double"))

    return F.when(F.length(text) > 0, bind(single, estimate)).otherwise(0).cast("long")


def typed_tokens(text: Column, kind: Column) -> Column:
    """Tokens by type: boilerplate and headers are compressed."""
    factor = F.lit(1.0).cast("double")
    for name, share in COMPRESSION.items():
        factor = F.when(kind == name, F.lit(share).cast("double")).otherwise(factor)
    return F.ceil(tokens(text) * factor).cast("long")


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, int(n * 4.2))


def chunk_by_tokens(text: Column, n: int) -> Column:
    """Pieces of ``n`` tokens by length."""
    width = int(n * 4.2)
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width))
    pieces = F.transform(starts, lambda i: F.substring(text, (i * width + 1).cast("int"), F.lit(width)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    """Extracted text without marks, soft hyphens, hard hyphenation, controls and runs of blanks.

    Takes text in compatibility composition (``nfkc``).
    """
    t = F.regexp_replace(text, "[�￾￿­]", "")
    t = F.regexp_replace(t, r"(\p{L})-\r?\n[\s ]*(\p{L})", "$1$2")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    t = F.regexp_replace(t, rf"[[\s{rx.SPACES}]&&[^\n]]+", " ")
    return rx.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


#: Characters that composition may change or that it may join to the one before: all but ASCII and the composed letters of Latin-1.
UNSTABLE = r"[^\x00-\x7F\xC0-\xFF]"


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; Spark has no built-in for it, so texts that it may change go to Python."""

    @F.pandas_udf("string")
    def compose(texts):
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    unstable = F.regexp_like(text, F.lit(UNSTABLE))
    return F.when(unstable, compose(F.when(unstable, text))).otherwise(text)


def is_boilerplate(line: Column) -> Column:
    """Whether a trimmed line or block is boilerplate."""
    by_flag = {f: "|".join(f"(?:{p})" for p, g in BOILERPLATE if g == f) for f in ("i", "")}
    # the patterns are anchored: most lines are told by their first characters
    head = F.lower(F.substring(line, 1, 4))
    worded = head.isin(*BOILERPLATE_HEADS) & rx.test(line, by_flag["i"], "i")
    return worded | (F.substring(line, 1, 1).isin("-", "©", *"0123456789") & rx.test(line, by_flag[""]))


def classify_block(text: Column, min_blanks: int = 3) -> Column:
    """boilerplate, header, spec_value, table_row or prose; ``min_blanks`` in a row make a table."""

    def label(t: Column) -> Column:
        header = (F.length(t) < 100) & (
            rx.test(t, r"^\d+(\.\d+)*\s+\S")
            | rx.test(t, r"^[A-ZÄÖÜ][A-ZÄÖÜ\s]{5,}$")
            | (rx.test(t, r"^[A-ZÄÖÜ]") & F.endswith(t, F.lit(":")))
        )
        table = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("|")) | F.contains(t, F.lit(" " * min_blanks))
        return (
            F.when(is_boilerplate(t), "boilerplate")
            .when(header, "header")
            .when((F.length(t) < 300) & rx.test(t, *SPEC_VALUE), "spec_value")
            .when(table, "table_row")
            .otherwise("prose")
        )

    return bind(rx.trim(text), label)


def filter_reason(text: Column) -> Column:
    """Why a chunk is rejected, null if it passes."""

    def reason(t: Column) -> Column:
        total = F.greatest(rx.dense(t), F.lit(1))
        letters = F.regexp_count(t, F.lit(r"\p{L}"))
        marks = F.regexp_count(t, F.lit(r"""[.,;:!?()\[\]{}"']"""))
        return (
            F.when(F.length(t) < 20, "too_short")
            .when(letters < 0.25 * total, "low_letter_ratio")
            .when(marks > 0.4 * total, "high_punctuation")
        )

    return bind(rx.trim(text), reason)


def split_blocks(text: Column) -> Column:
    """Trimmed non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), rx.trim), lambda b: b != "")


def normalize_line(line: Column) -> Column:
    """Lower case, single blanks, dates as DATE and numbers as N."""
    t = rx.replace(F.lower(line), r"\s+", " ")
    t = rx.replace(t, r"\b\d{1,2}[.\s]\d{1,2}[.\s]\d{2,4}\b", "DATE")
    return rx.trim(rx.replace(t, r"\b\d+\b", "N"))


def is_privacy_safe(form: Column) -> Column:
    """No word shows more than four letters unless it is a common one."""
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    letters = lambda w: F.regexp_replace(w, r"(?iu)[^a-zäöüß]", "")
    return F.forall(
        F.split(form, rx.java(r"\s+")),
        lambda w: (F.length(letters(w)) <= 4) | F.array_contains(common, F.lower(letters(w))),
    )


def suggested_regex(form: Column) -> Column:
    """An anchored pattern for a normalised line; N stands for digits."""
    escaped = F.regexp_replace(form, r"[.*+?^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("^"), rx.replace(escaped, r"\bN\b", r"\\d+"), F.lit("$"))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams."""
    n = F.length(text) - 2
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, else Jaccard of trigrams (0 if neither has any)."""
    both = F.struct(trigrams(a).alias("a"), trigrams(b).alias("b"))

    def jaccard(x: Column) -> Column:
        common = F.size(F.array_intersect(x["a"], x["b"]))
        union = F.size(x["a"]) + F.size(x["b"]) - common
        return F.when(union > 0, common / union).otherwise(0.0)

    return F.when(a == b, 1.0).otherwise(bind(both, jaccard))


def safe_ratio(a: Column, b: Column) -> Column:
    """Smaller by larger; 1 if both are 0."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def clamp(text: Column, n: int = 120, ellipsis: bool = False) -> Column:
    if not ellipsis:
        return F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def significant_words(name: Column, stop: tuple[str, ...]) -> Column:
    """Lower-case words of three letters or more that are no stop words."""
    parts = F.split(F.lower(name), r"[\s\-_.,&/]+")
    return F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def count_occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")
