"""Requirements of sections: rules that read long texts few times give what the plain rules give."""

from __future__ import annotations

import random
import re
import warnings

from pyspark.sql import functions as F

from docloom.functions import classify as C
from docloom.functions import jsregex as rx
from docloom.functions.profile import AUTOMOTIVE_DE, DECLARATIVE, FOLDED, NEARER
from docloom.operators import chunking, requirements

#: U+212A is a letter k in any case; as a capital it is none of [A-Z].
BITS = (
    "muss", "MÜSSEN", "ist", "zu", "hat", " ", "  ", "\n", "\t", " ", ".", "!", "?", ",", "5", "12", "1.5", "3,", "mm", "MPa", "°C", "%", "µm", "μm", "ΜM", "kN", "KN", "AB", "x", "-", "_", "123",
    "4567", "Rev.", "rev", "ſoll", "soll", "nicht", "NıCHT", "kann", "can", "dürfen", "may", "Die", "The", "Xa", "ä", "É", "𝒳", "shall", "must", "sollten", "SOLLTE ", " Should ", " sind zu ", "Must.", "İ",
)


def test_types_and_sentences_equal_the_plain_rules(spark):
    text = F.col("t")
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 16))) for _ in range(12000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    patterns = AUTOMOTIVE_DE.requirement_patterns
    assert set(FOLDED) | set(NEARER) == set(patterns.values())
    plain = C.ordered(list(patterns.items()), lambda _, p: rx.test(text, *p), F.lit("INFORMATIVE"))
    sentence = F.coalesce(*[F.when(plain == k, requirements._first_part(text, p)) for k, p in patterns.items()], text)
    got = rows.select(text, plain.alias("a"), C.requirement_type(text).alias("b"), sentence.alias("x"), requirements.requirement_sentence(text, plain).alias("y"))
    got = got.select("*", C.sentence_status(F.col("x")).alias("s"), rx.test(F.col("x"), r"nicht\s+muss|muss\s+nicht|nicht\s+soll|soll\s+nicht", "i").alias("n"), requirements.type_and_status(text).alias("both")).collect()
    assert [r.t for r in got if r.a != r.b or r.x != r.y or r.n != (r.s == "negated") or tuple(r.both) != (r.a, r.s)] == []
    assert {r.a for r in got} == {*patterns, "INFORMATIVE"} and sum(r.x != r.t for r in got) > 500 and sum(r.n for r in got) > 20


def test_long_texts_are_not_read_with_case_blind_patterns(spark):
    text = F.col("t")
    # one such pattern is left, of quantities, which starts with a digit or a hyphen
    assert str(C.requirement_type(text)).count("(?iu)") == 1 and NEARER[DECLARATIVE][0].startswith("[0123456789_-]")
    assert "(?iu)" not in str(C.sentence_status(text))
    assert str(requirements.type_and_status(text)).count("lower(") == 2  # the text, and the sentence that is found


def test_sections_are_slices_of_lines_and_no_fold(spark):
    lines, heads = ["A", "bcd", " Bcd ", "BCD", "", " bcd\t", "text", "x" * 160, "É11", "é11 ", "𝒳bc"], [None, [], ["A"], ["Bcd"], ["bcd", "BCD", "A"], ["x" * 160], ["abc", None, "Bcd"], ["É11", "text"], [" bcd "], ["𝒳bc"], [None]]
    rng = random.Random(9)
    rows = [(k, None if k % 50 == 7 else "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), rng.choice(heads)) for k in range(3000)]
    rows.append((3000, "\n".join(["Bcd", *["line"] * 30000, "bcd", "bcd", "end"]), ["bcd"]))

    def plain(whole, headings):
        if whole is None:
            return None
        known, heading, held, out = {h.strip().lower() for h in headings or [] if h is not None}, requirements.FIRST_SECTION, [], []
        for line in whole.split("\n"):
            t = line.strip()
            if 3 <= len(t) <= 150 and t.lower() in known:
                out += [(heading, "\n".join(held))] if held else []
                heading, held = t[:120], []
            else:
                held.append(line)
        return out + [(heading, "\n".join(held))] if held else out

    cut = requirements.sections(F.col("t"), F.col("h"))
    got = spark.createDataFrame(rows, "k int, t string, h array<string>").select("k", cut.alias("s")).collect()
    assert {r.k: r.s and [tuple(x) for x in r.s] for r in got} == {k: plain(t, h) for k, t, h in rows}
    assert "aggregate(" not in str(cut)


def test_white_space_is_told_from_printing_ascii_first(spark):
    text = F.col("t")
    spaces = f"[\\s{rx.SPACES}]"
    rows = spark.createDataFrame([(chr(k),) for k in range(0x10100) if not 0xD800 <= k < 0xE000], "t string")
    got = rows.select(text, *[F.regexp_like(text, F.lit(p)).alias(n) for n, p in zip("abcd", (rx.java(r"\s"), spaces, rx.java(r"\S"), f"[^{spaces[1:]}"))]).collect()
    assert all(r.a == r.b and r.c == r.d and r.a != r.c for r in got) and sum(r.a for r in got) == len(rx.BLANKS)
    assert rx.java(r"\s").startswith("[[^!-~]&&")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert re.compile(rx.python(chunking.SENTENCE_END), re.ASCII).search("a. B")
