"""Regular expressions with ECMAScript meaning for Spark (Java) and for the SQL oracle (RE2).

Rule tables are written once with the ECMAScript meaning of ``\\b`` (ASCII word
characters), ``\\s`` (with no-break and other Unicode spaces) and the ``i`` flag (folds
all letters).  ``java`` and ``re2`` translate.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
#: An ASCII word boundary: Java's own looks at all letters.
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: White space of ECMAScript beyond ASCII.
SPACES = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: All of it; Java tries the ranges of a class one by one, so that printing ASCII is told apart first.
SPACE, NO_SPACE = f"[[^!-~]&&[\\s{SPACES}]]", f"[!-~[^\\s{SPACES}]]"


#: The same where a word character must follow, and where one must go before: one look in place of four.
BEFORE_WORD, AFTER_WORD = f"(?<!{_WORD})", f"(?!{_WORD})"
_PLAIN = re.compile(r"[A-Za-z0-9_ÄÖÜäöüß\\\s+*?-]+")
#: What surely starts and ends with a word character: a digit, a literal, a group of one of them.
_STARTS = re.compile(r"\\d(?![*?{])|[A-Za-z0-9_](?![*?{])|\((?:\?:)?\\d\+?(?:\(\?:[^()|]*\)\?)?\)(?![*?{])|\(\[A-Z\]\{[1-9][\d,]*\}\)(?![*?{])")
_ENDS = re.compile(r"(?:(?<!\\)[A-Za-z0-9_]|\\d(?:\{[1-9][\d,]*\}|\+)?|\((?:\?:)?\\d(?:\{[1-9][\d,]*\}|\+)?\))$")


def _boundary(pattern: str, k: int) -> str:
    """What the ``\\b`` at ``k`` is, told by what stands beside it; a group's alternatives all have to tell the same."""
    before, after = pattern[:k], pattern[k + 2 :]
    group = re.match(r"\((?:\?:)?([^()\[\]]+)\)(?![*?{])", after)
    if _STARTS.match(after) or group and all(_STARTS.match(x) and _PLAIN.fullmatch(x) for x in group[1].split("|")):
        return BEFORE_WORD
    group = re.search(r"\((?:\?:)?([^()\[\]]+)\)$", before)
    if _ENDS.search(before) or group and all(_ENDS.search(x) and _PLAIN.fullmatch(x) for x in group[1].split("|")):
        return AFTER_WORD
    return BOUNDARY


@cache
def java(pattern: str, flags: str = "") -> str:
    """The pattern for Java's engine; flags: i, m, s."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            pair = pattern[k : k + 2]
            if pair == "\\b" and not in_class:
                pair = _boundary(pattern, k) if "i" in flags else _boundary(pattern, k).replace(_WORD, "\\w")  # the i flag leaves \w to ASCII
            elif pair == "\\s":
                pair = f"\\s{SPACES}" if in_class else SPACE
            elif pair == "\\S" and not in_class:
                pair = NO_SPACE
            out.append(pair)
            k += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "[":
            c = "\\["
        elif c == "]":
            in_class = False
        out.append(c)
        k += 1
    inline = "".join(f for f in "ims" if f in flags)
    inline += "u" if "i" in flags else ""
    return (f"(?{inline})" if inline else "") + "".join(out)


def python(pattern: str) -> str:
    """The pattern for Python's engine, which has no intersections of classes; no flags, no ``\\S`` outside of classes."""
    return java(pattern).replace(SPACE, f"[\\s{SPACES}]")


def re2(pattern: str, flags: str = "") -> str:
    """A SQL literal of the pattern for RE2 (no look-around, no back-references)."""
    inline = "".join(f for f in "ims" if f in flags)
    return "$rx$" + (f"(?{inline})" if inline else "") + pattern + "$rx$"


def test(text: Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern occurs in the text."""
    return F.regexp_like(text, F.lit(java(pattern, flags)))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(text, F.lit(java(pattern, flags)))


def find_all(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(group))


def first(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """The first match or one of its groups, null if there is none."""
    return F.when(test(text, pattern, flags), F.regexp_extract(text, java(pattern, flags), group))


def replace(text: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(text, java(pattern, flags), to)


#: The white space of ECMAScript, character by character.
BLANKS = " \t\n\x0b\x0c\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def dense(text: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(text, java(r"\s+"), ""))


def spaced(text: Column) -> Column:
    """The text with a plain blank for every white space: patterns of blanks are then simple ones."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def trim(text: Column) -> Column:
    """Trim of all ECMAScript white space; only the ends are looked at."""
    return F.btrim(text, F.lit(BLANKS))


#: Letters that the i flag takes for plain ones though lower case keeps them apart.
_ODD, _EVEN = "\u0130\u017f\u0131", "isi"


def even(text: Column) -> Column:
    """The text with plain letters for those that the i flag takes for plain ones; few texts have any."""
    odd = F.contains(text, F.lit(_ODD[0]))
    for c in _ODD[1:]:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.translate(text, _ODD, _EVEN)).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case in which a lower-case word stands wherever the i flag finds it in the text."""
    return F.lower(even(text))


def may_hit(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the folded text: a plain search, far cheaper than a pattern that needs one of them."""
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out
