"""Names within an edit distance of two, by what is left when characters are deleted.

Two texts that two edits make equal have a common rest after at most two deletions from each, so
an equi-join on hashes of all rests finds every pair, and few others: a rest is nearly the
whole text, however alike the names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTANCE = 2


def rests(text: Column) -> Column:
    """array<bigint>: hashes of the text and of what any one or two deletions leave, each once."""
    n = F.length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    end = F.lit(1 << 30)
    one = lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, end))
    two = lambda i, j: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, end))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.xxhash64(two(i, j)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), F.transform(places, lambda i: F.xxhash64(one(i))), pairs))


def candidates(texts: DataFrame, names: DataFrame, text: str, name: str, by: str) -> DataFrame:
    """(text, name): pairs whose columns ``by`` have a rest in common; every pair within DISTANCE is there, each once."""
    a = texts.select(text, F.explode(rests(F.col(by))).alias("_rest"))
    b = names.select(name, F.explode(rests(F.col(by))).alias("_rest"))
    return a.join(b, "_rest").select(text, name).distinct()
