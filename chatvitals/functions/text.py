"""Text columns that behave as Python's str methods do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's white space (str.isspace) and line boundaries (str.splitlines), as Java regex classes.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    """splitlines(): no empty last line after a final line end."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def any_match(c: Column, patterns) -> Column:
    """Whether any pattern is found; \\s stands for Python's white space."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns).replace(r"\s", SPACE[1:-1]))


def bigrams(c: Column) -> Column:
    """Overlapping pairs of code points inside one text."""
    # characters once, then pairs of neighbours: substring would walk the text from its start for each
    chars = F.split(c, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length(c) - 1), F.slice(chars, F.lit(2), F.length(c) - 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(c) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bits_of(values: Column, total: Column) -> Column:
    """Shannon entropy in bits of the values of an array, `total` of them; 0 for an empty one.  Runs of the sorted values are counted in the row."""
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    state = lambda last, run, sum_: F.struct(last.alias("last"), run.alias("run"), sum_.alias("sum"))
    begin = state(F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0))
    step = lambda a, x: F.when(a["last"] == x, state(x, a["run"] + 1, a["sum"])).otherwise(state(x, F.lit(1.0), a["sum"] + weight(a["run"])))
    counted = F.aggregate(F.sort_array(values), begin, step, lambda a: a["sum"] + weight(a["run"]))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - counted / total)).otherwise(F.lit(0.0))


def bigram_bits(c: Column) -> Column:
    """Entropy of the bigrams of one short text; 0 if it has none."""
    return bits_of(bigrams(c), F.greatest(F.length(c) - 1, F.lit(0)))


@F.pandas_udf(T.DoubleType())
def long_text_bits(texts: pd.Series) -> pd.Series:
    """The same for texts of any length: code points are paired and counted as numbers, in Arrow batches, as arrays of strings are slow."""
    import numpy as np

    def bits(text: str) -> float:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        if len(points) < 2:
            return 0.0
        n = np.unique(points[:-1] << np.uint64(32) | points[1:], return_counts=True)[1]
        return max(0.0, float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()))

    return texts.map(bits, na_action="ignore").astype(float)
