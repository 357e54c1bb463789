"""Line differences of two texts as array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Beyond so many cells all old lines go and all new lines come.
MOST_CELLS = 4_000_000
OPS = ArrayType(StructType([StructField("op", StringType()), StructField("line", StringType())]))


def line_ops(old: str, new: str) -> list[tuple[str, str]]:
    """(op, line) with op ` `, `-` or `+`: a longest common subsequence of lines between common ends."""
    a, b = old.split("\n"), new.split("\n")
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - head
    tail = next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    same = lambda lines: [(" ", x) for x in lines]
    return same(a[:head]) + _middle(mid_a, mid_b) + same(a[len(a) - tail :])


def _middle(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    if not a or not b or len(a) * len(b) > MOST_CELLS:
        return [("-", x) for x in a] + [("+", x) for x in b]
    # best[i, j]: length of the common subsequence of a[i:] and b[j:], a row at a time
    code = {x: k for k, x in enumerate(dict.fromkeys(a + b))}
    ca, cb = [code[x] for x in a], np.array([code[x] for x in b])
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        met = np.where(cb == ca[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(met[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out + [("-", x) for x in a[i:]] + [("+", x) for x in b[j:]]


@F.pandas_udf(OPS)
def diff_ops(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """array<struct<op, line>> of two text columns; null counts as empty."""
    for old, new in batches:
        yield pd.Series([[{"op": o, "line": x} for o, x in line_ops(a or "", b or "")] for a, b in zip(old, new, strict=True)])


def diff_stat(ops: Column) -> Column:
    """struct<added, removed>: numbers of lines."""
    count = lambda op: F.size(F.filter(ops, lambda x: x["op"] == op)).cast("long")
    return F.struct(count("+").alias("added"), count("-").alias("removed"))
