"""What the operators' Python functions share: outputs beside a table's own columns, and bounded memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a worker holds results for at a time (one text may have more).
PORTION_CHARS = 1_000_000


def quoted(name: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that have none of ``names``, in any case, as Spark resolves them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores, so that it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, made: Column, names: list[str], **more: Column) -> DataFrame:
    """The columns of ``df`` and, in place of any of the same names, ``names`` of the struct ``made`` and ``more`` made of these."""
    keep, held = others(df, [*names, *more]), unused(df, "made")
    out = df.select(*[F.col(quoted(c)) for c in keep], made.alias(held))
    out = out.select(*[F.col(quoted(c)) for c in keep], *[F.col(f"{held}.{n}") for n in names])
    return out.select(*[F.col(quoted(c)) for c in out.columns], *[column.alias(n) for n, column in more.items()])


def portions(texts: pd.Series, most: int = PORTION_CHARS) -> Iterator[pd.Series]:
    """``texts`` in order, as slices of about ``most`` characters."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield texts.iloc[begin : at + 1]
            begin, size = at + 1, 0
    if begin < len(texts):
        yield texts.iloc[begin:]


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker holds little of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
