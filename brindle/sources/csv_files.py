"""CSV import and export.

Import infers column types from the header and at most the next 255 lines: digits are u32, or u64 beyond it; digits with a point
f32 where that keeps the value, else f64; all else is text.  Mixed columns are text, but for u32 with u64 and f32
with f64.  Empty fields are null.  The whole file is then read in parallel: a column with a cell further down that its type can't hold
becomes u64 where that holds all of them, else text, so that no cell is lost.
"""

from __future__ import annotations

import csv
import re
import struct
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import EngineError
from brindle.types import LogicalType

#: Fixed value: lines that inference looks at, the header included.
SAMPLE_LINES = 256

_WHOLE, _POINT = re.compile(r"\d+"), re.compile(r"\d*\.\d+|\d+\.\d*")


def cell_kind(cell: str) -> str | None:
    """u32, u64, f32, f64 or string8; None for an empty cell."""
    text = cell.strip()
    if not text:
        return None
    if _WHOLE.fullmatch(text):
        n = int(text)
        return "u32" if n < 2**32 else "u64" if n < 2**64 else "string8"
    if _POINT.fullmatch(text):
        x = float(text)
        try:
            return "f32" if struct.unpack("f", struct.pack("f", x))[0] == x else "f64"
        except OverflowError:
            return "f64"
    return "string8"


def joined_kind(a: str | None, b: str | None) -> str | None:
    if a is None or a == b:
        return b
    if b is None:
        return a
    for pair in (("u32", "u64"), ("f32", "f64")):
        if {a, b} == set(pair):
            return pair[1]
    return "string8"


def inferred(lines: list[str]) -> list[tuple[str, LogicalType]]:
    rows = list(csv.reader(lines))
    if not rows or not rows[0]:
        raise EngineError("the file has no header")
    names = [x.strip() for x in rows[0]]
    if len(set(names)) < len(names):
        raise EngineError("the file's header names a column twice")
    kinds: list[str | None] = [None] * len(names)
    for row in rows[1:]:
        for i, cell in enumerate(row[: len(names)]):
            kinds[i] = joined_kind(kinds[i], cell_kind(cell))
    return [(n, LogicalType(k or "string8")) for n, k in zip(names, kinds, strict=True)]


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, LogicalType]]]:
    """The file's rows, and its columns with their inferred types."""
    head = [r.value for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]
    columns = inferred(head)
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` STRING" for n, _ in columns), quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    text = {n: F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n, _ in columns}
    tried = [(n, kind) for n, k in columns if k.kind != "string8" for kind in dict.fromkeys([k.kind, *(["u64"] if k.kind == "u32" else [])])]
    if tried:
        lost = raw.agg(*[F.count_if(text[n].isNotNull() & ~fitting(text[n], LogicalType(kind))).alias(f"{i}") for i, (n, kind) in enumerate(tried)]).first()
        fits = [x for i, x in enumerate(tried) if not lost[i]]
        columns = [(n, k if k.kind == "string8" else LogicalType(next((kind for m, kind in fits if m == n), "string8"))) for n, k in columns]
    return raw.select([(text[n] if k.kind == "string8" else text[n].try_cast(k.spark)).alias(n) for n, k in columns]), columns


def fitting(text: Column, kind: LogicalType) -> Column:
    """Whether a cell is a value of a type; whole numbers have digits alone."""
    fits = text.try_cast(kind.spark).isNotNull()
    if kind.kind in ("u32", "u64"):
        return F.coalesce(fits & F.trim(text).rlike(r"^\d+$") & (text.try_cast("decimal(38,0)") < F.lit(Decimal(2 ** (32 if kind.kind == "u32" else 64)))), F.lit(False))
    return fits


def write_csv(frame: DataFrame, path: str) -> None:
    """A folder of CSV files with headers: numbers with fractions have six digits, dates and times are ISO, nulls are empty."""
    out = []
    for name, kind in frame.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            c = F.format_string("%.6f", c.cast("double"))
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    frame.select(out).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""')
