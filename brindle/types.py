"""Logical column types: their names, Spark types and literals."""

from __future__ import annotations

import datetime as dt
import re
import struct
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import types as T

from brindle.errors import EngineError

#: The dialect's type names and their display spelling.
SIMPLE = ("u32", "u64", "i32", "i64", "f32", "f64", "bool", "date", "timestamp", "string8")
INTEGER_RANGES = {"u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1)}


@dataclass(frozen=True)
class LogicalType:
    """One of SIMPLE, "decimal" with precision and scale, or "enum" with its type's name and labels."""

    kind: str
    precision: int = 0
    scale: int = 0
    enum: str = ""
    labels: tuple[str, ...] = ()

    @property
    def display(self) -> str:
        if self.kind == "decimal":
            return f"decimal({self.precision},{self.scale})"
        return self.enum if self.kind == "enum" else self.kind

    @property
    def spark(self) -> T.DataType:
        return {
            "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(),
            "date": T.DateType(), "timestamp": T.TimestampNTZType(), "string8": T.StringType(), "enum": T.StringType(),
        }.get(self.kind) or T.DecimalType(self.precision, self.scale)

    @property
    def is_text(self) -> bool:
        return self.kind in ("string8", "enum")

    def to_json(self) -> dict:
        return {"kind": self.kind, "precision": self.precision, "scale": self.scale, "enum": self.enum, "labels": list(self.labels)}

    @staticmethod
    def from_json(x: dict) -> LogicalType:
        return LogicalType(x["kind"], x["precision"], x["scale"], x["enum"], tuple(x["labels"]))


def decimal_type(precision: int, scale: int) -> LogicalType:
    if not 1 <= precision <= 18 or not 0 <= scale <= precision:
        raise EngineError(f"decimal({precision},{scale}): precision must be 1 to 18 and scale at most the precision")
    return LogicalType("decimal", precision, scale)


def of_spark(kind: T.DataType) -> LogicalType:
    """The logical type that a foreign table's column is shown as."""
    if isinstance(kind, T.DecimalType):
        return LogicalType("u64") if (kind.precision, kind.scale) == (20, 0) else LogicalType("decimal", kind.precision, kind.scale)
    name = {T.ByteType: "i32", T.ShortType: "i32", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}
    return LogicalType(name.get(type(kind), "string8"))


_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
_STAMP = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}):(\d{2}):(\d{2}))?")


def parse_date(text: str) -> dt.date | None:
    """YYYY-MM-DD; days 1 to 31 of any month, a day past the month's end running on into the next."""
    m = _DATE.fullmatch(text)
    if not m or not 1 <= int(m[2]) <= 12 or not 1 <= int(m[3]) <= 31 or int(m[1]) < 1:
        return None
    return dt.date(int(m[1]), int(m[2]), 1) + dt.timedelta(days=int(m[3]) - 1)


def parse_timestamp(text: str) -> dt.datetime | None:
    m = _STAMP.fullmatch(text)
    day = parse_date(m[1]) if m else None
    if day is None:
        return None
    h, mi, s = (int(x or 0) for x in m.groups()[1:])
    return None if h > 23 or mi > 59 or s > 59 else dt.datetime(day.year, day.month, day.day, h, mi, s)


def parse_decimal(text: str, scale: int) -> Decimal | None:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    return value.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP) if value.is_finite() else None


def parse_literal(kind: LogicalType, text: str, column: str):
    """A literal of an INSERT as a Python value of the column's type."""
    k = kind.kind
    if k in INTEGER_RANGES:
        try:
            value = int(Decimal(text))
        except InvalidOperation:
            raise EngineError(f"column '{column}' takes a number, not '{text}'") from None
        low, high = INTEGER_RANGES[k]
        if not low <= value <= high:
            raise EngineError(f"column '{column}' holds {low} to {high}, not {text}")
        return Decimal(value) if k == "u64" else value
    if k in ("f32", "f64"):
        try:
            value = float(text)
        except ValueError:
            raise EngineError(f"column '{column}' takes a number, not '{text}'") from None
        return struct.unpack("f", struct.pack("f", value))[0] if k == "f32" else value
    if k == "bool":
        if text.lower() in ("true", "false"):
            return text.lower() == "true"
        return text not in ("", "0")
    if k == "date":
        found = parse_date(text)
    elif k == "timestamp":
        found = parse_timestamp(text)
    elif k == "decimal":
        found = parse_decimal(text, kind.scale)
        if found is not None and abs(found) >= Decimal(10) ** (kind.precision - kind.scale):
            raise EngineError(f"column '{column}' is {kind.display}, which has no room for {text}")
    elif k == "enum":
        if text not in kind.labels:
            raise EngineError(f"column '{column}' takes one of {', '.join(kind.labels)}, not '{text}'")
        found = text
    else:
        found = text
    if found is None:
        raise EngineError(f"column '{column}' can't read '{text}' as {k}")
    return found
