"""The dialect's syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Column:
    name: str
    table: str | None = None


@dataclass
class Number:
    text: str


@dataclass
class Text:
    value: str


@dataclass
class Bool:
    value: bool


@dataclass
class Null:
    pass


@dataclass
class Star:
    pass


@dataclass
class Over:
    partition: list[Column]
    order: list[OrderItem]


@dataclass
class Call:
    name: str
    args: list
    over: Over | None = None


@dataclass
class Compare:
    op: str
    left: object
    right: object


@dataclass
class Logic:
    op: str
    parts: list


@dataclass
class IsNull:
    what: object
    negated: bool


@dataclass
class InList:
    what: object
    items: list
    negated: bool


@dataclass
class InSelect:
    what: object
    select: Select
    negated: bool


@dataclass
class Exists:
    select: Select
    negated: bool


@dataclass
class Scalar:
    select: Select


@dataclass
class Item:
    what: object
    alias: str | None = None


@dataclass
class OrderItem:
    what: object
    descending: bool = False


@dataclass
class Source:
    """A table by name, or a derived table."""

    table: str | None
    select: Select | None
    alias: str | None
    join: str = ""
    on: object = None

    @property
    def name(self) -> str:
        return self.alias or self.table or ""


@dataclass
class Select:
    items: list[Item]
    sources: list[Source]
    where: object = None
    group: list[Column] = field(default_factory=list)
    having: object = None
    order: list[OrderItem] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, Select]] = field(default_factory=list)


@dataclass
class ColumnDef:
    name: str
    kind: str
    args: tuple[int, ...] = ()
    not_null: bool = False
    unique: bool = False
    primary: bool = False
    references: tuple[str, str] | None = None
    check: object = None
    check_text: str = ""


@dataclass
class Statement:
    """Any statement but SELECT: its kind and its parts by name."""

    kind: str
    parts: dict
