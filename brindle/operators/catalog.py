"""Databases, tables, enum types, constraints and indexes, kept as JSON beside the tables' Parquet folders.

A table's columns have physical names of their own, so adding, dropping and renaming touch no data file: a
file that lacks a column reads as null, and a dropped column's data is never read again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import types
from brindle.errors import EngineError
from brindle.functions.fuzzy import quoted
from brindle.sources.files import Files
from brindle.types import LogicalType

CATALOG_TABLE = "column_catalog"


@dataclass
class ColumnMeta:
    name: str
    kind: LogicalType
    physical: str
    not_null: bool = False
    unique: bool = False
    primary: bool = False
    references: tuple[str, str] | None = None
    check_text: str = ""
    distinct: int | None = None
    nulls: int | None = None

    def to_json(self) -> dict:
        return self.__dict__ | {"kind": self.kind.to_json()}

    @staticmethod
    def from_json(x: dict) -> ColumnMeta:
        return ColumnMeta(**x | {"kind": LogicalType.from_json(x["kind"]), "references": tuple(x["references"]) if x["references"] else None})


@dataclass
class TableMeta:
    name: str
    columns: list[ColumnMeta]
    folder: str = ""
    version: int = 0
    made: int = 0  # columns ever made
    rows: int | None = None
    indexes: dict[str, str] = field(default_factory=dict)
    appends: int = 0  # since the files were last written as a whole
    streams: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each stream that the table has
    ends: dict = field(default_factory=dict)  # see Changes.ends
    frame: DataFrame | None = None  # of an attached table, which is read only

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(f"table '{self.name}' has no column '{name}'")

    def add(self, name: str, kind: LogicalType, **constraints) -> ColumnMeta:
        self.made += 1
        self.columns.append(ColumnMeta(name, kind, f"c{self.made}", **constraints))
        return self.columns[-1]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.physical, c.kind.spark) for c in self.columns])

    @property
    def order(self) -> list[str]:
        """Physical names of the indexed columns, by which rows are laid out."""
        return list(dict.fromkeys(self.column(c).physical for c in self.indexes.values()))

    def within(self, column: str, descending: bool, rows: int) -> str | None:
        """A value of a column, as SQL text, up to which (descending: from which) there are surely that many rows; None: not known.

        It is that of the last layout: rows added since only add to them, and whatever takes rows away lays the table out anew.
        """
        found = self.column(column)
        if self.ends.get("column") == found.physical:
            for value, upto in self.ends["high" if descending else "low"]:
                if upto >= rows:
                    return f"CAST({quoted(value)} AS {found.kind.spark.simpleString()})"
        return None

    @property
    def path(self) -> str:
        return f"{self.folder}/v{self.version}"

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [c.to_json() for c in self.columns], "folder": self.folder, "version": self.version, "made": self.made, "rows": self.rows, "indexes": self.indexes, "appends": self.appends, "streams": self.streams, "ends": self.ends}

    @staticmethod
    def from_json(x: dict) -> TableMeta:
        return TableMeta(**x | {"columns": [ColumnMeta.from_json(c) for c in x["columns"]]})


@dataclass
class Database:
    name: str
    tables: dict[str, TableMeta] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    saved: bool = True  # a database of attached tables alone leaves no file

    def table(self, name: str) -> TableMeta:
        if name not in self.tables:
            raise EngineError(f"table '{name}' does not exist")
        return self.tables[name]

    def own_table(self, name: str) -> TableMeta:
        found = self.table(name)
        if found.frame is not None:
            raise EngineError(f"table '{name}' is attached and can only be read")
        return found


class Catalog:
    """All databases under a folder; a database is loaded when it is first used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.databases: dict[str, Database] = {}
        self.current: Database | None = None

    def database(self) -> Database:
        if self.current is None:
            raise EngineError("a database must be chosen first, by 'use' or 'create database'")
        return self.current

    def create(self, name: str) -> None:
        if name in self.databases or self.files.exists(self._place(name)):
            raise EngineError(f"database '{name}' already exists")
        self.current = self.databases[name] = Database(name)
        self.save()

    def use(self, name: str) -> None:
        if name not in self.databases:
            place = self._place(name)
            if not self.files.exists(place):
                raise EngineError(f"database '{name}' does not exist")
            raw = json.loads(self.files.read(place))
            self.databases[name] = Database(name, {x["name"]: TableMeta.from_json(x) for x in raw["tables"]}, {k: tuple(v) for k, v in raw["enums"].items()})
        self.current = self.databases[name]

    def save(self, database: Database | None = None) -> None:
        """Writes a database's metadata, by default the current one's; data files are written by the statements themselves."""
        d = database or self.current
        if d is not None and d.saved:
            raw = {"tables": [x.to_json() for x in d.tables.values() if x.frame is None], "enums": {k: list(v) for k, v in d.enums.items()}}
            self.files.write(self._place(d.name), json.dumps(raw, indent=1))

    def _place(self, name: str) -> str:
        return f"{self.folder}/{name}/catalog.json"

    def sweep(self) -> None:
        """Deletes what the current database's folder has besides the tables' current versions; queries made before on older ones then fail."""
        place = f"{self.folder}/{self.database().name}"
        current = {x.folder: f"v{x.version}" for x in self.database().tables.values() if x.frame is None}
        for folder in self.files.folders(place):
            known = next((v for f, v in current.items() if f.rsplit("/", 1)[-1] == folder), None)
            if known is None:
                self.files.delete(f"{place}/{folder}")
            else:
                for version in self.files.folders(f"{place}/{folder}"):
                    if version != known:
                        self.files.delete(f"{place}/{folder}/{version}")

    # -- tables

    def attach(self, name: str, frame: DataFrame) -> None:
        """Shows a DataFrame as a read-only table of the current database."""
        columns = [ColumnMeta(f.name, types.of_spark(f.dataType), f.name) for f in frame.schema.fields]
        self.database().tables[name] = TableMeta(name, columns, frame=frame)

    def frame(self, table: TableMeta) -> DataFrame:
        if table.frame is not None:
            return table.frame
        if not self.files.exists(table.path):
            raw = self.spark.createDataFrame([], table.schema)
        else:
            raw = self.spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(table.path)
        return raw.select([F.col(c.physical).alias(c.name) for c in table.columns])

    def kind(self, name: str, args: tuple[int, ...]) -> LogicalType:
        if name == "decimal":
            return types.decimal_type(*args)
        if name in types.SIMPLE:
            return LogicalType(name)
        enums = self.database().enums
        if name in enums:
            return LogicalType("enum", enum=name, labels=enums[name])
        raise EngineError(f"unknown type '{name}'")

    def column_catalog(self) -> DataFrame:
        """One row a column of the current database; counts of values are null until ANALYZE has made them."""
        rows = []
        for table in self.database().tables.values():
            for i, c in enumerate(table.columns):
                index = next((k for k, col in table.indexes.items() if col == c.name), "")
                ref = c.references or ("", "")
                rows.append((table.name, c.name, c.kind.display, i, int(not c.not_null), int(c.unique), int(c.primary), int(c.references is not None), *ref, int(bool(c.check_text)), c.check_text, int(bool(index)), index, int(table.frame is None), table.rows, c.distinct, c.nulls))
        # The virtual table's column names, by which users query it.
        return self.spark.createDataFrame(
            rows,
            "table_name string, column_name string, type string, ordinal long, nullable long, is_unique long, is_primary_key long, is_foreign_key long, fk_ref_table string, fk_ref_column string, "
            "has_check long, check_text string, is_indexed long, index_name string, is_disk_backed long, row_count long, distinct_count long, null_count long",
        )
