"""The engine: statements and point lookups over a catalog."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.predicates import Value, equal
from .functions.families import constant
from .plans.compiler import compile_statement
from .plans.parser import parse
from .sources.catalog import KEY, Catalog


@dataclass(frozen=True)
class EngineConfig:
    """Settings that have a counterpart in Spark; all must be positive or non-empty.

    ``memory_rows`` bounds what a sort-merge join buffers per key before it spills.
    """

    shuffle_partitions: int = 64
    memory_rows: int = 10_000
    spill_dir: str | None = None

    def __post_init__(self) -> None:
        if self.shuffle_partitions < 1 or self.memory_rows < 1:
            raise ValueError("shuffle_partitions and memory_rows must be positive")
        if self.spill_dir is not None and not self.spill_dir.strip():
            raise ValueError("spill_dir must name a folder")

    def settings(self) -> dict[str, str]:
        """Settings for ``SparkSession.builder``; ``spark.local.dir`` can't change later."""
        out = {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.ansi.enabled": "true",
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.sortMergeJoinExec.buffer.spill.threshold": str(self.memory_rows),
        }
        return out | ({"spark.local.dir": self.spill_dir} if self.spill_dir else {})


class Engine:
    """Queries over a :class:`Catalog`.  Results are lazy DataFrames."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def query(self, sql: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
        """The result of a SELECT statement; every mistake in it is a ``ValueError`` here."""
        return compile_statement(parse(sql), self.catalog, parameters or {})

    def rows(self, sql: str, parameters: Mapping[str, object] | None = None) -> list[dict]:
        """All rows as dictionaries, for small results."""
        return [r.asDict() for r in self.query(sql, parameters).collect()]

    def stream(self, sql: str, parameters: Mapping[str, object] | None = None) -> Iterator[dict]:
        """Rows one after another, a partition at a time on the driver.

        Only scans with filter, projection and LIMIT can be streamed.
        """
        statement = parse(sql)
        if not statement.streamable:
            raise ValueError("Only scan, filter, projection and LIMIT can be streamed")
        found = compile_statement(statement, self.catalog, parameters or {})
        return (r.asDict() for r in found.toLocalIterator())

    def scan(self, table: str, alias: str) -> DataFrame:
        """All rows with columns ``alias._key`` and ``alias.<column>``."""
        found = self.catalog.table(table)
        names = [KEY, *found.columns] if found.has_key else list(found.columns)
        return found.frame.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in names])

    def lookup(self, table: str, alias: str, key: object) -> dict | None:
        """The row with a key, labelled as in :meth:`scan`."""
        found = self.catalog.table(table)
        if not found.has_key:
            raise ValueError(f"{table} has no key")
        kind = found.kinds[KEY]
        value = Value(*constant(key, kind), constant=True)
        match = equal(Value(F.col(f"`{alias}.{KEY}`"), kind, required=True), value)
        row = self.scan(table, alias).where(match).limit(1).first()
        return None if row is None else row.asDict()

    def explain(self, sql: str, parameters: Mapping[str, object] | None = None) -> str:
        """Spark's formatted plan."""
        df = self.query(sql, parameters)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
