"""Tables bucketed alike by one key, so that joins between them move nothing.

All tables of a folder have the same number of buckets.  A table counts once
its line is in the folder's manifest; what a broken run has left beside it is
never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "name string, path string, columns string, key string, rows long, buckets int"


class BucketStore:
    """Named, bucketed tables below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.entries: dict[str, Row] = {r["name"]: r for r in self._committed()}
        some = next(iter(self.entries.values()), None)
        self.buckets = some["buckets"] if some else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _committed(self) -> list[Row]:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def rows(self, name: str) -> int:
        return self.entries[name]["rows"]

    def save(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Write ``df`` in buckets of ``key`` and commit it as ``name``."""
        path, table = f"{self.folder}/{name}-{uuid.uuid4().hex}", f"bucketed_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, key)
        dealt.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        saved = self.spark.table(table)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        entry = (name, path, columns, key, saved.count(), self.buckets)
        line = self.spark.createDataFrame([entry], _MANIFEST)
        line.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.entries[name] = Row(*_names())(*entry)
        return saved

    def load(self, name: str) -> DataFrame:
        """A committed table, bucketed also in a session that did not write it."""
        entry, table = self.entries[name], f"bucketed_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({entry['columns']}) USING parquet CLUSTERED BY (`{entry['key']}`) SORTED BY (`{entry['key']}`) "
            f"INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'"
        )
        return self.spark.table(table)


def _names() -> list[str]:
    return [c.split()[0] for c in _MANIFEST.split(", ")]


class KnownKeys:
    """A growing set of keys as bucketed tables of geometric sizes.

    A new table is merged with its neighbour while that is not twice as large,
    so there are at most log2(keys) tables and a key is rewritten as often.
    """

    def __init__(self, store: BucketStore, key: str):
        self.store, self.key = store, key
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, table: DataFrame, rows: int) -> None:
        self.parts.append((rows, table.select(self.key)))
        while len(self.parts) > 1 and self.parts[-2][0] < 2 * self.parts[-1][0]:
            (n, a), (m, b) = self.parts.pop(), self.parts.pop()
            merged = self.store.save(a.unionByName(b), f"known-{uuid.uuid4().hex}", self.key)
            self.parts.append((n + m, merged))

    def unknown(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is new; only ``rows`` can move."""
        for _, part in self.parts:
            rows = rows.join(part, self.key, "left_anti")
        return rows
