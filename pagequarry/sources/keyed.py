"""A keyed table that batches change by rewriting only the buckets they touch.

Rows lie in hash buckets of about ``bucket_rows`` rows.  A batch reads the
buckets of its own keys, writes them anew beside the old ones and commits a
manifest of where each bucket lies now, so its work follows its keys and not
the batches before it.  When the buckets have grown full, their number doubles
and all rows are written once: a row is rewritten as often as the table has
doubled.  A batch that is tried again replaces its own manifest only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "key_bucket int, path string, n_rows long, n_buckets int"


class KeyedTable:
    """Rows of ``columns`` (a DDL list) by ``keys`` below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, keys: list[str], bucket_rows: int = 200_000, buckets: int = 16):
        self.spark, self.folder, self.columns, self.keys = spark, folder, columns, keys
        self.bucket_rows, self.first_buckets = bucket_rows, buckets

    def _manifest(self, batch_id: int) -> dict[int, tuple[str, int]]:
        """Where each bucket lay after this batch; nothing before the first."""
        self.n_buckets = self.first_buckets
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/batch={batch_id}").collect()
        self.n_buckets = rows[0]["n_buckets"]
        return {r["key_bucket"]: (r["path"], r["n_rows"]) for r in rows if r["path"]}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def _rows(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.columns)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], self.columns)

    def _write(self, rows: DataFrame) -> dict[int, tuple[str, int]]:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.withColumn("key_bucket", self._bucket()).repartition("key_bucket").write.partitionBy("key_bucket").parquet(path)
        try:
            counts = self.spark.read.parquet(path).groupBy("key_bucket").count().collect()  # one row per bucket that was touched
        except AnalysisException as empty:
            if empty.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            counts = []
        return {r["key_bucket"]: (f"{path}/key_bucket={r['key_bucket']}", r["count"]) for r in counts}

    def touched(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows, as of the batch before, of the buckets that hold the batch's keys."""
        self._before = self._manifest(batch_id - 1)
        self._touched = [r[0] for r in batch.select(self._bucket()).distinct().collect()]  # at most the number of buckets
        paths = [self._before[b][0] for b in self._touched if b in self._before]
        self.rows_read = sum(self._before[b][1] for b in self._touched if b in self._before)
        return self._rows(paths)

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        """Put ``rows`` in the place of the touched buckets."""
        after = {b: at for b, at in self._before.items() if b not in set(self._touched)} | self._write(rows)
        if sum(n for _, n in after.values()) > self.n_buckets * self.bucket_rows:
            whole = self._rows([path for path, _ in after.values()])
            self.n_buckets *= 2
            after = self._write(whole)
        lines = [(b, path, n, self.n_buckets) for b, (path, n) in after.items()] or [(-1, None, 0, self.n_buckets)]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched buckets by ``merge(their rows, batch)``."""
        self.commit(merge(self.touched(batch, batch_id), batch), batch_id)

    def rows(self) -> DataFrame:
        """The whole table as of the last committed batch."""
        last = self.spark.read.parquet(f"{self.folder}/manifest").agg(F.max("batch")).first()[0]
        return self._rows([path for path, _ in self._manifest(last).values()])
