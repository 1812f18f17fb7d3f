"""Tables whose changes are conditional: versions, one committed after another, that refuse what was overtaken.

A table is a folder with data folders and a log. A writer reads a version, writes the next one's data
and commits it by creating the log's next entry, which names the data and cannot be created twice: of
two writers that read the same version one fails with :class:`Conflict` and changes nothing. Readers
see committed versions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.operators.reads import open_sort_key
from gleaner.sources.lists import snapshot_hash


class Conflict(RuntimeError):
    """A change that another one has overtaken, or that does not meet what it expects."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, *key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of commits."""
        fs, log = self._file("log")
        return len(fs.listStatus(log)) if fs.exists(log) else 0

    def _data(self, version: int) -> str:
        fs, p = self._file(f"log/{version:08d}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._data(at)}") if at else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, read: int) -> int:
        """Make ``rows`` the version after ``read``."""
        name = f"data-{uuid.uuid4().hex}"
        rows.select(*self.read(0).columns).write.parquet(f"{self.path}/{name}")
        fs, entry = self._file(f"log/{read + 1:08d}")
        try:
            out = fs.create(entry, False)
        except Exception as e:
            fs.delete(self._file(name)[1], True)
            raise Conflict(f"version {read + 1} was committed by another writer") from e
        out.write(bytearray(name.encode()))
        out.close()
        return read + 1

    def _matching(self, rows: DataFrame, how: str, now: DataFrame) -> DataFrame:
        return now.join(rows.select(*self.key).distinct(), self.key, how)

    def upsert(self, rows: DataFrame) -> int:
        """Rows in the place of those with their keys; ``rows`` has each key once."""
        at = self.version()
        return self.commit(self._matching(rows, "left_anti", self.read(at)).unionByName(rows.select(*self.read(0).columns)), at)

    def insert(self, rows: DataFrame) -> int:
        """New rows; a key that is there already, or twice, is a conflict and nothing is written."""
        at = self.version()
        now = self.read(at)
        if self._matching(rows, "left_semi", now).limit(1).count() or rows.groupBy(*self.key).count().where("count > 1").limit(1).count():
            raise Conflict("a key is there already")
        return self.commit(now.unionByName(rows.select(*now.columns)), at)

    def update(self, changes: DataFrame, observed: list[str]) -> DataFrame:
        """Change rows whose ``observed`` columns are still as ``changes`` has seen them (``seen_<column>``).

        Returns the keys of ``changes`` with ``applied``; a row that has moved on, or gone, stays as it is.
        """
        at = self.version()
        now = self.read(at)
        values = [c for c in now.columns if c not in self.key and c in changes.columns]
        seen = changes.select(*self.key, *(f"seen_{c}" for c in observed), *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_asked"))
        both = now.join(seen, self.key, "left")
        same = F.coalesce(F.col("_asked"), F.lit(False))
        for c in observed:
            same = same & F.col(c).eqNullSafe(F.col(f"seen_{c}"))
        both = both.withColumn("_applied", same)
        self.commit(both.select(*self.key, *(F.when(F.col("_applied"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in now.columns if c not in self.key)), at)
        done = both.where("_applied").select(*self.key, F.lit(True).alias("applied"))
        return changes.select(*self.key).join(done, self.key, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))

    def delete(self, rows: DataFrame, *by: str) -> int:
        """Without the rows that agree with ``rows`` on ``by`` (the key if none): all rows of a user, for instance."""
        at = self.version()
        on = list(by) or self.key
        return self.commit(self.read(at).join(rows.select(*on).distinct(), on, "left_anti"), at)

    def dry_run(self, wrong: Column, fields: list[str]) -> tuple[int, str]:
        """How many rows a repair would touch, and a token over their key and ``fields``."""
        return _marks(self.read().where(wrong), self.key, fields)

    def repair(self, wrong: Column, repaired: dict[str, Column], fields: list[str], count: int, token: str) -> int:
        """Repair the rows for which ``wrong`` holds, if they are still those of the dry run."""
        at = self.version()
        now = self.read(at)
        found = _marks(now.where(wrong), self.key, fields)
        if found != (count, token):
            raise Conflict(f"expected {count} rows with token {token}, found {found[0]} with {found[1]}")
        return self.commit(now.withColumns({k: F.when(wrong, v).otherwise(F.col(k)) for k, v in repaired.items()}), at)


def _marks(rows: DataFrame, key: list[str], fields: list[str]) -> tuple[int, str]:
    named = rows.select(F.lit(0).alias("_all"), F.concat_ws("|", *key).alias("_key"), *fields)
    hashed = snapshot_hash(named, "_all", "_key", *fields).select("content_hash").first()
    return rows.count(), hashed[0] if hashed else ""


def index_keys(technical: Column, is_open: Column, is_baseline: Column, visible_at: Column, last_seen: Column, key: Column) -> dict[str, Column]:
    """The sparse index keys of a job: open or closed ones, none for a job that is known to be untechnical."""
    listed = F.coalesce(technical, F.lit(True))
    opened, closed = listed & is_open, listed & ~is_open
    return {
        "open_pk": F.when(opened, "OPEN"),
        "open_sk": F.when(opened, open_sort_key(is_baseline, visible_at, key)),
        "closed_pk": F.when(closed, "CLOSED"),
        "closed_sk": F.when(closed, F.concat_ws("#", F.date_format(last_seen, "yyyy-MM-dd'T'HH:mm:ss"), key.cast("string"))),
    }


def index_mismatch(keys: dict[str, Column], technical: Column, is_open: Column) -> Column:
    """The kind of a row whose stored index keys are not those it should have; null if they are."""
    same = F.lit(True)
    for name, wanted in keys.items():
        same = same & F.col(name).eqNullSafe(wanted)
    kind = F.when(~F.coalesce(technical, F.lit(True)), "nontechnical").when(is_open, "openTechnical").otherwise("closedTechnical")
    return F.when(~same, kind)
