"""Tables kept in buckets of their key, of which an update rewrites only the buckets that it touches.

Files lie under ``version=<n>/bucket=<b>``: each update writes the touched buckets into a folder of its own, which counts
from the moment it is written in full, and the newest version of a bucket is its content. So readers of an older state are not
disturbed, an update that breaks off leaves the table as it was, and one that runs again gives the same rows.

The table is registered with Spark as partitioned by ``bucket`` and clustered by the key into as many buckets, with every
partition at the place of its newest version. Spark then knows how the rows lie: joins and aggregations on the key
don't move them, and a selection of buckets reads no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobmetrics.operators import state

BUCKET = "bucket"
#: Choose so many that a bucket fits a task; it is fixed for the life of a table.
BUCKETS = 64
#: Rows of a page: what is read of each column for one key of a sorted bucket.
PAGE_ROWS = 1000
#: Up to so many keys are looked for one by one.
FEW_KEYS = 200


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], buckets: int = BUCKETS, before: int | None = None):
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if BUCKET in schema.names:
            raise ValueError(f"a column may not be called {BUCKET}")
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.name = f"bucketed_{uuid.uuid4().hex}"
        self._create(self.name, self.path)
        self._places: dict[int, int] = {}
        self.at(before)

    def at(self, before: int | None = None) -> BucketedTable:
        """Show the state before a version, or the newest one."""
        wanted = self.newest(before)
        gone = sorted(b for b, version in self._places.items() if wanted.get(b) != version)
        new = sorted(wanted.items() - self._places.items())
        # The table's files are its own matter: dropping a partition leaves them where they are.
        if gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS " + ", ".join(f"PARTITION ({BUCKET}={b})" for b in gone))
        if new:
            places = (f"PARTITION ({BUCKET}={b}) LOCATION '{self.path}/version={version}/{BUCKET}={b}'" for b, version in new)
            self.spark.sql(f"ALTER TABLE {self.name} ADD " + " ".join(places))
        self._places = wanted
        return self

    def close(self) -> None:
        """Forget the definition; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def bucket_of(self) -> Column:
        """The bucket that Spark puts a key into."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias(BUCKET)

    def _create(self, name: str, path: str) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, {BUCKET} int) USING parquet "
            f"OPTIONS ('parquet.page.row.count.limit'='{PAGE_ROWS}') PARTITIONED BY ({BUCKET}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _glob(self, pattern: str) -> list[str]:
        """Paths below the table's folder."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(hadoop.Path(f"{self.path}/{pattern}")) or []
        return [f.getPath().toString() for f in found]

    def versions(self) -> list[int]:
        """Versions written in full, oldest first."""
        return sorted(int(p.split("version=")[-1].split("/")[0]) for p in self._glob("version=*/_SUCCESS"))

    def newest(self, before: int | None = None) -> dict[int, int]:
        """The newest version of each bucket (before a given one); buckets without rows are missing."""
        done, out = {v for v in self.versions() if before is None or v < before}, {}
        for p in self._glob(f"version=*/{BUCKET}=*"):
            version, bucket = (int(part.split("=")[1]) for part in p.split("/")[-2:])
            if version in done:
                out[bucket] = max(out.get(bucket, -1), version)
        return out

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, without a shuffle where rows are joined or grouped by the key."""
        table = self.spark.table(self.name)
        if buckets is not None:
            table = table.where(F.col(BUCKET).isin(*buckets) if buckets else F.lit(False))
        return table.select(*self.schema.names)

    def near(self, rows: DataFrame) -> DataFrame:
        """Rows of the buckets that the keys of ``rows`` fall into; of few keys, only the pages that can hold them."""
        keys = rows.select(self.keys[0], self.bucket_of()).distinct().limit(FEW_KEYS + 1).collect()
        if len(keys) > FEW_KEYS:  # at most ``buckets`` numbers
            return self.read(sorted(r[BUCKET] for r in rows.select(self.bucket_of()).distinct().collect()))
        values = sorted({r[0] for r in keys if r[0] is not None})
        # Ten at a time: longer lists are not pushed down to the pages value by value.
        parts = [F.col(self.keys[0]).isin(values[i : i + 10]) for i in range(0, len(values), 10)]
        return self.read(sorted({r[BUCKET] for r in keys})).where(reduce(or_, parts, F.lit(False)))

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Put rows (all the rows of their buckets) in place of what these buckets hold; returns the new version.

        A version that is there already, of an update that runs again, is replaced; the rows must not be read from it.
        """
        version = max(self.versions(), default=-1) + 1 if version is None else version
        folder, name = f"{self.path}/version={version}", f"{self.name}_{version}"
        self._delete(folder)
        self._create(name, folder)
        try:
            rows.select(*self.schema.names, self.bucket_of()).write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the definition only: the files stay
        self.at()
        return version

    def _delete(self, folder: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def merge(self, fresh: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int | None:
        """Replace the touched buckets by ``merged(their rows, fresh)``. ``fresh`` has one row a key; it is read twice, so small or kept.

        The touched buckets come to the driver as numbers, at most ``buckets`` of them.
        """
        touched = [r[BUCKET] for r in fresh.select(self.bucket_of()).distinct().collect()]
        return self.write(merged(self.read(sorted(touched)), fresh), version) if touched else None

    def forget(self, keep: int = 2) -> None:
        """Remove what no reader of the last ``keep`` versions needs."""
        kept = self.versions()[-keep:]
        if not kept:
            return
        shown = self.newest(kept[0] + 1)
        for p in self._glob(f"version=*/{BUCKET}=*"):
            version, bucket = (int(part.split("=")[1]) for part in p.split("/")[-2:])
            if version < kept[0] and shown.get(bucket) != version:
                self._delete(p)


def upsert(table: BucketedTable, updates: DataFrame, seq: Sequence[str]) -> int | None:
    """``state.upsert`` into a bucketed table: flows by flow_id, steps by step_id."""
    return table.merge(state.collapse(updates, table.keys, seq).drop(*[c for c in seq if c not in table.schema.names]), lambda old, new: state.merge_latest(old, new, table.keys))


def insert_edges(table: BucketedTable, new: DataFrame, seq: Sequence[str]) -> int | None:
    """``state.insert_edges`` into a bucketed table."""
    return table.merge(state.first_edges(new, seq), lambda old, fresh: state.merged(old, fresh, table.keys, keep_old=True))


def upsert_agg(table: BucketedTable, updates: DataFrame, seq: Sequence[str]) -> int | None:
    """``state.upsert_agg`` into a bucketed table."""
    return table.merge(state.last_snapshots(updates, seq), lambda old, fresh: state.merged(old, fresh, table.keys, keep_old=False))
