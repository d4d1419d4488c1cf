"""Tables that are replaced key by key, in versions: a reader never sees half an update.

Rows lie in folders by a hash of their key. An update writes the folders of the keys it touches
anew, under its own version, and then a manifest that says for each folder which version holds it;
all other folders stay as they were written. The manifest is written last, so a writer that stops
at any step leaves the state before, and the same update run again gives the state after.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloquy.operators.attribution import as_of_ranges
from veloquy.storage import discard, stored

BUCKETS = 32
MANIFEST = T.StructType().add("bucket", "integer").add("version", "long").add("schema", "string")


@dataclass
class VersionedTable:
    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        folder, store = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit() and store.exists(self._fs(f"{self.path}/manifests/{n}/_SUCCESS")[0]))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, int], T.StructType | None]:
        known = self.versions()
        version = version or (known[-1] if known else 0)
        if not version:
            return 0, {}, None
        # One row a folder, and one (bucket -1) for the columns.
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{version}").collect()
        return version, {r.bucket: r.version for r in rows if r.bucket >= 0}, T.StructType.fromJson(json.loads(next(r.schema for r in rows if r.bucket < 0)))

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of an older one; None before the first."""
        _, held, schema = self._manifest(version)
        return None if schema is None else self._folders(held, schema)

    def _folders(self, held: dict[int, int], schema: T.StructType) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])

    def replace(self, rows: DataFrame, touched: DataFrame) -> int:
        """Take out all rows of the keys in `touched` and put `rows` (of such keys) in; the version
        that this makes, or the last one if nothing is touched."""
        version, held, schema = self._manifest()
        keys = stored(touched.select(self.key).distinct().withColumn("__bucket", self.bucket()), "touched")
        hit = [r[0] for r in keys.select("__bucket").distinct().collect()]  # folders at most
        if not hit and schema is not None:
            discard(keys)
            return version
        new = rows
        old = {b: v for b, v in held.items() if b in hit}
        if old:
            same = F.col(f"o.{self.key}").eqNullSafe(F.col(f"k.{self.key}"))
            new = self._folders(old, schema).alias("o").join(keys.select(self.key).alias("k"), same, "left_anti").select(*rows.columns).unionByName(rows)
        at = f"{self.path}/data/version={version + 1}"
        new.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        folder, store = self._fs(at)
        written = {int(s.getPath().getName().split("=")[1]): version + 1 for s in store.listStatus(folder) if "=" in s.getPath().getName()}
        discard(keys)
        self._commit(version + 1, {b: v for b, v in held.items() if b not in hit} | written, rows.schema)
        return version + 1

    def _commit(self, version: int, held: dict[int, int], schema: T.StructType) -> None:
        said = [(b, v, None) for b, v in sorted(held.items())] + [(-1, version, schema.json())]
        self.spark.createDataFrame(said, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/{version}")

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the last `keep`, and folders that those don't name."""
        known = self.versions()
        needed = {(b, v) for n in known[-keep:] for b, v in self._manifest(n)[1].items()}
        for n in known[:-keep]:
            folder, store = self._fs(f"{self.path}/manifests/{n}")
            store.delete(folder, True)
        folder, store = self._fs(f"{self.path}/data")
        for status in store.listStatus(folder) if store.exists(folder) else []:
            for part in store.listStatus(status.getPath()):
                name = part.getPath().getName()
                if "=" in name and (int(name.split("=")[1]), int(status.getPath().getName().split("=")[1])) not in needed:
                    store.delete(part.getPath(), True)


def refreshed_attribution(table: VersionedTable, meetings: DataFrame, known: DataFrame | None, cues: Callable[[DataFrame], DataFrame], at: str, value: list[str], clamp: bool = False) -> int:
    """Attribute anew the cues of meetings whose speakers came late or changed, others untouched.

    `meetings` has one row for each meeting: the table's key, `stamp` and `speakers`, an array of
    struct with `at` and the columns `value`; `known` (key, stamp) is what the table was made from, None at first.
    `cues(keys)` reads the cues of the meetings in `keys`. Meetings that are gone lose their rows."""
    key = table.key
    if known is None:
        changed = touched = meetings
    else:
        same = F.col(f"m.{key}").eqNullSafe(F.col(f"k.{key}"))
        changed = meetings.alias("m").join(known.alias("k"), same & F.col("m.stamp").eqNullSafe(F.col("k.stamp")), "left_anti")
        gone = known.alias("k").join(meetings.alias("m"), same, "left_anti")
        touched = changed.select(key).unionByName(gone.select(key))
    changed = stored(changed.select(key, "stamp", "speakers"), "changed")
    speakers = changed.select(key, F.explode("speakers").alias("s")).select(key, F.col(f"s.{at}").alias(at), *[F.col(f"s.{v}").alias(v) for v in value])
    version = table.replace(as_of_ranges(cues(changed.select(key)), speakers, key, at, value, clamp), touched)
    discard(changed)
    return version
