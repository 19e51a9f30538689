"""A table of keyed rows in immutable files: each change is a version, published at once or not at all.

A version is a small file that lists the parts the table is made of, in order: of several rows of a key
the one in the last part counts, and a part may hold deletions. A change writes one part and then
publishes its version by a rename that fails where that version is there already; the change is then
made again on what the other writer left. Versions also list the states before, the newest few of which
can be restored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States that can be restored, and parts after which a change rewrites the table.
KEPT_STATES, MOST_PARTS = 5, 8


class Conflict(Exception):
    """Another writer was first, again and again."""


class SnapshotTable:
    """A table at a path; `schema` (DDL) has a column `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        place = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """{"parts": [...], "undo": [[...], ...]} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"parts": [], "undo": []}
        f = self._fs.open(self._at("versions", f"{version:010d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode())
        finally:
            f.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest one)."""
        return self._rows(self.state(version)["parts"])

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        read = lambda p: self.spark.read.schema(f"{self.schema}, deleted boolean").parquet(f"{self.path}/parts/{p}")
        if len(parts) == 1:
            return read(parts[0]).where("not deleted").select(*names)
        every = None
        for i, p in enumerate(parts):
            rows = read(p).withColumn("part", F.lit(i))
            every = rows if every is None else every.unionByName(rows)
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*every.columns), "part").alias("r")).select("r.*")
        return last.where("not deleted").select(*names)

    def _write(self, rows: DataFrame, deleted: bool = False) -> str:
        part = uuid.uuid4().hex
        rows.withColumn("deleted", F.lit(deleted)).write.parquet(f"{self.path}/parts/{part}")
        return part

    def publish(self, after: int, state: dict) -> bool:
        """Make a state the version that follows `after`; false if that version is there already."""
        own, place = self._at("versions", f"_{uuid.uuid4().hex}"), self._at("versions", f"{after + 1:010d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(own, place, options)
        except Exception as e:  # noqa: BLE001  told apart by what the store says
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _change(self, change, attempts: int = 10) -> int:
        """Publish change(state's parts) -> parts; on what others left, if they were first."""
        for _ in range(attempts):
            version = self.version()
            state = self.state(version)
            parts = change(state["parts"])
            if len(parts) > MOST_PARTS:
                parts = [self._write(self._rows(parts))]
            if self.publish(version, {"parts": parts, "undo": [*state["undo"], state["parts"]][-KEPT_STATES:]}):
                return version + 1
        raise Conflict(f"version {self.version()} of {self.path}")

    def upsert(self, rows: DataFrame) -> int:
        """Add rows; those of a key that is there replace it. Of several new rows of a key any one counts."""
        part = self._write(rows.dropDuplicates([self.key]))  # written once, however often it must be published
        return self._change(lambda parts: [*parts, part])

    def replace(self, rows: DataFrame) -> int:
        """Make rows the whole table."""
        part = self._write(rows)
        return self._change(lambda parts: [part])

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of the keys (a table with the key's column)."""
        names = [f for f in self.spark.createDataFrame([], self.schema).schema.fields if f.name != self.key]
        gone = keys.select(self.key, *(F.lit(None).cast(f.dataType).alias(f.name) for f in names)).dropDuplicates([self.key])
        part = self._write(gone, deleted=True)
        return self._change(lambda parts: [*parts, part])

    def restore(self) -> bool:
        """Go back to the state before the newest change; false if none is kept."""
        while True:
            version = self.version()
            state = self.state(version)
            if not state["undo"]:
                return False
            if self.publish(version, {"parts": state["undo"][-1], "undo": state["undo"][:-1]}):
                return True

    def vacuum(self) -> int:
        """Delete the parts that the newest version and its kept states don't list (of failed or forgotten changes); how many."""
        state = self.state()
        used = {p for parts in [state["parts"], *state["undo"]] for p in parts}
        place = self._at("parts")
        gone = [s.getPath() for s in self._fs.listStatus(place) if s.getPath().getName() not in used] if self._fs.exists(place) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
