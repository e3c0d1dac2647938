"""A keyed table in versions: writes touch only the buckets whose rows change, and of two writers from one version one is refused.

Rows lie in ``buckets`` by a hash of their keys.  A version is a manifest that
names the folders of each bucket; it is put in place by a rename that fails if
another writer has made that version meanwhile.  Data folders are never changed
once written, so readers of any version are undisturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.stages import filesystem

_BUCKET = "_bucket"


class VersionConflict(Exception):
    """Another writer has committed since the version that a write began from."""


class VersionedTable:
    """A table under ``path``; ``version`` 0 is empty.

    Keys may be null; a column named ``_bucket`` is refused.  The manifest has
    one entry for each bucket, so ``buckets`` bounds what the driver reads.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        fs, where = filesystem(spark, path)
        return fs.exists(where)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 32) -> VersionedTable:
        """The table at ``path``, which is made if it isn't there; one that is there keeps its own keys and buckets."""
        if _BUCKET in schema.names:
            raise ValueError(f"{_BUCKET} is a name of the table itself")
        table = cls(spark, path, schema, keys, buckets)
        if table.version() is None:
            try:
                table._commit({"version": 0, "keys": table.keys, "buckets": buckets, "folders": {}, "batch": None})
            except VersionConflict:  # made by another writer just now
                pass
        head = table._manifest()
        if head["keys"] != table.keys:
            raise ValueError(f"the table has keys {head['keys']}")
        table.buckets = head["buckets"]
        return table

    # Versions.

    def _names(self) -> list[int]:
        fs, where = filesystem(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self) -> int | None:
        return max(self._names(), default=None)

    def _manifest(self, version: int | None = None) -> dict:
        name = self.version() if version is None else version
        fs, where = filesystem(self.spark, f"{self.path}/versions/{name:020d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Puts a manifest in its place, unless there is one."""
        jvm = self.spark._jvm
        fs, ready = filesystem(self.spark, f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(ready, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{manifest['version']:020d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        refuse = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        try:
            context.rename(ready, place, refuse)
        except Exception as e:
            fs.delete(ready, False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"version {manifest['version']} of {self.path} is there already") from e
            raise

    # Reading.

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, buckets: Sequence[int] | None) -> list[str]:
        of = manifest["folders"]
        wanted = of if buckets is None else [str(b) for b in buckets if str(b) in of]
        return [f"{self.path}/data/{f}/{_BUCKET}={b}" for b in wanted for f in of[b]]

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        paths = self._folders(manifest, buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version, the last one by default; with ``keys``, those rows only, from their buckets only."""
        manifest = self._manifest(version)
        if keys is None:
            return self._rows(manifest)
        wanted = keys.select(*self.keys).distinct()
        return self._rows(manifest, self._touched(wanted)).join(wanted, self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # numbers below ``buckets``

    # Writing.

    def upsert(self, rows: DataFrame, version: str | None = None, batch: int | None = None, expected: int | None = None) -> int:
        """Rows of keys that are there replace them, others are added; of several rows of one key the greatest ``version`` stays, new ones first on ties.

        Without ``version``, new rows always win, one of each key.  A stream's
        ``batch`` that is committed already does nothing.  ``expected``: the
        version that the write must follow.  Returns the version now.
        """
        return self._rewrite(rows, lambda old, new: _latest(old, new, self.keys, version), batch, expected)

    def insert(self, rows: DataFrame, expected: int | None = None) -> int:
        """Adds the rows whose keys aren't there, one of each key."""
        return self._rewrite(rows, lambda old, new: old.unionByName(new.dropDuplicates(self.keys).join(old.select(*self.keys), self.keys, "left_anti")), None, expected)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Takes the rows of some keys away."""
        return self._rewrite(keys.select(*self.keys), lambda old, gone: old.join(gone.distinct(), self.keys, "left_anti"), None, expected)

    def swap(self, rows: DataFrame, revision: str, expected: str) -> DataFrame:
        """Updates rows whose ``revision`` is still what the new row says in ``expected``; a row that isn't there has none.

        Returns the keys with ``applied``; refused rows change nothing.  Of several rows of one key none is applied.
        """
        at = self.version()
        old = self.read(at, rows).select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.col(revision).alias("_was"))
        match = None
        for k in self.keys:
            same = F.col(k).eqNullSafe(F.col(f"_{k}"))
            match = same if match is None else match & same
        once = F.count(F.lit(1)).over(Window.partitionBy(*self.keys)) == 1
        judged = rows.withColumn("_once", once).join(old, match, "left").withColumn("applied", F.col("_once") & F.col("_was").eqNullSafe(F.col(expected)))
        stored = f"{self.path}/data/{uuid.uuid4().hex}"
        judged.select(*rows.columns, "applied").write.parquet(stored)
        judged = self.spark.read.parquet(stored)
        self._rewrite(judged.where("applied").select(*self.schema.names), lambda o, n: _latest(o, n, self.keys, None), None, at)
        return judged.select(*self.keys, "applied")

    def _rewrite(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None, expected: int | None) -> int:
        head = self._manifest()
        if expected is not None and head["version"] != expected:
            raise VersionConflict(f"{self.path} is at version {head['version']}, not {expected}")
        if batch is not None and head["batch"] is not None and batch <= head["batch"]:
            return head["version"]
        touched = self._touched(new)
        folders = dict(head["folders"])
        if touched:
            name = uuid.uuid4().hex
            made = merge(self._rows(head, touched), new).withColumn(_BUCKET, self.bucket())
            made.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
            there = self._written(name)
            for b in touched:
                folders.pop(str(b), None)
                if b in there:
                    folders[str(b)] = [name]
        elif batch is None:
            return head["version"]
        self._commit({**head, "version": head["version"] + 1, "folders": folders, "batch": head["batch"] if batch is None else batch})
        return head["version"] + 1

    def _written(self, name: str) -> set[int]:
        fs, where = filesystem(self.spark, f"{self.path}/data/{name}")
        return {int(n.split("=")[1]) for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith(f"{_BUCKET}=")}

    def append(self, rows: DataFrame, expected: int | None = None) -> int:
        """Adds rows without looking at those that are there; their buckets get a further folder each, until :meth:`compact`."""
        head = self._manifest()
        if expected is not None and head["version"] != expected:
            raise VersionConflict(f"{self.path} is at version {head['version']}, not {expected}")
        name = uuid.uuid4().hex
        rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        there = self._written(name)
        if not there:
            return head["version"]
        folders = {**head["folders"], **{str(b): [*head["folders"].get(str(b), []), name] for b in there}}
        self._commit({**head, "version": head["version"] + 1, "folders": folders})
        return head["version"] + 1

    def compact(self, most: int = 1) -> int:
        """Buckets of more than ``most`` folders are put into one each; rows stay what they are."""
        head = self._manifest()
        many = [int(b) for b, f in head["folders"].items() if len(f) > most]
        if not many:
            return head["version"]
        name = uuid.uuid4().hex
        self._rows(head, many).withColumn(_BUCKET, self.bucket()).repartition(len(many), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        self._commit({**head, "version": head["version"] + 1, "folders": {**head["folders"], **{str(b): [name] for b in many}}})
        return head["version"] + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and the folders that only these had; returns how many folders went.

        Not while others write: a folder whose manifest isn't in place yet looks like one that nobody has.
        """
        names = self._names()
        stay = names[-max(keep, 1) :]
        used = {f for v in stay for fs in self._manifest(v)["folders"].values() for f in fs}
        for v in names[: -len(stay)]:
            fs, where = filesystem(self.spark, f"{self.path}/versions/{v:020d}.json")
            fs.delete(where, False)
        fs, data = filesystem(self.spark, f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        for g in gone:
            fs.delete(g, True)
        return len(gone)


def _latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str | None) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    order = ([F.desc(version)] if version else []) + [F.desc("_new")] + [F.desc(c) for c in old.columns if c not in keys]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("_first", first).where("_first = 1").drop("_new", "_first")
