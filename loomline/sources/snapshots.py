"""Compacted stored runs: the last row of each key as a snapshot by hash partition, and runs since.

A run is a folder of rows. Compaction merges the runs since the last snapshot into it: only hash
partitions that these runs touch are written again, as a new version, and a manifest that says which
version of each partition is valid and which runs it holds takes the place of the last one by a
rename. Until then readers see the old one, whatever was written; what no manifest names is garbage
and goes with the next compaction. So a read scans one version of each partition and the newest runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another compaction was faster; its snapshot is valid and nothing of this one is."""


class Snapshots:
    """A table of the last row of each key at ``path``, any that Spark can write.

    ``order`` columns say which row of a key is the last; nulls are before all, and of rows that are
    alike in them one with the largest other columns counts. Keys may be null, as a value like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], parts: int = 32):
        self.spark, self.path, self.keys, self.order, self.parts = spark, path.rstrip("/"), list(keys), list(order), parts
        self.schema = T.StructType.fromDDL(schema)
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        at = self._jpath(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _finished(self, below: str) -> bool:
        return self._fs.exists(self._jpath(f"{self.path}/{below}/_SUCCESS"))

    def manifest(self) -> dict:
        """The valid manifest: ``number``, ``parts`` (hash partition to version), ``runs`` that they hold, and ``of`` how many parts keys are dealt to."""
        numbers = [n for n in self._names("manifests") if n.isdigit()]
        if not numbers:
            return {"number": 0, "parts": {}, "runs": [], "of": self.parts}
        stream = self._fs.open(self._jpath(f"{self.path}/manifests/{max(numbers)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        draft, final = self._jpath(f"{self.path}/manifests/draft-{uuid.uuid4().hex}"), self._jpath(f"{self.path}/manifests/{manifest['number']:012d}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(final.toString())

    def append(self, rows: DataFrame, run: str | int) -> None:
        """Stores ``rows`` as a run. A run of the same name is replaced, so one that is repeated counts once, as long as no compaction holds it."""
        if str(run) not in self.manifest()["runs"]:
            rows.select(*[_as(F.col(f"`{f.name}`"), f.dataType, rows.schema[f.name].dataType).alias(f.name) for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/runs/{run}")

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key. Only rows of keys that stand more than once are moved and compared."""
        keys = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)]
        many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        return rows.join(many, same, "left_anti").unionByName(self._best(rows.join(many, same, "left_semi")))

    def _best(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema if f.name not in self.keys and f.name not in self.order]
        plain = [c for c in rest if _ordered(self.schema[c].dataType)]
        best = F.max_by(F.struct(*[F.col(f"`{f.name}`") for f in self.schema]), F.struct(*[F.col(f"`{c}`") for c in [*self.order, *plain]]))
        return rows.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)]).agg(best.alias("__row")).select("__row.*")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _runs(self, manifest: dict) -> list[str]:
        return [r for r in self._names("runs") if r not in manifest["runs"] and self._finished(f"runs/{r}")]

    def scanned(self) -> list[str]:
        """The folders that a read scans."""
        m = self.manifest()
        return [f"{self.path}/versions/{v}/__part={p}" for p, v in sorted(m["parts"].items())] + [f"{self.path}/runs/{r}" for r in self._runs(m)]

    def read(self) -> DataFrame:
        """The last row of each key. A snapshot without runs since holds each key once and is read as it is, so only the columns that are used."""
        m = self.manifest()
        rows = self._read(self.scanned())
        return rows if "of" in m and not self._runs(m) else self._last(rows)

    def compact(self) -> dict:
        """Merges the runs into the snapshot and returns the manifest that is valid then."""
        old = self.manifest()
        runs = self._runs(old)
        if runs:
            part = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.parts)).cast("int")
            new = self._read([f"{self.path}/runs/{r}" for r in runs])
            # With another number of parts than before all rows are dealt anew.
            alike = old.get("of") == self.parts
            seen = new if alike else new.unionByName(self._read([f"{self.path}/versions/{v}/__part={p}" for p, v in old["parts"].items()]))
            touched = [r[0] for r in seen.select(part.alias("p")).distinct().collect()]
            version = f"{old['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            held = self._read([f"{self.path}/versions/{v}/__part={p}" for p, v in old["parts"].items() if not alike or int(p) in touched])
            merged = self._last(held.unionByName(new)).withColumn("__part", part)
            merged.write.partitionBy("__part").parquet(f"{self.path}/versions/{version}")
            # Names of runs that are gone already need not be kept.
            gone = set(self._names("runs"))
            parts = (old["parts"] if alike else {}) | {str(p): version for p in touched}
            self._commit({"number": old["number"] + 1, "parts": parts, "runs": sorted({*(r for r in old["runs"] if r in gone), *runs}), "of": self.parts})
        self.clean()
        return self.manifest()

    def clean(self) -> None:
        """Deletes what the valid manifest holds already or does not name. Not to run while another compaction does."""
        m = self.manifest()
        for n in self._names("manifests"):
            if n != f"{m['number']:012d}":
                self._fs.delete(self._jpath(f"{self.path}/manifests/{n}"), False)
        for r in m["runs"]:
            self._fs.delete(self._jpath(f"{self.path}/runs/{r}"), True)
        for v in self._names("versions"):
            for p in self._names(f"versions/{v}") if v in m["parts"].values() else []:
                if p.startswith("__part=") and m["parts"].get(p[7:]) != v:
                    self._fs.delete(self._jpath(f"{self.path}/versions/{v}/{p}"), True)
            if v not in m["parts"].values():
                self._fs.delete(self._jpath(f"{self.path}/versions/{v}"), True)


def _as(c: Column, want: T.DataType, have: T.DataType) -> Column:
    """``c`` as the type ``want``, fields of structs by their names; fields that it does not have are null."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {f.name: f.dataType for f in have}
        fields = [(_as(c.getField(f.name), f.dataType, known[f.name]) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: _as(x, want.elementType, have.elementType))
    return c.cast(want)


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type have an order, which maps have not."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))
