"""Stored tables of current rows, cut into parts: a change rewrites the parts it touches and is published at once."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Stored:
    """A table under `path`. Its rows lie in folders part=P/version=V; a manifest names the version of every part.

    `part` is an SQL expression over the columns: a hash of the key for tables that are looked up by key, a day for tables that
    are scanned by date. A change reads and writes the parts of its rows only. Its new folders are
    read by nobody until a manifest of a higher number names them; writing that fails if another change has taken
    the number. So readers see a whole state, an interrupted change leaves nothing, and of two changes at a time the
    later one fails and can be made again. Old folders stay until vacuum().
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    part: str

    # Manifests: small files of one number for each part.

    def _fs(self):
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return context._jvm, root.getFileSystem(context._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        _, fs = self._fs()
        if not fs.exists(self._at("_manifests")):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(self._at("_manifests")) if f.getPath().getName().endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """{number, schema, parts: {part: version}}, the latest by default."""
        number = self._numbers()[-1] if number is None else number
        jvm, fs = self._fs()
        stream = fs.open(self._at(f"_manifests/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, schema: str, parts: dict) -> None:
        jvm, fs = self._fs()
        stream = fs.create(self._at(f"_manifests/{number:012d}.json"), False)  # fails if it is there
        try:
            stream.write(bytearray(json.dumps({"number": number, "schema": schema, "parts": parts}).encode()))
        finally:
            stream.close()

    # Reading.

    def _read(self, parts: dict, schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not parts:
            return self.spark.createDataFrame([], kind.add("part", "string"))
        folders = [f"{self.path}/part={p}/version={v}" for p, v in sorted(parts.items())]
        rows = self.spark.read.schema(T.StructType([*kind, T.StructField("part", T.StringType())])).option("basePath", self.path).parquet(*folders)
        return rows.select(*kind.names, "part")

    def rows(self, where: Column | None = None, only: set[str] | None = None) -> DataFrame:
        """The current rows. `where` may use the column part, which prunes folders; `only` names parts, so that no other is even listed."""
        now = self.manifest()
        out = self._read({p: v for p, v in now["parts"].items() if only is None or p in only}, now["schema"])
        return (out if where is None else out.where(where)).drop("part")

    # Changing.

    def create(self, rows: DataFrame) -> Stored:
        """Write a new table. Keys must not be null; rows that share one stay together and are replaced together."""
        self._write(rows, 0, rows.schema.json(), {})
        return self

    def _write(self, rows: DataFrame, number: int, schema: str, parts: dict, gone: set[str] = frozenset()) -> None:
        kind = T.StructType.fromJson(json.loads(schema))
        out = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind)).withColumn("part", F.expr(self.part).cast("string")).withColumn("version", F.lit(number))
        out.repartition("part").write.mode("append").partitionBy("part", "version").parquet(self.path)
        made = set()
        _, fs = self._fs()
        for folder in fs.listStatus(self._at("")) if fs.exists(self._at("")) else []:
            name = folder.getPath().getName()
            if name.startswith("part=") and fs.exists(self._at(f"{name}/version={number}")):
                made.add(name[5:])
        self._publish(number, schema, {p: v for p, v in parts.items() if p not in gone} | dict.fromkeys(made, number))

    def change(self, updates: DataFrame | None = None, order: tuple[str, ...] = (), gone: DataFrame | None = None, moved_from: set[str] | None = None) -> set[str]:
        """Put in `updates` (whole rows, which replace those of their keys; of several for a key the last in `order`, or all without one) and take out the keys `gone`; the parts that were rewritten.

        Rows whose part is no function of the key may have to leave another part than they come to: `moved_from` names the
        parts where the old ones lie (of the scan that found them).
        """
        now = self.manifest()
        number, kind = now["number"] + 1, T.StructType.fromJson(json.loads(now["schema"]))
        part = F.expr(self.part).cast("string")
        touched = set(moved_from or ())
        for df in (updates, gone):
            if df is not None and set(df.columns) >= self._columns():
                touched |= {r.part for r in df.select(part.alias("part")).distinct().collect()}  # one row a part at most
        old = self._read({p: v for p, v in now["parts"].items() if p in touched}, now["schema"]).drop("part")
        keys = list(self.keys)
        if gone is not None:
            old = old.join(gone.select(*keys).distinct(), keys, "left_anti")
        if updates is not None:
            fresh = updates.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind))
            if order:
                first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
                fresh = fresh.withColumn("_n", first).where("_n = 1").drop("_n")
            old = old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
        self._write(old, number, now["schema"], now["parts"], touched)
        return touched

    def _columns(self) -> set[str]:
        """Columns that the part expression needs."""
        names = T.StructType.fromJson(json.loads(self.manifest()["schema"])).names
        return {n for n in names if n.lower() in self.part.lower()}

    def vacuum(self, keep: int = 2) -> None:
        """Delete what only manifests before the last `keep` name; readers of those must have ended."""
        numbers = self._numbers()
        _, fs = self._fs()
        alive = {(p, v) for n in numbers[-keep:] for p, v in self.manifest(n)["parts"].items()}
        for n in numbers[:-keep]:
            for p, v in self.manifest(n)["parts"].items():
                if (p, v) not in alive:
                    fs.delete(self._at(f"part={p}/version={v}"), True)
        for n in numbers[:-keep]:
            fs.delete(self._at(f"_manifests/{n:012d}.json"), False)


def by_key(spark: SparkSession, path: str, keys: list[str], parts: int = 64) -> Stored:
    """A table looked up by key: parts are a hash of the keys."""
    return Stored(spark, path, tuple(keys), f"pmod(xxhash64({', '.join(keys)}), {parts})")


def by_day(spark: SparkSession, path: str, keys: list[str], at: str, grain: str = "yyyy-MM-dd") -> Stored:
    """A table scanned by date: parts are the days of the timestamp `at`, or the months (grain yyyy-MM), where days would be many and small."""
    return Stored(spark, path, tuple(keys), f"date_format({at}, '{grain}')")
