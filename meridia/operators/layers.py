"""Tables as layers of Parquet: a change writes what it changes, readers merge.

A table is a list of layers. A layer of rows holds what one change added; a layer of keys
(gone) says whose rows of earlier layers no longer count. Both are laid out
by a hash of the key, ``_bucket``, so one key's rows are looked for in one bucket alone.
A numbered manifest names the layers of every table, with an order-free digest of each
layer's rows. Manifests are never replaced: readers take the highest, and
of two writers that began with the same version the second fails.

Readers join rows with the keys that are gone, which are as many as were put or
deleted since the table was last compacted; ``compact`` makes one layer of a table.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .integrity import StaleStoreError

SCHEMA_VERSION = 3


class ConflictError(RuntimeError):
    """Another writer has published the version that this one was to become."""


def _sums(df: DataFrame, name: str) -> DataFrame:
    row = F.to_json(F.struct(*[F.base64(c).alias(c) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c) for c in df.columns]))
    return df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.reverse(row)).alias("b")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"]).withColumn("name", F.lit(name))


def digests(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """[rows, sum, sum] of each table, in one job: two sums of 64-bit hashes over all rows, modulo 2**64 each. Equal multisets of rows have equal digests, in whatever order and files; digests of parts add up."""
    if not tables:
        return {}
    got = reduce(DataFrame.unionByName, [_sums(df, name) for name, df in tables.items()]).collect()
    return {r["name"]: [str(r["n"]), *[str(int(r[c] or 0) % 2**64) for c in "ab"]] for r in got}


class LayeredTables:
    """Named tables with explicit schemas under one folder. ``keys`` names the column of each table that changes replace rows by."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], keys: dict[str, str], buckets: int = 16):
        self.spark, self.root, self.schemas, self.keys, self.buckets = spark, root.rstrip("/"), schemas, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ---

    def names(self) -> list[str]:
        root = self._path(self.root)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def numbers(self) -> list[int]:
        return sorted(int(m.group(1)) for n in self.names() if (m := re.fullmatch(r"MANIFEST-(\d+)\.json", n)))

    def read_file(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create_file(self, name: str, text: str) -> None:
        """A new file; an error if there is one of that name."""
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # --- versions ---

    def latest(self) -> dict:
        """The last complete manifest, with ``next``: the number that a change of it will have. One that was cut off while it was written is no version."""
        found = self.numbers()
        for n in reversed(found):
            if text := self.read_file(f"MANIFEST-{n:012d}.json"):
                try:
                    return json.loads(text) | {"next": found[-1] + 1}
                except json.JSONDecodeError:
                    continue
        raise StaleStoreError(f"{self.root} has no manifest")

    def publish(self, manifest: dict) -> dict:
        """Makes a manifest the newest version under its number ``next``; ConflictError if another writer has taken it."""
        number = manifest["next"]
        name = f"MANIFEST-{number:012d}.json"
        text = json.dumps({k: v for k, v in manifest.items() if k != "next"} | {"schema_version": SCHEMA_VERSION, "version": number})
        try:
            self.create_file(name, text)
        except Exception as e:
            if name in self.names():
                raise ConflictError(f"version {number} was published by another writer") from e
            raise
        return json.loads(text) | {"next": number + 1}

    # --- layers ---

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that some keys are in; at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(key))).distinct().collect())

    def folder(self, manifest: dict) -> str:
        """A new folder for what the next version writes."""
        return f"v{manifest['next']}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, key: str, path: str) -> str:
        """Rows by bucket, in order of key inside a file; rebalanced, so that the bucket of a key with very many rows is written by many tasks."""
        df.withColumn("_bucket", self.bucket(F.col(key))).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return path

    def write_all(self, tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
        """Several tables at once, each as a layer in the folder."""
        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            done = {name: pool.submit(self.write, df, self.keys[name], f"{folder}/{name}") for name, df in tables.items()}
        return {name: d.result() for name, d in done.items()}

    def layer(self, name: str, layer: dict, buckets: list[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of one layer, with its bucket."""
        schema = schema or self.schemas[name]
        path = layer["path"] if layer.get("plain") else f"{self.root}/{layer['path']}"
        if layer.get("plain"):  # of older versions, not laid out by bucket
            df = self.spark.read.schema(schema).parquet(path).withColumn("_bucket", self.bucket(F.col(self.keys[name])))
        else:
            df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)
        return df if buckets is None else df.where(F.col("_bucket").isin(buckets))

    def table(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of some buckets or all."""
        schema, key = self.schemas[name], self.keys[name]
        entry = manifest["tables"].get(name, {"rows": [], "gone": []})
        if not entry["rows"] or buckets == []:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, [self.layer(name, x, buckets).withColumn("_layer", F.lit(x["n"])) for x in entry["rows"]])
        oldest = min(x["n"] for x in entry["rows"])
        gone = [x for x in entry["gone"] if x["n"] > oldest]
        if gone:
            only = T.StructType([schema[key]])
            ends = reduce(DataFrame.unionByName, [self.layer(name, x, buckets, only).select(key, F.lit(x["n"]).alias("_last")) for x in gone])
            rows = rows.join(ends.groupBy(key).agg(F.max("_last").alias("_last")), key, "left").where("_last is null or _layer >= _last")
        return rows.select(*schema.names)

    def look_up(self, name: str, manifest: dict, value: str) -> DataFrame:
        """The rows of one key, from its bucket."""
        at = self.spark.range(1).select(self.bucket(F.lit(value))).first()[0]
        return self.table(name, manifest, [at]).where(F.col(self.keys[name]) == value)

    def changed(self, manifest: dict, added: dict[str, str], gone: dict[str, str] | None = None) -> dict:
        """The manifest with layers of rows, and of keys whose earlier rows no longer count; not yet published. Paths are of ``write``."""
        n, tables = manifest["next"], json.loads(json.dumps(manifest["tables"]))
        for name, path in (gone or {}).items():
            if tables.get(name, {}).get("rows"):
                tables[name]["gone"].append({"n": n, "path": path})
        for name, layer in self._digested({name: {"n": n, "path": path} for name, path in added.items()}).items():
            tables.setdefault(name, {"rows": [], "gone": []})["rows"].append(layer)
        return manifest | {"tables": tables}

    def _digested(self, layers: dict[str, dict]) -> dict[str, dict]:
        """Layers that have rows, with their digests."""
        found = digests({name: self.layer(name, x).select(*self.schemas[name].names) for name, x in layers.items()})
        return {name: x | {"digest": found[name]} for name, x in layers.items() if found[name][0] != "0"}

    def compact(self, manifest: dict, more_than: int = 1) -> dict:
        """The manifest with one layer in place of those of each table that has more than so many; not yet published. Older versions keep their files."""
        many = [name for name, e in manifest["tables"].items() if len(e["rows"]) + len(e["gone"]) > more_than]
        paths = self.write_all({name: self.table(name, manifest) for name in many}, self.folder(manifest))
        layers = self._digested({name: {"n": manifest["next"], "path": path} for name, path in paths.items()})
        return manifest | {"tables": manifest["tables"] | {name: {"rows": [layers[name]] if name in layers else [], "gone": []} for name in many}}

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` versions, and the folders that these do not name; readers of older versions fail from then on."""
        found = self.numbers()
        kept = [json.loads(self.read_file(f"MANIFEST-{n:012d}.json")) for n in found[-keep:]]
        named = {x["path"].split("/")[0] for m in kept for e in m["tables"].values() for x in (*e["rows"], *e["gone"]) if not x.get("plain")}
        for n in found[:-keep]:
            self._drop(f"MANIFEST-{n:012d}.json")
        for name in self.names():
            if (m := re.fullmatch(r"v(\d+)-\w+", name)) and name not in named and int(m.group(1)) <= found[-1]:
                self._drop(name)

    def damaged(self, manifest: dict) -> list[str]:
        """Layers whose rows are not those that were written, by their digests."""
        held = {f"{name}: {x['path']}": (name, x) for name, e in manifest["tables"].items() for x in e["rows"] if "digest" in x}
        found = digests({said: self.layer(name, x).select(*self.schemas[name].names) for said, (name, x) in held.items()})
        return [said for said, (_, x) in held.items() if found[said] != x["digest"]]
