"""The index as Parquet tables below one folder: reading, replacing, merging and purging.

A manifest names the files of each module in each table. A change writes new files beside
the old ones and then the next manifest, so that it shows in all tables at once or, if the
writer is lost, not at all. Readers keep to the manifest they began with. There is one
writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandloom import schema as S


@dataclass
class Index:
    """The tables that operators read, wherever they come from."""

    symbols: DataFrame
    calls: DataFrame
    unresolved_calls: DataFrame
    implements: DataFrame
    type_refs: DataFrame
    impl_methods: DataFrame
    iface_methods: DataFrame
    package_meta: DataFrame
    package_files: DataFrame
    index_meta: DataFrame


_DEFAULTS = {T.StringType(): "", T.IntegerType(): 0, T.LongType(): 0, T.BooleanType(): False}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns and types; nulls, and a column that is missing as in an older layout, get the default."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        default = F.lit(_DEFAULTS.get(f.dataType)).cast(f.dataType)
        if f.name not in have:
            return default
        return F.col(f.name).cast(f.dataType) if f.dataType not in _DEFAULTS else F.coalesce(F.col(f.name).cast(f.dataType), default)

    return df.select(*(column(f).alias(f.name) for f in S.SCHEMAS[table].fields))


def last_wins(df: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``, then by the other columns."""
    keys = list(keys)
    rest = [F.col(c).desc() for c in df.columns if c not in keys and c != order]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *rest)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return last_wins(both, keys, "__new").drop("__new")


def added(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Insert or ignore: rows of ``new`` whose key ``old`` lacks, once each."""
    keys = list(keys)
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)
    return old.unionByName(fresh)


class Catalog:
    """Files belong to one module each, so a module is replaced or dropped without touching others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs_path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._fs_path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("_manifest") if n.endswith(".json")]

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._fs_path(f"{self.path}/_manifest/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self) -> dict:
        """{"version": n, "tables": {table: {module: {"columns": [...], "paths": [...]}}}}"""
        names = self._manifests()
        return self._load(names[-1]) if names else {"version": 0, "tables": {}}

    def _commit(self, change: Callable[[dict], None]) -> None:
        """Writes the next manifest under another name and gives it its own in one step."""
        names, manifest = self._manifests(), self._manifest()
        change(manifest)
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        draft = self._fs_path(f"{self.path}/_manifest/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._fs_path(f"{self.path}/_manifest/{number:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer changed {self.path}")

    def exists(self, table: str) -> bool:
        return table in self._manifest()["tables"]

    def read(self, table: str) -> DataFrame:
        """An absent table is empty."""
        return self._read(table, self._manifest())

    def _read(self, table: str, manifest: dict) -> DataFrame:
        schema, found = S.SCHEMAS[table], {}
        for entry in manifest["tables"].get(table, {}).values():
            found.setdefault(tuple(entry["columns"]), []).extend(f"{self.path}/{p}" for p in entry["paths"])
        out = None
        for columns, paths in found.items():
            own = T.StructType([f for f in schema.fields if f.name in columns])
            # Columns come as they are stored, so that filters on them reach the files.
            df = self.spark.read.schema(own).parquet(*paths)
            df = df if own == schema else conform(df, table)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def index(self) -> Index:
        """All tables as one manifest has them."""
        manifest = self._manifest()
        return Index(**{name: self._read(name, manifest) for name in Index.__dataclass_fields__})

    def _write(self, folder: str, table: str, rows: DataFrame) -> dict[str, dict]:
        """Writes rows by module; the manifest's entries of those that have any."""
        where, by = f"{folder}/{table}", S.SORTED_BY.get(table)
        names = rows.columns
        if "module_root" not in names:
            rows.write.parquet(f"{self.path}/{where}")
            return {"": {"columns": names, "paths": [where]}}
        if by:
            rows = rows.repartitionByRange(F.col("module_root"), F.col(by)).sortWithinPartitions("module_root", by)
        rows.withColumn("__m", F.md5("module_root")).write.partitionBy("__m").parquet(f"{self.path}/{where}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{where}")
        roots = {hashlib.md5(r.module_root.encode()).hexdigest(): r.module_root for r in written.select("module_root").distinct().toLocalIterator()}
        return {roots[n[4:]]: {"columns": names, "paths": [f"{where}/{n}"]} for n in self._names(where) if n.startswith("__m=")}

    def replace(self, tables: Mapping[str, DataFrame], modules: Iterable[str] | None = None) -> None:
        """Replaces whole modules in the given tables, all of them at once.

        ``modules`` are left with just the rows that the tables now have of them, maybe
        none; where it isn't given, these are all modules of which any table has rows.
        """
        folder, new = f"data/{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            rows = conform(df, name)
            new[name] = self._write(folder, name, rows.dropDuplicates(list(S.KEYS[name])) if name in S.KEYS else rows)
        replaced = {m for found in new.values() for m in found} | set(modules or ())

        def change(manifest: dict) -> None:
            for name, found in new.items():
                own = manifest["tables"].setdefault(name, {})
                for root in replaced:
                    own.pop(root, None)
                own.update(found)

        self._commit(change)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Last wins by key; only the modules of ``rows`` are rewritten."""
        rows = conform(rows, table)
        old = self.read(table).join(rows.select("module_root").distinct(), "module_root", "left_semi")
        self.replace({table: merged(old, rows, S.KEYS[table])})

    def update_files_hash(self, root: str, package: str, files_hash: str) -> None:
        """Sets the hash of a package that is there; of one that isn't, nothing."""
        own = self.read("package_meta").where(F.col("module_root") == root)
        self.replace({"package_meta": own.withColumn("files_hash", F.when(F.col("package_path") == package, F.lit(files_hash)).otherwise(F.col("files_hash")))}, [root])

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows to a table that isn't kept by module."""
        (entry,) = self._write(f"data/{uuid.uuid4().hex}", table, conform(rows, table)).values()

        def change(manifest: dict) -> None:
            manifest["tables"].setdefault(table, {}).setdefault("", {"columns": entry["columns"], "paths": []})["paths"] += entry["paths"]

        self._commit(change)

    def module_roots(self) -> list[str]:
        tables = self._manifest()["tables"]
        return sorted({m for t in ("symbols", "package_files") for m in tables.get(t, {})})

    def modules(self) -> DataFrame:
        """Module roots, as the manifest has them."""
        return self.spark.createDataFrame([(m,) for m in self.module_roots()], "module_root string")

    def purge_modules(self, roots: Iterable[str]) -> None:
        """Drops modules from every table."""
        gone = set(roots)

        def change(manifest: dict) -> None:
            for own in manifest["tables"].values():
                for root in gone & set(own):
                    own.pop(root)

        if gone:
            self._commit(change)

    def purge_module(self, root: str) -> None:
        self.purge_modules([root])

    def purge_orphans(self, discovered: DataFrame) -> list[str]:
        """Purges modules that are indexed and no longer discovered; their roots."""
        gone = [r.module_root for r in self.modules().join(discovered.select("module_root"), "module_root", "left_anti").orderBy("module_root").toLocalIterator()]
        self.purge_modules(gone)
        return gone

    def vacuum(self, keep: int = 2) -> None:
        """Removes manifests but the last ``keep``, and files that none of these name."""
        names = self._manifests()
        for name in names[:-keep]:
            self._fs.delete(self._fs_path(f"{self.path}/_manifest/{name}"), False)
        used = {p.split("/")[1] for n in names[-keep:] for own in self._load(n)["tables"].values() for e in own.values() for p in e["paths"]}
        for folder in self._names("data"):
            if folder not in used:
                self._fs.delete(self._fs_path(f"{self.path}/data/{folder}"), True)

    def version(self) -> int:
        return self._manifest()["version"]

    def migrate(self) -> None:
        """Stamps the layout; older tables need no rewriting, as reading fills in missing columns."""
        if self.version() < S.VERSION:
            self._commit(lambda manifest: manifest.update(version=S.VERSION))

    def reset(self) -> None:
        self._commit(lambda manifest: manifest.update(version=S.VERSION, tables={}))
        self.vacuum(1)
