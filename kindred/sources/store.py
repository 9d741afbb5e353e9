"""A catalogue of versioned tables in one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables below ``root``; each commit is a version that names the folder of every table.

    A commit writes its tables first and the manifest last, by a rename, so a
    reader sees the version before or after it and never a part. Tables that a
    commit does not name stay where they are. Old versions are kept, as backups,
    until ``expire``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._path(f"{self.root}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[str, str]:
        have = self.versions()
        if version is None and not have:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{have[-1] if version is None else version:09d}").first()[0])

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        where = self.manifest(version)
        if name not in where:
            raise KeyError(f"no table {name!r} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{where[name]}")

    def commit(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> int:
        """Replaces ``tables`` and appends to others, as one version, whose number is returned."""
        new = ([0, *self.versions()][-1]) + 1
        where = dict(self.manifest())
        for name, rows in (append or {}).items():
            tables[name] = self.read(name).unionByName(rows) if name in where else rows
        for name, rows in tables.items():
            where[name] = f"{name}/{new:09d}"
            rows.write.mode("overwrite").parquet(f"{self.root}/{where[name]}")
        fs, draft = self._path(f"{self.root}/manifest/_{new:09d}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(where, sort_keys=True).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{self.root}/manifest/{new:09d}")[1]):
            raise RuntimeError(f"version {new} was written by another process")
        return new

    def expire(self, keep: int) -> None:
        """Deletes all but the last ``keep`` versions, and the folders that only they name."""
        have = self.versions()
        used = {p for v in have[-keep:] for p in self.manifest(v).values()}
        for v in have[:-keep]:
            for path in [f"manifest/{v:09d}", *(p for p in self.manifest(v).values() if p not in used)]:
                fs, p = self._path(f"{self.root}/{path}")
                fs.delete(p, True)
