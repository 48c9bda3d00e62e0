"""Folders of tables and small JSON documents in the shared file system, each written under another name and renamed when it is whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it: in spark.checkpoint.dir, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quire-{name}/{uuid.uuid4().hex}"


class Folder:
    """Tables and documents by name. What has() tells of is whole: a writer that dies leaves its unfinished work under another name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _rename(self, temporary: str, name: str) -> None:
        old, fs = self._at(temporary)
        new, _ = self._at(name)
        if fs.exists(new):
            fs.delete(new, True)
        if not fs.rename(old, new):
            raise OSError(f"could not rename {old} to {new}")

    def has(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write the table unless it is there, and read it back."""
        if not self.has(name):
            temporary = f"_{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{temporary}")
            self._rename(temporary, name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def save(self, name: str, value: dict) -> None:
        """Replace a JSON document: at no time is it half-written."""
        temporary = f"_{name}-{uuid.uuid4().hex}"
        path, fs = self._at(temporary)
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        stream.close()
        self._rename(temporary, name)

    def load(self, name: str) -> dict | None:
        """The document, or None if it is missing or damaged."""
        if not self.has(name):
            return None
        try:
            return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])
        except (ValueError, TypeError):
            return None

    def clear(self, name: str = "") -> None:
        """Delete one entry, or the whole folder."""
        path, fs = self._at(name)
        fs.delete(path, True)
