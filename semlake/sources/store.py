"""Small files that the driver keeps beside written tables: manifests, committed last, read first."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, where = place(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def put_json(spark: SparkSession, path: str, value) -> None:
    """Write a value so that it is there whole or not at all; one that is there already stays (a ValueError)."""
    fs, where = place(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), "." + where.getName() + ".new")
    out = fs.create(side, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if fs.exists(where) or not fs.rename(side, where):
        fs.delete(side, False)
        raise ValueError(f"{path} is there already")


def get_json(spark: SparkSession, path: str):
    fs, where = place(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = place(spark, path)
    fs.delete(where, True)


class Versions:
    """Numbered manifests in a folder; the highest number is the present state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, self.path) if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int | None = None) -> tuple[int, dict | None]:
        """(number, manifest) of a version, or of the last one; (-1, None) where there is none."""
        if number is None:
            number = max(self.numbers(), default=-1)
        return (number, get_json(self.spark, f"{self.path}/{number}.json")) if number >= 0 else (-1, None)

    def commit(self, number: int, manifest: dict) -> None:
        put_json(self.spark, f"{self.path}/{number}.json", manifest)

    def forget(self, keep: int) -> list[dict]:
        """Delete all manifests but the last `keep`; those that stay."""
        numbers = self.numbers()
        stay = [self.read(n)[1] for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/{n}.json")
        return stay
