"""Results published as whole tables: written aside, listed in a manifest, and read only as listed.

A table is a folder with ``manifest.json`` and one data folder per publication. Data files are
written first, under a name of their own; then the manifest, which names each file with its size,
replaces the one before in one rename. A job that dies leaves files that no manifest names, and
readers see the whole old table or the whole new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.sources.csvgrid import csv_records

_MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Data files of a folder and their sizes."""
    listed = _system(spark, folder).listStatus(_path(spark, folder))
    return {s.getPath().getName(): s.getLen() for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", "."))}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and give it its name in one step, in place of an older one."""
    jvm, aside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    out = _system(spark, path).create(_path(spark, aside))
    out.write(text.encode())
    out.close()
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, aside), _path(spark, path), options)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What a table's manifest says; None where nothing was published."""
    where = f"{path}/{_MANIFEST}"
    if not _system(spark, where).exists(_path(spark, where)):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(where).collect()))


def publish(df: DataFrame, path: str, fmt: str = "parquet", write: Callable[[DataFrame, str], None] | None = None,
            mode: str = "errorifexists") -> dict:
    """Publish ``df`` at ``path`` and return the manifest.

    ``write`` writes files of its own kind to a folder (``fmt`` then says how they are read);
    else Spark's writer of ``fmt`` does. With ``mode="overwrite"`` a new publication takes the
    place of the old one, whose files stay until ``discard_old``.
    """
    spark = df.sparkSession
    before = manifest(spark, path)
    if before and mode != "overwrite":
        raise ValueError(f"{path} is published already")
    folder, rows = f"data-{uuid.uuid4().hex}", Observation()
    counted = df.observe(rows, F.count(F.lit(1)).alias("n"))
    if write:
        write(counted, f"{path}/{folder}")
    else:
        counted.write.format(fmt).save(f"{path}/{folder}")
    said = {"version": before["version"] + 1 if before else 1, "format": fmt, "folder": folder, "rows": rows.get["n"],
            "schema": json.loads(df.schema.json()), "files": _files(spark, f"{path}/{folder}")}
    _put(spark, f"{path}/{_MANIFEST}", json.dumps(said, indent=1))
    return said


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published rows; an error where a listed file is missing or has another size.

    Text formats come back as they were written: the cells of ``csv`` are text.
    """
    said = manifest(spark, path)
    if said is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    folder = f"{path}/{said['folder']}"
    there = _files(spark, folder)
    wrong = sorted(name for name, size in said["files"].items() if there.get(name) != size)
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong[:5])} missing or changed")
    files, schema = [f"{folder}/{name}" for name in sorted(said["files"])], T.StructType.fromJson(said["schema"])
    if not files:
        return spark.createDataFrame([], schema)
    if said["format"] == "csv":
        cells = csv_records(spark, files).where("source_row > 1")
        return cells.select(*[F.get("cells", F.lit(i)).alias(f.name) for i, f in enumerate(schema.fields)])
    return spark.read.schema(schema).format(said["format"]).load(files)


def discard_old(spark: SparkSession, path: str) -> list[str]:
    """Remove the data folders that the manifest does not name; returns their names."""
    said = manifest(spark, path)
    if said is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    system = _system(spark, path)
    old = [s.getPath() for s in system.listStatus(_path(spark, path))
           if s.isDirectory() and s.getPath().getName().startswith("data-") and s.getPath().getName() != said["folder"]]
    for folder in old:
        system.delete(folder, True)
    return sorted(p.getName() for p in old)


def publish_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict[str, dict]:
    """Role tables, or the tables of an analysis, each published under its name."""
    return {name: publish(table, f"{folder}/{name}", fmt, mode=mode) for name, table in tables.items()}
