"""Relations in versions: a commit writes a new folder, then one pointer file; readers pin a version, and see a whole one or none.

A pointer `v<number>` names its data folder and is made by renaming a finished file to a name that must not exist. So a job that dies leaves
the version before in place, and of two writers of one number one fails. Folders are reached by Spark's own file systems.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer made the version that this one was to be."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing in one that isn't there."""
    fs, at = _files(spark, folder), _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """A rename that fails where the target exists."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(_path(spark, source), _path(spark, target), options)


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(n[1:]) for n in names(spark, folder) if n.startswith("v") and n[1:].isdigit()]


def _pointer(folder: str, version: int) -> str:
    return f"{folder}/v{version:012}"


def _named(spark: SparkSession, folder: str, version: int) -> str:
    return spark.read.text(_pointer(folder, version)).first()[0]


def commit(df: DataFrame, folder: str, expected: int | None = None, by: tuple[str, ...] = (), **options: str) -> int:
    """Write df as the next version of the folder's relation and give its number.

    expected: the version that df was made from; if another one has come since, nothing is committed. Without it the last writer wins.
    by: columns that make folders; options: the writer's.
    """
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).options(**options).parquet(f"{folder}/{data}")
    note = f"{folder}/_note-{uuid.uuid4().hex}"
    out = _files(spark, note).create(_path(spark, note), False)
    out.write(bytearray(data.encode()))
    out.close()
    while True:
        latest = max(versions(spark, folder), default=0)
        if expected is not None and latest != expected:
            break
        try:
            move(spark, note, _pointer(folder, latest + 1))
            return latest + 1
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
    remove(spark, note)
    remove(spark, f"{folder}/{data}")
    raise Conflict(f"{folder} is at version {latest}, not {expected}")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, or the latest one."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{folder} has no version {version or ''}".rstrip())
    return spark.read.parquet(f"{folder}/{_named(spark, folder, version or max(known))}")


def forget(spark: SparkSession, folder: str, keep: int) -> list[int]:
    """Remove all but the last `keep` versions, pointers first, and give the removed ones. Data without a pointer may be a commit under way and stays."""
    gone = versions(spark, folder)[: -max(1, keep)]
    for version in gone:
        data = _named(spark, folder, version)
        remove(spark, _pointer(folder, version))
        remove(spark, f"{folder}/{data}")
    return gone


def put(blobs: dict[str, DataFrame], folder: str, allowed: set[str], keep: int = 2) -> dict[str, str]:
    """Replace whole relations by key; keys that aren't allowed are ignored. The outcome a key: ok, ignored, or why it failed.

    A relation that fails keeps its version, and the others aren't held up.
    """
    out = {}
    for key, df in blobs.items():
        if key not in allowed:
            out[key] = "ignored"
            continue
        try:
            commit(df, f"{folder}/{key}")
            forget(df.sparkSession, f"{folder}/{key}", keep)
            out[key] = "ok"
        except Exception as e:
            out[key] = f"failed: {str(e).splitlines()[0][:200]}"
    return out


def autosave(draft: DataFrame, folder: str, seen: int, keep: int = 5) -> int:
    """Save a draft after an edit: on top of the version that the editor has seen, or not at all. The last few can be gone back to."""
    version = commit(draft, folder, expected=seen)
    forget(draft.sparkSession, folder, keep)
    return version
