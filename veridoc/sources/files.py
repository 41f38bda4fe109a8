"""Folders of files as tables: claims by folder or file name, and the documents of a claim."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classification as K
from ..operators import extraction as E
from .scratch import own_folder
from .workbooks import opened

DEEPEST = 5
#: Entries after which a task opens no further folder in a round: few at first, so that what it found is dealt out soon.
ROUNDS = (1_000, 8_000, 64_000)
#: Rows of a batch that goes to Spark.
BATCH = 10_000
ENTRY = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("unopened", pa.bool_())])


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out: those of unfinished writes and marks."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """What a folder has: name, whether it is a folder, size, milliseconds of its last change. A local one is streamed."""
    if not isinstance(store, fs.LocalFileSystem):
        for i in store.get_file_info(fs.FileSelector(folder)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(folder) as found:
        for e in found:
            try:
                at = e.stat()
            except FileNotFoundError:  # a link to nothing
                continue
            yield e.name, e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000


def opened_folders(folders: DataFrame, root: str, most: int, recursive: bool) -> DataFrame:
    """Files in folders (path below the root) and below them, and, once a task has seen most entries, the folders that it leaves unopened."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        rows: list[tuple] = []
        seen = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(ENTRY.types)], schema=ENTRY)
            rows.clear()
            return batch

        for batch in batches:
            for start in batch.column(0).to_pylist():
                left = [start]
                while left:
                    folder = left.pop()
                    if seen >= most:
                        rows.append((folder, None, None, True))
                    else:
                        for name, is_folder, size, changed in entries(store, f"{base}/{folder}" if folder else base):
                            seen += 1
                            path = f"{folder}/{name}" if folder else name
                            if hidden(name):
                                continue
                            if not is_folder:
                                rows.append((path, size, changed * 1000, False))
                            elif recursive and seen < most:
                                left.append(path)
                            elif recursive:
                                rows.append((path, None, None, True))
                            if len(rows) >= BATCH:
                                yield out()
                    if len(rows) >= BATCH:
                        yield out()
        if rows:
            yield out()

    return folders.mapInArrow(walk, "path string, size long, modified timestamp, unopened boolean")


def files_below(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """path below the root, size, modified of its files, listed by tasks and stored.

    Folders are opened in rounds: a task goes down from those it was given, and what it leaves unopened is dealt to the
    tasks of the next round. The driver gets their number alone. One folder's entries are read by one task, in a stream.
    """
    store, many, rounds = own_folder(spark, "listing"), 1, []
    folders = spark.createDataFrame([("",)], "path string")
    while many:
        rounds.append(f"{store}/{len(rounds)}")
        most = ROUNDS[min(len(rounds), len(ROUNDS)) - 1]
        opened_folders(folders.repartition(min(many, E.tasks(spark))), root, most, recursive).write.parquet(rounds[-1])
        folders = spark.read.parquet(rounds[-1]).where("unopened").select("path")
        many = folders.count()
    return spark.read.parquet(*rounds).where("not unopened").drop("unopened")


def files_by_spark(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """As files_below, by Spark's own listing, which keeps the status of every file on the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    base = root.rstrip("/") + "/"
    below = F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/")
    rel = F.substr(below, F.lit(len(base) + 1), F.length(below)) if base.startswith("/") else F.element_at(F.split("path", base), -1)
    return raw.withColumn("path", rel)


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files under a folder, without reading them: path below the root, name, folder, depth, size, modified.

    Tasks list them, but in a store that Arrow can't open.
    """
    root = root.rstrip("/") or "/"
    root = root if re.match(r"[a-z][a-z0-9+.-]*:/", root) else os.path.abspath(root)
    try:
        opened(root)
        found = files_below(spark, root, recursive)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        found = files_by_spark(spark, root, recursive)
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), (F.size(parts) - 1).alias("depth"), "size", "modified")


def claim_id(name: Column, start: int, length: int) -> Column:
    """The part of a name that a rule (start from 1, length) takes for the claim's id; null where there is none."""
    return F.nullif(F.trim(F.substring(name, start, length)), F.lit(""))


def reject(name: Column, start: int, length: int) -> Column:
    """Why a name has no claim id; null where it has one."""
    return F.when(F.length(name) < start + length - 1, "NAME_TOO_SHORT").when(F.trim(F.substring(name, start, length)) == "", "EMPTY_CLAIM_ID")


def file_claims(files: DataFrame, start: int, length: int) -> DataFrame:
    """Files directly in the root as claims: path, claim, problem."""
    stem = F.regexp_replace("name", r"\.[^.]*\z", "")
    problem = reject(stem, start, length)
    return files.where("depth = 0").select("path", F.when(problem.isNull(), claim_id(stem, start, length)).alias("claim"), problem.alias("problem"))


def folder_claims(files: DataFrame, start: int, length: int, deepest: int = DEEPEST) -> DataFrame:
    """Folders, down to a depth, whose names have a claim id, and loose files that no such folder holds: path, claim, kind."""
    parts = F.split("folder", "/")
    inside = files.where((F.col("folder") != "") & (F.col("depth") <= deepest)).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), F.get(parts, n - 1).alias("name")))).alias("f")).select("f.*").distinct()
    folders = inside.where(reject(F.col("name"), start, length).isNull()).select("path", claim_id(F.col("name"), start, length).alias("claim"), F.lit("FOLDER").alias("kind"))
    stem = F.regexp_replace("name", r"\.[^.]*\z", "")
    # a file's own folder is among these folders if its name has an id, so no file needs to meet them
    held = (F.col("folder") != "") & reject(F.get(parts, F.size(parts) - 1), start, length).isNull()
    loose = files.where((F.col("depth") <= deepest) & reject(stem, start, length).isNull() & ~held)
    return folders.unionByName(loose.select("path", claim_id(stem, start, length).alias("claim"), F.lit("FILE").alias("kind")))


def documents(files: DataFrame, claims: DataFrame, types: list[dict], known: DataFrame) -> DataFrame:
    """Files directly in claims' folders that aren't known (claim, path): claim, path, name, type (by name), mime, size."""
    met = files.join(claims.where("kind = 'FOLDER'").select(F.col("path").alias("folder"), "claim"), "folder")
    fresh = met.join(known.select("claim", "path"), ["claim", "path"], "left_anti")
    return fresh.select("claim", "path", "name", K.file_type(F.col("name"), types).alias("type"), T.mime_type(F.col("name")).alias("mime"), "size")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one a line, as a table (word); lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where(~F.col("word").rlike(r"\A(?:#|\z)")).distinct()
