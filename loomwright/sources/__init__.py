"""Where documents and transcripts come from, and where results go."""

from __future__ import annotations

import os
import stat
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(path, content) of every file that fits, one document a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files as binary lines split at LF, numbered from 0; a last empty line is none.

    Large files are read in splits, each by a task of its own, and never held whole. A line's number is its
    place in its split and the number of lines in the splits before, of which only counts are gathered.
    Bytes that are no UTF-8 stay as they are.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    m = F.col("_metadata")
    # a task reads its splits in order, so these numbers ascend within a split
    rows = read.select(m["file_path"].alias("path"), m["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("line"))
    splits = rows.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_split")) - F.col("_n")
    starts = splits.select("path", "_split", "_first", before.alias("_before"))
    return rows.join(starts, ["path", "_split"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("line_no"), "line")


@dataclass
class Walk:
    """Transcript files under a folder, in the order of their path components, and what was passed over."""

    files: list[str] = field(default_factory=list)
    skipped: int = 0
    unreadable: int = 0


def walk(root: str, suffix: str = ".jsonl", spark: SparkSession | None = None) -> Walk:
    """Regular ``*.jsonl`` files below a folder; links and special files are skipped and counted.

    With a session the folder may be on any store that Spark reads, else it is a local one. A single file
    is taken whatever its name; a root that cannot be read is an error."""
    listing = _local_entries if spark is None else _store_entries(spark)
    kind = listing(root, only=True)
    if kind == "file":
        return Walk([root])
    out, todo = Walk(), [root]
    while todo:
        folder = todo.pop()
        try:
            entries = listing(folder)
        except OSError:
            if folder == root:
                raise
            out.unreadable += 1
            continue
        for path, kind in entries:
            if kind == "folder":
                todo.append(path)
            elif path.endswith(suffix):
                if kind == "file":
                    out.files.append(path)
                else:
                    out.skipped += 1
    out.files.sort(key=lambda p: p.split("/"))
    return out


def _local_entries(path: str, only: bool = False):
    """The entries of a local folder with their kinds, or the kind of one path."""
    if only:
        return "file" if stat.S_ISREG(os.stat(path).st_mode) else "folder"
    kind = lambda e: "folder" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"
    with os.scandir(path) as found:
        return [(e.path, kind(e)) for e in found]


def _store_entries(spark: SparkSession):
    """The same by Hadoop's file systems."""
    from py4j.protocol import Py4JJavaError

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def entries(path: str, only: bool = False):
        kind = lambda x: "other" if x.isSymlink() else "folder" if x.isDirectory() else "file"
        there = at(path)
        try:
            store = there.getFileSystem(conf)
            if only:
                return kind(store.getFileStatus(there))
            return [(x.getPath().toString(), kind(x)) for x in store.listStatus(there)]
        except Py4JJavaError as e:
            raise OSError(f"{path} cannot be read: {e.java_exception.getMessage()}") from None

    return entries


def path_order(path: Column) -> Column:
    """Sorts paths component by component."""
    return F.split(path, "/")


def write_archives(df: DataFrame, path: str, key: str, blob: str) -> None:
    """Archives as a Parquet table (key, archive), replaced as a whole or not at all."""
    df.select(F.col(key), F.col(blob).alias("archive")).write.mode("overwrite").parquet(path)


def write_renderings(df: DataFrame, path: str, key: str, rendering: str) -> None:
    df.select(F.col(key), F.col(rendering).alias("rendering")).write.mode("overwrite").parquet(path)


def stats_line(stats: Column) -> Column:
    """A JSON line of a statistics struct, in field order, nulls kept."""
    return F.to_json(stats, {"ignoreNullFields": "false"})


def stats_text(stats: Column) -> Column:
    """A statistics struct as aligned lines, ratios with four digits."""
    rows = [("bytes before", "bytes_before", "%d"), ("bytes after", "bytes_after", "%d"), ("tokens before", "est_tokens_before", "%d"), ("tokens after", "est_tokens_after", "%d"), ("encoder", "encoder", "%d"), ("byte ratio", "byte_ratio", "%.4f"), ("token ratio", "token_ratio", "%.4f")]
    return F.concat_ws("\n", *[F.format_string(f"%-15s{form}", F.lit(label), stats[name]) for label, name, form in rows])
