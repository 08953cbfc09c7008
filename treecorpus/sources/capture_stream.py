"""A growing folder of captured files as a stream, by the Python Data Source API.

Spark's own file streams skip names that start with an underscore, as capture names do. Here the
offset is a time: a micro-batch holds the files last written after the old offset and up to the new
one, so the driver keeps no list of files. The folder is listed in the tasks, each of which takes
its share of the folders.
"""

from __future__ import annotations

import time
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from treecorpus.sources import captures
from treecorpus.streaming.folds import follow

FILE_SCHEMA = "path string, modified timestamp, content string"
BATCH_BYTES = 8 << 20


class Share(InputPartition):
    """One of ``shares`` parts of the folder, and the times between which its files were written."""

    def __init__(self, place: int, shares: int, after: int, until: int):
        super().__init__(place)
        self.place, self.shares, self.after, self.until = place, shares, after, until


class CaptureReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.ending = options.get("ending", ".json")
        self.shares = int(options.get("shares", "16"))
        self.settle = int(float(options.get("settle", "1")) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict):
        return [Share(i, self.shares, start["until"], end["until"]) for i in range(self.shares)]

    def commit(self, end: dict) -> None:
        pass

    def _files(self, part: Share):
        """The share's files: what lies in the first two levels by file, what lies deeper by the folder of the second."""
        system, root = fs.FileSystem.from_uri(self.root)
        mine = lambda path: zlib.crc32(path.encode()) % part.shares == part.place
        listed = lambda path, deep: system.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True))
        for top in listed(root, False):
            for info in [top] if top.type == fs.FileType.File else listed(top.path, False):
                if mine(info.path):
                    yield from [info] if info.type == fs.FileType.File else (x for x in listed(info.path, True) if x.type == fs.FileType.File)

    def read(self, partition: Share):
        system, _ = fs.FileSystem.from_uri(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        rows, held = [], 0

        def batch():
            names, times, texts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(times, pa.timestamp("us", "UTC")), pa.array(texts)], ["path", "modified", "content"])

        for info in self._files(partition):
            if info.path.endswith(self.ending) and partition.after < info.mtime_ns <= partition.until:
                with system.open_input_stream(info.path) as stream:
                    raw = stream.read()
                rows.append((scheme + info.path, info.mtime_ns // 1000, raw.decode("utf-8", errors="replace")))
                held += len(raw)
                if held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class CaptureFolder(DataSource):
    """``spark.readStream.format("capture_folder").load(root)``: ``path, modified, content`` of the files below a folder.

    Options: ``ending`` of the names (``.json``), ``shares`` (16 tasks), and ``settle``: the seconds (1) for
    which a file must have been left alone before it is read, so that a file still being written, or
    stamped by a coarse clock, falls into the next batch. Files are taken once, by their time of
    writing: files that appear with an old time (a copy that keeps times) are not seen once the
    offset has passed it.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_folder"

    def schema(self) -> str:
        return FILE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureReader(dict(self.options))


def capture_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """The stream of files below ``root``; see :class:`CaptureFolder`."""
    spark.dataSource.register(CaptureFolder)
    return spark.readStream.format("capture_folder").options(**{k: str(v) for k, v in options.items()}).load(root)


def ingest_folder(spark: SparkSession, root: str, at: str, source: str, trust: str = "REAL", vendor: str | None = None,
                  **options) -> tuple[DataFrame, DataFrame]:
    """``(records, skipped)`` of all files that were ever ingested from ``root``; called again, it takes what is new.

    ``at`` is a folder for the classified files and the stream's progress. The results are those of
    :func:`captures.read_captures` over the same files; sidecars, empty and broken files are in
    ``skipped`` with a reason. Each file is read once.
    """
    files = capture_files(spark, root, **options)
    shape = captures.classify_files(files).schema
    follow(spark, captures.classify_files(files), f"{at}/files", f"{at}/progress")
    kept = spark.read.schema(shape).parquet(f"{at}/files")
    return captures.captures(kept, source, trust, vendor), kept.filter("reason is not null").select("path", "reason")
