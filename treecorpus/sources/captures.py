"""Captured JSON files as provenance-tagged records."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treecorpus.functions.classify import is_sidecar, resolved_url
from treecorpus.functions.urls import odata_id, odata_type, url_from_file_name
from treecorpus.schemas import TRUST


FILE_SCHEMA = "path string, modified timestamp, content string"
READ_BYTES = 8 << 20


def _entries(folder: str, recursive: bool):
    system, path = fs.FileSystem.from_uri(folder)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    return system.get_file_info(fs.FileSelector(path, recursive=recursive, allow_not_found=True))


def _tasks(spark: SparkSession) -> int:
    """Names are few bytes, by which adaptive execution would merge all tasks into one: a fixed number."""
    return max(16, 4 * spark.sparkContext.defaultParallelism)


def read_folders(folders: DataFrame, glob: str = "*.json", levels: int = 4) -> DataFrame:
    """``(origin, path, modified, content)`` of matching files below each ``origin`` of ``folders``.

    An origin is a folder or a file, as an absolute path or a URI of a file system that Arrow knows;
    a missing one gives no rows. Capture names start with an underscore, which Spark's own file
    sources treat as hidden, so tasks list and open the files themselves. Folders are expanded level
    by level, each level spread over all tasks; what lies below the last level is listed whole by
    the task of its folder. Undecodable bytes are replaced.
    """
    spark = folders.sparkSession
    shape = "origin string, name string, is_file boolean"

    def listing(recursive: bool):
        def stage(batches):
            for batch in batches:
                for origin, name, is_file in zip(*(batch.column(c).to_pylist() for c in ("origin", "name", "is_file"))):
                    scheme = name.split("://")[0] + "://" if "://" in name else ""
                    found = [(name, True)] if is_file else [
                        (scheme + f.path, f.type == fs.FileType.File) for f in _entries(name, recursive)]
                    for start in range(0, len(found), 10_000):
                        part = found[start:start + 10_000]
                        yield pa.RecordBatch.from_pydict({
                            "origin": pa.array([origin] * len(part), pa.string()),
                            "name": pa.array([n for n, _ in part], pa.string()), "is_file": pa.array([f for _, f in part], pa.bool_())})
        return stage

    def contents(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_pydict({
                "origin": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()),
                "modified": pa.array([r[2] for r in rows], pa.timestamp("us", "UTC")),
                "content": pa.array([r[3] for r in rows], pa.string())})

        rows, held = [], 0
        for batch in batches:
            for origin, name in zip(batch.column("origin").to_pylist(), batch.column("name").to_pylist()):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_stream(path) as stream:
                    raw = stream.read()
                rows.append((origin, name, system.get_file_info(path).mtime, raw.decode("utf-8", errors="replace")))
                held += len(raw)
                if held > READ_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    tasks = _tasks(spark)
    found = folders.select("origin", F.col("origin").alias("name"), F.lit(False).alias("is_file"))
    for level in range(levels):
        found = found.repartition(max(16, tasks // 2), "name").mapInArrow(listing(level == levels - 1), shape)
    pattern = "^" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    named = found.filter(F.col("is_file") & F.substring_index("name", "/", -1).rlike(pattern)).select("origin", "name")
    return named.repartition(tasks, "name").mapInArrow(contents, "origin string, " + FILE_SCHEMA)


def read_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``(path, modified, content)`` of matching files below ``root``; see :func:`read_folders`."""
    return read_folders(spark.range(1).select(F.lit(root).alias("origin")), glob).drop("origin")


def write_files(files: DataFrame) -> int:
    """Write each ``(path, content)`` as one file, in tasks; returns how many.

    A task that is run again writes the same files again.
    """

    def stage(batches):
        for batch in batches:
            for name, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                system, path = fs.FileSystem.from_uri(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as stream:
                    stream.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    named = files.select("path", "content").repartition(_tasks(files.sparkSession), "path")
    return named.mapInArrow(stage, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``file_name`` and ``reason`` (null for a usable capture)."""
    top = F.schema_of_variant(F.try_parse_json("content"))
    name = F.substring_index("path", "/", -1)
    keys = F.json_object_keys("content")
    reason = (
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty")
        # Duplicate keys are valid JSON for the walk although VARIANT refuses them.
        .when(top.isNull() & keys.isNull(), "malformed")
        .when(keys.isNull(), "not an object")
        .when(is_sidecar(name, F.col("content")), "sidecar")
    )
    return files.withColumns({"file_name": name, "reason": reason})


def captures(files: DataFrame, source: str | Column, trust: str = "REAL", vendor: str | Column | None = None,
             corpus_id: str | Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records of the usable files among ``(path, content)``; ``seq`` orders by path.

    Source, vendor and corpus are values or columns of ``files``; ``keep`` are columns to carry on.
    """
    good = classify_files(files).filter("reason is null")
    given = lambda value: value if isinstance(value, Column) else F.lit(value)
    own = odata_id(F.col("content"))
    url = resolved_url(F.col("content"), url_from_file_name(F.col("file_name")))
    return good.select(
        url.alias("url"), F.col("path").alias("seq"), given(source).alias("source"),
        F.lit(TRUST[trust]).alias("trust"), F.lit("GET").alias("method"),
        given(vendor).cast("string").alias("vendor"),
        F.coalesce(odata_type(F.col("content")), F.lit("")).alias("schema_version"),
        F.when(url.eqNullSafe(own), "odata").otherwise("filename").alias("url_from"),
        given(source if corpus_id is None else corpus_id).alias("corpus_id"), F.col("content").alias("body"), *keep)


def quarantine(files: DataFrame) -> DataFrame:
    """Skipped files with the reason."""
    return classify_files(files).filter("reason is not null").select("path", "reason")


def read_captures(spark: SparkSession, root: str, source: str, trust: str = "REAL", vendor: str | None = None,
                  glob: str = "*.json", corpus_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records, skipped)`` of a folder; a missing folder gives none of either."""
    files = read_files(spark, root, glob)
    return captures(files, source, trust, vendor, corpus_id), quarantine(files)


def attach_allowed_methods(records: DataFrame, method_map: DataFrame) -> DataFrame:
    """Left lookup of ``(url, methods)`` by URL."""
    found = method_map.select("url", F.col("methods").alias("allowed_methods"))
    return records.drop("allowed_methods").join(found, "url", "left")


def method_maps(files: DataFrame) -> DataFrame:
    """``(path, url, methods)`` from the portable map documents."""
    mapping = F.from_json(F.get_json_object("content", "$.allowed_methods_mapping"), "map<string,array<string>>")
    return files.select("path", F.explode(mapping).alias("url", "methods"))


def manifest_corpora(manifest: DataFrame, kind: str = "dataset", ids: list[str] | None = None) -> DataFrame:
    """Selected rows of a corpus manifest document ``(content)``: id, slug, kind, vendor, model, capture, place."""
    schema = ("corpora array<struct<id:string,corpus_id:string,kind:string,archive:string,archive_path:string,"
              "vendor:string,model:string,capture_id:string>>")
    rows = manifest.select(F.posexplode(F.from_json("content", schema)["corpora"]).alias("adapter", "c")).select("adapter", "c.*")
    plain = lambda c: F.when(F.lower(c) == "full", "dataset").otherwise(F.lower(c))
    archive = F.substring_index(F.coalesce(F.nullif("archive", F.lit("")), F.nullif("archive_path", F.lit(""))), "/", -1)
    stem = F.when(archive.endswith(".tar.gz"), F.regexp_replace(archive, r"\.tar\.gz$", "")).otherwise(
        F.regexp_replace(archive, r"(?<=.)\.[^.]*$", ""))
    named = F.concat(F.trim(F.coalesce("vendor", F.lit(""))), F.lit("_"), F.trim(F.coalesce("model", F.lit(""))))
    slug = F.coalesce(stem, F.regexp_replace(named, "^_+|_+$", ""))
    own = F.coalesce(F.nullif("id", F.lit("")), F.nullif("corpus_id", F.lit("")), F.lit(""))
    wanted_kind = "dataset" if kind.lower() == "full" else kind.lower()
    rows = rows.withColumns({"corpus": own, "slug": slug, "plain_kind": plain(F.coalesce("kind", F.lit("")))})
    rows = rows.filter(F.col("plain_kind") == wanted_kind)
    if ids:
        rows = rows.filter(F.col("corpus").isin(list(ids)))
    return rows.select(
        F.coalesce(F.nullif("corpus", F.lit("")), "slug").alias("corpus_id"), "slug", F.col("plain_kind").alias("kind"),
        "vendor", "model", "capture_id", "adapter")


def corpus_folders(corpora: DataFrame, root: str) -> DataFrame:
    """Add ``origin``: the folder of each corpus, ``root/kind/slug`` where that is there, else ``root/slug``."""

    def stage(batches):
        for batch in batches:
            there = []
            for name in batch.column("origin").to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                there.append(system.get_file_info(path).type != fs.FileType.NotFound)
            yield pa.RecordBatch.from_arrays([batch.column("origin"), pa.array(there, pa.bool_())], ["origin", "there"])

    nested = F.concat_ws("/", F.lit(root), "kind", "slug")
    asked = corpora.select(nested.alias("origin")).distinct()
    known = asked.repartition(_tasks(asked.sparkSession), "origin").mapInArrow(stage, "origin string, there boolean")
    rows = corpora.withColumn("nested", nested).join(known.withColumnRenamed("origin", "nested"), "nested")
    return rows.withColumn("origin", F.when(F.col("there"), F.col("nested")).otherwise(F.concat_ws("/", F.lit(root), "slug"))).drop("nested", "there")


def sources_from_manifest(spark: SparkSession, manifest_path: str, root: str, trust: str = "REAL",
                          kind: str = "dataset", ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(records, skipped)`` of every corpus a manifest names; ``adapter`` is its place in the manifest.

    The folders of all corpora are read as one table. Records carry the methods of their corpus's
    map file, null where it has none for the URL.
    """
    corpora = corpus_folders(manifest_corpora(read_files(spark, manifest_path), kind, ids), root)
    files = read_folders(corpora.select("origin").distinct()).join(corpora.select("origin", "corpus_id", "vendor", "adapter"), "origin")
    records = captures(files, F.col("corpus_id"), trust, F.col("vendor"), keep=["origin", "adapter"])
    at = F.concat("origin", F.lit("/rest_api_map.v1.json")).alias("origin")
    maps = method_maps(read_folders(corpora.select(at).distinct(), levels=1)).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("origin"), "url", F.col("methods").alias("allowed_methods"))
    return records.join(maps, ["origin", "url"], "left").drop("origin"), quarantine(files)


def merge_capture_maps(maps: DataFrame) -> DataFrame:
    """One ``(url, file, methods)`` table from map documents ``(host, host_ord, modified, content)``.

    Per host the newest map counts. File names are re-rooted at ``/<host>/``. Hosts are united; on a
    URL of several hosts the later host wins. A host without a map has no row here.
    """
    newest = maps.groupBy("host").agg(
        F.max_by(F.struct("content", "host_ord"), "modified").alias("m")).select("host", "m.*")
    pick = lambda name, kind: F.from_json(F.get_json_object("content", f"$.{name}"), kind)
    files = newest.select("host", "host_ord", F.explode(pick("url_file_mapping", "map<string,string>"))
                          .alias("url", "file"))
    methods = newest.select(
        "host_ord", F.explode(pick("allowed_methods_mapping", "map<string,array<string>>")).alias("url", "methods"))
    at = F.expr(
        "locate(concat('/', host, '/'), file)")
    rooted = F.when(at > 0, F.expr("substring(file, locate(concat('/', host, '/'), file))")).otherwise(F.col("file"))
    last_files = files.withColumn("file", rooted).groupBy("url").agg(F.max_by("file", "host_ord").alias("file"))
    last_methods = methods.groupBy("url").agg(F.max_by("methods", "host_ord").alias("methods"))
    return last_files.join(last_methods, "url", "full")


def sample_capture_archive(url_files: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """First ``n`` URLs (sorted) whose file is among the members ``(base, member, content)``.

    A file name resolves as ``base/name``, ``base/basename`` or the name without its leading slash,
    in this order; then by base name anywhere below the base.
    """
    base_name = F.substring_index("file", "/", -1)
    tries = F.array(
        F.concat_ws("/", "base", "file"), F.concat_ws("/", F.col("base"), base_name),
        F.regexp_replace("file", "^/+", ""))
    asked = url_files.select("*", F.posexplode(tries).alias("choice", "member"))
    known = members.select("member", "content")
    direct = asked.join(known, "member").groupBy("url", "base", "file").agg(
        F.min_by(F.struct("member", "content"), "choice").alias("m"))
    rest = url_files.join(direct.select("url", "base"), ["url", "base"], "left_anti").withColumn("name", base_name)
    by_name = members.select("base", F.substring_index("member", "/", -1).alias("name"), "member", "content")
    loose = rest.join(by_name, ["base", "name"]).groupBy("url", "base", "file").agg(
        F.min_by(F.struct("member", "content"), "member").alias("m"))
    hits = direct.unionByName(loose).select("url", "base", "m.*").filter(F.try_parse_json("content").isNotNull())
    extra = url_files.select("url", "base", "methods")
    return hits.join(extra, ["url", "base"], "left").withColumn(
        "method", F.upper(F.coalesce(F.try_element_at("methods", F.lit(1)), F.lit("GET")))
    ).orderBy("base", "url").limit(n)
