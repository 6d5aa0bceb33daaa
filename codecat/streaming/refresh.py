"""Refresh of a catalogue (S5): versioned snapshots per repository behind one committed manifest.

The reference rebuilds its whole index when ``Index()`` is called again.  Here
a refresh compares the listing of the source root with the listing that the
catalogue was built from, rebuilds the repositories that differ, and leaves the
others as they are:

    data/<table>/version=<v>/repo=<r>/    the rows of one repository, written once, never changed
    listing/<v>/                          (repo, file, length, modified) of the sources at that version
    schemas/<v>/                          (table, schema)
    manifest/<v>/                         (repo, version): where each repository's rows are

A version counts from the moment its manifest is complete (its ``_SUCCESS``
file, which Spark writes last).  Until then readers see the previous one, so a
refresh that fails between two tables changes nothing, and the next one does the
work again.  A repository that no longer fills a table has no rows there in its
new version; a repository that is gone is in no manifest.  Imports are resolved
within each repository, so a rebuilt one does not depend on which others were
rebuilt with it.

``start`` runs a refresh whenever files arrive (Structured Streaming); the
stream's checkpoint makes it restartable, and a batch that is run again finds
nothing to do.  Deleted files cause no event of their own and are found by the
next refresh, scheduled or caused by another file.

Layout of the sources: ``<source_root>/<repo>/...`` — the first path element
under the root is the repository.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecat.operators.symbol_index import INDEX_TABLES, with_symbol_index
from codecat.plans.catalog import TABLES, build_catalog, read_source_tree, repo_of
from codecat.schemas import Catalog
from codecat.session import cut_lineage, scratch_path

ALL_TABLES = (*TABLES, *INDEX_TABLES, "rejects")
_LISTING = "repo string, file string, length long, modified timestamp"
_MANIFEST = "repo string, version string"


def list_sources(spark: SparkSession, root: str) -> DataFrame:
    """(repo, file, length, modified) of every source file below ``root``; contents are not read."""
    def load(glob: str) -> DataFrame:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
                .select(repo_of(F.col("path"), root).alias("repo"), F.regexp_replace("path", r"^file:(//(?=/))?", "").alias("file"),
                        "length", F.col("modificationTime").alias("modified")))
    return load("*.go").unionByName(load("go.mod")).where(~F.col("file").endswith("_test.go"))


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, catalog_root: str) -> str | None:
    """The newest version whose manifest is complete; None before the first refresh."""
    root = catalog_root.rstrip("/")
    fs, at = _folder(spark, f"{root}/manifest")
    if not fs.exists(at):
        return None
    names = sorted((x.getPath().getName() for x in fs.listStatus(at)), reverse=True)
    return next((n for n in names if fs.exists(_folder(spark, f"{root}/manifest/{n}/_SUCCESS")[1])), None)


def manifest(spark: SparkSession, catalog_root: str, version: str | None = None) -> DataFrame:
    """(repo, version) of the current version, or of an earlier one."""
    version = version or current_version(spark, catalog_root)
    if version is None:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{catalog_root.rstrip('/')}/manifest/{version}")


def read_current(spark: SparkSession, catalog_root: str, version: str | None = None) -> tuple[Catalog, DataFrame]:
    """The catalogue and its rejects as of the current version, or of an earlier one.

    Each table is read through its manifest, a small table joined on both partition columns, so Spark prunes the
    partitions of other versions.  A table that no repository fills is empty.
    """
    root = catalog_root.rstrip("/")
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no catalogue at {catalog_root}")
    want = manifest(spark, root, version)
    schemas = {r.table: T.StructType.fromJson(json.loads(r.schema)) for r in spark.read.parquet(f"{root}/schemas/{version}").collect()}
    out = {}
    for name in (n for n in ALL_TABLES if n in schemas):  # a version of before the index has none
        parts = T.StructType([*schemas[name].fields, T.StructField("version", T.StringType()), T.StructField("repo", T.StringType())])
        df = spark.read.schema(parts).parquet(f"{root}/data/{name}")
        out[name] = df.join(want, ["repo", "version"], "left_semi").drop("version")
    rejects = out.pop("rejects")
    return Catalog(**out), rejects


def changed_repos(listing: DataFrame, before: DataFrame) -> DataFrame:
    """(repo) with a file that is new, changed or gone."""
    now = listing.join(before, ["repo", "file", "length", "modified"], "left_anti").select("repo")
    gone = before.join(listing, ["repo", "file"], "left_anti").select("repo")
    return now.unionByName(gone).distinct()


def refresh(spark: SparkSession, root: str, catalog_root: str, external_methods: DataFrame | None = None) -> str | None:
    """Bring the catalogue up to date with the sources; returns the new version, or None if nothing differs.

    The names of the changed repositories reach the driver, as the paths to read.
    """
    base = catalog_root.rstrip("/")
    old = current_version(spark, base)
    listing = cut_lineage(list_sources(spark, root))
    before = spark.read.schema(_LISTING).parquet(f"{base}/listing/{old}") if old else spark.createDataFrame([], _LISTING)
    changed = cut_lineage(changed_repos(listing, before))
    rebuild = listing.join(changed, "repo", "left_semi").select("repo").distinct()
    names = sorted(r.repo for r in rebuild.collect())
    if changed.isEmpty():
        return None
    version = f"{int(re.match('[0-9]+', old)[0]) + 1 if old else 1:010d}-{uuid.uuid4().hex[:8]}"
    kept = manifest(spark, base, old) if old else spark.createDataFrame([], _MANIFEST)
    if names:
        everything = listing.join(changed, "repo", "left_anti").isEmpty()
        paths = None if everything or "" in names else [f"{root.rstrip('/')}/{n}" for n in names]
        sources = read_source_tree(spark, root, paths).join(changed, "repo", "left_semi")
        cat, rejects = build_catalog(spark, cut_lineage(sources), external_methods, across_repos=False)
        cat = with_symbol_index(cat)
        frames = {**{n: getattr(cat, n) for n in (*TABLES, *INDEX_TABLES)}, "rejects": rejects}
        for name, df in frames.items():
            write_snapshot(df, f"{base}/data/{name}/version={version}")
        shapes = [(n, T.StructType([f for f in df.schema.fields if f.name != "repo"]).json()) for n, df in frames.items()]
    else:
        shapes = [tuple(r) for r in spark.read.parquet(f"{base}/schemas/{old}").select("table", "schema").collect()]
    spark.createDataFrame(shapes, "table string, schema string").coalesce(1).write.parquet(f"{base}/schemas/{version}")
    listing.write.parquet(f"{base}/listing/{version}")
    new = (kept.join(changed, "repo", "left_anti").unionByName(rebuild.withColumn("version", F.lit(version))))
    # The last write: with it the version counts.
    new.write.parquet(f"{base}/manifest/{version}")
    return version


def write_snapshot(df: DataFrame, path: str) -> None:
    """The rows of one table at one version, a partition per repository."""
    df.write.partitionBy("repo").parquet(path)


def vacuum(spark: SparkSession, catalog_root: str) -> int:
    """Delete what the current version does not need: versions that no row of its manifest names, unfinished ones as well.

    Only for times when nothing reads an earlier version and no refresh runs.  Returns the number of folders deleted.
    """
    base = catalog_root.rstrip("/")
    current = current_version(spark, base)
    if current is None:
        return 0
    needed = {r.version for r in manifest(spark, base, current).select("version").distinct().collect()}
    gone = 0
    for folder, keep in [*((f"data/{t}", {f"version={v}" for v in needed}) for t in ALL_TABLES),
                         *((d, {current}) for d in ("listing", "schemas", "manifest"))]:
        fs, at = _folder(spark, f"{base}/{folder}")
        for x in fs.listStatus(at):
            if x.isDirectory() and x.getPath().getName() not in keep:
                fs.delete(x.getPath(), True)
                gone += 1
    return gone


def start(spark: SparkSession, root: str, catalog_root: str, checkpoint_location: str | None = None,
          available_now: bool = True, external_methods: DataFrame | None = None):
    """Start the refresh stream; returns the StreamingQuery.

    ``available_now`` processes what is there and stops (a scheduled
    refresh); otherwise it keeps watching.
    """
    ckpt = checkpoint_location or scratch_path(spark, "reindex-stream")
    changes = (spark.readStream.format("text").option("wholetext", "true")
               .option("recursiveFileLookup", "true").load(root.rstrip("/"))
               .select(F.input_file_name().alias("file"))
               .where(F.col("file").endswith(".go") | F.col("file").endswith("go.mod")))

    def batch(df: DataFrame, epoch_id: int) -> None:
        if not df.isEmpty():
            refresh(df.sparkSession, root, catalog_root, external_methods)

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
