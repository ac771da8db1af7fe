"""Versioned branches of a table, kept as Parquet folders.

Layout: `root/branch=<name>/version=<n>/commit=<m>/`. Commit 0 makes the version, appends
are further commits of it. A commit counts once Spark's committer has left `_SUCCESS` in it, so
neither a failed nor a running write is read, and a change never overwrites what it reads.

A branch may be laid out by key bucket (`bucket_by`): a commit then holds one folder per bucket, and
`version=<n>/layout` lists, by bucket, the folders of earlier versions that the version goes on
using. An update or delete whose key holds the bucket columns reads and writes the buckets of its changes only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylag.sources.files import export, with_logged_at
from skylag.sources.scratch import materialize

MODES = ("snapshot", "append", "update", "delete")
BUCKET = "_bucket"
#: One row for the branch (bucket -1: its columns, number of buckets and schema), and one for each folder of an earlier version.
_LAYOUT = "bucket int, path string, by array<string>, buckets int, schema string"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in fs.globStatus(path) or []]


class Commit(NamedTuple):
    version: int
    number: int
    path: str


def _numbered(path: str) -> Commit:
    version, number = re.search(r"/version=(\d+)/commit=(\d+)", path).groups()
    return Commit(int(version), int(number), path.removesuffix("/_SUCCESS"))


def commits(spark: SparkSession, root: str, branch: str = "master") -> list[Commit]:
    """Finished commits of a branch, oldest first."""
    found = sorted(map(_numbered, _glob(spark, f"{root}/branch={branch}/version=*/commit=*/_SUCCESS")))
    made = {c.version for c in found if c.number == 0}
    return [c for c in found if c.version in made]


def _latest(spark: SparkSession, root: str, branch: str) -> list[Commit]:
    found = commits(spark, root, branch)
    return [c for c in found if c.version == found[-1].version]


def _next_path(spark: SparkSession, root: str, branch: str, append_to: int | None = None) -> str:
    # Unfinished versions and commits keep their number too, so leftovers are never written into.
    base = f"{root}/branch={branch}"
    if append_to is None:
        started = _glob(spark, f"{base}/version=*")
        return f"{base}/version={1 + max((int(p.split('/version=')[1]) for p in started), default=0)}/commit=0"
    started = _glob(spark, f"{base}/version={append_to}/commit=*")
    return f"{base}/version={append_to}/commit={1 + max(int(p.split('/commit=')[1]) for p in started)}"


def list_branches(spark: SparkSession, root: str) -> list[str]:
    """Names of the branches that have a finished version; no data file is opened."""
    done = _glob(spark, f"{root}/branch=*/version=*/commit=0/_SUCCESS")
    return sorted({p.split("/branch=")[1].split("/")[0] for p in done})


def branch_paths(spark: SparkSession, root: str, branch: str = "master") -> list[str]:
    """Folders of the latest version's finished commits; those of its buckets where it is laid out by bucket."""
    found = _latest(spark, root, branch) if commits(spark, root, branch) else []
    if not found:
        raise FileNotFoundError(f"no data in branch {branch!r} of {root}")
    layout = _layout(spark, root, branch, found[-1].version)
    return [c.path for c in found] if layout is None else sorted(p for paths in layout.leaves(spark, found).values() for p in paths)


class Layout(NamedTuple):
    """Buckets of one version: columns, number, schema, and folders of earlier versions by bucket."""

    by: list[str]
    buckets: int
    schema: StructType
    earlier: dict[int, list[str]]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def leaves(self, spark: SparkSession, version: list[Commit]) -> dict[int, list[str]]:
        """Folders by bucket, with those of the version's own commits."""
        out = {b: list(paths) for b, paths in self.earlier.items()}
        for commit in version:
            for path in _glob(spark, f"{commit.path}/{BUCKET}=*"):
                out.setdefault(int(path.rsplit("=", 1)[1]), []).append(path)
        return out


def _layout(spark: SparkSession, root: str, branch: str, version: int) -> Layout | None:
    path = f"{root}/branch={branch}/version={version}/layout"
    if not _glob(spark, f"{path}/_SUCCESS"):
        return None
    rows = spark.read.schema(_LAYOUT).json(path).collect()  # one per folder
    head = next(r for r in rows if r["bucket"] == -1)
    earlier: dict[int, list[str]] = {}
    for r in rows:
        if r["bucket"] >= 0:
            earlier.setdefault(r["bucket"], []).append(r["path"])
    return Layout(list(head["by"]), head["buckets"], StructType.fromJson(json.loads(head["schema"])), earlier)


def _store_layout(spark: SparkSession, version_path: str, layout: Layout) -> None:
    rows = [(-1, None, layout.by, layout.buckets, layout.schema.json())]
    rows += [(b, p, None, None, None) for b, paths in layout.earlier.items() for p in paths]
    spark.createDataFrame(rows, _LAYOUT).coalesce(1).write.json(f"{version_path}/layout")


def _read(spark: SparkSession, layout: Layout, leaves: dict[int, list[str]], only: set[int] | None = None) -> DataFrame:
    paths = [p for b, found in leaves.items() if only is None or b in only for p in found]
    return spark.read.schema(layout.schema).parquet(*paths) if paths else spark.createDataFrame([], layout.schema)


def read_branch(
    spark: SparkSession, root: str, branch: str = "master", limit: int | None = None
) -> DataFrame:
    paths = branch_paths(spark, root, branch)
    found = _latest(spark, root, branch)
    layout = _layout(spark, root, branch, found[-1].version)
    df = spark.read.parquet(*paths) if layout is None else _read(spark, layout, layout.leaves(spark, found))
    return df if limit is None else df.limit(limit)


def read_commit(spark: SparkSession, root: str, branch: str, commit: Commit) -> DataFrame:
    """The rows of a commit: the appended ones, or the whole table where the commit makes a version."""
    layout = _layout(spark, root, branch, commit.version)
    if layout is None:
        return spark.read.parquet(commit.path)
    if commit.number:
        layout = layout._replace(earlier={})
    return _read(spark, layout, layout.leaves(spark, [commit]))


def _claim(spark: SparkSession, root: str, branch: str, append_to: int | None = None) -> str:
    """A folder for one commit that no other writer can have: its claim is a file that only one can create."""
    path = _next_path(spark, root, branch, append_to)
    version_path, number = path.rsplit("/commit=", 1)
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{version_path}/claims/{number}")
    try:
        claim.getFileSystem(spark._jsc.hadoopConfiguration()).create(claim, False).close()
    except Exception as taken:
        if "AlreadyExists" not in str(taken):
            raise
        raise RuntimeError(f"another writer is at {path}") from None
    return path


def _put(df: DataFrame, path: str, layout: Layout | None, finished: bool = True) -> None:
    """Write a commit; unless it is `finished`, it lacks the mark by which readers know it."""
    if layout is not None:
        # Rebalanced by bucket: a bucket with a third of all rows is written by several tasks, small ones share one.
        df = df.withColumn(BUCKET, layout.bucket()).hint("rebalance", BUCKET)
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(finished).lower())
    (writer if layout is None else writer.partitionBy(BUCKET)).parquet(path)


def _finish(spark: SparkSession, path: str) -> None:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, False).close()


def write(
    df: DataFrame,
    root: str,
    branch: str = "master",
    mode: str = "snapshot",
    key: str | Sequence[str] | None = None,
    bucket_by: str | Sequence[str] | None = None,
    buckets: int = 64,
) -> str:
    """Write `df` into a branch and return the folder it lies in.

    snapshot: a new version holding only `df`; append: one more commit of the latest
    version; update: rows of `df` replace those with the same key and new keys are
    added, so a key may occur once in `df`; delete: rows whose key occurs in `df` go away.
    A commit that another writer finishes meanwhile makes update and delete fail
    rather than drop it; of two writers that reach for the same folder the second one fails.

    A snapshot (or the first append) with `bucket_by` lays the branch out by bucket of these columns; further writes keep the layout. An
    update or delete whose key holds them touches the buckets of `df` only, any other one all buckets.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    spark = df.sparkSession
    seen = commits(spark, root, branch)
    layout = _layout(spark, root, branch, seen[-1].version) if seen else None
    if mode == "append" and seen:
        path = _claim(spark, root, branch, append_to=seen[-1].version)
        if layout is not None:
            given = {c.lower() for c in df.columns}
            df = df.select(*[F.col(f.name).cast(f.dataType) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in layout.schema])
        _put(df, path, layout)
        return path
    earlier: dict[int, list[str]] = {}
    if mode in ("update", "delete"):
        if not key:
            raise ValueError(f"mode {mode!r} needs a key")
        keys = [key] if isinstance(key, str) else list(key)
        if not seen:
            raise FileNotFoundError(f"no data in branch {branch!r} of {root}")
        # Read twice, and their size decides between broadcast and shuffle.
        df = materialize(df, "changes")
        if mode == "update" and not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"a key {keys} occurs more than once among the changes")
        if layout is None:
            current = read_branch(spark, root, branch)
        else:
            leaves = layout.leaves(spark, _latest(spark, root, branch))
            touched = set(leaves) | set(range(layout.buckets))
            if {c.lower() for c in layout.by} <= {k.lower() for k in keys}:
                touched = {r[0] for r in df.select(layout.bucket()).distinct().collect()}  # at most one row per bucket
            earlier = {b: paths for b, paths in leaves.items() if b not in touched}
            current = _read(spark, layout, leaves, touched)
        kept = current.join(df.select(*keys), keys, "left_anti").select(*current.columns)
        df = kept.unionByName(df, allowMissingColumns=True) if mode == "update" else kept
    elif bucket_by is not None:
        by = [bucket_by] if isinstance(bucket_by, str) else list(bucket_by)
        layout = Layout(by, buckets, df.schema, {})
    elif mode == "snapshot" and layout is not None and not {c.lower() for c in layout.by} <= {c.lower() for c in df.columns}:
        layout = None
    path = _claim(spark, root, branch)
    if layout is not None:
        _store_layout(spark, path.rsplit("/", 1)[0], layout._replace(earlier=earlier, schema=df.schema))
    if mode not in ("update", "delete"):
        _put(df, path, layout)
        return path
    _put(df, path, layout, finished=False)
    if commits(spark, root, branch) != seen:
        raise RuntimeError(f"branch {branch!r} changed while it was rewritten")
    _finish(spark, path)
    return path


def append_many(frames: Sequence[DataFrame], root: str, branch: str = "master") -> str:
    """Several frames into one branch with one write; missing columns become NULL."""
    if not frames:
        raise ValueError("no frames to write")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return write(union, root, branch, "append")


def log_predictions(df: DataFrame, root: str | None, branch: str = "master") -> str | None:
    """Append scored rows with their `logged_at` time; without a target nothing happens."""
    return None if root is None else write(with_logged_at(df), root, branch, "append")


def export_branch(
    spark: SparkSession, root: str, path: str, branch: str = "master", fmt: str = "parquet"
) -> str:
    return export(read_branch(spark, root, branch), path, fmt)


def push_metrics(metrics: DataFrame, root: str, branch: str = "master") -> str:
    """Append a long metric table (see `operators.metrics.long_metrics`)."""
    return write(metrics.withColumn("recorded_at", F.current_timestamp()), root, branch, "append")
