"""Versioned tables with a commit log.

A table is a folder. Every try to write goes to a data folder of its own, so a
crashed one is in nobody's way. A version exists once its manifest,
``_log/<number>.json``, has been created; it is created whole, and never over
another one, so of two writers of a version one wins and the other begins anew on
top of it. A manifest names the data folder of each bucket, and the last batch of
each stream that is in the table, by which a repeated batch is told.

Rows are dealt to buckets by a hash of the key. A merge reads and writes the
buckets that its batch touches; the files of all others stay as they are.

Creating without replacing is a hard link on local folders, and elsewhere a rename,
which must refuse an existing target, as HDFS does.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.schemas import TABLES

#: Tries of a merge against other writers.
TRIES = 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and times of change (ms) of what is in a folder."""
    fs = _fs(spark, folder)
    return [(s.getPath().getName(), int(s.getModificationTime())) for s in fs.listStatus(_path(spark, folder))] if fs.exists(_path(spark, folder)) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in _names(spark, f"{folder}/_log") if n.endswith(".json"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """What a version is made of (the newest by default), or None."""
    if version is None:
        known = versions(spark, folder)
        if not known:
            return None
        version = known[-1]
    path = f"{folder}/_log/{version:020d}.json"
    with_lines = spark._jvm.java.util.Scanner(_fs(spark, path).open(_path(spark, path)), "UTF-8").useDelimiter("\\A")
    try:
        return json.loads(with_lines.next())
    finally:
        with_lines.close()


def _published(spark: SparkSession, folder: str, new: dict) -> bool:
    """Create the manifest, unless the version exists."""
    path, draft = f"{folder}/_log/{new['version']:020d}.json", f"{folder}/_log/.{uuid.uuid4().hex}"
    fs = _fs(spark, folder)
    out = fs.create(_path(spark, draft), False)
    out.write(bytearray(json.dumps(new), "utf-8"))
    out.close()
    if fs.getScheme() == "file":
        local = lambda p: urlparse(p).path if "://" in p or p.startswith("file:") else p
        try:
            os.link(local(draft), local(path))
        except FileExistsError:
            return False
        finally:
            fs.delete(_path(spark, draft), False)
        return True
    if fs.exists(_path(spark, path)) or not fs.rename(_path(spark, draft), _path(spark, path)):
        fs.delete(_path(spark, draft), False)
        return False
    return True


def _read(spark: SparkSession, folder: str, name: str, found: dict | None, buckets: list[int] | None = None) -> DataFrame:
    files = found["files"] if found else {}
    some = files if buckets is None else {str(b): files[str(b)] for b in buckets if str(b) in files}
    if not some:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{folder}/data/{data}/bucket={b}" for b, data in some.items()])


def read_version(spark: SparkSession, folder: str, name: str, version: int | None = None) -> tuple[DataFrame, int]:
    """A version of a table (the newest by default) and its number; an empty table
    and -1 where there is none. Later versions do not change it."""
    found = manifest(spark, folder, version)
    return _read(spark, folder, name, found), found["version"] if found else -1


def read_changed(spark: SparkSession, folder: str, name: str, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the buckets whose files are not the same in two versions, as they were
    in ``since`` (-1: before the first) and as they are in ``until`` (the newest by
    default); and the number of the latter."""
    old, new = manifest(spark, folder, since) if since >= 0 else None, manifest(spark, folder, until)
    before, after = (old or {"files": {}})["files"], (new or {"files": {}})["files"]
    changed = sorted(int(b) for b in {*before, *after} if before.get(b) != after.get(b))
    return _read(spark, folder, name, old, changed), _read(spark, folder, name, new, changed), new["version"] if new else -1


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def merge(
    batch: DataFrame,
    folder: str,
    name: str,
    apply: Callable[..., DataFrame],
    keys: list[str] | None = None,
    buckets: int = 1,
    stream: str | None = None,
    number: int | None = None,
    counter: str | None = None,
) -> int:
    """The version after ``apply(rows, batch)``, which gets the rows of the buckets
    that the batch touches, and returns them after the merge; a row's key must not
    change there. ``keys`` deal rows to buckets, as values in the batch and in the
    table; the number of buckets is fixed by the first version. A batch whose stream
    has that ``number`` or a later one in the table changes nothing. With ``counter``,
    an id column, ``apply`` gets the greatest value so far as well."""
    spark = batch.sparkSession
    keys, stream = keys or [], stream or ""
    batch = batch.persist()
    try:
        for _ in range(TRIES):
            old = manifest(spark, folder)
            if old and number is not None and old["streams"].get(stream, -1) >= number:
                return old["version"]
            n = old["buckets"] if old else (buckets if keys else 1)
            # At most one number for each bucket.
            touched = sorted(r[0] for r in batch.select(bucket_of(keys, n)).distinct().collect())
            last = (old or {}).get("last", 0)
            new = {"version": (old["version"] if old else -1) + 1, "table": name, "keys": keys, "buckets": n, "files": dict(old["files"] if old else {}), "streams": dict(old["streams"] if old else {}), "last": last}
            if number is not None:
                new["streams"][stream] = number
            if touched:
                rows = _read(spark, folder, name, old, touched)
                after = apply(rows, batch, last) if counter else apply(rows, batch)
                data = uuid.uuid4().hex
                typed = after.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]).withColumn("bucket", bucket_of(keys, n))
                # One file a bucket: keys are distinct, so buckets are even.
                (typed.repartition("bucket") if n > 1 else typed).write.partitionBy("bucket").parquet(f"{folder}/data/{data}")
                for b in touched:
                    new["files"].pop(str(b), None)
                written = {x.removeprefix("bucket=") for x, _ in _names(spark, f"{folder}/data/{data}") if x.startswith("bucket=")}
                if strange := written - {str(b) for b in touched}:
                    raise ValueError(f"the merge moved rows to buckets {sorted(strange)} that its batch does not touch")
                new["files"] |= dict.fromkeys(written, data)
                if counter and written:
                    new["last"] = max(last, spark.read.parquet(f"{folder}/data/{data}").agg(F.max(counter)).first()[0] or 0)
            while True:
                if _published(spark, folder, new):
                    return new["version"]
                # Another writer was first. Its version is taken as a base where it left these buckets alone.
                base = manifest(spark, folder)
                same = all(base["files"].get(str(b)) == (old["files"].get(str(b)) if old else None) for b in touched)
                if counter or not old or not same or (number is not None and base["streams"].get(stream, -1) >= number):
                    break
                own = {str(b): new["files"][str(b)] for b in touched if str(b) in new["files"]}
                rest = {b: f for b, f in base["files"].items() if int(b) not in touched}
                new |= {"version": base["version"] + 1, "files": rest | own, "streams": base["streams"] | ({stream: number} if number is not None else {})}
        raise RuntimeError(f"{folder}: other writers were first {TRIES} times")
    finally:
        batch.unpersist()


def expire(spark: SparkSession, folder: str, keep: int = 10, older_than_s: float = 86_400) -> int:
    """Delete the manifests of all but the newest ``keep`` versions, and the data
    folders that none of these names and that nobody has written to for
    ``older_than_s`` (tries that may still be going on are younger). Returns how many
    data folders went."""
    known = versions(spark, folder)
    fs = _fs(spark, folder)
    for version in known[:-keep]:
        fs.delete(_path(spark, f"{folder}/_log/{version:020d}.json"), False)
    named = {d for version in known[-keep:] for d in manifest(spark, folder, version)["files"].values()}
    old = [n for n, at in _names(spark, f"{folder}/data") if n not in named and at <= (time.time() - older_than_s) * 1000]
    for data in old:
        fs.delete(_path(spark, f"{folder}/data/{data}"), True)
    return len(old)
