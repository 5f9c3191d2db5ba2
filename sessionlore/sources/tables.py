"""Parquet tables with fixed schemas, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlore.schemas import TABLES
from sessionlore.sources.packets import contents, listed, write_files
from sessionlore.sources.versions import _fs, _path, read_version

#: Spark's own name of a folder for what is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: What Spark escapes in names of folders; the sign of escapes comes first.
ESCAPED = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    """Write a table's own columns, in order and with its types."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]).write.mode(mode).parquet(f"{folder}/{name}")


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    write_table(df, folder, name, mode="append")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table of the catalogue whose rows are dealt to buckets by ``key`` and sorted in
    them: tables that have as many buckets join by it without a shuffle."""
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    (dealt.option("path", path) if path else dealt).saveAsTable(table)


def latest_snapshot(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, int]:
    """The newest version of a table that :mod:`sessionlore.sources.versions` keeps,
    or an empty table and -1."""
    return read_version(spark, folder, name)


def write_markdown(documents: DataFrame, folder: str, as_text: bool = False) -> None:
    """(session_id, kind, markdown) as one table, or as text files in a folder
    for each kind and session."""
    if not as_text:
        documents.select("session_id", "kind", "markdown").write.parquet(folder)
        return
    if _fs(documents.sparkSession, folder).exists(_path(documents.sparkSession, folder)):
        raise FileExistsError(folder)
    number = F.row_number().over(Window.partitionBy("kind", "session_id").orderBy("markdown")) - 1

    def part(c: str) -> Column:
        value = F.nullif(F.col(c).cast("string"), F.lit(""))
        for x in ESCAPED:
            value = F.replace(value, F.lit(x), F.lit(f"%{ord(x):02X}"))
        return F.concat(F.lit(f"{c}="), F.coalesce(value, F.lit(NO_VALUE)))

    path = F.concat_ws("/", part("kind"), part("session_id"), F.concat(F.lit("part-"), F.lpad(number.cast("string"), 5, "0"), F.lit(".txt")))
    # Each text ends with one line end.
    content = F.concat(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\n\z", ""), F.lit("\n")).cast("binary")
    write_files(documents.select(path.alias("path"), content.alias("content")), folder)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, kind, markdown) of the text files of :func:`write_markdown`. Folders are
    listed by tasks: the driver sees neither files nor partitions."""
    rows, tasks = spark.createDataFrame([("",)], "path string"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(2):
        rows = listed(rows, folder).where("not is_file").repartition(tasks, "path")
    files = contents(listed(rows, folder).where("is_file"), folder)
    part = lambda c: F.url_decode(F.replace(F.nullif(F.regexp_extract("path", f"(?:^|/){c}=([^/]*)/", 1), F.lit(NO_VALUE)), F.lit("+"), F.lit("%2B")))
    return files.select(part("session_id").cast("long").alias("session_id"), part("kind").alias("kind"), F.decode("content", "UTF-8").alias("markdown"))
