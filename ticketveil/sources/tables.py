"""Sources and sinks on Spark's readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import HISTORY_COLUMNS


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt over so many tasks, for a small table in few row groups that long text expressions follow; off
    by default, as the text then moves through a shuffle. Large tables are split when they are read."""
    return df.repartition(partitions) if partitions else df


#: Rows of a task of ``spread_rows``: some ten megabytes of text, if a row becomes a ticket or a report.
ROWS_PER_TASK = 20_000


def spread_rows(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt evenly over as many tasks as its number of rows asks for, for short rows that become long texts. Such
    a table is small on disk and one row group holds a million of its rows, so a reader gives them to one task; the
    short rows are what moves. The rows are counted first, which reads no more than the file footers of a Parquet table."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def read_documents(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, text, ...)``. For ``text`` each file is one document, named by its path; ``csv``
    and ``json`` hold both columns and those of ``keep`` (each a name, or a name and a type), read without inference,
    as strings unless a type is given. The columns of a csv file are told by its header, in any order."""
    if format == "text":
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("doc_id"), F.col("value").alias("text")
        )
    if format in ("csv", "json"):
        wanted = {id: "string", text: "string"} | {c.split()[0]: " ".join(c.split()[1:]) or "string" for c in keep}
        if format == "csv":
            read = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
            df = read.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in wanted.items()))
        else:
            df = spark.read.schema(", ".join(f"`{c}` {kind}" for c, kind in wanted.items())).json(path)
    else:
        df = spark.read.format(format).load(path)
    if id != "doc_id":
        df = df.withColumnRenamed(id, "doc_id")
    return df if text == "text" else df.withColumnRenamed(text, "text")


def write_redacted(redacted: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Redacted text and counts as one partitioned data set; stats become columns."""
    flat = redacted.select(*[c for c in redacted.columns if c != "stats"], "stats.*")
    flat.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _replace_run(rows: DataFrame, path: str, run: str, format: str, **options) -> None:
    """Write the partition of a run, in place of what it has."""
    if not re.fullmatch(r"[\w.-]+", run, re.ASCII):
        raise ValueError("a run is named by letters, digits, dots, dashes and underscores")
    if rows.isEmpty():  # no row would leave the partition as it is
        rows.write.mode("overwrite").options(**options).format(format).save(f"{path}/run={run}")
        return
    writer = rows.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run")
    writer.options(partitionOverwriteMode="dynamic", **options).format(format).save(path)


def keep_groups(groups: DataFrame, path: str, run: str) -> None:
    """Keep the groups (``audit_groups``, ``redaction_groups``) of a run, so that totals need not read earlier rows again.
    A run that is repeated takes the place of its groups."""
    _replace_run(groups, path, run, "parquet")


def kept_groups(spark: SparkSession, path: str) -> DataFrame:
    """The groups of all runs, with the columns that ``keep_groups`` was given: a group has a row for each run."""
    return spark.read.option("basePath", path).parquet(path).drop("run")


def append_history(history: DataFrame, path: str, run: str) -> None:
    """Add the history rows of a run. A run that is repeated, by a retry or after a failure, takes the place of its rows.

    Each run is a partition of the table; the header line goes into every part file."""
    _replace_run(history.select(*HISTORY_COLUMNS), path, run, "csv", header=True)


def read_history(spark: SparkSession, path: str, timestamp: str = "timestamp", run: bool = False) -> DataFrame:
    """The rows that ``append_history`` wrote; empty texts stay empty. ``timestamp`` is the type of that column; with
    ``run`` there is one more that names the run."""
    whole = ("pass", "fail", "na", "answered", "applicable")
    kinds = {"timestamp": timestamp} | {c: "int" for c in whole}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in (*HISTORY_COLUMNS, "run"))
    rows = spark.read.schema(schema).options(header=True, nullValue="\x00", emptyValue="").csv(path)
    return rows if run else rows.drop("run")


def write_bundle(bundle: DataFrame, path: str) -> None:
    """``(path, content)`` rows of a result bundle."""
    bundle.write.mode("overwrite").parquet(path)


def write_ordered(blocks: DataFrame, path: str, *order: str, content: str = "content") -> None:
    """Text blocks in order: part files are in order, and so are the blocks within each.

    A block ends with a line feed, which the writer adds back."""
    block = F.regexp_replace(content, r"\n\z", "")
    blocks.orderBy(*order).select(block.alias(content)).write.mode("overwrite").text(path)
