"""CSV ingest for job tables and sensor-run directories.

* delimiter: ``;`` when the first line holds more ``;`` than ``,`` (S1)
* names: stripped, spaces to ``_``, ``datetime`` renamed ``time_stamp`` (S2)
* times: the four job time columns, and any column whose name ends in
  ``timestamp`` or equals ``time_stamp`` (any case), parsed with ``try_cast`` so
  unparsable text becomes NULL (S3)
* directories: files are grouped by header text and each group is read once;
  groups are unioned **by name** (S4). A plain ``spark.read.csv(dir)`` would align
  differing headers by position.
* run groups (``valve1``...) come from the file path (S6).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.sources.tables import nan_to_null

# The job-table time columns parsed as datetimes.
JOB_TIME_COLUMNS = ["Scheduled_Start", "Scheduled_End", "Actual_Start", "Actual_End"]
# Named sensor-run groups, and the words that select the whole tree.
RUN_GROUPS = ["valve1", "valve2", "anomaly-free", "other"]
WHOLE_TREE_WORDS = ("skab", "all", "")


def sniff_delimiter(first_line: str) -> str:
    return ";" if first_line.count(";") > first_line.count(",") else ","


def clean_names(cols: list[str]) -> list[str]:
    out = [c.strip().replace(" ", "_") for c in cols]
    out = ["time_stamp" if c == "datetime" else c for c in out]
    dup = {c for c in out if out.count(c) > 1}
    if dup:
        raise ValueError(f"duplicate column names after cleaning: {sorted(dup)}")
    return out


def _is_time_name(c: str) -> bool:
    low = c.lower()
    return low.endswith("timestamp") or low == "time_stamp"


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of every ``*.csv`` file at or below ``path``: (file, line). The text of
    each file's first split is read for it."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
                     F.col("_metadata.file_block_start").alias("blk"),
                     F.monotonically_increasing_id().alias("pos")))
    # The split starting at byte 0 of a file is read by one task in file order,
    # so its smallest position is the header line.
    return (lines.where(F.col("blk") == 0).groupBy("file")
            .agg(F.min_by("line", "pos").alias("line")))


def read_csv(spark: SparkSession, path: str, header_line: str | None = None,
             infer_schema: bool = True, schema=None) -> DataFrame:
    """Read one CSV file or a set of files sharing one header."""
    if header_line is None:
        row = spark.read.text(path).first()
        header_line = row[0] if row else ""
    header_line = header_line.lstrip("﻿")
    sep = sniff_delimiter(header_line)
    raw_cols = [c.strip() for c in header_line.rstrip("\r\n").split(sep)]
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", infer_schema).csv(path)
    df = df.toDF(*clean_names(df.columns))
    job_cols = set(clean_names([c for c in JOB_TIME_COLUMNS if c in raw_cols])) if sep == "," else set()
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if (f.name in job_cols or _is_time_name(f.name)) and f.dataType.simpleString() != "timestamp_ntz":
            c = (c.cast("string")).try_cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return nan_to_null(df.select(*cols))


def read_csv_dir(spark: SparkSession, path: str, infer_schema: bool = True,
                 with_group: bool = True) -> DataFrame:
    """All ``*.csv`` at any depth below ``path`` (or that one file); differing headers are
    unioned by name (S4, S6).

    The header table has one row per file (the driver lists the files anyway); each
    distinct header is read as one Spark scan over its files.
    """
    heads = _headers(spark, path).collect()
    by_header: dict[str, list[str]] = {}
    for r in heads:
        by_header.setdefault(r["line"], []).append(r["file"])
    parts = []
    for line, files in sorted(by_header.items(), key=lambda kv: sorted(kv[1])[0]):
        df = read_csv(spark, sorted(files), header_line=line, infer_schema=infer_schema)
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
        parts.append(df)
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if with_group:
        groups = "|".join(re.escape(g) for g in RUN_GROUPS)
        out = out.withColumn("group", F.regexp_extract("source_file", f"/({groups})/", 1))
    return out


def read_run_group(spark: SparkSession, root: str, group: str) -> DataFrame:
    """Named group resolution (S6): a whole-tree word → every group, else one sub-directory."""
    df = read_csv_dir(spark, root)
    if group.lower() in WHOLE_TREE_WORDS:
        return df
    if group not in RUN_GROUPS:
        raise ValueError(f"unknown run group {group!r}; expected one of {RUN_GROUPS}")
    return df.where(F.col("group") == group)
