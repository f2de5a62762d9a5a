"""Readers of the supported file formats, all with explicit schemas. Compressed files (gzip, bzip2) are read as they are;
``spread`` redistributes the rows after a file that can't be split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string, DESCRIPTION string"
NEWS = "tweet_id string, text string, url string"
RATINGS = "user bigint, item bigint, rating double, timestamp string"
EVENTS = "event_time timestamp, event string"


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def read_csv_header(spark: SparkSession, path: str, *columns: str, partitions: int | None = None) -> DataFrame:
    """CSV with a header, every value as text; the named columns, or all. A column that the file lacks raises."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spread(df.select(*columns) if columns else df, partitions)


def read_conditions(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``(patient, code bigint, description)``; a code that is no number is null."""
    df = read_csv_header(spark, path, "PATIENT", "CODE", "DESCRIPTION", partitions=partitions)
    return df.select(F.col("PATIENT").alias("patient"), F.col("CODE").try_cast("bigint").alias("code"), F.col("DESCRIPTION").alias("description"))


def read_json_lines(spark: SparkSession, path: str, schema: str = NEWS, partitions: int | None = None) -> DataFrame:
    """JSON lines; a line that is no JSON gives a row of nulls."""
    return spread(spark.read.schema(schema).json(path), partitions)


def read_multi_header_csv(
    spark: SparkSession, path: str, header_rows: int = 3, skip_rows: int = 0, names: list[str] | None = None
) -> DataFrame:
    """CSV whose first ``header_rows`` lines name the columns together, joined by ``_``; further ``skip_rows`` lines
    follow. The leading lines are recognised by all their fields, so the file may be split."""
    raw = spark.read.option("header", False).csv(path)
    head = raw.take(header_rows + skip_rows)
    joined = names or ["_".join(str(r[i]) for r in head[:header_rows] if r[i]) or raw.columns[i] for i in range(len(raw.columns))]
    row = F.struct(*[F.col(c) for c in raw.columns])
    for r in head:
        line = F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(raw.columns, r, strict=True)])
        raw = raw.where(~row.eqNullSafe(line))
    return raw.toDF(*_unique(joined))


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def numeric_array(df: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """``(id, vector array<double>)`` of the columns, all others by default; what is no number is null."""
    chosen = columns or tuple(c for c in df.columns if c != row_id)
    return df.select(F.col(f"`{row_id}`").alias("id"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in chosen]).alias("vector"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``user, item, rating, timestamp`` without a header; the timestamp is dropped."""
    return spark.read.schema(RATINGS).option("sep", "\t").csv(path).drop("timestamp")


def _edges(lines: DataFrame, sep: str, comment: str | None, *more: Column) -> DataFrame:
    kept = lines.where(F.trim("value") != "")
    kept = kept.where(~F.contains("value", F.lit(comment))) if comment else kept
    parts = F.split(F.trim("value"), sep)
    ends = [F.get(parts, F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(("src", "dst"))]
    return kept.select(*more, *ends)


def read_edges(spark: SparkSession, path: str, sep: str = r"[,\s]+", comment: str | None = "#") -> DataFrame:
    """``(src, dst)`` of an edge list in text lines, separated by blanks, tabs or commas; empty lines and lines that
    contain ``comment`` are skipped, ends that are no numbers are null."""
    return _edges(spark.read.text(path), sep, comment)


def read_edge_folder(spark: SparkSession, folder: str, suffix: str = ".edges") -> DataFrame:
    """``(graph, src, dst)`` of all files of a folder with the suffix; the graph is the file's name without it."""
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), f"{suffix.replace('.', '[.]')}$", "")
    return _edges(lines, r"[,\s]+", None, name.alias("graph"))


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """``(id, similar)`` of the JSON lines that :func:`quern.sources.sinks.write_suggestions` writes."""
    return spark.read.schema("id string, similar array<string>").json(path)


def read_suggestion_object(spark: SparkSession, path: str) -> DataFrame:
    """The same of one JSON object that maps ids to lists of ids."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string, array<string>>")
    return whole.select(F.explode(pairs).alias("id", "similar"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` lines of text files, compressed or not."""
    return spark.read.text(path)
