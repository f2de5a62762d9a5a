"""Sinks: fixed-width reports, parquet, JSON lines, streaming outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _cell(c: Column, width: int) -> Column:
    """Left-aligned to at least ``width``; a longer value is not cut."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def fixed_width_lines(df: DataFrame, widths: dict[str, int], order: list[Column] | None = None, header: bool = True) -> DataFrame:
    """``(line_no, line)``: the columns of ``widths`` side by side, the header as line 0, rows in ``order``.

    Line numbers come from one ordered window: use it on reports, which are bounded, and not on whole tables.
    """
    from pyspark.sql import Window

    cells = F.concat(*[_cell(F.col(c), w) for c, w in widths.items()])
    at = F.row_number().over(Window.orderBy(*(order or list(widths))))
    lines = df.select(at.cast("bigint").alias("line_no"), F.rtrim(cells).alias("line"))
    if not header:
        return lines
    title = "".join(c.ljust(w) for c, w in widths.items()).rstrip()
    return lines.unionByName(df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit(title).alias("line")))


def write_text_report(lines: DataFrame, path: str) -> None:
    """One text file of the lines in order."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_suggestions(pairs: DataFrame, path: str, a: str = "id_a", b: str = "id_b") -> None:
    """JSON lines ``{"id": ..., "similar": [...]}``: each id with its partners in ascending order."""
    both = pairs.select(F.col(a).alias("id"), F.col(b).alias("other")).unionByName(
        pairs.select(F.col(b).alias("id"), F.col(a).alias("other"))
    )
    both.groupBy("id").agg(F.sort_array(F.collect_set("other")).alias("similar")).write.mode("overwrite").json(path)


def console_stream(df: DataFrame, mode: str = "complete", **options: str) -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("console").options(**options).start()


def memory_stream(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """All that is available goes into the in-memory table ``name``; for tests and small results."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def foreach_batch_stream(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
