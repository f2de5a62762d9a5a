"""Queries of windows, decay and bit counting over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.rows import differences, local_maxima, with_row_numbers
from quern.session import shared_folder
from quern.sources.sinks import foreach_batch_stream
from quern.sources.tables import table
from quern.streaming.dgim import dgim_batch, dgim_stream, exact_ones
from quern.streaming.sources import parquet_stream
from quern.streaming.windows import decayed_counts, window_counts

SIZE, SLIDE, DECAY = "10 seconds", "1 second", 0.1
WINDOW, K, SHORT = 1000, 300, 20


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", "event_type")


def _bits(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("bit"))


def sliding_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(_events(spark, sf_dir), "ts", "event_type", SIZE, SLIDE)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(_events(spark, sf_dir), "ts", "event_type", "1 hour")


def decay_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decayed_counts(_events(spark, sf_dir), "ts", "event_type", SIZE, SLIDE, DECAY, by_age=False)


def decay_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decayed_counts(_events(spark, sf_dir), "ts", "event_type", SIZE, SLIDE, DECAY, by_age=True)


def _drained(result: DataFrame, mode: str, last_only: bool) -> DataFrame:
    """Run a stream over all that is there and read back what it wrote: of complete mode the last batch, otherwise all
    batches. State, progress and results lie in the shared checkpoint folder."""
    spark, place = result.sparkSession, shared_folder(result.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{place}/out" if last_only else f"{place}/out/b={number}"
        )

    foreach_batch_stream(result, write, f"{place}/state", mode).awaitTermination()
    return spark.read.parquet(f"{place}/out")


def stream_window_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling counts of the stream of events in complete mode, after its last micro-batch."""
    events = parquet_stream(spark, sf_dir, "events.parquet").select("ts", "event_type")
    return _drained(window_counts(events, "ts", "event_type", "1 hour"), "complete", True).drop("_batch")


def stream_window_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sorted by the window's start and the event within the stream, with each row's place in the last batch."""
    events = parquet_stream(spark, sf_dir, "events.parquet").select("ts", "event_type")
    rows = window_counts(events, "ts", "event_type", "1 hour").orderBy("start", "event").select("event", "n", "start")

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
        placed.write.mode("overwrite").parquet(f"{place}/out")

    place = shared_folder(spark)
    foreach_batch_stream(rows, write, f"{place}/state", "complete").awaitTermination()
    return spark.read.parquet(f"{place}/out")


def stream_window_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling counts in append mode: each window once, when the watermark of an hour has passed its end."""
    events = parquet_stream(spark, sf_dir, "events.parquet").select("ts", "event_type")
    return _drained(window_counts(events, "ts", "event_type", "1 hour", watermark="1 hour"), "append", False).drop("_batch", "b")


def hourly_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more events than both the hour before and after, with the difference to the next."""
    hours = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return local_maxima(differences(hours, "hour", "n"), "hour", "n")


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered from 0 in the order of time and id, without one task for all."""
    return with_row_numbers(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id").select("event_id", "idx")


def repeated_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group key once more among the aggregates: both columns are one, so the name stays clear."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.col("event_type"))
    return rows.select("event_type", "total")


def dgim_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dgim_batch(_bits(table(spark, sf_dir, "events")), "user_id", "event_id", "bit", WINDOW, K, "canonical")


def dgim_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dgim_batch(_bits(table(spark, sf_dir, "events")), "user_id", "event_id", "bit", WINDOW, K, "compat")


def dgim_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the last row that the stream wrote."""
    bits = _bits(parquet_stream(spark, sf_dir, "events.parquet"))
    rows = _drained(dgim_stream(bits, "user_id", "event_id", "bit", WINDOW, K), "update", False)
    last = rows.groupBy("key").agg(F.max_by(F.struct("t_start", "t_end", "estimate", "ones"), "_batch").alias("r"))
    return last.select("key", "r.*")


def dgim_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user whether the estimate is off by at most half of the ones in the window."""
    bits = _bits(table(spark, sf_dir, "events"))
    exact = exact_ones(bits, "user_id", "event_id", "bit", SHORT)
    rows = dgim_batch(bits, "user_id", "event_id", "bit", SHORT, SHORT).join(exact, "key")
    return rows.select("key", "n_bits", "ones", (2 * F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact")).alias("within"))


def bit_window_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_ones(_bits(table(spark, sf_dir, "events")), "user_id", "event_id", "bit", K)


QUERIES = {
    f.__name__: f
    for f in (
        sliding_window_counts, tumbling_counts, decay_per_event, decay_by_age, stream_window_final, stream_window_sorted,
        stream_window_watermark, hourly_peaks, event_numbers, repeated_group_key, dgim_canonical, dgim_compat, dgim_streamed, dgim_error, bit_window_exact,
    )
}

_WINDOWS = """
    with e as (select ts, event_type as event from events where ts is not null and event_type is not null),
    w as (select time_bucket(interval '1 second', ts) - to_seconds(o) as start, ts, event from e, range(0, 10) r(o)),
    x as (select start, start + interval '10 seconds' as "end", event, ts from w)"""
_TUMBLING = """
    select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as "end",
           event_type as event, count(*) as n from events where ts is not null and event_type is not null group by all"""

_BITS = """
    with b as (select user_id as key, event_id, (event_type = 'error')::int as bit from events
               where user_id is not null and event_id is not null and event_type is not null),
    u as (select key, count(*) as n_bits, sum(bit)::bigint as ones, min(event_id) as t_start, max(event_id) as t_end from b group by key)"""
#: The oldest of the buckets of n ones that are all in the window holds 2^(floor(log2(n + 1)) - 1), of which half is counted.
_ESTIMATE = "(case when ones > 0 then ones - (2 ** (floor(log2(ones + 1)) - 1))::bigint // 2 else 0 end)::bigint"

ORACLE = {
    "stream_window_sorted": f"""
        select event, n, start, row_number() over (order by start, event) as place from ({_TUMBLING})""",
    "stream_window_watermark": f"""
        select * from ({_TUMBLING}) where "end" <= (select max(ts) from events where event_type is not null) - interval '1 hour'""",
    "hourly_peaks": """
        with h as (select date_trunc('hour', ts) as hour, count(*) as n from events where ts is not null group by 1),
        d as (select *, lag(n) over w as before, lead(n) over w as after from h window w as (order by hour))
        select hour, n, after - n as diff from d where before < n and n > after""",
    "event_numbers": "select event_id, row_number() over (order by ts nulls first, event_id nulls first) - 1 as idx from events",
    "repeated_group_key": "select event_type, round(sum(value), 2) as total from events group by 1",
    # Users have fewer bits than the window in the test tables: nothing leaves it and nothing is halved.
    "dgim_canonical": f"{_BITS} select key, n_bits, ones, {_ESTIMATE} as estimate from u",
    "dgim_compat": f"{_BITS} select key, n_bits, ones, ones as estimate from u",
    "dgim_streamed": f"{_BITS} select key::varchar as key, t_start, t_end, {_ESTIMATE} as estimate, ones from u",
    "dgim_error": f"{_BITS} select key, n_bits, ones, true as within from u",
    "sliding_window_counts": f"{_WINDOWS} select start, \"end\", event, count(*) as n from x group by all",
    "tumbling_counts": _TUMBLING,
    "stream_window_final": _TUMBLING,
    "decay_per_event": f"{_WINDOWS} select start, \"end\", event, round(count(*) * 1.9::double, 4) as weight from x group by all",
    "decay_by_age": f"""{_WINDOWS}
        select start, "end", event, round(sum(pow(0.9::double, date_diff('microsecond', ts, "end") / 1e6::double)), 4) as weight
        from x group by all""",
    "bit_window_exact": f"""
        with b as (select user_id as key, (event_type = 'error')::int as bit,
                          row_number() over (partition by user_id order by event_id desc) as n
                   from events where user_id is not null and event_id is not null and event_type is not null)
        select key, sum(bit)::bigint as exact from b where n <= {K} group by key""",
}
