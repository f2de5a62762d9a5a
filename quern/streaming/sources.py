"""Streaming sources and line producers."""

from __future__ import annotations

import gzip
import random
import socket
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Stream of ``value`` lines from a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def csv_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1, header: bool = False) -> DataFrame:
    """Stream of the CSV files of a folder, a few files at a time; compressed files are read as they are."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("header", header).csv(path)


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of ``folder/name``, a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def rate_bits(spark: SparkSession, rows_per_second: int = 100, seed: int = 1) -> DataFrame:
    """Endless ``(ts, bit)`` of pseudo-random bits, a function of the counter and the seed."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.col("value").alias("ts"), F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(2)).cast("int").alias("bit"))


def parse_bits(lines: DataFrame) -> DataFrame:
    """``stamp,bit`` lines as ``(ts bigint, bit int)``; what can't be read is null."""
    parts = F.split("value", ",")
    return lines.select(F.get(parts, F.lit(0)).try_cast("bigint").alias("ts"), F.get(parts, F.lit(1)).try_cast("int").alias("bit"))


def parse_events(lines: DataFrame) -> DataFrame:
    """``time,event`` lines as ``(event_time timestamp, event string)``; an unreadable time is null."""
    parts = F.split("value", ",")
    when: Column = F.get(parts, F.lit(0)).try_cast("timestamp")
    return lines.select(when.alias("event_time"), F.get(parts, F.lit(1)).alias("event"))


def random_bit_lines(seed: int | None = None) -> Iterator[str]:
    """``1,b``, ``2,b``, ... with random bits b."""
    bits, n = random.Random(seed), 0
    while True:
        n += 1
        yield f"{n},{bits.getrandbits(1)}"


def gzip_csv_lines(path: str) -> Iterator[str]:
    """Lines of a compressed CSV file without its header."""
    with gzip.open(path, "rt") as f:
        next(f, None)
        for line in f:
            yield line.rstrip("\n")


def serve_lines(lines: Iterable[str], host: str, port: int, seconds: float = 300, pause: float = 0.005, ready=None) -> int:
    """Serve lines to the first client for at most ``seconds``, ``pause`` apart; returns how many were sent. ``ready`` is
    called with the port once the server listens (port 0 picks a free one)."""
    with socket.create_server((host, port)) as server:
        if ready:
            ready(server.getsockname()[1])
        server.settimeout(seconds)
        client, _ = server.accept()
        sent, end = 0, time.monotonic() + seconds
        with client:
            for line in lines:
                if time.monotonic() > end:
                    break
                try:
                    client.sendall(f"{line}\n".encode())
                except OSError:
                    break
                sent += 1
                time.sleep(pause)
        return sent
