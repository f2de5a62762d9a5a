import datetime as dt
import os
import random
import threading

import numpy as np
import pytest

from quern.sources.sinks import memory_stream
from quern.streaming.dgim import Dgim, dgim_batch, dgim_stream, exact_ones
from quern.streaming.sources import csv_stream, gzip_csv_lines, parse_bits, parse_events, random_bit_lines, rate_bits, serve_lines, socket_lines
from quern.streaming.windows import decayed_counts, window_counts


def test_buckets_of_seven_ones():
    d = Dgim(100, 100, "compat")
    seen = []
    for _ in range(7):
        d.update(1)
        seen.append(" ".join(f"{s}@{t}" for t, s in d.buckets))
    assert seen == ["1@1", "1@2 1@1", "1@2 2@1", "1@4 1@2 2@1", "1@4 2@2 2@1", "1@6 1@4 2@2 2@1", "1@6 2@4 2@2 2@1"]
    assert d.count() == 7
    c = Dgim(100, 100)
    for _ in range(7):
        c.update(1)
    assert c.buckets == [[7, 1], [6, 2], [4, 4]] and c.count() == 5 and c.ones == 7


@pytest.mark.parametrize("density", [0.05, 0.5, 0.95])
def test_error_is_at_most_half(density):
    rng, d, bits = random.Random(3), Dgim(200, 200), []
    for _ in range(3000):
        bits.append(int(rng.random() < density))
        d.update(bits[-1])
        exact = sum(bits[-200:])
        assert abs(d.count() - exact) <= 0.5 * exact + 1
    sizes = [s for _, s in d.buckets]
    assert all(sizes.count(s) <= 2 for s in sizes)


@pytest.mark.parametrize("mode", ["canonical", "compat"])
def test_many_bits_at_once_are_as_one_by_one(mode):
    rng = np.random.default_rng(2)
    one, many = Dgim(60, 25, mode), Dgim(60, 25, mode)
    for _ in range(40):
        bits = (rng.random(rng.integers(0, 30)) < rng.choice([0.05, 0.5, 0.9])).astype(int)
        for b in bits.tolist():
            one.update(b)
        many.extend(bits)
        assert (one.now, one.ones, one.buckets, one.count()) == (many.now, many.ones, many.buckets, many.count())


def test_unknown_mode():
    with pytest.raises(ValueError):
        Dgim(1, 1, "x")


def test_batch_keeps_streams_apart_and_ignores_nulls(spark):
    rows = [("a", i, i % 2) for i in range(50)] + [("b", i, 1) for i in range(9)] + [("a", None, 1), (None, 1, 1), ("b", 99, None)]
    df = spark.createDataFrame(rows, "k string, at bigint, bit int")
    got = {r["key"]: (r["n_bits"], r["ones"]) for r in dgim_batch(df, "k", "at", "bit", 20, 20).collect()}
    assert got == {"a": (50, 25), "b": (9, 9)}
    assert {r["key"]: r["exact"] for r in exact_ones(df, "k", "at", "bit", 4).collect()} == {"a": 2, "b": 4}
    assert dgim_batch(df.limit(0), "k", "at", "bit", 20, 20).count() == 0


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{i % 3}", i, rng.randint(0, 1)) for i in range(300)]
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        file = tmp_path / "in" / f"{part}.csv"
        file.write_text("".join(f"{k},{i},{b}\n" for k, i, b in rows[part * 100 : part * 100 + 100]))
        os.utime(file, (1_600_000_000 + part, 1_600_000_000 + part))  # files are taken in the order of their times
    stream = csv_stream(spark, str(tmp_path / "in"), "k string, at bigint, bit int")
    memory_stream(dgim_stream(stream, "k", "at", "bit", 50, 50), "dgim_rows", "update", str(tmp_path / "state")).awaitTermination()
    last = {r["key"]: r for r in spark.sql("select * from dgim_rows order by t_end").collect()}
    batch = dgim_batch(spark.createDataFrame(rows, "k string, at bigint, bit int"), "k", "at", "bit", 50, 50)
    assert {k: (r["estimate"], r["ones"]) for k, r in last.items()} == {r["key"]: (r["estimate"], r["ones"]) for r in batch.collect()}


def test_one_event_is_in_ten_windows(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0, 0, 10, 500_000), "x"), (None, "x"), (dt.datetime(2020, 1, 1), None)], "ts timestamp_ntz, e string")
    got = window_counts(df, "ts", "e", "10 seconds", "1 second").orderBy("start").collect()
    assert [r["start"].second for r in got] == list(range(1, 11)) and all(r["n"] == 1 for r in got)
    weights = decayed_counts(df, "ts", "e", "10 seconds", "1 second", 0.1, by_age=False).collect()
    assert [r["weight"] for r in weights] == [1.9] * 10
    aged = decayed_counts(df, "ts", "e", "10 seconds", "1 second", 0.1, by_age=True).orderBy("start").collect()
    assert [r["weight"] for r in aged] == [round(0.9 ** (0.5 + i), 4) for i in range(10)]


def test_watermarked_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.csv").write_text("2020-01-01T00:00:01,a\n2020-01-01T00:00:02,a\n")
    (tmp_path / "in" / "1.csv").write_text("2020-01-01T01:00:00,b\n")
    stream = csv_stream(spark, str(tmp_path / "in"), "event_time timestamp, event string")
    counts = window_counts(stream, "event_time", "event", "10 seconds", watermark="1 minute")
    memory_stream(counts, "marked", "append", str(tmp_path / "state")).awaitTermination()
    assert [(r["event"], r["n"]) for r in spark.sql("select * from marked").collect()] == [("a", 2)]


def test_lines_through_a_socket(spark, tmp_path):
    ready, port = threading.Event(), []
    lines = [next(b) for b in [random_bit_lines(1)] for _ in range(5)]
    server = threading.Thread(target=serve_lines, args=(lines * 20, "127.0.0.1", 0, 20, 0.001, lambda p: (port.append(p), ready.set())), daemon=True)
    server.start()
    assert ready.wait(10)
    query = parse_bits(socket_lines(spark, "127.0.0.1", port[0])).writeStream.format("memory").queryName("bits").start()
    server.join(20)
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from bits").collect()
    assert rows and all(r["bit"] in (0, 1) and 1 <= r["ts"] <= 5 for r in rows)


def test_parsing_and_producers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("time,event\n2020-01-01 00:00:00,x\nbad,y\n")
    lines = list(gzip_csv_lines(str(tmp_path / "e.csv.gz")))
    df = parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r["event_time"] is None, r["event"]) for r in df.collect()] == [(False, "x"), (True, "y")]
    assert rate_bits(spark).isStreaming
