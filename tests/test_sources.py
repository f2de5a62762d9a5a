import bz2
import gzip
import json

from pyspark.sql import functions as F

from quern.functions.parse import integer_text, same_id
from quern.sources import readers
from quern.sources.sinks import fixed_width_lines, write_parquet, write_suggestions, write_text_report


def test_integer_text(spark):
    values = [" 0012.0 ", "\t7", "12a", "", None, "-3", "1.5", "1.00", "99999999999999999999", "0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(integer_text("v")).collect()] == [12, 7, None, None, None, None, None, None, None, 0]


def test_same_id(spark):
    df = spark.createDataFrame([(" AB\t",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(same_id("v")).collect()] == ["ab", None, ""]


def test_gzip_csv_and_bzip2_json(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("START,PATIENT,CODE,DESCRIPTION\n1,p,12,d\n2,q,x,e\n")
    rows = readers.read_conditions(spark, str(tmp_path / "c.csv.gz"), partitions=2).collect()
    assert {(r["patient"], r["code"]) for r in rows} == {("p", 12), ("q", None)}
    with bz2.open(tmp_path / "n.json.bz2", "wt") as f:
        f.write(json.dumps({"tweet_id": "1", "text": "t"}) + "\n" + "broken\n")
    assert [r["tweet_id"] for r in readers.read_json_lines(spark, str(tmp_path / "n.json.bz2")).collect()] == ["1", None]


def test_multi_row_header(spark, tmp_path):
    (tmp_path / "f.csv").write_text("feature,a,a\nstatistics,min,max\nnumber,01,01\ntrack_id,,\n5,1.5,x\n6,2,3\n")
    df = readers.read_multi_header_csv(spark, str(tmp_path / "f.csv"), 3, 1)
    assert df.columns[1:] == ["a_min_01", "a_max_01"]
    rows = readers.numeric_array(df, df.columns[0]).collect()
    assert [(r["id"], r["vector"]) for r in rows] == [("5", [1.5, None]), ("6", [2.0, 3.0])]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "a.edges").write_text("1 2\n2 3\n\n")
    (tmp_path / "b.edges").write_text("7 8\n")
    (tmp_path / "c.txt").write_text("# head\n1\t2\n3\tx\n")
    (tmp_path / "d.csv").write_text("4,5\n")
    (tmp_path / "u.tsv").write_text("1\t2\t3\t999\n")
    folder = readers.read_edge_folder(spark, str(tmp_path))
    assert {tuple(r) for r in folder.collect()} == {("a", 1, 2), ("a", 2, 3), ("b", 7, 8)}
    assert {tuple(r) for r in readers.read_edges(spark, str(tmp_path / "c.txt")).collect()} == {(1, 2), (3, None)}
    assert [tuple(r) for r in readers.read_edges(spark, str(tmp_path / "d.csv")).collect()] == [(4, 5)]
    assert [tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "u.tsv")).collect()] == [(1, 2, 3.0)]
    assert readers.read_lines(spark, str(tmp_path / "d.csv")).first()[0] == "4,5"


def test_reports_and_suggestions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 12), (2, None)], "n int, name string")
    lines = fixed_width_lines(df, {"n": 4, "name": 10}, [F.desc("n")])
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["n   name", "2", "1   " + "a" * 12]
    write_text_report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()][0] == "n   name"
    write_suggestions(spark.createDataFrame([("a", "b"), ("c", "a")], "id_a string, id_b string"), str(tmp_path / "s"))
    got = {r["id"]: r["similar"] for r in readers.read_suggestions(spark, str(tmp_path / "s")).collect()}
    assert got == {"a": ["b", "c"], "b": ["a"], "c": ["a"]}
    (tmp_path / "o.json").write_text(json.dumps({"x": ["y"], "z": []}))
    assert {r["id"]: r["similar"] for r in readers.read_suggestion_object(spark, str(tmp_path / "o.json")).collect()} == {"x": ["y"], "z": []}
    write_parquet(df, str(tmp_path / "p"), ["n"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_rows_that_begin_like_a_header_line_stay(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",x,y\nid,a,b\nid,7,8\n,1,2\n")
    rows = readers.read_multi_header_csv(spark, str(tmp_path / "f.csv"), 2).collect()
    assert [tuple(r) for r in rows] == [("id", "7", "8"), (None, "1", "2")]
