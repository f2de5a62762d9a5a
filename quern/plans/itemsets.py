"""Queries of itemsets and association rules over the condition codes of patients."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.itemsets import (
    METRICS,
    basket_items,
    frequent_items,
    frequent_pairs,
    frequent_triplets,
    rules_xy,
    rules_xyz,
    select_rules,
    top_itemsets,
)
from quern.sources.sinks import fixed_width_lines
from quern.sources.tables import condition_items, table

SUPPORT = 50
MIN_STD_LIFT = 0.2


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (patient, code), kept for the levels that are all built from it."""
    return basket_items(condition_items(spark, sf_dir), "patient", "code").persist(StorageLevel.MEMORY_AND_DISK)


def _levels(spark: SparkSession, sf_dir: str, k: int) -> list[DataFrame]:
    b = _baskets(spark, sf_dir)
    out = [frequent_items(b, SUPPORT).persist(StorageLevel.MEMORY_AND_DISK)]
    if k >= 2:
        out.append(frequent_pairs(b, SUPPORT, out[0]).persist(StorageLevel.MEMORY_AND_DISK))
    if k >= 3:
        out.append(frequent_triplets(b, SUPPORT, out[0], out[1]))
    return out


def basket_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _baskets(spark, sf_dir).groupBy("basket").agg(F.count(F.lit(1)).alias("n_items"))
    return sizes.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_baskets"))


def itemsets_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 1)[0]


def itemsets_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 2)[1]


def itemsets_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 3)[2]


def itemsets_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for k, level in enumerate(_levels(spark, sf_dir, 3), 1):
        items = [F.col(f"item{i}") if i <= k else F.lit(None).cast("bigint") for i in (1, 2, 3)]
        parts.append(top_itemsets(level).select(F.lit(k).alias("k"), *[c.alias(f"item{i + 1}") for i, c in enumerate(items)], "support"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rounded(rules: DataFrame) -> DataFrame:
    keys = [c for c in rules.columns if c not in METRICS]
    return rules.select(*keys, *[F.round(m, 6).alias(m) for m in METRICS])


def assoc_rules_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rules_xy(*_levels(spark, sf_dir, 2)))


def assoc_rules_xy_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rules_xy(*_levels(spark, sf_dir, 2), denominator="baskets", baskets=_baskets(spark, sf_dir)))


def assoc_rules_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rules_xyz(*_levels(spark, sf_dir, 3)))


def rules_filtered_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(select_rules(rules_xy(*_levels(spark, sf_dir, 2)), MIN_STD_LIFT))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One description per readable code: the smallest."""
    from quern.functions.parse import integer_text

    rows = table(spark, sf_dir, "conditions").select(integer_text("code").alias("code"), "description")
    return rows.where("code is not null").groupBy("code").agg(F.min("description").alias("description"))


def report_itemsets_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_itemsets(_levels(spark, sf_dir, 1)[0])
    named = top.join(_descriptions(spark, sf_dir).withColumnRenamed("code", "item1"), "item1", "left")
    shown = named.select(F.col("item1").alias("Code"), F.col("description").alias("Conditions"), F.col("support").alias("Count"))
    return fixed_width_lines(shown, {"Code": 42, "Conditions": 120, "Count": 15}, [F.desc("Count"), F.col("Code")])


def _top_report(spark: SparkSession, sf_dir: str, k: int, widths: tuple[int, int]) -> DataFrame:
    """Codes, descriptions and support of the ten most frequent itemsets of ``k`` items, side by side."""
    top, known = top_itemsets(_levels(spark, sf_dir, k)[k - 1]), _descriptions(spark, sf_dir)
    names = [f"item{i}" for i in range(1, k + 1)]
    for n in names:
        top = top.join(known.select(F.col("code").alias(n), F.col("description").alias(f"{n}_text")), n, "left")
    columns = {n: widths[0] for n in names} | {f"{n}_text": widths[1] for n in names} | {"support": 15}
    return fixed_width_lines(top.select(*columns), columns, [F.desc("support"), *[F.col(n) for n in names]])


def report_pairs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_report(spark, sf_dir, 2, (14, 60))


def report_triplets_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_report(spark, sf_dir, 3, (14, 40))


def _rule_report(spark: SparkSession, sf_dir: str, rules: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rules with the descriptions of their codes."""
    known = _descriptions(spark, sf_dir)
    ordered = rules.select(*keys, *[F.format_string("%.6f", F.col(m)).alias(m) for m in METRICS])
    for k in keys:
        ordered = ordered.join(known.select(F.col("code").alias(k), F.col("description").alias(f"{k}_text")), k, "left")
    columns = {f"{k}_text": width for k in keys} | {m: 20 for m in ("std_lift", "lift", "confidence", "interest")}
    order = [F.col("std_lift").cast("double").desc(), *[F.col(k) for k in keys]]
    return fixed_width_lines(ordered, columns, order)


def report_rules_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_report(spark, sf_dir, rules_filtered_sorted(spark, sf_dir), ["x", "y"], 80)


def report_xyz_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rounded(select_rules(rules_xyz(*_levels(spark, sf_dir, 3)), MIN_STD_LIFT))
    return _rule_report(spark, sf_dir, rules, ["x", "y", "z"], 80)


def report_rules_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_filtered_sorted(spark, sf_dir)
    shown = rules.select(
        F.col("x").alias("X"), F.lit("->").alias("->"), F.col("y").alias("Y"),
        *[F.format_string("%.6f", F.col(m)).alias(t) for m, t in
          (("std_lift", "Std Lift"), ("lift", "Lift"), ("confidence", "Confidence"), ("interest", "Interest"))],
    )
    widths = {"X": 15, "->": 5, "Y": 15, "Std Lift": 20, "Lift": 20, "Confidence": 20, "Interest": 20}
    return fixed_width_lines(shown, widths, [F.col("Std Lift").cast("double").desc(), F.col("X"), F.col("Y")])


QUERIES = {
    f.__name__: f
    for f in (
        basket_distinct, itemsets_k1, itemsets_k2, itemsets_k3, itemsets_top10, assoc_rules_xy, assoc_rules_xy_baskets,
        assoc_rules_xyz, rules_filtered_sorted, report_itemsets_text, report_rules_text,
        report_pairs_text, report_triplets_text, report_rules_described, report_xyz_described,
    )
}

_BASE = rf"""
    with c as (select regexp_replace(lower(patient), '^\s+|\s+$', '', 'g') as o,
                      try_cast(nullif(regexp_extract(code, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint) as c, description
               from conditions),
    b as (select distinct o, c from c where o is not null and c is not null),
    l1 as (select c as item1, count(*) as support from b group by c having count(*) >= {SUPPORT}),
    f as (select b.* from b semi join l1 on b.c = l1.item1),
    l2 as (select x.c as item1, y.c as item2, count(*) as support from f x join f y on x.o = y.o and x.c > y.c
           group by all having count(*) >= {SUPPORT}),
    l3 as (select x.c as item1, y.c as item2, z.c as item3, count(*) as support
           from f x join f y on x.o = y.o and x.c > y.c join f z on y.o = z.o and y.c > z.c
           group by all having count(*) >= {SUPPORT}),
    t as (select (select sum(support) from l1)::double as t1, (select sum(support) from l2)::double as t2,
                 (select sum(support) from l3)::double as t3, (select count(distinct o) from b)::double as n)"""


def _rule_sql(rows: str, keys: str, sx: str, px: str, py: str, n: str) -> str:
    least = f"greatest({px} + {py} - 1, 1 / {n}) / ({px} * {py})"
    conf = f"(support::double / {sx})"
    return f"""
        select {keys}, round({conf}, 6) as confidence, round({conf} - {py}, 6) as interest,
               round({conf} / {py}, 6) as lift,
               round(({conf} / {py} - {least}) / (1 / greatest({px}, {py}) - {least}), 6) as std_lift
        from ({rows}), t"""


_XY = """select x, y, r.support, i.support as sx, j.support as sy from (
             select item1 as x, item2 as y, support from l2 union all select item2, item1, support from l2) r
         join l1 i on i.item1 = x join l1 j on j.item1 = y"""
_XYZ = """select x, y, z, r.support, p.support as sxy, k.support as sz from (
              select item1 as x, item2 as y, item3 as z, support from l3
              union all select item1, item3, item2, support from l3
              union all select item2, item3, item1, support from l3) r
          join l2 p on p.item1 = x and p.item2 = y join l1 k on k.item1 = z"""
_RULES = _rule_sql(_XY, "x, y", "sx", "(sx / t1)", "(sy / t1)", "t2")
_SORTED = f"select * from ({_RULES}) where std_lift >= {MIN_STD_LIFT}"

_NAMES = "d as (select c as code, min(description) as t from c where c is not null group by c)"


def _pad(parts: list[tuple[str, int]]) -> str:
    """A longer value is not cut."""
    return "rtrim(" + " || ".join(f"coalesce({c}, '') || repeat(' ', greatest(0, {w} - length(coalesce({c}, ''))))" for c, w in parts) + ")"


def _top_sql(k: int, widths: tuple[int, int]) -> str:
    items = [f"item{i}" for i in range(1, k + 1)]
    joins = " ".join(f"left join d d{i} on d{i}.code = item{i}" for i in range(1, k + 1))
    texts = ", ".join(f"d{i}.t as item{i}_text" for i in range(1, k + 1))
    line = _pad([(f"{i}::varchar", widths[0]) for i in items] + [(f"{i}_text", widths[1]) for i in items] + [("support::varchar", 15)])
    head = _pad([(f"'{i}'", widths[0]) for i in items] + [(f"'{i}_text'", widths[1]) for i in items] + [("'support'", 15)])
    order = ", ".join(["support desc", *items])
    return f"""{_BASE}, {_NAMES},
        r as (select {", ".join(items)}, support, {texts} from (select * from l{k} order by {order} limit 10) {joins})
        select row_number() over (order by {order}) as line_no, {line} as line from r union all select 0, {head}"""


def _described_sql(rules: str, keys: list[str]) -> str:
    joins = " ".join(f"left join d d{k} on d{k}.code = {k}" for k in keys)
    order = ("std_lift", "lift", "confidence", "interest")
    line = _pad([(f"d{k}.t", 80) for k in keys] + [(f"printf('%.6f', {m})", 20) for m in order])
    head = _pad([(f"'{k}_text'", 80) for k in keys] + [(f"'{m}'", 20) for m in order])
    return f"""{_BASE}, {_NAMES}, s as (select * from ({rules}) where std_lift >= {MIN_STD_LIFT})
        select row_number() over (order by std_lift desc, {", ".join(keys)}) as line_no, {line} as line from s {joins}
        union all select 0, {head}"""


ORACLE = {
    "report_pairs_text": _top_sql(2, (14, 60)),
    "report_triplets_text": _top_sql(3, (14, 40)),
    "report_rules_described": _described_sql(_RULES, ["x", "y"]),
    "report_xyz_described": _described_sql(_rule_sql(_XYZ, "x, y, z", "sxy", "(sxy / t2)", "(sz / t1)", "t3"), ["x", "y", "z"]),
    "basket_distinct": f"{_BASE} select n_items, count(*) as n_baskets from (select o, count(*) as n_items from b group by o) group by 1",
    "itemsets_k1": f"{_BASE} select * from l1",
    "itemsets_k2": f"{_BASE} select * from l2",
    "itemsets_k3": f"{_BASE} select * from l3",
    "itemsets_top10": f"""{_BASE}
        (select 1 as k, item1, null::bigint as item2, null::bigint as item3, support from l1 order by support desc, item1 limit 10)
        union all (select 2, item1, item2, null, support from l2 order by support desc, item1, item2 limit 10)
        union all (select 3, item1, item2, item3, support from l3 order by support desc, item1, item2, item3 limit 10)""",
    "assoc_rules_xy": _BASE + _RULES,
    "assoc_rules_xy_baskets": _BASE + _rule_sql(_XY, "x, y", "sx", "(sx / n)", "(sy / n)", "n"),
    "assoc_rules_xyz": _BASE + _rule_sql(_XYZ, "x, y, z", "sxy", "(sxy / t2)", "(sz / t1)", "t3"),
    "rules_filtered_sorted": _BASE + _SORTED,
    "report_itemsets_text": f"""{_BASE},
        d as (select c as code, min(description) as d from c where c is not null group by c),
        r as (select item1, d, support, row_number() over (order by support desc, item1) as line_no
              from l1 left join d on code = item1 order by line_no limit 10)
        select line_no, rtrim(rpad(item1::varchar, 42, ' ') || rpad(coalesce(d, ''), 120, ' ') || rpad(support::varchar, 15, ' ')) as line from r
        union all select 0, rtrim(rpad('Code', 42, ' ') || rpad('Conditions', 120, ' ') || 'Count')""",
    "report_rules_text": f"""{_BASE}, s as ({_SORTED}),
        r as (select *, row_number() over (order by std_lift desc, x, y) as line_no from s)
        select line_no, rtrim(rpad(x::varchar, 15, ' ') || rpad('->', 5, ' ') || rpad(y::varchar, 15, ' ')
               || rpad(printf('%.6f', std_lift), 20, ' ') || rpad(printf('%.6f', lift), 20, ' ')
               || rpad(printf('%.6f', confidence), 20, ' ') || rpad(printf('%.6f', interest), 20, ' ')) as line from r
        union all select 0, rtrim(rpad('X', 15, ' ') || rpad('->', 5, ' ') || rpad('Y', 15, ' ') || rpad('Std Lift', 20, ' ')
               || rpad('Lift', 20, ' ') || rpad('Confidence', 20, ' ') || 'Interest')""",
}
