"""Queries of the graph operators: the edge list ``ca_hepph`` and the graph of nations that trade with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.operators.graph import (
    degrees,
    eigengap,
    laplacian_spectrum,
    leading_spectrum,
    normalized_laplacian,
    power_iteration_clusters,
    spectral_clusters,
    undirected,
)
from quern.sources.tables import table


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undirected(table(spark, sf_dir, "ca_hepph"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and suppliers, weighted by the number of common order lines. Lines are counted per order key
    and supplier nation first; suppliers and nations are small."""
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(nation, "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), "c_custkey")
    rows = lines.join(buyers, "l_orderkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return undirected(rows.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), "n"), weight="n")


def edges_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(_citations(spark, sf_dir))


def norm_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_laplacian(_citations(spark, sf_dir)).withColumn("value", F.round("value", 6))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_citations(spark, sf_dir), "src", "dst")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir)


def pic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_iteration_clusters(_citations(spark, sf_dir), 4)


def spectral_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_clusters(_trade(spark, sf_dir))


def eigengap_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, values, _ = laplacian_spectrum(_trade(spark, sf_dir))
    rows = [(i, float(v), eigengap(values)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, eigenvalue double, n_clusters int")


def spectral_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_clusters(_citations(spark, sf_dir))


def eigengap_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest eigenvalues of the citations' Laplacian."""
    values, _ = leading_spectrum(_citations(spark, sf_dir))
    rows = [(i, round(abs(float(v)), 6), eigengap(values)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, eigenvalue double, n_clusters int")


def pic_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power iteration clusters of as many clusters as the eigengap tells."""
    trade = _trade(spark, sf_dir)
    _, values, _ = laplacian_spectrum(trade)
    return power_iteration_clusters(trade, max(2, eigengap(values)))


def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the clusterings of the citations give a cluster, and how often the same node."""
    parts = [
        found.agg(F.lit(name).alias("method"), F.count("cluster").alias("n_nodes"), F.count_distinct("node").alias("n_distinct"))
        for name, found in (("pic", pic_clusters(spark, sf_dir)), ("spectral", spectral_citations(spark, sf_dir)))
    ]
    return parts[0].unionByName(parts[1])


def spectrum_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and sum of squares of the eigenvalues of the trade graph, which its edges tell as well."""
    _, values, _ = laplacian_spectrum(_trade(spark, sf_dir))
    row = (len(values), round(float(values.sum()), 4), round(float((values**2).sum()), 4))
    return spark.createDataFrame([row], "n bigint, total double, squares double")


QUERIES = {
    f.__name__: f
    for f in (
        edges_canonical, node_degrees, norm_laplacian, graph_components, trade_edges, pic_clusters, spectral_nations,
        eigengap_nations, spectral_citations, eigengap_citations, pic_nations, cluster_coverage, spectrum_sums,
    )
}

_G = """
    with recursive g as (select distinct least(src, dst) as src, greatest(src, dst) as dst from ca_hepph where src is not null and dst is not null),
    p as (select * from g where src <> dst),
    d as (select node, count(*) as n from (select src as node from p union all select dst from p) group by node),
    q as (select src as node from g union select dst from g)"""

_TRADE = """
        select least(s_nationkey, c_nationkey)::bigint as src, greatest(s_nationkey, c_nationkey)::bigint as dst, count(*)::double as weight
        from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey group by 1, 2"""

ORACLE = {
    "edges_canonical": f"{_G} select src, dst, 1.0::double as weight from g",
    "node_degrees": f"""{_G} select node, count(*) as degree, count(*)::double as weighted_degree
        from (select src as node from g union all select dst from g where src <> dst) group by node""",
    "norm_laplacian": f"""{_G}
        select src, dst, round(-1 / sqrt(a.n * b.n), 6) as value from p join d a on a.node = src join d b on b.node = dst
        union all select q.node, q.node, case when n is null then 0.0 else 1.0 end from q left join d using (node)""",
    "graph_components": f"""{_G},
        e as (select src as a, dst as b from p union all select dst, src from p),
        r as (select a as node, a as root from e group by a union select e.b, r.root from r join e on r.node = e.a where r.root < e.b)
        select node, min(root) as component from r group by node""",
    "cluster_coverage": f"""{_G}
        select m as method, count(*) as n_nodes, count(*) as n_distinct from q, (values ('pic'), ('spectral')) t(m) group by m""",
    "spectrum_sums": f"""
        with t as ({_TRADE}), p as (select * from t where src <> dst),
        d as (select node, sum(weight) as w from (select src as node, weight from p union all select dst, weight from p) group by node)
        select (select count(*) from (select src from t union select dst from t)) as n,
               round((select count(*) from d), 4)::double as total,
               round((select count(*) from d) + 2 * sum(weight * weight / (a.w * b.w)), 4) as squares
        from p join d a on a.node = src join d b on b.node = dst""",
    "trade_edges": _TRADE,
}
