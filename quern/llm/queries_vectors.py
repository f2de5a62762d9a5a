"""Queries for similarity clusters and most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.vector_cells import Scaling, scaling_of
from quern.llm.vector_clusters import cluster_medoids, vector_clusters
from quern.llm.vector_neighbors import nearest_neighbors
from quern.sources.tables import table, track_vectors

WIDTH = 518
THRESHOLD = 0.75
#: Track ids that are broadcast for the semi-join; beyond that it shuffles.
BROADCAST_IDS = 1_000_000


def _scaling(spark: SparkSession, sf_dir: str) -> Scaling:
    return scaling_of(table(spark, sf_dir, "feature_columns"), WIDTH)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = vector_clusters(
        track_vectors(spark, sf_dir), "track_id", "feature", _scaling(spark, sf_dir), THRESHOLD, min_size=3
    )
    return clusters.select("cluster_id", F.col("id").alias("track_id"))


def p2_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and three most typical tracks of every cluster."""
    vectors, scaling = track_vectors(spark, sf_dir), _scaling(spark, sf_dir)
    clusters = vector_clusters(vectors, "track_id", "feature", scaling, THRESHOLD, min_size=3)
    found = cluster_medoids(vectors, "track_id", "feature", scaling, clusters)
    return found.withColumn("mean_similarity", F.round("mean_similarity", 4))


def known_track_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the tracks that occur in ``tracks``. The vectors are not shuffled while the ids are few."""
    ids = table(spark, sf_dir, "tracks").select("track_id").where("track_id is not null")
    few = ids.count() <= BROADCAST_IDS
    return track_vectors(spark, sf_dir).join(F.broadcast(ids) if few else ids.distinct(), "track_id", "left_semi")


def _neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbors(
        known_track_vectors(spark, sf_dir), "track_id", "feature", _scaling(spark, sf_dir), k=5, threshold=THRESHOLD
    )


def p4_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar tracks of each, with their similarity to two digits."""
    return _neighbors(spark, sf_dir).select("id", "other", F.round("similarity", 2).alias("similarity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _neighbors(spark, sf_dir)
    return near.select(
        F.least("id", "other").alias("track_a"), F.greatest("id", "other").alias("track_b")
    ).distinct()


QUERIES = {"p2_found": p2_found, "p2_medoids": p2_medoids, "p4_found": p4_found, "p4_neighbors": p4_neighbors}

_VECTORS = r"""
    with recursive t as (
        select try_cast(nullif(regexp_extract(track_id, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint) as id, feature from features),
    g as (select id, any_value(feature) as f from t where id is not null and len(feature) = 518
          and len(list_filter(feature, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by id),
    k as (select list(center order by pos) as c, list(spread order by pos) as s from feature_columns),
    z as (select id, list_transform(range(1, 519), lambda i: (f[i]::double - c[i]) / s[i]) as v from g, k)"""

_CLUSTERS = f"""{_VECTORS},
        p as (select x.id as a, y.id as b from z x join z y on x.id < y.id where list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
        e as (select a, b from p union all select b, a from p),
        r as (select a as node, a as root from e group by a union select e.b, r.root from r join e on r.node = e.a where r.root < e.b),
        n as (select node, min(root) as cluster_id from r group by node),
        c as (select cluster_id, node as id, count(*) over (partition by cluster_id) as size from n qualify size >= 3)"""
_NEAR = f"""{_VECTORS},
        q as (select * from z where id in (select track_id from tracks)),
        p as (select x.id as a, y.id as b, round(list_cosine_similarity(x.v, y.v), 6) as s from q x join q y on x.id < y.id),
        e as (select a, b, s from p where s >= {THRESHOLD} union all select b, a, s from p where s >= {THRESHOLD}),
        n as (select a, b, s from e qualify row_number() over (partition by a order by s desc, b) <= 5)"""

ORACLE = {
    "p2_found": f"{_CLUSTERS} select cluster_id, id as track_id from c",
    "p2_medoids": f"""{_CLUSTERS},
        m as (select x.cluster_id, x.size, x.id, avg(list_cosine_similarity(zx.v, zy.v)) as mean
              from c x join c y using (cluster_id) join z zx on zx.id = x.id join z zy on zy.id = y.id group by all),
        w as (select *, row_number() over (partition by cluster_id order by round(mean, 6) desc, id) as rank from m)
        select cluster_id, size, rank, id, round(mean, 4) as mean_similarity from w where rank <= 3""",
    "p4_neighbors": f"{_NEAR} select a as id, b as other, round(s, 2) as similarity from n",
    "p4_found": f"{_NEAR} select distinct least(a, b) as track_a, greatest(a, b) as track_b from n",
}
