"""Queries of the vector aggregates and clusterings."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.parse import integer_text
from quern.operators.bfr import bfr, summary_rows
from quern.operators.vectors import (
    clean_vectors,
    cluster_metrics,
    distance_to_center,
    mahalanobis_to_centers,
    mean_and_deviation,
    nearest_center,
    nested_diameters,
    standardised,
    summaries,
    top_value_per_group,
)
from quern.operators.ward import distance_row_metrics, elbow, ward_labels
from quern.session import cut_lineage
from quern.sources.tables import table, track_vectors

WIDTH, FEATURES = 64, 518
BFR_K, BFR_THRESHOLD = 14, 3.0


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDTH, "label")


def _tracks(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """One vector per track, of those in ``ids`` (``track_id``) if given: a repeated track has the same vector. Kept for
    the passes of the clusterings."""
    vectors = track_vectors(spark, sf_dir)
    rows = clean_vectors(vectors.join(ids, "track_id", "left_semi") if ids else vectors, "track_id", "feature", FEATURES)
    return rows.groupBy("id").agg(F.first("vector").alias("vector")).persist(StorageLevel.MEMORY_AND_DISK)


def _by_place(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per element of the arrays, rounded to six digits."""
    zipped = df.select(key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "e"))
    return zipped.select(key, "pos", *[F.round(f"e.{c}", 6).alias(c) for c in columns])


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mean_and_deviation(summaries(_embeddings(spark, sf_dir), "label"))
    return _by_place(stats, "cluster", "mean", "stdev").withColumnRenamed("cluster", "label")


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = mean_and_deviation(summaries(_tracks(spark, sf_dir).withColumn("_all", F.lit(0)), "_all"))
    rows = stats.select("cluster", F.posexplode(F.arrays_zip("mean", "stdev")).alias("pos", "e"))
    return rows.select("pos", F.round("e.mean", 4).alias("mean"), F.round("e.stdev", 4).alias("stdev"))


def standardised_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standardised(_embeddings(spark, sf_dir))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select(F.col("id").alias("vec_id"), F.round(F.sqrt(square), 4).alias("norm"))


def center_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distance_to_center(_embeddings(spark, sf_dir), "label")
    return rows.select(F.col("id").alias("vec_id"), "label", F.round("euclid", 4).alias("euclid"), F.round("mahalanobis", 4).alias("mahalanobis"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _embeddings(spark, sf_dir)
    means = mean_and_deviation(summaries(points, "label")).orderBy("cluster").collect()
    found = nearest_center(points, [(r["cluster"], r["mean"]) for r in means])
    return found.select(F.col("id").alias("vec_id"), "center", F.round("distance", 4).alias("distance"))


def nearest_centroid_full_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _embeddings(spark, sf_dir)
    means = mean_and_deviation(summaries(points, "label")).orderBy("cluster").collect()
    found = mahalanobis_to_centers(points, [(r["cluster"], r["mean"]) for r in means])
    return found.select(F.col("id").alias("vec_id"), "center", F.round("distance", 4).alias("distance"))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster_metrics(_embeddings(spark, sf_dir), "label")
    return rows.select(F.col("cluster").alias("label"), "size", *[F.round(c, 4).alias(c) for c in ("radius", "diameter", "density")])


def subset_row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics over rows of distances for the tracks of the subset ``small`` by the parity of their ids."""
    small = table(spark, sf_dir, "tracks").where("set_subset = 'small'").select("track_id")
    points = _tracks(spark, sf_dir, small).withColumn("part", (F.col("id") % 2).cast("int"))
    rows = distance_row_metrics(points, "part")
    return rows.select(F.col("cluster").alias("part"), "size", *[F.round(c, 3).alias(c) for c in ("radius", "diameter", "density")])


def top_genre_per_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "tracks").select("track_id", "set_subset", "genre_top").distinct()
    clean = tracks.select("set_subset", F.initcap(F.trim("genre_top")).alias("genre"))
    return top_value_per_group(clean, "set_subset", "genre")


def bfr_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_rows(spark, bfr(_tracks(spark, sf_dir), BFR_K, BFR_THRESHOLD))


def bfr_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfr(_tracks(spark, sf_dir), BFR_K, BFR_THRESHOLD).assignments.withColumnRenamed("id", "track_id")


def bfr_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, distinct ids, and points that the summaries and the retained set count together: three equal numbers."""
    result = bfr(_tracks(spark, sf_dir), BFR_K, BFR_THRESHOLD)
    summed = int(result.discard.n.sum() + result.compressed.n.sum())
    rows = result.assignments.agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("kind") == "retained").alias("kept")
    )
    return rows.select("n_points", "n_ids", (F.col("kept") + summed).alias("n_counted"))


def bfr_top_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent genre of the tracks of each cluster of the discard set."""
    found = bfr_assignments(spark, sf_dir).where("kind = 'discard'")
    tracks = table(spark, sf_dir, "tracks").select("track_id", F.initcap(F.trim("genre_top")).alias("genre")).distinct()
    return top_value_per_group(found.join(tracks, "track_id"), "cluster", "genre")


def _ward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All readable tracks of the subset ``small``, and their ``(k, id, cluster)`` for every k, found once."""
    small = table(spark, sf_dir, "tracks").where("set_subset = 'small'").select("track_id")
    points = _tracks(spark, sf_dir, small)
    return points, cut_lineage(ward_labels(points, range(8, 17)))


def _ward_cells(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``points`` with their ``keys`` (k * 100 + cluster), their coarsest cluster ``whole`` and ``cell``, the points that share all
    their clusters; and the diameters by key."""
    own = labels.groupBy("id").agg(F.sort_array(F.collect_list(F.col("k") * 100 + F.col("cluster"))).alias("keys"))
    own = own.withColumn("whole", F.col("keys")[0]).withColumn("cell", F.concat_ws(" ", F.col("keys").cast("array<string>")))
    placed = points.join(own, "id")
    members = own.select("cell", F.explode("keys").alias("cluster")).distinct()
    return placed, nested_diameters(placed, "whole", "cell", members)


def ward_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of clusters and of points for every k."""
    _, labels = _ward(spark, sf_dir)
    return labels.groupBy("k").agg(F.count_distinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_points"))


def ward_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, far = _ward_cells(*_ward(spark, sf_dir))
    rows = cluster_metrics(placed.select("id", "vector", F.explode("keys").alias("key")), "key", far)
    return rows.select((F.col("cluster") / 100).cast("int").alias("k"), (F.col("cluster") % 100).alias("cluster"), "size", "radius", "diameter", "density")


def ward_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, far = _ward_cells(*_ward(spark, sf_dir))
    return elbow(far.select((F.col("cluster") / 100).cast("int").alias("k"), "diameter"))


QUERIES = {
    f.__name__: f
    for f in (
        centroids, feature_statistics, standardised_norms, center_distances, nearest_centroid, nearest_centroid_full_covariance, label_metrics,
        subset_row_metrics, top_genre_per_subset, bfr_summaries, bfr_assignments, bfr_invariants, bfr_top_genre, ward_invariants, ward_metrics, ward_elbow,
    )
}

_E = """
    with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
    c as (select label, pos, avg(x) as m, stddev_pop(x) as s from e group by label, pos),
    d as (select e.vec_id, e.label, sqrt(sum((x - m) * (x - m))) as euclid,
                 sqrt(sum(((x - m) / s) * ((x - m) / s))) as maha
          from e join c on e.label = c.label and e.pos = c.pos group by e.vec_id, e.label)"""

_READABLE = r"""
    with t as (select try_cast(nullif(regexp_extract(track_id, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint) as id, feature from features),
    g as (select id, any_value(feature) as f from t where id is not null and len(feature) = 518
          and len(list_filter(feature, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by id)"""

ORACLE = {
    "bfr_invariants": f"{_READABLE} select count(*) as n_points, count(*) as n_ids, count(*) as n_counted from g",
    "subset_row_metrics": f"""{_READABLE},
        s as (select id, f::double[518] as f, (id % 2)::int as part from g where id in (select track_id from tracks where set_subset = 'small')),
        d as (select x.id, x.part, y.id as other, array_distance(x.f, y.f) as d from s x join s y on true),
        m as (select part, other, avg(d) as m from d group by part, other),
        r as (select d.part, max(abs(d.d - m.m)) as radius, max(d.d) as diameter, count(distinct d.id) as size
              from d join m on m.part = d.part and m.other = d.other group by d.part)
        select part, size, round(radius, 3) as radius, round(diameter, 3) as diameter,
               round(size * (select count(*) from s) / diameter, 3) as density from r""",
    "ward_invariants": f"""{_READABLE},
        n as (select count(*) as n from g where id in (select track_id from tracks where set_subset = 'small'))
        select k::int as k, k as n_clusters, n as n_points from n, range(8, 17) r(k) where k <= n""",
    "centroids": f"{_E} select label, pos::int as pos, round(m, 6) as mean, round(s, 6) as stdev from c",
    "feature_statistics": r"""
        with t as (select try_cast(nullif(regexp_extract(track_id, '^\s*(\d+)(?:\.0)?\s*$', 1), '') as bigint) as id, feature from features),
        g as (select id, any_value(feature) as f from t where id is not null and len(feature) = 518
              and len(list_filter(feature, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by id),
        e as (select unnest(f)::double as x, generate_subscripts(f, 1) - 1 as pos from g)
        select pos::int as pos, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as stdev from e group by pos""",
    "standardised_norms": f"""{_E}, w as (select pos, avg(x) as m, stddev_pop(x) as s from e group by pos)
        select vec_id, round(sqrt(sum(((x - m) / s) * ((x - m) / s))), 4) as norm from e join w on e.pos = w.pos group by vec_id""",
    "center_distances": f"{_E} select vec_id, label, round(euclid, 4) as euclid, round(maha, 4) as mahalanobis from d",
    "nearest_centroid": f"""{_E},
        n as (select e.vec_id, c.label, sqrt(sum((x - m) * (x - m))) as d from e join c on e.pos = c.pos group by all)
        select vec_id, arg_min(label, (d, label)) as center, round(min(d), 4) as distance from n group by vec_id""",
    "label_metrics": f"""{_E},
        r as (select label, count(*) as size, max(euclid) as radius from d group by label),
        p as (select a.label, max(array_distance(a.embedding::float[{WIDTH}]::double[{WIDTH}], b.embedding::float[{WIDTH}]::double[{WIDTH}])) as far
              from embeddings a join embeddings b on a.label = b.label group by a.label)
        select label, size, round(radius, 4) as radius, round(far, 4) as diameter, round(size / (radius * radius), 4) as density
        from r join p using (label)""",
    "top_genre_per_subset": """
        with t as (select distinct track_id, set_subset, genre_top from tracks),
        n as (select set_subset, list_reduce(list_transform(string_split(lower(trim(genre_top)), ' '),
                     lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) as genre from t),
        c as (select set_subset, genre, count(*) as n from n where set_subset is not null and genre is not null group by all)
        select set_subset, genre, n from c qualify row_number() over (partition by set_subset order by n desc, genre) = 1""",
}
