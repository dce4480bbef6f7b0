"""Queries of the spatial and trajectory operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.apps import check_in, stay_time
from tidegrid.functions import geometry as G
from tidegrid.functions.canonical import canonical_oid, finite, is_usable, usable_ms
from tidegrid.grid import BEIJING
from tidegrid.operators import spatial, trajectories
from tidegrid.operators.windowing import Windows
from tidegrid.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
HOUR, DAY = 3_600_000, 86_400_000
TWO_DAYS, ONE_DAY, ONE_HOUR = Windows(2 * DAY, DAY), Windows(DAY), Windows(HOUR)
R, KNN_R, K, JOIN_R, NEAR = 0.01, 0.5, 10, 0.01, 0.002
PLACE = (116.14319, 40.07271)
#: The single query shapes, as SQL that both engines read alike.
QUERY_RING = [(116.10, 40.02), (116.20, 40.02), (116.20, 40.11), (116.15, 40.14), (116.10, 40.11)]
QUERY_PATH = [(116.05, 40.00), (116.15, 40.08), (116.25, 40.05)]
IDS = ["bus-0042", "tram-0007", "van-0311"]
CAPACITIES = {"room0": 10, "room1": 20, "room2": 30, "room3": 40, "room4": 50}
#: Synthetic lines and points from tables without geometry: expressions that both engines read alike.
_AXIS = "CAST({base} AS DOUBLE)+CAST({span} AS DOUBLE)*CAST(({k}*{factor})%10007 AS DOUBLE)/CAST(10007 AS DOUBLE)"
LINES = {"customer": ("c_custkey", 4801, 3301, 1728000), "supplier": ("s_suppkey", 2389, 5449, 25920000)}


def line_fields(name: str) -> dict[str, str]:
    """Expressions of a line's key, time and vertices."""
    k, fx, fy, every = LINES[name]
    x, y = _AXIS.format(base=115.6, span=1.9, k=k, factor=fx), _AXIS.format(base=39.7, span=1.3, k=k, factor=fy)
    d = lambda v: f"CAST({v} AS DOUBLE)"
    out = {"oid": f"CAST({k} AS STRING)", "ts_ms": f"CAST(1704067200000 AS BIGINT)+({k}*{every})%2592000000", "x0": x, "y0": y}
    return out | {"x1": f"{x}+{d(0.02)}", "y1": f"{y}+{d(0.01)}*CAST(({k}%7)-3 AS DOUBLE)", "x2": f"{x}+{d(0.05)}", "y2": f"{y}+{d(0.01)}*CAST(({k}%5)-2 AS DOUBLE)"}


PING_X = _AXIS.format(base=115.5, span=2.1, k="", factor="").replace("(*)", "(user_id*613+((event_id*7919)%997))")
PING_Y = _AXIS.format(base=39.6, span=1.5, k="", factor="").replace("(*)", "(user_id*1217+((event_id*104729)%991))")


def points(spark: SparkSession, d: str) -> DataFrame:
    """The point stream: rows that have an oid, a time and a place; copies stay."""
    t = table(spark, d, "moving_points").where(is_usable(F.col("ts_ms")) & finite(F.col("x")) & finite(F.col("y")))
    return t.select("event_id", canonical_oid(F.col("oid")).alias("oid"), "ts_ms", "x", "y").where(F.col("oid").isNotNull())


def events(spark: SparkSession, d: str) -> DataFrame:
    """The point stream, each event once."""
    return points(spark, d).dropDuplicates(["event_id"])


def pings(spark: SparkSession, d: str) -> DataFrame:
    return pings_of(table(spark, d, "events"))


def pings_of(rows: DataFrame) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return rows.select("event_id", F.col("user_id").cast("string").alias("oid"), ms.alias("ts_ms"), F.expr(PING_X).alias("x"), F.expr(PING_Y).alias("y"))


def zone_stream(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "zone_stream").where(is_usable(F.col("ts_ms")))
    t = t.select("event_id", canonical_oid(F.col("oid")).alias("oid"), "ts_ms", "rings")
    return t.where(F.col("oid").isNotNull()).dropDuplicates(["event_id"])


def zones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "zones").select("zone_id", "oid", usable_ms(F.col("ts_ms")).alias("ts_ms"), "rings")


def sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sites").select("site_id", "x", "y")


def lines(name: str) -> Query:
    def make(spark: SparkSession, d: str) -> DataFrame:
        f = {k: F.expr(v) for k, v in line_fields(name).items()}
        path = F.array(*(F.struct(f[f"x{i}"].alias("x"), f[f"y{i}"].alias("y")) for i in range(3)))
        return table(spark, d, name).select(f["oid"].alias("oid"), f["ts_ms"].alias("ts_ms"), path.alias("path"))

    return make


def one_shape(spark: SparkSession, kind: str) -> DataFrame:
    vertices = lambda vs: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in vs))
    row = spark.range(1)
    if kind == "pt":
        return row.select(F.lit(PLACE[0]).alias("x"), F.lit(PLACE[1]).alias("y"))
    return row.select(F.array(vertices(QUERY_RING)).alias("rings")) if kind == "pg" else row.select(vertices(QUERY_PATH).alias("path"))


STREAMS: dict[str, Query] = {"pt": points, "pg": zone_stream, "ls": lines("customer")}
QUERY_SETS: dict[str, Query] = {"pt": sites, "pg": zones, "ls": lines("supplier")}
QUERY_STREAMS: dict[str, Query] = {"pt": pings, "pg": zones, "ls": lines("supplier")}
KEYS = {"pt": ["event_id", "oid", "ts_ms"], "pg": ["event_id", "oid", "ts_ms"], "ls": ["oid", "ts_ms"]}
Q_KEYS = {"pt": ["event_id"], "pg": ["zone_id"], "ls": ["oid"]}
ROW_KEY = {"pt": None, "pg": "event_id", "ls": "oid"}

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _range(kind: str, q: str, grid=BEIJING, windows: Windows | None = None, approximate: bool = False) -> Query:  # noqa: ANN001
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = spatial.range_query(STREAMS[kind](spark, d), QUERY_SETS[q](spark, d), R, grid, kind, q, ROW_KEY[kind], approximate, windows)
        return hits.select(*KEYS[kind], *(["window_start"] if windows else []))

    return run


def _knn(kind: str, q: str, grid=BEIJING, approximate: bool = False) -> Query:  # noqa: ANN001
    def run(spark: SparkSession, d: str) -> DataFrame:
        best = spatial.knn_query(STREAMS[kind](spark, d), one_shape(spark, q), KNN_R, K, grid, kind, q, TWO_DAYS, approximate)
        return best.select("window_start", "rank", "oid", F.round("dist", 6).alias("dist"))

    return run


def _join(kind: str, q: str, grid=BEIJING, approximate: bool = False) -> Query:  # noqa: ANN001
    def run(spark: SparkSession, d: str) -> DataFrame:
        right = QUERY_STREAMS[q](spark, d).where(F.col("ts_ms").isNotNull())
        pairs = spatial.spatial_join(STREAMS[kind](spark, d), right, JOIN_R, grid, kind, q, ONE_DAY, approximate)
        return pairs.select("window_start", *KEYS[kind], *(F.col(f"q_{k}") for k in Q_KEYS[q]), F.round("dist", 6).alias("dist"))

    return run


for _k in G.KINDS:
    for _q in G.KINDS:
        QUERIES[f"range_{_k}_{_q}"] = _range(_k, _q)
        QUERIES[f"knn_{_k}_{_q}_window"] = _knn(_k, _q)
        QUERIES[f"join_{_k}_{_q}_window"] = _join(_k, _q)
        QUERIES[f"range_{_k}_{_q}_window"] = _range(_k, _q, windows=TWO_DAYS)
        QUERIES[f"range_{_k}_{_q}_approx"] = _range(_k, _q, approximate=True)
        QUERIES[f"knn_{_k}_{_q}_approx"] = _knn(_k, _q, approximate=True)
        QUERIES[f"join_{_k}_{_q}_approx"] = _join(_k, _q, approximate=True)
QUERIES["range_pt_pg_naive"] = _range("pt", "pg", grid=None)
QUERIES["knn_pt_pg_naive"] = _knn("pt", "pg", grid=None)
QUERIES["join_pt_pt_naive"] = _join("pt", "pt", grid=None)
QUERIES["join_pt_pg_naive"] = _join("pt", "pg", grid=None)


def summary(paths: DataFrame, *keys: str) -> DataFrame:
    """Sub-trajectories as plain columns: n, first_ms, last_ms, length."""
    at = lambda i: F.element_at("path", i)["ts_ms"]
    return paths.select(*keys, F.size("path").cast("long").alias("n"), at(1).alias("first_ms"), at(-1).alias("last_ms"), F.round(G.path_length(F.col("path")), 6).alias("length"))


@query
def tfilter_rt(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.tfilter(points(spark, d), IDS)


@query
def tfilter_window(spark: SparkSession, d: str) -> DataFrame:
    return summary(trajectories.tfilter(events(spark, d), None, TWO_DAYS), "window_start", "oid")


@query
def trange_rt(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.trange(points(spark, d), zones(spark, d), BEIJING)


@query
def trange_naive(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.trange(points(spark, d), zones(spark, d), None)


@query
def trange_window(spark: SparkSession, d: str) -> DataFrame:
    return summary(trajectories.trange(events(spark, d), zones(spark, d), BEIJING, TWO_DAYS), "window_start", "oid")


def _stats(stats: DataFrame, *keys: str) -> DataFrame:
    return stats.select(*keys, F.round("spatial_len", 6).alias("spatial_len"), "temporal_len_ms", F.round(F.col("speed") * 1e6, 3).alias("speed_micro"))


@query
def tstats_rt(spark: SparkSession, d: str) -> DataFrame:
    return _stats(trajectories.tstats(points(spark, d)), "oid", "ts_ms")


@query
def tstats_window(spark: SparkSession, d: str) -> DataFrame:
    return _stats(trajectories.tstats(points(spark, d), None, TWO_DAYS), "window_start", "oid")


def _entries(heat: DataFrame, *keys: str) -> DataFrame:
    return heat.select(*keys, F.explode("lengths").alias("key", "value"))


def _heat_time(fn: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        heat = trajectories.taggregate(points(spark, d), fn, BEIJING, TWO_DAYS)
        return _entries(heat, "window_start", "cx", "cy", "n_traj")

    return run


for _fn in trajectories.AGGREGATES:
    QUERIES[f"tagg_{_fn.lower()}_time"] = _heat_time(_fn)


@query
def tagg_sum_count(spark: SparkSession, d: str) -> DataFrame:
    return _entries(trajectories.taggregate(events(spark, d), "SUM", BEIJING, Windows(20, 10), count_based=True), "last", "cx", "cy", "n_traj")


@query
def tagg_max_rt(spark: SparkSession, d: str) -> DataFrame:
    return _entries(trajectories.taggregate_now(points(spark, d), "MAX", BEIJING, 1705276800000, 7 * DAY), "cx", "cy", "n_traj")


@query
def tknn_rt(spark: SparkSession, d: str) -> DataFrame:
    best = trajectories.tknn(points(spark, d), *PLACE, KNN_R, K, BEIJING, ONE_HOUR)
    return best.select("window_start", "rank", "oid", F.round("dist", 6).alias("dist"), "x", "y")


@query
def tknn_window(spark: SparkSession, d: str) -> DataFrame:
    best = trajectories.tknn(events(spark, d), *PLACE, KNN_R, K, BEIJING, TWO_DAYS, paths=True)
    return summary(best, "window_start", "rank", "oid")


@query
def tknn_naive(spark: SparkSession, d: str) -> DataFrame:
    best = trajectories.tknn(points(spark, d), *PLACE, None, K, None, ONE_DAY)
    return best.select("window_start", "rank", "oid", F.round("dist", 6).alias("dist"), "x", "y")


@query
def tjoin_rt(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.tjoin(points(spark, d), pings(spark, d), JOIN_R, BEIJING, ONE_DAY).drop("window_end")


@query
def tjoin_naive(spark: SparkSession, d: str) -> DataFrame:
    """As ``tjoin_rt`` without the grid: points outside it count too."""
    return trajectories.tjoin(points(spark, d), pings(spark, d), JOIN_R, None, ONE_DAY).drop("window_end")


@query
def tknn_window_naive(spark: SparkSession, d: str) -> DataFrame:
    return summary(trajectories.tknn(events(spark, d), *PLACE, None, K, None, TWO_DAYS, paths=True), "window_start", "rank", "oid")


def _joined(paths: DataFrame) -> DataFrame:
    length = lambda c: F.round(G.path_length(F.col(c)), 6)
    return paths.select("window_start", "oid", "qid", F.size("path").cast("long").alias("n"), length("path").alias("length"), F.size("q_path").cast("long").alias("q_n"), length("q_path").alias("q_length"))


@query
def tjoin_window(spark: SparkSession, d: str) -> DataFrame:
    return _joined(trajectories.tjoin(events(spark, d), pings(spark, d), JOIN_R, BEIJING, ONE_DAY, paths=True))


@query
def tjoin_self(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d)
    return trajectories.tjoin(own, own, NEAR, BEIJING, ONE_HOUR, apart=True).drop("window_end")


@query
def stay_cell(spark: SparkSession, d: str) -> DataFrame:
    return stay_time.cell_stay_time(events(spark, d), BEIJING, ONE_DAY).select("window_start", "cx", "cy", F.round("stay_ms", 4).alias("stay_ms"))


@query
def stay_sensor(spark: SparkSession, d: str) -> DataFrame:
    return stay_time.cell_sensor_count(zone_stream(spark, d), BEIJING, ONE_DAY).drop("window_end")


@query
def stay_normalized(spark: SparkSession, d: str) -> DataFrame:
    value = stay_time.normalized_stay_time(events(spark, d), zone_stream(spark, d), BEIJING, ONE_DAY)
    return value.select("window_start", "cx", "cy", F.round("value", 4).alias("value"))


def devices_of(rows: DataFrame) -> DataFrame:
    """Events as check-ins at five rooms."""
    device = F.expr("'room' || CAST(user_id%5 AS STRING) || CASE WHEN (event_id*31)%3=0 THEN '-out' ELSE '-in' END")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return rows.select("event_id", F.col("user_id").cast("string").alias("user_id"), ms.alias("ts_ms"), device.alias("device_id"))


@query
def checkin(spark: SparkSession, d: str) -> DataFrame:
    return check_in.check_in(devices_of(table(spark, d, "events")), CAPACITIES)


@query
def heat_count(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(BEIJING.cx(F.col("x")).alias("cx"), BEIJING.cy(F.col("y")).alias("cy"))
    return p.where(BEIJING.has(F.col("cx"), F.col("cy"))).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@query
def extreme_points(spark: SparkSession, d: str) -> DataFrame:
    """Per oid the extreme coordinates, and the time when each was last reached."""
    c = F.col
    at = [("min_x", F.min("x"), F.min_by("ts_ms", F.struct("x", -c("ts_ms")))), ("max_x", F.max("x"), F.max_by("ts_ms", F.struct("x", "ts_ms"))), ("min_y", F.min("y"), F.min_by("ts_ms", F.struct("y", -c("ts_ms")))), ("max_y", F.max("y"), F.max_by("ts_ms", F.struct("y", "ts_ms")))]
    return points(spark, d).groupBy("oid").agg(*(v.alias(n) for n, v, _ in at), *(t.alias(f"{n}_ms") for n, _, t in at))


@query
def cell_bounds(spark: SparkSession, d: str) -> DataFrame:
    cells = heat_count(spark, d).select("cx", "cy")
    b = BEIJING.bounds(F.col("cx"), F.col("cy"))
    return cells.select(BEIJING.id_of(F.col("cx"), F.col("cy")).alias("cell"), *(F.round(v, 6).alias(k) for k, v in b.items()))


@query
def grid_layers(spark: SparkSession, d: str) -> DataFrame:
    """Each site's cell and, of the query place's, its layer and whether it can or must be within 0.1."""
    qx, qy = BEIJING.index(*PLACE)
    s = sites(spark, d).select("site_id", BEIJING.cx(F.col("x")).alias("cx"), BEIJING.cy(F.col("y")).alias("cy")).where(F.col("cx").isNotNull() & F.col("cy").isNotNull())
    layer = BEIJING.layer(F.col("cx"), F.col("cy"), F.lit(qx), F.lit(qy))
    return s.select("site_id", BEIJING.id_of(F.col("cx"), F.col("cy")).alias("cell"), layer.alias("layer"), (layer <= BEIJING.candidate_layers(0.1)).alias("candidate"), (layer <= BEIJING.guaranteed_layers(0.1)).alias("guaranteed"))

