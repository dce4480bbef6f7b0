"""Queries over tables read as streams, worked off until nothing is left, and helper queries on cells and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.functions.canonical import canonical_oid, finite, is_usable
from tidegrid.grid import BEIJING
from tidegrid.operators import cells, late_events, spatial, trajectories
from tidegrid.plans import pipeline_sql as p
from tidegrid.plans import spatial_queries as q
from tidegrid.plans import spatial_sql as s
from tidegrid.plans.tables import table
from tidegrid.shared import exists, shared_path
from tidegrid.sinks.streams import to_files
from tidegrid.streaming import stateful
from tidegrid.streaming.lambda_store import LambdaStore


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    # As a pattern the path may be a folder or, as in the small tables, a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/{name}.parque[t]")


def _points(spark: SparkSession, d: str) -> DataFrame:
    t = _stream(spark, d, "moving_points").where(is_usable(F.col("ts_ms")) & finite(F.col("x")) & finite(F.col("y")))
    return t.select("event_id", canonical_oid(F.col("oid")).alias("oid"), "ts_ms", "x", "y").where(F.col("oid").isNotNull())


def _worked_off(df: DataFrame, name: str) -> DataFrame:
    """A stream's result as a table in the shared folder."""
    spark = df.sparkSession
    at = shared_path(spark, name)
    to_files(df, f"{at}/out", f"{at}/progress").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def stream_range_pt_pt(spark: SparkSession, d: str) -> DataFrame:
    return _worked_off(spatial.range_query(_points(spark, d), q.sites(spark, d), q.R, BEIJING), "range").select(*q.KEYS["pt"])


def stream_range_pt_pg(spark: SparkSession, d: str) -> DataFrame:
    return _worked_off(spatial.range_query(_points(spark, d), q.zones(spark, d), q.R, BEIJING, "pt", "pg"), "range").select(*q.KEYS["pt"])


def stream_trange_rt(spark: SparkSession, d: str) -> DataFrame:
    return _worked_off(trajectories.trange(_points(spark, d), q.zones(spark, d), BEIJING), "trange")


def stream_tstats_rt(spark: SparkSession, d: str) -> DataFrame:
    stats = _worked_off(stateful.running_stats(_points(spark, d)), "stats")
    return stats.select("oid", "ts_ms", F.round("spatial_len", 6).alias("spatial_len"), "temporal_len_ms")


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_millis("window.start"))


def stream_knn_pt_pt(spark: SparkSession, d: str) -> DataFrame:
    best = _worked_off(spatial.knn_query(_points(spark, d), q.one_shape(spark, "pt"), q.KNN_R, q.K, BEIJING, windows=q.ONE_DAY), "knn")
    return _start(best).select("window_start", "rank", "oid", F.round("dist", 6).alias("dist"))


def stream_tknn(spark: SparkSession, d: str) -> DataFrame:
    best = _worked_off(trajectories.tknn(_points(spark, d), *q.PLACE, q.KNN_R, q.K, BEIJING, q.ONE_DAY), "tknn")
    return _start(best).select("window_start", "rank", "oid", F.round("dist", 6).alias("dist"), "x", "y")


def stream_tagg_sum(spark: SparkSession, d: str) -> DataFrame:
    heat = _worked_off(trajectories.taggregate(_points(spark, d), "SUM", BEIJING, q.ONE_DAY), "heat")
    return _start(heat).select("window_start", "cx", "cy", "n_traj", F.element_at("lengths", F.lit("")).alias("value"))


def stream_trange_window(spark: SparkSession, d: str) -> DataFrame:
    found = _worked_off(trajectories.trange(_points(spark, d), q.zones(spark, d), BEIJING, q.ONE_DAY), "trange")
    return _start(found).select("window_start", "oid", F.col("n").cast("long").alias("n"))


def stream_tjoin(spark: SparkSession, d: str) -> DataFrame:
    pings = q.pings_of(_stream(spark, d, "events"))
    met = _worked_off(trajectories.tjoin(_points(spark, d), pings, q.JOIN_R, BEIJING, q.ONE_DAY), "tjoin")
    return _start(met).select("window_start", "oid", "qid", "ts_ms", "x", "y", "q_ts_ms", "q_x", "q_y")


def stream_count_windows(spark: SparkSession, d: str) -> DataFrame:
    return _worked_off(stateful.count_windows(_points(spark, d), BEIJING, 20, 10), "counts")


def stream_missed_events(spark: SparkSession, d: str) -> DataFrame:
    return _worked_off(stateful.missed_events(q.devices_of(_stream(spark, d, "events"))), "missed")


SLICES = 4


def p2_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The lambda views over both streams, kept up as they arrive: in slices of arrival time each stream brings its
    batches, and a scheduled batch then replaces the open periods and freezes those past their cut-off."""
    store, logs = LambdaStore(spark, shared_path(spark, "views")), f"{shared_path(spark, 'logs')}/in"
    log = reduce(DataFrame.unionByName, (late_events.event_log(table(spark, d, t), t) for t in ("moving_points", "zone_stream")))
    first, last = log.agg(F.min("arrived_us"), F.max("arrived_us")).first()
    if first is None:
        return store.serve().select("stream_name", "oid", "period_start_ms", "n")
    span = (last - first) // SLICES + 1
    arrived = log.withColumns({"slice": F.floor((F.col("arrived_us") - F.lit(first)) / F.lit(span)).cast("int"), "feed": F.col("stream_name")})
    arrived.write.partitionBy("slice", "feed").parquet(logs)
    for i in range(SLICES):
        for name in ("moving_points", "zone_stream"):
            folder = f"{logs}/slice={i}/feed={name}"
            if not exists(spark, folder):
                continue
            add = lambda df, n, i=i, name=name: store.add(df, i * 10**6 + n, name)
            stream = spark.readStream.schema(log.schema).parquet(folder)
            stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{store.folder}/progress/{i}-{name}").trigger(availableNow=True).start().awaitTermination()
        store.recompute((first + span * (i + 1)) // 1000)
    return store.serve().select("stream_name", "oid", "period_start_ms", "n")


def replicate_pg(spark: SparkSession, d: str) -> DataFrame:
    return cells.replicate(q.zone_stream(spark, d), BEIJING, "pg").select("event_id", "cx", "cy", "ts_ms")


def replicate_ls_near(spark: SparkSession, d: str) -> DataFrame:
    return cells.replicate(q.lines("supplier")(spark, d), BEIJING, "ls", 0.03).select("oid", "cx", "cy", "ts_ms")


def cell_filter_pt(spark: SparkSession, d: str) -> DataFrame:
    near = cells.cells_within(BEIJING, *q.PLACE, 0.1, spark)
    return cells.in_cells(q.points(spark, d), near, BEIJING).select("event_id", "oid", "ts_ms")


def bboxes(spark: SparkSession, d: str) -> DataFrame:
    return G.with_shape(q.zones(spark, d), "pg").select("zone_id", "box.minx", "box.miny", "box.maxx", "box.maxy")


def site_distances(spark: SparkSession, d: str) -> DataFrame:
    """Each site's distance to the query place, plain and in metres, and to the bbox and border of the query polygon."""
    place = [F.lit(v) for v in q.PLACE]
    shape = G.with_shape(q.one_shape(spark, "pg"), "pg").select("segs", F.col("box").alias("b"))
    x, y = F.col("x"), F.col("y")
    t = q.sites(spark, d).where(finite(x) & finite(y)).join(F.broadcast(shape))  # one row
    d_ = {"plain": G.point_distance(x, y, *place), "metres": G.haversine_m(x, y, *place), "to_box": G.box_distance(G.point_box(x, y), F.col("b")), "to_border": G.point_path(x, y, F.col("segs")), "to_area": G.point_polygon(x, y, F.col("segs"))}
    return t.select("site_id", *(F.round(v, 1 if k == "metres" else 6).alias(k) for k, v in d_.items()))


QUERIES = {f.__name__: f for f in (stream_range_pt_pt, stream_range_pt_pg, stream_trange_rt, stream_tstats_rt, stream_knn_pt_pt, stream_tknn, stream_tagg_sum, stream_trange_window, stream_tjoin, stream_count_windows, stream_missed_events, p2_streamed, replicate_pg, replicate_ls_near, cell_filter_pt, bboxes, site_distances)}


def _cells(sql: str, kind: str, keys: str, r: float) -> str:
    k, n = BEIJING.candidate_layers(r), BEIJING.n - 1
    side = lambda c: f"unnest(generate_series(greatest(cmin{c} - {k}, 0), least(cmax{c} + {k}, {n})))"
    return f"SELECT {keys}, CAST(i AS INT) AS cx, CAST(j AS INT) AS cy FROM ({s.shaped(sql, kind)}) t, {side('x')} a(i), {side('y')} b(j)"


_X, _Y = (f"CAST({v} AS DOUBLE)" for v in q.PLACE)
_QX, _QY = BEIJING.index(*q.PLACE)
_NEAR = BEIJING.candidate_layers(0.1)

def closed(sql: str, points: str = s.POINTS, aligned: bool = False) -> str:
    """Rows of windows that the watermark passes at the end: it stands at the last point's time; ``aligned``: at the start
    of the last point's window."""
    last = f"(SELECT max(ts_ms{f' - ts_ms % {q.DAY}' if aligned else ''}) FROM ({points}))"
    return f"SELECT * FROM ({sql}) WHERE window_start + {q.DAY} <= {last}"


_IN_REACH = f"SELECT * FROM ({s.POINTS}) WHERE sqrt((x - {_X}) * (x - {_X}) + (y - {_Y}) * (y - {_Y})) <= {q.KNN_R!r} AND {s.IN_GRID}"
SQL = {
    "stream_knn_pt_pt": closed(s.knn("pt", "pt", q.DAY, q.DAY), _IN_REACH, True), "stream_tknn": closed(s.tknn(s.POINTS, q.KNN_R, q.DAY, q.DAY), _IN_REACH, True),
    "stream_tagg_sum": closed(s.heat(s.windows(s.CELLED.format(s.POINTS), q.DAY, q.DAY), "window_start, cx, cy", "SUM")).replace("SELECT * FROM", "SELECT window_start, cx, cy, n_traj, value FROM", 1),
    "stream_trange_window": closed(s.SQL_TRANGE_DAY), "stream_tjoin": closed(s.SQL_TJOIN_PAIRS, f"SELECT least((SELECT max(ts_ms) FROM ({s.POINTS})), (SELECT max(ts_ms) FROM ({s.PINGS}))) AS ts_ms"),
    "stream_count_windows": f"SELECT cx, cy, last, n_traj, value AS sum_ms FROM ({s.count_windows(s.POINTS)})", "stream_missed_events": s.SQL_MISSED,
    "stream_range_pt_pt": s.SQL["range_pt_pt"], "stream_range_pt_pg": s.SQL["range_pt_pg"], "stream_trange_rt": s.SQL["trange_rt"],
    "stream_tstats_rt": f"SELECT oid, ts_ms, spatial_len, temporal_len_ms FROM ({s.SQL['tstats_rt']})",
    "p2_streamed": f"SELECT stream_name, oid, period_start_ms, n FROM ({p.SQL['p2_counts']}) WHERE n > 0",
    "replicate_pg": _cells(s.ZONE_STREAM, "pg", "event_id, ts_ms", 0), "replicate_ls_near": _cells(s.QUERY_SETS["ls"], "ls", "oid, ts_ms", 0.03),
    "cell_filter_pt": f"SELECT event_id, oid, ts_ms FROM ({s.POINTS}) WHERE {s.IN_GRID} AND {s.CX} BETWEEN {_QX - _NEAR} AND {_QX + _NEAR} AND {s.CY} BETWEEN {_QY - _NEAR} AND {_QY + _NEAR}",
    "bboxes": f"SELECT zone_id, minx, miny, maxx, maxy FROM ({s.shaped(s.ZONES, 'pg')})",
    "site_distances": f"""WITH g AS ({s.shaped(s.one_shape('pg'), 'pg')}), t AS ({s.shaped(s.SITES, 'pt')})
SELECT site_id, round(sqrt((x - {_X}) * (x - {_X}) + (y - {_Y}) * (y - {_Y})), 6) AS plain,
round(6371008.7714 * acos(greatest(-1, least(1, sin(radians(y)) * sin(radians({_Y})) + cos(radians(y)) * cos(radians({_Y})) * cos(radians({_X}) - radians(x))))), 1) AS metres,
round({s.box_distance('t', 'g')}, 6) AS to_box, round(list_min(list_transform(g.segs, lambda s: {s.pt_seg('t.x', 't.y', 's')})), 6) AS to_border, round({s.distance('pt', 't', 'pg', 'g')}, 6) AS to_area FROM t, g""",
}
