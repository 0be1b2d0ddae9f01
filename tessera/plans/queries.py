"""The queries over the driver's tables, each with the SQL of another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import color, matrices
from ..functions.dialect import OTHER, SPARK, Dialect
from ..operators import analytics, demosaic, geometry, metrics, preprocess, stencil
from ..sources import planes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLANE, TRUTH = planes.orders_plane(OTHER), planes.orders_truth(OTHER)
CURVE = [(0.0, 0.0), (0.15, 0.1), (0.4, 0.45), (0.7, 0.8), (1.0, 1.0)]
LEVELS = preprocess.Levels(black=(256.0, 260.0, 250.0, 244.0), white=60000.0, active=(2, 3, 120, 95), delta_rows=[0.5, 1.0, 1.5, 2.0], delta_columns=[0.25 * k for k in range(8)])
GAINS = {"R": 1.9140625, "G": 1.0, "B": 1.484375}
#: A 6 x 4 table of hue shift, saturation scale, value scale.
TABLE = [(float(3 * i - 2 * k), 0.8 + 0.05 * i, 1.1 - 0.02 * k) for i in range(6) for k in range(4)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def both(name: str, text: Callable[[Dialect], str], *tables: str) -> None:
    """A query that is SQL in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planes.read(spark, sf_dir, *tables)
        return spark.sql(text(SPARK))

    QUERIES[name], ORACLE_SQL[name] = run, text(OTHER)


# Planes and mosaics
both("plane_from_orders", planes.orders_plane, "orders")
both("truth_from_orders", planes.orders_truth, "orders")


def _embedding(d: Dialect) -> str:
    value = d.int("least(65535, greatest(0, (CAST(v AS DOUBLE) + 1) * 32767.5))".replace("32767.5", "CAST(32767.5 AS DOUBLE)"))
    if d.spark:
        return f"SELECT 0 AS image_id, CAST(vec_id AS INT) AS y, CAST(p AS INT) AS x, {value} AS s FROM (SELECT vec_id, posexplode(embedding) AS (p, v) FROM embeddings)"
    return f"SELECT 0 AS image_id, CAST(vec_id AS INT) AS y, CAST(p - 1 AS INT) AS x, {value} AS s FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)"


both("plane_from_embeddings", _embedding, "embeddings")
MOSAIC = {p: f"SELECT image_id, y, x, {planes.by_pattern([c.lower() for c in planes.CFA[p]])} AS s FROM ({TRUTH}) AS t" for p in planes.CFA}
for _p in planes.CFA:
    query(f"mosaic_{_p.lower()}", MOSAIC[_p])(lambda spark, sf_dir, p=_p: planes.mosaic(planes.truth(spark, sf_dir), p))

# Per-sample maps
query("raw_map", f"SELECT image_id, y, x, {preprocess.raw_map(LEVELS, OTHER)} AS s FROM ({PLANE}) AS t")(lambda spark, sf_dir: planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", f"{preprocess.raw_map(LEVELS, SPARK)} AS s"))
query("white_balance", f"SELECT image_id, y, x, {preprocess.white_balance(GAINS, 'RGGB', OTHER)} AS s FROM ({PLANE}) AS t")(
    lambda spark, sf_dir: planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", f"{preprocess.white_balance(GAINS, 'RGGB', SPARK)} AS s")
)
query("crop", f"SELECT image_id, y - 4 AS y, x - 10 AS x, s FROM ({PLANE}) AS t WHERE y >= 4 AND y < 64 AND x >= 10 AND x < 90")(lambda spark, sf_dir: geometry.crop(planes.plane(spark, sf_dir), 4, 10, 60, 80))
_SIZE = f"(SELECT max(y) AS bottom, max(x) AS right_ FROM ({PLANE}) AS q)"
for _deg, _y, _x in ((90, "x", "bottom - y"), (180, "bottom - y", "right_ - x"), (270, "right_ - x", "y")):
    query(f"rotate_{_deg}", f"SELECT image_id, {_y} AS y, {_x} AS x, s FROM ({PLANE}) AS t, {_SIZE} AS size")(lambda spark, sf_dir, deg=_deg: geometry.rotate(planes.plane(spark, sf_dir), deg))
query("to_8_bit", f"SELECT image_id, y, x, {OTHER.int('s / CAST(65535 AS DOUBLE) * 255')} AS s FROM ({PLANE}) AS t")(lambda spark, sf_dir: planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", f"{SPARK.int('s / CAST(65535 AS DOUBLE) * 255')} AS s"))
query("invert", f"SELECT image_id, y, x, 65535 - s AS s FROM ({PLANE}) AS t")(lambda spark, sf_dir: planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", "65535 - s AS s"))
query("probe_window", f"SELECT y, x, s FROM ({PLANE}) AS t WHERE abs(x - 50) <= 4 AND abs(y - 7) <= 4")(lambda spark, sf_dir: planes.plane(spark, sf_dir).filter("abs(x - 50) <= 4 AND abs(y - 7) <= 4").select("y", "x", "s"))

# Reconstruction
for _m in demosaic.METHODS:
    for _p in ("RGGB", "GBRG") if _m != "NONE" else ("RGGB",):
        _name = f"demosaic_{_m.lower()}" + ("" if _p == "RGGB" else f"_{_p.lower()}")
        query(_name, demosaic.demosaic_sql(MOSAIC[_p], _m, _p, OTHER))(lambda spark, sf_dir, m=_m, p=_p: demosaic.demosaic(planes.mosaic(planes.truth(spark, sf_dir), p), m, p))

_TAPS = [-0.25, 0.5, 0.5, 0.5, -0.25]
for _n, _over in (("conv1d_rows", stencil.ROWS), ("conv1d_cols", stencil.COLUMNS)):
    _e = stencil.convolved("s", _TAPS, _over)
    query(_n, f"SELECT image_id, y, x, {_e} AS f FROM ({PLANE}) AS t")(lambda spark, sf_dir, e=_e: planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", f"{e} AS f"))
_LOW = planes.by_pattern(["v", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)", "v"])
_LOW_V = "s / CAST(4 AS DOUBLE) + (s_n + s_s + s_w + s_e) / CAST(8 AS DOUBLE) + (s_nw + s_ne + s_sw + s_se) / CAST(16 AS DOUBLE)"
_LOW_N = {"s": ["n", "s", "w", "e", "nw", "ne", "sw", "se"]}
query("lowpass_3x3", f"SELECT image_id, y, x, {_LOW} AS f FROM (SELECT *, {_LOW_V} AS v FROM ({stencil.neighbours_sql(PLANE, _LOW_N)}) AS a) AS t")(
    lambda spark, sf_dir: stencil.neighbours(planes.plane(spark, sf_dir), _LOW_N).selectExpr("*", f"{_LOW_V} AS v").selectExpr("image_id", "y", "x", f"{_LOW} AS f")
)

# Metrics: the rendering of the bilinear method against the truth, two pixels of margin left out
_DONE = demosaic.demosaic_sql(MOSAIC["RGGB"], "BILINEAR_MEAN", "RGGB", OTHER)
_EDGE = f"x >= 2 AND x < 98 AND y >= 2 AND y < (SELECT max(y) - 1 FROM ({PLANE}) AS q)"
_PAIR = f"SELECT t.image_id, t.y, t.x, a.r AS a_r, a.g AS a_g, a.b AS a_b, t.r AS b_r, t.g AS b_g, t.b AS b_b FROM ({_DONE}) AS a JOIN ({TRUTH}) AS t ON a.image_id = t.image_id AND a.y = t.y AND a.x = t.x WHERE t.x >= 2 AND t.x < 98 AND t.y >= 2 AND t.y < (SELECT max(y) - 1 FROM ({PLANE}) AS q)"


def beside_truth(spark: SparkSession, sf_dir: str, method: str = "BILINEAR_MEAN") -> DataFrame:
    """The rendering a_r, a_g, a_b beside the truth b_r, b_g, b_b, which rides along the windows instead of being joined."""
    sample = planes.by_pattern([c.lower() for c in planes.CFA["RGGB"]])
    plane = planes.truth(spark, sf_dir).selectExpr("image_id", "y", "x", f"{sample} AS s", *(f"{c} AS b_{c}" for c in "rgb"))
    return demosaic.demosaic(plane, method, carry=("b_r", "b_g", "b_b")).withColumnsRenamed({c: f"a_{c}" for c in "rgb"})


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.inner(beside_truth(spark, sf_dir), 2)


_D = "abs(a_g - b_g)"
query("diff_image", f"SELECT image_id, y, x, {OTHER.int('least(255, greatest(0, CAST(255 AS DOUBLE) / 65535 * (a_g - b_g) + CAST(127.5 AS DOUBLE)))')} AS d FROM ({_PAIR}) AS p")(lambda spark, sf_dir: metrics.difference_image(pair(spark, sf_dir), "g", 65535))
query(
    "diff_report",
    f"SELECT count(*) AS n, CAST(sum(CASE WHEN {_D} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS differing, round(100.0::DOUBLE * sum(CASE WHEN {_D} > 0 THEN 1 ELSE 0 END) / count(*), 6) AS percent, round(coalesce(CAST(sum({_D}) AS DOUBLE) / nullif(sum(CASE WHEN {_D} > 0 THEN 1 ELSE 0 END), 0), 0), 6) AS mean_difference, CAST(max({_D}) AS BIGINT) AS largest, round(CAST(sum(CAST({_D} AS BIGINT) * {_D}) AS DOUBLE) / count(*), 6) AS mse FROM ({_PAIR}) AS p",
)(lambda spark, sf_dir: metrics.report(pair(spark, sf_dir), "g"))
query(
    "diff_histogram",
    f"SELECT b_g >> 12 AS bucket, count(*) AS n, CAST(sum(CASE WHEN {_D} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS differing, CAST(max({_D}) AS BIGINT) AS largest, round(CAST(sum(CAST({_D} AS BIGINT) * {_D}) AS DOUBLE) / count(*), 6) AS mse FROM ({_PAIR}) AS p GROUP BY 1",
)(lambda spark, sf_dir: metrics.histogram_report(pair(spark, sf_dir), "g"))
_SUMS = ", ".join(f"CAST(sum(CAST(a_{c} - b_{c} AS BIGINT) * (a_{c} - b_{c})) AS DOUBLE) AS sq_{c}, max(abs(a_{c} - b_{c})) AS max_{c}" for c in "rgb")
_MSE = "((sq_r + sq_g + sq_b) / (CAST(3 AS DOUBLE) * n) / (CAST(65535 AS DOUBLE) * 65535))"
query("metric_mse_psnr", f"SELECT n, {', '.join(f'round(sq_{c} / n, 6) AS mse_{c}' for c in 'rgb')}, max_r, max_g, max_b, round(CASE WHEN {_MSE} > 0 THEN -10 * log10({_MSE}) END, 6) AS psnr FROM (SELECT count(*) AS n, {_SUMS} FROM ({_PAIR}) AS p) AS z")(
    lambda spark, sf_dir: metrics.mse_psnr(pair(spark, sf_dir))
)
query("rgb_histogram", " UNION ALL ".join(f"SELECT '{c}' AS channel, {OTHER.int(f'{c} / CAST(65535 AS DOUBLE) * 255')} AS bin, count(*) AS n FROM ({TRUTH}) AS t GROUP BY 2" for c in "rgb"))(lambda spark, sf_dir: metrics.rgb_histogram(planes.truth(spark, sf_dir)))

# Colour chain over 0..1
_UNIT = "SELECT image_id, y, x, r / CAST(65535 AS DOUBLE) AS r, g / CAST(65535 AS DOUBLE) AS g, b / CAST(65535 AS DOUBLE) AS b FROM ({}) AS u"


def _chain(name: str, names: str, expressions: Callable[[Dialect], list[str]], before: Callable[[Dialect], str] | None = None) -> None:
    """A projection of the unit-scaled truth, or of another projection of it; results are rounded, as powers may differ in the last bit."""

    def text(d: Dialect) -> str:
        source = _UNIT.format(planes.orders_truth(d))
        if before:
            source = before(d).format(source)
        return "SELECT image_id, y, x, " + ", ".join(f"round({e}, 9) AS {n}" for e, n in zip(expressions(d), names.split())) + f" FROM ({source}) AS t"

    both(name, text, "orders")


#: A camera's matrix to XYZ (D50), as its tags would give it.
CAMERA = [[float(v) for v in row] for row in matrices.camera_to_xyz(matrices.ColorTags(color1=[1.0234, -0.2969, -0.0664, -0.4478, 1.2148, 0.2661, -0.0617, 0.1434, 0.6812], color2=[0.9602, -0.2984, -0.0407, -0.3823, 1.1495, 0.2632, -0.0461, 0.1182, 0.6284], neutral=[0.5224, 1.0, 0.6737], cct1=2856, cct2=6504))[0]]
_TO_XYZ = color.matrix(CAMERA)
_HSV = "SELECT image_id, y, x, " + ", ".join(f"{e} AS {n}" for e, n in zip(color.hsv(), "hsv")) + " FROM ({}) AS hsv_"


def _get(d: Dialect, table: list[tuple[float, float, float]] = TABLE):
    def get(channel: int, index: str) -> str:
        items = ", ".join(f"CAST({row[channel]!r} AS DOUBLE)" for row in table)
        return f"element_at(array({items}), CAST({index} AS INT) + 1)" if d.spark else f"list_extract([{items}], CAST({index} AS INT) + 1)"

    return get


_chain("color_matrix", "r g b", lambda d: _TO_XYZ)
_chain("exposure", "r g b", lambda d: [color.exposure(c, "CAST(0.35 AS DOUBLE)") for c in "rgb"])
_chain("rgb_to_hsv", "h s v", lambda d: list(color.hsv()))
_chain("hsv_to_rgb", "r g b", lambda d: list(color.rgb()), lambda d: _HSV)
LOOK = [(float(k - i), 1.0 + 0.03 * k, 0.95 + 0.01 * i) for i in range(6) for k in range(4)]
_chain("hsv_map", "r g b", lambda d: list("rgb"), lambda d: color.hue_chain("{}", (6, 4), TABLE, _get(d)))
_chain("look_table", "r g b", lambda d: list("rgb"), lambda d: color.hue_chain("{}", (6, 4), LOOK, _get(d, LOOK)))
_chain("tone_curve", "r g b", lambda d: [color.tone_curve(c, CURVE) for c in "rgb"])
_chain("srgb_gamma", "r g b", lambda d: [color.srgb_gamma(c) for c in "rgb"])
_chain("cct", "t", lambda d: [color.cct("(r / 4 + CAST(0.2 AS DOUBLE))", "(g / 4 + CAST(0.2 AS DOUBLE))")])


def _developed(d: Dialect) -> str:
    """Balance, reconstruct, then matrix, exposure, curve and gamma, to 16 bits."""
    source = f"SELECT image_id, y, x, {preprocess.white_balance(GAINS, 'RGGB', d)} AS s FROM (SELECT image_id, y, x, {planes.by_pattern(['r', 'g', 'g', 'b'])} AS s FROM ({planes.orders_truth(d)}) AS t0) AS t1"
    unit = _UNIT.format(demosaic.demosaic_sql(source, "MALVAR_HE_CUTLER", "RGGB", d))
    lit = f"SELECT image_id, y, x, {', '.join(f'{color.exposure(e, repr(0.25))} AS {c}' for c, e in zip('rgb', _TO_XYZ))} FROM ({unit}) AS t2"
    toned = f"SELECT image_id, y, x, {', '.join(f'{color.tone_curve(c, CURVE)} AS {c}' for c in 'rgb')} FROM ({lit}) AS t3"
    back = color.matrix(color.to_srgb())
    linear = f"SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for c, e in zip('rgb', back))} FROM ({toned}) AS t4"
    return f"SELECT image_id, y, x, {', '.join('CAST(' + d.div(d.int(f'round({color.srgb_gamma(c)} * 65535, 3)'), '4') + f' AS INT) AS {c}' for c in 'rgb')} FROM ({linear}) AS t5"


both("develop_full", _developed, "orders")

# Reports: events as a timing log, line items as a log with tile sizes
_TIMING = "SELECT event_type AS task, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'MT' ELSE 'TILING' END AS strategy0, CAST(1 + user_id % 4 AS INT) AS tile, value AS duration, user_id FROM events"
_FILLED = f"SELECT task, coalesce(strategy0, 'None') AS strategy, tile, duration, user_id FROM ({_TIMING}) AS f0"
_TILES = "SELECT l_returnflag AS task, l_linestatus AS strategy, l_linenumber AS tile, l_quantity AS duration FROM lineitem"


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes.read(spark, sf_dir, "events")
    return spark.sql(_TIMING).withColumnRenamed("strategy0", "strategy").fillna("None", ["strategy"])


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes.read(spark, sf_dir, "lineitem")
    return spark.sql(_TILES)


query("mean_by_task_strategy", f"SELECT task, strategy, round(avg(duration), 6) AS mean_duration FROM ({_FILLED}) AS t GROUP BY 1, 2")(lambda spark, sf_dir: analytics.mean_by(timing(spark, sf_dir), ["task", "strategy"], "duration"))
query("min_group_n", f"SELECT min(n) AS min_n FROM (SELECT count(*) AS n FROM ({_FILLED}) AS t GROUP BY task, strategy) AS g")(lambda spark, sf_dir: analytics.least_group(timing(spark, sf_dir), ["task", "strategy"]))
query("best_tile", f"SELECT task, strategy, tile, mean_duration FROM (SELECT *, row_number() OVER (PARTITION BY task, strategy ORDER BY mean_duration, tile) AS k FROM (SELECT task, strategy, tile, round(avg(duration), 6) AS mean_duration FROM ({_TILES}) AS t GROUP BY 1, 2, 3) AS m) AS z WHERE k = 1")(
    lambda spark, sf_dir: analytics.best_tile(tiles(spark, sf_dir))
)
query("speedup", f"SELECT a.task, a.strategy, round(b.m / a.m, 6) AS speedup FROM (SELECT task, strategy, avg(duration) AS m FROM ({_FILLED}) AS t GROUP BY 1, 2) AS a LEFT JOIN (SELECT task, avg(duration) AS m FROM ({_FILLED}) AS t WHERE strategy = 'None' GROUP BY 1) AS b ON a.task = b.task")(
    lambda spark, sf_dir: analytics.speedup(timing(spark, sf_dir), "None")
)
query("relative_tile_speedup", f"SELECT task, tile, round(max(m) OVER (PARTITION BY task) / m, 6) AS relative FROM (SELECT task, tile, avg(duration) AS m FROM ({_TILES}) AS t GROUP BY 1, 2) AS g")(lambda spark, sf_dir: analytics.relative_tile_speedup(tiles(spark, sf_dir)))
query("pivot_task_strategy", "SELECT task, " + ", ".join(f"round(avg(CASE WHEN strategy = '{s}' THEN duration END), 6) AS \"{s}\"" for s in ("None", "MT", "TILING")) + f" FROM ({_FILLED}) AS t GROUP BY 1")(
    lambda spark, sf_dir: analytics.pivot(timing(spark, sf_dir), ["None", "MT", "TILING"])
)
_Q = f"SELECT task, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.5) AS median, quantile_cont(duration, 0.75) AS q3 FROM ({_FILLED}) AS t GROUP BY 1"
query("box_stats", f"SELECT t.task, round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3, min(duration) AS low, max(duration) AS high FROM ({_FILLED}) AS t JOIN ({_Q}) AS q ON t.task = q.task WHERE duration BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1")(
    lambda spark, sf_dir: analytics.box_stats(timing(spark, sf_dir), "task", "duration")
)
query("run_alg", f"SELECT user_id, tile, max(CAST(round(duration * 100) AS BIGINT)) OVER (PARTITION BY user_id, tile) AS run_method FROM ({_FILLED}) AS t")(
    lambda spark, sf_dir: analytics.latest_method(timing(spark, sf_dir).selectExpr("user_id AS system_id", "tile AS run", "CAST(round(duration * 100) AS BIGINT) AS method_id")).selectExpr("system_id AS user_id", "run AS tile", "run_method")
)
_RENAME = "CASE task WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' ELSE task END"
query("recode_union", f"SELECT {_RENAME} AS task, tile, duration FROM ({_FILLED}) AS t WHERE strategy = 'None' UNION ALL SELECT {_RENAME} AS task, tile, duration FROM ({_FILLED}) AS t WHERE strategy <> 'None'")(
    lambda spark, sf_dir: (lambda t: t.filter("strategy = 'None'").unionByName(t.filter("strategy <> 'None'")).replace({"view": "View", "click": "Click"}, subset=["task"]).select("task", "tile", "duration"))(timing(spark, sf_dir))
)
query("category_order", f"SELECT task, place, count(*) AS n FROM (SELECT task, CASE task WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END AS place FROM ({_FILLED}) AS t) AS z WHERE place IS NOT NULL GROUP BY 1, 2")(
    lambda spark, sf_dir: analytics.ranked(timing(spark, sf_dir), "task", ["purchase", "click", "view"]).groupBy("task", "place").count().withColumnRenamed("count", "n")
)

# Scalars on bytes and bits
both("sign_extend", lambda d: "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v < 8 THEN v - 15 ELSE v END AS INT) AS difference FROM (SELECT l_orderkey, l_linenumber, l_partkey % 16 AS v FROM lineitem) AS t", "lineitem")


def _predictor(d: Dialect) -> str:
    """Lossless JPEG's predictor 1 as running sums: first samples down the rows, then along each row."""
    source = planes.orders_plane(d)
    first = f"SELECT image_id, y, 32768 + sum(s % 17 - 8) OVER (PARTITION BY image_id ORDER BY y) AS start FROM ({source}) AS p WHERE x = 0"
    along = f"SELECT image_id, y, x, sum(CASE WHEN x = 0 THEN 0 ELSE s % 17 - 8 END) OVER (PARTITION BY image_id, y ORDER BY x) AS step FROM ({source}) AS p"
    return f"SELECT a.y, a.x, CAST(f.start + a.step AS BIGINT) AS s FROM ({along}) AS a JOIN ({first}) AS f ON a.image_id = f.image_id AND a.y = f.y"


both("ljpeg_predictor", _predictor, "orders")


# Wide kernels in tile form: no SQL says them in reasonable length; tests hold them against other forms.
def _tile_queries() -> None:
    from ..operators import kernels, tiles

    mosaicked = lambda spark, sf_dir: planes.mosaic(planes.truth(spark, sf_dir))
    for method in kernels.KERNELS:
        QUERIES[f"demosaic_{method.lower()}"] = lambda spark, sf_dir, m=method: tiles.demosaic(mosaicked(spark, sf_dir), m)
    for name, key in (("rcd_xy_gradient", "xy_gradient"), ("rcd_pq_gradient", "pq_gradient"), ("rcd_greens", "greens"), ("rcd_opposite", "opposite")):
        QUERIES[name] = lambda spark, sf_dir, k=key: tiles.stage(mosaicked(spark, sf_dir), k).selectExpr("image_id", "y", "x", "round(v, 6) AS v")
    QUERIES["rcd_colours"] = lambda spark, sf_dir: tiles.stage(mosaicked(spark, sf_dir), "colours").selectExpr("image_id", "y", "x", "round(r, 6) AS r", "round(b, 6) AS b")
    QUERIES["metric_mssim"] = lambda spark, sf_dir: tiles.mssim(beside_truth(spark, sf_dir), 2)
    QUERIES["tile_lowpass"] = lambda spark, sf_dir: tiles.stage(planes.plane(spark, sf_dir), "lowpass").withColumnRenamed("v", "f")
    ORACLE_SQL["tile_lowpass"] = ORACLE_SQL["lowpass_3x3"]


_tile_queries()
