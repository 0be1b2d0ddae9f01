"""Queries whose SQL is written apart from the formulas that Spark runs: by joins, aggregates and literal numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import analytics, demosaic, metrics, tiles
from ..sources import container, images, planes
from .queries import MOSAIC, ORACLE_SQL, PLANE, QUERIES, TRUTH, pair, query, timing

# Formulas of queries.py, once more by hand.
_UNIT = f"SELECT image_id, y, x, r / 65535.0::DOUBLE AS r, g / 65535.0::DOUBLE AS g, b / 65535.0::DOUBLE AS b FROM ({TRUTH}) AS t"
ORACLE_SQL["raw_map"] = f"""
SELECT image_id, y, x, CAST(trunc(least(65535, greatest(0, (s - black) / (60000 - black) * 65535))) AS INT) AS s
FROM (SELECT *, CASE WHEN y >= 2 AND y < 120 AND x >= 3 AND x < 95 THEN ([256.0, 260.0, 250.0, 244.0])[1 + x % 2 + 2 * (y % 2)]::DOUBLE + 0.5 * (1 + least(y - 2, 3)) + 0.25 * least(x - 3, 7) ELSE 256.0::DOUBLE END AS black
      FROM ({PLANE}) AS p) AS q"""


def _hue(shift: str, saturation: str, value: str) -> str:
    """A hue table, joined by its bucket, over RIMM colours; i counts hues, k saturations."""
    return f"""
WITH unit AS ({_UNIT}),
rimm AS (SELECT image_id, y, x, (1.3460::DOUBLE * r - 0.2556 * g - 0.0511 * b) / (1.3460 - 0.2556 - 0.0511) AS r, (-0.5446::DOUBLE * r + 1.5082 * g + 0.0205 * b) / (-0.5446 + 1.5082 + 0.0205) AS g, b FROM unit),
span AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rimm),
hsv0 AS (SELECT image_id, y, x, v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS h FROM span),
hsv AS (SELECT image_id, y, x, CASE WHEN h < 0 THEN h + 360 ELSE h END AS h, s, v FROM hsv0),
lut AS (SELECT i * 4 + k AS idx, {shift} AS sh, {saturation} AS sa, {value} AS va FROM range(6) AS a(i), range(4) AS c(k)),
place AS (SELECT *, h / 60 AS spot, least(CAST(floor(h / 60) AS INT), 5) AS i, least(CAST(floor(s * 3) AS INT), 2) AS k FROM hsv),
turned AS (SELECT p.image_id, p.y, p.x, p.h + (n.sh * (1 - (spot - i)) + m.sh * (spot - i)) AS h, least(p.s * (n.sa * (1 - (spot - i)) + m.sa * (spot - i)), 1) AS s, least(p.v * (n.va * (1 - (spot - i)) + m.va * (spot - i)), 1) AS v
           FROM place AS p JOIN lut AS n ON n.idx = i * 4 + k JOIN lut AS m ON m.idx = (i + 1) % 5 * 4 + k),
wheel AS (SELECT image_id, y, x, CASE WHEN h < 0 THEN h + 360 WHEN h >= 360 THEN h - 360 ELSE h END AS h, s, v FROM turned),
part AS (SELECT *, CAST(floor(h / 60) AS INT) AS n, h / 60 - floor(h / 60) AS f, v * (1 - s) AS p FROM wheel),
rgb AS (SELECT image_id, y, x, ([v, v * (1 - s * f), p, p, v * (1 - s * (1 - f)), v])[n + 1] AS r, ([v * (1 - s * (1 - f)), v, v, v * (1 - s * f), p, p])[n + 1] AS g, ([p, p, v * (1 - s * (1 - f)), v, v, v * (1 - s * f)])[n + 1] AS b FROM part)
SELECT image_id, y, x, round((0.7977::DOUBLE * r + 0.1352 * g + 0.0313 * b) / (0.7977 + 0.1352 + 0.0313), 9) AS r, round((0.2880::DOUBLE * r + 0.7119 * g + 0.0001 * b) / (0.2880 + 0.7119 + 0.0001), 9) AS g, round(b, 9) AS b FROM rgb"""


ORACLE_SQL["hsv_map"] = _hue("3.0::DOUBLE * i - 2 * k", "0.8::DOUBLE + 0.05 * i", "1.1::DOUBLE - 0.02 * k")
ORACLE_SQL["look_table"] = _hue("1.0::DOUBLE * k - i", "1.0::DOUBLE + 0.03 * k", "0.95::DOUBLE + 0.01 * i")

# Neighbourhoods by joins with clamped coordinates, where Spark has windows and tiles.
_ENDS = "(SELECT max(y) AS bottom, max(x) AS right_ FROM p)"
_HIGH = " UNION ALL ".join(f"SELECT {k} AS k, {t} AS h" for k, t in zip(range(-3, 4), (1, -3, -1, 6, -1, -3, 1)))


def _energy(down: bool) -> str:
    place = "q.x = t.x AND q.y = least(greatest(t.y + k + j, 0), bottom)" if down else "q.y = t.y AND q.x = least(greatest(t.x + k + j, 0), right_)"
    return f"SELECT y, x, greatest(sum(e * e), 0.1 / 65025) AS e FROM (SELECT t.y, t.x, j, CAST(sum(h * q.s) AS DOUBLE) AS e FROM p AS t, {_ENDS} AS z, taps, (VALUES (-1), (0), (1)) AS shifts(j), p AS q WHERE {place} GROUP BY 1, 2, 3) AS a GROUP BY 1, 2"


ORACLE_SQL["rcd_xy_gradient"] = f"WITH p AS ({MOSAIC['RGGB']}), taps AS ({_HIGH}), v AS ({_energy(True)}), h AS ({_energy(False)}) SELECT p.image_id, p.y, p.x, round(v.e / (v.e + h.e), 6) AS v FROM p JOIN v ON v.y = p.y AND v.x = p.x JOIN h ON h.y = p.y AND h.x = p.x"

_TWO = f"SELECT CAST(y % 2 AS INT) AS image_id, CAST(y // 2 AS INT) AS y, x, s FROM ({PLANE}) AS t"
_NEAR = "(SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM range(-1, 2) AS a(dy), range(-1, 2) AS b(dx))"
_BILINEAR = """
SELECT image_id, y, x,
  CASE c WHEN 0 THEN s WHEN 1 THEN (w + e) // 2 WHEN 2 THEN (n + so) // 2 ELSE (nw + ne + sw + se) // 4 END AS r,
  CASE WHEN c IN (1, 2) THEN s ELSE (n + so + w + e) // 4 END AS g,
  CASE c WHEN 3 THEN s WHEN 2 THEN (w + e) // 2 WHEN 1 THEN (n + so) // 2 ELSE (nw + ne + sw + se) // 4 END AS b
FROM (SELECT *, x % 2 + 2 * (y % 2) AS c FROM around) AS z"""
_AROUND = ", ".join(f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN q.s END) AS {n}" for n, (dy, dx) in {"n": (-1, 0), "so": (1, 0), "w": (0, -1), "e": (0, 1), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}.items())
query(
    "demosaic_two_images",
    f"WITH p AS ({_TWO}), ends AS (SELECT image_id, max(y) AS bottom, max(x) AS right_ FROM p GROUP BY 1), around AS (SELECT t.image_id, t.y, t.x, t.s, {_AROUND} FROM p AS t JOIN ends AS z ON z.image_id = t.image_id, {_NEAR} AS o, p AS q WHERE q.image_id = t.image_id AND q.y = least(greatest(t.y + dy, 0), bottom) AND q.x = least(greatest(t.x + dx, 0), right_) GROUP BY 1, 2, 3, 4) {_BILINEAR}",
)(lambda spark, sf_dir: demosaic.demosaic(planes.plane(spark, sf_dir).selectExpr("CAST(y % 2 AS INT) AS image_id", "CAST(y div 2 AS INT) AS y", "x", "s"), "BILINEAR_MEAN"))
query(
    "bilinear_reduced",
    f"""WITH p AS (SELECT *, x % 2 + 2 * (y % 2) AS c FROM ({MOSAIC['RGGB']}) AS m),
means AS (SELECT t.image_id, t.y, t.x, t.s, t.c, avg(CASE WHEN dy = 0 AND dx <> 0 THEN q.s END) AS h, avg(CASE WHEN dx = 0 AND dy <> 0 THEN q.s END) AS v, avg(CASE WHEN abs(dx) + abs(dy) = 1 THEN q.s END) AS a, avg(CASE WHEN abs(dx) + abs(dy) = 2 THEN q.s END) AS d
          FROM p AS t, {_NEAR} AS o, p AS q WHERE q.y = t.y + dy AND q.x = t.x + dx GROUP BY 1, 2, 3, 4, 5)
SELECT image_id, y, x, round(CASE c WHEN 0 THEN s WHEN 1 THEN h WHEN 2 THEN v ELSE d END, 6) AS r, round(CASE WHEN c IN (1, 2) THEN s ELSE a END, 6) AS g, round(CASE c WHEN 3 THEN s WHEN 2 THEN h WHEN 1 THEN v ELSE d END, 6) AS b FROM means""",
)(lambda spark, sf_dir: tiles.bilinear_reduced(planes.mosaic(planes.truth(spark, sf_dir))).selectExpr("image_id", "y", "x", *(f"round({c}, 6) AS {c}" for c in "rgb")))
query(
    "four_averages",
    f"WITH p AS ({PLANE}) SELECT t.image_id, t.y, t.x, round(avg(CASE WHEN dy <> 0 AND dx <> 0 THEN q.s END), 6) AS diagonal, round(avg(CASE WHEN abs(dx) + abs(dy) = 1 THEN q.s END), 6) AS axial FROM p AS t, {_ENDS} AS z, {_NEAR} AS o, p AS q WHERE q.y = least(greatest(t.y + dy, 0), bottom) AND q.x = least(greatest(t.x + dx, 0), right_) GROUP BY 1, 2, 3",
)(lambda spark, sf_dir: tiles.stage(planes.plane(spark, sf_dir), "averages").selectExpr("image_id", "y", "x", "round(diagonal, 6) AS diagonal", "round(axial, 6) AS axial"))
query(
    "window_moments",
    f"""WITH p AS ({PLANE}), smooth AS (SELECT t.y, t.x, sum(q.s * (CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE 0.25 END)) AS d FROM p AS t, {_ENDS} AS z, range(-1, 2) AS o(k), p AS q WHERE q.y = t.y AND q.x = least(greatest(t.x + k, 0), right_) GROUP BY 1, 2)
SELECT t.image_id, t.y, t.x, round(CAST(sum(q.s) AS DOUBLE), 3) AS total, round(CAST(sum(q.s::BIGINT * q.s) AS DOUBLE), 3) AS squares, round(sum((q.s - f.d) * (q.s - f.d)), 3) AS apart
FROM p AS t, {_ENDS} AS z, range(-4, 5) AS o(k), p AS q JOIN smooth AS f ON f.y = q.y AND f.x = q.x WHERE q.y = t.y AND q.x = least(greatest(t.x + k, 0), right_) GROUP BY 1, 2, 3""",
)(lambda spark, sf_dir: tiles.stage(planes.plane(spark, sf_dir), "moments").selectExpr("image_id", "y", "x", *(f"round({c}, 3) AS {c}" for c in ("total", "squares", "apart"))))
for _name, _mean in (("least_squares_code", False), ("least_squares_paper", True)):
    query(_name)(lambda spark, sf_dir, m=_mean: tiles.least_squares(planes.mosaic(planes.truth(spark, sf_dir)), m).selectExpr("image_id", "y", "x", *(f"round({c}, 6) AS {c}" for c in "rgb")))

# Files: a plane or image written and read back is what it was.


def _back(plane: DataFrame, **options) -> DataFrame:
    return container.read_planes(container.written(plane, "plane", **options)).selectExpr("0 AS image_id", "y", "x", "s")


_FORMS = {"strips_little": {"rows": 7}, "strips_big": {"rows": 16, "order": ">"}, "tiles": {"tile": (48, 32)}, "lossless_jpeg_tiles": {"tile": (64, 64), "components": 2}, "lossless_jpeg_strip": {"components": 1, "order": ">"}}
for _name, _options in _FORMS.items():
    query(f"container_{_name}", PLANE)(lambda spark, sf_dir, o=_options: _back(planes.plane(spark, sf_dir), **o))
query("container_12_bits", f"SELECT image_id, y, x, s % 4096 AS s FROM ({PLANE}) AS t")(lambda spark, sf_dir: _back(planes.plane(spark, sf_dir).selectExpr("image_id", "y", "x", "s % 4096 AS s"), bits=12, rows=10))
for _name in ("PNG16", "TIFF16"):
    query(f"image_{_name.lower()}", f"SELECT 16 AS bits, y, x, r, g, b FROM ({TRUTH}) AS t")(lambda spark, sf_dir, k=_name: images.as_pixels(images.as_files(planes.truth(spark, sf_dir), k)).drop("path"))
for _name in ("PNG8", "TIFF8", "BMP"):
    query(f"image_{_name.lower()}", f"SELECT 8 AS bits, y, x, {', '.join(f'CAST(floor({c} / 65535.0::DOUBLE * 255) AS INT) AS {c}' for c in 'rgb')} FROM ({TRUTH}) AS t")(lambda spark, sf_dir, k=_name: images.as_pixels(images.as_files(planes.truth(spark, sf_dir), k)).drop("path"))

# Metrics and logs.
_APART = "SELECT image_id, y, x, abs(a_r - b_r) AS d_r, abs(a_g - b_g) AS d_g, abs(a_b - b_b) AS d_b, b_g FROM ({}) AS p0"


def _pairs() -> str:
    sql = ORACLE_SQL["diff_histogram"]
    return sql[sql.index("FROM (") + 6 : sql.rindex(") AS p GROUP BY 1")]


_D = _APART.format(_pairs())
query(
    "metric_summary",
    f"SELECT round(top, 9) AS largest, round(mse, 9) AS mse, round(sqrt(mse), 9) AS rmse, round(-10 * log10(mse), 6) AS psnr, round(255 * top, 6) AS largest_255, round(255 * 255 * mse, 6) AS mse_255, round(255 * sqrt(mse), 6) AS rmse_255 FROM (SELECT max(greatest(d_r, d_g, d_b)) / 65535.0::DOUBLE AS top, avg(((d_r / 65535.0::DOUBLE) ** 2 + (d_g / 65535.0::DOUBLE) ** 2 + (d_b / 65535.0::DOUBLE) ** 2) / 3) AS mse FROM ({_D}) AS d) AS z",
)(lambda spark, sf_dir: metrics.summary(pair(spark, sf_dir)))
query("diff_shares", f"SELECT b_g // 4096 AS bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ({_D}) AS e), 6) AS share, round(100.0::DOUBLE * count(*) FILTER (d_g > 0) / count(*), 6) AS percent, CAST(max(d_g) AS BIGINT) AS largest, round(avg(d_g::DOUBLE * d_g), 6) AS mse FROM ({_D}) AS d GROUP BY 1")(lambda spark, sf_dir: metrics.bucket_shares(pair(spark, sf_dir), "g"))
query("diff_scaled", f"SELECT image_id, y, x, d_r, d_g, d_b, {', '.join(f'round(d_{c} / (SELECT max(greatest(d_r, d_g, d_b)) FROM ({_D}) AS e)::DOUBLE, 9) AS s_{c}' for c in 'rgb')} FROM ({_D}) AS d")(lambda spark, sf_dir: metrics.scaled_differences(pair(spark, sf_dir)))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes.read(spark, sf_dir, "lineitem")
    return spark.sql("SELECT l_returnflag AS alg, l_linestatus AS dataset, l_quantity AS mse, l_extendedprice AS psnr, l_discount AS mssim FROM lineitem")


query("accuracy_means", "SELECT l_returnflag AS alg, l_linestatus AS dataset, round(avg(l_quantity), 6) AS mse, round(avg(l_extendedprice), 6) AS psnr, round(avg(l_discount), 6) AS mssim FROM lineitem GROUP BY 1, 2")(lambda spark, sf_dir: analytics.accuracy_means(accuracy(spark, sf_dir)))
query("deviation", "SELECT event_type AS task, user_id, value AS duration, round(avg(value) OVER w, 6) AS group_mean, min(value) OVER w AS group_min, max(value) OVER w AS group_max FROM events WINDOW w AS (PARTITION BY event_type)")(lambda spark, sf_dir: analytics.deviation(timing(spark, sf_dir).select("task", "user_id", "duration"), ["task"], "duration"))
_MARKS = "SELECT 'u' || (user_id % 40) AS system_id, 'k' || (event_id % 3) AS task, event_id AS ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'end' END AS kind FROM events WHERE event_type IN ('view', 'click')"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes.read(spark, sf_dir, "events")
    return spark.sql(_MARKS)


query(
    "task_pairs",
    f"""WITH m AS ({_MARKS}) SELECT s.system_id, s.task, coalesce((SELECT arg_max(b.kind, b.ts) FROM m AS b WHERE b.system_id = s.system_id AND b.task = s.task AND b.ts < s.ts) = 'start', false) AS restarted, s.ts AS start,
e.ends AS "end", e.ends - s.ts AS duration FROM m AS s JOIN LATERAL (SELECT coalesce(min(n.ts) FILTER (n.task = s.task AND n.ts > s.ts), max(n.ts)) AS ends FROM m AS n WHERE n.system_id = s.system_id) AS e ON true WHERE s.kind = 'start'""",
)(lambda spark, sf_dir: analytics.task_pairs(marks(spark, sf_dir)))
query("run_label", "SELECT user_id, n, (['None', 'Mean', 'Median', 'Cubic'])[n % 4 + 1] AS run_label FROM (SELECT user_id, max(event_id % 4) OVER (PARTITION BY user_id) AS n FROM events) AS t")(
    lambda spark, sf_dir: (planes.read(spark, sf_dir, "events"), analytics.latest_method(spark.sql("SELECT user_id AS system_id, 0 AS run, event_id % 4 AS method_id FROM events"), {0: "None", 1: "Mean", 2: "Median", 3: "Cubic"}))[1].selectExpr("system_id AS user_id", "run_method AS n", "run_label")
)

# Scalars.


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")


query("gcd_lcm", "SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS l FROM lineitem")(lambda spark, sf_dir: _lineitem(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", f"{scalars.gcd('l_partkey', 'l_suppkey')} AS g", f"{scalars.lcm('l_partkey', 'l_suppkey')} AS l"))
query("rational_parts", "SELECT l_orderkey, l_linenumber, round(l_partkey / nullif(l_suppkey, 0)::DOUBLE, 9) AS value, l_partkey // nullif(l_suppkey, 0) AS whole, round(l_suppkey / nullif(l_partkey, 0)::DOUBLE, 9) AS reciprocal, l_partkey || '/' || l_suppkey AS shown FROM lineitem")(
    lambda spark, sf_dir: _lineitem(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", *(f"round({e}, 9) AS {n}" if n in ("value", "reciprocal") else f"{e} AS {n}" for n, e in scalars.rational("l_partkey", "l_suppkey").items()))
)
query("percent_text", "SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '%' AS shown, round(l_discount, 2) AS back FROM lineitem")(
    lambda spark, sf_dir: _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", scalars.percent(F.col("l_discount"), 0).alias("shown")).withColumn("back", F.round(scalars.from_percent(F.col("shown")), 2))
)
_AT = lambda k: f"ord(substring(url, {k}, 1))"
query("unsigned_bytes", f"SELECT page_id, {_AT(1)} * 256 + {_AT(2)} AS big16, {_AT(1)} + 256 * {_AT(2)} AS little16, (({_AT(1)}::BIGINT * 256 + {_AT(2)}) * 256 + {_AT(3)}) * 256 + {_AT(4)} AS big32, (({_AT(4)}::BIGINT * 256 + {_AT(3)}) * 256 + {_AT(2)}) * 256 + {_AT(1)} AS little32 FROM pages")(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *(scalars.unsigned(F.encode("url", "utf-8"), 0, n, little).alias(f"{'little' if little else 'big'}{8 * n}") for n in (2, 4) for little in (False, True)))
)
query("sign_extend_n", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_partkey % {1 << n} >= {1 << n - 1} THEN l_partkey % {1 << n} ELSE l_partkey % {1 << n} - {(1 << n) - 1} END AS d{n}" for n in (1, 5, 9)) + " FROM lineitem")(
    lambda spark, sf_dir: _lineitem(spark, sf_dir).selectExpr("l_orderkey", "l_linenumber", *(f"{scalars.sign_extended(f'(l_partkey % {1 << n})', n)} AS d{n}" for n in (1, 5, 9)))
)
query("tinted_red", f"SELECT image_id, y, x, r, round(r / 1.1::DOUBLE, 6) AS g, round(r / 1.1::DOUBLE, 6) AS b FROM ({TRUTH}) AS t")(lambda spark, sf_dir: planes.truth(spark, sf_dir).selectExpr("image_id", "y", "x", *(f"{e} AS {c}" if c == "r" else f"round({e}, 6) AS {c}" for e, c in zip(scalars.tinted("R"), "rgb"))))
query("file_names", "SELECT page_id, split_part(url, '.', 1) || '.png' AS renamed, lower(url) LIKE '%.html' AS is_html FROM pages")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.with_extension(F.col("url"), "png").alias("renamed"), scalars.has_extension(F.col("url"), "html").alias("is_html")))
query("zoom_steps", "SELECT DISTINCT l_discount AS factor, least(32, greatest(0.01::DOUBLE, round(l_discount * sqrt(2), 2))) AS closer, least(32, greatest(0.01::DOUBLE, round(l_discount / sqrt(2), 2))) AS farther FROM lineitem")(lambda spark, sf_dir: _lineitem(spark, sf_dir).selectExpr("l_discount AS factor").distinct().selectExpr("factor", f"{scalars.zoom('factor', True)} AS closer", f"{scalars.zoom('factor', False)} AS farther"))

__all__ = ["ORACLE_SQL", "QUERIES"]
