"""Sensor queries: features of windows, spectra, roughness. Their SQL steps through filters and the car's state row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import signals as sg
from ..operators import sensors, tracks
from ..sources import tables as t
from .field import _samples
from .queries import _HAV, query

HOUR = 3600 * tracks.SECOND


def _imu(spark: SparkSession, d: str) -> DataFrame:
    """Six axes, place and speed of each event's user."""
    turn = lambda k, n, off: ((F.col("event_id") * k % 100) / n - off).cast("double")
    return t.track(spark, d).select(
        F.col("user_id").alias("run"), "event_id", "us", turn(37, 50, 1.0).alias("ax"), turn(53, 60, 0.8).alias("ay"), (9.81 + F.col("value") / 20 - 2).alias("az"),
        turn(71, 500, 0.1).alias("gx"), turn(29, 400, 0.1).alias("gy"), turn(83, 300, 0.2).alias("gz"), "lat", "lon", (F.col("value") % 40).alias("speed_kmh"),
    )


_IMU = (
    "imu AS (SELECT user_id AS run, event_id, us, (event_id * 37 % 100) / 50 - 1.0::DOUBLE AS ax, (event_id * 53 % 100) / 60 - 0.8::DOUBLE AS ay, 9.81 + value / 20 - 2 AS az, (event_id * 71 % 100) / 500 - 0.1::DOUBLE AS gx, "
    "(event_id * 29 % 100) / 400 - 0.1::DOUBLE AS gy, (event_id * 83 % 100) / 300 - 0.2::DOUBLE AS gz, lat, lon, value % 40 AS kmh FROM track)"
)


def _filters() -> str:
    """(k, b0 to b4, a1 to a4, z1 to z4) of the acceleration (series 0) and of the three turning axes."""
    rows = []
    for k in range(4):
        b, a = sg.band_filter(*(sensors.TURN if k else sensors.SHAKE), sensors.RATE)
        rows.append("(" + ", ".join([str(k), *(f"{float(v)!r}::DOUBLE" for v in (*b, *a[1:], *sg.resting(b, a)))]) + ")")
    names = ", ".join(["k", *(f"b{i}" for i in range(5)), *(f"a{i}" for i in range(1, 5)), *(f"r{i}" for i in range(1, 5))])
    return f"co({names}) AS (VALUES {', '.join(rows)})"


def _pass(name: str, rows: str) -> str:
    """A recursive pass of the filters over rows (run, k, n, p, x), p from 0."""
    z = lambda i, old: f"{old} + b{i} * x - a{i} * (b0 * x + {{0}})"
    first = ", ".join(z(i, f"r{i + 1} * x" if i < 4 else "0.0").format("r1 * x") + f" AS z{i}" for i in range(1, 5))
    later = ", ".join((f"z{i + 1}" if i < 4 else "0.0") + f" + b{i} * e.x - a{i} * (b0 * e.x + z1)" for i in range(1, 5))
    return (
        f"{name} AS (SELECT e.run, e.k, e.n, p, b0 * x + r1 * x AS y, {first} FROM {rows} e JOIN co USING (k) WHERE p = 0 "
        f"UNION ALL SELECT e.run, e.k, e.n, e.p, b0 * e.x + z1, {later} FROM {name} q JOIN {rows} e ON e.run = q.run AND e.k = q.k AND e.p = q.p + 1 JOIN co ON co.k = e.k)"
    )


def _features_sql(windows: str) -> str:
    """All features of windows: (run, event_id, us, axes, lat, lon, kmh)."""
    band = lambda a, b: f"coalesce(sum(area) FILTER (f0 >= {a} AND f < {b}), 0) / (sum(area) + 1e-12)"
    r = lambda e, k: f'round({e} + 1e-9, 6) AS "{k}"'
    shake = {
        "imu_rms": "sqrt(avg(y * y))", "imu_std": "stddev_pop(y)", "imu_p2p": "max(y) - min(y)", "imu_max": "max(abs(y))", "imu_p95": "quantile_cont(abs(y), 0.95)", "imu_p99": "quantile_cont(abs(y), 0.99)",
        "imu_kurtosis": "avg(pow(y - my, 4)) / pow(var_pop(y), 2) - 3", "imu_skew": "avg(pow(y - my, 3)) / pow(var_pop(y), 1.5)", "imu_crest": "max(abs(y)) / greatest(sqrt(avg(y * y)), 1e-6)",
        "imu_rms_sqrtv": "sqrt(avg(y * y)) / sqrt(any_value(vm))", "imu_energia_m": "sum(y * y) / 50 / greatest(any_value(vm) * count(*) / 50, 1e-3)", "imu_jerk_rms": "sqrt(avg(pow((y - py) * 50, 2)))",
        "imu_max_sqrtv": "max(abs(y)) / sqrt(any_value(vm))",
    }
    place = {
        "gyro_yaw_rms": "sqrt(avg(yaw * yaw))", "vel_media_kmh": "any_value(vm) * 3.6", "vel_std_kmh": "stddev_samp(kmh)", "vel_min_kmh": "min(kmh)", "frac_detenido": "avg((kmh < 3)::INT)", "gps_distancia_m": "sum(step_m)",
        "gps_jitter_m": "stddev_pop(off_m)", "dq_jitter_ms": "stddev_pop(dt / 1000.0)", "dq_saturacion": "avg(((abs(ax) > 19.2276)::INT + (abs(ay) > 19.2276)::INT + (abs(az) > 19.2276)::INT) / 3.0)",
    }
    bands = {f"imu_banda_{a:g}_{b:g}": band(a, b) for a, b in sensors.BANDS}
    columns = [f'"{k}"' for k in sensors.FEATURES]
    return f"""WITH RECURSIVE {t.SQL['track']}, {_IMU}, {_filters()}, {windows},
 nb AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY run) AS n, avg(ax) OVER g AS mx, avg(ay) OVER g AS my, avg(az) OVER g AS mz, avg(lat) OVER g AS clat, avg(lon) OVER g AS clon,
               avg(greatest(kmh / 3.6, 0.5)) OVER g AS vm FROM win WINDOW g AS (PARTITION BY run)),
 vx AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS g FROM nb WHERE n >= {sensors.LEAST}),
 vy AS (SELECT *, (ax * mx + ay * my + az * mz) / g AS up, (gx * mx + gy * my + gz * mz) / g AS yaw FROM vx),
 se AS (SELECT run, n, i, 0 AS k, up - avg(up) OVER (PARTITION BY run) AS x FROM vy UNION ALL SELECT run, n, i, 1, gx - yaw * mx / g FROM vy UNION ALL SELECT run, n, i, 2, gy - yaw * my / g FROM vy UNION ALL SELECT run, n, i, 3, gz - yaw * mz / g FROM vy),
 en AS (SELECT *, first(x) OVER w AS x0, last(x) OVER w AS x1 FROM se WINDOW w AS (PARTITION BY run, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 fw AS (SELECT run, k, n, i + 15 AS p, x FROM en UNION ALL SELECT run, k, n, 15 - i, 2 * x0 - x FROM en WHERE i BETWEEN 1 AND 15 UNION ALL SELECT run, k, n, 2 * (n - 1) - i + 15, 2 * x1 - x FROM en WHERE i BETWEEN n - 16 AND n - 2),
 {_pass('fa', 'fw')}, bw AS (SELECT run, k, n, n + 29 - p AS p, y AS x FROM fa), {_pass('fb', 'bw')},
 ou AS (SELECT run, k, n, n + 14 - p AS i, y FROM fb WHERE n + 14 - p BETWEEN 0 AND n - 1),
 sh AS (SELECT o.*, avg(y) OVER (PARTITION BY o.run) AS my, lag(y) OVER (PARTITION BY o.run ORDER BY o.i) AS py, vm FROM ou o JOIN vy USING (run, i) WHERE k = 0),
 f1 AS (SELECT run, {', '.join(r(e, k) for k, e in shake.items())}, count(*) FILTER (abs(y) > 2) AS imu_choques_2, count(*) FILTER (abs(y) > 4) AS imu_choques_4, count(*) AS dq_muestras FROM sh GROUP BY run),
 ti AS (SELECT run, {r('sqrt(sum(y * y) / any_value(n))', 'gyro_tilt_rms')} FROM ou WHERE k > 0 GROUP BY run),
 pl AS (SELECT *, us - lag(us) OVER w AS dt, {_HAV.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step_m, {_HAV.format('lat', 'lon', 'clat', 'clon')} AS off_m FROM vy WINDOW w AS (PARTITION BY run ORDER BY i)),
 f2 AS (SELECT run, {', '.join(r(e, k) for k, e in place.items())} FROM pl GROUP BY run),
 ln AS (SELECT run, n, least(n, {sensors.SEGMENT}) AS l FROM sh WHERE i = 0),
 st AS (SELECT run, l, unnest(range((n - l) // (l - l // 2) + 1)) AS s FROM ln),
 sw AS (SELECT st.run, l, s, sh.i - s * (l - l // 2) AS j, y - avg(y) OVER (PARTITION BY st.run, s) AS x FROM st JOIN sh ON sh.run = st.run AND sh.i >= s * (l - l // 2) AND sh.i < s * (l - l // 2) + l),
 sx AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / l)) AS v, pow(0.5 - 0.5 * cos(2 * pi() * j / l), 2) AS q FROM sw),
 fr AS (SELECT run, l, unnest(range(l // 2 + 1)) AS h FROM ln),
 dft AS (SELECT sx.run, fr.l, s, h, (pow(sum(v * cos(2 * pi() * h * j / fr.l)), 2) + pow(sum(v * sin(2 * pi() * h * j / fr.l)), 2)) / (50 * sum(q)) * CASE WHEN h >= 1 AND h < (fr.l + 1) // 2 THEN 2 ELSE 1 END AS pw FROM sx JOIN fr ON fr.run = sx.run GROUP BY sx.run, fr.l, s, h),
 ps AS (SELECT run, l, h, h * 50.0 / l AS f, avg(pw) AS pw FROM dft GROUP BY run, l, h),
 pa AS (SELECT *, (pw + lag(pw) OVER w) / 2 * 50.0 / l AS area, lag(f) OVER w AS f0 FROM ps WINDOW w AS (PARTITION BY run ORDER BY h)),
 f3 AS (SELECT run, {', '.join(r(e, k) for k, e in bands.items())}, {r('sum(f * pw) / (sum(pw) + 1e-12)', 'imu_centroide_hz')}, {r('arg_max(f, pw)', 'imu_frec_dominante')} FROM pa GROUP BY run)
SELECT run, {', '.join(columns)} FROM f1 JOIN f2 USING (run) JOIN f3 USING (run) JOIN ti USING (run)"""


def _rounded(out: DataFrame) -> DataFrame:
    whole = ("imu_choques_2", "imu_choques_4", "dq_muestras")
    return out.select("run", *[F.col(k) if k in whole else F.round(F.col(f"`{k}`") + 1e-9, 6).alias(k) for k in sensors.FEATURES])


@query(_features_sql("win AS (SELECT * FROM imu)"))
def sns_window_features(spark, d):
    """The 33 features of each run."""
    return _rounded(sensors.window_features(_imu(spark, d), ["run"], "event_id"))


@query(_features_sql("win AS (SELECT f.event_id AS run, s.event_id, s.us, ax, ay, az, gx, gy, gz, lat, lon, kmh FROM imu s JOIN (SELECT run AS r, event_id, us FROM imu WHERE event_id % 20 = 0) f ON f.r = s.run AND s.us >= f.us - 180000000000 AND s.us < f.us + 900000000000)"))
def sns_build(spark, d):
    """The 33 features of a window of samples around each frame, from 50 hours before to 250 hours after it."""
    imu = _imu(spark, d)
    frames = imu.where("event_id % 20 = 0").select("run", F.col("event_id").alias("frame"), "us")
    found = sensors.samples_in(frames, imu, 50 * HOUR, 250 * HOUR)
    return _rounded(sensors.window_features(found.drop("run").withColumnRenamed("frame", "run"), ["run"], "event_id"))


_SPECTRUM = """WITH sa AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value / 100 - 0.5 AS y FROM events),
 ln AS (SELECT run, n, least(n, 64) AS l FROM sa WHERE i = 0 AND n >= 20), st AS (SELECT run, n, l, unnest(range((n - l) // (l - l // 2) + 1)) AS s FROM ln),
 sw AS (SELECT st.run, st.n, l, s, sa.i - s * (l - l // 2) AS j, y - avg(y) OVER (PARTITION BY st.run, s) AS x FROM st JOIN sa ON sa.run = st.run AND sa.i >= s * (l - l // 2) AND sa.i < s * (l - l // 2) + l),
 sx AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / l)) AS v, pow(0.5 - 0.5 * cos(2 * pi() * j / l), 2) AS q FROM sw), fr AS (SELECT run, unnest(range(l // 2 + 1)) AS h FROM ln),
 dft AS (SELECT sx.run, n, l, s, h, (pow(sum(v * cos(2 * pi() * h * j / l)), 2) + pow(sum(v * sin(2 * pi() * h * j / l)), 2)) / (50 * sum(q)) * CASE WHEN h >= 1 AND h < (l + 1) // 2 THEN 2 ELSE 1 END AS pw FROM sx JOIN fr ON fr.run = sx.run GROUP BY sx.run, n, l, s, h),
 ps AS (SELECT run, n, l, h * 50.0 / l AS f, avg(pw) AS pw FROM dft GROUP BY run, n, l, h)
SELECT run, n, round(coalesce(sum(pw) FILTER (f >= 0.5 AND f < 3), 0) * 50.0 / any_value(l) + 1e-9, 6) AS band_0, round(coalesce(sum(pw) FILTER (f >= 3 AND f < 10), 0) * 50.0 / any_value(l) + 1e-9, 6) AS band_1, round(coalesce(sum(pw) FILTER (f >= 10 AND f < 25), 0) * 50.0 / any_value(l) + 1e-9, 6) AS band_2,
 round(sum(f * pw) / greatest(sum(pw), 1e-300) + 1e-9, 6) AS centroid, round(arg_max(f, pw), 6) AS dominant FROM ps GROUP BY run, n"""


@query(_SPECTRUM)
def sns_spectrum(spark, d):
    """Power in bands, centroid and dominant frequency of each run."""
    out = sensors.bands_by_run(_samples(spark, d), sensors.RATE)
    return out.select("run", "n", *[F.round(F.col(k) + 1e-9, 6).alias(k) for k in ("band_0", "band_1", "band_2", "centroid")], F.round("dominant", 6).alias("dominant"))


def _iri_sql() -> str:
    step, push = sensors.golden_car()
    lit = lambda v: f"{float(v)!r}::DOUBLE"
    after = ", ".join(" + ".join([f"{lit(step[i, j])} * s{j}" for j in range(4)] + [f"{lit(push[i])} * road"]) for i in range(4))
    return (
        "WITH RECURSIVE h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, (value / 100 - 0.5) / 100 AS height FROM events), "
        "r AS (SELECT run, pos, n, height - first(height) OVER (PARTITION BY run ORDER BY pos) AS road FROM h), "
        "s AS (SELECT run, 0 AS pos, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3 FROM r WHERE pos = 0 "
        f"UNION ALL SELECT run, pos + 1, {after} FROM s JOIN r USING (run, pos)) "
        f"SELECT run, n, round(1000 * avg(abs(s1 - s3)) FILTER (pos < n - 1 AND pos * 0.25 >= {sensors.LEAD_IN}) / {sensors.SPEED!r}, 6) AS iri FROM s JOIN (SELECT DISTINCT run, n FROM r) USING (run) GROUP BY run, n"
    )


@query(_iri_sql())
def sns_iri(spark, d):
    """Roughness of each run's height profile, a sample every 0.25 m."""
    place = F.row_number().over(Window.partitionBy("run").orderBy("us", "event_id")) - 1
    out = sensors.roughness(_samples(spark, d).select("run", place.alias("pos"), (F.col("value") / 100).alias("height")), 0.25)
    return out.select("run", "n", F.round("iri", 6).alias("iri"))
