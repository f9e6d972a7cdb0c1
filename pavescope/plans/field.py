"""Further road-condition queries: field filters, calibration, deliverables, sensors, graph, samples and text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from ..functions import exprs as x
from ..operators import boxes as bx
from ..operators import calibration, geo, graph, pavement, sampling, sensors, tracks
from ..sources import tables as t
from . import queries as q
from .queries import _CUTS, _DOMINANT, _DV, _EARLY, _KEY, _MATCH, _PCI, _RHO, _STATE, _TAU, _iou, query, r6

# ---- filters with surfaces and other scales; thresholds by precision; calibration

_SURFACE = "CASE WHEN l_suppkey % 3 = 0 THEN 'adoquin' WHEN l_suppkey % 3 = 1 THEN 'asfalto' END"
_FULL = f"{_EARLY.replace('END AS early', f'WHEN ({_SURFACE}) IS NOT DISTINCT FROM {chr(39)}adoquin{chr(39)} AND cls <> {chr(39)}D40{chr(39)} THEN {chr(39)}2_superficie{chr(39)} END AS early')}, k AS (SELECT * FROM e WHERE early IS NULL), ok AS (SELECT DISTINCT a.segment_id, a.cls, a.chain_pos, a.cx, a.cy, a.w, a.h FROM k a JOIN k b ON a.segment_id = b.segment_id AND a.cls = b.cls AND abs(a.chain_pos - b.chain_pos) BETWEEN 1 AND 2 AND greatest({_iou('a', 'b')}, {_iou('a', 'b', 0.15)}, {_iou('a', 'b', -0.15)}) >= 0.3), l AS (SELECT {_KEY}, coalesce(early, CASE WHEN ok.cls IS NULL THEN '3_sin_persistencia' END, '') AS reason FROM e LEFT JOIN ok USING (segment_id, cls, chain_pos, cx, cy, w, h)), s AS (SELECT image_id, cls, cx + 0.3 * w * (l_suppkey % 3) AS cx, cy, w, h, conf * 0.9 AS conf FROM boxes)"


@query(f"+{_FULL} SELECT {_KEY}, CASE WHEN reason = '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.image_id = l.image_id AND s.cls = l.cls AND s.conf >= 0.6 * {_TAU.replace('cls', 's.cls')} AND {_iou('l', 's')} >= 0.5) THEN '4_sin_consenso_escala' ELSE reason END AS reason FROM l", "boxes", "frames")
def fld_filter_scales(spark, d):
    """All four layers: surfaces per box row and one other scale."""
    boxes = t.all_boxes(spark, d)
    surface = F.when(F.col("l_suppkey") % 3 == 0, "adoquin").when(F.col("l_suppkey") % 3 == 1, "asfalto")
    scale = boxes.select("image_id", "cls", (F.col("cx") + 0.3 * F.col("w") * (F.col("l_suppkey") % 3)).alias("cx"), "cy", "w", "h", (F.col("conf") * 0.9).alias("conf"))
    return bx.consensus(bx.filtered(boxes, t.frames(spark, d), surface), [scale])


@query(f"+{_MATCH}, m AS (SELECT dt.cls, dt.conf, CASE WHEN won.n = 1 THEN 1 ELSE 0 END AS tp FROM dt LEFT JOIN won USING ({_KEY})), g AS (SELECT range * 5 AS tau FROM range(1, 20)), p AS (SELECT cls, tau, coalesce(count(*) FILTER (conf * 100 + 1e-9 >= tau), 0) AS n, coalesce(sum(tp) FILTER (conf * 100 + 1e-9 >= tau), 0)::BIGINT AS tp FROM m, g GROUP BY cls, tau) SELECT cls, tau, n, tp, round(tp / greatest(n, 1), 6) AS precision, tau IS NOT DISTINCT FROM min(tau) FILTER (n > 0 AND tp / greatest(n, 1) >= 0.5) OVER (PARTITION BY cls) AS chosen FROM p", "boxes")
def fld_tau_precision(spark, d):
    return bx.precision_grid(q.QUERIES["jn_iou_greedy"](spark, d), [5 * i for i in range(1, 20)], 0.5).withColumn("precision", F.round("precision", 6))


_TRUTH3 = "CASE segment_id % 3 WHEN 0 THEN 'bueno' WHEN 1 THEN 'regular' ELSE 'malo' END"
_SWEEP = f"{_CUTS}, gm AS (SELECT range AS step, range * 5 / 100.0::DOUBLE AS m FROM range(4, 25)), e AS (SELECT b.*, f.segment_id, f.chain_pos, conf / ({_TAU}) AS ratio FROM (SELECT DISTINCT {_KEY} FROM boxes) b JOIN frames f USING (image_id) WHERE NOT (cls = 'D10' AND w > 0.5 AND h < 0.15) AND cy > 0.35 AND abs(cx - 0.5) < 0.38 + 0.12 * cy), ps AS (SELECT a.segment_id, a.cls, a.chain_pos, a.cx, a.cy, a.w, a.h, max(b.ratio) AS pr FROM e a JOIN e b ON a.segment_id = b.segment_id AND a.cls = b.cls AND abs(a.chain_pos - b.chain_pos) BETWEEN 1 AND 2 AND greatest({_iou('a', 'b')}, {_iou('a', 'b', 0.15)}, {_iou('a', 'b', -0.15)}) >= 0.3 GROUP BY ALL), lim AS (SELECT e.*, least(ratio, pr) AS lim, {q._SIZE} AS size, {q._DENSITY} AS density FROM e JOIN ps USING (segment_id, cls, chain_pos, cx, cy, w, h)), sp AS (SELECT segment_id, count(*) AS nf FROM frames GROUP BY segment_id), rr AS (SELECT segment_id, step, " + ", ".join(f"coalesce(sum(density * CASE WHEN low IS NULL OR high IS NULL THEN 1.0 WHEN size < low THEN 0.33 WHEN size >= high THEN 3.0 ELSE 1.0 END) FILTER (cls = '{k}'), 0) AS s_{k}" for k in c.CLASSES) + " FROM lim LEFT JOIN cuts USING (cls) JOIN gm ON lim.lim + 1e-9 >= gm.m GROUP BY segment_id, step), fr AS (SELECT sp.segment_id, gm.step, gm.m, " + ", ".join(f"coalesce(s_{k}, 0) / nf AS rho_{k}" for k in c.CLASSES) + f" FROM sp CROSS JOIN gm LEFT JOIN rr USING (segment_id, step)), dv AS (SELECT *, {_DV} FROM fr), sc AS (SELECT *, {_PCI} AS pci, {_TRUTH3} AS truth FROM dv), ds AS (SELECT step, m, pci, CASE truth WHEN 'bueno' THEN greatest(90 - pci, 0) WHEN 'regular' THEN greatest(56 - pci, 0) + greatest(pci - 90, 0) ELSE greatest(0 - pci, 0) + greatest(pci - 56, 0) END AS dist, CASE truth WHEN 'bueno' THEN 95.0 WHEN 'regular' THEN 73.0 ELSE 28.0 END AS centre, (CASE WHEN pci >= 90 THEN 'bueno' WHEN pci >= 56 THEN 'regular' ELSE 'malo' END = truth)::INT AS hit FROM sc), cv AS (SELECT step, any_value(m) AS m, avg(dist) AS loss, avg(hit) AS accuracy, round(abs(avg(pci) - avg(centre)), 9) AS off FROM ds GROUP BY step)"


@query(f"+{_SWEEP} SELECT m, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, step = (SELECT arg_min(step, (off, step)) FROM cv WHERE loss <= (SELECT min(loss) FROM cv) + 1e-9) AS chosen FROM cv", "boxes", "frames")
def fld_calibrate(spark, d):
    """Thresholds times m for each m of a grid, all from one filter pass: a box is kept up to its own limit of m."""
    boxes, frames = t.all_boxes(spark, d), t.frames(spark, d)
    truth = frames.select("segment_id").distinct().select("segment_id", F.when(F.col("segment_id") % 3 == 0, "bueno").when(F.col("segment_id") % 3 == 1, "regular").otherwise("malo").alias("truth"))
    curve = calibration.curve(boxes, frames, truth, pavement.cutoffs(boxes.where(F.col("conf") >= c.DETECTION)), range(4, 25), 0.05)
    return curve.select("m", r6("loss"), r6("accuracy"), "chosen")


# ---- deliverables and levels

_SEG = f"{_RHO}, seg AS (SELECT segment_id, count(*) AS n_frames, " + ", ".join(f"avg(rho_{k}) AS rho_{k}" for k in c.CLASSES) + f" FROM fr GROUP BY segment_id), dv AS (SELECT *, {_DV} FROM seg), p AS (SELECT *, {_PCI} AS pci FROM dv), z AS (SELECT segment_id, n_frames, pci, {_STATE.format('pci')} AS state, {_DOMINANT} AS dominant FROM p)"


@query(f"+{_RHO}, lv AS (SELECT 'tramo' AS level, segment_id AS id, * FROM fr UNION ALL SELECT 'sitio', segment_id % 25, * FROM fr), seg AS (SELECT level, id, count(*) AS n_frames, " + ", ".join(f"avg(rho_{k}) AS rho_{k}" for k in c.CLASSES) + f" FROM lv GROUP BY level, id), dv AS (SELECT *, {_DV} FROM seg), p AS (SELECT *, {_PCI} AS pci FROM dv) SELECT level, id, n_frames, round(pci, 6) AS pci_vis FROM p", "boxes", "frames")
def agg_multilevel(spark, d):
    """Scores of stretches and of sites, each from its own mean densities."""
    level = F.explode(F.array(F.struct(F.lit("tramo").alias("level"), F.col("segment_id").alias("id")), F.struct(F.lit("sitio").alias("level"), (F.col("segment_id") % 25).alias("id")))).alias("l")
    dens = q._densities(spark, d).select(level, *[f"rho_{k}" for k in c.CLASSES]).groupBy("l").agg(*[F.avg(f"rho_{k}").alias(f"rho_{k}") for k in c.CLASSES], F.count(F.lit(1)).alias("n_frames"))
    return pavement.scored(dens).select("l.level", "l.id", "n_frames", r6("pci_vis"))


@query(f"+{_SEG} SELECT state, least(floor(pci / 5), 19)::INT AS bin, count(*) AS n FROM z GROUP BY ALL", "boxes", "frames")
def rep_html_aggs(spark, d):
    """Histogram of segment scores by state: five-point bins, the last one closed."""
    s = pavement.segment_scores(q._densities(spark, d))
    return s.groupBy("state", F.least(F.floor(F.col("pci_vis") / 5), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_SCORES = "ref AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 100, 0), 100) AS icv, 100.0 * (SELECT count(*) FROM part WHERE p_retailprice <= 900 + c_acctbal / 10) / (SELECT count(*) FROM part) AS social, c_custkey % 101 AS mobility, c_nationkey * 4 AS safety, c_custkey % 700 AS school, c_custkey % 2100 AS hospital, (c_custkey * 37) % 101 AS rain FROM customer), pr AS (SELECT *, 0.4 * social + 0.35 * mobility + 0.25 * safety AS importance FROM ref), fin AS (SELECT id, importance, least(greatest(0.6 * (100 - icv) + 0.4 * importance + 5 * (school <= 300)::INT + 5 * (hospital <= 1000)::INT + 3 * (rain >= 75 AND icv < 56)::INT, 0), 100) AS p FROM pr)"


@query(f"WITH {_SCORES} SELECT id, round(importance, 4) AS importance, round(p, 4) AS priority, CASE WHEN p >= 60 THEN 'alta' WHEN p >= 40 THEN 'media' ELSE 'baja' END AS level FROM fin")
def geo_priority(spark, d):
    k = F.col("c_custkey")
    segs = t.read(spark, d, "customer").select(k.alias("id"), F.least(F.greatest(F.col("c_acctbal") / 100, F.lit(0.0)), F.lit(100.0)).alias("icv"), (900 + F.col("c_acctbal") / 10).alias("v0"), (k % 101).alias("mobility"), (F.col("c_nationkey") * 4).alias("safety"), (k % 700).alias("school_m"), (k % 2100).alias("hospital_m"), (k * 37 % 101).alias("rain"))
    out = geo.priority(geo.percentile_of(segs, t.read(spark, d, "part"), "v0", "p_retailprice", "social"))
    return out.select("id", F.round("importance", 4).alias("importance"), F.round("priority", 4).alias("priority"), "level")


@query(f"+{_SEG} SELECT segment_id, (row_number() OVER (ORDER BY round(pci, 6), segment_id))::INT AS ranking, state, dominant, n_frames, concat_ws(' | ', 'VIA-' || substr(sha1(segment_id::VARCHAR), 1, 12), state, coalesce(dominant, 'sin_dano')) AS label FROM z", "boxes", "frames")
def rep_segments(spark, d):
    """Ranked segments, the worst first. Ranks come from counts of range-partitioned rows, not from one task."""
    s = pavement.segment_scores(q._densities(spark, d)).withColumn("key", F.round("pci_vis", 6))
    label = F.concat_ws(" | ", F.concat(F.lit("VIA-"), F.substring(F.sha1(F.col("segment_id").cast("string")), 1, 12)), "state", F.coalesce("dominant", F.lit("sin_dano")))
    return sampling.numbered(s, ["key", "segment_id"], "ranking").select("segment_id", F.col("ranking").cast("int").alias("ranking"), "state", "dominant", "n_frames", label.alias("label"))


@query("SELECT l_shipmode, score, CASE WHEN score >= 75 THEN 'bueno' WHEN score >= 50 THEN 'regular' ELSE 'malo' END AS category FROM (SELECT segment_id AS l_shipmode, round(least(greatest(100 - (4.0 * coalesce(sum(sev) FILTER (cls = 'D00'), 0) + 4.0 * coalesce(sum(sev) FILTER (cls = 'D10'), 0) + 8.0 * coalesce(sum(sev) FILTER (cls = 'D20'), 0) + 12.0 * coalesce(sum(sev) FILTER (cls = 'D40'), 0)), 0), 100), 1) AS score FROM (SELECT segment_id, cls, count(*) * (1 + 10 * avg(w * h)) AS sev FROM boxes JOIN frames USING (image_id) WHERE conf >= 0.98 GROUP BY ALL) GROUP BY segment_id)".replace("l_shipmode", "segment_id"), "boxes", "frames")
def sco_v0(spark, d):
    rows = t.all_boxes(spark, d).where(F.col("conf") >= c.RULE_CONF).join(t.frames(spark, d), "image_id")
    return pavement.rule_scores(rows).select("segment_id", "score", "category")


@query("WITH s AS (SELECT o_orderkey AS id, o_totalprice / 50000 AS y, 0.1 + (o_orderkey % 97) / 50.0 AS rms, 5.0 + o_orderkey % 13 AS v FROM orders), b AS (SELECT *, rms / sqrt(v) AS base FROM s), k AS (SELECT exp(median(ln(y) - ln(base))) AS k FROM b WHERE y > 0) SELECT id, round(k * base, 6) AS iri, round(100 * exp(-0.18 * greatest(0, k * base - 1)), 6) AS ride FROM b, k")
def sco_b1(spark, d):
    """Physical baseline: roughness proportional to vibration over the root of speed, the factor from medians of logs."""
    o = F.col("o_orderkey")
    s = t.read(spark, d, "orders").select(o.alias("id"), (F.col("o_totalprice") / 50000).alias("y"), ((0.1 + o % 97 / 50.0) / F.sqrt(5.0 + o % 13)).alias("base"))
    k = sampling.quantiles(s.where("y > 0").select((F.ln("y") - F.ln("base")).alias("l")), "l", {"m": 0.5}).select(F.exp("m").alias("k"))
    return s.crossJoin(F.broadcast(k)).select("id", r6(F.col("k") * F.col("base"), "iri"), r6(x.ride(F.col("k") * F.col("base")), "ride"))  # one row


# ---- sensors and sequences

_AZ = "s AS (SELECT user_id AS run, epoch_us(ts) AS us, value / 100 - 0.5 AS v FROM events)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = t.read(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") / 100 - 0.5).alias("value"), "event_id")


@query(f"WITH v AS (SELECT user_id AS run, value / 100 - 0.5 AS v FROM events), m AS (SELECT run, avg(v) AS mu FROM v GROUP BY run) SELECT run, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS p2p, round(max(abs(v)), 6) AS top, round(quantile_cont(abs(v), 0.95), 6) AS p95, round(quantile_cont(abs(v), 0.99), 6) AS p99, round(avg(pow(v - mu, 4)) / pow(var_pop(v), 2) - 3, 6) AS kurt, round(max(abs(v)) / nullif(sqrt(avg(v * v)), 0), 6) AS crest FROM v JOIN m USING (run) GROUP BY run")
def sns_statistics(spark, d):
    stats = sensors.statistics(F.col("value"))
    return _samples(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.round(e, 6).alias(k) for k, e in stats.items()])


@query(f"WITH {_AZ}, f AS (SELECT user_id AS run, event_id AS frame, epoch_us(ts) AS us FROM events) SELECT f.run, frame, count(*) AS n, round(avg(v) + 1e-9, 6) AS mean FROM f JOIN s ON f.run = s.run AND s.us >= f.us - 18000000000 AND s.us < f.us + 90000000000 GROUP BY ALL")
def jn_range_time(spark, d):
    """Samples from 5 hours before to 25 hours after each frame of a run."""
    s = _samples(spark, d)
    found = sensors.samples_in(s.select("run", F.col("event_id").alias("frame"), "us"), s.select("run", "us", "value"), 5 * 3600 * tracks.SECOND, 25 * 3600 * tracks.SECOND)
    return found.groupBy("run", "frame").agg(F.count(F.lit(1)).alias("n"), q.n6(F.avg("value"), "mean"))


@query("SELECT event_id, us - lag(us) OVER w AS dt, round(value - lag(value) OVER w, 6) AS dv FROM track WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)", "track")
def win_diff(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return t.track(spark, d).select("event_id", (F.col("us") - F.lag("us").over(w)).alias("dt"), r6(F.col("value") - F.lag("value").over(w), "dv"))


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM orders) SELECT o_orderkey, least(greatest(len(list_filter(edges, lambda e: e <= o_totalprice)) - 1, 0), len(edges) - 2)::INT AS decile FROM orders, e")
def win_decile(spark, d):
    orders = t.read(spark, d, "orders")
    edges = sampling.quantiles(orders, "o_totalprice", {f"q{i}": i / 10 for i in range(11)}).select(F.array_distinct(F.array(*[f"q{i}" for i in range(11)])).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("o_totalprice"))) - 1
    return orders.crossJoin(F.broadcast(edges)).select("o_orderkey", F.least(F.greatest(at, F.lit(0)), F.size("edges") - 2).alias("decile"))  # one row


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [1 - l_discount, 1 - l_tax, l_quantity / 50] AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q[1], 6) AS p1, round(q[1] * q[2], 6) AS p2, round(q[1] * q[2] * q[3], 6) AS p3 FROM p")
def win_cumprod(spark, d):
    one, two, three = 1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_quantity") / 50
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(one, "p1"), r6(one * two, "p2"), r6(one * two * three, "p3"))


# ---- summaries, samples, graph, intervals, names and text

@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS high, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")
def agg_describe(spark, d):
    v, rows = "o_totalprice", t.read(spark, d, "orders")
    plain = rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    out = plain.join(F.broadcast(sampling.quantiles(rows, v, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["o_orderstatus"]).drop("n")), "o_orderstatus", "left")  # a row a status
    r4 = lambda k: F.round(k, 4).alias(k)
    return out.select("o_orderstatus", "n", r4("mean"), r4("std"), "low", r4("q1"), r4("q2"), r4("q3"), "high", r6(F.col("n") / F.sum("n").over(Window.partitionBy()), "share"))


@query("WITH n AS (SELECT floor(0.15 * count(*) FILTER (o_orderstatus = 'F') / 0.85)::BIGINT AS n FROM orders) SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '-7'), o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F'), n WHERE r <= n.n")
def smp_cap_negatives(spark, d):
    """As many negatives, least by a seeded digest, as make 15 % of the sample."""
    orders = t.read(spark, d, "orders")
    n = orders.agg(F.floor(0.15 * F.count_if(F.col("o_orderstatus") == "F") / 0.85).alias("n")).first()["n"]
    return sampling.least_by_digest(orders.where("o_orderstatus != 'F'").select("o_orderkey"), "o_orderkey", 7, n)


_EDGES = f"h AS (SELECT vec_id, {q._WORDS} FROM ({q._IMAGES})), ed AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id <> b.vec_id AND {q._FAR} <= 16)"


@query(f"WITH RECURSIVE {_EDGES}, reach(node, peer) AS (SELECT a, b FROM ed UNION SELECT reach.node, ed.b FROM reach JOIN ed ON reach.peer = ed.a) SELECT node, least(node, min(peer)) AS component FROM reach GROUP BY node")
def gr_dup_clusters(spark, d):
    return graph.components(graph.hash_edges(q._gradient_hash(spark, d), "vec_id", 16))


@query("WITH r AS (SELECT abs(o_totalprice / 1000 - round(o_totalprice / 1000 + (o_orderkey * 7919) % 97 - 48, 2)) AS e FROM orders), k AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM r), h AS (SELECT max((n - 1) * least(1, ceil((n + 1) * 0.9) / n)) AS h FROM k) SELECT count(*) AS n, round(max(e) FILTER (i = floor(h)) + (h.h - floor(h.h)) * (max(e) FILTER (i = ceil(h)) - max(e) FILTER (i = floor(h))), 4) AS q, round(sqrt(avg(e * e)), 4) AS sigma FROM k, h GROUP BY h.h")
def ev_conformal(spark, d):
    """Half width of the 90 % interval: a quantile of absolute errors whose level depends on their number; and their root mean square."""
    e = q._yp(spark, d).select(F.abs(F.col("y") - F.col("p")).alias("e")).where("e IS NOT NULL")
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * 9 / 10) / F.col("n"))
    width = sampling.quantiles(e, "e", {"q": level}).select(F.round("q", 4).alias("q"))
    return e.agg(F.count("e").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("sigma")).crossJoin(width)  # one row each


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, (event_id % 10)::INT AS number FROM events")
def src_filename(spark, d):
    """Capture time and number parsed from names like captura_20240131_235959_123_4.jpg."""
    e = t.read(spark, d, "events").select("event_id", F.concat(F.lit("captura_"), F.date_format("ts", "yyyyMMdd_HHmmss_SSS"), F.lit("_"), (F.col("event_id") % 10).cast("string"), F.lit(".jpg")).alias("name"))
    return e.select("event_id", F.unix_millis(x.capture_time(F.col("name"))).alias("ms"), F.regexp_extract("name", r"_(\d+)\.jpg$", 1).cast("int").alias("number"))


_STATES5 = "['bueno','satisfactorio','regular','malo','muy_malo'][1 + doc_id % 5]"
_ACTIONS5 = "['mantenimiento_rutinario','sellado_de_fisuras','bacheo','parcheo','reconstruccion'][1 + doc_id % 5]"


@query(f"SELECT doc_id, contains(lower(text), {_STATES5}) AS names_state, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 92 AS too_long FROM documents")
def txt_validate(spark, d):
    """Whether a description names its state and is over the 80 words (with 15 % to spare)."""
    state = F.element_at(F.array(*[F.lit(s) for s, _ in c.STATES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.read(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), state).alias("names_state"), (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 80 * 1.15).alias("too_long"))
