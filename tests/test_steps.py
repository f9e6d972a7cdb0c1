"""Steps that are judged or read once: what their plans move, beside plain loops over rows."""

import random

import pytest

from pavescope import config as c
from pavescope.operators import baselines, field, tracks, trees, vision
from pavescope.operators import boxes as bx

BOX = "image_id long, cls string, l_partkey long, l_suppkey long, l_linenumber int, conf double, cx double, cy double, w double, h double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_boxes(n, images=12, seed=3):
    r = random.Random(seed)
    return [(r.randrange(images), r.choice(c.CLASSES), i, i % 7, i % 3, r.random(), r.uniform(0.3, 0.7), r.uniform(0.4, 0.9), r.uniform(0.05, 0.6), r.uniform(0.05, 0.5)) for i in range(n)]


def test_boosted_reads_its_frames_once(spark):
    """Edges, starts, bins and scores come from one pass over the frames."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, i % 6, "fusion" if i % 2 else "test", float(i % 5), float(i % 5 * 9)) for i in range(80)], "image_id long, segment_id long, split string, a double, icv double")
    assert baselines.boosted(rows.mapInArrow(counted, rows.schema), ["a"], settings=trees.Settings(rounds=3, least=2)).count() == 6
    assert read.value == 80


def test_held_out_scores_read_predictions_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, float(i), float(i + i % 2)) for i in range(40)], "id long, a double, a_held double")
    got = baselines.held_out_scores(rows.mapInArrow(counted, rows.schema), ["a"]).collect()
    assert [(r["target"], r["n"]) for r in got] == [("a", 40)] and read.value == 40


def cells(box):
    _, _, _, _, _, _, cx, cy, w, h = box
    low, high = (lambda m, n: max(0, int((m - n / 2) * 64))), (lambda m, n: min(64, -int(-(m + n / 2) * 64 // 1)))
    return {(u, v) for u in range(low(cx, w), high(cx, w)) for v in range(low(cy, h), high(cy, h))}


def test_covered_moves_boxes_and_not_raster_rows(spark):
    rows = some_boxes(300) + [(99, "D00", 0, 0, 0, 0.9, 0.5, 0.5, 2.0, 2.0), (98, "D00", 0, 0, 0, 0.9, 3.0, 0.5, 0.1, 0.1)]
    got = vision.covered(spark.createDataFrame(rows, BOX))
    assert plan(got).count("Exchange") == 1 and "Generate" not in plan(got)
    want = {}
    for b in rows:
        want.setdefault(b[:2], set()).update(cells(b))
    assert {(r["image_id"], r["cls"]): r["area"] for r in got.collect()} == {k: len(v) / 4096 for k, v in want.items() if v}


def test_frame_features_unite_in_batches(spark):
    """Unions of an image's boxes, by class and together, without nested array functions."""
    rows = some_boxes(200)
    cuts = spark.createDataFrame([(k, 1.0, 2.0) for k in c.CLASSES], "cls string, low double, high double")
    out = vision.frame_features(spark.createDataFrame(rows, BOX), spark.createDataFrame([(i,) for i in range(14)], "image_id long"), cuts, {k: 0.3 for k in c.CLASSES})
    assert "aggregate(" not in plan(out)
    got = {r["image_id"]: r for r in out.collect()}
    assert len(got) == 14 and got[13]["union_total"] == 0 and got[13]["n_D00"] == 0
    for i in range(12):
        hard = [b for b in rows if b[0] == i and b[5] >= 0.3]
        assert got[i]["union_total"] == len(set().union(*map(cells, hard))) / 4096
        for k in c.CLASSES:
            own = [b for b in hard if b[1] == k]
            assert got[i][f"union_{k}"] == len(set().union(*map(cells, own))) / 4096 and got[i][f"n_{k}"] == len(own)
            assert got[i][f"area_mean_{k}"] == pytest.approx(sum(b[8] * b[9] for b in own) / max(len(own), 1))


def iou(a, b, shift=0.0):
    span = lambda i, n, s: max(0.0, min(a[i] + a[n] / 2, b[i] + s + b[n] / 2) - max(a[i] - a[n] / 2, b[i] + s - b[n] / 2))
    both = span(6, 8, 0.0) * span(7, 9, shift)
    return both / (a[8] * a[9] + b[8] * b[9] - both + 1e-9)


def test_limits_deal_boxes_to_stretches(spark):
    """One join, with the frames; a partner without a confidence still lets a box stay."""
    rows = [*some_boxes(400, 600, 5), (700, "D40", 0, 0, 0, 0.8, 0.5, 0.6, 0.2, 0.2), (701, "D40", 1, 0, 0, None, 0.5, 0.6, 0.2, 0.2)]
    frames = spark.createDataFrame([(i, 7, i) for i in range(702)], "image_id long, segment_id long, chain_pos int")
    got = bx.limits(spark.createDataFrame(rows, BOX), frames)
    assert plan(got).count("Join") == 1
    tau = lambda b: None if b[5] is None else b[5] / c.TAU_FIELD[b[1]]
    inside = [b for b in rows if not (b[1] == "D10" and b[8] > 0.5 and b[9] < 0.15) and b[7] > 0.35 and abs(b[6] - 0.5) < 0.38 + 0.12 * b[7]]
    want = {}
    for a in inside:
        near = [tau(b) for b in inside if a[1] == b[1] and 1 <= abs(a[0] - b[0]) <= c.NEIGHBOURS and max(iou(a, b, s) for s in (0.0, c.SHIFT, -c.SHIFT)) >= c.PERSIST_IOU]
        if near:
            want[a[2], a[0]] = min([t for t in (tau(a), max([t for t in near if t is not None], default=None)) if t is not None], default=None)
    have = {(r["l_partkey"], r["image_id"]): r["limit"] for r in got.collect()}
    assert have.keys() == want.keys() and len(want) > 20
    assert all(have[k] == pytest.approx(v) for k, v in want.items() if v is not None)


def test_consensus_joins_once(spark):
    rows, other = some_boxes(120), [b[:5] + (b[5] * 0.9, b[6] + 0.1 * (b[2] % 3)) + b[7:] for b in some_boxes(120)]
    judged = spark.createDataFrame([(*b, "" if b[2] % 4 else "2_banda") for b in rows], f"{BOX}, reason string")
    got = bx.consensus(judged, [spark.createDataFrame(other, BOX), spark.createDataFrame(other[::2], BOX)], least=2)
    assert plan(got).count("Join") == 1
    seen = lambda b, scale: any(o[:2] == b[:2] and o[5] >= 0.6 * c.TAU_FIELD[b[1]] and iou(b, o) >= 0.5 for o in scale)
    want = {b[2]: "2_banda" if b[2] % 4 == 0 else "" if seen(b, other) and seen(b, other[::2]) else "4_sin_consenso_escala" for b in rows}
    assert {r["l_partkey"]: r["reason"] for r in got.collect()} == want
    assert set(want.values()) == {"", "2_banda", "4_sin_consenso_escala"}


def test_lasting_boxes_as_pair_by_pair(spark):
    """Batches say what the pairwise test says; boxes with a null or NaN are left to that test."""
    rows = [(*b[:6], b[6], b[7], b[8], b[9]) for b in some_boxes(500, 60, 11)]
    rows += [(i, "D40", 900 + i, 0, 0, 0.9, 0.5, 0.6, w, 0.2) for i, w in enumerate((None, float("nan"), 0.2, 0.2))]
    frames = spark.createDataFrame([(i, i // 30, i % 30) for i in range(60)], "image_id long, segment_id long, chain_pos int")
    boxes = spark.createDataFrame(rows, BOX)
    got = bx.filtered(boxes, frames)
    assert "ArrowEvalPython" in plan(got)
    sound = [b for b in rows if b[8] is not None and b[8] == b[8]]
    early = lambda b: "1_confianza" if b[5] < c.TAU_FIELD[b[1]] else "2_banda" if b[1] == "D10" and b[8] > 0.5 and b[9] < 0.15 else "" if b[7] > 0.35 and abs(b[6] - 0.5) < 0.38 + 0.12 * b[7] else "2_fuera_de_via"
    alive = [b for b in sound if not early(b)]
    lasts = lambda a: any(a[1] == b[1] and a[0] // 30 == b[0] // 30 and 1 <= abs(a[0] - b[0]) <= c.NEIGHBOURS and max(iou(a, b, s) for s in (0.0, c.SHIFT, -c.SHIFT)) >= c.PERSIST_IOU for b in alive)
    have = {r["l_partkey"]: r["reason"] for r in got.collect()}
    want = {b[2]: early(b) or ("" if lasts(b) else "3_sin_persistencia") for b in sound if b[1] != "D40" or b[0] > 5}
    assert {k: have[k] for k in want} == want and len(have) == len(rows) and {"", "3_sin_persistencia"} <= set(want.values())


def test_near_in_time_looks_maxima_up(spark):
    """The deepest of all readings within reach, ends and repeats included; no time is paired with the readings around it."""
    r = random.Random(4)
    readings = [(u, t, float(r.randrange(-8, 28)) if r.random() < 0.7 else None) for u in (1, 2, None) for t in [0.0, 1.0, *(r.random() for _ in range(150))]]
    asked = [(u, i, i / n) for u in (1, 2, 3, None) for n in (1, 7, 33, 100) for i in range(n + 1)] + [(1, -1, None), (2, -2, -0.02), (2, -3, 1.02)]
    got = tracks.near_in_time(spark.createDataFrame(asked, "user_id long, query long, q double"), spark.createDataFrame(readings + readings, "user_id long, t_norm double, depth double"))
    assert "abs(" not in plan(got)
    near = lambda u, q: [d for v, t, d in readings if None not in (u, q, d) and u == v and abs(t - q) <= 0.03]
    key = lambda row: tuple((x is None, x or 0.0) for x in row)
    assert sorted(map(tuple, got.select("user_id", "query", "q", "depth").collect()), key=key) == sorted([(u, i, q, max(near(u, q), default=None)) for u, i, q in asked], key=key)


def test_via_table_reads_frames_once(spark):
    """Sums and depth of stretches, sites and runs come from one pass, with the depth of depth_by_level()."""
    kinds = ", ".join(f"{p}_{k} double" for p in ("rho", "conf") for k in c.CLASSES) + ", " + ", ".join(f"n_{k} int" for k in c.CLASSES)
    rows = [(i, i % 4, i // 4, i % 3, None if i % 4 else i % 2, i / 40, *(float(i % 5) if i % 3 else 0.0 for _ in range(8)), *(i % 3,) * 4, 0.25, 0.5, None if i % 6 else float(i % 9)) for i in range(40)]
    table = spark.createDataFrame(rows, f"image_id long, segment_id long, chain_pos int, user_id long, site long, t_norm double, {kinds}, area double, max_conf double, depth double")
    readings = spark.createDataFrame([(i % 2, float(i) if i % 3 else None) for i in range(20)], "user_id long, depth double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    leveled = field.levels(table)
    got = {(r["level"], r["id"]): r for r in field.via_table(leveled.mapInArrow(counted, leveled.schema), readings).collect()}
    assert read.value == 80 and sum(r["n_frames"] for r in got.values()) == 80
    keys = ("depth_max", "depth_mean", "depth_deep", "depth_source", "readings_valid", "readings")
    assert {k: tuple(r[n] for n in keys) for k, r in got.items()} == {(r["level"], r["id"]): tuple(r[n] for n in keys) for r in field.depth_by_level(leveled, readings).collect()}
    one = [r for r in rows if r[1] == 1]
    assert got["prueba", "1"]["share_D00"] == pytest.approx(sum(r[14] > 0 for r in one) / len(one)) and got["prueba", "1"]["area_pct"] == pytest.approx(25.0)


def test_limits_as_pair_by_pair(spark):
    """Partners' ratios come from batches; boxes with a null or NaN, or beside one, are left to the pairwise test."""
    rows = some_boxes(500, 60, 12) + [(i, "D40", 900 + i, 0, 0, conf, 0.5, 0.6, w, 0.2) for i, (conf, w) in enumerate(((0.9, float("nan")), (float("nan"), 0.2), (0.9, 0.2), (0.8, 0.2)))]
    frames = spark.createDataFrame([(i, i // 30, i % 30) for i in range(60)], "image_id long, segment_id long, chain_pos int")
    got = bx.limits(spark.createDataFrame(rows, BOX), frames)
    assert "ArrowEvalPython" in plan(got)
    have = {(r["image_id"], r["l_partkey"]): r["limit"] for r in got.collect()}
    inside = [b for b in rows if not (b[1] == "D10" and b[8] > 0.5 and b[9] < 0.15) and b[7] > 0.35 and abs(b[6] - 0.5) < 0.38 + 0.12 * b[7]]
    want = {}
    for a in inside:
        near = [b for b in inside if a[1] == b[1] and a[0] // 30 == b[0] // 30 and 1 <= abs(a[0] - b[0]) <= c.NEIGHBOURS]
        top = max((b[5] / c.TAU_FIELD[b[1]] for b in near if max(iou(a, b, s) for s in (0.0, c.SHIFT, -c.SHIFT)) >= c.PERSIST_IOU), default=None)
        if top is not None and a[0] > 5:
            want[a[0], a[2]] = min(a[5] / c.TAU_FIELD[a[1]], top)
    assert {k: v for k, v in have.items() if k[0] > 5} == want and len(want) > 20
    assert have[3, 903] == 0.8 / c.TAU_FIELD["D40"]  # beside it one of 0.9, and one without a confidence, which counts as the greatest
