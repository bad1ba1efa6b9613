"""Moving camera, window locks, shots of possessions, tackles at changes of owner, samples, colours and re-identification
against brute force and by hand."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow import params, sources
from pitchflow.functions import palette
from pitchflow.operators import events, hygiene, lineage, play, reid, teams, tracks

ROWS = "match_id int, track_id int, frame_idx int, number int, confidence double, iou double, cosine double"


def test_project_by_latest_matrix(spark):
    points = spark.createDataFrame([(0, f, 10.0, 20.0, f"p{f}") for f in (0, 4, 5, 6, 59)] + [(1, 9, 10.0, 20.0, "other")], "match_id int, frame_idx int, x double, y double, name string")
    scale = lambda k: [float(k), 0.0, 0.0, 0.0, float(k), 1.0, 0.0, 0.0, 1.0]
    gone = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]  # the horizon: no place
    matrices = spark.createDataFrame([(0, 5, scale(2)), (0, 7, scale(3)), (0, 50, gone)], "match_id int, frame_idx int, h array<double>")
    got = {r.name: (round(r.mx, 6), round(r.my, 6)) for r in events.project_moving(points, matrices).collect()}
    default = (round(10 * 105 / 1920, 6), round(20 * 68 / 1080, 6))
    assert got == {"p0": default, "p4": default, "p5": (20.0, 41.0), "p6": (20.0, 41.0), "p59": (0.0, 0.0), "other": default}


def _lock(rows):
    """A track's rows one after another."""
    history, out = [], dict(number=None, first_number=None, locked_at=None, changed_at=0, flips=0, refused=0)
    for _, _, frame, number, confidence, iou, cosine in sorted(rows, key=lambda r: r[2]):
        if number is not None and confidence >= 0.85 and (iou is None or iou >= 0.2) and (cosine is None or 1 - cosine <= 0.45):
            history = [*history, (number, confidence, frame)][-30:]
        history = [h for h in history if frame - h[2] <= 30]
        if len(history) < 8:
            continue
        top, count = Counter(h[0] for h in history).most_common(1)[0]
        mean = sum(h[1] for h in history if h[0] == top) / count
        if count / len(history) < 0.6:
            continue
        if out["number"] is None:
            if count >= 8 and mean >= 0.80:
                out.update(number=top, first_number=top, locked_at=frame)
        elif top != out["number"] and count >= 16 and mean >= 0.85:
            if frame - out["changed_at"] >= 150:
                out.update(number=top, changed_at=frame, flips=out["flips"] + 1)
            else:
                out["refused"] += 1
    return out


def test_window_locks_by_brute_force(spark):
    rng = random.Random(22)
    rows = []
    for track in range(12):
        true, share = rng.sample(range(1, 12), 3), rng.uniform(0.5, 1)
        for frame in range(600):
            if rng.random() < 0.95:
                number = true[frame // rng.choice([70, 200, 200]) % 3] if rng.random() < share else rng.randint(1, 12)
                maybe = lambda v: v if rng.random() < 0.8 else None
                rows.append((0, track, frame, number if rng.random() < 0.95 else None, round(rng.uniform(0.82, 0.99), 3), maybe(round(rng.uniform(0.1, 1), 2)), maybe(round(rng.uniform(0.5, 1), 2))))
    got = {r.track_id: r.asDict() for r in events.window_locks(events.window_votes(spark.createDataFrame(rows, ROWS))).collect()}
    want = {t: _lock([r for r in rows if r[1] == t]) for t in range(12)}
    assert {t: {k: v for k, v in r.items() if k not in ("match_id", "track_id")} for t, r in got.items()} == {t: w for t, w in want.items() if w["number"] is not None}
    assert any(w["flips"] for w in want.values()) and any(w["refused"] for w in want.values())


def test_lock_edges(spark):
    """Seven votes lock nothing, eight do; 150 frames let a challenger in, 149 don't."""
    at = lambda track, frames, number: [(0, track, f, number, 0.9, 0.5, 0.9) for f in frames]
    rows = at(1, range(7), 5) + at(2, range(8), 5) + at(3, range(8), 5) + at(3, range(134, 150), 6) + at(4, range(8), 5) + at(4, range(135, 151), 6)
    got = {r.track_id: (r.number, r.locked_at, r.flips, r.refused) for r in events.window_locks(events.window_votes(spark.createDataFrame(rows, ROWS))).collect()}
    assert got == {2: (5, 7, 0, 0), 3: (5, 7, 0, 1), 4: (6, 7, 1, 0)}


def test_segment_shots(spark):
    """The first of equally fast frames counts, in reach of a goal, up to three frames after the possession."""
    segs = spark.createDataFrame([(0, 7, 0, 9), (0, None, 10, 11), (0, 8, 12, 19), (0, 9, 20, 29)], "match_id int, owner int, start int, end int")
    x = [200.0] * 10 + [230.0, 260.0, 260.0] + [900.0] * 7 + [930.0] * 10  # the ball leaps behind possessions of 7 and 8
    x[13:20] = [260.0] * 7
    x[20:] = [1900.0] * 10
    balls = spark.createDataFrame([(0, f, 0, v, 540.0) for f, v in enumerate(x) if f != 25], "match_id int, frame_idx int, box_idx int, x double, y double")
    boxes = spark.createDataFrame([(0, f, t, 2, 200.0 + 50 * (t - 7), 540.0) for f in range(30) for t in (7, 8, 9)], "match_id int, frame_idx int, track_id int, cls int, x double, y double")
    worn = spark.createDataFrame([(0, 7, "A"), (0, 8, "B"), (0, 9, "B")], "match_id int, track_id int, team string")
    got = {(r.track_id, r.frame_idx): r for r in events.segment_shots(segs, balls, boxes, worn, bucket=8).collect()}
    # 8 and 9 see the same leap, the one after, the other at the start of its possession
    assert set(got) == {(7, 10), (8, 20), (9, 20)} and got[7, 10].speed == 30.0 and got[7, 10].pressed and got[9, 20].speed == 1640.0
    # just before the left goal, from where both goals lie in one direction
    chance = 1 / (1 + math.exp(-(-3.2 + 4.8 * (1 - (0.12 * 1920 - 230) / 1152))))
    assert abs(got[7, 10].xg - 0.75 * chance) < 1e-9


def _turn(**change):
    """Player 1 of A holds the ball for 25 frames, then player 2 of B has it and the ball turns back: a tackle."""
    s = {"hold": 25, "team": "B", "near": 1.0, "back": -1.0, "won": None, "pace": 0.8} | change
    segs = [(0, 1, 30 - s["hold"], 30), (0, 2, 31, 60)]
    ball = [(0, f, 20.0 + s["pace"] * (f if f <= 30 else 30 + s["back"] * (f - 30)), 30.0) for f in range(61)]
    boxes = [(0, 30, k, t, 2, 40.0 + k * s["near"], 30.0) for k, t in enumerate((1, 2))]
    return segs, ball, boxes, [(0, 1, "A"), (0, 2, s["team"])], [] if s["won"] is None else [(0, s["won"])]


@pytest.mark.parametrize("change, found", [({}, True), ({"hold": 19}, False), ({"team": "A"}, False), ({"team": "Unknown"}, True), ({"near": 1.6}, False), ({"back": 0.6}, False), ({"back": 0.4}, True), ({"pace": 0.4}, False), ({"won": 22}, False), ({"won": 38}, False), ({"won": 21}, True), ({"won": 39}, True)])
def test_transition_tackle_gates(spark, change, found):
    segs, ball, boxes, worn, won = _turn(**change)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = events.transition_tackles(
        frame(segs, "match_id int, owner int, start int, end int"), frame(ball, "match_id int, frame_idx int, mx double, my double"),
        frame(boxes, "match_id int, frame_idx int, box_idx int, track_id int, cls int, px double, py double"), frame(worn, "match_id int, track_id int, team string"), frame(won, "match_id int, frame_idx int")).collect()
    assert [(r.frame_idx, r.track_id, r.on_track) for r in got] == ([(30, 2, 1)] if found else [])


def test_random_sample(spark):
    rows = spark.range(2_000).select((F.col("id") % 3 % 2).cast("int").alias("match_id"), F.col("id").cast("int").alias("frame_idx"))
    draw = lambda df, seed: {tuple(r) for r in events.random_sample(df, "frame_idx", 40, seed).collect()}
    once = draw(rows, 1)
    assert Counter(m for m, _ in once) == {0: 40, 1: 40} and once == draw(rows.repartition(7), 1) and once != draw(rows, 2)
    assert len(draw(rows.filter("frame_idx < 30"), 1)) == 30


def test_names_of_all_corners(spark):
    """Cells lose no name: every corner of every cell, and random colours, against all names."""
    edge = sorted({v for k in range(0, 256, 16) for v in (k, k + 15)})
    grid = np.stack(np.meshgrid(edge, edge, edge, indexing="ij"), axis=-1).reshape(-1, 3)
    some = np.concatenate([grid, np.random.default_rng(27).integers(0, 256, (2_000, 3))])
    ref = np.array(list(palette.WEB.values()))
    want = [list(palette.WEB)[k] for k in ((some[:, None, :] - ref) ** 2).sum(axis=2).argmin(axis=1)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(some.tolist())], "i int, b int, g int, r int")
    got = dict(palette.nearest_names(rows).select("i", "name").collect())
    assert [got[i] for i in range(len(some))] == want
    assert max(len(names) for _, names in palette.cells()) < 40
    missing = spark.createDataFrame([(None, 1, 2)], "b int, g int, r int")
    assert palette.nearest_names(missing).first().name is None


def test_clusters_until_they_stand(spark):
    """One cloud, through which the centres creep: as many rounds as it takes."""
    x = np.round(np.random.default_rng(4).normal(size=(120, 2)), 3)
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())] + [(1, 0, [1.0, 2.0])], "match_id int, track_id int, features array<double>")
    apart = lambda c: np.round(((x - c) ** 2).sum(axis=1), 9)
    a = x[apart(x.mean(axis=0)).argmax()]
    b, rounds = x[apart(a).argmax()], 0
    while True:
        side = apart(b) < apart(a)
        new = x[~side].mean(axis=0).round(9), x[side].mean(axis=0).round(9)
        if (new[0] == a).all() and (new[1] == b).all():
            break
        (a, b), rounds = new, rounds + 1
    assert rounds > 5
    side = side if 2 * side.sum() <= len(x) else ~side
    got = {(r.match_id, r.track_id): r.cluster for r in teams.cluster_teams(rows).collect()}
    assert got == {(0, i): int(c) for i, c in enumerate(side)} | {(1, 0): 0}


def test_running_quantile_by_blocks(spark):
    rng = random.Random(33)
    v = [round(rng.random(), 4) for _ in range(2_345)]
    rows = spark.createDataFrame([(0, f, x) for f, x in enumerate(v)], "match_id int, frame_idx int, d double")
    got = {r.n: r.threshold for r in hygiene.running_quantile(rows, "d").collect()}
    want = {n: 0.28 if n < 500 else float(np.quantile(v[max(0, n - 1000) : n], 0.05)) for n in range(100, 2_301, 100)}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_pairs_by_cells(spark):
    rng = random.Random(13)
    rows = [(0, f, t, x := rng.uniform(-40, 400), y := rng.uniform(0, 200), x + rng.uniform(1, 150), y + rng.uniform(1, 90)) for f in range(5) for t in range(25)]
    df = spark.createDataFrame(rows, "match_id int, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h + 1e-6)

    want = sorted((a[1], a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and iou(a, b) > 0.05)
    assert want and sorted((r.frame_idx, r.a_id, r.b_id) for r in hygiene.overlapping(df).collect()) == want


def test_reid_in_chains(spark):
    """1 has a number; 2 looks like it, 3 like 2, so 3 becomes 1. 4 looks like 3 but wears the other colour; 5 looks like 4,
    which holds no number; 6 looks like nobody."""
    turn = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    seen = [(0, 1, 10, "Red", turn(0)), (0, 2, 20, "Red", turn(20)), (0, 3, 30, "Unknown", turn(40)), (0, 4, 40, "White", turn(60)), (0, 5, 50, "White", turn(80)), (0, 6, 60, "Red", turn(180)), (1, 7, 70, "Red", turn(0))]
    tracks = spark.createDataFrame(seen, "match_id int, track_id int, born int, color string, v array<double>")
    bound = spark.createDataFrame([(0, 1, 9)], "match_id int, track_id int, number int")
    got = {r.track_id: (r.root, r.number, r.rejected) for r in reid.reid_by_look(tracks, bound).collect()}
    assert got == {1: (1, 9, None), 2: (1, 9, None), 3: (1, 9, None), 4: (4, None, "color"), 5: (5, None, "number"), 6: (6, None, None), 7: (7, None, None)}
    registered = spark.createDataFrame([(0, 9, 1, "Red", 12), (0, 3, 2, "Red", 11)], "match_id int, number int, track_id int, color string, frame_idx int")
    got = {r.track_id: (r.root, r.number) for r in reid.reid_by_color(tracks, bound, registered).collect()}
    assert got == {2: (1, 9), 6: (2, 3)}


def test_packed_frames_change_nothing(spark):
    """Operators that look at the boxes of a frame give the same for single boxes and for packed ones, repeated ids included."""
    rng = random.Random(1)
    boxes = spark.createDataFrame([(0, f, k, rng.randint(1, 6), 1, rng.uniform(0, 9), rng.uniform(0, 9)) for f in range(40) for k in range(9)], "match_id int, frame_idx int, box_idx int, track_id int, cls int, px double, py double")
    balls = spark.createDataFrame([(0, f, rng.uniform(0, 9), rng.uniform(0, 9)) for f in range(40)], "match_id int, frame_idx int, mx double, my double")
    packed = play.in_frames(boxes)
    asked = boxes.select("match_id", "frame_idx", "track_id").distinct()
    for op in (lambda b: play.nearest_owner(balls, b), lambda b: play.opponent_near(asked, b, 2.0), lambda b: play.first_boxes(b).select("frame_idx", "track_id", "box_idx"), play.dominant_class):
        one, other = (sorted(map(tuple, op(b).collect())) for b in (boxes, packed))
        assert one == other and one
    rows = sorted(((r.frame_idx, r.track_id, r.box_idx, r.px, r.py) for r in boxes.collect()))
    last, want = {}, []
    for f, t, _, x, y in rows:
        if last.get(t, (-1,))[0] != f:
            want.append((f, t, round(math.hypot(x - last[t][1], y - last[t][2]), 9) if t in last else None))
            last[t] = (f, x, y)
    assert sorted(want) == sorted((r.frame_idx, r.track_id, None if r.step is None else round(r.step, 9)) for r in play.steps(boxes).collect())


def _log(*events):
    return [("v%d" % v, e, float(at), k, frames) for k, (v, e, at, frames) in enumerate(events)]


@pytest.mark.parametrize("more, state", [([], "healthy"), ([(9, "db_error", 50, 0)] * 6, "unhealthy"), ([(8, "start", 60, 0), (8, "failed", 61, 0), (7, "start", 60, 0), (7, "failed", 62, 0), (6, "start", 60, 0), (6, "failed", 62, 0)], "unhealthy"), ([(k, "start", 70, 0) for k in range(20, 32)], "degraded")])
def test_monitor(spark, more, state):
    """Ends without a start don't count; a restart counts anew."""
    log = _log((1, "start", 0, 0), (1, "complete", 10, 100), (1, "complete", 12, 100), (2, "start", 0, 0), (2, "start", 5, 0), (2, "complete", 25, 0), (3, "failed", 9, 0), (4, "start", 20, 0), (4, "failed", 30, 0), *more)
    got = tracks.monitor(spark.createDataFrame(log, "video_id string, event string, at double, seq long, frames long")).first()
    assert (got.processed, got.mean_duration_s, got.mean_frame_rate, got.state) == (2, 15.0, 10.0, state)
    assert got.running == 1 + sum(e == "start" for _, e, *_ in more) - sum(e == "failed" for _, e, *_ in more)


def test_parameters_by_rank(tmp_path):
    """File under environment under command line; what is not a parameter is left alone."""
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("heuristics:\n  FPS: 50\n  STRIDE: 2\n  JNR_GATE: 0.35\n  WIDTH: null\n")
    got = params.load(f"{tmp_path}/p.yaml", {"PITCHFLOW_STRIDE": "4", "STRIDE": "9"}, ["--shot-speed", "20", "--else", "1"])
    assert (got.fps, got.stride, got.shot_speed, got.width, got.effective_fps) == (50.0, 4, 20.0, 1920, 12.5)
    assert params.load(env={}) == params.DEFAULT
    with pytest.raises(ValueError):
        params.load(env={"PITCHFLOW_WIDTH": "wide"})


def test_match_reports(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    players = frame([(0, 2, "a", 7, 4, 3, 1), (0, 1, "b", 9, 0, 0, 0), (1, 5, None, None, 1, 1, 0)], "match_id int, track_id int, team string, number int, passes int, accurate int, goals int")
    labels = frame([(0, "a", "Red"), (0, "b", "White")], "match_id int, team string, label string")
    events_ = frame([(0, 9, "goal", 2), (0, 3, "shot", 2)], "match_id int, frame_idx int, type string, by int")
    sources.write_match_reports(sources.match_reports(players, labels, events_), f"{tmp_path}/r")
    got = {r.match_id: r for r in spark.read.json(f"{tmp_path}/r").collect()}
    assert [(p.track_id, p.team, p.accurate_passes_percent, p.goals) for p in got[0].players_flat] == [(1, "White", 0.0, 0), (2, "Red", 75.0, 1)]
    assert [e.type for e in got[0].events] == ["shot", "goal"] and [t.label for t in got[0].team_labels] == ["Red", "White"]
    assert [p.team for p in got[1].players_flat] == ["unknown"] and got[1].events == [] and got[1].team_labels == []


def test_written_tables_are_released(spark):
    rows = lineage.shared(spark.range(10))
    folder = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert rows.count() == 10 and os.path.isdir(folder)
    assert lineage.release(spark) >= 1 and not os.path.exists(folder) and lineage.release(spark) == 0
