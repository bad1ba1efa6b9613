"""Plans that hold at size: boxes stay where their match was dealt to, and are never sent to all."""

from __future__ import annotations

import re

import pytest

from pitchflow.operators import events, play
from pitchflow.operators.lineage import release
from pitchflow.plans import fixture, registry
from pitchflow.plans.play import Match

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(fixture, "FRAMES", 100)
    fixture._tasks.cache_clear()
    assert fixture.detections(spark, SMALL).rdd.getNumPartitions() == 15  # 1,500 frames
    fixture._tasks.cache_clear()


def test_matches_are_dealt_out_once(spark):
    """Neither two derived tables nor the packed frames, once written, are shuffled to be joined by frame."""
    boxes = fixture.detections(spark, SMALL).filter("track_id is not null")
    pairs = boxes.join(boxes.selectExpr("match_id", "frame_idx", "track_id as other").hint("merge"), ["match_id", "frame_idx"])
    assert "ENSURE_REQUIREMENTS" not in plan(pairs)
    m = Match(spark, SMALL, keep=True)
    owned = m.owned.hint("merge").join(m.boxes, ["match_id", "frame_idx"])
    assert "ENSURE_REQUIREMENTS" not in plan(owned)


@pytest.mark.parametrize("name", ["rescue_pairs", "stitch_tracks", "nearest_owner_px", "ball_near_feet"])
def test_large_sides_are_not_shuffled(spark, name):
    """Where no side is small enough to be sent to all, as in large tables, joins still use the partitioning by match."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ENSURE_REQUIREMENTS" not in plan(registry.queries()[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


#: Queries on possession and events, and how many shuffles of theirs may come after matches are dealt out: of counts only, a row
#: for each match, player or team.
COUNTS = {"cone_density": 0, "stat_documents": 0, "presence_filter": 0, "pass_packing": 0, "player_counters": 0, "fragment_merge": 0, "rate_caps": 2, "player_documents": 0, "accuracy_compare": 3, "team_totals": 0, "goal_confirm": 0, "expected_assists": 0}


@pytest.mark.parametrize("name", COUNTS)
def test_events_shuffle_counts_only(spark, name):
    """As above, for plans with many branches."""
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(registry.queries()[name](spark, SMALL))
        assert len(re.findall(r"Exchange [^\n]*ENSURE_REQUIREMENTS", found)) <= COUNTS[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
        release(spark)


@pytest.mark.parametrize("name", ["box_pairs", "collision_winner", "ghost_spawn_suppress", "near_miss_spawns", "segment_peak_shot", "under_pressure_px", "duplicate_tracks", "greedy_iou_match"])
def test_boxes_are_not_sent_to_all(spark, name):
    """Whatever is broadcast was aggregated first, by track or frame."""
    lines = plan(registry.queries()[name](spark, SMALL)).splitlines()
    depth = lambda line: len(re.match(r"[\s:+-]*", line).group())
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            grown = next((i for i, x in enumerate(below) if "Generate explode" in x), None)
            assert grown is None or any("Aggregate" in x for x in below[:grown])


def test_votes_are_counted_once(spark):
    """What locks ask of the leading number is not pushed below its count, to count it again for each question."""
    rows = spark.createDataFrame([(1, 1, k, 7 + (k % 3 == 0), 0.9, 0.5, 0.9) for k in range(40)], "match_id int, track_id int, frame_idx int, number int, confidence double, iou double, cosine double")
    led = events.window_votes(rows).filter("votes >= 8 and seen >= 8 and share >= 0.6 and mean >= 0.8")
    assert not [x for x in plan(led).splitlines() if "Filter" in x and "lambda" in x]
    last = max(led.collect(), key=lambda r: r.frame_idx)
    assert (last.frame_idx, last.number, last.votes, last.seen) == (39, 7, 20, 30)


#: How often the plans of these make boxes anew: for reads only, whatever the number of events that they count.
MADE = {"stat_documents": 1, "team_totals": 1, "rate_caps": 1, "presence_filter": 2, "player_documents": 1, "accuracy_compare": 1, "goal_confirm": 0, "fragment_merge": 1, "player_counters": 0, "accuracy_by_player": 1}


@pytest.mark.parametrize("name", MADE)
def test_boxes_are_made_once(spark, name):
    """Plans with many branches read one table of frames, and one each of tracks, teams, changes of owner, shots and take-ons."""
    found = plan(registry.queries()[name](spark, SMALL))
    assert len(re.findall(r"Generate explode\(\[1,2,3", found)) <= MADE[name]


def test_tracks_in_one_pass(spark):
    """The same as its two parts, also where a frame holds an id twice, with another class."""
    rows = [(1, 0, 0, 2, 7, 5.0, 34.0), (1, 0, 1, 1, 7, 50.0, 34.0), (1, 1, 0, 1, 7, 5.0, 30.0), (1, 1, 1, 2, 8, 60.0, 1.0), (1, 1, 2, 2, 7, 5.0, 2.0), (1, 2, 0, 2, 8, 61.0, 1.0), (2, 0, 0, 3, 7, 104.0, 40.0)]
    boxes = spark.createDataFrame(rows, "match_id int, frame_idx int, box_idx int, cls int, track_id int, px double, py double")
    packed = play.in_frames(boxes)
    parts = play.dominant_class(packed).join(play.residency(boxes), ["match_id", "track_id"])
    got = play.track_summary(packed).select(parts.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parts.collect()))
    # of id 7 in match 1 the boxes that lead are one of each class: the class seen first
    assert {(r.match_id, r.track_id): r.dominant_class for r in got.collect()} == {(1, 7): 2, (1, 8): 2, (2, 7): 3}
