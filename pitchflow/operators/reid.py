"""Tracks found again by their look or colour.

tracks(match_id, track_id, born, color, v): when a track was first seen, its shirt, and its embedding; bound(match_id,
track_id, number): the tracks that hold a number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.operators.lineage import shared
from pitchflow.operators.tracks import dot, normalized

TRACK = ["match_id", "track_id"]


def looks_like(tracks: DataFrame, least: float = 0.85) -> DataFrame:
    """(match_id, track_id, other, cosine): of the tracks of its match that were born before it, the one that a track looks
    most like, if enough; of equals the lowest. A match's gallery, a vector for each of its tracks, is one array."""
    unit = tracks.select(*TRACK, "born", normalized(F.col("v")).alias("v"))
    gallery = unit.groupBy("match_id").agg(F.collect_list(F.struct("born", "track_id", "v")).alias("gallery"))
    older = F.filter("gallery", lambda e: e["born"] < F.col("born"))
    best = F.array_max(F.transform(older, lambda e: F.struct(F.round(dot(e["v"], F.col("v")), 9).alias("cosine"), (-e["track_id"]).alias("t"))))
    found = unit.join(gallery, "match_id").select(*TRACK, best.alias("b"))
    return found.select(*TRACK, (-F.col("b.t")).alias("other"), F.col("b.cosine").alias("cosine")).filter(F.col("cosine") >= least)


def reid_by_look(tracks: DataFrame, bound: DataFrame, least: float = 0.85) -> DataFrame:
    """(match_id, track_id, root, number, rejected) of every track: which track it turns out to be, itself mostly. A track
    becomes the one that it looks most like, or whatever that one has become, if that holds a number and their colours
    agree (an unknown colour agrees with any); so a track that was merged answers for later ones. rejected: 'number' or
    'color', where the likeness didn't do.

    A track can be decided once the one that it looks like has been; each round decides all such. There are as many rounds
    as the longest chain of likenesses, and each is written, so that nothing above it runs again."""
    known = F.when(F.col("color") != "Unknown", F.col("color"))
    named = bound.groupBy(*TRACK).agg(F.min("number").alias("number"))
    every = tracks.select(*TRACK, known.alias("color")).join(named, TRACK, "left").join(looks_like(tracks, least).drop("cosine"), TRACK, "left")
    every = shared(every)
    own = lambda rows: rows.select(*TRACK, F.col("track_id").alias("root"), "number", "color", F.lit(None).cast("string").alias("rejected"))
    done, parts, waiting = shared(own(every.filter("other is null"))), [], every.filter("other is not null")
    while not done.isEmpty():
        parts.append(done)
        last = done.select("match_id", F.col("track_id").alias("other"), F.col("root").alias("r_root"), F.col("number").alias("r_number"), F.col("color").alias("r_color"))
        met = waiting.join(last, ["match_id", "other"])
        fits = F.coalesce(F.col("color") == F.col("r_color"), F.lit(True))
        why = F.when(F.col("r_number").isNull(), "number").when(~fits, "color")
        pick = lambda merged, alone: F.when(why.isNull(), F.col(merged)).otherwise(F.col(alone)).alias(alone if alone != "track_id" else "root")
        done = shared(met.select(*TRACK, pick("r_root", "track_id"), pick("r_number", "number"), pick("r_color", "color"), why.alias("rejected")))
    return reduce(DataFrame.unionByName, parts, done).drop("color")


def reid_by_color(tracks: DataFrame, bound: DataFrame, registered: DataFrame) -> DataFrame:
    """(match_id, track_id, root, number) of tracks without a number: the first registered one of their colour.
    registered(match_id, number, track_id, color, frame_idx)."""
    lost = tracks.filter("color <> 'Unknown'").join(bound, TRACK, "left_anti").select(*TRACK, "color")
    first = registered.select("match_id", "color", "number", F.col("track_id").alias("root"), "frame_idx")
    pairs = lost.join(first, ["match_id", "color"]).filter(F.col("root") != F.col("track_id"))
    return pairs.groupBy(*TRACK).agg(F.min(F.struct("frame_idx", "number", "root")).alias("b")).select(*TRACK, "b.root", "b.number")
