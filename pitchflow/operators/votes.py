"""Locks of jersey numbers by votes: the rule, for a track's reads at once, and locks that are unique in a match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Least confidence of a vote, least lead over the second number, lead by which a lock is stolen, score of a registration.
FLOOR, LEAD, STEAL, REGISTER = 0.40, 0.50, 3.0, 0.6
#: Latest votes that are looked at, how many of them there must be, and the least share of the leading number.
LATEST, SOME, SHARE = 10, 5, 0.5


def standing(numbers: np.ndarray, confidence: np.ndarray, scores: dict[int, float] | None = None, latest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After each vote of a track: the leading number, its score, and whether it may lock. scores and latest: of the
    votes before. Equal scores go to the number that is later as text."""
    before = scores or {}
    names = np.array(sorted({*before, *numbers.tolist()}, key=str), dtype=np.int64)
    own = (numbers[:, None] == names) * confidence[:, None]
    total = np.round(np.cumsum(own, axis=0) + np.array([before.get(n, 0.0) for n in names.tolist()]), 9)
    column = total.shape[1] - 1 - np.argmax(total[:, ::-1], axis=1)
    leader, best = names[column], total[np.arange(len(total)), column]
    rest = total.copy()
    rest[np.arange(len(total)), column] = 0.0
    past = np.concatenate([np.full(LATEST, -1), np.asarray(latest if latest is not None else [], dtype=np.int64), numbers])
    windows = np.lib.stride_tricks.sliding_window_view(past, LATEST)[-len(numbers) :]
    voted, agree = (windows >= 0).sum(axis=1), (windows == leader[:, None]).sum(axis=1)
    return leader, best, (np.round(best - rest.max(axis=1), 9) >= LEAD) & ((voted < SOME) | (agree >= SHARE * voted))


def _claims(reads: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, own in reads.groupby("track_id"):
        leader, best, may = standing(own["number"].to_numpy(), own["confidence"].to_numpy())
        parts.append(own.assign(leader=leader, best=best, may=may))
    return pd.concat(parts).sort_values(["frame_idx", "track_id"], kind="stable")


EVENT = ["event", "track_id", "team", "number", "frame_idx", "score", "stolen_from"]


def settle(claims: pd.DataFrame, held: dict[tuple, tuple[int, float]], locked: dict[int, int], registered: set[int]) -> list[tuple]:
    """The events of claims in time. held: (team, number) to the track and its score; it, locked and registered go on."""
    out: list[tuple] = []
    of_note = claims[claims["may"].astype(bool) | (claims["best"] >= REGISTER)]
    for frame, track, team, number, score, may in of_note[["frame_idx", "track_id", "team", "leader", "best", "may"]].to_numpy().tolist():
        if track in locked:
            continue
        if score >= REGISTER and number not in registered:
            registered.add(number)
            out.append(("registered", track, team, number, frame, score, None))
        owner = held.get((team, number))
        if may and (owner is None or score > owner[1] + STEAL):
            held[team, number] = (track, score)
            locked[track] = number
            out.append(("locked", track, team, number, frame, score, owner and owner[0]))
    return out


def _settle(reads: pd.DataFrame) -> pd.DataFrame:
    """A match's locks and registrations, in time."""
    own = reads[reads["confidence"] >= FLOOR].sort_values(["track_id", "frame_idx"], kind="stable")
    found = settle(_claims(own), {}, {}, set()) if len(own) else []
    return pd.DataFrame(found, columns=EVENT).assign(match_id=reads["match_id"].iloc[0])


def vote_locks(reads: DataFrame, teams: DataFrame) -> DataFrame:
    """(match_id, event, track_id, team, number, frame_idx, score, stolen_from): a track locks the number that leads its
    votes clearly enough, if no other track of its team holds that, or by so much more votes that it is stolen. The first
    track in which a number leads by votes enough registers it for the match, before any lock.

    A match's reads are one group: some thousands, whatever the number of matches."""
    worn = reads.join(teams.select("match_id", "track_id", "team"), ["match_id", "track_id"], "left").fillna("Unknown", ["team"])
    schema = "match_id int, event string, track_id int, team string, number int, frame_idx int, score double, stolen_from int"
    return worn.select("match_id", "track_id", "frame_idx", "number", "confidence", "team").groupBy("match_id").applyInPandas(lambda g: _settle(g)[schema_names(schema)], schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
