"""Streams whose rows may come in any order: ball, possession and distance while a match is played, and unique jersey locks.

Input carries its event time (ts). A row waits until the watermark has passed it, so an operator sees its key's rows in the
order of frames, in whatever batches they came; what it has to look ahead for waits longer, in the state. Timers, one for
each time that waits, go off when the watermark passes, so nothing waits for more rows of its own key. When a key has been
silent for the time `idle`, what still waits is settled as at the end of a match, and the state goes.

A row that comes after the watermark has passed its time is late: its frame has been told, and it is left out. So rows may
be `late` behind the newest row of the stream, and no more. A session must keep state in RocksDB
(spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchflow.functions import geometry as g
from pitchflow.operators import votes
from pitchflow.params import DEFAULT, Params


def _plain(rows: pd.DataFrame, columns: dict[str, str]) -> list[tuple]:
    """Rows as the state takes them: plain values of the columns' types (whole numbers may have come as floats), None for
    what is missing."""
    whole = {n: "Int64" for n, t in columns.items() if t in ("int", "long")}
    kept = rows[list(columns)].astype(whole).astype(object)
    return list(kept.where(rows[list(columns)].notna(), None).itertuples(index=False, name=None))


class InOrder(StatefulProcessor):
    """Hands the rows of a key to step() in order, once the watermark has passed them.

    columns: names and types of the input, frame_idx and ms (the event time) among them."""

    columns: dict[str, str]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.columns.items()))
        self.told = handle.getValueState("told", "frame_idx int, closes long")
        self.open(handle)

    @abstractmethod
    def open(self, handle: StatefulProcessorHandle) -> None:
        """Make the operator's own state."""

    @abstractmethod
    def step(self, key: tuple, rows: pd.DataFrame, first: int, last: int, end: bool) -> tuple[pd.DataFrame, int]:
        """New rows, and the last frame that is settled; rows of later frames come again. rows: complete, in order; last: the
        latest complete frame; first: the one after the last settled (-1 before any); end: nothing more will come."""

    @abstractmethod
    def forget(self) -> None:
        """Drop the operator's own state."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told, closes = self.told.get() if self.told.exists() else (-1, 0)
        now = timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows))[list(self.columns)]
        new = new[new["frame_idx"] > told]
        if len(new):
            self.waiting.appendList(_plain(new, self.columns))
            due = int(new["ms"].max()) + self.idle_ms
            for ms in new.loc[new["ms"] > now, "ms"].unique().tolist():
                self.handle.registerTimer(int(ms))
            if due > closes:
                if closes > now:
                    self.handle.deleteTimer(closes)
                closes = due
                self.handle.registerTimer(closes)
            self.told.update((told, closes))
        yield from self._advance(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, now: int) -> Iterator[pd.DataFrame]:
        if not self.told.exists():
            return
        told, closes = self.told.get()
        end = now >= closes
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=list(self.columns))
        full = held[held["ms"].astype("int64") <= now].sort_values(["frame_idx"], kind="stable")
        if len(full):
            new, settled = self.step(key, full, told + 1 if told >= 0 else -1, int(full["frame_idx"].max()), end)
            left = held[held["frame_idx"] > settled]
            if len(left):
                self.waiting.put(_plain(left, self.columns))
            else:
                self.waiting.clear()
            self.told.update((max(told, settled), closes))
            if len(new):
                yield new
        if end:
            self.waiting.clear()
            self.told.clear()
            self.forget()

    def close(self) -> None:
        pass


class Play(InOrder):
    """The ball of each frame and who has it, by the rules of ball_track and ownership: a gap is filled once its end is seen,
    or left empty once it is too long."""

    columns = {"frame_idx": "int", "ms": "long", "box_idx": "int", "track_id": "int", "kind": "int", "x": "double", "y": "double", "conf": "double"}
    out = "match_id int, frame_idx int, is_raw boolean, mx double, my double, owner int"

    def __init__(self, idle_ms: int, p: Params = DEFAULT):
        super().__init__(idle_ms)
        self.p = p

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ball_frame int, bx double, by double, owner_frame int, owner int")

    def forget(self) -> None:
        self.last.clear()

    def step(self, key, rows, first, last, end):
        p = self.p
        ball_frame, bx, by, owner_frame, owner = self.last.get() if self.last.exists() else (None, None, None, None, None)
        begin = first if first >= 0 else int(rows["frame_idx"].min())
        balls = rows[rows["kind"].isin([0, 32])].sort_values(["conf", "box_idx"], ascending=[False, True], kind="stable").drop_duplicates("frame_idx")
        known = balls.set_index(balls["frame_idx"].astype(int))[["x", "y"]].astype(float)
        if ball_frame is not None:
            known.loc[ball_frame] = (bx, by)
        known = known.sort_index()
        latest = int(known.index[-1]) if len(known) else None
        # behind the latest ball all is open until the gap has become too long to be filled
        upto = last if latest is None or end or last - latest >= p.interpolate_gap else latest
        if upto < begin:
            return pd.DataFrame(), begin - 1
        frames = np.arange(begin, upto + 1)
        at = known.index.to_numpy(dtype=np.int64)
        px, py = np.full(len(frames), np.nan), np.full(len(frames), np.nan)
        if len(at):
            after = np.searchsorted(at, frames)
            a, b = np.maximum(after - 1, 0), np.minimum(after, len(at) - 1)
            hit = at[b] == frames
            gap = at[b] - at[a]
            between = ~hit & (after > 0) & (after < len(at)) & (gap <= p.interpolate_gap)
            for out, c in ((px, "x"), (py, "y")):
                v = known[c].to_numpy()
                out[hit] = v[b][hit]
                out[between] = (v[a] + (v[b] - v[a]) / np.maximum(gap, 1) * (frames - at[a]))[between]
        raw = np.isin(frames, known.index.to_numpy(dtype=np.int64))
        mx, my = px * (p.pitch_x / p.width), py * (p.pitch_y / p.height)
        men = rows[rows["track_id"].notna() & (rows["frame_idx"] <= upto)]
        i = men["frame_idx"].to_numpy(dtype=np.int64) - begin
        d = np.hypot(men["x"].to_numpy(dtype=float) * (p.pitch_x / p.width) - mx[i], men["y"].to_numpy(dtype=float) * (p.pitch_y / p.height) - my[i])
        near = pd.DataFrame({"i": i, "d": d, "box": men["box_idx"].to_numpy(), "id": men["track_id"].to_numpy()})[d <= p.owner_radius].sort_values(["i", "d", "box"], kind="stable").drop_duplicates("i")
        found = pd.Series(near["id"].to_numpy(dtype=float), index=near["i"].to_numpy(dtype=np.int64)).reindex(range(len(frames)))
        since = pd.Series(np.where(found.notna(), frames, np.nan)).ffill().fillna(np.nan if owner_frame is None else owner_frame)
        held = found.ffill().fillna(np.nan if owner is None else owner)
        shown = held.where(frames - since.to_numpy() <= p.fill_limit)
        if len(known):
            now = known[known.index <= upto]
            if len(now):
                ball_frame, bx, by = int(now.index[-1]), float(now["x"].iloc[-1]), float(now["y"].iloc[-1])
        if pd.notna(since.iloc[-1]):
            owner_frame, owner = int(since.iloc[-1]), int(held.iloc[-1])
        self.last.update((ball_frame, bx, by, owner_frame, owner))
        out = pd.DataFrame({"match_id": key[0], "frame_idx": frames.astype("int32"), "is_raw": raw, "mx": mx, "my": my, "owner": shown.astype("Int32")})
        return out.astype({"match_id": "int32"}), int(upto)


class Distance(InOrder):
    """How far a track has gone, by the rules of distance_covered: a row whenever frames become complete, the total so far."""

    columns = {"frame_idx": "int", "ms": "long", "box_idx": "int", "px": "double", "py": "double"}
    out = "match_id int, track_id int, frame_idx int, distance_m double"

    def __init__(self, idle_ms: int, p: Params = DEFAULT):
        super().__init__(idle_ms)
        self.p = p

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "px double, py double, total double")

    def forget(self) -> None:
        self.last.clear()

    def step(self, key, rows, first, last, end):
        own = rows.sort_values(["frame_idx", "box_idx"], kind="stable").drop_duplicates("frame_idx")
        x, y, total = self.last.get() if self.last.exists() else (np.nan, np.nan, 0.0)
        px, py = own["px"].to_numpy(dtype=float), own["py"].to_numpy(dtype=float)
        step = np.hypot(np.diff(px, prepend=x), np.diff(py, prepend=y))
        total += float(step[step < self.p.max_step].sum())
        self.last.update((float(px[-1]), float(py[-1]), total))
        return pd.DataFrame({"match_id": [key[0]], "track_id": [key[1]], "frame_idx": [last], "distance_m": [total]}), last


class Standing(InOrder):
    """After each vote of a track: the number that leads, its score, and whether it may lock. Only what can lock or register."""

    columns = {"frame_idx": "int", "ms": "long", "number": "int", "confidence": "double", "team": "string"}
    out = "match_id int, track_id int, team string, leader int, best double, may boolean, frame_idx int, ms long, ts timestamp"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getMapState("scores", "number int", "score double")
        self.latest = handle.getListState("latest", "number int")

    def forget(self) -> None:
        self.scores.clear()
        self.latest.clear()

    def step(self, key, rows, first, last, end):
        own = rows[rows["confidence"] >= votes.FLOOR]
        if own.empty:
            return pd.DataFrame(), last
        numbers, confidence = own["number"].to_numpy(dtype=np.int64), own["confidence"].to_numpy(dtype=float)
        before = {int(k[0]): float(v[0]) for k, v in self.scores.iterator()} if self.scores.exists() else {}
        latest = [int(x[0]) for x in self.latest.get()] if self.latest.exists() else []
        leader, best, may = votes.standing(numbers, confidence, before, np.array(latest, dtype=np.int64))
        for n in np.unique(numbers).tolist():
            self.scores.updateValue((n,), (before.get(n, 0.0) + float(confidence[numbers == n].sum()),))
        self.latest.put([(n,) for n in [*latest, *numbers.tolist()][1 - votes.LATEST :]])
        told = may | (best >= votes.REGISTER)
        ms = own["ms"].to_numpy(dtype=np.int64)[told]
        out = pd.DataFrame({"match_id": key[0], "track_id": key[1], "team": own["team"].to_numpy()[told], "leader": leader[told], "best": best[told], "may": may[told], "frame_idx": own["frame_idx"].to_numpy(dtype=np.int64)[told], "ms": ms})
        return out.assign(ts=pd.to_datetime(ms, unit="ms", utc=True)), last


class Unique(InOrder):
    """Locks and registrations of a match: (team, number) is held by one track, which a much stronger one may steal."""

    columns = {"frame_idx": "int", "ms": "long", "track_id": "int", "team": "string", "leader": "int", "best": "double", "may": "boolean"}
    out = "match_id int, event string, track_id int, team string, number int, frame_idx int, score double, stolen_from int"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "team string, number int", "track_id int, score double")
        self.locked = handle.getMapState("locked", "track_id int", "number int")
        self.registered = handle.getMapState("registered", "number int", "track_id int")

    def forget(self) -> None:
        for state in (self.held, self.locked, self.registered):
            state.clear()

    def step(self, key, rows, first, last, end):
        read = lambda state: {tuple(k): tuple(v) for k, v in state.iterator()} if state.exists() else {}
        held, locked, registered = read(self.held), {k[0]: v[0] for k, v in read(self.locked).items()}, {k[0] for k in read(self.registered)}
        out = votes.settle(rows.sort_values(["frame_idx", "track_id"], kind="stable"), held, locked, registered)
        for event, track, team, number, _, score, _ in out:
            if event == "locked":
                self.held.updateValue((team, number), (track, score))
                self.locked.updateValue((track,), (number,))
            else:
                self.registered.updateValue((number,), (track,))
        new = pd.DataFrame(out, columns=votes.EVENT).assign(match_id=key[0])
        return new[votes.schema_names(self.out)].astype({"stolen_from": "Int32"}), last


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))


def _run(rows: DataFrame, keys: list[str], processor: InOrder, event_time: str = "") -> DataFrame:
    wanted = rows.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in processor.columns.items()], "ts")
    return wanted.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode="append", timeMode="EventTime", eventTimeColumnName=event_time)


def live_play(detections: DataFrame, late: str = "5 seconds", idle_ms: int = 60_000, p: Params = DEFAULT) -> DataFrame:
    """Frames of a stream of detections(match_id, frame_idx, ts, box_idx, cls, track_id, x1 .. y2, conf) with the ball in
    metres and its owner, each once, up to interpolate_gap frames after it became complete. Frames run from the first one
    of a match that has a box to the last."""
    x, y = g.center("x1", "y1", "x2", "y2")
    return _run(_timed(detections, late).withColumn("kind", F.col("cls")).withColumn("x", x).withColumn("y", y), ["match_id"], Play(idle_ms, p))


def live_distance(detections: DataFrame, late: str = "5 seconds", idle_ms: int = 60_000, p: Params = DEFAULT) -> DataFrame:
    """(match_id, track_id, frame_idx, distance_m): the metres of each track up to a frame; the latest frame's row counts."""
    px, py = g.to_meters(*g.center("x1", "y1", "x2", "y2"), p)
    known = _timed(detections.filter("track_id is not null"), late)
    return _run(known.withColumn("px", px).withColumn("py", py), ["match_id", "track_id"], Distance(idle_ms, p))


def live_locks(reads: DataFrame, teams: DataFrame, late: str = "5 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Events of vote_locks from a stream of reads(match_id, frame_idx, ts, track_id, number, confidence): each track's votes,
    then a match's claims to numbers, one stateful step after the other. teams(match_id, track_id, team) is a table."""
    timed = _timed(reads, late)
    worn = timed.join(teams.select("match_id", "track_id", "team"), ["match_id", "track_id"], "left").withColumn("team", F.coalesce("team", F.lit("Unknown")))
    claims = _run(worn, ["match_id", "track_id"], Standing(idle_ms), "ts")
    return _run(claims, ["match_id"], Unique(idle_ms))
