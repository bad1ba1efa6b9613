"""Parameters of the match operators; plans take their literals from here."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # fixed values: they must be these for the intended results
    fps: float = 25.0
    stride: int = 3
    pitch_x: float = 105.0
    pitch_y: float = 68.0
    width: int = 1920
    height: int = 1080
    owner_radius: float = 5.0
    dribble_radius: float = 3.0
    pass_minimum: float = 3.0
    shot_speed: float = 16.0
    post_low: float = 30.34
    post_high: float = 37.66
    interpolate_gap: int = 30

    @property
    def effective_fps(self) -> float:
        return self.fps / self.stride

    @property
    def fill_limit(self) -> int:
        return int(2.5 * self.effective_fps)

    @property
    def max_step(self) -> float:
        return 12.0 * self.stride / self.fps

    @property
    def dribble_lookback(self) -> int:
        return max(1, int(self.effective_fps * 0.5))

    @property
    def retention_window(self) -> int:
        return int(1.5 * self.effective_fps)

    @property
    def min_possession(self) -> int:
        return max(3, int(self.effective_fps * 0.36))

    @property
    def max_pass_gap(self) -> float:
        return self.effective_fps * 3

    def seconds(self, s: float) -> int:
        return int(s * self.effective_fps)


DEFAULT = Params()
#: What the parameters are called in files and in the environment.
PREFIX = "PITCHFLOW_"


def load(path: str | None = None, env: Mapping[str, str] | None = None, args: Sequence[str] | None = None) -> Params:
    """Parameters from a YAML file (its section `heuristics`, or all of it), over these the environment (PITCHFLOW_FPS=50),
    over these the command line (--fps 50). Names are those of Params in any case; other names in the file are left alone,
    for it may hold more; a value that isn't a number raises ValueError."""
    kinds = {f.name: float if f.type == "float" else int for f in fields(Params)}
    found: dict[str, object] = {}
    if path:
        import yaml  # asked for here, so that the library works where it isn't installed

        with open(path, encoding="utf-8") as file:
            read = yaml.safe_load(file) or {}
        found |= {k.lower(): v for k, v in (read.get("heuristics") or read).items() if v is not None}
    environment = os.environ if env is None else env
    found |= {n: environment[PREFIX + n.upper()] for n in kinds if PREFIX + n.upper() in environment}
    if args is not None:
        parser = argparse.ArgumentParser(allow_abbrev=False)
        for n in kinds:
            parser.add_argument("--" + n.replace("_", "-"), dest=n)
        found |= {n: v for n, v in vars(parser.parse_known_args(list(args))[0]).items() if v is not None}
    return replace(DEFAULT, **{n: kinds[n](found[n]) for n in kinds if n in found})
