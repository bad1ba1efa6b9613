"""Geometry of boxes and of the pitch as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchflow.params import DEFAULT, Params


def center(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (F.col(x1) + F.col(x2)) / 2, (F.col(y1) + F.col(y2)) / 2


def foot(x1, y2, x2) -> tuple[Column, Column]:
    return (F.col(x1) + F.col(x2)) / 2, F.col(y2)


def to_meters(x: Column, y: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """The default homography, a scaling of the frame to the pitch."""
    return x * F.lit(p.pitch_x / p.width), y * F.lit(p.pitch_y / p.height)


def project(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """Any 3 x 3 homography, row by row; (0, 0) where the point lies at infinity."""
    w = x * h[6] + y * h[7] + h[8]
    safe = F.when(w != 0, w)
    return F.coalesce((x * h[0] + y * h[1] + h[2]) / safe, F.lit(0.0)), F.coalesce((x * h[3] + y * h[4] + h[5]) / safe, F.lit(0.0))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def in_zone(x: Column, y: Column, x1, y1, x2, y2) -> Column:
    return x.between(x1, x2) & y.between(y1, y2)


def in_penalty_box(mx: Column, my: Column) -> Column:
    return (mx.between(0.0, 16.5) | mx.between(88.5, 105.0)) & my.between(34 - 20.15, 34 + 20.15)


def in_box_strict(mx: Column, my: Column) -> Column:
    return ((mx < 16.5) | (mx > 88.5)) & (my > 13.84) & (my < 54.16)


def side_channel(my: Column, share: float = 0.15) -> Column:
    return (my < DEFAULT.pitch_y * share) | (my > DEFAULT.pitch_y * (1 - share))


def shot_cone(mx: Column, my: Column, p: Params = DEFAULT) -> Column:
    """Degrees between the posts of the nearer goal."""
    gx = F.when(mx > p.pitch_x / 2, p.pitch_x).otherwise(0.0)
    ax, ay, by = gx - mx, F.lit(p.post_low) - my, F.lit(p.post_high) - my
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(ax * ax + by * by)
    cosine = (ax * ax + ay * by) / F.when(norm > 0, norm)
    return F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), F.lit(0.0))


def goal_distance(mx: Column, my: Column) -> Column:
    return F.least(distance(mx, my, F.lit(0.0), F.lit(34.0)), distance(mx, my, F.lit(105.0), F.lit(34.0)))


def angle_between(ax, ay, bx, by) -> Column:
    """Radians, 0 for vectors of no length."""
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = (ax * bx + ay * by) / F.when((na >= 1e-6) & (nb >= 1e-6), na * nb)
    return F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Of two boxes, columns <prefix>x1 .. <prefix>y2."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def contains(inner: str, outer: str) -> Column:
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(inner, "x1") >= c(outer, "x1")) & (c(inner, "y1") >= c(outer, "y1")) & (c(inner, "x2") <= c(outer, "x2")) & (c(inner, "y2") <= c(outer, "y2"))


def center_distance_norm(a: str, b: str) -> Column:
    """Distance of centres over the larger side of box b, at least 1."""
    c = lambda p, n: F.col(f"{p}{n}")
    mid = lambda p, k: (c(p, f"{k}1") + c(p, f"{k}2")) / 2
    side = F.greatest(F.lit(1.0), c(b, "x2") - c(b, "x1"), c(b, "y2") - c(b, "y1"))
    return distance(mid(a, "x"), mid(a, "y"), mid(b, "x"), mid(b, "y")) / side


def valid_box(p: Params = DEFAULT) -> Column:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return (x1 >= 0) & (x1 < x2) & (x2 <= p.width) & (y1 >= 0) & (y1 < y2) & (y2 <= p.height)


def strict_box(p: Params = DEFAULT, edge: int = 30) -> Column:
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    shape = (x2 - x1) / F.when(y2 > y1, y2 - y1)
    return (x2 > x1) & (y2 > y1) & (x1 >= edge) & (y1 >= edge) & (x2 <= p.width - edge) & (y2 <= p.height - edge) & F.coalesce(shape.between(0.2, 4.0), F.lit(False))


def xg(mx: Column, my: Column, goal_x: Column | None = None, header: Column | None = None, pressed: Column | None = None) -> Column:
    """Chance of a shot from this place in metres: a logistic model of distance, offset and angle."""
    if goal_x is None:
        goal_x = F.when(F.abs(mx - 105.0) < F.abs(mx), 105.0).otherwise(0.0)
    x, c = F.greatest(F.abs(mx - goal_x), F.lit(0.5)), F.abs(my - 34.0)
    angle = F.atan2(7.32 * x, x * x + c * c - 3.66 * 3.66)
    angle = F.when(angle < 0, angle + math.pi).otherwise(angle)
    # fixed values of the published model
    odds = 0.5103 + 0.6338 * angle - 0.2798 * F.sqrt(x * x + c * c) + 0.1243 * x - 0.0300 * c + 0.0014 * x * x + 0.0041 * c * c - 0.1251 * angle * x
    less = lambda c, share: F.lit(1.0) if c is None else F.when(c, share).otherwise(1.0)
    chance = 1 / (1 + F.exp(-odds)) * less(header, 0.6) * less(pressed, 0.75)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.01), chance))


def _goal_mouths(p: Params) -> tuple[float, float, float]:
    """Left and right in pixels, and the height of both."""
    return 0.12 * p.width, 0.88 * p.width, 0.50 * p.height


def pixel_goal_distance(x: Column, y: Column, p: Params = DEFAULT) -> Column:
    """Pixels to the nearer goal."""
    left, right, mid = _goal_mouths(p)
    return F.least(distance(x, y, F.lit(left), F.lit(mid)), distance(x, y, F.lit(right), F.lit(mid)))


def pixel_goal_angle(x: Column, y: Column, p: Params = DEFAULT) -> Column:
    """The angle between both goals as seen from a place, 1 for half a turn."""
    left, right, mid = _goal_mouths(p)
    return angle_between(left - x, mid - y, right - x, mid - y) / math.pi


def pixel_xg(x: Column, y: Column, header: Column | None = None, pressed: Column | None = None, p: Params = DEFAULT) -> Column:
    """Chance of a shot from a place in pixels."""
    far = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pixel_goal_distance(x, y, p) / (0.6 * p.width)))
    chance = 1 / (1 + F.exp(-(-3.2 + 4.8 * (1.0 - far) + 1.8 * pixel_goal_angle(x, y, p))))
    less = lambda c, share: F.lit(1.0) if c is None else F.when(c, share).otherwise(1.0)
    return F.greatest(F.lit(0.02), F.least(F.lit(0.75), chance * less(header, 0.80) * less(pressed, 0.75)))


def density_xg(defenders: Column) -> Column:
    return F.greatest(F.lit(0.01), 0.30 - 0.05 * defenders)


def pass_range(d: Column) -> Column:
    return F.when(d <= 16, "short").when(d <= 30, "medium").otherwise("long")


def shot_range(d: Column) -> Column:
    return F.when(d <= 5, "close").when(d <= 16, "mid").otherwise("long")


def save_range(d: Column) -> Column:
    return F.when(d < 6, "close").when(d < 17, "mid").otherwise("long")
