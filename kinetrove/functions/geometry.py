"""Scalar geometry as Column expressions (whole-stage code, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(dx: Column, dy: Column) -> Column:
    """Written as a square root, which other engines compute alike; NULL if either part is."""
    return F.sqrt(dx * dx + dy * dy)


def angle(dy: Column, dx: Column) -> Column:
    """Degrees in [0, 360)."""
    deg = F.degrees(F.atan2(dy, dx))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def heading(dx: Column, dy: Column) -> Column:
    """Radians of a heading vector."""
    return F.atan2(dy, dx)


def rotated(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    """The point turned by -theta."""
    return x * F.cos(theta) + y * F.sin(theta), y * F.cos(theta) - x * F.sin(theta)


def inside(dist: Column, radius: C, inclusive: bool = True) -> Column:
    return dist <= col(radius) if inclusive else dist < col(radius)


def mean_heading(deg: Column) -> Column:
    """Aggregate: circular mean in (-180, 180], missing values skipped."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(deg))), F.sum(F.cos(F.radians(deg)))))


def to_frames(seconds: Column, fps: int = 30) -> Column:
    """Rounded half to even."""
    return F.rint(seconds * fps).cast("bigint")


def to_seconds(frames: Column, fps: int = 30) -> Column:
    return frames / fps


def clock(seconds: Column) -> Column:
    """H:MM:SS cut to seven characters."""
    whole = F.floor(seconds)
    text = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.substring(text, 1, 7)


def polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.sqrt(re * re + im * im), F.atan2(im, re)
