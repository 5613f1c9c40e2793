"""Clip names (trial, frame range and the pattern of valid names), and the cells of a CSV line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_NAME = r"^(CTRL|BHVE)_group\d_\d{6}-\d{6}(\.mp4)?$"


def bare(key: Column) -> Column:
    """Without leading slashes and extension."""
    return F.regexp_replace(F.regexp_replace(key, "^/+", ""), r"\.[A-Za-z0-9]+$", "")


def trial(key: Column) -> Column:
    return F.substring_index(bare(key), "_", 2)


def frame_range(key: Column) -> tuple[Column, Column]:
    last = F.element_at(F.split(bare(key), "_"), -1)
    ends = F.split(last, "-")
    return F.get(ends, F.lit(0)).try_cast("bigint"), F.get(ends, F.lit(1)).try_cast("bigint")


def is_clip(key: Column) -> Column:
    return key.rlike(CLIP_NAME)


def without(key: Column, part: str) -> Column:
    return ~F.contains(key, F.lit(part))


def cells(line: Column) -> Column:
    """The cells of a line; commas within double quotes do not part them."""
    quoted = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = F.transform(quoted, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, ",", -1))
