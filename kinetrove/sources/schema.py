"""Table schemas, the keypoint vocabulary and the missing-value rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Body parts with their short names, in table order (fixed values).
BODYPARTS = {"nose": "no", "leftEye": "le", "rightEye": "re", "stripe1": "sa", "stripe2": "sb", "stripe3": "sc", "stripe4": "sd", "tailBase": "tb", "tailTip": "tt"}
INDIVIDUALS = ["individual1", "individual2", "individual3"]
FPS = 30
TRIAL_FRAMES = 378_000

POSE = T.StructType(
    [
        T.StructField("clip", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("individual", T.StringType()),
        T.StructField("bodypart", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("likelihood", T.DoubleType()),
    ]
)
ROI = T.StructType([T.StructField("clip", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("roi_x", "roi_y", "roi_r")), T.StructField("frame_w", T.IntegerType()), T.StructField("frame_h", T.IntegerType())])
ANNOTATIONS = T.StructType([T.StructField("trial", T.StringType()), T.StructField("temporal_segment_start", T.DoubleType()), T.StructField("temporal_segment_end", T.DoubleType())])
SEGMENTS = T.StructType([T.StructField("clip", T.StringType()), T.StructField("individual", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
KP_ERROR = T.StructType([T.StructField("individual", T.StringType()), T.StructField("bodypart", T.StringType()), T.StructField("rmse", T.DoubleType())])


def missing(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates and comparisons skip it."""
    return F.when(~F.isnan(value), value)


def normalise(pose: DataFrame) -> DataFrame:
    """Applied once at ingest: NaN to NULL in all floating columns."""
    floating = [f.name for f in pose.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return pose.withColumns({c: missing(F.col(c).cast("double")) for c in floating})


def short_name(bodypart: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BODYPARTS.items() for x in kv])[bodypart]
