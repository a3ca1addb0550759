"""Shared constants, thresholds and schemas.

Missing values are always NULL in every table of this package, never NaN and
never a marker string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
FEV_NONE, FEV_START, FEV_CONTINUE, FEV_END = 0, 1, 2, 3

NO_IMAGE_MARKERS = ("no_image", "", "nan")
NULL_MARKERS = ("nan", "None")

NEGATIVE_LABELS = ("sad face", "sad", "funeral", "suicide", "death", "breakup")
POSITIVE_LABELS = ("happy face", "positive", "happy", "wedding", "party", "pregnant")

VALENCES = ("negative", "positive", "neutral")
VALENCE_SHORT = {"negative": "neg", "positive": "pos", "neutral": "neu"}

TRIAL_MIN_MS, TRIAL_MAX_MS = 500, 10000
EARLY_EPOCH_MS = 500.0


@dataclass(frozen=True)
class Pair:
    """One kind of two-image trial."""

    name: str
    suffix: str
    valences: tuple[str, str]

    @property
    def bias(self) -> str:
        return f"bias_{self.suffix}"


# Pair names are the two valences in alphabetical order; suffixes are fixed values.
PAIRS = (
    Pair("negative_vs_positive", "neg_vs_pos", ("negative", "positive")),
    Pair("negative_vs_neutral", "neg_vs_neu", ("negative", "neutral")),
    Pair("neutral_vs_positive", "pos_vs_neu", ("positive", "neutral")),
)
PAIR_NAMES = [p.name for p in PAIRS]
BIASES = [p.bias for p in PAIRS]


@dataclass(frozen=True)
class Gates:
    """Quality limits for sessions and scenes."""

    session_min_samples: int = 200
    session_min_seconds: float = 30
    session_max_missing: float = 0.50
    session_min_scenes: int = 10
    scene_min_samples: int = 20
    scene_min_ms: float = 1000
    scene_max_missing: float = 0.40
    scene_max_blink: float = 0.40
    scene_min_starts: int = 1


@dataclass(frozen=True)
class Bands:
    """Severity bands of a questionnaire: label i covers scores up to uppers[i]."""

    labels: tuple[str, ...]
    uppers: tuple[int, ...]
    cutoff: int
    low_extreme: int
    high_extreme: int


PHQ9 = Bands(
    ("minimal", "mild", "moderate", "moderately_severe", "severe"), (4, 9, 14, 19), 10, 4, 20
)
BDI = Bands(("minimal", "mild", "moderate", "severe"), (13, 19, 28), 14, 13, 29)
# ----------------------------------------------------------------------------

# A recording is one file: two folders may hold files of the same name.
SCENE_KEY = ["session_id", "folder", "scene_index"]

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("timestamp_ms", T.DoubleType()),
        T.StructField("tev", T.DoubleType()),
        T.StructField("fev", T.DoubleType()),
        T.StructField("fdur", T.DoubleType()),
        T.StructField("fpogx", T.DoubleType()),
        T.StructField("fpogy", T.DoubleType()),
        T.StructField("rx", T.DoubleType()),
        T.StructField("ry", T.DoubleType()),
        T.StructField("blink", T.BooleanType()),
        T.StructField("image", T.StringType()),
        T.StructField("scene_index", T.IntegerType()),
    ]
)

# Rows of one session that one task may hold in order at a time. Ordered work on
# longer sessions is split into blocks of this many rows and stitched together.
BLOCK_ROWS = 1 << 19
