"""Column names, categories and fixed settings shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import types as T

FEATURES = ("open", "close", "low", "high", "volume")
BAR_COLUMNS = ("symbol", "date", *FEATURES)

# Order of the assembled vector of the whole-table scaler.
VECTOR_FEATURES = ("open", "low", "high", "volume", "close")

# Fixed values of the forecasting run: bars per window, bars ahead, train share.
WINDOW_LENGTH = 22
HORIZON = 1
TRAIN_RATIO = 0.9

# Windows per block. A block is one row of at most BLOCK_SIZE + WINDOW_LENGTH bars.
BLOCK_SIZE = 512

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)


class Category(StrEnum):
    """The feature a forecaster is trained for; ALL stands for the five together."""

    OPEN = "open"
    CLOSE = "close"
    LOW = "low"
    HIGH = "high"
    VOLUME = "volume"
    ALL = "all"

    @classmethod
    def of(cls, value: str) -> "Category":
        try:
            return cls(str(value).lower())
        except ValueError:
            raise ValueError(f"unknown category {value!r}; one of {[c.value for c in cls]}") from None

    @property
    def features(self) -> tuple[str, ...]:
        return FEATURES if self is Category.ALL else (self.value,)


@dataclass(frozen=True)
class SequenceConfig:
    """Settings of the recurrent kernel.

    The defaults are fixed values: two recurrent layers of 256, a dense layer of
    32, RMSProp at 0.1, L2 of 1e-4, a drop probability of 0.2, 22 steps of
    truncated back-propagation and seed 12345.
    """

    layer1: int = 256
    layer2: int = 256
    dense: int = 32
    learning_rate: float = 0.1
    rms_decay: float = 0.95
    l2: float = 1e-4
    dropout: float = 0.2
    tbptt: int = 22
    seed: int = 12345
