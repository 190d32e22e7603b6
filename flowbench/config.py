"""Parameters of the engine. Fixed values are named once, here."""

from __future__ import annotations

from dataclasses import dataclass

# Names and labels that give a flow table its meaning.
RAW_LABEL = " Label"
LABEL = "label"
SOURCE_FILE = "source_file"
BENIGN = "BENIGN"
BENIGN_TARGET = 0
ATTACK_TARGET = 1

# Capture days, and the part of the split each belongs to.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
SPLIT_DAYS = {
    "train": ("Monday", "Tuesday"),
    "val": ("Wednesday",),
    "test": ("Thursday", "Friday"),
}

# Columns that identify a flow instead of describing it.
IDENTIFIER_COLUMNS = ("flow_id", "source_ip", "destination_ip", "timestamp", "simillarhttp")
NON_FEATURE_COLUMNS = ("binary_label", "multiclass_label", "source_file", "row_id")

# Columns this engine adds to the one frame it works on; never features either.
ENGINE_COLUMNS = ("label", "target", "split", "weekday", "score", "prediction")

DEFAULT_SEED = 42
PROBABILITY_FLOOR = 1e-12


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of the benign-only self-supervised detector."""

    # The defaults that results depend on.
    svd_components: int = 64
    rff_components: int = 192
    rff_gamma: float = 0.10
    rotations: int = 8
    trees: int = 200
    max_depth: int | None = 20
    min_rows_per_leaf: int = 2
    threshold_quantile: float = 0.97
    calibrated_threshold: float | None = 0.8042
    use_calibrated_threshold: bool = False
    scale_numeric: bool = True
    exclude_columns: tuple[str, ...] = IDENTIFIER_COLUMNS
    # Spark-side settings. Split candidates per feature: fewer are cheaper and coarser.
    max_bins: int = 32
    # About so many benign training rows grow the forest, drawn by their content; None takes all.
    # Statistics, threshold, validation and test always use every row.
    max_fit_rows: int | None = 2_000_000
    # Cost only: memory of a task, and where categories are kept.
    forest_memory_mb: int = 512
    inline_width: int = 4096

    def __post_init__(self) -> None:
        if self.max_depth is None or not 0 <= self.max_depth <= 30:
            raise ValueError("max_depth must be a number from 0 to 30: Spark ML grows bounded trees")
        if not 0.0 <= self.threshold_quantile <= 1.0:
            raise ValueError("threshold_quantile must lie in [0, 1]")
        if self.rotations < 1:
            raise ValueError("rotations must be at least 1 (the identity)")
