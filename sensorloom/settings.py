"""Fixed domain values and the parameter objects of a data set."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

# --- fixed values -----------------------------------------------------------

EARLIEST_READING = datetime(2020, 10, 19, tzinfo=timezone.utc)

CHANNEL_ALIASES = {
    "counts_10": "counts, No Wt, <10 (Primary)",
    "counts_10-50": "counts, No Wt, 10-50 (Primary)",
    "counts_50-150": "counts, No Wt, 50-150 (Primary)",
    "counts_150-300": "counts, No Wt, 150-300 (Primary)",
    "counts_300-1000": "counts, No Wt, 300-1000 (Primary)",
    "counts_1000": "counts, No Wt, >1000 (Primary)",
}

SUBSTANCE_ALIASES = {"aa": "adipic_acid", "pdp": "kdp"}

# names under which the two solubility curves are known
ADIPIC_ACID_NAMES = ("adipic_acid", "aa", "adipin")
POTASSIUM_PHOSPHATE_NAMES = ("potassium_dihydrogen_phosphate", "kh2po4", "pdp", "kdp")

# solubility curves over °C and over K, in g per kg water
ADIPIC_ACID_CURVE = (13.505, 0.0418)
POTASSIUM_PHOSPHATE_CURVE = (4.6479e-5, 0.022596, 2.8535, 1000.0)
KELVIN = 273.15
GROWTH_BY_SIZE = 0.1
# kinetic parameters used where none are given
NUCLEATION = (5e-7, 1.7)
GROWTH = (1.0, 1.5)

DEFAULT_SUBSTANCE = "aa"
DENSITIES = {"aa": 1.37, "pdp": 2.34}  # kg/dm^3
DISSOLVED_CONCENTRATIONS = {"aa": 50.0}  # g/L, any other substance 335
DISSOLVED_CONCENTRATION_OTHER = 335.0
REACTOR_VOLUME = 2.0  # L

FEATURE_PATTERN = r"^[a-zA-Z0-9_-]+:[a-zA-Z0-9_-]+$"
FIXED_FEATURE_PATTERN = r"^fix:[a-zA-Z0-9_-]+=-?[0-9]+(\.[0-9]+)?$"
DERIVED_DEVICES = ("fe", "fix")

FEATURE_DEPENDENCIES = {
    "fe:nucleation_temperature": ("sensor:intensity", "sensor:temperature"),
    "fe:supersaturation": ("ftir:concentration", "ftir:temperature"),
}

DEFAULT_RANGES = {
    "ftir:temperature": (5.0, 75.0),
    "ftir:concentration": (0.0, 400.0),
    "fbrm:counts_10": (0.0, 300.0),
    "fbrm:counts_10-50": (0.0, 300.0),
    "fbrm:counts_10-100": (0.0, 300.0),
    "fbrm:counts_50-150": (0.0, 300.0),
    "fbrm:counts_150-300": (0.0, 300.0),
    "fbrm:counts_100-1000": (0.0, 300.0),
    "fbrm:counts_300-1000": (0.0, 300.0),
    "fbrm:counts_1000": (0.0, 300.0),
    "sensor:intensity": (0.0, 300.0),
    "sensor:temperature": (5.0, 75.0),
    "thermostat:temperature_process": (5.0, 75.0),
    "thermostat:temperature_internal": (5.0, 75.0),
    "thermostat:temperature_setpoint": (5.0, 75.0),
    "fe:supersaturation": (0.0, 5.0),
    "fe:nucleation_temperature": (5.0, 75.0),
}

EXPERIMENT_BATCHES = {
    "first_batch": (0, 184),
    "second_batch": (185, 201),
    "doe": (202, 267),
}

FAULTY_EXPERIMENTS = (
    1, 4, 6, 10, 14, 15, 18, 19, 22, 23, 30, 33, 44, 48, 55, 57, 70, 71, 101, 132, 145,
    167, 168, 169, 170, 171, 172, 173, 174, 175, 176, 177, 178, 179, 180, 181, 182, 183,
    184, 185, 191, 192, 193, 194, 195, 196, 197, 198, 199, 200, 201, 218, 219, 220, 221,
    222, 223, 231, 232, 233, 251, 252, 253, 254, 255, 256,
)

FILE_DEPENDENCIES = {
    "generate_dataset.py": ("generate_dataset", "create_model", "train"),
    "create_model.py": ("create_model", "train"),
    "train.py": ("train",),
}

RELEVANT_SECTIONS = {
    "generate_dataset": ("dataset", "features"),
    "generate_artificial_data": ("dataset",),
    "cluster_experiments": ("dataset",),
    "create_model": ("features", "model"),
    "train": ("dataset", "features", "model", "training", "evaluation", "optimizer"),
}

SWEEP_PARAMETERS = (
    "nr_dps_per_minute", "nr_dps_smoothing", "min_nr_experiments", "max_nr_experiments",
    "nr_clusters", "model_type", "nr_timesteps_history", "nr_timesteps_prediction",
    "batch_size", "kernel_regulizer", "bias_regulizer", "dense_activation_function",
    "list_units_per_layer", "buffer_size", "nr_epochs", "steps_per_epoch",
    "optimizer_name", "learning_rate", "epsilon", "beta_1", "beta_2", "amsgrad",
)
SWEEP_SECTIONS = ("dataset", "model", "training", "optimizer", "evaluation")
SWEEP_PLAIN_LISTS = ("list_units_per_layer", "list_dropout_per_layer")

CLUSTER_FEATURES = ("thermostat:temperature_process", "sensor:temperature")
CURVE_POINTS = 50
SYNTHETIC_ID_START = 2000
MAX_DURATION_S = 172_800
JITTER_LEVEL = 0.05
SPLIT_SEED = 42

# --- end of fixed values ----------------------------------------------------

MINUTE_NS = 60_000_000_000
DAY_NS = 24 * 60 * MINUTE_NS


@dataclass(frozen=True)
class Grid:
    """Spacing and length limit of the regular time grid."""

    dps_per_minute: int = 6
    chunk_seconds: int | None = None
    max_duration_s: int = MAX_DURATION_S

    def __post_init__(self):
        if self.chunk_seconds is None and self.dps_per_minute < 1:
            raise ValueError(f"dps_per_minute must be at least 1, got {self.dps_per_minute}")
        if self.chunk_seconds is not None and self.chunk_seconds < 1:
            raise ValueError(f"chunk_seconds must be at least 1, got {self.chunk_seconds}")

    @property
    def chunk_ns(self) -> int:
        if self.chunk_seconds is not None:
            return self.chunk_seconds * 1_000_000_000
        return MINUTE_NS // self.dps_per_minute

    @property
    def divides_day(self) -> bool:
        return DAY_NS % self.chunk_ns == 0

    @property
    def max_rows(self) -> int:
        """Most grid rows an experiment can have once the duration gate has passed it."""
        return (self.max_duration_s + 60) * 1_000_000_000 // self.chunk_ns + 2


@dataclass(frozen=True)
class DatasetSpec:
    """Everything a prepared data set depends on."""

    history: tuple[str, ...]
    prediction: tuple[str, ...] = ()
    controlled: tuple[str, ...] = ()
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(DEFAULT_RANGES))
    substance: str | None = DEFAULT_SUBSTANCE
    grid: Grid = Grid()
    smoothing: int = 50
    remove_outliers: bool = True
    normalize: bool = True
    resample: bool = True
    smooth: bool = True
    nucleation_start: str = "minute_of_hour"
    min_experiments: int = 0
    max_experiments: int | None = None
    clusters: int = 6
    jitter: float = JITTER_LEVEL
    seed: int = SPLIT_SEED

    def __post_init__(self):
        if self.smoothing < 1:
            raise ValueError(f"smoothing must be at least 1, got {self.smoothing}")
        for feature, (lo, hi) in self.ranges.items():
            if not lo < hi:
                raise ValueError(f"range of {feature} is empty: {lo}..{hi}")


@dataclass(frozen=True)
class WindowSpec:
    """Columns and lengths of training windows."""

    history: tuple[str, ...]
    prediction: tuple[str, ...]
    controlled: tuple[str, ...] = ()
    steps_history: int = 10
    steps_prediction: int = 10

    def __post_init__(self):
        if self.steps_history < 1 or self.steps_prediction < 1:
            raise ValueError("window lengths must be at least 1")
