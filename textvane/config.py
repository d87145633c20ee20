"""Fixed values and tunable policies shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: results depend on these exact constants -------------------

LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}
VALID_LABELS = ("negative", "neutral", "positive")

# Applied in this order, each one on the text the earlier ones already redacted.
PII_PATTERNS = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b(?:\+1[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b"),
    ("account_number", r"\b\d{8,17}\b"),
)

# UTF-8 quotes that were decoded as Latin-1, with their repair.
MOJIBAKE_QUOTES = (
    ("â\u0080\u0099", "'"),
    ("â\u0080\u009c", '"'),
    ("â\u0080\u009d", '"'),
)

SIMILARITY_THRESHOLD = 0.95
IMBALANCE_THRESHOLD = 10.0
OUTLIER_PERCENTILE = 0.95
SAMPLE_FRACTION = 0.8
DEFAULT_BATCH_SIZE = 32
BATCH_MEMORY_SHARE = 0.1
CONFIDENCE_THRESHOLD = 0.7
MAX_REQUEST_CHARS = 2048
TEST_SIZE = 0.2
SPLIT_SEED = 42
LATENCY_PROBE_ROWS = 100
MAX_VOCABULARY = 10_000
MIN_DOCUMENT_FREQUENCY = 2
MAX_DOCUMENT_SHARE = 0.95
MAX_SEQUENCE_LENGTH = 512

# --- policies (their defaults are fixed values as well) ----------------------------------------------------------------


@dataclass(frozen=True)
class MonitorPolicy:
    """Windows and thresholds of the request-log metrics."""

    window_sec: int = 3600
    latency_samples: int = 1000
    drift_samples: int = 500
    drift_min_samples: int = 100
    drift_threshold: float = 0.15
    drift_floor: float = 1e-6
    latency_alert_ms: float = 500.0
    error_rate_alert: float = 0.05
    healthy_score: float = 50.0


@dataclass(frozen=True)
class RecoveryPolicy:
    """Thresholds of the fault detectors."""

    failure_threshold: int = 5
    recovery_timeout_sec: float = 30.0
    half_open_successes: int = 2
    spike_multiplier: float = 2.5
    spike_samples: int = 10
    batch_start: int = 32
    batch_factor: float = 0.5
    batch_floor: int = 1
    batch_cooldown_sec: float = 60.0
    error_rate_threshold: float = 0.10
    error_rate_samples: int = 100
    quality_threshold: float = 0.15
    quality_baseline: float = 0.8
    quality_samples: int = 10


# --- scale limits (performance only, never results) --------------------------

ROWS_PER_SLICE = 1_000_000   # rows of one key that a single task may hold
SMALL_TABLE_ROWS = 100_000   # largest summary that is sent to every executor
SMALL_TABLE_BYTES = 64 << 20  # and its largest size
