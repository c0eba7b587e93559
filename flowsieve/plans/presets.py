"""Settings of the two flow collections the stages were designed around."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preset:
    recursive: bool                 # look for CSV files in sub-folders
    fraction: float                 # share of common-class rows kept
    rare_labels: tuple[str, ...]    # classes kept whole
    finder_trees: int               # ranking forest that sets the threshold
    finder_rows: float
    edit: bool                      # edit neighbours after oversampling
    fit_rows: int | None            # most rows a classifier of the selection's evaluation is fitted on
    forest_fixed: dict = field(default_factory=dict)  # overrides of the tuned forest


# Sampling fractions, rare class names, forest sizes and caps.
IDS = Preset(
    recursive=False,
    fraction=0.02,
    rare_labels=(
        "Web attack-SQL Injection",
        "SQL Injection",
        "Brute Force-XSS",
        "Brute Force -XSS",
        "Brute Force-Web",
        "Brute Force -Web",
        "DDOS attack-LOIC-UDP",
        "Infiltration",
    ),
    finder_trees=30,
    finder_rows=0.1,
    edit=True,
    fit_rows=None,
)

IOT = Preset(
    recursive=True,
    fraction=0.1,
    rare_labels=(
        "SQLINJECTION",
        "BRUTEFORCE",
        "XSS",
        "UPLOADING_ATTACK",
        "DNS SPOOFING",
        "ARP SPOOFING",
    ),
    finder_trees=15,
    finder_rows=0.05,
    edit=False,
    fit_rows=20_000_000,
    forest_fixed={"max_depth": 30, "subsample": 0.1},
)

# Part held out for testing, seed, and sample sizes for explanations that ask for one.
TEST_FRACTION = 0.2
SEED = 42
EXPLAIN_ROWS = 20_000
EXPLAIN_FOREST_ROWS = 10_000
TOP_FEATURES = 15
