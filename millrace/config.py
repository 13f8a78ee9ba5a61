"""Settings: a frozen description of a panel, and the defaults that a settings file may override."""

from __future__ import annotations

import copy
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Panel:
    """Columns of a panel: its key, month, target, money amount, and an attribute to be filled."""

    key: tuple[str, ...] = ("subcategory", "sizing", "tactical")
    date: str = "date"
    target: str = "quantity"
    amount: str = "amount"
    attribute: str = "barrel_length"


# Months of the seasons, regimes, windows, levels and search ranges of the domain.
DEFAULTS: dict = {
    "random_seed": 42,
    "years": [2019, 2020, 2021, 2022, 2023],
    "seasons": {
        "waterfowl": (10, 1),
        "upland": (9, 2),
        "turkey_spring": (3, 5),
        "turkey_fall": (10, 11),
        "dove": (9, 11),
        "deer": (10, 1),
    },
    "regime": ("2020-03-01", "2021-12-01"),
    "after_regime": "2022-01-01",
    "off_season": (6, 7, 8),
    "peak_month": 3,
    "anchor_month": 10,
    "lags": (1, 3, 6, 12),
    "windows": (3, 6, 12),
    "kept_levels": ("12 GA", "16 GA", "20 GA", "28 GA", "410 GA", "45/410 GA"),
    "other_level": "OTHER_GAUGE",
    "min_nonzero_months": 12,
    "cv": {"min_train": 24, "horizon": 3, "step": 3},
    "split": ("2022-12-31", "2023-06-30"),
    "ridge_alpha": 1.0,
    "sarima": {"order": (1, 1, 1), "seasonal": (1, 1, 1, 12)},
    "alpha": 0.05,
    "trials": 50,
    "expected_raw_rows": None,
}


def load_config(path: str | None = None) -> dict:
    """``DEFAULTS`` with a YAML file's top-level entries over them. FileNotFoundError if the file is missing."""
    out = copy.deepcopy(DEFAULTS)
    if path is not None:
        import yaml

        found = Path(path)
        if not found.is_file():
            raise FileNotFoundError(path)
        out |= yaml.safe_load(found.read_text()) or {}
    return out
