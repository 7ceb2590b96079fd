"""Settings: defaults as plain data, a YAML file over them."""

from __future__ import annotations

from pathlib import Path

DEFAULTS = {
    "paths": {"raw": "data/raw", "processed": "data/processed", "reports": "reports", "models": "models"},
    "source": {"sales_file": "sales_train_evaluation.csv", "sales_file_fallback": "sales_train_validation.csv", "calendar_file": "calendar.csv", "prices_file": "sell_prices.csv"},
    "subset": {"stores": None, "categories": None, "departments": None, "max_items_per_store": None},
    "availability": {"method": "price", "drop_inactive": True},
    "backtest": {"horizon_days": 28, "n_folds": 5, "step_days": 28, "min_train_days": 730},
    "segmentation": {"adi_threshold": 1.32, "cv2_threshold": 0.49},
    "replenishment": {"lead_time_days": 7, "service_level": 0.95, "review_period_days": 7, "initial_inventory_days_of_cover": 14},
    "phase6": {"safety_stock_z_override": None, "fallback_sigma": 1.0, "outlier_forecast_multiplier": 10.0},
    "random_seed": 42,
}


def load_config(path: str | None = None) -> dict:
    """The defaults with the sections of a YAML file laid over them."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in DEFAULTS.items()}
    if path is not None:
        import yaml

        for key, value in (yaml.safe_load(Path(path).read_text()) or {}).items():
            out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
