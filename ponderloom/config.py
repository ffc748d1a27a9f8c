"""Settings: defaults, a YAML or JSON file over them, and environment variables over both."""

from __future__ import annotations

import json
import os
from copy import deepcopy

#: The defaults.
DEFAULTS = {
    "pipeline": {"extractors": ["rbe", "sbe", "rbe_rand"], "cot_samples": 100, "seed": 42},
    "gcp": {"n_bootstrap": 2000, "pass_mean": 0.80, "pass_min": 0.60, "pass_ci_lower": 0.70},
    "iaa": {"n_samples": 100, "wl_iterations": 3},
    "baselines": {"jp_dpr_k": 100, "n_swaps": 10, "tsi_percentile": 95.0},
    "power_analysis": {"target_auc_improvement": 0.05, "baseline_auc": 0.60, "alpha": 0.05, "power": 0.80},
    "prune": {"use_calibration_signal": False, "calibration_weight": 0.35, "use_prm_signal": False, "prm_weight": 0.30},
}

#: Models by family and size (billions of parameters).
MODELS = {
    "qwen2.5-7b": ("qwen", 7), "qwen2.5-32b": ("qwen", 32), "qwen2.5-72b": ("qwen", 72), "llama-3-8b": ("llama", 8), "llama-3-70b": ("llama", 70),
    "deepseek-v2-lite": ("deepseek", 16), "mixtral-8x7b": ("mixtral", 47),
}


def models_of(family: str) -> list[str]:
    return [m for m, (f, _) in MODELS.items() if f == family]


def one_of_each_family() -> list[str]:
    return [models_of(f)[0] for f in sorted({f for f, _ in MODELS.values()})]


def load(path: str | None = None, env: dict | None = None) -> dict:
    """PONDERLOOM_CONFIG names a file, PONDERLOOM_EXTRACTORS a comma-separated list. Unknown sections are kept."""
    env = os.environ if env is None else env
    out = deepcopy(DEFAULTS)
    path = path or env.get("PONDERLOOM_CONFIG")
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            own = json.loads(text)
        except ValueError:
            import yaml  # only for files that aren't JSON

            own = yaml.safe_load(text) or {}
        for section, values in own.items():
            out[section] = {**out.get(section, {}), **values} if isinstance(values, dict) else values
    if env.get("PONDERLOOM_EXTRACTORS"):
        out["pipeline"]["extractors"] = [x.strip() for x in env["PONDERLOOM_EXTRACTORS"].split(",") if x.strip()]
    return out
