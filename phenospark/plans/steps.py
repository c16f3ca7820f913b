"""Step registry, presets, configuration grids and result names."""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from phenospark.operators import batch as bt
from phenospark.operators import normalize as nm
from phenospark.operators import quality as ql
from phenospark.operators import select as sel
from phenospark.operators.aggregate import aggregate_profiles
from phenospark.operators.frame import ProfileFrame
from phenospark.operators.relational import enrich


@dataclass(frozen=True)
class Step:
    name: str
    params: Mapping = field(default_factory=dict)
    enabled: bool = True


def _control(p: Mapping) -> Column | None:
    """Condition that marks control rows, when the step fits on controls."""
    if not p.get("fit_on_controls", True):
        return None
    return F.col(p.get("control_col", "Metadata_control_type")) == p.get("control_key", "negcon")


def _batch(p: Mapping) -> str | None:
    return p.get("batch_col", "Metadata_Plate") or None


def _batches(p: Mapping) -> list[str]:
    return [b] if (b := _batch(p)) else []


def _take(p: Mapping, *names: str) -> dict:
    return {n: p[n] for n in names if n in p}


STEPS: dict[str, Callable[[ProfileFrame, Mapping], ProfileFrame]] = {
    "clean_nans": lambda pf, p: sel.clean_rows(pf, **_take(p, "na_cutoff")),
    "merge_metadata": lambda pf, p: pf.with_df(enrich(pf.df, p["metadata"], p["on"], p.get("how", "inner"), prefer="right")),
    "filter_features": lambda pf, p: sel.filter_features(pf, p.get("filters", [])),
    "aggregate_wells": lambda pf, p: aggregate_profiles(pf, p["strata"], p.get("method", "median")),
    "normalize_robustmad": lambda pf, p: nm.robust_mad(pf, _batches(p), _control(p), **_take(p, "epsilon", "mad_divisor")),
    "normalize_standardize": lambda pf, p: nm.standardize(pf, _batches(p), _control(p), **_take(p, "epsilon")),
    "normalize_tvn": lambda pf, p: bt.tvn(pf, _batch(p), _control(p), **_take(p, "alpha", "epsilon")),
    "normalize_tvn_efaar": lambda pf, p: bt.tvn_aligned(pf, _batch(p), _control({**p, "fit_on_controls": True}), **_take(
        p, "n_components", "epsilon", "dim_ratio_threshold", "dim_ratio_action")),
    "normalize_tvn_original": lambda pf, p: bt.tvn_original(pf, _batch(p), _control(p), **_take(
        p, "k", "epsilon", "few", "dim_ratio_threshold", "dim_ratio_action")),
    "normalize_tvn_cascade": lambda pf, p: bt.tvn_cascade(pf, _batch(p), _control(p), **_take(p, "k1", "k2", "epsilon", "few")),
    "normalize_spherize": lambda pf, p: bt.spherize(pf, _batch(p), _control({"fit_on_controls": False, **p}), **_take(
        p, "method", "epsilon", "remove", "variance", "n_permutations")),
    "normalize_pca": lambda pf, p: bt.pca(pf, control=_control(p), **_take(p, "n_components", "whiten")),
    "prune_correlated": lambda pf, p: pf.select(sel.correlation_threshold(pf, **_take(p, "threshold"))),
    "well_position_correct": lambda pf, p: nm.well_position_correct(pf, p.get("well_col", "Metadata_Well")),
    "inverse_normal_transform": lambda pf, p: nm.inverse_normal_transform(pf),
    "sample_norm": lambda pf, p: nm.sample_normalize(pf, p.get("norm", "l2")),
}


def register(name: str, fn: Callable[[ProfileFrame, Mapping], ProfileFrame]) -> None:
    """Add a step ``fn(frame, params) -> frame`` under a name."""
    STEPS[name] = fn


def run(pf: ProfileFrame, steps: Sequence[Step], validate: bool = False, checkpoints: Sequence[str] = ()) -> ProfileFrame:
    """Apply the enabled steps in order.

    Steps only extend the plan, apart from the small fit statistics. After a step named in ``checkpoints`` the frame
    is written to the shared folder, so later fits and other configurations start from there.
    """
    from phenospark.session import materialize

    for step in steps:
        if not step.enabled:
            continue
        pf = STEPS[step.name](pf, step.params)
        if step.name in checkpoints:
            pf = pf.with_df(materialize(pf.df, step.name))
        if validate:
            ql.require_rows(pf.df, step.name)
            ql.check_features(pf, step.name)
    return pf


# Step orders. A filter may occur more than once; batch methods are switched on by the settings.
_BATCH_STEPS = (
    Step("normalize_tvn_efaar", {"epsilon": 0.5, "n_components": 128}, False),
    Step("normalize_spherize", {"method": "ZCA-cor", "epsilon": 0.1, "fit_on_controls": True, "batch_col": ""}, False),
    Step("normalize_tvn", {"alpha": 0.5, "epsilon": 1.0}, False),
    Step("normalize_tvn_original", {"k": 64}, False),
    Step("normalize_tvn_cascade", {"k1": 128, "k2": 32}, False),
)
_VARIANCE = Step("filter_features", {"filters": (("variance_threshold", {"freq_cut": 0.05, "unique_cut": 0.01}),)})
_OUTLIERS = Step("filter_features", {"filters": (("drop_outliers", {"cutoff": 500}),)})
_NORM = (Step("normalize_robustmad", {"fit_on_controls": True}), Step("normalize_standardize", {"fit_on_controls": True}, False))
PRESETS: dict[str, tuple[Step, ...]] = {
    "minimal": (Step("clean_nans", {"na_cutoff": 0.30}), *_NORM),
    "embedding": (Step("clean_nans", {"na_cutoff": 0.30}), _VARIANCE, *_NORM, Step("inverse_normal_transform", {}, False),
                  Step("well_position_correct", {}, False), Step("sample_norm", {"norm": "l2"}, False),
                  Step("prune_correlated", {"threshold": 0.9}), Step("normalize_pca", {"n_components": 256, "fit_on_controls": False}),
                  *_BATCH_STEPS),
    "full": (Step("clean_nans", {"na_cutoff": 0.30}), _VARIANCE, *_NORM, _OUTLIERS, Step("inverse_normal_transform", {}, False),
             Step("well_position_correct", {}, False), Step("sample_norm", {"norm": "l2"}, False),
             Step("prune_correlated", {"threshold": 0.9}), Step("normalize_pca", {"n_components": 128}, False), *_BATCH_STEPS),
}

# Batch method of a configuration to the step it enables.
METHOD_STEP = {
    "tvn": "normalize_tvn",
    "tvn_efaar": "normalize_tvn_efaar",
    "tvn_original": "normalize_tvn_original",
    "cascade_tvn": "normalize_tvn_cascade",
    "spherize": "normalize_spherize",
    "spherize_global": "normalize_spherize",
}
# Switch of a configuration to the step it turns on or off.
SWITCH_STEP = {
    "use_pca": "normalize_pca",
    "use_prune_correlated": "prune_correlated",
    "use_wellcorr": "well_position_correct",
    "use_int": "inverse_normal_transform",
    "use_sample_norm": "sample_norm",
    "use_filter_features": "filter_features",
}
# Setting of a configuration to (step, parameter).
SETTING_PARAM = {
    "tvn_alpha": ("normalize_tvn", "alpha"),
    "tvn_epsilon": ("normalize_tvn", "epsilon"),
    "tvn_efaar_epsilon": ("normalize_tvn_efaar", "epsilon"),
    "tvn_efaar_n_components": ("normalize_tvn_efaar", "n_components"),
    "tvn_original_k": ("normalize_tvn_original", "k"),
    "tvn_cascade_k1": ("normalize_tvn_cascade", "k1"),
    "tvn_cascade_k2": ("normalize_tvn_cascade", "k2"),
    "spherize_method": ("normalize_spherize", "method"),
    "spherize_epsilon": ("normalize_spherize", "epsilon"),
    "spherize_fit_controls": ("normalize_spherize", "fit_on_controls"),
    "spherize_remove_variance_threshold": ("normalize_spherize", "variance"),
    "spherize_remove_variance_method": ("normalize_spherize", "remove"),
    "spherize_n_permutations": ("normalize_spherize", "n_permutations"),
    "pca_n_components": ("normalize_pca", "n_components"),
    "pca_whiten": ("normalize_pca", "whiten"),
    "corr_thresh": ("prune_correlated", "threshold"),
    "sample_norm_type": ("sample_norm", "norm"),
    "agg_method": ("aggregate_wells", "method"),
}
# Settings that ``configure`` reads by itself.
OTHER_SETTINGS = {"norm_method", "batch_method", "use_spherize", "spherize_batch_col", "outlier_cutoff", "norm_fit_controls",
                  "tvn_fit_controls", "prune_always"}


def configure(steps: Sequence[Step], settings: Mapping) -> tuple[Step, ...]:
    """Steps of a preset with the flat settings of one grid row applied; a setting that no step knows is an error."""
    unknown = set(settings) - set(SWITCH_STEP) - set(SETTING_PARAM) - OTHER_SETTINGS
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    out = []
    norm, method = settings.get("norm_method"), settings.get("batch_method")
    for s in steps:
        p, on = copy.deepcopy(dict(s.params)), s.enabled
        if s.name in ("normalize_robustmad", "normalize_standardize") and norm is not None:
            on = s.name == {"robustmad": "normalize_robustmad", "standardize": "normalize_standardize"}.get(norm)
        if s.name in METHOD_STEP.values() and method is not None:
            on = METHOD_STEP.get(method) == s.name or (s.name == "normalize_spherize" and bool(settings.get("use_spherize")))
        for switch, target in SWITCH_STEP.items():
            if target == s.name and switch in settings:
                on = bool(settings[switch])
        if s.name == "normalize_pca" and method == "tvn":
            on = True
        p.update({param: settings[k] for k, (target, param) in SETTING_PARAM.items() if target == s.name and k in settings})
        if s.name == "normalize_spherize" and method in ("spherize", "spherize_global"):
            p["batch_col"] = "" if method == "spherize_global" else settings.get("spherize_batch_col", "Metadata_Batch")
            if method == "spherize_global":
                p["fit_on_controls"] = True
        if s.name == "normalize_spherize" and p.get("remove") == "threshold" and p.get("variance") is None:
            p["remove"] = None  # removal by threshold without a threshold is none
        elif s.name == "normalize_spherize" and p.get("variance") is not None and p.get("remove") is None:
            p["remove"] = "threshold"
        if s.name.startswith("normalize_tvn") and "tvn_fit_controls" in settings:
            p["fit_on_controls"] = settings["tvn_fit_controls"]
        if s.name == "filter_features" and "outlier_cutoff" in settings:
            p["filters"] = tuple((n, {**kw, "cutoff": settings["outlier_cutoff"]}) if n == "drop_outliers" else (n, kw) for n, kw in p["filters"])
        if s.name.startswith("normalize_") and "norm_fit_controls" in settings and s.name in ("normalize_robustmad", "normalize_standardize"):
            p["fit_on_controls"] = settings["norm_fit_controls"]
        out.append(replace(s, params=p, enabled=on))
    return tuple(out)


def expand_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the settings, last setting varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


# Settings that matter only under a condition, with the values that count as unset.
_WHITENING = ("spherize", "spherize_global")
CONDITIONAL = (
    ("spherize_method", ("PCA-cor",), lambda c: c.get("use_spherize", False) or c.get("batch_method") == "spherize"),
    ("spherize_epsilon", (1e-6, 0.1, 0.5), lambda c: c.get("batch_method") in _WHITENING),
    ("spherize_fit_controls", (False,), lambda c: c.get("batch_method") in _WHITENING),
    ("spherize_remove_variance_threshold", (None,), lambda c: c.get("batch_method") in _WHITENING
     and c.get("spherize_remove_variance_method", "threshold") == "threshold"),
    ("spherize_remove_variance_method", ("threshold",), lambda c: c.get("batch_method") in _WHITENING),
    ("pca_n_components", (64,), lambda c: c.get("use_pca", False) or c.get("batch_method") == "tvn"),
    ("corr_thresh", (0.85, 0.90), lambda c: c.get("use_prune_correlated", False) or c.get("prune_always", False)),
    ("outlier_cutoff", (15,), lambda c: c.get("use_filter_features", True)),
    ("tvn_efaar_epsilon", (0.5,), lambda c: c.get("batch_method") == "tvn_efaar"),
    ("tvn_efaar_n_components", (128,), lambda c: c.get("batch_method") == "tvn_efaar"),
    ("tvn_original_k", (64,), lambda c: c.get("batch_method") == "tvn_original"),
    ("tvn_cascade_k1", (128,), lambda c: c.get("batch_method") == "cascade_tvn"),
    ("tvn_cascade_k2", (32,), lambda c: c.get("batch_method") == "cascade_tvn"),
)


def redundant(config: Mapping) -> str | None:
    """Why a configuration repeats another one, or None: a setting without effect differs from its default."""
    if config.get("batch_method") in ("tvn", "tvn_efaar") and config.get("use_spherize"):
        return "covariance alignment already whitens"
    for name, defaults, matters in CONDITIONAL:
        if name in config and config[name] not in defaults and not matters(config):
            return f"{name} has no effect"
    return None


def _scale_text(eps: float) -> str:
    return f"e{abs(round(math.log10(eps)))}" if eps < 0.001 else f"e{eps}"


def _fit_text(p: Mapping) -> str:
    return "ctrl" if p.get("fit_on_controls", False) else "all"


def _removal_text(p: Mapping) -> str:
    kind = p.get("remove")
    if kind == "pa":
        return f"_truncPA{p.get('n_permutations', 10)}"
    if kind == "mp":
        return "_truncMP"
    return f"_trunc{p['variance']}" if p.get("variance") is not None else ""


# Name part of each step; None leaves the step out of the name.
NAME_PART: dict[str, Callable[[Mapping], str | None]] = {
    "normalize_robustmad": lambda p: f"robustmad_{_fit_text(p)}",
    "normalize_standardize": lambda p: f"std_{_fit_text(p)}",
    "normalize_pca": lambda p: f"pca{p.get('n_components', 128)}",
    "normalize_tvn": lambda p: f"tvn_a{p.get('alpha', 0.5)}",
    "normalize_tvn_original": lambda p: f"tvn_original_k{p.get('k', 64)}",
    "normalize_tvn_cascade": lambda p: f"cascade_tvn_k{p.get('k1', 128)}_k{p.get('k2', 32)}",
    "normalize_tvn_efaar": lambda p: f"tvn_efaar_e{p.get('epsilon', 0.5)}" + (
        f"_c{p['n_components']}" if p.get("n_components", 128) != 128 else ""),
    "normalize_spherize": lambda p: "_".join([p.get("method", "ZCA-cor") + ("" if _batch(p) else "_global"), _fit_text(p), _scale_text(
        p.get("epsilon", 1e-6))]) + _removal_text(p),
    "filter_features": lambda p: next((f"outlier{kw.get('cutoff', 50)}" for n, kw in p.get("filters", ()) if n == "drop_outliers"), None),
    "prune_correlated": lambda p: f"prune{p.get('threshold', 0.9)}",
    "well_position_correct": lambda p: "wellcorr",
    "inverse_normal_transform": lambda p: "INT",
    "sample_norm": lambda p: f"snorm_{p.get('norm', 'l2')}",
    "aggregate_wells": lambda p: "agg" if p.get("method", "median") == "median" else f"agg_{p['method']}",
}


def output_name(steps: Sequence[Step], mark_unpruned: bool = False) -> str:
    """Name of a configuration from its enabled steps; ``functions.names.parse_config`` reads it back."""
    parts = [NAME_PART[s.name](s.params) for s in steps if s.enabled and s.name in NAME_PART]
    parts = [p for p in parts if p]
    if mark_unpruned and not any(p.startswith("prune") for p in parts):
        parts.append("noprune")
    return "__".join(parts) or "default"
