"""Run configuration: the contract of the published YAML files, checked before any job starts.

A rule is a path into the mapping and what must hold there; all rules are tried, so
one error names everything that is wrong. `run_settings` turns a configuration into
the parameters of each stage.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from parcelspark.env.county import Params


class ConfigError(ValueError):
    """The configuration breaks its contract."""


# The keys that a configuration must have, by section.
REQUIRED = {
    "project": [],
    "data": ["dltb", "dem", "prepared_dir"],
    "fields": ["dlbm", "qsdwdm", "bsm"],
    "slope": ["source", "field"],
    "outputs": ["plan_dir", "optimized_vector"],
    "sampling": ["n_episodes", "n_states", "n_actions", "seed"],
    "training": ["n_members", "epochs", "patience", "lambda_rank"],
    "planning": ["horizon", "top_k", "n_episodes"],
    "workflow": [],
}
# The numeric ones of them, versions with constraints, profiles of the inputs, and their statements.
NUMERIC = ["sampling", "training", "planning"]
CONSTRAINED_VERSIONS = ["2.1.0", "2.2.3", "2.3.0"]
PROFILED_VERSION = "2.3.0"
INPUT_MODES = ["authority_four_source", "dltb_dem_only"]
LIMITED = {"evidence_tier": "exploratory_data_limited", "decision_use": "exploratory_technical_validation_only"}
UNAVAILABLE = ["pdt", "eco_redline", "permanent_basic_farmland"]
NOT_EVALUATED = "not_provided_not_evaluated"

_MISSING = object()


def at(config: Mapping, path: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    here: Any = config
    for key in path.split("."):
        here = here.get(key, _MISSING) if isinstance(here, Mapping) else _MISSING
        if here is _MISSING:
            return default
    return here


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def constrained(config: Mapping) -> bool:
    """Whether the configuration names the second generation of the algorithm, which has hard constraints."""
    return str(at(config, "algorithm.name", "")).endswith("v2")


def problems(config: Mapping) -> list[str]:
    """Everything that is wrong."""
    if not isinstance(config, Mapping):
        return ["the configuration must be a mapping"]
    found: list[str] = []

    def must(ok: bool, message: str) -> bool:
        if not ok:
            found.append(message)
        return ok

    for section, keys in REQUIRED.items():
        if must(isinstance(config.get(section), Mapping) and (bool(config[section]) or not keys), f"missing section {section}"):
            for key in keys:
                value = config[section].get(key)
                if must(value is not None and value != "", f"missing {section}.{key}") and section in NUMERIC:
                    must(isinstance(value, (int, float)), f"{section}.{key} must be numeric")
    must(at(config, "slope.source") == "field", "slope.source must be field: the slope of the parcels' own attribute is used")
    must(at(config, "workflow.force_resample_and_retrain_on_reward_change") is True, "workflow.force_resample_and_retrain_on_reward_change must be true: a changed reward needs new samples and training")
    for name, profile in (config.get("reward_profiles") or {}).items():
        must(at(profile, "requires_resample_train") is True, f"reward_profiles.{name}.requires_resample_train must be true")
    if constrained(config):
        version = at(config, "algorithm.version")
        must(version in CONSTRAINED_VERSIONS, f"algorithm.version must be one of {CONSTRAINED_VERSIONS}")
        floor = at(config, "planning.constraints.cultivated_area_floor_delta_ha")
        must(_number(floor) and floor >= 0, "planning.constraints.cultivated_area_floor_delta_ha must be a number of at least 0")
        must(str(at(config, "outputs.optimized_vector", "")).lower().endswith(".shp"), "outputs.optimized_vector must end with .shp")
        if version == PROFILED_VERSION:
            found += _profile_problems(config.get("input_profile"))
    return found


def _profile_problems(profile: object) -> list[str]:
    mode = at(profile, "mode") if isinstance(profile, Mapping) else None
    if mode not in INPUT_MODES:
        return [f"input_profile.mode must be one of {INPUT_MODES}"]
    if mode == INPUT_MODES[0]:
        return []
    wrong = [f"input_profile.{k} must be {v}" for k, v in LIMITED.items() if profile.get(k) != v]
    return wrong + [f"input_profile.unavailable_authority_data.{k} must be {NOT_EVALUATED}" for k in UNAVAILABLE if at(profile, f"unavailable_authority_data.{k}") != NOT_EVALUATED]


def validate(config: Mapping) -> Mapping:
    """The configuration itself; raises ConfigError with all that is wrong."""
    found = problems(config)
    if found:
        raise ConfigError("; ".join(found))
    return config


def reward_change_requires_resampling(config: Mapping, profile: str | None = None) -> bool:
    """Whether another reward (a named profile) needs new samples and training."""
    if at(config, "workflow.force_resample_and_retrain_on_reward_change") is True:
        return True
    return profile is not None and at(config, f"reward_profiles.{profile}.requires_resample_train") is True


def load(path: str) -> dict:
    """The mapping in a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict):
        raise ConfigError(f"{path} must hold a mapping")
    return config


@dataclass(frozen=True)
class Settings:
    """The parameters of each stage."""

    files: dict[str, str]
    fields: dict[str, str]
    blocks: dict[str, float]
    sampling: Params
    planning: Params
    samples: dict[str, int]
    training: dict[str, float]
    search: dict[str, Any] = field(default_factory=dict)
    limited: bool = False


# The names of rewards and of preparation, training and search options, and the parameters that they set.
REWARDS = {"slope_weight": "slope", "cont_weight": "cont", "baimu_weight": "baimu", "baimu_bonus": "bonus", "baimu_area_penalty": "penalty"}
PREPARATION = {"min_parcels": "min_parcels", "min_area_ha": "min_ha", "max_parcels": "large", "min_parcels_per_township": "min_township"}
TRAINING = {"n_members": "members", "epochs": "epochs", "patience": "patience", "lambda_rank": "rank", "batch_size": "batch"}
SEARCH = {"horizon": "horizon", "top_k": "top_k", "n_episodes": "episodes", "continuation": "continuation", "scoring": "scoring"}
SAMPLES = {"n_episodes": "episodes", "n_states": "states", "n_actions": "actions", "seed": "seed"}


def _renamed(section: Mapping | None, names: Mapping[str, str]) -> dict:
    return {to: section[key] for key, to in names.items() if section and section.get(key) is not None}


def run_settings(config: Mapping, profile: str | None = None) -> Settings:
    """A checked configuration as parameters; profile: the reward profile that replaces the reward section."""
    validate(config)
    reward = at(config, f"reward_profiles.{profile}.reward") if profile else config.get("reward")
    if profile and reward is None:
        raise ConfigError(f"no reward profile {profile}")
    weights = _renamed(reward, REWARDS)
    floors = at(config, "planning.constraints", {}) or {}
    if floors.get("cultivated_area_floor_delta_ha") is not None:
        weights["area_floor_delta_ha"] = float(floors["cultivated_area_floor_delta_ha"])
    planning = _renamed(config["planning"], {"gamma_conn": "gamma", "delta_conn": "delta"})
    planning["baimu_floor"] = floors.get("baimu_area_floor_delta_ha") is not None
    return Settings(
        files={**{k: str(v) for k, v in config["data"].items() if isinstance(v, str)}, **{k: str(v) for k, v in config["outputs"].items()}, "crs": str(config.get("crs", ""))},
        fields={**{k: str(v) for k, v in config["fields"].items()}, "slope": str(config["slope"]["field"])},
        blocks=_renamed(config.get("preparation"), PREPARATION),
        sampling=Params(**weights),
        planning=Params(**weights, **planning),
        samples=_renamed(config["sampling"], SAMPLES),
        training={**_renamed(config["training"], TRAINING), "seed": int(config["training"].get("seed_base", 0) or 0)},
        search={**_renamed(config["planning"], SEARCH), "seed": int(config["planning"].get("seed_offset", 0) or 0)},
        limited=at(config, "input_profile.mode") == INPUT_MODES[1],
    )


# The stages of a run, in order.
STAGES = ["prepare", "sample", "train", "plan", "audit"]


def stage_commands(config_path: str, out: str, stages: list[str] | None = None) -> dict[str, list[str]]:
    """The command line of each stage, run one by one."""
    return {s: ["python", "-m", "parcelspark", "run-stage", s, config_path, out] for s in stages or STAGES}


def rendered(config: Mapping, changes: Mapping[str, Any]) -> dict:
    """A copy of the configuration with values at dotted paths replaced, checked; sections on the way are made."""

    def put(here: Mapping, keys: list[str], value: Any) -> dict:
        first, *rest = keys
        below = here.get(first)
        return {**here, first: put(below if isinstance(below, Mapping) else {}, rest, value) if rest else value}

    out: dict = dict(config)
    for path, value in changes.items():
        out = put(out, path.split("."), value)
    return dict(validate(out))


# Where a run that knows parcels and elevation alone keeps its files below a data folder.
RUNTIME_PATHS = {
    "data.dltb": "input/DLTB_with_authority_slope.gpkg",
    "data.admin_units": "input/admin_units.gpkg",
    "data.dem": "input/DEM_placeholder.tif",
    "data.prepared_dir": "working/prepared_paper9v23_{name}_dltb_only",
    "outputs.plan_dir": "outputs/plan_paper9v23_{name}_dltb_only",
    "outputs.optimized_vector": "outputs/plan_paper9v23_{name}_dltb_only/DLTB_optimized.shp",
}


def runtime_config(config: Mapping, data_root: str, name: str = "zhongning") -> dict:
    """The configuration with absolute paths below a data folder, whatever folder it was written for."""
    root = data_root.rstrip("/") if "://" in data_root else os.path.abspath(os.path.expanduser(data_root))
    return rendered(validate(config), {k: f"{root}/{v.format(name=name)}" for k, v in RUNTIME_PATHS.items()} | {"runtime.data_root": root})
