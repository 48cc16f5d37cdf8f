"""Configurations of clusterings and hyper-parameter grids; driver-side, small."""

from __future__ import annotations

import copy
import itertools
import json
import re

from tessera.operators.fingerprints import config_hash, set_hash

DEFAULTS = {
    "meta": {"note": ""},
    "data": {"datasetsplit": None, "splits": ["train", "dev"], "testsplits": ["dev"], "mincount": 1, "maxcount": 2**62},
    "local": {"alpha": 0.5, "dim": 64, "clusterer": {"type": "cw", "min_weight": 0.5}},
    "global": {"min_size": 1, "max_size": 2**62, "merge_knowns": "before_global", "clusterer": {"type": "cw", "min_weight": 0.5}},
}


def load(text_or_file: str | dict) -> dict:
    """A configuration from a dict, a JSON text, or the name of a JSON file; line comments are allowed in files."""
    if isinstance(text_or_file, dict):
        return text_or_file
    if text_or_file.lstrip().startswith(("{", "[")):
        return json.loads(text_or_file)
    with open(text_or_file) as f:
        return json.loads(re.sub(r"^\s*//.*$", "", f.read(), flags=re.M))


def merge(base: dict, over: dict, whole: tuple[str, ...] = ("clusterer",)) -> dict:
    """``base`` overlaid by ``over``, deep; a subtree named in ``whole`` is replaced and not merged."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v, whole) if isinstance(v, dict) and isinstance(out.get(k), dict) and k not in whole else copy.deepcopy(v)
    return out


def with_defaults(config: dict) -> dict:
    """The configuration over the defaults; a ``dataset`` of the data is its split assignment."""
    out = merge(DEFAULTS, config)
    if out["data"].get("dataset") and not out["data"].get("datasetsplit"):
        out["data"]["datasetsplit"] = out["data"]["dataset"]
    return out


def parse_identifier(text: str) -> dict[str, str | None]:
    """Parts of ``[##]identifier[@version]``: whether it refers to this configuration's own local clustering, the identifier, and the version (an id or ``latest``)."""
    m = re.fullmatch(r"(##)?([^@#]+)(?:@([^@]+))?", text.strip())
    if not m:
        raise ValueError(f"{text!r} is no identifier")
    return {"own": bool(m[1]), "identifier": m[2], "version": m[3]}


def set_path(config: dict, path: list[str], value) -> None:
    for k in path[:-1]:
        config = config.setdefault(k, {})
    config[path[-1]] = value


def grid(experiment: dict) -> list[dict]:
    """Every combination of the hyper-parameters' values, set at their key paths in the base settings."""
    parameters = experiment.get("hyperparameters", [])
    out = []
    for values in itertools.product(*[p["values"] for p in parameters]):
        c = with_defaults(experiment.get("base_run_settings", {}))
        for p, v in zip(parameters, values):
            set_path(c, p["key"], v)
        out.append(c)
    return out


def local_identifier(config: dict) -> str:
    """Runs that share data and local settings share their local clustering."""
    return config_hash({"data": config["data"], "local": config["local"]})


def run_identifier(config: dict) -> str:
    return local_identifier(config) + "@" + config_hash({"global": config["global"]})


def experiment_hash(configs: list[dict]) -> str:
    return set_hash([run_identifier(c) for c in configs])


def compare(runs: list[dict], configs: list[dict]) -> dict[str, set[str]]:
    """Which runs are missing and which are too many, by identifier."""
    a, b = {run_identifier(c) for c in runs}, {run_identifier(c) for c in configs}
    return {"missing": b - a, "extra": a - b}


def seeded(config: dict, local_seeds: list[int], global_seeds: list[int]) -> list[dict]:
    """Repetitions of a run: every local with every global seed; a clusterer without a seed gets one run for its side."""
    out = []
    for a, b in itertools.product(local_seeds, global_seeds):
        c = copy.deepcopy(config)
        c["local"]["clusterer"]["random_state"] = a
        c["global"]["clusterer"]["random_state"] = b
        out.append(c)
    return out


def best_config(runs: list[dict], ranks: dict[str, int]) -> dict:
    """Of the best-ranked runs (rank by run identifier) the first by identifier: the same whatever the order of the runs."""
    best = min(ranks.values())
    return min((r for r in runs if ranks.get(run_identifier(r)) == best), key=run_identifier)


def stopping_grid(thresholds: list[float], alphas: list[float], linkage: str = "average") -> dict:
    """The grid of one-step agglomerative clusterings over merge thresholds and weights."""
    keys = [{"key": ["local", "clusterer", "distance_threshold"], "values": thresholds}, {"key": ["local", "alpha"], "values": alphas}]
    return {"name": "stopping", "hyperparameters": keys, "base_run_settings": {"local": {"clusterer": {"type": "ha", "linkage": linkage, "n_clusters": None}}}}
