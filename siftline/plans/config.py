"""Configuration: defaults, presets, merging, and values given on a command line."""

from __future__ import annotations

import copy
import os

# The default configuration.
DEFAULTS: dict = {
    "seed": 42,
    "total_rounds": 10,
    "data": {"min_length": 10, "max_length": 4096, "fields": {}, "template": "{instruction}\n{input}"},
    "embedding": {"encoder": "hash", "dim": 256, "pca_dim": None, "pca_variance": None},
    "clustering": {"algorithm": "density", "min_cluster_size": 50, "min_samples": 10, "method": "eom", "k": 100, "noise": "nearest", "threshold": 50_000, "pilot_rows": None, "max_size": 100_000, "target_size": 50_000},
    "compression": {"max_representatives": 2048, "reference_size": 512, "algorithm": "fps", "metric": "cosine"},
    "error": {"weights": {"loss": 0.4, "correctness": 0.6, "entropy": 0.0}, "momentum": 0.99, "offset": 0.5, "tolerance": 0.001},
    "thompson": {"alpha0": 1.0, "beta0": 1.0, "strength": 2.0, "ratio": 0.3, "warmup_rounds": 2},
    "budget": {"total": 10_000, "base_ratio": 0.2, "max_ratio": 3.0, "adaptive": False},
    "priority": {"c": 0.5, "a": 0.5, "b": 0.5, "k": 10, "eta": 0.7, "ratios": [0.8, 0.15, 0.05]},
    "retirement": {"patience": 3, "threshold": 0.1, "revisit": 0.05},
    "prior": {"variance": 0.25, "global_distance": 0.25, "isolation": 0.25, "label_entropy": 0.25},
}
# What the presets change.
PRESETS: dict[str, dict] = {
    "default": {},
    "small": {"total_rounds": 5, "embedding": {"pca_dim": 128}, "clustering": {"min_cluster_size": 20, "min_samples": 5}, "compression": {"max_representatives": 256, "reference_size": 128}, "thompson": {"strength": 0.5, "warmup_rounds": 3}, "budget": {"total": 100, "base_ratio": 0.3, "max_ratio": 1.5}, "priority": {"a": 0.3, "b": 0.2, "k": 5, "ratios": [0.5, 0.3, 0.2]}, "prior": {"variance": 0.3, "global_distance": 0.3, "isolation": 0.2, "label_entropy": 0.2}},
    "math": {"data": {"fields": {"instruction": "question", "output": "answer"}}, "thompson": {"strength": 3.0, "warmup_rounds": 3}, "priority": {"c": 0.6, "a": 0.3, "b": 0.4, "eta": 0.6}, "retirement": {"patience": 2, "threshold": 0.05, "revisit": 0.08}},
    "instruction": {"error": {"weights": {"loss": 0.8, "correctness": 0.0, "entropy": 0.2}}, "thompson": {"ratio": 0.35}, "priority": {"c": 0.4, "a": 0.4, "ratios": [0.7, 0.2, 0.1]}, "retirement": {"patience": 4, "threshold": 0.15, "revisit": 0.03}},
    "code": {"data": {"max_length": 8192, "fields": {"instruction": "prompt", "output": "solution"}}, "error": {"weights": {"loss": 0.3, "correctness": 0.7, "entropy": 0.0}}, "thompson": {"strength": 2.5}, "priority": {"c": 0.6, "a": 0.3, "b": 0.4, "eta": 0.5}, "retirement": {"patience": 2, "threshold": 0.0, "revisit": 0.1}},
    "mmlu": {"data": {"max_length": 2048, "fields": {"instruction": "question", "input": "choices", "output": "answer"}}, "error": {"weights": {"loss": 0.3, "correctness": 0.7, "entropy": 0.0}, "tolerance": 0.0}, "thompson": {"strength": 2.5, "ratio": 0.35}, "budget": {"total": 5000, "base_ratio": 0.25, "max_ratio": 2.5}, "priority": {"a": 0.35, "b": 0.4, "eta": 0.65}, "retirement": {"threshold": 0.08, "revisit": 0.06}, "prior": {"variance": 0.2, "global_distance": 0.3, "isolation": 0.2, "label_entropy": 0.3}},
    "bbh": {"data": {"fields": {"instruction": "input", "output": "target"}}, "error": {"weights": {"loss": 0.35, "correctness": 0.65, "entropy": 0.0}, "tolerance": 0.0}, "thompson": {"strength": 3.0, "ratio": 0.4, "warmup_rounds": 3}, "budget": {"total": 3000}, "priority": {"c": 0.6, "a": 0.25, "b": 0.45, "eta": 0.55}, "retirement": {"patience": 4, "threshold": 0.05, "revisit": 0.1}, "prior": {"variance": 0.3}},
    "mmlu_bbh": {"error": {"weights": {"loss": 0.35, "correctness": 0.65, "entropy": 0.0}}, "thompson": {"strength": 2.8, "ratio": 0.35, "warmup_rounds": 3}, "budget": {"total": 8000}, "priority": {"c": 0.55, "a": 0.3, "b": 0.45}, "retirement": {"threshold": 0.06, "revisit": 0.08}, "prior": {"variance": 0.2}},
    "bbh_hf": {"total_rounds": 4, "data": {"max_length": 2048}, "thompson": {"warmup_rounds": 1}, "budget": {"total": 337}, "retirement": {"patience": 2}},
}


def merged(base: dict, over: dict) -> dict:
    """Recursive: the right side wins."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def rescaled(weights: dict[str, float], slack: float = 0.01) -> dict[str, float]:
    """Weights that sum to 1, unless they nearly do."""
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 and abs(total - 1) > slack else dict(weights)


def literal(text: str):
    """A command-line value: true, false, null, a number, a comma-separated list, or text."""
    plain = text.strip()
    fixed = {"true": True, "false": False, "null": None, "none": None}
    if plain.lower() in fixed:
        return fixed[plain.lower()]
    for kind in (int, float):
        try:
            return kind(plain)
        except ValueError:
            pass
    return [literal(x) for x in plain.split(",")] if "," in plain else plain


def dotted(settings: list[str]) -> dict:
    """``a.b=value`` settings as a nested dict."""
    out: dict = {}
    for item in settings:
        path, _, value = item.partition("=")
        at = out
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = literal(value)
    return out


def preset(name: str = "default", over: dict | None = None, settings: list[str] | None = None) -> dict:
    """Defaults, then a preset, then overrides, then settings; weights are made to sum to 1."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    out = merged(merged(merged(DEFAULTS, PRESETS[name]), over or {}), dotted(settings or []))
    out["error"]["weights"], out["prior"] = rescaled(out["error"]["weights"]), rescaled(out["prior"])
    share = sum(out["priority"]["ratios"])
    if abs(share - 1) > 0.01:
        out["priority"]["ratios"] = [r / share for r in out["priority"]["ratios"]]
    return out


def load_yaml(path: str) -> dict:
    """A YAML file; ``_base_`` names a file that it builds upon."""
    import yaml

    with open(path) as file:
        data = yaml.safe_load(file) or {}
    base = data.pop("_base_", None)
    return merged(load_yaml(os.path.join(os.path.dirname(path), base)), data) if base else data


def load_python(path: str, function: str | None = None, **arguments) -> dict:
    """What a function of a Python file returns: ``get_config``, or the file's only function whose name ends so, unless named. The file is run, so it must be trusted."""
    import runpy

    names = runpy.run_path(path)
    found = [n for n, f in names.items() if callable(f) and n.startswith("get_") and n.endswith("config")]
    if function is None:
        function = "get_config" if "get_config" in found else found[0] if len(found) == 1 else None
    if function is None:
        raise ValueError(f"{path} has {len(found)} functions get_..config; name one")
    if not callable(names.get(function)):
        raise AttributeError(f"{path} has no function {function!r}")
    return names[function](**arguments)


def load(path: str, over: dict | None = None, settings: list[str] | None = None, function: str | None = None, **arguments) -> dict:
    """A whole configuration from a file (``.py``, ``.yaml``, ``.yml``) on top of the defaults, then overrides, then settings."""
    kind = os.path.splitext(path)[1]
    if kind == ".py":
        data = load_python(path, function, **arguments)
    elif kind in (".yaml", ".yml"):
        data = load_yaml(path)
    else:
        raise ValueError(f"no configuration format {kind!r}")
    return preset("default", merged(data, over or {}), settings)


TASKS = ("math", "instruction", "code", "mmlu", "bbh", "mmlu_bbh")


def for_task(task: str, path: str, budget: int | None = None, settings: list[str] | None = None) -> dict:
    """The preset of a task for the data at ``path``, with another budget per round where one is given."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; there are {', '.join(TASKS)}")
    return preset(task, merged({"data": {"path": path}}, {"budget": {"total": budget}} if budget is not None else {}), settings)


def save_yaml(config: dict, path: str) -> None:
    import yaml

    with open(path, "w") as file:
        yaml.safe_dump(config, file, allow_unicode=True, sort_keys=False)
