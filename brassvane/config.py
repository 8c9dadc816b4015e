"""Settings: nested dictionaries, deep-merged, read by dotted names."""

from __future__ import annotations


def deep_merge(base: dict, over: dict) -> dict:
    """A new dictionary: `over` wins, dictionaries are merged, lists replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(settings: dict, name: str, default=None):
    """The value at a dotted name, or the default where a part of it is missing."""
    here = settings
    for part in name.split("."):
        if not isinstance(here, dict) or part not in here:
            return default
        here = here[part]
    return here


def load_yaml(*paths: str) -> dict:
    """YAML files merged in order; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is not installed") from e
    out: dict = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out = deep_merge(out, yaml.safe_load(f) or {})
    return out
