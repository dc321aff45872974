"""YAML settings with one file inheriting from another, and the settings of a search."""

from __future__ import annotations

import os
from dataclasses import fields, replace

from mossline.operators.traversal import Limits


def deep_merge(base: dict, over: dict) -> dict:
    """`over` laid on `base`: mappings merge key by key, anything else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str) -> dict:
    """A YAML file, laid on those that its `inherits` names (one or a list, the later over the earlier), relative to it."""
    import yaml

    with open(path, encoding="utf-8") as file:
        own = yaml.safe_load(file) or {}
    parents = own.pop("inherits", None) or []
    merged: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        merged = deep_merge(merged, load(os.path.join(os.path.dirname(path), parent)))
    return deep_merge(merged, own)


def limits(settings: dict) -> Limits:
    """Limits with every value that the section `traversal` names; unknown names are an error."""
    section = settings.get("traversal", {})
    unknown = set(section) - {f.name for f in fields(Limits)}
    if unknown:
        raise ValueError(f"unknown traversal settings: {sorted(unknown)}")
    return replace(Limits(), **section)
