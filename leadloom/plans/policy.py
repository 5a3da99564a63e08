"""Rules and settings from profiles and the environment; a profile replaces the environment's rules, flags override single ones."""

from __future__ import annotations

import json
import os
import re
from dataclasses import fields, replace
from pathlib import Path

from leadloom.operators.qualify import Rules

PREFIX = "LEAD_FILTER__"


def profile_key(name: str) -> str:
    return re.sub(r"[\s_-]+", "_", name.strip().casefold())


def items(text: str) -> tuple[str, ...]:
    """A JSON list or comma separated text."""
    text = text.strip()
    found = json.loads(text) if text.startswith("[") else text.split(",")
    return tuple(dict.fromkeys(str(x).strip() for x in found if str(x).strip()))


def _typed(name: str, value):
    known = {f.name: f for f in fields(Rules)}
    if name not in known:
        raise ValueError(f"unknown rule {name!r}; known are {', '.join(known)}")
    default = known[name].default
    if isinstance(default, tuple):
        return items(value) if isinstance(value, str) else tuple(dict.fromkeys(str(v).strip() for v in value if str(v).strip()))
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return float(value) if isinstance(default, float) else int(value)


def rules(values: dict) -> Rules:
    return Rules(**{k: _typed(k, v) for k, v in values.items() if v is not None})


def from_environment(env: dict[str, str] | None = None) -> Rules:
    env = os.environ if env is None else env
    return rules({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"repeated key {k!r}")
        out[k] = v
    return out


def load_profiles(path: str | Path) -> dict[str, dict]:
    """Named profiles of a JSON or YAML file; repeated keys and names that fold to the same key are errors."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        class Strict(yaml.SafeLoader):
            pass

        Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: _no_repeats([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]))
        found = yaml.load(text, Strict) or {}  # noqa: S506
    else:
        found = json.loads(text, object_pairs_hook=_no_repeats)
    out: dict[str, dict] = {}
    for name, body in found.items():
        if profile_key(name) in out:
            raise ValueError(f"profile {name!r} collides with another")
        out[profile_key(name)] = body or {}
    return out


def resolve(env: Rules, profile: dict | None = None, flags: dict | None = None) -> Rules:
    base = rules(profile) if profile is not None else env
    return replace(base, **{k: _typed(k, v) for k, v in (flags or {}).items() if v is not None})
