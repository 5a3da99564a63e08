"""Settings from the environment: ``LEAD_NAME`` and ``LEAD_SECTION__NAME``; lists as JSON or separated by commas.

A variable that looks like a setting but is not read under that name stops the run: an ignored credential is worse than an error.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from types import MappingProxyType

from leadloom.errors import BadConfig
from leadloom.functions.vocab import MAX_REJECTIONS, STRATEGIES
from leadloom.secrets import Secret

PREFIX = "LEAD_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


@dataclass(frozen=True)
class Http:
    timeout: float = 30.0
    max_attempts: int = 3
    initial_backoff: float = 0.5
    max_backoff: float = 20.0


@dataclass(frozen=True)
class PeopleSearch:
    api_key: Secret | None = None
    base_url: str = "https://people.example/api/v1"
    per_page: int = 25
    max_pages: int = 20
    person_titles: tuple[str, ...] = ()
    person_seniorities: tuple[str, ...] = ()
    person_locations: tuple[str, ...] = ()
    organization_locations: tuple[str, ...] = ()
    organization_industries: tuple[str, ...] = ()
    employee_count_ranges: tuple[str, ...] = ()
    q_keywords: str | None = None
    include_similar_titles: bool = True


@dataclass(frozen=True)
class CsvSource:
    path: str | None = None
    delimiter: str = "auto"
    encoding: str = "UTF-8"
    column_map: tuple[str, ...] = ()


@dataclass(frozen=True)
class Website:
    urls: tuple[str, ...] = ()
    max_pages_per_site: int = 3
    request_delay: float = 1.0
    respect_robots: bool = True
    same_host_only: bool = True
    max_emails: int = 5
    user_agent: str = "leadloom"


@dataclass(frozen=True)
class Settings:
    log_level: str = "INFO"
    log_format: str = "console"
    max_recorded_rejections: int = MAX_REJECTIONS
    default_sources: tuple[str, ...] = ("synthetic",)
    default_limit: int = 100
    profile: str | None = None
    search_profile: str | None = None
    search_profiles_path: str = "config/search_profiles.yaml"
    filter_profile: str | None = None
    filter_profiles_path: str = "config/filters.yaml"
    output_dir: str = "data/exports"
    output_formats: tuple[str, ...] = ("csv", "json")
    output_prefix: str = "leads"
    write_run_report: bool = True
    output_csv_delimiter: str = ","
    dedup_strategy: str = "identity"
    dedup_merge_fields: bool = True
    min_completeness: float = 0.0
    sort_by_completeness: bool = True
    http: Http = field(default_factory=Http)
    people: PeopleSearch = field(default_factory=PeopleSearch)
    csv_source: CsvSource = field(default_factory=CsvSource)
    website: Website = field(default_factory=Website)


#: name -> (least, most)
BOUNDS = MappingProxyType({
    "default_limit": (1, None), "max_recorded_rejections": (0, None), "min_completeness": (0.0, 1.0), "http.max_attempts": (1, 10), "http.timeout": (0.001, None), "people.per_page": (1, 100),
    "people.max_pages": (1, None), "website.max_pages_per_site": (1, 10), "website.request_delay": (0.0, None),
})
CHOICES = MappingProxyType({"dedup_strategy": tuple(STRATEGIES), "log_format": ("console", "json"), "log_level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")})
# Names without the prefix that are close enough to a setting to be meant as one.
BARE = MappingProxyType({
    "HTTP_TIMEOUT": "LEAD_HTTP__TIMEOUT", "HTTP_MAX_ATTEMPTS": "LEAD_HTTP__MAX_ATTEMPTS", "LOG_LEVEL": "LEAD_LOG_LEVEL", "LOG_FORMAT": "LEAD_LOG_FORMAT", "DEDUP_STRATEGY": "LEAD_DEDUP_STRATEGY",
    "MIN_COMPLETENESS": "LEAD_MIN_COMPLETENESS", "DEFAULT_SOURCES": "LEAD_DEFAULT_SOURCES", "DEFAULT_LIMIT": "LEAD_DEFAULT_LIMIT", "OUTPUT_DIR": "LEAD_OUTPUT_DIR", "OUTPUT_FORMATS": "LEAD_OUTPUT_FORMATS",
    "OUTPUT_PREFIX": "LEAD_OUTPUT_PREFIX", "WRITE_RUN_REPORT": "LEAD_WRITE_RUN_REPORT", "SEARCH_PROFILE": "LEAD_SEARCH_PROFILE", "FILTER_PROFILE": "LEAD_FILTER_PROFILE", "PEOPLE_API_KEY": "LEAD_PEOPLE__API_KEY",
})


def listed(text: str) -> tuple[str, ...]:
    text = text.strip()
    try:
        found = json.loads(text) if text.startswith("[") else text.split(",")
    except ValueError as e:
        raise BadConfig(f"{text!r} is no list: {e}") from e
    return tuple(dict.fromkeys(x for v in found if (x := str(v).strip())))


def _typed(name: str, kind: str, text: str):
    kind = kind.replace(" | None", "")
    try:
        if kind.startswith("tuple"):
            return listed(text)
        if kind == "bool":
            if text.strip().lower() not in TRUE + FALSE:
                raise ValueError("it is neither true nor false")
            return text.strip().lower() in TRUE
        return {"int": int, "float": float, "Secret": Secret, "str": str}[kind](text.strip())
    except ValueError as e:
        raise BadConfig(f"{name}: {e}") from e


def _check(path: str, value) -> None:
    least, most = BOUNDS.get(path, (None, None))
    if value is not None and ((least is not None and value < least) or (most is not None and value > most)):
        raise BadConfig(f"{path} has to be from {least} to {most if most is not None else 'any'}, not {value}")
    if path in CHOICES and value not in CHOICES[path]:
        raise BadConfig(f"{path} has to be one of {', '.join(CHOICES[path])}, not {value!r}")


def _build(kind: type, env: dict[str, str], prefix: str, path: str):
    values = {}
    for f in fields(kind):
        made = f.default_factory() if callable(f.default_factory) else None
        own = f"{path}{f.name}"
        if is_dataclass(made):
            values[f.name] = _build(type(made), env, f"{prefix}{f.name.upper()}__", f"{own}.")
            continue
        name = f"{prefix}{f.name.upper()}"
        if env.get(name) is not None:
            values[f.name] = _typed(name, str(f.type), env[name])
        _check(own, values.get(f.name, f.default))
    return kind(**values)


def misnamed() -> dict[str, str]:
    """Names that are not read, and the ones that are."""
    out = dict(BARE)
    for f in fields(Settings):
        made = f.default_factory() if callable(f.default_factory) else None
        if is_dataclass(made):
            out |= {f"{PREFIX}{f.name.upper()}_{g.name.upper()}": f"{PREFIX}{f.name.upper()}__{g.name.upper()}" for g in fields(made)}
    return out


def dotenv(path: str | Path = ".env") -> dict[str, str]:
    """The variables of a file of NAME=value lines, if it is there."""
    if not Path(path).is_file():
        return {}
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and name.strip() and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def guard(env: dict[str, str]) -> None:
    wrong = [f"{a} is set, but {b} is what is read" for a, b in sorted(misnamed().items()) if a in env and b not in env]
    if wrong:
        raise BadConfig("; ".join(wrong))


def load(env: dict[str, str] | None = None, file: str | Path = ".env") -> Settings:
    """The settings of the environment, over those of a file of variables."""
    env = dotenv(file) | dict(os.environ if env is None else env)
    guard(env)
    return _build(Settings, {k.upper(): v for k, v in env.items()}, PREFIX, "")
