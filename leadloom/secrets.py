"""Credentials stay out of logs and reports: a registry of their values, a filter that masks them, and the renderings of log records."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterable
from dataclasses import fields, is_dataclass
from datetime import datetime, timezone

# The mask, and the length from which on a value is masked.
MASK = "***"
SHORTEST = 8

_values: set[str] = set()


class Secret(str):
    """A credential in the settings: a string that does not show itself."""

    def __repr__(self) -> str:
        return f"Secret({MASK!r})"


def held_by(settings: object) -> list[str]:
    """The values of every ``Secret`` in a tree of settings."""
    if isinstance(settings, Secret):
        return [str.__str__(settings)]
    if is_dataclass(settings):
        parts: Iterable = (getattr(settings, f.name) for f in fields(settings))
    elif isinstance(settings, dict):
        parts = settings.values()
    elif isinstance(settings, (list, tuple, set, frozenset)):
        parts = settings
    else:
        return []
    return [v for p in parts for v in held_by(p)]


def register(values: Iterable[str | None]) -> None:
    _values.update(v for v in values if v and len(v) >= SHORTEST)


def forget() -> None:
    _values.clear()


def masked(value):
    """A text without registered values, the longest ones first; anything else as it is."""
    if isinstance(value, str) and _values:
        value = re.sub("|".join(map(re.escape, sorted(_values, key=lambda v: (-len(v), v)))), MASK, value)
    return value


class MaskingFilter(logging.Filter):
    """Masks message, arguments and extra fields of a record."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg = masked(record.getMessage())
        record.args = ()
        for k, v in list(record.__dict__.items()):
            if k not in _STANDARD:
                record.__dict__[k] = masked(v)
        return True


_STANDARD = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


def _extras(record: logging.LogRecord) -> dict:
    return {k: v for k, v in vars(record).items() if k not in _STANDARD}


class ConsoleFormat(logging.Formatter):
    """``time LEVEL name: message key=value``."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).strftime("%H:%M:%S")
        more = "".join(f" {k}={v}" for k, v in sorted(_extras(record).items()))
        text = f"{at} {record.levelname} {record.name}: {record.getMessage()}{more}"
        return masked(text + (f"\n{self.formatException(record.exc_info)}" if record.exc_info else ""))


class JsonFormat(logging.Formatter):
    """One JSON object a record."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat().replace("+00:00", "Z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | _extras(record)
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return masked(json.dumps(out, default=str, ensure_ascii=False))


def set_up(level: str = "INFO", style: str = "console", stream=None) -> logging.Handler:
    """The package's log on ``stream``, in the style ``console`` or ``json``, masked."""
    handler = logging.StreamHandler(stream)
    handler.setFormatter(JsonFormat() if style == "json" else ConsoleFormat())
    handler.addFilter(MaskingFilter())
    log = logging.getLogger("leadloom")
    log.handlers[:] = [handler]
    log.setLevel(level.upper())
    return handler
