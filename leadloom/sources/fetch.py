"""Fetching over HTTP for the sources: retries, waits between hits on one host, and what a site's robots.txt allows.

Plain urllib underneath; ``opener`` replaces it (tests serve from memory). Runs inside the readers of the Python data sources.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from leadloom.errors import Denied, SourceFailure, Throttled, Unreachable
from leadloom.settings import Http

# Statuses that may pass, statuses that say who asks is not let in, and the longest wait that is honoured.
TRY_AGAIN = frozenset((408, 425, 429, 500, 502, 503, 504))
NOT_LET_IN = frozenset((401, 403))
LONGEST_WAIT = 60.0
JITTER = 0.25

#: (method, url, headers, body, timeout) -> (status, headers, body)
Opener = Callable[[str, str, dict, bytes | None, float], tuple[int, dict, bytes]]


def open_url(method: str, url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310  the scheme is checked by the client
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read()
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Unreachable("http", f"{method} {url}: {e}") from e


def asked_wait(headers: dict) -> float | None:
    """The seconds of a ``Retry-After``; its date form is ignored."""
    text = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    try:
        return max(0.0, float(text)) if text else None
    except ValueError:
        return None


@dataclass
class Client:
    """One source's requests. Failures that may pass are tried again, up to ``max_attempts``; the last one is raised."""

    source: str
    base: str = ""
    headers: dict = field(default_factory=dict)
    http: Http = field(default_factory=Http)
    opener: Opener = open_url
    sleep: Callable[[float], None] = time.sleep

    def _once(self, method: str, url: str, body: bytes | None) -> bytes:
        try:
            status, headers, answer = self.opener(method, url, self.headers, body, self.http.timeout)
        except Unreachable as e:
            raise Unreachable(self.source, str(e)) from e
        if status in NOT_LET_IN:
            raise Denied(self.source, f"{method} {url}: HTTP {status}; check the key of this source")
        if status == 429:
            raise Throttled(self.source, f"{method} {url}: HTTP 429", asked_wait(headers))
        if status in TRY_AGAIN:
            raise Unreachable(self.source, f"{method} {url}: HTTP {status}")
        if status >= 400:
            raise SourceFailure(self.source, f"{method} {url}: HTTP {status}: {answer[:200].decode('utf-8', 'replace')}")
        return answer

    def pause(self, attempt: int, failure: SourceFailure) -> float:
        """Seconds before the next attempt: what the source asked for, else growing with the attempts."""
        if isinstance(failure, Throttled) and failure.wait:
            return min(failure.wait, LONGEST_WAIT)
        step = min(self.http.initial_backoff * 2 ** (attempt - 1), self.http.max_backoff)
        return step + random.uniform(0, JITTER * step)

    def request(self, method: str, path: str, body=None) -> bytes:
        url = self.base.rstrip("/") + path if path.startswith("/") else path
        if urlsplit(url).scheme not in ("http", "https"):
            raise SourceFailure(self.source, f"{url} is no web address")
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(1, self.http.max_attempts + 1):
            try:
                return self._once(method, url, data)
            except (Throttled, Unreachable) as e:
                if attempt == self.http.max_attempts:
                    raise
                self.sleep(self.pause(attempt, e))
        raise AssertionError("no attempt was made")

    def json(self, method: str, path: str, body=None):
        try:
            return json.loads(self.request(method, path, body))
        except ValueError as e:
            raise SourceFailure(self.source, f"{path} gave no JSON: {e}") from e


@dataclass
class Manners:
    """The waits between hits on one host, and what its robots.txt allows. A host is read by one task, so the state needs no sharing."""

    client: Client
    agent: str = "leadloom"
    delay: float = 1.0
    robots: bool = True
    clock: Callable[[], float] = time.monotonic
    _last: dict = field(default_factory=dict)
    _rules: dict = field(default_factory=dict)

    def wait(self, url: str) -> None:
        host = urlsplit(url).netloc
        rest = self._last.get(host, -1e9) + self.delay - self.clock()
        if rest > 0:
            self.client.sleep(rest)
        self._last[host] = self.clock()

    def allowed(self, url: str) -> bool:
        """By the host's robots.txt, read once; one that can't be read allows everything."""
        if not self.robots:
            return True
        host = urlsplit(url).netloc
        if host not in self._rules:
            at = urljoin(url, "/robots.txt")
            rules: RobotFileParser | None = RobotFileParser()
            self.wait(at)
            try:
                rules.parse(self.client.request("GET", at).decode("utf-8", "replace").splitlines())
            except SourceFailure:
                rules = None
            self._rules[host] = rules
        rules = self._rules[host]
        return rules is None or rules.can_fetch(self.agent, url)

    def get(self, url: str) -> str:
        self.wait(url)
        return self.client.request("GET", url).decode("utf-8", "replace")
