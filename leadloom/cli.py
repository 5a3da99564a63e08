"""python -m leadloom.cli --source csv --path FILE --format csv,jsonl --out DIR: a run from the command line.

Settings come from the environment (``leadloom.settings``), then from the profiles, then from the options. Exit codes: 0 done, 1 unexpected failure, 2 bad invocation,
3 every source failed, 4 an export failed, 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from dataclasses import replace
from datetime import datetime, timezone
from functools import partial
from pathlib import Path

from leadloom import secrets
from leadloom import settings as env
from leadloom.errors import BadConfig, Failure
from leadloom.functions.vocab import STRATEGIES
from leadloom.plans import policy, searches
from leadloom.sinks import files
from leadloom.sources import registry

FLAGS = argparse.BooleanOptionalAction
#: option -> rule of ``qualify.Rules``; lists are separated by commas.
RULE_OPTIONS = {
    "min-completeness": "min_completeness", "exclude-domain": "exclude_domains", "exclude-email-domain": "exclude_email_domains", "require-field": "required_fields", "exclude-country": "exclude_countries",
    "include-country": "include_countries", "exclude-industry": "exclude_industries", "include-industry": "include_industries", "min-employees": "min_employees", "max-employees": "max_employees",
    "exclude-seniority": "exclude_seniority", "include-seniority": "include_seniority", "exclude-title": "exclude_titles", "include-title": "include_titles", "exclude-title-keyword": "exclude_title_keywords",
    "include-title-keyword": "include_title_keywords", "role-prefix": "role_based_email_prefixes",
}
RULE_FLAGS = {"require-email": "require_email", "require-domain": "require_company_domain", "require-linkedin": "require_linkedin", "exclude-free-email": "exclude_free_email", "exclude-role-email": "exclude_role_based_email"}
#: option -> field of the people search.
SEARCH_OPTIONS = {"search-title": "titles", "search-seniority": "seniorities", "search-location": "locations", "search-person-location": "person_locations", "search-industry": "industries", "search-employees": "employee_ranges", "search-keywords": "keywords"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leadloom")
    p.add_argument("--source", action="append", default=[], help="a source name, repeatable; --path gives its input in the same order")
    p.add_argument("--path", action="append", default=[])
    p.add_argument("--limit", type=int, help="records of each source")
    p.add_argument("--max-leads", type=int)
    p.add_argument("--env-file", default=".env")
    p.add_argument("--csv-delimiter")
    p.add_argument("--csv-encoding")
    p.add_argument("--csv-map", action="append", default=[], metavar="TARGET=HEADER")
    p.add_argument("--csv-multi-line", action="store_true")
    p.add_argument("--website-url", action="append", default=[])
    p.add_argument("--website-pages", type=int)
    p.add_argument("--people-pages", type=int)
    p.add_argument("--people-per-page", type=int)
    p.add_argument("--similar-titles", action=FLAGS, default=None)
    for o in SEARCH_OPTIONS:
        p.add_argument(f"--{o}", action="append", default=[])
    p.add_argument("--format")
    p.add_argument("--out")
    p.add_argument("--prefix")
    p.add_argument("--dedup", choices=list(STRATEGIES))
    p.add_argument("--merge", action=FLAGS, default=None)
    p.add_argument("--sort", action=FLAGS, default=None)
    p.add_argument("--report", action=FLAGS, default=None)
    p.add_argument("--max-rejections", type=int)
    p.add_argument("--search-profiles")
    p.add_argument("--search-profile")
    p.add_argument("--profiles", help="the file of named rule profiles")
    p.add_argument("--filter-profile")
    p.add_argument("--profile", help="a name of either profile file")
    p.add_argument("--set", action="append", default=[], metavar="RULE=VALUE", help="a single rule, over profile and environment")
    for o in RULE_OPTIONS:
        p.add_argument(f"--{o}", action="append", default=[])
    for o in RULE_FLAGS:
        p.add_argument(f"--{o}", action=FLAGS, default=None)
    p.add_argument("--log-level")
    p.add_argument("--log-format", choices=("console", "json"))
    p.add_argument("--quiet", action="store_true")
    for what in ("sources", "formats", "filter-profiles", "profiles"):
        p.add_argument(f"--list-{what}", action="store_true")
    return p


def _settings(a) -> env.Settings:
    """The environment's settings with the options that were given over them."""
    s = env.load(file=a.env_file)
    over = {
        "default_limit": a.limit, "output_formats": env.listed(a.format) if a.format else None, "output_dir": a.out, "output_prefix": a.prefix, "dedup_strategy": a.dedup, "dedup_merge_fields": a.merge, "sort_by_completeness": a.sort,
        "write_run_report": a.report, "search_profiles_path": a.search_profiles, "search_profile": a.search_profile, "filter_profiles_path": a.profiles, "filter_profile": a.filter_profile, "profile": a.profile,
        "max_recorded_rejections": a.max_rejections, "log_level": a.log_level, "log_format": a.log_format, "default_sources": tuple(a.source) or None,
    }
    s = replace(s, **{k: v for k, v in over.items() if v is not None})
    part = lambda x, **kw: replace(x, **{k: v for k, v in kw.items() if v not in (None, [], ())})
    return replace(
        s, csv_source=part(s.csv_source, delimiter=a.csv_delimiter, encoding=a.csv_encoding, column_map=tuple(a.csv_map)), website=part(s.website, urls=tuple(a.website_url), max_pages_per_site=a.website_pages),
        people=part(s.people, max_pages=a.people_pages, per_page=a.people_per_page),
    )


def _profiles(s: env.Settings) -> tuple[searches.Search | None, dict | None]:
    """The search and the rules that profiles name: a half named on its own wins over the name of both."""
    both = searches.strategy(s.profile, s.search_profiles_path, s.filter_profiles_path) if s.profile else None
    found, rules = (both.search, both.filters) if both else (None, None)
    if s.search_profile:
        found = searches.strategy(s.search_profile, s.search_profiles_path, os.devnull).search
    if s.filter_profile:
        rules = searches.strategy(s.filter_profile, os.devnull, s.filter_profiles_path).filters
    return found, rules


def _rules(a, s: env.Settings, profile: dict | None):
    base = policy.from_environment()
    if s.min_completeness and not base.min_completeness:
        base = replace(base, min_completeness=s.min_completeness)
    flags: dict = dict(x.split("=", 1) for x in a.set)
    for o, rule in RULE_OPTIONS.items():
        if v := getattr(a, o.replace("-", "_")):
            flags[rule] = ",".join(v)
    for o, rule in RULE_FLAGS.items():
        if (v := getattr(a, o.replace("-", "_"))) is not None:
            flags[rule] = v
    return policy.resolve(base, profile, flags)


def preflight(folder: str | Path, formats, names: list[Path]) -> None:
    """The folder can be written to, every format is known, and no file stands where a folder is needed: known before the run, not after it."""
    unknown = [f for f in formats if f not in files.FORMATS]
    if unknown or not formats:
        raise BadConfig(f"name formats among {', '.join(files.FORMATS)}" + (f", not {unknown[0]}" if unknown else ""))
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=folder, prefix=".probe-"):
            pass
    except OSError as e:
        raise BadConfig(f"{folder} can't be written to: {e}") from e
    if taken := [n for n in names if n.is_dir()]:
        raise BadConfig(f"{taken[0]} is a folder")


def _listing(a, s: env.Settings) -> list[str] | None:
    if a.list_sources:
        return registry.names()
    if a.list_formats:
        return sorted(files.FORMATS)
    there = lambda path, read: read(path) if Path(path).is_file() else {}
    rules = there(s.filter_profiles_path, policy.load_profiles)
    if a.list_filter_profiles:
        return sorted(rules)
    if a.list_profiles:
        return [f"{n} ({', '.join(h)})" for n, h in searches.halves(there(s.search_profiles_path, searches.load), rules).items()]
    return None


def _makers(a, s: env.Settings, spark, found: searches.Search | None) -> dict:
    out = {}
    given = {k: v for o, k in SEARCH_OPTIONS.items() if (v := getattr(a, o.replace("-", "_")))}
    over = searches.search({k: " ".join(v) if k == "keywords" else v for k, v in given.items()} | ({} if a.similar_titles is None else {"similar_titles": a.similar_titles}))
    merged = replace(found or searches.Search(), **{k: getattr(over, k) for k in given}, **({} if a.similar_titles is None else {"similar_titles": a.similar_titles}))
    for i, name in enumerate(s.default_sources):
        path = a.path[i] if i < len(a.path) else (s.csv_source.path or "" if name == "csv" else "")
        options: dict = {}
        if name == "csv":
            options = {"delimiter": s.csv_source.delimiter, "encoding": s.csv_source.encoding, "column_map": list(s.csv_source.column_map), "multi_line": a.csv_multi_line}
        elif name == "synthetic":
            options = {"n": s.default_limit}
        elif name == "people_search":
            options = {"settings": s.people, "criteria": searches.criteria(s.people, merged), "limit": s.default_limit, "http": s.http}
        elif name == "company_site":
            options = {"settings": s.website, "limit": s.default_limit, "http": s.http}
        out[f"{name}#{i}"] = partial(registry.source(name), spark, path, **options)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        s = _settings(a)
        secrets.register(secrets.held_by(s))
        secrets.set_up(s.log_level, s.log_format, sys.stderr)
        if (lines := _listing(a, s)) is not None:
            print("\n".join(lines))
            return 0
        for name in s.default_sources:
            registry.source(name)
        found, profile = _profiles(s)
        rules = _rules(a, s, profile)
        now = datetime.now(timezone.utc)
        report = Path(s.output_dir) / files.file_name(f"{s.output_prefix}_report", list(s.default_sources), now, ".json")
        preflight(s.output_dir, s.output_formats, [report])
    except (ValueError, KeyError, OSError, Failure) as e:
        print(f"error: {secrets.masked(str(e))}", file=sys.stderr)
        return 2
    try:
        return _run(a, s, found, rules, now, report)
    except KeyboardInterrupt:
        print("interrupted", file=sys.stderr)
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"error: {secrets.masked(str(e))}", file=sys.stderr)
        return 1


def _run(a, s: env.Settings, found, rules, now: datetime, report: Path) -> int:
    from pyspark.sql import SparkSession

    from leadloom.cluster import prepare
    from leadloom.plans import pipeline

    spark = prepare(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        result = pipeline.run(_makers(a, s, spark, found), rules, s.dedup_strategy, s.dedup_merge_fields, a.limit, a.max_leads, s.sort_by_completeness, cap=s.max_recorded_rejections)
    except RuntimeError as e:
        print(f"error: {secrets.masked(str(e))}", file=sys.stderr)
        return 3
    done, failure = [], None
    try:
        done = files.export(result.leads, s.output_dir, list(s.output_formats), s.output_prefix, list(s.default_sources), now)
    except Exception as e:  # noqa: BLE001  the report is written all the same
        failure = e
    stats = result.stats()
    if s.write_run_report:
        try:
            files.write_report(result.report(stats, {"sources": list(s.default_sources), "strategy": s.dedup_strategy, "limit": a.limit, "max_leads": a.max_leads}, done), report)
        except OSError as e:
            failure = failure or e
    print(pipeline.summary(stats) if a.quiet else pipeline.details(stats, pipeline.top(result.leads)))
    result.close()
    if failure:
        print(f"error: {secrets.masked(str(failure))}", file=sys.stderr)
        return 4
    return 0


if __name__ == "__main__":
    sys.exit(main())
