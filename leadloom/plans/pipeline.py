"""Sources to ranked records in one plan: union, normalize, validate, qualify, deduplicate, rank; with counts and rejections."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.vocab import MAX_REJECTIONS
from leadloom.operators import dedup, rank
from leadloom.operators.normalize import normalize
from leadloom.operators.qualify import Rules, qualify
from leadloom.operators.validate import validate

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Stages:
    """The stages of a run; each may be replaced by another of the same shape."""

    normalize: Callable[[DataFrame, bool], DataFrame] = normalize
    validate: Callable[[DataFrame], DataFrame] = validate
    qualify: Callable[[DataFrame, Rules], DataFrame] = qualify
    deduplicate: Callable[[DataFrame, str, bool, bool], tuple[DataFrame, DataFrame]] = dedup.deduplicate
    rank: Callable[[DataFrame, int | None], DataFrame] = rank.best_first


@dataclass
class Result:
    leads: DataFrame
    annotated: DataFrame
    pairs: DataFrame
    rejections: DataFrame
    started: datetime
    errors: dict[str, str] = field(default_factory=dict)
    max_leads: int | None = None
    cap: int = MAX_REJECTIONS

    def stats(self) -> dict:
        """The counts of the run; small aggregates of the annotated frame."""
        one = rank.stage_counts(self.annotated).collect()[0].asDict()
        dup = self.pairs.agg(F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "probable").alias("probable")).collect()[0]
        finished = datetime.now(timezone.utc)
        removed = dup["exact"] + dup["probable"]
        left = one["n_kept"] - removed
        rejected = one["n_invalid"] + one["n_filtered"] + removed
        out = one | {
            "duplicates_exact": dup["exact"], "duplicates_probable": dup["probable"], "duplicates_removed": removed, "after_dedup": left, "n_exported": left if self.max_leads is None else min(left, self.max_leads),
            "total_rejected": rejected, "rejections_truncated": rejected > self.cap,
            "per_provider": {r["provider"]: r["n_records"] for r in rank.provider_counts(self.annotated).collect()}, "per_validation_rule": {r["rule"]: r["n_records"] for r in rank.by_count(rank.rule_counts(self.annotated)).collect()},
            "per_filter_rule": {r["rule"]: r["n_records"] for r in rank.by_count(rank.filter_counts(self.annotated)).collect()}, "failed_sources": sorted(self.errors), "errors": self.errors,
            "duration_seconds": round((finished - self.started).total_seconds(), 3),
        }
        log.info("run finished", extra={k: v for k, v in out.items() if isinstance(v, (int, float, bool))})
        return out

    def report(self, stats: dict, about: dict, outputs: list[dict]) -> dict:
        """The run report: what ran, the counts, what deduplication and the sources did, and the capped rejections."""
        rejected = [r.asDict() for r in self.rejections.collect()]  # capped by the operator
        return {
            "summary": summary(stats), "run": about | {"started_at": self.started}, "stats": stats,
            "deduplication": {k: stats[k] for k in ("n_kept", "duplicates_exact", "duplicates_probable", "duplicates_removed", "after_dedup")},
            "sources": {"records": stats["per_provider"], "failed": stats["errors"]}, "rejections": rejected, "rejections_truncated": stats["rejections_truncated"], "outputs": outputs,
        }

    def close(self) -> None:
        self.annotated.unpersist()


def summary(s: dict) -> str:
    """The run in one line."""
    return f"{s['n_raw']} records, {s['n_invalid']} invalid, {s['n_filtered']} filtered, {s['duplicates_removed']} duplicates, {s['n_exported']} leads in {s['duration_seconds']} s"


def details(s: dict, top: list[dict]) -> str:
    """The run for people: counts, rules by how often they fired, sources that failed, the first leads."""
    lines = [summary(s), "", f"providers: {', '.join(f'{k} {v}' for k, v in sorted(s['per_provider'].items())) or 'none'}"]
    for title, counts in (("validation rules", s["per_validation_rule"]), ("filter rules", s["per_filter_rule"])):
        lines += [f"{title}:", *(f"  {n:>8} {rule}" for rule, n in counts.items())] if counts else []
    lines += [f"failed source {k}: {v}" for k, v in sorted(s["errors"].items())]
    lines += ["first leads:", *(f"  {x['completeness']:.2f} {x['name'] or '-'} | {x['title'] or '-'} | {x['company'] or '-'} | {x['email'] or '-'}" for x in top)] if top else []
    return "\n".join(lines)


def top(leads: DataFrame, n: int = 5) -> list[dict]:
    """The first leads of a run, for printing."""
    return [r.asDict() for r in leads.select("completeness", F.col("person.full_name").alias("name"), F.col("person.job_title").alias("title"), F.col("company.name").alias("company"), F.col("person.email").alias("email")).take(n)]


def run(
    sources: dict, rules: Rules = Rules(), strategy: str = "identity", merge: bool = True, limit: int | None = None, max_leads: int | None = None, sort: bool = True, unicode: bool = True,
    stages: Stages = Stages(), map_records: Callable[[DataFrame], DataFrame] | None = None, cap: int = MAX_REJECTIONS,
) -> Result:
    """``sources`` are callables without arguments; one that fails is noted and left out. ``map_records`` changes raw records of every source before they are normalized.
    The annotated frame is persisted: leads, rejections and counts all come from it (``Result.close`` gives it back)."""
    started = datetime.now(timezone.utc)
    frames, errors = [], {}
    for name, make in sources.items():
        try:
            frame = make()
            frame.limit(1).count()  # a lazy source fails here, on its own
            frames.append(map_records(frame) if map_records else frame)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e).splitlines()[0][:300]
            log.warning("source failed", extra={"source": name, "error": errors[name]})
    if not frames:
        raise RuntimeError(f"every source failed: {errors}")
    annotated = stages.qualify(stages.validate(stages.normalize(rank.union_sources(frames, limit), unicode)), rules).persist()
    kept, pairs = stages.deduplicate(annotated.where(F.col("valid") & F.col("failed").isNull()), strategy, merge, unicode)
    leads = stages.rank(kept, max_leads) if sort else (kept.orderBy("src_rank", "seq").limit(max_leads) if max_leads is not None else kept.orderBy("src_rank", "seq"))
    return Result(leads, annotated, pairs, rank.rejections(annotated, pairs, cap), started, errors, max_leads, cap)
