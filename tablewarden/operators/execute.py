"""Runs a contract over a frame.

Round one is one aggregation for all slots and the profile, one for its distinct-value sketches, and one
grouped job per exact distinct count or key check; independent jobs are submitted together. Round two fetches samples for failed checks.
A user's expression that fails while it runs is evaluated again by itself, so it fails alone.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..contract.model import Contract
from ..contract.parse import dump_contract
from ..plans.planner import Outcome, Planned, Planner, _first_line, cannot_run, name_of
from ..session import pinned
from . import keys as key_jobs
from . import samples
from .keys import KeySet
from .profile import ColumnProfile, fill_values, prepared, profile_slots, profiled_columns, read_profile

CHECK_SCHEMA = (
    "id string, column string, kind string, params string, severity string, status string, rows_evaluated long, rows_failed long, "
    "fail_ratio double, observed string, samples array<struct<row: long, value: string>>, message string"
)
REDACTED = "<redacted>"


@dataclass
class CheckResult:
    id: str
    column: str | None
    kind: str
    params: dict[str, Any]
    severity: str
    outcome: Outcome
    samples: list[dict] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "failed" if self.outcome.failed else "passed"

    def to_dict(self) -> dict[str, Any]:
        o = self.outcome
        metrics = {k: v for k, v in (("rows_evaluated", o.rows_evaluated), ("rows_failed", o.rows_failed)) if v is not None} | o.observed
        out = {"id": self.id, "column": self.column, "kind": self.kind, "params": self.params, "severity": self.severity, "status": self.status, "metrics": metrics, "samples": self.samples}
        return {k: v for k, v in out.items() if k != "column" or v is not None} | ({"message": o.message} if o.message else {})


@dataclass
class RunResult:
    contract: dict[str, Any]
    source: dict[str, Any]
    started_at: str
    duration_ms: int
    checks: list[CheckResult]
    observed_schema: dict[str, Any]
    profile: list[ColumnProfile] | None = None
    redacted: bool = False
    key_set: KeySet | None = None

    @property
    def status(self) -> str:
        return "failed" if self.summary["failed_error"] else "passed"

    @property
    def summary(self) -> dict[str, int]:
        failed = [c for c in self.checks if c.outcome.failed]
        warn = sum(c.severity == "warn" for c in failed)
        return {"checks_total": len(self.checks), "passed": len(self.checks) - len(failed), "failed_error": len(failed) - warn, "failed_warn": warn}

    def is_failure(self, strict: bool = False) -> bool:
        s = self.summary
        return s["failed_error"] > 0 or strict and s["failed_warn"] > 0

    def to_dict(self) -> dict[str, Any]:
        out = {
            "result_schema_version": 1, "tool_version": __version__, "contract": self.contract, "source": self.source, "started_at": self.started_at, "duration_ms": self.duration_ms,
            "status": self.status, "summary": self.summary, "checks": [c.to_dict() for c in self.checks], "observed_schema": self.observed_schema,
        }
        if self.profile is not None:
            out["profile"] = {"columns": [p.to_dict(self.redacted) for p in self.profile]} | ({"redacted": True} if self.redacted else {})
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.id, c.column, c.kind, json.dumps(c.params), c.severity, c.status, c.outcome.rows_evaluated, c.outcome.rows_failed, _float(c.outcome.observed.get("fail_ratio")), json.dumps(c.outcome.observed), [(s["row"], s["value"]) for s in c.samples], c.outcome.message)
            for c in self.checks
        ]
        return spark.createDataFrame(rows, CHECK_SCHEMA)


def _float(x: Any) -> float | None:
    return None if x is None else float(x)


def micros_of(now: dt.datetime | str | None) -> int:
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now.replace("Z", "+00:00"))
    now = now or dt.datetime.now(dt.UTC)
    now = now if now.tzinfo else now.replace(tzinfo=dt.UTC)
    return (now - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


class Run:
    def __init__(self, contract: Contract, frame: DataFrame, typed: bool, now_micros: int, references: dict[str, KeySet], sample_failures: int, profile: bool, strict_freshness: bool) -> None:
        self.frame, self.contract, self.n = frame, contract, sample_failures
        self.planner = Planner(contract, frame, typed, now_micros, references, strict_freshness, ahead=True)
        self.checks = self.planner.plan()
        self.profile_names = profiled_columns(frame) if profile else []
        self.frame = self.parsed(frame)
        self.wide = prepared(self.frame, self.profile_names, typed)
        self.typed, self.profile, self.values = typed, None, {}

    def parsed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns(self.planner.parsed) if self.planner.parsed else frame

    # round one

    def _slots(self) -> tuple[dict[str, Any], dict[str, Any]]:
        """Plain aggregates, which compile into one loop, and sketches, which would keep them from it."""
        slots = dict(self.planner.slots.expressions)
        if self.profile_names:
            slots |= profile_slots(self.profile_names)
        sketches = {k for k in slots if k in self.planner.slots.sketches or k.endswith("_distinct")}
        return {k: e for k, e in slots.items() if k not in sketches}, {k: slots[k] for k in slots if k in sketches}

    def _aggregate(self, slots: dict[str, Any]) -> dict[str, Any]:
        if not slots:
            return {}
        try:
            return self.wide.agg(*(e.alias(k) for k, e in slots.items())).first().asDict()
        except Exception:
            users = {s for c in self.checks for s in c.user_slots} & slots.keys()
            if not users:
                raise
        # one of the user's expressions fails on these data: all others together, then each by itself
        row = self.wide.agg(*(e.alias(k) for k, e in slots.items() if k not in users)).first().asDict()
        for slot in users:
            try:
                row[slot] = self.wide.agg(slots[slot].alias("v")).first()["v"]
            except Exception as e:  # noqa: BLE001
                row[slot] = e
        return row

    def _job(self, check: Planned) -> Any:
        kind, what = check.job
        if kind == "distinct":
            return self.frame.select(what.alias("v")).dropna().groupBy("v").agg(F.count(F.lit(1)).alias("n")).count()
        if kind == "primary_key":
            return key_jobs.primary_key_counts(self.frame, what).first()
        if kind == "references":
            return key_jobs.reference_counts(self.frame, *what).first()
        return self._assert(what)

    def _assert(self, text: str) -> Outcome:
        """One truth about all rows, over the columns as their declared types."""
        declared = {n: c.typed for n, c in self.planner.cells.items()}
        others = [name_of(n) for n in self.frame.columns if n not in declared and n not in self.planner.parsed]
        typed = self.frame.select(*(c.alias(n) for n, c in declared.items()), *others)
        try:
            asked = typed.agg(F.expr(text).alias("v"))
            if (kind := asked.schema["v"].dataType.simpleString()) not in ("boolean", "void"):
                return cannot_run(f"the assertion gives {kind}, not true or false")
            row = asked.first()
        except Exception as e:  # noqa: BLE001
            return cannot_run(_first_line(e))
        if row["v"] is None:
            return Outcome(True, message="the assertion came out null")
        return Outcome(not row["v"], message=None if row["v"] else "the assertion is false")

    def evaluate(self) -> list[CheckResult]:
        distinct: dict[str, Planned] = {}
        jobs: list[tuple[Planned, Planned]] = []
        for c in self.checks:
            if c.job and c.job[0] == "distinct":
                jobs.append((c, distinct.setdefault(str(c.job[1]), c)))
            elif c.job:
                jobs.append((c, c))
        with ThreadPoolExecutor(max_workers=8) as pool:
            plain, sketches = self._slots()
            fused, estimates = pool.submit(self._aggregate, plain), pool.submit(self._aggregate, sketches)
            running = {id(first): pool.submit(self._job, first) for _, first in jobs}
            values = fused.result() | estimates.result()
            answers = {id(c): running[id(first)].result() for c, first in jobs}
        self.values = values
        results = [CheckResult(c.id, c.column, c.kind, c.params, c.severity, self._outcome(c, values, answers.get(id(c)))) for c in self.checks]
        if self.profile_names:
            self.profile = read_profile(values, self.profile_names)
            fill_values(self.frame, self.profile, self.typed)
        self._samples(results)
        return results

    def _outcome(self, c: Planned, values: dict[str, Any], answer: Any) -> Outcome:
        if c.fixed:
            return c.fixed
        for slot in c.user_slots:
            if isinstance(values[slot], Exception):
                return cannot_run(_first_line(values[slot]))
        if not c.job:
            return c.read(values)
        kind, what = c.job
        rows = values[self.planner.slots.rows()]
        if kind == "distinct":
            return c.read(values | {"distinct": answer})
        if kind == "primary_key":
            failed = answer["null_key_rows"] + answer["duplicate_rows"]
            observed = {"fail_ratio": failed / rows if rows else 0, "distinct_keys": answer["distinct_keys"], "duplicate_rows": answer["duplicate_rows"], "null_key_rows": answer["null_key_rows"]}
            return Outcome(failed > 0, rows, failed, observed, f"{answer['duplicate_rows']} repeated keys, {answer['null_key_rows']} rows without a whole key" if failed else None)
        if kind == "references":
            n, bad = answer["rows_evaluated"], answer["rows_failed"]
            observed = {"fail_ratio": bad / n if n else 0, "referenced_dataset": c.params["dataset"], "referenced_keys": answer["referenced_keys"], "rows_skipped_null": answer["rows_skipped_null"]}
            return Outcome(bad > 0, n, bad, observed, f"{bad} rows refer to nothing in `{c.params['dataset']}`" if bad else None)
        answer.observed = {"rows": rows}
        return answer

    # round two

    def _samples(self, results: list[CheckResult]) -> None:
        wanted = [(c, r) for c, r in zip(self.checks, results, strict=True) if r.outcome.failed and r.outcome.rows_failed and (c.bad is not None or c.job and c.job[0] in ("primary_key", "references"))]
        if not wanted or not self.n:
            return
        frame = samples.located(self.frame)
        with ThreadPoolExecutor(max_workers=8) as pool:
            self.sizes = pool.submit(samples.partition_sizes, self.frame).result
            for (_, r), found in zip(wanted, pool.map(lambda x: self._sample(frame, x[0]), wanted), strict=True):
                r.samples = found

    def _sample(self, frame: DataFrame, c: Planned) -> list[dict]:
        if not c.job:
            return samples.first_rows(frame, c.bad, c.value, self.n, self.sizes)
        if c.job[0] == "distinct":
            return samples.repeated_rows(frame, [c.job[1]], c.value, self.n, self.sizes)
        columns = c.job[1] if c.job[0] == "primary_key" else c.job[1][0]
        texts = key_jobs.key_texts(frame, columns)
        shown = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.coalesce(t, F.lit("(null)"))) for n, t in zip(columns, texts, strict=True)))
        if c.job[0] == "references":
            bad = key_jobs.orphans(frame, *c.job[1])
            return samples.first_rows(bad, F.lit(True), shown, self.n, self.sizes)
        whole = F.lit(True)
        for t in texts:
            whole = whole & t.isNotNull()
        nulls = samples.first_rows(frame, ~whole, shown, self.n, self.sizes)
        return sorted([*nulls, *samples.repeated_rows(frame, texts, shown, self.n, self.sizes)], key=lambda s: s["row"])[: self.n]


def run_check(
    contract: Contract,
    frame: DataFrame,
    *,
    typed: bool = True,
    now: dt.datetime | str | None = None,
    references: dict[str, KeySet] | None = None,
    sample_failures: int = 5,
    profile: bool = True,
    redact: bool = False,
    fail_on_unknown_freshness: bool = False,
    source: dict[str, Any] | None = None,
    contract_text: str | None = None,
    contract_path: str | None = None,
) -> RunResult:
    """Check a frame against a contract.

    ``typed``: whether the source has types of its own (Parquet, tables); text sources are parsed by the
    contract's types. ``now`` is the clock that freshness is judged by. ``references`` hold the key sets of
    other datasets.
    """
    began, clock = time.time(), dt.datetime.now(dt.UTC)
    with pinned(frame.sparkSession):
        hidden = [samples.ROW] if samples.ROW in frame.columns else []
        run = Run(contract, frame.drop(*hidden) if hidden else frame, typed, micros_of(now), references or {}, sample_failures, profile, fail_on_unknown_freshness)
        if hidden:
            checks = _with_rows(run, run.parsed(frame))
        else:
            checks = run.evaluate()
        key_set = None
        if contract.primary_key and all(c in frame.columns for c in contract.primary_key):
            if next(c for c in checks if c.id == "dataset.primary_key").status == "passed":
                key_set = key_jobs.collect_key_set(frame, contract.primary_key)
    if redact:
        for c in checks:
            c.samples = [{"row": s["row"], "value": REDACTED} for s in c.samples]
    fields = [f for f in run.frame.schema.fields if f.name not in run.planner.parsed]
    text = contract_text if contract_text is not None else dump_contract(contract)
    head = {"dataset": contract.dataset, "path": contract_path, "content_sha256": hashlib.sha256(text.encode()).hexdigest(), "owner": contract.owner, "consumers": [{k: v for k, v in (("name", c.name), ("contact", c.contact)) if v} for c in contract.consumers]}
    rows = run.values[run.planner.slots.rows()]
    return RunResult(
        {k: v for k, v in head.items() if v not in (None, [])},
        {"path": "-", "format": "dataframe"} | (source or {}) | {"rows": rows, "columns": len(fields)},
        clock.strftime("%Y-%m-%dT%H:%M:%SZ"),
        int((time.time() - began) * 1000),
        checks,
        {"typed": typed, "columns": [{"name": f.name} | ({"dtype": f.dataType.simpleString()} if typed else {}) for f in fields]},
        run.profile,
        redact,
        key_set,
    )


def _with_rows(run: Run, frame: DataFrame) -> list[CheckResult]:
    """Evaluate on the visible columns, but sample by the source's own row numbers."""
    visible, take = run.frame, run._samples
    run._samples = lambda results: None
    results = run.evaluate()
    run.frame = frame
    take(results)
    run.frame = visible
    return results
