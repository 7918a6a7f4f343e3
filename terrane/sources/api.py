"""Unreliable sources: retries with growing waits, a circuit breaker, dead letters that reach the disk."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..operators.lineage import attach, make_lineage

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


class CircuitOpen(RuntimeError):
    pass


@dataclass
class CircuitBreaker:
    threshold: int = 5
    recovery: float = 60.0
    clock: Callable[[], float] = time.monotonic
    state: str = CLOSED
    failures: int = 0
    opened: float = 0.0

    def call(self, fn: Callable):
        if self.state == OPEN:
            if self.clock() - self.opened <= self.recovery:
                raise CircuitOpen("circuit open")
            self.state = HALF_OPEN
        try:
            out = fn()
        except Exception:
            self.failures += 1
            if self.state == HALF_OPEN or self.failures >= self.threshold:
                self.state, self.opened = OPEN, self.clock()
            raise
        self.state, self.failures = CLOSED, 0
        return out


def with_backoff(fn: Callable, tries: int = 5, base: float = 1.0, most: float = 32.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0, 0.5)):
    """fn's result; each failure but the last waits base * 2^n plus jitter, at most `most`. No tries give None."""
    for n in range(tries):
        try:
            return fn()
        except Exception:
            if n == tries - 1:
                raise
            sleep(min(base * 2**n + jitter(), most))
    return None


@dataclass
class ApiResult:
    run_id: str
    landed: int = 0
    dead_letters: list[dict] = field(default_factory=list)


def ingest_api(spark: SparkSession, endpoint: str, source: str, fetch: Callable[[str], list[dict]], bronze: str, breaker: CircuitBreaker | None = None, tries: int = 5, **waits) -> ApiResult:
    """Fetch, land rows as JSON lines; a lasting failure lands one dead letter (circuit_break or permanent_failure)."""
    breaker, out = breaker or CircuitBreaker(), ApiResult(str(uuid.uuid4()))
    try:
        rows = with_backoff(lambda: breaker.call(lambda: fetch(endpoint)), tries, **waits) or []
    except Exception as e:
        kind = "circuit_break" if isinstance(e, RuntimeError) else "permanent_failure"
        out.dead_letters.append({"endpoint": endpoint, "error": str(e), "timestamp": datetime.now(timezone.utc).isoformat(), "type": kind})
        spark.createDataFrame(out.dead_letters).write.mode("append").json(f"{bronze}/{source}/kind=dead_letter/run_id={out.run_id}")
        return out
    if rows:
        names = list(rows[0])
        every = list(dict.fromkeys(k for r in rows for k in r))
        data = [[None if r.get(k) is None else str(r[k]) for k in every] for r in rows]
        df = spark.createDataFrame(data, ", ".join(f"`{k}` string" for k in every))
        attach(df, make_lineage(source, endpoint, len(rows), names, out.run_id)).drop("run_id").write.mode("append").json(f"{bronze}/{source}/kind=data/run_id={out.run_id}")
        out.landed = len(rows)
    return out
