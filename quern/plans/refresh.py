"""Driver-side control of a refresh: phases in order, retries with backoff, a versioned result."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Attempt:
    operation: str
    number: int
    ok: bool
    error: str = ""


@dataclass
class RetryLog:
    """What happened, as rows for quern.operators.ops.retry_schedule."""

    attempts: list[Attempt] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.operation, a.number, a.ok, a.error) for a in self.attempts], "op string, attempt int, ok boolean, error string")


def delay_seconds(attempt: int, base: float = 60.0, cap: float = 3600.0) -> float:
    return min(base * 2.0 ** min(attempt, 40), cap)


def run_with_retry(operation: str, f: Callable[[], object], log: RetryLog | None = None, most: int = 3, sleep: Callable[[float], None] = time.sleep, notify: Callable[[str], None] | None = None):
    """f's result; after ``most`` failures the last error is raised and told to ``notify``."""
    log = log if log is not None else RetryLog()
    for n in range(1, most + 1):
        try:
            out = f()
        except Exception as e:
            log.attempts.append(Attempt(operation, n, False, f"{type(e).__name__}: {e}"))
            if n == most:
                if notify:
                    notify(f"{operation} failed after {most} attempts: {e}")
                raise
            sleep(delay_seconds(n))
        else:
            log.attempts.append(Attempt(operation, n, True))
            return out


def run_phases(phases: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, str, str]]:
    """(name, success or failed, error) of each; a failed phase does not keep later ones from running."""
    out = []
    for name, f in phases:
        try:
            f()
            out.append((name, "success", ""))
        except Exception as e:  # noqa: BLE001  reported, not hidden
            out.append((name, "failed", f"{type(e).__name__}: {e}"))
    return out


def phase_summary(results: list[tuple[str, str, str]]) -> dict[str, object]:
    bad = [n for n, s, _ in results if s != "success"]
    return {"total": len(results), "success": len(results) - len(bad), "failed": len(bad), "failed_phases": bad, "status": "failed" if bad else "success"}


def system_resources(path: str, least_gb: float = 1.0) -> dict[str, object]:
    """Free disk of the driver's machine; not a distributed operation."""
    free = shutil.disk_usage(path).free / 1e9
    return {"free_gb": free, "status": "healthy" if free >= least_gb else "unhealthy"}
