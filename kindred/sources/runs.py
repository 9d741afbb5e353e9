"""A record of each run, written once, whether it ends well or not."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

SCHEMA = "public_id string, command string, status string, started_at timestamp_ntz, ended_at timestamp_ntz, summary_json string, error_summary string"


@dataclass
class Run:
    public_id: str
    summary: dict = field(default_factory=dict)
    error_summary: str | None = None


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


@contextmanager
def recorded(spark: SparkSession, path: str, command: str, prefix: str) -> Iterator[Run]:
    """Appends one row to the table at ``path``. An exception is recorded and goes on."""
    run, start, status = Run(f"{prefix}_{uuid.uuid4().hex}"), _now(), "FAILED"
    try:
        yield run
        status = "SUCCESS"
    except Exception as e:
        run.error_summary = run.error_summary or str(e) or type(e).__name__
        raise
    finally:
        row = (run.public_id, command, status, start, _now(), json.dumps(run.summary), run.error_summary)
        spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(path)
