"""Log lines with the run they belong to, on the console and in a file that turns over."""

from __future__ import annotations

import contextvars
import json
import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

MAX_BYTES, BACKUPS = 10 * 1024 * 1024, 5
run_id: contextvars.ContextVar[str] = contextvars.ContextVar("run_id", default="-")
command: contextvars.ContextVar[str] = contextvars.ContextVar("command", default="-")


class _Context(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.run_id, record.command = run_id.get(), command.get()
        return True


class _Line(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "run_id": record.run_id, "command": record.command, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out)


def console_level(verbosity: int, level: str = "WARNING") -> int:
    """More with each -v, less with each -q, than ``level``."""
    steps = [logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG]
    at = steps.index(logging.getLevelName(level.upper()))
    return steps[max(0, min(len(steps) - 1, at + verbosity))]


def configure(folder: Path, verbosity: int = 0, level: str = "WARNING") -> logging.Logger:
    """The library's logger; a second call replaces what the first set up."""
    folder.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("kindred")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    lines = RotatingFileHandler(folder / "kindred.log", maxBytes=MAX_BYTES, backupCount=BACKUPS, encoding="utf-8")
    lines.setFormatter(_Line())
    lines.setLevel(logging.DEBUG)
    console = logging.StreamHandler()
    console.setLevel(console_level(verbosity, level))
    for h in (lines, console):
        h.addFilter(_Context())
        log.addHandler(h)
    log.setLevel(logging.DEBUG)
    return log
