"""Sinks beside the reports: logs, debug and emergency reports, archives, and their checks."""

from __future__ import annotations

import contextlib
import json
import logging
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from docloom.operators import report

MESSAGE_LIMIT = 120
DEBUG_LIMIT = 60
#: Sections of a report and the type of what they hold.
REPORT_FIELDS = {"scan_id": str, "timestamp": str, "summary": dict, "checks": list}


class JsonLines(logging.Formatter):
    """A log record as one JSON line; messages are cut."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "message": record.getMessage()[:MESSAGE_LIMIT]}
        return json.dumps(row | getattr(record, "data", {}), ensure_ascii=False)


class Forward(logging.Handler):
    """Hands warnings and errors to a listener, as a progress view does."""

    def __init__(self, listener: Callable[[str, str], None]):
        super().__init__(logging.WARNING)
        self.listener = listener

    def emit(self, record: logging.LogRecord) -> None:
        self.listener(record.levelname, record.getMessage()[:MESSAGE_LIMIT])


def debug_report(sections: dict[str, DataFrame], path: str, exempt: tuple[str, ...] = ("pattern",)) -> dict:
    """Debug tables with strings of at most 60 characters."""
    return report.write_json_report(sections, path, DEBUG_LIMIT, exempt)


@contextlib.contextmanager
def emergency_report(path: str, done: dict) -> Iterator[None]:
    """Write what is done if the block fails, then raise on; a minimal report if that fails too."""
    try:
        yield
    except Exception as e:
        minimal = {"error": f"{type(e).__name__}: {e}"[:MESSAGE_LIMIT]}
        try:
            text = json.dumps(minimal | {"partial": done}, ensure_ascii=False)
        except (TypeError, ValueError):
            text = json.dumps(minimal)
        Path(path).write_text(text)
        raise


def validate_report(data: dict, fields: dict[str, type] | None = None) -> list[str]:
    """What is wrong with a report: absent fields and wrong types."""
    wanted = REPORT_FIELDS if fields is None else fields
    missing = [f"{k} is missing" for k in wanted if k not in data]
    return missing + [f"{k} is no {t.__name__}" for k, t in wanted.items() if k in data and not isinstance(data[k], t)]


def newest_reports(folder: str) -> dict[str, Path]:
    """The newest file by extension."""
    out: dict[str, Path] = {}
    for p in sorted(Path(folder).iterdir(), key=lambda p: (p.stat().st_mtime, p.name)):
        if p.is_file():
            out[p.suffix] = p
    return out


def archive(folder: str, target: str) -> list[str]:
    """Zip of the newest report of every extension; returns the names in it."""
    files = newest_reports(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files.values():
            z.write(p, p.name)
    return sorted(p.name for p in files.values())
