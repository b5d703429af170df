import json
import logging

import pytest

from docloom.sources import sinks


def test_log_lines():
    heard = []
    record = logging.LogRecord("x", logging.ERROR, "f", 1, "y" * 300, None, None)
    assert len(json.loads(sinks.JsonLines().format(record))["message"]) == 120
    sinks.Forward(lambda level, message: heard.append((level, len(message)))).emit(record)
    assert heard == [("ERROR", 120)]


def test_emergency_and_validation(tmp_path):
    path = f"{tmp_path}/e.json"
    with pytest.raises(RuntimeError), sinks.emergency_report(path, {"files": 3}):
        raise RuntimeError("phase failed")
    assert json.loads(open(path).read())["partial"] == {"files": 3}
    with pytest.raises(RuntimeError), sinks.emergency_report(path, {"files": object()}):
        raise RuntimeError("again")
    assert "partial" not in json.loads(open(path).read())
    assert sinks.validate_report({"scan_id": 1, "timestamp": "", "summary": {}}) == ["checks is missing", "scan_id is no str"]


def test_archive(tmp_path):
    (tmp_path / "r").mkdir()
    for name in ("a.json", "b.json", "c.md"):
        (tmp_path / "r" / name).write_text(name)
    import os

    os.utime(tmp_path / "r" / "a.json", (1, 1))
    assert sinks.archive(f"{tmp_path}/r", f"{tmp_path}/z.zip") == ["b.json", "c.md"]
