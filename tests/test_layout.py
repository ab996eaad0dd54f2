"""The test folders are collected together, as a whole run does."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

TESTS = Path(__file__).parent


def test_no_test_imports_a_conftest():
    wrong = [p for p in TESTS.rglob("*.py") if p.name != Path(__file__).name and "from conftest" in p.read_text()]
    assert not wrong, wrong


def test_all_folders_are_collected():
    command = [sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", "-p", "no:cacheprovider"]
    done = subprocess.run(command, cwd=TESTS.parent, capture_output=True, text=True, env=os.environ | {"PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stdout[-2000:]
    for path in TESTS.rglob("test_*.py"):
        assert path.name in done.stdout, path
