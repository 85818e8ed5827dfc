"""All tests can be collected in one run, with the optional folders or without them."""

import subprocess
import sys
from pathlib import Path

import pytest

TESTS = Path(__file__).resolve().parent


@pytest.mark.parametrize("without", ["", "llm"])
def test_every_module_is_collected(without):
    ignored = [f"--ignore={TESTS / without}"] if without else []
    run = subprocess.run([sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", *ignored], capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
