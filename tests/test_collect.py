"""The whole test tree collects in one run: no two helper modules share a name."""

import pathlib
import subprocess
import sys

TESTS = pathlib.Path(__file__).parent


def test_every_module_collects():
    run = subprocess.run([sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", "-p", "no:cacheprovider"],
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-3000:]
    for module in TESTS.rglob("test_*.py"):
        assert module.name in run.stdout


def test_module_names_differ():
    names = [p.stem for p in TESTS.rglob("*.py")]
    assert len(names) == len(set(names))
