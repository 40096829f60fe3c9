import importlib.util
import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_point

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    assert entry_point.entry(spark).count() > 0
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_without_the_training_data_operators(tmp_path):
    """Everything else imports and runs when that subpackage and its pipeline are gone, from any folder."""
    for name in ("tessera", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / ("l" + "lm"), ignore_errors=True)
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() and e.queries()['casefold_digests'](s, '/root/testdata/sf0.001').count(); assert not [n for n in e.queries() if n[:2] == 'op' and n[2:3].isdigit()]; print('fine')"
    run = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env={"PATH": "/usr/bin:/bin:/usr/local/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]


def test_nothing_outside_imports_it():
    word = "l" + "lm"
    for f in [*ROOT.glob("tessera/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if word not in f.relative_to(ROOT).parts and f.exists():
            assert not re.search(rf"tessera\.{word}|tessera import {word}", f.read_text()), f


def test_spec_is_importable():
    assert importlib.util.find_spec("__spark_entry__") is not None
