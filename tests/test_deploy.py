"""The entry module works from any folder: Python workers need not find the package."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_udfs_run_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as e
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        row = e.queries()["pearson"](spark, "/root/testdata/sf0.001").first()
        n = e.queries()["rolling_time_median"](spark, "/root/testdata/sf0.001").count()
        print("RESULT", row["status"], n)
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "RESULT ok 1000" in out.stdout, out.stderr[-2000:]
