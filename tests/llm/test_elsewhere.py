"""Executors get the package whatever the driver's working directory."""

import os
import subprocess
import sys


def test_queries_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = (SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "for k in sorted(k for k in q if k.startswith('op') and k[2].isdigit()) + ['pipeline']:\n"
        "    q[k](s, '/root/testdata/sf0.001').count()\n"
        "    print('DONE', k, flush=True)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert said.stdout.count("DONE") == 14, said.stdout + said.stderr[-3000:]
