"""Executors need not have the package: only the driver finds it here, after its start and from another folder."""

import os
import subprocess
import sys

from yomibon.session import data_dir

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from yomibon.session import session
import __spark_entry__ as entry
spark = session("local[4]", "foreign", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
try:
    spark.range(1).mapInArrow(lambda batches: [__import__("yomibon")] and batches, "id long").collect()
    print("executors have the package")
except Exception:
    for name, query in sorted(entry.queries().items()):
        if name.startswith("op") or name in ("pipeline", "lattice_costs", "chapter_tokens"):
            print("ran", name, query(spark, sys.argv[2]).count())
"""


def test_executors_without_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, REPO, data_dir("0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert len([name for name in ran if name.startswith("op")]) == 13 and "pipeline" in ran, done.stdout[-500:] + done.stderr[-2000:]
