"""Workers that cannot import this repository: every query ships what it needs."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import os, sys
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
     .config("spark.checkpoint.dir", os.path.join(os.getcwd(), "shared")).getOrCreate())
s.sparkContext.setLogLevel("ERROR")
def blind(batches):
    try:
        import quakes
        raise RuntimeError("workers see the repository")
    except ModuleNotFoundError:
        yield from batches
assert s.range(3).mapInArrow(blind, "id long").count() == 3
sys.path.insert(0, {root!r})  # the driver alone
import __spark_entry__
done = 0
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(s, {sf!r}).count() > 0, name
        done += 1
print("queries", done)
"""


def test_all_queries_from_another_folder():
    where = tempfile.mkdtemp(prefix="off-repo-")
    script = os.path.join(where, "run.py")
    with open(script, "w") as f:
        f.write(RUN.format(root=ROOT, sf="/root/testdata/sf0.001"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, script], cwd=where, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "queries 14" in done.stdout
