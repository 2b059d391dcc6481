"""The entry module in an interpreter of its own, away from the repository."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import importlib.util, pathlib, sys
real = pathlib.Path.glob
def no_jars(self, pattern, **kw):
    if self.name == "jars":
        return iter(())
    return real(self, pattern, **kw)
pathlib.Path.glob = no_jars
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
assert "stopword_filter" in entry.queries() and "nb_multinomial" in entry.oracle_sql()
"""

WORKER = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession, functions as F
from tabloom.functions import text
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
def probe(spark, sf_dir):
    def size(batches):
        import tabloom.functions.text as inside
        for b in batches:
            yield b.assign(n=len(inside.STOP_WORDS), at=inside.__file__)
    return spark.range(4).mapInPandas(size, "id long, n int, at string")
rows = entry._shipping(probe)(spark, "").collect()
assert {r.n for r in rows} == {len(text.STOP_WORDS)} and all("tabloom.zip" in r.at for r in rows), rows
"""


def _run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, REPO], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_import_needs_no_jar(tmp_path):
    _run(HIDDEN, tmp_path)


def test_workers_get_the_package(tmp_path):
    _run(WORKER, tmp_path)
