import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from strandloom import workspace


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(session(master))
    try:
        assert workspace.shared_folder(session(master, "hdfs://x/shared/")) == "hdfs://x/shared/strandloom-app-1"
    finally:
        workspace._made.pop("hdfs://x/shared/strandloom-app-1", None)


def test_tables_are_kept_and_the_session_is_left_alone(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    kept = workspace.keep(spark.range(5), "numbers")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_workers_get_the_package_from_a_driver_elsewhere(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(workspace.__file__)))
    code = f"""
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
from strandloom.sources import readers
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
open("g.gb", "w").write("LOCUS       M 9 bp\\nFEATURES             Location/Qualifiers\\n     CDS             1..9\\n"
    + " " * 21 + '/locus_tag="A"' + "\\nORIGIN\\n 1 atggcttaa\\n//\\n")
print("rows", readers.read_genbank(spark, "g.gb").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 1" in done.stdout, done.stderr[-2000:]
