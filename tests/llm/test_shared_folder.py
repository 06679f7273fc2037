import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
from memloom.session import local_session
from memloom.llm.common import connected_components, shared_folder, written
s = local_session('t', '1', 1)
assert s.conf.get('spark.checkpoint.dir', None) is None
edges = s.createDataFrame([(1, 2), (2, 3), (7, 8)], 'a long, b long')
assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
assert shared_folder(s) == shared_folder(s)
"""


def test_operators_run_without_a_configured_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    subprocess.run([sys.executable, "-c", CODE], env=os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path / "conf")}, check=True, timeout=200)
