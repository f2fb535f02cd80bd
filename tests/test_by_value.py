import os
import subprocess
import sys

from pyspark import cloudpickle

from tagmill.functions.text import fuzzy_names, repair_json

LOAD = "import sys, pyarrow as pa; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); print(f(pa.array({}, {})).to_pylist())"


def elsewhere(function, values, kind):
    """What the function says in a Python that can't import this package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOAD.format(values, kind)], input=cloudpickle.dumps(function), cwd="/", env=env, capture_output=True, timeout=120)
    assert out.returncode == 0, out.stderr.decode()[-500:]
    return out.stdout.decode().strip()


def test_functions_need_no_installed_package(spark):
    assert elsewhere(fuzzy_names(["Finance"]).func, [["Finanse", None], None], "pa.list_(pa.string())") == "[['Finance', None], None]"
    assert elsewhere(repair_json().func, ["{'a': 1", None], "pa.string()") == "['{\"a\": 1}', None]"
