import os
import subprocess
import sys
import zipfile
from pathlib import Path

from folia import session

ROOT = Path(session.__file__).resolve().parent.parent


def test_lineage_is_cut(spark):
    df = session.cut_lineage(spark.range(10).selectExpr("id * 2 as v"))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().toString()


def test_queries_run_from_any_folder(tmp_path):
    """The package isn't importable for workers by their folder or path: it is shipped."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from folia.session import build_session
from folia.plans import catalog
spark = build_session("local[2]", spark__checkpoint__dir={(tmp_path / "shared").as_uri()!r})
assert catalog.queries()["p3_found"](spark, "/root/testdata/sf0.001").count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True)
    packed = list((tmp_path / "shared" / "packages").rglob("folia.zip"))
    assert packed and "folia/session.py" in zipfile.ZipFile(packed[0]).namelist()


def test_nothing_else_imports_the_training_data_package():
    for path in [*(ROOT / "folia").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "folia.llm" not in path.read_text() and "import llm" not in path.read_text(), path
