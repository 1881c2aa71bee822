"""The driver's contract, with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.schema == e.entry(spark).schema
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_parts(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", ".pytest_cache"):
            at = os.path.join(ROOT, name)
            (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "lumenfold" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_an_optional_part_that_lacks_a_library_leaves_the_rest(tmp_path):
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lumenfold")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert not re.search(r"\bllm\b", text.read()), f
