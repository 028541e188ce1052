import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('NAMES', *q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.rpartition("NAMES")[2].split()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/siftwise", tmp_path / "siftwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = listed(tmp_path)
    assert "q5_region_revenue" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names


def test_names_are_unique_by_number():
    numbers = [n.split("_")[0] for n in listed(ROOT) if n.startswith("op") and n[2].isdigit()]
    assert len(numbers) == len(set(numbers))


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(f"{ROOT}/siftwise"):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}") as text:
                        assert "siftwise.llm" not in text.read()
