import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_nothing_else_imports_the_optional_subpackage():
    for f in (ROOT / "siftmesh").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"siftmesh\.llm|from \.llm|import llm", f.read_text()), f


def test_sql_keys_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    from siftmesh.session import Scratch, shared_dir

    s = Scratch(spark, "x")
    table = s.write(spark.range(3).toDF("id"), "t")
    assert table._siftmesh_path.startswith(shared_dir(spark)) and table.count() == 3
    s.drop(table)
