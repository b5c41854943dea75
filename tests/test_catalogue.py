import pytest

import __spark_entry__ as entry_module
from lorewell.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, data, same_as_sql, name):
    same_as_sql(catalogue.QUERIES[name](spark, data), catalogue.ORACLES[name])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_nothing_else_imports_the_subpackage():
    import os

    root = os.path.dirname(catalogue.__file__) + "/.."
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "lorewell.llm" not in file.read()
