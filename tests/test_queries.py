"""Every registered query of the library against its DuckDB SQL."""

import os
import re

import pytest

from corpusloom.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    oracle.same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_queries_without_sql_have_a_brute_force_test():
    folder, tests = os.path.dirname(__file__), ""
    for name in sorted(os.listdir(folder)):
        if name.startswith("test_") and name != "test_queries.py":
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                tests += f.read()
    assert [n for n in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)) if f'"{n}"' not in tests] == []


def test_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in catalogue.QUERIES)
