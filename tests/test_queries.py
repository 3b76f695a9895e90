"""Every core query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import compare

from graphloom.plans import graph, more, problems, relational

DATA = "/root/testdata/sf0.001"
NAMES = [n for m in (problems, relational, graph, more) for n in m.QUERIES]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    said = compare.compare(spark, compare.views(DATA), DATA, name)
    assert not said.startswith("FAIL"), said
