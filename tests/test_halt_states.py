"""Halting over all vertices of G1, odd ids as well as the even ones that q13 returns."""

import os

import pytest

from bspgraph import queries
from bspgraph import testgraphs as tg

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_vertices(spark):
    graph = tg.g1(spark, SF)
    reached = {r.dst for r in graph.edges.where("src = 'S1'").select("dst").collect()}
    want = {}
    for r in graph.vertices.select("id").collect():
        even = int(r.id[1:]) % 2 == 0
        want[r.id] = (even, (2 if r.id in reached else 1) if even else 3)
    assert {r.id: (r.halted, r.last_computed) for r in queries.halt_states(spark, SF).collect()} == want
    assert {last for _, last in want.values()} == {1, 2, 3}
