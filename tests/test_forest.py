"""Trees of all roots at once against the tree of one root at a time."""

import os

import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.plans import trees

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EVERY = [(r, t) for r, names in trees.TREES.items() for t in range(len(names))]
CASES = EVERY if os.environ.get("QUERY_ALL") else [("authors", 7), ("institutions", 2), ("countries", 0)]


@pytest.mark.parametrize("root,tid", CASES)
def test_one_root_of_the_forest_is_its_tree(spark, root, tid):
    graph = queries.order_graph(queries.Tables(spark, SF))
    entity = queries._ROOT[root][0]
    own = trees.forest(graph, root, tid, 1998).filter(F.col("root") == entity).drop("root")
    alone = trees.tree(graph, root, entity, tid, 1998)
    assert sorted(map(repr, own.select(*alone.columns).collect())) == sorted(map(repr, alone.collect()))


def test_pruned_forest(spark):
    graph = queries.order_graph(queries.Tables(spark, SF))
    own = trees.pruned_forest(graph, "institutions", 0, 1998).filter("root = 7").drop("root")
    alone = trees.pruned_tree(graph, "institutions", 7, 0, 1998)
    assert sorted(map(repr, own.select(*alone.columns).collect())) == sorted(map(repr, alone.collect()))
