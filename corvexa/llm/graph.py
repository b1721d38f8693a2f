"""Connected components of links (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvexa.operators import graph

from .common import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of an edge; comp is the smallest node of its component."""
    return ws.save(graph.components(edges, "a", "b").withColumnRenamed("component", "comp"), "components")
