"""Connected components of links between long nodes; small tables of links in one task.

A star step is some eight stages, whatever the number of links, and the driver keeps
account of each of their tasks. Links that one task can hold are joined there instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.graph import edge_table, star_steps
from .shared import rows_of

__all__ = ["IN_TASK", "components", "least_reached"]

#: Links that one task joins: 4 MB. More of them go through star steps.
IN_TASK = 1 << 18


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, the least node that each reaches) over the links ``a[i]``, ``b[i]``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[left], root[right]), np.minimum(root[left], root[right])
        if (high == low).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(node, component) for each node with a link to another; component is its least node."""
    links = edge_table(edges)
    if rows_of(links) > in_task:
        return star_steps(links)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])

    def run(batches):
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
        if held:
            found = least_reached(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=schema.names)

    return links.coalesce(1).mapInArrow(run, schema)
