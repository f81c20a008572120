"""Connected components by label propagation over written edge tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, which cuts lineage."""
    sc = df.sparkSession.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")  # one machine, as in tests
        sc.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_groups(rows: DataFrame, key: list[str], order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run on the rows of some whole groups of key at a time, sorted by order, and on the places where groups begin.

    Groups are bounded, as pages and document pairs are; what a call costs is spread over the groups of a batch.
    """

    def begun(frame: pd.DataFrame) -> np.ndarray:
        return np.flatnonzero(frame["__i"].to_numpy() == 1)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            first = begun(frame)
            if len(first):
                done = pd.concat([*held, frame.iloc[: first[-1]]], ignore_index=True)
                held = []
                if len(done):
                    yield run(done, begun(done))
                frame = frame.iloc[first[-1] :]
            held.append(frame)
        if held and len(rest := pd.concat(held, ignore_index=True)):
            yield run(rest, begun(rest))

    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__i", number).mapInPandas(whole, schema)


def connected_components(nodes: DataFrame, edges: DataFrame, key: list[str], node: str, max_rounds: int = 60) -> DataFrame:
    """nodes with `component`, the smallest node of its component within its key group.

    Each round a node takes the least label among its own, its neighbours' and its label's label,
    so that long chains are halved; it ends when nothing changes. edges: key columns, a, b.
    """
    both = edges.select(*key, "a", "b").union(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(nodes.select(*key, F.col(node).alias("n"), F.col(node).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("n", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("n")).agg(F.min("label").alias("near"))
        jump = labels.select(*key, F.col("n").alias("label"), F.col("label").alias("jump"))
        merged = labels.join(near, [*key, "n"], "left").join(jump, [*key, "label"], "left")
        new = written(merged.select(*key, "n", F.least("label", "near", "jump").alias("label"), (F.least("label", "near", "jump") < F.col("label")).alias("moved")), "labels")
        labels = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"labels still moved after {max_rounds} rounds")
    return nodes.join(labels.select(*key, F.col("n").alias(node), F.col("label").alias("component")), [*key, node])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each one is connected with by edges a to b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def page_components(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, label): nodes with an edge and the least node of their component, for groups of key that are bounded, as pages are.

    edges: key columns, a, b. Some groups at a time are held in a task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = (rows["i"].to_numpy() == 1).cumsum() - 1
        first = np.flatnonzero(rows["i"].to_numpy() == 1)
        value, g = np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), np.concatenate([group, group])
        order = np.lexsort((value, g))
        new = np.append(True, (np.diff(value[order]) != 0) | (np.diff(g[order]) != 0))
        node = np.empty(len(order), np.int64)
        node[order] = new.cumsum() - 1
        value, g = value[order][new], g[order][new]
        label = least_labels(len(value), node[: len(rows)], node[len(rows) :])
        return rows[key].iloc[first[g]].reset_index(drop=True).assign(n=value, label=value[label])

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            first = np.flatnonzero(frame["i"].to_numpy() == 1)
            if len(first):
                done = pd.concat([*held, frame.iloc[: first[-1]]], ignore_index=True)
                held = []
                if len(done):
                    yield run(done)
                frame = frame.iloc[first[-1] :]
            held.append(frame)
        if held and len(rest := pd.concat(held, ignore_index=True)):
            yield run(rest)

    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), f"n {kinds['a']}", f"label {kinds['a']}"])
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*key))  # brings groups together, in any order
    return edges.select(*key, "a", "b", number.alias("i")).mapInPandas(whole, schema)
