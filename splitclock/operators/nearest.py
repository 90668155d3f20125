"""Exact nearest neighbours of all points, by the sum of differences in three dimensions, in cells that are split at medians.

1. Equal points are one point with its ``k + 1`` smallest ids: at equal distance the smallest ids are nearest, so no other id of
   the point can be among anybody's nearest. A stack of equal points of any size is one row.
2. The points are split into cells at medians, the longest side first. A bounded sample of the points that lie in cells with over
   ``cell`` points finds the next cuts; then the points are counted again, until no cell holds more. An outlier changes one
   median by one place, and a dense cluster is simply cut more often. The tree has at most ``MOST`` leaves; a larger table has
   larger cells.
3. In its own cell a point finds its ``k`` nearest so far. The distance of the last is its radius, and only cells whose box is nearer
   than that can hold a nearer point: the tree names them, and the point visits them. A cell with few ids bounds nothing; its points
   take their radius from the far corners of the boxes around.
4. A cell that very many points visit is copied to several tasks, each with a part of the visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitclock.session import stored

SAMPLE = 100_000
MOST = 1 << 16
VISITORS = 4096
SIDES = ("x", "y", "z")


class Tree:
    """Cuts at medians: inner nodes have a side, a value and two children; a leaf has a cell number. Points with a coordinate up to
    the value go left. It has at most 2 * `MOST` nodes, so it may travel with a task."""

    def __init__(self) -> None:
        self.side, self.value, self.left, self.right, self.cell = [-1], [0.0], [-1], [-1], [0]
        self.cells = 1

    def split(self, points: np.ndarray, found: np.ndarray, counts: dict[int, int], most: int) -> bool:
        """Cut the leaves whose points, by their count, are over ``most``; ``points`` is a sample of them, in cells ``found``."""
        leaf_of = {c: n for n, c in enumerate(self.cell) if c >= 0}
        todo = [(leaf_of[c], points[found == c], n) for c, n in counts.items() if n > most]
        grown = False
        while todo:
            node, own, n = todo.pop()
            if n <= most or self.cells >= MOST or len(own) < 2:
                continue
            spread = np.ptp(own, axis=0)
            side = int(np.argmax(spread))
            if not spread[side] > 0:
                continue
            ordered = np.sort(own[:, side])
            value = float(ordered[(len(ordered) - 1) // 2])
            if value == ordered[-1]:  # over half are the largest: cut below them
                value = float(ordered[np.searchsorted(ordered, value) - 1])
            below = own[:, side] <= value
            kids = []
            for c in (self.cell[node], self.cells):
                kids.append(len(self.side))
                self.side.append(-1), self.value.append(0.0), self.left.append(-1), self.right.append(-1), self.cell.append(c)
            self.cells += 1
            self.side[node], self.value[node], self.left[node], self.right[node], self.cell[node] = side, value, *kids, -1
            todo += [(kids[0], own[below], n * below.mean()), (kids[1], own[~below], n * (1 - below.mean()))]
            grown = True
        return grown

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.side, self.value, self.left, self.right, self.cell))


def _cells(tree: tuple[np.ndarray, ...], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    side, value, left, right, cell = tree
    node = np.zeros(len(points), np.int64)
    open_ = np.flatnonzero(side[node] >= 0)
    while len(open_):
        at = node[open_]
        node[open_] = np.where(points[open_, side[at]] <= value[at], left[at], right[at])
        open_ = open_[side[node[open_]] >= 0]
    return cell[node]


def _near_cells(boxes: np.ndarray, point: np.ndarray, radius: float) -> np.ndarray:
    """Which boxes (low and high corner) come as near as ``radius``."""
    gap = np.maximum(0.0, np.maximum(boxes[:, :3] - point, point - boxes[:, 3:])).sum(axis=1)
    return np.flatnonzero(gap <= radius)


def _top(query: np.ndarray, points: np.ndarray, ids: list, most: int) -> Iterator[list[tuple[float, str]]]:
    """The ``most`` nearest (distance, id) of each query point among the points' ids."""
    for at in range(0, len(query), 256):
        far = np.abs(query[at : at + 256, None, :] - points[None, :, :])
        far = far[:, :, 0] + far[:, :, 1] + far[:, :, 2]
        for row in far:
            if len(row) > most:
                near = np.flatnonzero(row <= np.partition(row, most - 1)[most - 1])
            else:
                near = range(len(row))
            yield sorted((float(row[p]), i) for p in near for i in ids[p])[:most]


def nearest(rows: DataFrame, k: int = 10, cell: int = 1024) -> DataFrame:
    """(id, other, distance, rank) for ``rows`` (id, x, y, z): the ``k`` nearest others of each id, ties by id. Rows with a NULL
    coordinate have and are no neighbours; fewer than ``k + 1`` ids have fewer neighbours."""
    spark = rows.sparkSession
    real = rows.where("id IS NOT NULL").select("id", *[F.col(c).cast("double").alias(c) for c in SIDES]).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x + y + z)")
    real = real.withColumns({c: F.col(c) + F.lit(0.0) for c in SIDES})
    place = F.row_number().over(W.partitionBy(*SIDES, "_s").orderBy("id"))
    # The smallest ids of a stack: first of its parts, then of what they leave.
    few = real.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", place).where(F.col("_r") <= k + 1)
    few = few.withColumn("_s", F.lit(0)).withColumn("_r", place).where(F.col("_r") <= k + 1)
    points = stored(few.groupBy(*SIDES).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    tree, placed = Tree(), points
    while True:
        arrays = tree.arrays()

        def assign(frames: Iterator[pd.DataFrame], arrays=arrays) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(cell=_cells(arrays, f[list(SIDES)].to_numpy()))

        placed = points.mapInPandas(assign, "x double, y double, z double, ids array<string>, cell long")
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = max(cell, 2 * sum(counts.values()) // MOST)
        over = {c: n for c, n in counts.items() if n > most}
        if not over:
            break
        held = placed.where(F.col("cell").isin(list(over))) if len(over) < 1000 else placed
        share = min(1.0, SAMPLE / sum(counts.values() if held is placed else over.values()))
        sample = held.select(*SIDES, "cell").where(F.pmod(F.xxhash64(*SIDES, F.lit(tree.cells)), F.lit(1 << 20)) < share * (1 << 20)).toPandas()
        if not tree.split(sample[list(SIDES)].to_numpy(), sample["cell"].to_numpy(), over, most // 2):
            break
    placed = stored(placed)
    corners = [F.min(c).alias(f"l{c}") for c in SIDES] + [F.max(c).alias(f"h{c}") for c in SIDES]
    known = placed.groupBy("cell").agg(*corners, F.sum(F.size("ids")).alias("n")).toPandas()
    boxes, numbers, holds = known.drop(columns=["cell", "n"]).to_numpy(), known["cell"].to_numpy(), known["n"].to_numpy()
    want = k + 1  # an id finds itself too

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        at, ids = frame[list(SIDES)].to_numpy(), [list(x) for x in frame["ids"]]
        home, out = frame["cell"].iloc[0], []
        for point, found in zip(at, _top(at, at, ids, want), strict=True):
            if len(found) == want:
                radius = found[-1][0]
            else:  # the far corners of the nearest boxes that hold enough together
                corner = np.maximum(np.abs(point - boxes[:, :3]), np.abs(boxes[:, 3:] - point)).sum(axis=1)
                order = np.argsort(corner, kind="stable")
                enough = np.searchsorted(np.cumsum(holds[order]), want)
                radius = corner[order[min(enough, len(order) - 1)]]
            out += [(*point, c, [], []) for c in numbers[_near_cells(boxes, point, radius * (1 + 1e-12))] if c != home]
            out.append((*point, -1, [i for _, i in found], [d for d, _ in found]))
        return pd.DataFrame(out, columns=[*SIDES, "visits", "others", "far"])

    schema = "x double, y double, z double, visits long, others array<string>, far array<double>"
    first = stored(placed.groupBy("cell").applyInPandas(own, schema))
    visits = first.where("visits >= 0").select(*SIDES, F.col("visits").alias("cell"))
    parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*SIDES), F.col("parts")).cast("int")
    visits = stored(visits.join(parts, "cell").select(*SIDES, "cell", part.alias("part")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    homes = placed.join(parts, "cell").select(*SIDES, "ids", F.col("cell").alias("home"), every.alias("copy"))

    def visit(queries: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        at, ids, out = frame[list(SIDES)].to_numpy(), [list(x) for x in frame["ids"]], []
        query = queries[list(SIDES)].to_numpy()
        for point, found in zip(query, _top(query, at, ids, want), strict=True):
            out.append((*point, -1, [i for _, i in found], [d for d, _ in found]))
        return pd.DataFrame(out, columns=[*SIDES, "visits", "others", "far"])

    more = visits.groupBy("cell", "part").cogroup(homes.groupBy("home", "copy")).applyInPandas(visit, schema)
    near = first.where("visits < 0").unionAll(more)
    near = near.groupBy(*SIDES).agg(F.flatten(F.collect_list(F.arrays_zip("far", "others"))).alias("all"))
    near = near.select(*SIDES, F.slice(F.array_sort("all"), 1, want).alias("near"))
    each = real.join(near, list(SIDES)).select("id", F.slice(F.filter("near", lambda n: n["others"] != F.col("id")), 1, k).alias("near"))
    found = each.select("id", F.posexplode("near").alias("p", "n"))
    return found.select("id", F.col("n.others").alias("other"), F.col("n.far").alias("distance"), (F.col("p") + 1).alias("rank"))
