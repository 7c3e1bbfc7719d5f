"""A vector store in cells around centroids, searched exactly without reading most of it.

No row x of a cell scores more for a query q than q·c + |q| R, where c is the cell's centroid and R the largest distance of
its rows from that: q·x = q·c + q·(x - c). A search reads the cells of the largest bounds until it has k rows, and then only
cells whose bound is not below the k-th best score. Cells are folders, so the others are not opened. How well rows gather
around centroids decides how much is read, never what is found.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.functions import vectors as V
from lumenweft.operators import search
from lumenweft.session import delete
from lumenweft.sources import commits

#: Rows of a cell about, the most cells (their centroids are held by the driver), and rows that centroids are fitted on.
CELL_ROWS, MOST_CELLS, FIT_ROWS = 4096, 4096, 100_000
ITERATIONS, SEED = 8, 5
#: Relative slack of a bound, for rounded sums.
SLACK = 1e-9


def _log(path: str) -> str:
    return f"{path}/_log"


def build_cells(store: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> dict:
    """Writes the rows of ``store`` in cells at ``path`` and publishes them as a version; returns that.

    ValueError if there are no rows, or a vector is null, not finite, of length zero or of another width. Centroids are fitted
    (k-means) on FIT_ROWS rows or so, drawn by a hash of the id; every row is in the cell of its nearest one. All columns stay.
    """
    spark = store.sparkSession
    v = F.col(vector)
    facts = store.agg(F.count("*").alias("n"), F.count_if(~V.valid(v)).alias("invalid"), F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most")).first()
    if not facts.n or facts.invalid or facts.least != facts.most:
        raise ValueError(f"The vectors can't be put in cells: {facts.asDict()}")
    wanted = cells or min(MOST_CELLS, max(1, math.ceil(facts.n / CELL_ROWS)))
    known = store.withColumn("_vector", array_to_vector(V.doubles(v)))
    share = min(1.0, FIT_ROWS / facts.n)
    sample = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("_vector")
    model = KMeans(k=max(2, wanted), maxIter=ITERATIONS, initSteps=2, seed=SEED, featuresCol="_vector", predictionCol="cell").fit(sample) if wanted > 1 else None
    centres = [c.tolist() for c in model.clusterCenters()] if model else [[0.0] * facts.most]
    placed = (model.transform(known) if model else known.withColumn("cell", F.lit(0))).drop("_vector")
    folder = f"{path}/rows-{uuid.uuid4().hex}"
    placed.repartition("cell").write.partitionBy("cell").parquet(folder)
    # What was written is what radii are taken from.
    table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    rows = spark.read.parquet(folder).join(F.broadcast(table), "cell")
    distance = F.sqrt(V.total(F.zip_with(V.doubles(v), F.col("centre"), lambda a, b: (a - b) * (a - b))))
    radii = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max(distance).alias("radius"), F.max(V.norm(v)).alias("norm")).collect()}
    entry = {"rows": folder, "n": facts.n, "width": facts.most, "cells": [{"cell": k, "n": r.n, "radius": r.radius, "norm": r.norm, "centre": centres[k]} for k, r in sorted(radii.items())]}
    return commits.transact(spark, _log(path), lambda number, before: entry | {"number": number})


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the last ``keep`` versions; returns how many went."""
    return sum(delete(spark, old["rows"]) for old in commits.forget(spark, _log(path), keep))


def bounds(version: dict, query: list[float]) -> dict[int, float]:
    """What no row of each cell exceeds."""
    length = math.sqrt(sum(x * x for x in query))
    out = {}
    for c in version["cells"]:
        most = min(sum(a * b for a, b in zip(query, c["centre"], strict=True)) + length * c["radius"], length * c["norm"])
        out[c["cell"]] = most + SLACK * (abs(most) + length * (c["radius"] + c["norm"]))
    return out


def _cells_to_read(spark: SparkSession, version: dict, query: list[float], k: int, id_col: str, vector: str) -> list[int]:
    most = bounds(version, query)
    order = sorted(most, key=lambda c: (-most[c], c))
    sizes, first, held = {c["cell"]: c["n"] for c in version["cells"]}, [], 0
    while order[len(first) :] and held < k:
        held += sizes[order[len(first)]]
        first.append(order[len(first)])
    if held < k:
        return order
    rows = spark.read.parquet(version["rows"]).where(F.col("cell").isin(first))
    # Clipping could hide how far apart scores are, so they are taken as they come.
    scores = rows.select(V.dot(F.col(vector), F.array(*(F.lit(float(q)) for q in query))).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.min("s")).first()
    return sorted(c for c in order if most[c] >= scores[0])


def vector_top_k(spark: SparkSession, path: str, query: list[float], k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the store at ``path`` of the largest dot product with ``query``, ties by id, as ``search.vector_top_k`` finds
    them over all rows. ValueError if there is no store there, or the query is of another width or not finite."""
    _, version = commits.latest(spark, _log(path))
    if version is None:
        raise ValueError(f"There is no store in cells at {path}.")
    if len(query) != version["width"] or not all(math.isfinite(x) for x in query):
        raise ValueError("The query is no vector of the store's width.")
    cells = _cells_to_read(spark, version, [float(x) for x in query], k, id_col, vector)
    return search.vector_top_k(spark.read.parquet(version["rows"]).where(F.col("cell").isin(cells)), query, k, id_col, vector).drop("cell")


def share_read(spark: SparkSession, path: str, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """The share of the store's rows that a search reads in the end."""
    _, version = commits.latest(spark, _log(path))
    cells = set(_cells_to_read(spark, version, [float(x) for x in query], k, id_col, vector))
    return sum(c["n"] for c in version["cells"] if c["cell"] in cells) / version["n"]
