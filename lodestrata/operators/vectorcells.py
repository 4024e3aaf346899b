"""Exact nearest vectors without a full scan: k-means cells, read nearest first while the triangle inequality allows a hit.

Every vector lies in the cell of its nearest centre, which is a folder, with its distance to that centre; a cell's smallest and
largest such distances are kept. By the triangle inequality a vector x of a cell with centre c is at least |d(q, c) - d(x, c)|
away from a query q, so a cell whose bound is beyond the k-th distance found so far can't hold a nearer one, and in a cell that
is read only vectors at fitting distances from the centre are looked at, which the files' statistics know as well. Cells are read
in order of their bounds, in waves that double, until the next bound passes the k-th distance. The answer is that of a scan.

Scale. Centres are fitted on a sample of SAMPLE vectors at most, those with the smallest hashes of their ids; this only decides how
much is read. All vectors are assigned in the scan's partitions and exchanged once, a large cell over several tasks. There are
CELLS cells at most, whose centres the driver knows; a wave brings back k rows.

Defined results: vectors that are null have no distance and are never found; ties go to the smaller id; with fewer than k vectors
that the filter leaves, all of them are found; an empty table has no cells.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lodestrata.operators.search import l2
from lodestrata.sources import versions
from lodestrata.sources.storage import stored

#: Vectors that centres are fitted on, cells, and rounds of fitting, at most.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 20
#: What rounding may take off a bound, relative to the distances.
SLACK = 1e-9


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's k-means, begun with the first different vectors; at most `cells` centres."""
    _, first = np.unique(sample, axis=0, return_index=True)
    found = sample[np.sort(first)[:cells]].copy()
    nearest = None
    for _ in range(ROUNDS):
        now = _nearest(sample, found)
        if nearest is not None and (now == nearest).all():
            break
        nearest = now
        count = np.bincount(nearest, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, nearest, sample)
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


def _nearest(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    out, norm = np.empty(len(vectors), np.int64), (found**2).sum(1)
    for i in range(0, len(vectors), 4096):
        out[i : i + 4096] = (norm - 2 * vectors[i : i + 4096] @ found.T).argmin(1)
    return out


def build(vectors: DataFrame, path: str, id: str = "vec_id", cells: int | None = None) -> int:
    """Writes the cells of vectors (id, embedding, others) below path; gives their number."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull())
    n = rows.count()
    drawn = rows.select("embedding", id).orderBy(F.xxhash64(id), id).limit(SAMPLE).select("embedding").toArrow()["embedding"].to_pylist()
    sample = np.array(drawn, np.float64) if drawn else np.zeros((0, 1))
    found = centres(sample, cells or max(1, min(CELLS, round(n**0.5)))) if n else sample
    sent, place = spark.sparkContext.broadcast(found), rows.columns.index("embedding")
    schema = StructType([*rows.schema.fields]).add("to_centre", DoubleType()).add("cell", IntegerType())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            cell = _nearest(x, sent.value)
            far = np.sqrt(((x - sent.value[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(cell, pa.int32())], schema.names)

    dealt = rows.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64(id), F.lit(8))).sortWithinPartitions("cell", "to_centre")
    after, _ = versions.newest(spark, path)
    data = f"{path}/cells-{after + 1}-{uuid.uuid4().hex[:12]}"
    dealt.write.partitionBy("cell").parquet(data)
    stats = []
    if n:
        kept = spark.read.schema(schema).parquet(data).groupBy("cell").agg(F.count("*").alias("n"), F.min("to_centre").alias("low"), F.max("to_centre").alias("high"))
        stats = [{"cell": r["cell"], "n": r["n"], "low": r["low"], "high": r["high"], "centre": found[r["cell"]].tolist()} for r in kept.collect()]
    versions.commit(spark, path, after, {"data": data, "schema": schema.json(), "cells": stats})
    return len(stats)


def cells_of(vectors: DataFrame, id: str = "vec_id") -> str:
    """The path of the cells of a table of vectors; built if the shared folder has none of these files as they are."""
    path = versions.beside(vectors, "vector-cells", id)
    if not versions.newest(vectors.sparkSession, path)[0]:
        try:
            build(vectors, path, id)
        except versions.Conflict:
            pass  # another session has just built them
    return path


def knn(spark: SparkSession, path: str, query: Sequence[float], k: int, where: Column | None = None, id: str = "vec_id") -> tuple[DataFrame, int]:
    """The k nearest vectors (all columns and distance), nearest first, among those that `where` leaves; and how many cells were read."""
    said = versions.newest(spark, path)[1]
    schema = StructType.fromJson(json.loads(said["schema"]))
    q = np.array(query, np.float64)
    to = {c["cell"]: float(np.sqrt(((q - np.array(c["centre"])) ** 2).sum())) for c in said["cells"]}
    slack = lambda *d: SLACK * (1 + sum(d))
    bound = {c["cell"]: max(0.0, to[c["cell"]] - c["high"], c["low"] - to[c["cell"]]) - slack(to[c["cell"]], c["high"]) for c in said["cells"]}
    left = sorted(said["cells"], key=lambda c: (bound[c["cell"]], to[c["cell"]]))
    rows = spark.read.schema(schema).parquet(said["data"])
    measured = l2(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    best: list[DataFrame] = []
    limit, found, read, wave = float("inf"), [], 0, 1
    while left and bound[left[0]["cell"]] <= limit:
        now, held = [], 0
        while left and bound[left[0]["cell"]] <= limit and (len(now) < wave or held < k and limit == float("inf")):
            held += left[0]["n"]
            now.append(left.pop(0)["cell"])
        part = rows.where(F.col("cell").isin(now))
        if limit < float("inf"):  # of these cells only the shells that can hold a nearer vector
            shell = [(F.col("cell") == c) & F.col("to_centre").between(to[c] - limit - slack(to[c], limit), to[c] + limit + slack(to[c], limit)) for c in now]
            part = part.where(reduce(Column.__or__, shell))
        part = part if where is None else part.where(where)
        top = stored(part.withColumn("distance", measured).orderBy("distance", id).limit(k), "nearest")
        best.append(top)
        found = sorted(found + [r["distance"] for r in top.select("distance").collect()])[:k]  # k numbers
        limit = found[-1] if len(found) == k and k else float("inf")
        read, wave = read + len(now), 2 * wave
    if not best:
        best = [spark.createDataFrame([], schema).withColumn("distance", F.lit(None).cast("double"))]
    return reduce(DataFrame.unionByName, best).drop("to_centre", "cell").orderBy("distance", id).limit(k), read
