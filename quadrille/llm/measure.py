"""Recall of the nearest-neighbour search and the share of the nodes that a walk meets, by size of the table.

python -m quadrille.llm.measure 2000 10000 50000 prints a line a size, for random unit vectors of 64 dimensions and the
settings that op3_nearest uses; a folder of tables in place of a number takes its embeddings. 150000:500 takes every 500th
row as a query in place of every 100th, which leaves the graph and each walk as they are.
"""

from __future__ import annotations

import sys
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import neighbours
from quadrille.llm.common import read

#: Every how many rows is a query, unless a size says so.
EVERY = 100


def unit_vectors(spark: SparkSession, rows: int, dims: int = 64, seed: int = 5) -> DataFrame:
    """(vec_id, embedding) of random directions."""
    x = np.random.default_rng(seed).normal(size=(rows, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def recall(frame: DataFrame, k: int = 10, every: int = EVERY) -> dict[str, float]:
    """Recall at k against brute force and the nodes that a walk meets on average; for tables that fit the driver."""
    met: list[int] = []
    sharded = neighbours.sharded

    def counted(*args):
        found = sharded(*args)
        met.append(found.select("shard", "q", "met").distinct().agg(F.sum("met")).first()[0] or 0)
        return found

    neighbours.sharded = counted
    began = time.perf_counter()
    try:
        rows = neighbours.search(frame, F.col("id") % every == 0, k=k).select("query_id", "vec_id").collect()
    finally:
        neighbours.sharded = sharded
    took = time.perf_counter() - began
    known = neighbours.usable(frame, "vec_id", "embedding").toPandas()
    ids, x = known["id"].to_numpy(), np.array(known["vec"].tolist())
    found: dict[int, set[int]] = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = wanted = 0
    for q in np.nonzero(ids % every == 0)[0]:
        d = ((x - x[q]) ** 2).sum(1)
        nearest = [i for i in np.lexsort((ids, d))[: k + 1] if i != q][:k]
        hits += len(found.get(int(ids[q]), set()) & set(ids[nearest].tolist()))
        wanted += len(nearest)
    queries = max(1, int((ids % every == 0).sum()))
    return {"vectors": len(ids), "queries": queries, "recall": hits / max(1, wanted), "met": met[0] / queries, "share": met[0] / queries / max(1, len(ids)), "seconds": took}


def main(sizes: list[str]) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.cleaner.periodicGC.interval", "1min").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for told in sizes:
        size, _, every = told.partition(":")
        frame = unit_vectors(spark, int(size)) if size.isdecimal() else read(spark, size, "embeddings")
        print(told, {n: round(v, 4) for n, v in recall(frame, every=int(every or EVERY)).items()}, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
