"""Exact nearest codes by Hamming distance with incremental multi-index hashing.

A vector's code is the signs of its numbers, ``BITS`` of them. Codes are cut into segments, each with
an index from segment value to codes. A query looks up its own segment values, then all values that
differ in one bit, in two, and so on; after radius r every code within ``segments * (r + 1) - 1`` bits
has been met, for a code farther in every segment is farther in all. A query ends as soon as its kth
best distance is covered by that, so results are exact.

Equal codes are one entry of the index, and equal query codes one query; ids are put in at the end,
of each code the k least, so a vector that a third of all rows repeat makes no larger bucket. The
segment width follows the number of codes, about its logarithm, as the method has it. A radius of a whole
segment meets every code, so the search ends with whole results even where there are fewer than k.

Edge cases: null vectors have no code and are neither found nor queries; null or NaN numbers give a
zero bit; ties go to the smaller id; a query finds itself, as all rows are searched; repeated rows
are found once for each id and code; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import written

BITS = 64
K = 10


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """64-bit code: bit i is set where number i is above zero."""
    powers = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint") for i in range(bits)])
    zero = F.lit(0).cast("bigint")
    mask = F.zip_with(F.slice(vector, 1, bits), powers, lambda x, p: F.when((x > 0) & ~F.isnan(x), p).otherwise(zero))
    return F.aggregate(mask, zero, lambda a, x: a.bitwiseOR(x))


def segments_for(n_codes: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, about log2 of the number of codes less 2.5, 24 at most.

    A value then has about six codes: fewer look-ups than with one code a value, and most of the
    codes met are dropped by the bound inside the join.
    """
    width = min(24, max(4, math.log2(max(n_codes, 2)) - 2.5))
    count = max(1, round(bits / width))
    edges = [round(bits * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND((1 << width) - 1)


def search(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``rows`` (id, code) for each of ``queries`` (query_id, code)."""
    codes = written(rows.where("code IS NOT NULL").select("code").distinct(), "codes")
    n_codes = codes.count()
    parts = segments_for(n_codes, bits)
    index = None
    for number, (first, width) in enumerate(parts):
        one = codes.select(F.lit(number).alias("part"), segment(F.col("code"), first, width).alias("value"), "code")
        index = one if index is None else index.union(one)
    index = written(index, "index")
    # bound: the kth distance found so far, beyond which a code cannot be among the k nearest
    open_ = written(queries.where("code IS NOT NULL").select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(bits)), "queries")
    best, done = None, None
    spark = rows.sparkSession
    widest = max(w for _, w in parts)
    for radius in range(widest + 1):
        probes = None
        for number, (first, width) in enumerate(parts):
            # Every way to flip `radius` of `width` bits: a fixed table, whatever the data.
            masks = spark.createDataFrame([(sum(1 << b for b in c),) for c in combinations(range(width), radius)], "mask bigint")
            value = segment(F.col("query"), first, width).bitwiseXOR(F.col("mask"))
            one = open_.join(F.broadcast(masks)).select("query", "bound", F.lit(number).alias("part"), value.alias("value"))
            probes = one if probes is None else probes.union(one)
        near = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))) <= F.col("bound")
        met = probes.join(index, (probes["part"] == index["part"]) & (probes["value"] == index["value"]) & near)
        met = met.select("query", "code").distinct()
        met = met.select("query", "code", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        every = met if best is None else met.union(best.join(open_, "query", "left_semi")).distinct()
        best = written(_first(every, k), "best")
        covered = len(parts) * (radius + 1) - 1
        found = best.groupBy("query").agg(
            F.count_if(F.col("distance") <= covered).alias("sure"), F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")
        )
        closed = found.where((F.col("sure") >= k) | F.lit(radius == widest)).select("query")
        ready = written(best.join(closed, "query", "left_semi"), "ready")
        done = ready if done is None else done.union(ready)
        bounds = found.select("query", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
        left = open_.join(closed, "query", "left_anti").join(bounds, "query", "left")
        open_ = written(left.select("query", F.coalesce("kth", "bound").alias("bound")), "open")
        if open_.isEmpty():
            break
    return _with_ids(rows, queries, done, k)


def _first(met: DataFrame, k: int) -> DataFrame:
    """The k nearest codes of each query and all that tie with the last of them.

    Ties are kept by distance, since ids decide among them later.
    """
    near = met.groupBy("query", "distance").count()
    upto = Window.partitionBy("query").orderBy("distance")
    last = near.withColumn("before", F.sum("count").over(upto) - F.col("count")).where(F.col("before") < k)
    last = last.groupBy("query").agg(F.max("distance").alias("last"))
    return met.join(last, "query").where("distance <= last").select("query", "code", "distance")


def _with_ids(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    ids = rows.where("code IS NOT NULL").select("code", "id").distinct()
    least = ids.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k).select("code", "id")
    named = found.join(written(least, "ids"), "code").select("query", "id", "distance")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
    asked = queries.where("code IS NOT NULL").select("query_id", F.col("code").alias("query")).distinct()
    return asked.join(written(ranked, "ranked"), "query").select("query_id", "rank", "id", "distance")


def nearest(vectors: DataFrame, k: int = K, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest rows by sign code for all rows whose id is divisible by ``every``."""
    rows = vectors.select(F.col(vec_id).alias("id"), sign_code(F.col(vector)).alias("code"))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    return search(rows, queries, k)
