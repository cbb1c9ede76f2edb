"""Operator 3: exact top-k search by distributed histogram selection.

All scores are computed, by blocks of candidates against blocks of queries. A first pass counts,
for every query, scores by coarse ranges; the range that holds the kth score is counted again in
finer ranges, until each kth score is known. A last pass keeps the scores above it, and of those
equal to it the smallest ids.

A block sends counts only from its best score down to where it alone has enough, which the kth
score can't be below. Vectors that are null or hold null or non-finite components take no part.
Components missing in the shorter of two vectors count as 0. Scores beyond 2**61 in size are
held there. Rows with a repeated id are queries and candidates of their own; rows with a
null id are candidates with the largest id of ties. Fewer candidates than k are all returned; empty
tables give empty results. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialogmeter.llm.store import ship, stored

CANDIDATES, QUERIES = 2048, 1024
#: Ranges of a histogram pass.
BINS = 2048
SCALE = 64
LARGEST = 2**61


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) with v the components times ``SCALE``, rounded down, of the vectors that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return df.where(x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double")).alias("v")
    ).withColumn("row", F.monotonically_increasing_id())


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from a list column, filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = np.asarray(vectors.offsets)
    flat = np.asarray(vectors.values)
    lengths = np.diff(ends)
    out = np.zeros((len(vectors), width))
    at = np.repeat(np.arange(len(vectors)), lengths)
    out[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat[ends[0] : ends[-1]]
    return out


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as 64-bit integers."""
    bound = queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0)
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    products = exact(queries).dot(exact(candidates).T)
    return np.clip(products, -LARGEST, LARGEST).astype(np.int64)


def blocks(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries dealt to the cells (c, q) of a grid of candidate and query blocks."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("m")).first()
    n_blocks, m_blocks = max(1, -(-counts.n // CANDIDATES)), max(1, -(-counts.m // QUERIES))
    place = F.xxhash64("row")
    cells = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = rows.select(F.col("row").alias("c_row"), F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.pmod(place, F.lit(n_blocks)).cast("int").alias("c"), cells("q", m_blocks))
    queries = rows.where(F.col("id") % every == 0).select(
        "row", "id", "v", F.pmod(place, F.lit(m_blocks)).cast("int").alias("q"), cells("c", n_blocks)
    )
    return candidates, queries


def _cell(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(scores, mask of a query beside itself) of a cell's queries and candidates."""
    width = max((n.as_py() or 0 for v in (left["v"], right["c_v"]) for n in [pc.max(pc.list_value_length(v))]), default=0)
    score = scores_of(matrix(left["v"], width), matrix(right["c_v"], width))
    own = left["row"].to_numpy()[:, None] == right["c_row"].to_numpy()[None, :]
    return score, own


def _histograms(width: int, bins: int):
    """Per cell: how many scores of each query lie in each range from its ``low`` up, best first until ``need`` are there."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        score, own = _cell(left, right)
        low, need = left["low"].to_numpy(), left["need"].to_numpy()
        place = (score - low[:, None]) // width
        place[own | (score < low[:, None]) | (place >= bins)] = -1
        rows, at, n = [], [], []
        for i in range(len(place)):
            counts = np.bincount(place[i] + 1, minlength=bins + 1)[1:]
            found = np.flatnonzero(counts)[::-1]
            if len(found):
                enough = int(np.searchsorted(np.cumsum(counts[found]), need[i])) + 1
                found = found[:enough]
                rows.append(np.full(len(found), left["row"][i].as_py(), np.int64))
                at.append(found)
                n.append(counts[found])
        return pa.table({"row": _join(rows), "bin": _join(at), "n": _join(n)})

    return run


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _selection():
    """Per cell: each query's scores above its kth, and the first ``need`` ids of those equal to it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        score, own = _cell(left, right)
        kth, need, known = left["low"].to_numpy(), left["need"].to_numpy(), left["known"].to_numpy(zero_copy_only=False)
        row, owner = right["c_row"].to_numpy(), left["row"].to_numpy()
        last = np.iinfo(np.int64).max
        ids = right["c_id"].fill_null(last).to_numpy()
        order = np.lexsort((row, ids))
        out: dict[str, list[np.ndarray]] = {"query_row": [], "row": [], "score": []}
        for i in range(len(score)):
            mine = ~own[i]
            if known[i]:
                above = np.flatnonzero(mine & (score[i] > kth[i]))
                equal = order[(mine & (score[i] == kth[i]))[order]][: need[i]]
                found = np.concatenate([above, equal])
            else:
                found = np.flatnonzero(mine)
            out["query_row"].append(np.full(len(found), owner[i], np.int64))
            out["row"].append(row[found])
            out["score"].append(score[i][found])
        return pa.table({k: _join(v) for k, v in out.items()})

    return run


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    rows = stored(quantised(df, id_col, vector_col), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    longest = rows.agg(F.max(norm).alias("n")).first().n or 0.0
    bound = int(min(longest * (1 + 1e-9) + 1, float(LARGEST)))
    candidates, queries = blocks(rows, every)
    width = 1
    while 2 * bound + 1 > BINS * width:
        width *= BINS
    # The topmost range starts at -bound; each pass divides the range of the kth score by BINS.
    state = rows.where(F.col("id") % every == 0).select(
        "row", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("known")
    )
    while True:
        state = stored(state, "topk-state")
        left = queries.join(state.withColumnRenamed("row", "s_row"), queries["row"] == F.col("s_row")).drop("s_row").where("known")
        counted = left.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(
            _histograms(width, BINS), "row long, bin long, n long"
        ).groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("row").orderBy(F.col("bin").desc())
        counted = counted.join(state.select(F.col("row").alias("s_row"), "need"), counted["row"] == F.col("s_row")).drop("s_row")
        down_to = counted.withColumn("with_bin", F.sum("n").over(down)).where("with_bin >= need and with_bin - n < need").select(
            F.col("row").alias("d_row"), "bin", (F.col("need") - F.col("with_bin") + F.col("n")).alias("still")
        )
        state = state.join(down_to, state["row"] == down_to["d_row"], "left").select(
            "row", F.coalesce(F.col("low") + F.col("bin") * width, F.col("low")).alias("low"),
            F.coalesce("still", "need").alias("need"), (F.col("known") & F.col("bin").isNotNull()).alias("known"),
        )
        if width == 1:
            break
        width //= BINS
    state = stored(state, "topk-state")
    left = queries.join(state.withColumnRenamed("row", "s_row"), queries["row"] == F.col("s_row")).drop("s_row")
    found = left.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(
        _selection(), "query_row long, row long, score long"
    )
    found = found.join(rows.select("row", "id"), "row").withColumn(
        "rank", F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    ).where(F.col("rank") <= k)
    names = rows.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return found.join(names, "query_row").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""
