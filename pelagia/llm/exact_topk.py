"""Operator 10, exact top-k by inner product with pivot-table elimination.

Vectors become integers floor(1024 x). A table holds each vector's squared distances to ``pivots``
vectors, picked farthest-first from a bounded sample; they are whole numbers, so nothing is lost. For a query q and
a candidate x every pivot p bounds d(q,x) from below by |d(q,p) - d(x,p)|; together they tell where q and x
lie in the span of the pivots and how far off it, and so give the largest lower bound that follows from them:
d(q,x)^2 >= |q' - x'|^2 + (|q - q'|  - |x - x'|)^2, with q' and x' the projections. That bounds the inner product
(|q|^2 + |x|^2 - d^2) / 2 from above by q'.x' + |q - q'| |x - x'|. Candidates are scored in falling order of the
bound until it is under the k-th best score found, or under the k-th best among the sampled vectors: those are candidates
too, so it holds for the whole table, and each task knows it from the start.

The table is dealt to files of ``CELL_BYTES`` of vectors and distances; queries come in batches of at most ``BATCH_QUERIES``, each
broadcast to the tasks that read the files, so vectors move once whatever the number of queries, and a task gives
k rows a query at most. Ties go to the smaller vec_id.
Null vectors, and those with null or non-finite components, take no part; shorter vectors count
as padded with zeros; of rows that share a query's vec_id none is its candidate, and they are
one query (the smallest vector); repeated candidates count each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import Scratch, read_table

CELL_BYTES, LEAST_CELLS, BATCH_QUERIES = 1 << 28, 12, 1 << 14
#: Less than any score.
NONE = -(1 << 62)
#: Candidates scored first, and then at a time; bounds held at once.
FIRST, STEP, CHUNK = 32, 32, 1 << 20
FOUND = "query_id long, vec_id long, score long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), kind)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared, of integer rows to integer pivots; exact below 2^53."""
    x, pivots = x.astype(float), pivots.astype(float)
    return np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T))


def farthest_first(x: np.ndarray, m: int) -> np.ndarray:
    """``m`` rows (or all), each as far as possible from those before."""
    picked = [0] if len(x) else []
    near = np.full(len(x), np.inf)
    while picked and len(picked) < min(m, len(x)):
        near = np.minimum(near, distances(x, x[picked[-1:]])[:, 0])
        picked.append(int(near.argmax()))
    return x[picked]


def _score(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    return (x.astype(float) @ q.astype(float)).astype(np.int64) if exact else x @ q


class Span:
    """Places in the span of the pivots, from squared distances to them."""

    def __init__(self, pivots: np.ndarray):
        p = pivots.astype(float)
        self.norms = (p * p).sum(1)
        u, s, _ = np.linalg.svd(p, full_matrices=False)
        held = s > 1e-6 * s.max(initial=0)
        self.to = u[:, held] / s[held]

    def place(self, squares: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span and the distance from it, given squared distances and squared lengths."""
        inside = ((norms[:, None] + self.norms - squares) / 2) @ self.to
        return inside, np.sqrt(np.maximum(0, norms - (inside * inside).sum(1)))


def squared(x: np.ndarray) -> np.ndarray:
    return (x.astype(float) ** 2).sum(1)


def search(span: Span, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, qids: np.ndarray, q: np.ndarray, dq: np.ndarray, k: int,
           floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, candidate ids, scores) of the k best of ``x`` for each query, and how many candidates were scored. Candidates below a query's ``floor`` may be left out."""
    floor = np.full(len(q), NONE) if floor is None else floor
    out, scored = [[], [], []], 0
    small = len(x) == 0 or float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**52
    nx, nq = squared(x), squared(q)
    (ax, bx), (aq, bq) = span.place(dx, nx), span.place(dq, nq)
    slack = 1e-9 * np.sqrt(nx.max(initial=0) * nq) + 1e-3  # rounding is on the safe side
    step = max(1, CHUNK // max(1, len(x)))
    self_at = np.flatnonzero(np.isin(ids, qids))
    self_of = ids[self_at]
    for lo in range(0, len(q) if len(x) else 0, step):
        upper = aq[lo : lo + step] @ ax.T + bq[lo : lo + step, None] * bx + slack[lo : lo + step, None]
        for i, bound in enumerate(upper, lo):
            bound[self_at[self_of == qids[i]]] = -np.inf
            n = len(bound)
            order = np.argpartition(bound, n - FIRST)[n - FIRST :] if n > FIRST else np.arange(n)
            got_id, got, done, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
            while True:
                order = order[bound[order] >= floor[i]]
                scored += len(order)
                got_id, got = np.append(got_id, ids[order]), np.append(got, _score(x[order], q[i], small))
                best = np.lexsort((got_id, -got))[:k]
                got_id, got = got_id[best], got[best]
                least = max(got[-1], floor[i]) if len(got) == k else floor[i]
                if not done:  # all that can still be among the best, once, in falling order of their bounds
                    bound[order] = -np.inf
                    rest = np.flatnonzero(bound >= least)
                    rest = rest[np.argsort(-bound[rest], kind="stable")]
                    value, done = bound[rest], 1
                at = done - 1
                order = rest[at : at + size]
                order = order[value[at : at + size] >= least]
                if not len(order):
                    break
                done, size = done + size, 2 * size
            for to, v in zip(out, (np.full(len(got), qids[i]), got_id, got), strict=True):
                to.append(v)
    return *(np.concatenate(v) if v else np.zeros(0, np.int64) for v in out), scored


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 56, sample: int = 2000) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id, vec (array<long>)."""
    scratch = Scratch(spark, "top-k")
    rows = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).first()
    width = max(1, rows.w or 0)
    cells = max(LEAST_CELLS, -(-rows.n * 8 * (width + pivots) // CELL_BYTES))
    drawn = vectors.orderBy(F.xxhash64(F.lit(5), F.col("vec_id")), "vec_id").limit(sample).toArrow()
    known, some = drawn["vec_id"].to_numpy(), matrix(drawn["vec"], width, np.int64)
    pivot = farthest_first(some, pivots)

    def measure(batches):
        for b in batches:
            d = distances(matrix(b.column("vec"), width, np.int64), pivot)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel().astype(np.int64)), d.shape[1]).cast(pa.list_(pa.int64())) if d.size else pa.array([[]] * len(d), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), lists], ["vec_id", "vec", "squares"])

    def sampled(batches):
        """The k-th best score among the sampled vectors, for each query."""
        for b in batches:
            floor = np.full(b.num_rows, NONE)
            for i, (own, q) in enumerate(zip(b.column("vec_id").to_pylist(), matrix(b.column("vec"), width, np.int64), strict=True)):
                score = (some @ q)[known != own]
                if len(score) >= k:
                    floor[i] = np.partition(score, len(score) - k)[len(score) - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], [*b.schema.names, "floor"])

    table = "vec_id long, vec array<long>, squares array<long>"
    held = scratch.table(vectors.repartition(cells, "vec_id").mapInArrow(measure, table), "pivot-table")
    asked = queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInArrow(measure, table).mapInArrow(sampled, f"{table}, floor long")
    batches = max(1, -(-asked.count() // BATCH_QUERIES)) if rows.n else 1
    asked = scratch.table(asked.withColumn("batch", F.pmod(F.xxhash64(F.lit(2), F.col("vec_id")), F.lit(batches))), "queries")
    span = Span(pivot)

    def ask(shared):
        def run(read):
            qids, q, dq, floor = shared.value
            read = [b for b in read if b.num_rows]
            if read:
                t = pa.Table.from_batches(read)
                *found, _ = search(span, t["vec_id"].to_numpy(), matrix(t["vec"], width, np.int64), matrix(t["squares"], len(pivot), float), qids, q, dq, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query_id", "vec_id", "score"])

        return run

    found = None
    for batch in range(batches):  # each is bounded: about BATCH_QUERIES rows
        own = asked.where(F.col("batch") == batch).toArrow()
        shared = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), matrix(own["vec"], width, np.int64), matrix(own["squares"], len(pivot), float), own["floor"].to_numpy()))
        got = scratch.table(held.mapInArrow(ask(shared), FOUND), f"found-{batch}")
        shared.destroy()
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vec: floor(1024 x) of each component, for vectors that take part."""
    x = F.col(vector)
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return rows.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(1024.0) * v.cast("double"))).alias("vec"))


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(spark, vectors, vectors.where("vec_id % 100 = 0"))


SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(r as integer) rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 10"""

QUERIES = {"op10_pivot_topk": op10_pivot_topk}
ORACLES = {"op10_pivot_topk": SQL}
