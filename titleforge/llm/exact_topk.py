"""Exact top-k inner products by the threshold algorithm over sorted lists.

Candidates are dealt to shards of bounded size, queries to blocks of bounded
size; a task holds one shard and one block. All vectors are turned by one
orthogonal matrix per length (principal axes of a bounded sample), which changes
no product but lets a few lists carry most of it where the data allow that. A
shard has, per axis, the list of its rows in order of that component. A query
reads all its lists (from the top where its own component is positive, from the
bottom where it is negative) to growing depths, scores each row when first seen,
and stops once the bound - the sum of what every list can still contribute -
can't beat the k-th best score; at equality it reads on, as a tie goes to the
smaller id.

1. Each query meets its own shard first: the k-th score there is its floor.
2. The heads of a shard's lists bound what the shard can hold: a query goes only to
   shards whose bound reaches its floor.
3. There it stops as soon as the bound is below the floor or its own k-th score, and
   returns what reaches the floor. A window per query merges the shards.

Scores are integers: components become floor(scale * x). They are summed in
doubles, which hold them exactly (under 2**53). Bounds are sums over turned
vectors; ``SLACK`` stands for their rounding.

Cases:

* vectors that are null, or hold null or non-finite components, take no part; nor
  do those with a null id as candidates or queries;
* vectors of different lengths never meet: each length is searched on its own;
* an id that repeats gives a row per copy; a query's own row is no candidate, its
  copies under the same id are;
* with fewer than k candidates all are returned; an empty table gives no rows;
* other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, release

K = 20
SCALE = 64
#: A row is a query if its id is divisible by this.
EVERY = 20
#: Rows per shard, and queries per block.
SHARD = 8_192
QUERIES = 4_096
#: Rows read from every list at first, and how much deeper each time.
DEPTH, DEEPER = 16, 1.25
#: Queries whose rows are scored together.
CHUNK = 64
#: Vectors that the axes are fitted on, lengths that get own axes (others keep theirs).
SAMPLE, LENGTHS = 4_096, 16
#: Bytes of list heads up to which they go to every task; beyond, queries go to all shards.
HEADS = 64 << 20
#: What rounding may add to a bound.
SLACK = 1e-3


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class Lists:
    """A shard's rows, the order of each axis, and the values that stand at certain depths of it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, axes: np.ndarray | None) -> None:
        self.ids, self.rows, self.axes = ids, rows, axes
        self.x = x.astype(np.float32) if x.shape[1] * float(np.abs(x).max(initial=0)) ** 2 < 1 << 24 else x  # exact either way
        turned = x if axes is None else x @ axes
        order = np.argsort(turned, axis=0, kind="stable")
        n = len(x)
        depths = [DEPTH]
        while depths[-1] < n:
            depths.append(int(depths[-1] * DEEPER))
        self.depths = np.minimum(np.array(depths), n)
        ends = np.minimum(self.depths, n - 1)
        low, high = order[ends], order[n - 1 - ends]
        self.low, self.high = np.take_along_axis(turned, low, 0), np.take_along_axis(turned, high, 0)
        self.heads = np.take_along_axis(turned, order[[0, n - 1]], 0)
        self.order = np.ascontiguousarray(order.T)
        self.where = {int(r): i for i, r in enumerate(rows)}

    def _read(self, seen: np.ndarray, turned: np.ndarray, depth: int) -> None:
        """Mark what a query's lists show down to a depth, unless all rows are marked already."""
        n = len(seen)
        for i, axis in enumerate(np.argsort(-np.abs(turned)).tolist()):
            if turned[axis] > 0:
                seen[self.order[axis, n - depth :]] = True
            elif turned[axis] < 0:
                seen[self.order[axis, :depth]] = True
            if i % 8 == 7 and seen.all():
                break

    def search(self, rows: list[int], queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """For each query places and scores of its best ``k`` that reach its floor, its own row left
        out; how deep the lists were read, and how many rows were scored. Queries go in chunks, whose
        rows are scored together."""
        for i in range(0, len(rows), CHUNK):
            yield from self._chunk(rows[i : i + CHUNK], queries[i : i + CHUNK], k, floors[i : i + CHUNK].copy())

    def _chunk(self, rows: list[int], q: np.ndarray, k: int, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        n, m = len(self.x), len(rows)
        floors = best.copy()
        turned = q if self.axes is None else q @ self.axes
        # what a row that no list has shown down to each depth can reach at most
        bounds = np.maximum(turned, 0) @ self.high.T + np.minimum(turned, 0) @ self.low.T + SLACK
        own = [self.where.get(r, -1) for r in rows]
        seen = np.zeros((m, n), bool)
        at = np.full(m, -1)  # the depth reached, as a place in ``depths``
        out: list = [(np.zeros(0, np.int64), np.zeros(0))] * m
        open_ = list(range(m))
        while open_:
            for j in open_:
                enough = np.flatnonzero(bounds[j] < best[j])
                if len(enough):  # from here on nothing unseen can matter
                    at[j] = max(at[j] + 1, enough[0])
                else:  # no score to beat yet, or none that the bound falls below
                    at[j] = min(at[j] + 4, len(self.depths) - 1) if at[j] < 4 else len(self.depths) - 1
                depth = self.depths[at[j]]
                if depth == n or not turned[j].any():
                    seen[j], at[j] = True, len(self.depths) - 1
                else:
                    self._read(seen[j], turned[j], depth)
                if own[j] >= 0:
                    seen[j, own[j]] = False
            some = np.flatnonzero(seen[open_].any(0))
            wanted = q[open_].astype(self.x.dtype).T
            scores = (self.x @ wanted if 4 * len(some) > n else self.x[some] @ wanted).T
            left = []
            for j, all_ in zip(open_, scores):
                mine = np.flatnonzero(seen[j])
                got = all_[mine] if 4 * len(some) > n else all_[np.searchsorted(some, mine)]
                good = got >= floors[j]
                found, got = mine[good], got[good].astype(np.float64)
                if len(found) > k:
                    kept = _best(self.ids, found, got, k)
                    found, got = found[kept], got[kept]
                out[j] = (found, got)
                if len(got) == k:
                    best[j] = max(best[j], got.min())
                if self.depths[at[j]] < n and not bounds[j, at[j]] < best[j]:
                    left.append(j)
            open_ = left
        for j in range(m):
            yield (*out[j], int(self.depths[at[j]]), int(seen[j].sum()))


def _best(ids: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= cut)
    return some[np.lexsort((ids[found[some]], -scores[some]))[:k]]


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes, the one that carries most of the products first."""
    weight, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, np.argsort(weight)[::-1]])


def fit_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Axes of the most frequent lengths, from a bounded sample. They decide speed only."""
    lengths = [r["d"] for r in rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]
    out = {}
    for d in lengths:
        some = rows.where(F.col("d") == d).orderBy(F.xxhash64("row"), "row").limit(max(1, SAMPLE // len(lengths))).select("x").toArrow()["x"]
        out[d] = principal_axes(np.array(some.to_pylist(), np.float64).reshape(len(some), d))
    return out


def _lists(pdf: pd.DataFrame, axes: dict[int, np.ndarray]) -> Lists:
    return Lists(pdf["id"].to_numpy(), pdf["row"].to_numpy(), np.stack(pdf["x"].to_numpy()), axes.get(int(pdf["d"].iloc[0])))


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates."""
    whole = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    plain = materialize(
        vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), whole.alias("x"), F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("d")),
        "topk-vectors",
    )
    n, n_queries = plain.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    n_shards, n_blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES))
    at = F.xxhash64("row")
    rows = plain.withColumn("shard", F.pmod(at, F.lit(n_shards)).cast("int"))
    asked = rows.where(F.col("id") % every == 0)
    axes = fit_axes(plain)
    cols = ["d", "shard", "row", "id", "x"]

    def own(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "floor"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        asking = [int(r) for r in right["row"]]
        got = _lists(left, axes).search(asking, np.stack(right["x"].to_numpy()), k, np.full(len(asking), -np.inf))
        return pd.DataFrame([(r, scores.min() if len(scores) == k else None) for r, (_, scores, _, _) in zip(asking, got)], columns=names)

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = _lists(pdf, axes).heads
        return pd.DataFrame({"d": [int(pdf["d"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "low": [low], "high": [high]})

    floors = materialize(rows.select(cols).groupBy("d", "shard").cogroup(asked.select(cols).groupBy("d", "shard")).applyInPandas(own, "query_row long, floor double"), "topk-floors")
    queries = asked.join(floors.withColumnRenamed("query_row", "row"), "row", "left").select("d", "row", "id", "x", "floor", F.pmod(at, F.lit(n_blocks)).cast("int").alias("block"))
    width = plain.agg(F.max("d")).first()[0] or 0
    if 16 * width * n_shards <= HEADS:
        known: dict[int, list] = {}
        for r in rows.select(cols).groupBy("d", "shard").applyInPandas(heads, "d int, shard int, low array<double>, high array<double>").collect():
            known.setdefault(r["d"], []).append((r["shard"], r["low"], r["high"]))
        tops = {d: (np.array([s for s, _, _ in own_], np.int32), np.array([lo for _, lo, _ in own_]), np.array([hi for _, _, hi in own_])) for d, own_ in known.items()}

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The shards that each query has to visit."""
            for batch in batches:
                lists = []
                for d, x, floor in zip(batch.column("d").to_pylist(), batch.column("x").to_pylist(), batch.column("floor").to_pylist()):
                    shards, low, high = tops[d]
                    q = np.array(x)
                    turned = q @ axes[d] if d in axes else q
                    bound = np.maximum(low * turned, high * turned).sum(1)
                    lists.append(shards[bound + SLACK >= (-np.inf if floor is None else floor)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

        queries = queries.mapInArrow(reach, "d int, row long, id long, x array<double>, floor double, block int, shards array<int>")
    else:
        queries = queries.withColumn("shards", F.sequence(F.lit(0), F.lit(n_shards - 1)))
    visits = queries.select("d", "block", "row", "id", "x", "floor", F.explode("shards").alias("shard"))
    listed = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        lists, asking = _lists(left, axes), [int(r) for r in right["row"]]
        floor = right["floor"].fillna(-np.inf).to_numpy(np.float64)
        out = []
        for r, i, (found, scores, _, _) in zip(asking, right["id"], lists.search(asking, np.stack(right["x"].to_numpy()), k, floor)):
            out += [(r, int(i), int(lists.rows[a]), int(lists.ids[a]), int(s)) for a, s in zip(found, scores)]
        return pd.DataFrame(out, columns=names)

    keys = ["d", "shard", "block"]
    found = listed.select(*cols, "block").groupBy(*keys).cogroup(visits.select(*cols, "block", "floor").groupBy(*keys)).applyInPandas(meet, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    out = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")
    release(plain, floors)
    return out


#: What :func:`top_k` returns for ``embeddings``, as DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 20
"""
