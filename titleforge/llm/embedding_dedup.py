"""Embedding near-duplicates by product quantisation, exact in the end.

Within a label, unit vectors go to the inverted list of their nearest coarse
centroid; the rest to the centroid is coded per subspace. A vector searches its
own list and every list that can hold a partner: one at most ``reach`` beyond the
bisecting plane of the two centroids, where ``reach`` is the distance of two unit
vectors at the least cosine. In a list, distances to the coded vectors come from
lookup tables (asymmetric: the query isn't coded); with the known error of each
code the triangle inequality drops only pairs that can't link. What stays is
compared exactly, in double precision. Nothing is lost, so recall is 1; the
sample that the centroids and codes are fitted on decides only the speed.

Exact copies are one class and are compared once; a class counts its copies. A
list longer than ``LIST`` rows is cut into parts that separate tasks search. A
task returns link counts and a star per component, not pairs.

Cases:

* vectors that are null, zero, or hold null or non-finite components link with
  nothing, nor do those with a null label, or of different lengths;
* ids that repeat give a row each, and link like other copies if they are equal;
* null ids take part but don't name a component (null if there is no other);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .components import connected_components, forest
from .exact_topk import usable

LEAST = 0.98
#: Vectors that centroids and codes are fitted on, at most (per table).
SAMPLE = 20_000
#: Vectors aimed at per list, and from which a list is cut.
AIM, LIST = 2_000, 8_000
#: Most coarse centroids; subspaces and codewords of the codes.
LISTS, SUBSPACES, WORDS = 4_096, 8, 64
#: Slack for rounding in bounds that only drop pairs.
SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and the codewords of each subspace of what they leave."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = k_means(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [k_means(rest[:, p], WORDS) for p in self.parts]

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and each one's distance to what its code stands for."""
        codes = np.stack([nearest(rest[:, p], w) for p, w in zip(self.parts, self.words)], 1)
        off = rest.copy()
        for j, (p, w) in enumerate(zip(self.parts, self.words)):
            off[:, p] -= w[codes[:, j]]
        return codes, np.sqrt((off * off).sum(1))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals of queries to coded rows, by lookup."""
        total = np.zeros((len(rest), len(codes)))
        for j, (p, w) in enumerate(zip(self.parts, self.words)):
            total += _squares(rest[:, p], w)[:, codes[:, j]]
        return np.sqrt(total)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each row has to search."""
        d = _squares(x, self.coarse)
        own = d[np.arange(len(x)), home]
        between = np.sqrt(_squares(self.coarse, self.coarse))[home]
        return (d - own[:, None]) <= 2 * (reach + SLACK) * between + SLACK


def search(quantiser: Quantiser, at: int, queries: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) of unit vectors with cosine of at least ``least``."""
    reach = np.sqrt(2 - 2 * least)
    codes, errors = quantiser.code(rows - quantiser.coarse[at])
    step = max(1, 2_000_000 // max(1, len(rows)))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        close = quantiser.distances(q - quantiser.coarse[at], codes) - errors[None, :] <= reach + SLACK
        some = close.any(0)
        if not some.any():
            continue
        cols = np.flatnonzero(some)
        a, b = np.nonzero(close[:, cols] & (q @ rows[cols].T >= least))
        yield a + i, cols[b]


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.when(ok, F.transform("embedding", lambda v: v.cast("double") + 0.0)).alias("x"))
    rows = materialize(rows.withColumn("key", F.when(F.col("x").isNotNull(), F.sha2(F.to_json(F.struct("label", "x")), 256))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # a class per distinct vector and label; its number is that of one of its rows
    classes = rows.where("x is not null").groupBy("key").agg(F.min("row").alias("c"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min_by(F.struct("label", "x"), "row").alias("v"))
    classes = materialize(classes.select("key", "c", "copies", "least", "v.label", "v.x", F.size("v.x").alias("d")), "vector-classes")
    stats = classes.groupBy("d").count().orderBy(F.desc("count")).limit(16).collect()
    models: dict[int, Quantiser] = {}
    for d, n in ((r["d"], r["count"]) for r in stats):
        got = classes.where(F.col("d") == d).orderBy(F.xxhash64("key")).limit(SAMPLE // len(stats)).select("x").toArrow()["x"].to_pylist()
        x = np.array(got)
        models[d] = Quantiser(x / np.sqrt((x * x).sum(1, keepdims=True)), int(min(LISTS, max(1, n // AIM), len(x))))
    reach = float(np.sqrt(2 - 2 * least))

    def unit(xs: list) -> np.ndarray:
        x = np.array(xs)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds = batch.column("d").to_numpy()
            for d in np.unique(ds):
                part = batch.filter(pa.array(ds == d))
                model = models.get(int(d))
                if model is None:  # one of many lengths: its label is a single list
                    home, to = np.zeros(len(part), np.int64), [[0]] * len(part)
                else:
                    x = unit(part.column("x").to_pylist())
                    home = nearest(x, model.coarse)
                    to = [np.flatnonzero(p).tolist() for p in model.probes(x, home, reach)]
                yield pa.RecordBatch.from_arrays([part.column("c"), part.column("label"), part.column("d"), pa.array(home, pa.int32()), pa.array(to, pa.list_(pa.int32()))], ["c", "label", "d", "home", "probes"])

    label = classes.schema["label"].dataType.simpleString()
    dealt = materialize(classes.select("c", "label", "d", "x").mapInArrow(deal, f"c long, label {label}, d int, home int, probes array<int>"), "vector-lists")
    by = ["label", "d", "list"]
    lists = dealt.groupBy("label", "d", F.col("home").alias("list")).agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    askers = dealt.select("label", "d", F.explode("probes").alias("list")).groupBy(*by).agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    # the lists are few: LISTS per length and label at most
    lists = materialize(lists.join(askers, by), "list-sizes")
    # a task holds one part of a list's rows and one block of those that search it
    place = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = classes.select("c", "x", "copies")
    stored = dealt.withColumn("list", F.col("home")).join(lists, by).withColumn("part", place("parts")).withColumn("block", every("blocks")).join(carried, "c")
    asking = dealt.withColumn("list", F.explode("probes")).join(lists, by).withColumn("block", place("blocks")).withColumn("part", every("parts")).join(carried, "c")
    keys = [*by, "part", "block"]
    cols = [*keys, "c", "copies", "x"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "a", "b"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        at, d = int(left["list"].iloc[0]), int(left["d"].iloc[0])
        rows, queries = unit(left["x"].tolist()), unit(right["x"].tolist())
        model = models.get(d) or Quantiser(rows[:WORDS], 1)
        c_rows, c_queries, copies = left["c"].to_numpy(), right["c"].to_numpy(), left["copies"].to_numpy()
        n = np.zeros(len(queries), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in search(model, at, queries, rows, least):
            other = c_queries[i] != c_rows[j]
            i, j = i[other], j[other]
            np.add.at(n, i, copies[j])
            v, low = forest(np.concatenate([a, c_queries[i]]), np.concatenate([b, c_rows[j]]))
            a, b = v[v != low], low[v != low]
        hit = n > 0
        return pd.DataFrame({"kind": np.r_[np.zeros(hit.sum(), np.int32), np.ones(len(a), np.int32)], "a": np.r_[c_queries[hit], a], "b": np.r_[n[hit], b]})

    found = materialize(stored.select(cols).groupBy(*keys).cogroup(asking.select(cols).toDF(*cols).groupBy(*keys)).applyInPandas(meet, "kind int, a long, b long"), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("n"))
    labels = connected_components(found.where("kind = 1").select("a", "b"))
    named = classes.select("key", "c", "copies", "least").join(counts, "c", "left").join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least_of = named.groupBy("label").agg(F.min("least").alias("component"))
    by_key = named.join(least_of, "label").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: What :func:`near_duplicates` returns for ``embeddings``, as DuckDB SQL.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM p GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON n.a = e.vec_id
"""
