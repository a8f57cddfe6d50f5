"""SimHash near-duplicates, found by vantage-point trees.

A document's fingerprint has a bit for each of 64: set if over half of the
hashes of its shingles set it. Distinct fingerprints are dealt to the leaves of a
vantage-point tree: at a node a fingerprint goes inside if it is within the
median distance of the vantage point, else outside; fingerprints within
``RADIUS`` of that boundary also visit the other side as guests (the triangle
inequality), so that any two fingerprints within ``RADIUS`` meet in the home leaf
of each. The tree is built on a bounded sample, which decides only how even the
leaves are. In a leaf the same recursion goes on until blocks are small enough to
compare; blocks that it doesn't shrink (one cloud of near copies) are linked by
sorting under all masks of two bits, which costs as much per fingerprint however
dense the cloud is. A leaf returns a star per component, not pairs. How many rows a
cloud has doesn't matter, as equal fingerprints are one: within 4 bits of a point
there are 679,121 fingerprints at most.

Cases:

* null text, and text without words, has the fingerprint 0 and links like any other;
* exact copies share one fingerprint and are compared once;
* ids may repeat: an id links what its rows link, and a component is named by its
  smallest id; null ids don't name a component (null if there is no other);
* other columns are ignored here; :func:`deduplicated` keeps them, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_map, free_names, materialize
from .components import connected_components, forest

#: Words in a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that the tree is built on, and distinct fingerprints aimed at per leaf.
SAMPLE = 20_000
LEAF = 12_000
#: Pairs of a block that are compared outright.
BLOCK = 1 << 20


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id -> doc_id, fp."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the bits of its absolute value


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, median, inside, outside); children below 0 are leaves ~n."""
    nodes: list = []
    rng = np.random.default_rng(5)
    n_leaves = 0

    def grow(part: np.ndarray, share: int) -> int:
        nonlocal n_leaves
        if share > 1 and len(part) >= 8:
            best = None
            for v in rng.choice(part, min(8, len(part)), replace=False):
                d = distance(part, v)
                m = int(np.median(d))
                if not (d > m).any():
                    m -= 1
                if m < 0:
                    continue
                # fewest visits: guests stand within RADIUS of the boundary
                visits = (d <= m + RADIUS).sum() + (d > m - RADIUS).sum() + abs(2 * (d <= m).sum() - len(d)) / 4
                if best is None or visits < best[0]:
                    best = (visits, v, m, d)
            if best is not None and best[0] < 1.95 * len(part):
                _, v, m, d = best
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (int(v), m, grow(part[d <= m], share // 2), grow(part[d > m], share - share // 2))
                return at
        n_leaves += 1
        return ~(n_leaves - 1)

    root = grow(sample, leaves)
    return nodes if root >= 0 else []


def route(tree: list[tuple[int, int, int, int]], fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, leaves, and whether the leaf is the row's home."""
    rows, leaves, homes = [], [], []
    stack = [(0 if tree else ~0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        at, part, home = stack.pop()
        if not len(part):
            continue
        if at < 0:
            rows.append(part)
            leaves.append(np.full(len(part), ~at, np.int32))
            homes.append(home)
            continue
        v, m, inside, outside = tree[at]
        d = distance(fps[part], np.int64(v)).astype(np.int64)
        near, far = d <= m + RADIUS, d > m - RADIUS
        stack.append((inside, part[near], (home & (d <= m))[near]))
        stack.append((outside, part[far], (home & (d > m))[far]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def _dense(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is within RADIUS: neighbours in order under each mask."""
    a, b = [], []
    u = fps.view(np.uint64)
    for bits in combinations(range(64), RADIUS):
        mask = np.uint64(~sum(1 << k for k in bits) & (2**64 - 1))
        order = np.argsort(u & mask, kind="stable")
        same = (u[order][1:] & mask) == (u[order][:-1] & mask)
        if same.any():
            a.append(fps[order[:-1][same]])
            b.append(fps[order[1:][same]])
    return a, b


def leaf_links(home: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links between ``home`` and ``home`` or ``guest``."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    rng = np.random.default_rng(7)
    stack = [(home, np.concatenate([home, guest]), 0)]
    while stack:
        h, every, stuck = stack.pop()
        if not len(h):
            continue
        if len(h) * len(every) <= BLOCK:
            x, y = np.nonzero(distance(h[:, None], every[None, :]) <= RADIUS)
            apart = h[x] != every[y]
            a.append(h[x][apart])
            b.append(every[y][apart])
            continue
        if stuck >= 6 and len(h) * len(every) > 4096 * len(every):
            dense_a, dense_b = _dense(np.unique(every))
            a += dense_a
            b += dense_b
            continue
        v = rng.choice(h)
        dh, de = distance(h, v).astype(np.int64), distance(every, v).astype(np.int64)
        m = int(np.median(dh))
        if not (dh > m).any():
            m -= 1
        near, far = de <= m + RADIUS, de > m - RADIUS
        inner = dh <= m
        work = inner.sum() * near.sum() + (~inner).sum() * far.sum()
        stuck = stuck + 1 if work > 0.9 * len(h) * len(every) else 0
        if work > 0.97 * len(h) * len(every) and len(h) > 2 and stuck < 6:
            stack.append((h, every, stuck))
            continue
        if work > 0.97 * len(h) * len(every):
            # small but not shrinking: compare in slices
            step = max(1, BLOCK // len(every))
            stack += [(h[i : i + step], every, 0) for i in range(0, len(h), step)] if step < len(h) and step * len(every) <= BLOCK else [(h[i : i + 1], every[k : k + BLOCK], 0) for i in range(len(h)) for k in range(0, len(every), BLOCK)]
            continue
        stack.append((h[inner], every[near], stuck))
        stack.append((h[~inner], every[far], stuck))
        if len(a) > 256:
            v_, low = forest(np.concatenate(a), np.concatenate(b))
            a, b = [v_[v_ != low]], [low[v_ != low]]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v_, low = forest(np.concatenate(a), np.concatenate(b))
    return v_[v_ != low], low[v_ != low]


def links(fps: DataFrame, n: int) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within RADIUS."""
    wanted = max(1, -(-n // LEAF))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64)
    tree = build_tree(sample, wanted) if wanted > 1 else []

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("fp").to_numpy()
        rows, leaves, homes = route(tree, own)
        return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(own[rows], pa.int64()), pa.array(homes)], ["leaf", "fp", "home"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        a, b = leaf_links(fp[home], fp[~home])
        return pd.DataFrame({"a": a, "b": b})

    return arrow_map(fps.select("fp"), deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInPandas(meet, "a long, b long")


def named_components(rows: DataFrame) -> DataFrame:
    """Rows with doc_id and fp -> per distinct fp its component_id and label.

    The label (a fingerprint) tells components apart even without ids.
    """
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = connected_components(links(distinct, distinct.count()))
    named = distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.select("fp", "label").join(least, "label")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    rows = materialize(fingerprints(docs), "fingerprints")
    return rows.join(named_components(rows).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the least id."""
    names = docs.columns
    fp, row = free_names(names, "_simhash_fp", "_simhash_row")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, fp])

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    whole = materialize(arrow_map(docs, run, schema).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    rows = whole.select(F.col(row).alias("row"), "doc_id", F.col(fp).alias("fp"))
    labelled = rows.join(named_components(rows).select("fp", "label"), "fp")
    first = labelled.groupBy("label").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(row))
    return whole.join(first.select(row), row, "left_semi").select(*names)


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup_report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")
