"""Removal of repeated passages by prefix-free parsing, spread over a cluster.

A byte goes if a passage of ``LENGTH`` bytes covers it that also starts anywhere
else. The texts are parsed by rolling-hash triggers: a gram of ``GRAM`` bytes is a
trigger if the top ``BITS`` bits of its hash are zero. The *core* of a window of
``LENGTH`` bytes is what lies from its first trigger to its last (in a window
without triggers, the gram of ``BLANK`` bytes with the least hash), so that equal
windows have equal cores at equal places, wherever they stand. Neighbouring
windows with the same core form a *run*: the bytes that they span.

1. Runs whose core is unique in the corpus hold no repeated window.
2. The dictionary: of the rest, runs are counted by core and content. Runs that
   occur twice hold only repeated windows. Neither kind moves its bytes.
3. What is left are runs that share a core but not their content (the edges of
   repeated passages). One copy of each goes, by core, to a shard. There the runs
   are cut into phrases that end with a trigger; suffix arrays of the dictionary of
   distinct phrases and of the parse give the order of all windows, and those
   whose neighbour agrees in ``LENGTH`` bytes are marked (:func:`ordered_repeats`).
4. Cores with more than ``HOT`` different runs would make a shard of any size. The
   windows of their runs are counted one by one across the cluster instead.

Counts are by hashes of 128 bits; step 3 compares bytes. Keys that hold many rows
are joined by broadcast (:func:`._common.meet`), the rest by shuffling.

Cases:

* null text counts as empty; texts under ``LENGTH`` bytes lose nothing;
* exact copies of a text of ``LENGTH`` bytes or more lose all their bytes;
* matches never cross texts; overlaps count, also within a text, and passages are
  judged on the input, not on what is left;
* null ids and repeated rows each give a row; other columns are ignored;
* cutting may leave bytes that are no UTF-8: :func:`removed_spans` gives byte
  spans, the digest is over bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FREQUENT, materialize, meet, release

LENGTH = 400
#: Bytes of a trigger, and the bits of its hash that are zero.
GRAM = 16
BITS = 7
#: Bytes of the core of a window without triggers.
BLANK = 128
#: Windows of a text that are parsed at once.
PIECE = 1 << 18
#: Rows that a Python worker holds before it hands them on.
ROWS = 1 << 15
#: Bytes of runs aimed at per shard, and different runs from which a core is hot.
SHARD = 1 << 20
HOT = 1_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 20) - 1)  # bits of a place inside a piece


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """The hash of every string of ``size`` bytes (a power of two)."""
    h, k = raw.astype(np.uint64) * _B + _A, 1
    while k < size:
        right = h[k:]
        h = h[: len(h) - k] * _A + (right ^ (right >> np.uint64(29))) * _B
        h ^= h >> np.uint64(32)
        k *= 2
    return h


def triggers(raw: np.ndarray) -> np.ndarray:
    """Places where a trigger starts."""
    return np.flatnonzero(rolling(raw, GRAM) >> np.uint64(64 - BITS) == 0) if len(raw) >= GRAM else np.zeros(0, np.int64)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    low, k = keys, 1
    while 2 * k <= width:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    rest = width - k
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _blank_runs(raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First window, last window and core of the runs of a stretch without triggers."""
    keys = (rolling(raw, BLANK) & ~_LOW) | np.arange(len(raw) - BLANK + 1, dtype=np.uint64)
    least = _least(keys, LENGTH - BLANK + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    yield from zip(first.tolist(), last.tolist(), (least[first] & _LOW).tolist())


def parse(raw: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """The runs of a text: hash of the core, hash of the content, first and last window."""
    short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    for start in range(0, len(raw) - LENGTH + 1, PIECE):
        piece = raw[start : start + PIECE + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        view = np.frombuffer(piece, np.uint8)
        at = triggers(view)
        edges = np.unique(np.concatenate([[0], at + 1, at - (LENGTH - GRAM)]))
        lows = edges[(edges >= 0) & (edges < n)]
        highs = np.append(lows[1:], n) - 1
        firsts = np.searchsorted(at, lows)
        lasts = np.searchsorted(at, lows + (LENGTH - GRAM), "right") - 1
        places = at.tolist()
        for lo, hi, f, last in zip(lows.tolist(), highs.tolist(), firsts.tolist(), lasts.tolist()):
            if f <= last:
                core = piece[places[f] : places[last] + GRAM]
                yield short(core) - (1 << 63), long(piece[lo : hi + LENGTH], places[f] - lo), start + lo, start + hi
                continue
            for a, b, core_at in _blank_runs(view[lo : hi + LENGTH]):
                a, b, core_at = lo + a, lo + b, lo + core_at
                yield short(piece[core_at : core_at + BLANK], 1) - (1 << 63), long(piece[a : b + LENGTH], core_at - a), start + a, start + b


def _raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch.column("key"), batch.column("text")):
            key = key.as_py()
            for run in parse(_raw(text)):
                rows.append((key, *run))
                if len(rows) >= ROWS:
                    yield _batch(rows, _RUNS)
                    rows = []
        yield _batch(rows, _RUNS)


_RUNS = (("key", pa.binary()), ("g", pa.int64()), ("c", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()))
_CUTS = (("shard", pa.int64()), ("window", pa.binary()), ("key", pa.binary()), ("lo", pa.int32()), ("bytes", pa.binary()))


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


# the order of all windows of a shard


def ranks(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix ranks by prefix doubling; equal suffixes share one.

    ``symbols``: from 1 on; ``left``: how many symbols each suffix has. What is past
    the end ranks 0, before every symbol.
    """
    rank, k = symbols.astype(np.int64), 1
    longest = int(left.max(initial=0))
    while k < longest:
        follow = np.zeros_like(rank)
        inside = np.flatnonzero(left > k)
        follow[inside] = rank[inside + k]
        _, rank = np.unique(rank * (rank.max() + 1) + follow, return_inverse=True)
        rank += 1
        k *= 2
    return rank


def ordered_repeats(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Part and place of each window that some other window of the parts equals.

    Prefix-free parsing: phrases end with a trigger and overlap the next one by it, so
    no suffix of a phrase that is longer than a trigger is a prefix of another one. A
    window is therefore ordered by the rank of what is left of its phrase among the
    dictionary's suffixes, then by the rank of the parse from the next phrase on.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    at = triggers(raw)
    own = np.searchsorted(begin, at, "right") - 1
    at = at[(at + GRAM <= begin[own] + sizes[own]) & (at > begin[own])]  # inside one part
    starts = np.unique(np.concatenate([begin, at]))
    owner = np.searchsorted(begin, starts, "right") - 1
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, begin[owner] + sizes[owner], np.append(starts[1:], 0) + GRAM)
    whole = raw.tobytes()
    names: dict[bytes, int] = {}
    name = np.fromiter((names.setdefault(whole[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    phrase_sizes = np.fromiter(map(len, names), np.int64, len(names))
    phrase_at = np.cumsum(phrase_sizes) - phrase_sizes
    dictionary = np.frombuffer(b"".join(names), np.uint8)
    left = np.repeat(phrase_at + phrase_sizes, phrase_sizes) - np.arange(len(dictionary))
    suffix = ranks(dictionary.astype(np.int64) + 1, left)
    per_part = np.bincount(owner, minlength=len(parts))
    phrases_left = np.repeat(np.cumsum(per_part), per_part) - np.arange(len(starts))
    parsed = np.append(ranks(suffix[phrase_at[name]], phrases_left), 0)
    n = np.maximum(sizes - LENGTH + 1, 0)
    part = np.repeat(np.arange(len(parts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window = begin[part] + place
    phrase = np.searchsorted(starts, window, "right") - 1
    order = np.lexsort((np.where(last[phrase], 0, parsed[phrase + 1]), suffix[phrase_at[name[phrase]] + window - starts[phrase]]))
    hit = np.zeros(len(window), bool)
    strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH) if len(raw) >= LENGTH else None
    for i in range(0, len(order) - 1, 2048):
        a, b = order[i : i + 2048], order[i + 1 : i + 2049]
        same = (strings[window[a[: len(b)]]] == strings[window[b]]).all(1)
        hit[a[: len(b)][same]] = True
        hit[b[same]] = True
    return part[hit], place[hit]


def _repeated(shards: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows of a shard that occur more than once in it."""
    part, place = ordered_repeats(shards["bytes"].tolist())
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(part) > 0)]) if len(part) else np.zeros(0, bool)
    end = np.concatenate([new[1:], [True]]) if len(part) else new
    of, lo = part[new], shards["lo"].to_numpy()
    return pd.DataFrame({"key": shards["key"].to_numpy()[of], "lo": lo[of] + place[new], "hi": lo[of] + place[end]})


def _cut(n_shards: int):
    """Texts with their open runs -> bytes of runs by shard, windows of runs with a hot core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, open_ in zip(batch.column("key"), batch.column("text"), batch.column("open")):
                key, raw = key.as_py(), _raw(text)
                for p in open_.as_py():
                    content = raw[p["lo"] : p["hi"] + LENGTH]
                    if p["hot"]:
                        rows += [(None, xxhash.xxh3_128_digest(content[i : i + LENGTH]), key, p["lo"] + i, None) for i in range(len(content) - LENGTH + 1)]
                    else:
                        rows.append((p["g"] % n_shards, None, key, p["lo"], content))
                    if len(rows) >= ROWS:
                        yield _batch(rows, _CUTS)
                        rows = []
            yield _batch(rows, _CUTS)

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """key, text of documents -> key and the repeated windows (first, last) of the text."""
    runs = materialize(docs.mapInArrow(_runs, "key binary, g long, c binary, lo int, hi int"), "runs")
    total = runs.count()
    cores = materialize(runs.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    shared = materialize(meet(runs, cores, ["g"], "n", total).drop("n"), "shared-runs")
    release(runs, cores)
    dictionary = materialize(shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("at")), "dictionary")
    total = shared.count()
    whole = materialize(meet(shared, dictionary.where("n > 1").select("g", "c", "n"), ["g", "c"], "n", total).select("key", "lo", "hi").distinct(), "whole-runs")
    release(shared)
    variants = dictionary.groupBy("g").agg(F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("int")).alias("open")).where("k > 1 and open > 0").select("g", "k")
    open_ = meet(dictionary.select("g", "at.*"), materialize(variants, "open-cores"), ["g"], "k", total).withColumn("hot", F.col("k") > HOT)
    by_text = materialize(open_.groupBy("key").agg(F.collect_list(F.struct("g", "lo", "hi", "hot")).alias("open")), "open-runs")
    size = by_text.select(F.sum(F.aggregate("open", F.lit(0).cast("long"), lambda acc, p: acc + p["hi"] - p["lo"] + LENGTH))).first()[0] or 0
    release(dictionary)
    once = docs.groupBy("key").agg(F.first("text").alias("text"))  # copies of a text meet before they move
    pieces = materialize(once.join(by_text, "key").mapInArrow(_cut(max(1, -(-size // SHARD))), "shard long, window binary, key binary, lo int, bytes binary"), "open-bytes")
    in_shards = pieces.where("shard is not null").select("shard", "key", "lo", "bytes").groupBy("shard").applyInPandas(_repeated, "key binary, lo int, hi int")
    windows = pieces.where("window is not null").select("window", "key", "lo")
    often = materialize(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "hot-windows")
    one_by_one = meet(windows, often, ["window"], "n", windows.count()).select("key", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(in_shards).unionByName(one_by_one)


def spans_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans [start, end) that the windows of the runs (first, last) cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the runs of repeated windows (null if none).

    A text with very many copies is one run, whatever else it holds: those rows need
    no join, which would bring them to one task.
    """
    keyed = _with_key(docs)
    runs = materialize(repeated_windows(keyed.select("key", "text")).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "repeated-runs")
    n = docs.count()
    copied = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(FREQUENT, n // FREQUENT)).select("key"), "copied-texts")
    rare = keyed.join(F.broadcast(copied), "key", "left_anti").join(runs, "key", "left")
    size = F.octet_length("text")
    all_of_it = F.when(size >= LENGTH, F.array(F.struct(F.lit(0).alias("lo"), (size - LENGTH).alias("hi"))))
    often = keyed.join(F.broadcast(copied), "key", "left_semi").withColumn("runs", all_of_it)
    return rare.unionByName(often).select("doc_id", "text", "runs")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                raw = _raw(text)
                cuts = spans_of([(r["lo"], r["hi"]) for r in runs.as_py() or ()])
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2]):
                    digest.update(raw[a:b])
                for col, x in zip(cols, (len(raw), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return removed_spans(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
