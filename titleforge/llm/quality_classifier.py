"""Document quality by Bradley-Terry pairwise ranking.

A document's score is a linear function of text statistics. It is learned from
preference pairs (a document labelled 1 is preferred to one labelled 0): the
logistic loss of the difference of their features is minimised by Newton's
method over all labelled documents that are not held out. A quantile of their
scores gives the cut-off.

Cases:

* null text counts as empty text, and an empty text has a score like any other;
* null ids are scored and never held out; repeated rows each give a row;
* other columns are ignored;
* without labels, or with labels of one kind only, every score is the neutral
  0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, held_out, labelled_sample, materialize, release

#: Labelled documents whose pairs are worked on at once; more are dealt to buckets by the hash of their ids.
BUCKET = 20_000
#: Preference pairs per less liked document, at most.
PAIRS_EACH = 12
#: ``predicted`` is 1 from this score on; the cut-off quantile is mapped to it.
CUT = 0.3
L2 = 1e-3

_KINDS = ("upper", "lower", "digit", "space", "line", "stop", "comma", "quote", "symbol", "wide")


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, _KINDS.index("wide"), np.uint8)
    kind[:128] = _KINDS.index("symbol")
    for chars, name in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        (b"abcdefghijklmnopqrstuvwxyz", "lower"),
        (b"0123456789", "digit"),
        (b" \t\x0b\x0c", "space"),
        (b"\r\n", "line"),
        (b".", "stop"),
        (b",;:", "comma"),
        (b"'\"()-", "quote"),
    ):
        kind[list(chars)] = _KINDS.index(name)
    return kind


_KIND_OF = _byte_kinds()
#: Words of a window whose share of distinct words is measured.
WINDOW = 100
FEATURES = (
    *(f"share_{k}" for k in _KINDS),
    *(f"log_{k}" for k in ("upper", "digit", "quote", "symbol")),
    "distinct_words",
    "distinct_words_window",
    "top_word",
    "short_words",
    "repeated_lines",
    "word_length",
    "long_text",
)


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) + 1
    share = np.bincount(_KIND_OF[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS)) / n
    words = raw.split()
    if words:
        distinct = set(words)
        # consecutive windows over the whole text; the last one ends with it
        starts = [*range(0, len(words) - WINDOW, WINDOW), max(0, len(words) - WINDOW)]
        size = min(WINDOW, len(words))
        of_words = [
            len(distinct) / len(words) ** 0.9,
            sum(len(set(words[i : i + WINDOW])) for i in starts) / (len(starts) * size),
            Counter(words).most_common(1)[0][1] / (len(words) + 5),
            sum(map((1).__eq__, map(len, words))) / len(words),
        ]
    else:
        of_words = [1.0, 1.0, 0.0, 0.0]
    lines = [x for x in raw.split(b"\n") if x]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    logs = [float(np.log(share[_KINDS.index(k)] + 1e-3)) for k in ("upper", "digit", "quote", "symbol")]
    return [
        *share.tolist(),
        *logs,
        *of_words,
        repeated,
        float(np.log1p((n - 1) / max(1, len(words)))),
        float(np.log1p(len(words))),
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: ``score`` is logistic in the weighted features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight
        u = np.clip(self.slope * (z - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-u))


def neutral() -> Ranking:
    d = len(FEATURES)
    return Ranking(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(CUT / (1 - CUT))), 1.0)


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Bradley-Terry weights of features ``x`` for labels ``y`` (1 preferred)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return neutral()
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(11)
    lose = np.repeat(bad, PAIRS_EACH)
    d = z[rng.choice(good, len(lose))] - z[lose]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(p @ d) / len(d) + L2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile of all scores below which the share of documents labelled 0 lies
    cut = float(np.quantile(s, len(bad) / len(s)))
    return Ranking(mean, scale, w, cut, 1.0)


def fit_buckets(packed: DataFrame) -> Ranking:
    """:func:`fit` over buckets (bucket, x and y as bytes), with pairs inside each; only sums and scores reach the driver."""
    d = len(FEATURES)

    def over(fn: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column("bucket").to_pylist()
            out = [fn(k, np.frombuffer(x).reshape(-1, d), np.frombuffer(y, np.int32)) for k, x, y in zip(keys, batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], ["bucket", "v"])

        return [np.array(v) for _, v in sorted(map(tuple, arrow_map(packed, run, "bucket long, v array<double>").collect()))]

    n, n_good, n_bad, *total = sum(over(lambda k, x, y: np.array([len(y), (y == 1).sum(), (y == 0).sum(), *x.sum(0)])))
    if not n_good or not n_bad:
        return neutral()
    mean = np.array(total) / n
    scale = np.sqrt(sum(over(lambda k, x, y: ((x - mean) ** 2).sum(0))) / n) + 1e-6
    w = np.zeros(d)

    def terms(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return np.zeros(1 + d + d * d)
        z = np.clip((x - mean) / scale, -8, 8)
        lose = np.repeat(bad, PAIRS_EACH)
        apart = z[np.random.default_rng([11, k]).choice(good, len(lose))] - z[lose]
        p = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        return np.concatenate([[len(lose)], p @ apart, ((apart * (p * (1 - p))[:, None]).T @ apart).ravel()])

    for _ in range(30):
        pairs, *rest = sum(over(terms))
        grad, hess = np.array(rest[:d]), np.array(rest[d:]).reshape(d, d)
        step = np.linalg.solve(hess / max(1, pairs) + L2 * np.eye(d), L2 * w - grad / max(1, pairs))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = np.concatenate(over(lambda k, x, y: np.clip((x - mean) / scale, -8, 8) @ w))
    return Ranking(mean, scale, w, float(np.quantile(s, n_bad / n)), 1.0)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 5, rest: int = 0, bucket: int = BUCKET) -> Ranking:
    """Fit on all labelled documents that are not held out."""

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_h"), pa.array(xs, pa.list_(pa.float64())), batch.column("_label").cast(pa.int32())], ["h", "x", "y"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "x": [np.stack(rows["x"].to_list()).tobytes()], "y": [rows["y"].to_numpy(np.int32).tobytes()]})

    labelled = labelled_sample(docs, labels, label, mod, rest, None).withColumn("_h", F.xxhash64("doc_id"))
    rows = materialize(arrow_map(labelled, stats, "h long, x array<double>, y int"), "quality-features")
    n = rows.count()
    if n <= bucket:
        got = rows.orderBy("h").toArrow()
        release(rows)
        return fit(np.array(got["x"].to_pylist()), got["y"].to_numpy()) if n else neutral()
    dealt = rows.withColumn("bucket", F.pmod("h", F.lit(-(-n // bucket))))
    packed = materialize(dealt.groupBy("bucket").applyInPandas(pack, "bucket long, x binary, y binary"), "quality-buckets")
    model = fit_buckets(packed)
    release(rows, packed)
    return model


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """Every column of ``docs`` that is named doc_id or text, and ``score``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(xs), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    mod, rest = how.get("mod", 5), how.get("rest", 0)
    scored = score(docs, learn(docs, labels, **how))
    return scored.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (scored.score >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches the cut-off."""
    model = learn(docs, labels, **how)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return batch.select(names).filter(pa.array(model.score(xs) >= CUT))

    return arrow_map(docs, run, docs.schema)
