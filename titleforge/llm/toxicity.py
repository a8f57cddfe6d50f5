"""Toxic passages as maximum-scoring segments of token log-odds.

Every token gets the log-odds of toxic against clean labelled documents, with
an informative Dirichlet prior; features are whole words and word beginnings,
so that inflected forms share evidence. Tokens without significant evidence
cost a constant, which makes the mean score of clean text negative. A
linear-time scan (Ruzzo and Tompa) finds all maximal segments of a text.
Segment scores follow an extreme-value law in clean text: ``lambda * S -
ln(K * n)`` is compared across texts of any length, the passages that stay
below a p-value are reported, and a logistic calibration over the best one
gives a document's score.

Cases:

* null text counts as empty; a text without words gets the score of no passage;
* null ids are scored and never held out; repeated rows each give a row;
* other columns are ignored;
* without labels, or with labels of one kind only, no token has evidence, and
  every score is the same and below the cut-off.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, held_out, labelled_sample, materialize, release

#: Labelled documents that the evidence is learned from, at most.
SAMPLE = 20_000
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Prior documents per feature, shared between the kinds by their sizes.
PRIOR = 1.0
#: Standard errors, and log-odds, from which evidence counts.
SIGNIFICANT = 3.0
LEAST_ODDS = 3.5
#: Statistics are cut to this range for the calibration.
RANGE = (-15.0, 15.0)
#: Cost of a token without evidence, as a share of the mean evidence.
DRIFT = 0.02
#: The constant of the extreme-value law.
K = 0.1
#: Largest p-value of a reported passage.
P_VALUE = 0.05
#: ``predicted`` is 1 from this score on.
CUT = 0.7

#: Words of a shingle, and the Jaccard similarity of copies in the training sample.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of four minhashes each: at the similarity of copies, one agrees in all but 3 of 100,000 pairs.
BANDS = 20
#: Odd multipliers: seeds of the minhashes.
_ODD = np.random.default_rng(8).integers(0, 1 << 63, 4 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def word_features(word: str) -> list[str]:
    """The word itself (marked by ``$``) and its beginnings, longest first."""
    return [word + "$", *(word[:k] for k in reversed(PREFIXES) if len(word) >= k)]


def segments(scores: list[tuple[int, float]], drift: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal segments [start, end) with their scores, in linear time.

    ``scores``: position and score of each token with evidence, by position;
    every other of the ``n`` tokens scores ``-drift``.
    """
    # each entry: start, end, sum before, sum through
    found: list[list[float]] = []
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        at = pos + 1
        if s <= 0:
            total += s
            continue
        cur = [pos, pos + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j -= 1
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in found]


@dataclass
class Model:
    evidence: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    lam: float = 1.0
    slope: float = 1.0
    shift: float = -4.0
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def _evidence(self, words: list[str]) -> list[tuple[int, float]]:
        known, out = self._known, []
        if len(known) > 500_000:
            known.clear()
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = max((self.evidence[x] for x in word_features(w) if x in self.evidence), default=0.0)
            if s:
                out.append((i, s))
        return out

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """First token, token after the last, and p-value of every significant passage."""
        words = tokens(text or "")
        out = []
        for a, b, s in segments(self._evidence(words), self.drift, len(words)):
            p = -np.expm1(-K * len(words) * np.exp(-self.lam * s))
            if p <= P_VALUE:
                out.append((a, b, float(p)))
        return out

    def statistic(self, text: str | None) -> float:
        """lambda * S - ln(K * n) of the best passage; without any, that of S = 0."""
        words = tokens(text or "")
        best = max((s for _, _, s in segments(self._evidence(words), self.drift, len(words))), default=0.0)
        return float(np.clip(self.lam * best - np.log(K * max(len(words), 10)), *RANGE))

    def score(self, text: str | None) -> float:
        u = float(np.clip(self.slope * self.statistic(text) + self.shift, -30, 30))
        return float(1 / (1 + np.exp(-u)))


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(lambda * scores)) = 1."""
    weights = weights / weights.sum()
    if (scores @ weights) >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1e-3
    while weights @ np.exp(np.minimum(high * scores, 500)) < 1:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        if weights @ np.exp(np.minimum(mid * scores, 500)) < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic regression of y on x."""
    if len(np.unique(y)) < 2:
        return 1.0, -4.0
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + 1e-3 * np.array([w[0], 0])
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * mean)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and their z of features in so many toxic and clean documents."""
    n = n_toxic + n_clean
    a1, a0 = PRIOR * n_toxic / n, PRIOR * n_clean / n
    y1, y0 = toxic + a1, clean + a0
    odds = np.log(y1 / (n_toxic + PRIOR - toxic)) - np.log(y0 / (n_clean + PRIOR - clean))
    return odds, odds / np.sqrt(1 / y1 + 1 / y0)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``SHINGLE`` words; a shorter text is one run."""
    words = tokens(text or "")
    grams = {" ".join(words[i : i + SHINGLE]).encode() for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band of minhashes; sets that are alike agree in one at least."""
    least = (hashes[:, None] * _ODD).min(0).reshape(BANDS, -1)
    return [int(np.uint64(xxhash.xxh64_intdigest(row.tobytes())).astype(np.int64)) for row in least]


def distinct_documents(sample: DataFrame) -> DataFrame:
    """Without near copies: else all words of a toxic text with copies look toxic.

    A document goes only if one of its own label, with a smaller id, has the same
    shingles or a Jaccard similarity of ``SIMILAR`` at least. Bands of minhashes
    propose pairs: each document with the first and the one before it of its key.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        cols = [
            pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
            pa.array([bands(x) for x in found], pa.list_(pa.int64())),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "_set", "_bands", "_digest"])

    numbered = sample.withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    rows = materialize(arrow_map(numbered, run, schema + ", _set array<long>, _bands array<long>, _digest string"), "toxic-shingles")
    once = rows.groupBy("_label", "_digest").agg(F.min(F.struct("doc_id", "_row")).alias("_m")).select("_m._row")
    keys = rows.join(once, "_row", "left_semi").select("_label", "doc_id", "_row", F.posexplode("_bands").alias("_band", "_key"))
    w = Window.partitionBy("_label", "_band", "_key").orderBy("doc_id", "_row")
    beside = keys.select("_row", F.array(F.first("_row").over(w), F.lag("_row").over(w)).alias("_others"))
    pairs = beside.select("_row", F.explode("_others").alias("_other")).where("_other <> _row").distinct()
    sets = rows.select("_row", "_set")
    met = pairs.join(sets, "_row").join(sets.toDF("_other", "_other_set"), "_other")
    shared = F.size(F.array_intersect("_set", "_other_set"))
    copies = met.where(shared / (F.size("_set") + F.size("_other_set") - shared) >= SIMILAR).select("_row").distinct()
    return rows.join(once, "_row", "left_semi").join(copies, "_row", "left_anti").select(*sample.columns)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 3, rest: int = 1, limit: int = SAMPLE) -> Model:
    """Learn evidence and calibration from at most ``limit`` labelled documents."""
    sample = materialize(distinct_documents(labelled_sample(docs, labels, label, mod, rest, limit)), "toxic-sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist()):
            kinds[1 if y else 0].update({f for w in set(tokens(text or "")) for f in word_features(w)})
            kinds[1 if y else 0][""] += 1
        names = list(kinds[0] | kinds[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([kinds[1][f] for f in names], pa.int64()), pa.array([kinds[0][f] for f in names], pa.int64())],
            ["feature", "toxic", "clean"],
        )

    counts = arrow_map(sample, count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # a feature in fewer toxic documents can't be significant under the prior, nor one that is
    # commoner in clean ones reach LEAST_ODDS; the rest is bounded by the sample's toxic words
    sizes = counts.where("feature = ''").select(F.col("toxic").alias("n1"), F.col("clean").alias("n0"))
    likely = counts.join(F.broadcast(sizes), F.lit(True)).where("feature = '' or (toxic >= 3 and toxic * n0 > clean * n1)")
    kept = likely.select("feature", "toxic", "clean").toArrow()
    total = {f: (a, b) for f, a, b in zip(kept["feature"].to_pylist(), kept["toxic"].to_pylist(), kept["clean"].to_pylist())}
    n1, n0 = total.pop("", (0, 0))
    if not n1 or not n0:
        return Model()
    names = list(total)
    ys = np.array([total[f] for f in names], float).reshape(-1, 2)
    odds, z = log_odds(ys[:, 0], ys[:, 1], n1, n0)
    evidence = {f: float(o) for f, o, s in zip(names, odds, z) if s >= SIGNIFICANT and o >= LEAST_ODDS}
    if not evidence:
        return Model()
    model = Model(evidence, drift=DRIFT * float(np.mean(list(evidence.values()))))

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("_label").to_pylist()):
            if not y:
                words = tokens(text or "")
                hits = model._evidence(words)
                sums[-model.drift] += len(words) - len(hits)
                for _, s in hits:
                    sums[round(s, 3)] += 1
        # scores to three decimals in a bounded range: a bounded table
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())], ["s", "n"])

    tallied = arrow_map(sample, tally, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    if tallied.num_rows:
        model.lam = karlin_lambda(tallied["s"].to_numpy(), tallied["n"].to_numpy().astype(float))
    model._known.clear()

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([model.statistic(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("_label").cast(pa.int32())], ["x", "y"])

    rows = arrow_map(sample, stats, "x double, y int").toArrow()
    model.slope, model.shift = calibrate(rows["x"].to_numpy(), (rows["y"].to_numpy() != 0).astype(float))
    model._known.clear()
    release(sample)
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the significant passages of each document, as token ranges."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"first": a, "end": b, "p": p} for a, b, p in model.passages(t)] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, passages array<struct<first:int,end:int,p:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels, **how)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", how.get("mod", 3), how.get("rest", 1)).alias("held_out"), "score", (scored.score >= CUT).cast("int").alias("predicted"))
