"""Learned models against brute force, and every pipeline stage against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from titleforge.llm import quality_classifier, secret_scan, sentencepiece_codec, simhash_dedup, toxicity

from test_operators import labelled, plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ranking_minimises_the_pairwise_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, len(quality_classifier.FEATURES)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=200) > 0).astype(int)
    model = quality_classifier.fit(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    lose = np.repeat(bad, quality_classifier.PAIRS_EACH)
    d = z[np.random.default_rng(11).choice(good, len(lose))] - z[lose]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + quality_classifier.L2 * (w @ w) / 2
    for i in range(len(model.weight)):
        for step in (-1e-3, 1e-3):
            assert loss(model.weight) < loss(model.weight + step * np.eye(len(model.weight))[i])
    # the cut is the quantile under which the share of rejected documents lies
    assert (z @ model.weight < model.cut).mean() == pytest.approx((y == 0).mean(), abs=0.01)
    assert ((model.score(x) >= quality_classifier.CUT) == (z @ model.weight >= model.cut)).all()


def test_log_odds_and_lambda():
    odds, z = toxicity.log_odds(np.array([30.0, 1.0]), np.array([2.0, 100.0]), 50, 500)
    a1, a0 = toxicity.PRIOR * 50 / 550, toxicity.PRIOR * 500 / 550
    y1, y0 = 30 + a1, 2 + a0
    assert odds[0] == pytest.approx(np.log(y1 / (50 + toxicity.PRIOR - 30)) - np.log(y0 / (500 + toxicity.PRIOR - 2)))
    assert z[0] == pytest.approx(odds[0] / np.sqrt(1 / y1 + 1 / y0)) and odds[1] < 0
    s, w = np.array([-0.1, 4.0]), np.array([1000.0, 3.0])
    lam = toxicity.karlin_lambda(s, w)
    assert lam > 0 and (w / w.sum()) @ np.exp(lam * s) == pytest.approx(1)


def test_scores_match_brute_force():
    rng = random.Random(2)
    model = toxicity.Model({"vile$": 4.0, "scum": 5.0, "fool$": 3.6}, drift=0.08, lam=0.9, slope=1.2, shift=-1.5)
    for _ in range(60):
        words = [rng.choice(["vile", "scumbag", "fool", "mild", "word", "and"] + ["plain"] * 8) for _ in range(rng.randint(0, 40))]
        each = [max([model.evidence[f] for f in toxicity.word_features(w) if f in model.evidence], default=-model.drift) for w in words]
        best = max([sum(each[a:b]) for a in range(len(each)) for b in range(a + 1, len(each) + 1)] + [0.0])
        u = model.slope * np.clip(model.lam * best - np.log(toxicity.K * max(len(words), 10)), *toxicity.RANGE) + model.shift
        assert model.score(" ".join(words)) == pytest.approx(1 / (1 + np.exp(-u)))


def test_evidence_counts_documents(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.learn(docs, labels)
    assert {w for w in ("scumbag$", "vile", "vileness$") if w in model.evidence} and not any(f.startswith("plain") for f in model.evidence)


def test_repeated_ids_give_one_sample_row(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, i % 2) for i in range(12)], "doc_id long, quality int")
    from titleforge.llm._common import labelled_sample

    got = labelled_sample(docs, labels, "quality", 5, 0, 2).collect()
    assert len(got) <= 2 and len({r.doc_id for r in got}) == len(got) and all(r.text == f"text {r.doc_id}" for r in got)


def test_very_long_texts(spark):
    long = spark.createDataFrame([(1, "word vile " * 60_000, "x"), (2, "x" * 400_000, "y"), (3, None, None)], "doc_id long, text string, score string")
    _, labels, _ = labelled(spark)
    for scores in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        got = scores(long, labels).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


@pytest.fixture
def corpus(spark, tmp_path):
    docs, labels, _ = labelled(spark)
    rows = [(r.doc_id, r.text, r.lang, f"s{(r.doc_id or 0) % 3}", len(r.text or "")) for r in docs.collect()]
    rows += [(1000 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(20)]
    rows += [(2000, rows[1][1] + " token = abcdefghijklmnop and AKIA" + "Z" * 16, "en", "s2", 9)]
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return spark.createDataFrame(rows, COLUMNS), labels, str(tmp_path)


def bag(rows):
    return Counter(map(tuple, rows))


def test_stages_match_plain_python(spark, corpus):
    import corpus_pipeline

    docs, labels, folder = corpus
    quality, near_dedup, secrets, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    rows = docs.collect()
    model = quality_classifier.learn(docs, labels)
    x = np.array([quality_classifier.features(r.text) for r in rows])
    kept = [r for r, s in zip(rows, model.score(x)) if s >= quality_classifier.CUT]
    assert bag(quality(spark, docs, folder).collect()) == bag(kept)

    prints = [plain_fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        low = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= simhash_dedup.RADIUS) for i in range(len(rows))]
        if low == label:
            break
        label = low
    groups = {}
    for r, k in zip(rows, label):
        groups.setdefault(k, []).append(r)
    one = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert bag(near_dedup(spark, docs, folder).collect()) == bag(one)

    pattern = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)

    def masked(text):
        if text is None:
            return None
        spans = [m.span() for m in pattern.finditer(text) if len(m[2]) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{14,}", text)] + [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out, at = out + text[at:a] + secret_scan.MASK, b
        return out + text[at:]

    assert bag(secrets(spark, docs, folder).collect()) == bag([(r.doc_id, masked(r.text), r.lang, r.source, r.n_chars) for r in rows])

    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = encode(spark, docs, folder).collect()
    assert bag((r.doc_id, tuple(r.ids)) for r in got) == bag((r.doc_id, tuple(library.encode(r.text or ""))) for r in rows)

    mixed = mix(spark, docs, folder).collect()
    assert set(bag(mixed)) <= set(bag(rows)) and max(bag(mixed).values()) <= 2


def test_stages_on_empty_tables_and_extra_columns(spark, corpus):
    import corpus_pipeline

    docs, _, folder = corpus
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0, name
        if name != "encode":
            assert out.columns == docs.columns
            wide = stage(spark, docs.limit(5).selectExpr("*", "'x' AS label", "1 AS score", "2 AS fp"), folder)
            assert wide.columns == [*docs.columns, "label", "score", "fp"], name


def test_hash_is_the_stated_one():
    assert plain_fingerprint("one two three") == xxhash.xxh64_intdigest("one two three", 42) == simhash_dedup.fingerprint("one two three") % (1 << 64)


def test_quality_is_learned_from_every_labelled_document(spark):
    rng = np.random.default_rng(3)
    n, words = 600, ["alpha", "beta", "gamma", "DELTA,", "12", "x"]
    docs = [(i, " ".join(rng.choice(words[:4] if i % 3 else words[2:], 30 + i % 50))) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    used = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 0]
    x = np.array([quality_classifier.features(t) for t in used])
    many = quality_classifier.learn(df, labels, bucket=100)
    assert many.mean == pytest.approx(x.mean(0)) and many.scale == pytest.approx(x.std(0) + 1e-6)
    z = np.clip((x - many.mean) / many.scale, -8, 8) @ many.weight
    bad = sum(i % 3 == 0 for i, _ in docs if zlib.crc32(str(i).encode()) % 5 != 0)
    assert many.cut == pytest.approx(np.quantile(z, bad / len(used)))
    one = quality_classifier.learn(df, labels)
    assert np.corrcoef(one.score(x), many.score(x))[0, 1] > 0.95
