"""Operators against brute force, on small inputs with odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from titleforge.llm import components, embedding_dedup, exact_topk, mixing, quality_classifier, secret_scan, sentencepiece_codec, simhash_dedup, substring_dedup, toxicity, url_filter

EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# op1


def test_url_rules_and_empty(spark):
    urls = ["http://A.org/x", "http://x.Example.org/es/1", "http://example.org/en/12", "http://b.com/fr/1", "http://b.com/de/1", "https://borg/x", "http://c.net/p?q=/#f", "no scheme", None, "http://e.org", "http://f.org?x=/", "http://b.com/fr/1"]
    rows = spark.createDataFrame([(i if i != 11 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge_urls(rows).collect()
    assert len(got) == len(urls)
    by = {r.page_id: r for r in got}
    assert [by[i].rule for i in range(11)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [by[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (by[6].host, by[6].path) == ("c.net", "/p") and (by[7].host, by[7].path) == ("", "") and (by[8].host, by[8].path) == ("", "")
    assert by[7].verdict == by[8].verdict == "block" and (by[10].host, by[10].path) == ("f.org", "")
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_url_model_prefers_likely_urls(spark):
    rows = [(i, f"http://good{i % 7}.org/news/{i}") for i in range(200)] + [(1000 + i, f"http://bad{i % 7}.com/de/pills/{i}") for i in range(200)] + [(5000, "http://good9.net/news/77"), (5001, "http://bad9.net/de/pills/7")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 5000").collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block" and got[5000].score > 0 > got[5001].score


def test_url_ratios_match_brute_force(spark):
    urls = ["ab/1", "abc/2", "ab/xyz", "zz/9"]
    folded = [re.sub("[0-9]", "0", u) for u in urls]
    kinds = ["allow", "allow", "block", "block"]
    k = url_filter.ORDER
    grams = [(("^" * k + u + "$")[i : i + k + 1], kind) for u, kind in zip(folded, kinds) for i in range(len(u) + 1)]
    counts = {}
    for g, kind in grams:
        counts.setdefault(g, {"allow": 0, "block": 0})[kind] += 1

    def prob(text, kind):
        if not text:
            return 1 / len(url_filter.SYMBOLS)
        ctx = text[:-1]
        own = [(g[-len(text) :], c[kind]) for g, c in counts.items()]
        n = {}
        for s, c in own:
            if s[:-1] == ctx and c:
                n[s] = n.get(s, 0) + c
        total, low = sum(n.values()), prob(text[1:], kind)
        return (n.get(text, 0) + len(n) * low) / (total + len(n)) if total else low

    df = spark.createDataFrame([(g, c["allow"], c["block"]) for g, c in counts.items()], "_gram string, allow long, block long")
    for r in url_filter.ratios(df).collect():
        assert r._ratio == pytest.approx(np.log(prob(r._gram, "allow") / prob(r._gram, "block")))


# op2


def test_mixing(spark, docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == 7
    sizes = {None: 0, "a": 27, "b": 6, "c": 15000}
    total = sum(sizes.values())
    weights, left, target = {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * total, {}
    while True:
        w = sum(v for k, v in weights.items() if k not in target)
        over = [k for k in weights if k not in target and left * weights[k] / w > 2 * sizes[k]]
        if not over:
            target |= {k: left * weights[k] / w for k in weights if k not in target}
            break
        for k in over:
            target[k] = 2.0 * sizes[k]
        left = 1.5 * total - sum(target.values())
    by_size = {r.source_size: r.target for r in got}
    assert by_size == pytest.approx({sizes[k]: t for k, t in target.items()})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert mixing.mix_report(spark.createDataFrame([], EMPTY)).count() == 0


def test_mix_matches_report(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {r.doc_id: r for r in mixing.mix_report(df).collect()}
    counts = {r.doc_id: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    assert all(r.taken == r.size * counts.get(i, 0) for i, r in report.items())
    taken = {}
    for i, r in report.items():
        taken.setdefault(i % 4, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= 0.02 * t for a, t in taken.values())


# op3


def windows_removed(texts):
    n, seen = substring_dedup.LENGTH, {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + n] = b"\1" * n
    return cover


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñß") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(150), prose(70)
    texts = [prose(40) + shared + prose(30), prose(10) + shared[100:], shared[:700] + prose(20) + shared[200:], "ab" * 600, "x" * 399, "y" * 401, prose(200), None, "", "z" * 400, "z" * 400]
    texts += [prose(9) + line + prose(9) for _ in range(6)]
    df = spark.createDataFrame([(i if i != 6 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in substring_dedup.dedup_report(df).collect()}
    raws = [(t or "").encode() for t in texts]
    for i, (raw, cover) in enumerate(zip(raws, windows_removed(raws))):
        r = got[i if i != 6 else None]
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover)))), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substring_dedup.dedup_report(df.limit(0)).count() == 0


def test_parse_in_pieces(monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abc") for _ in range(5000))
    whole = list(substring_dedup.parse(raw))
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    windows = lambda runs: sorted(w for _, _, lo, hi in runs for w in range(lo, hi + 1))
    assert windows(whole) == windows(substring_dedup.parse(raw)) == list(range(len(raw) - substring_dedup.LENGTH + 1))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(97, 123))])
def test_corpus_order_finds_equal_windows(alphabet):
    rng = random.Random(len(alphabet))
    word = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    core = word(350)
    parts = [word(rng.randint(1, 90)) + core + word(rng.randint(60, 90)) for _ in range(12)]
    parts += [parts[0][5:], parts[1][:-3], parts[2][20:] + parts[3], word(399), word(400), parts[0]]
    seen = {}
    for i, t in enumerate(parts):
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((i, p))
    want = {x for places in seen.values() if len(places) > 1 for x in places}
    part, place = substring_dedup.ordered_repeats(parts)
    assert set(zip(part.tolist(), place.tolist())) == want and len(part) == len(want)


# op4


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_report(spark, docs):
    got = simhash_dedup.dedup_report(docs).collect()
    assert len(got) == 7
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{plain_fingerprint(t):016x}") for i, t in texts}
    by = {r.doc_id: r.component_id for r in got}
    assert by == {1: 1, 2: 1, 3: 3, 4: 3, None: None, 5: 5}
    kept = simhash_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]
    assert simhash_dedup.dedup_report(spark.createDataFrame([], EMPTY)).count() == 0
    odd = docs.withColumnsRenamed({"lang": "_simhash_fp", "source": "_SIMHASH_ROW"})
    assert simhash_dedup.deduplicated(odd).columns == odd.columns and simhash_dedup.deduplicated(odd).count() == 4


@pytest.mark.parametrize("leaves", [1, 5, 16])
def test_vantage_trees_lose_no_link(leaves):
    rng = np.random.default_rng(leaves)
    base = rng.integers(-(2**63), 2**63 - 1, 2500)
    flip = lambda x: x ^ np.left_shift(np.int64(1), rng.integers(0, 64, len(x)))
    cloud = np.full(1500, base[0])
    for _ in range(4):
        cloud = flip(cloud)
    fps = np.unique(np.concatenate([base, flip(base[:500]), flip(flip(base[:500])), cloud]))
    x, y = np.nonzero(simhash_dedup.distance(fps[:, None], fps[None, :]) <= simhash_dedup.RADIUS)
    want = dict(zip(*(v.tolist() for v in components.forest(fps[x], fps[y]))))
    tree = simhash_dedup.build_tree(rng.permutation(fps)[:800], leaves) if leaves > 1 else []
    row, leaf, home = simhash_dedup.route(tree, fps)
    assert home.sum() == len(fps)
    parts = [simhash_dedup.leaf_links(fps[row[(leaf == k) & home]], fps[row[(leaf == k) & ~home]]) for k in range(leaf.max() + 1)]
    a, b = (np.concatenate([p[i] for p in parts] + [fps]) for i in (0, 1))
    assert dict(zip(*(v.tolist() for v in components.forest(a, b)))) == want


def test_dense_links_connect_the_same():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**12, 900) << 20)
    a, b = simhash_dedup._dense(fps)
    x, y = np.nonzero(simhash_dedup.distance(fps[:, None], fps[None, :]) <= simhash_dedup.RADIUS)
    got = components.forest(np.concatenate([*a, fps]), np.concatenate([*b, fps]))
    want = components.forest(fps[x], fps[y])
    assert (got[1] == want[1]).all()


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.label for r in components.connected_components(links.repartition(7)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


# op5 and op10


def vectors(spark, n=300, d=6, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, d)) * 0.05
    rows = [(i, [float(np.float32(v)) for v in x], int(i % 3)) for i, x in enumerate(base)]
    rows += [(n, rows[0][1], 0), (n, rows[0][1], 0), (n + 20, None, 1), (n + 40, [float("nan")] * d, 1), (n + 60, [0.0] * d, 1), (n + 80, [1.0] * (d - 1), 1), (n + 100, rows[1][1], None), (n + 120, [None] + [1.0] * (d - 1), 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD", 100)
    monkeypatch.setattr(exact_topk, "QUERIES", 5)
    rows, df = vectors(spark)
    ok = [(i, np.floor(64 * np.array(x))) for i, x, _ in rows if x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for at, (q, x) in enumerate(ok):
        if q % 20 == 0:
            scored = sorted((-int(x @ y), i) for k, (i, y) in enumerate(ok) if k != at and len(y) == len(x))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    got = [tuple(r) for r in exact_topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert exact_topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("axes", [False, True])
def test_threshold_stops_early_and_exactly(axes):
    """Where few axes carry the products, most rows are never scored; ties go to the smaller id."""
    rng = np.random.default_rng(11)
    n, d, k = 4000, 24, 7
    x = np.floor(64 * rng.normal(size=(n, d)) * 0.5 ** np.arange(d))
    x[100:140] = x[0]
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0] if axes else np.eye(d)
    x = np.floor(x @ turn)
    ids = rng.permutation(n)
    lists = exact_topk.Lists(ids, np.arange(n), x, exact_topk.principal_axes(x[:1000]) if axes else None)
    rows = list(range(0, n, 40))
    wanted = []
    for row in rows:
        scores = x @ x[row]
        wanted.append(sorted(((-scores[i], ids[i]) for i in range(n) if i != row))[:k])
    none = np.full(len(rows), -np.inf)
    shares = []
    for floors in (none, np.array([-w[-1][0] for w in wanted])):
        for want, (found, got, depth, scored) in zip(wanted, lists.search(rows, x[rows], k, floors)):
            assert sorted((-s, i) for s, i in zip(got, ids[found])) == want and depth < n
            shares.append(scored / n)
    assert np.mean(shares) < 0.5


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "AIM", 12)
    monkeypatch.setattr(embedding_dedup, "LIST", 9)
    rows, df = vectors(spark)
    unit = [np.array(x) / np.linalg.norm(x) if x is not None and None not in x and np.isfinite(x).all() and any(x) and lab is not None else None for _, x, lab in rows]
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    assert sum(map(len, near)) > 20
    label = [r[0] for r in rows]
    for _ in range(len(rows)):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    want = sorted((rows[i][0], len(near[i]), label[i], rows[i][0] == label[i]) for i in range(len(rows)))
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# op6


def test_secrets(spark, docs):
    texts = [
        "api_key: 'ABCDEFGHIJKL' and token=short then secret = abcdefghijkl",
        "token: secret = abcdefghijklmnop",
        "AKIA" + "Z" * 14 + " AKIA" + "Q" * 12 + " AKIAX",
        "deadbeef" * 2 + " 0123abcd0123 é𝄞 PASSWORD=\"x" + "y" * 20,
        "id AKIA" + "Q" * 12 + " password=weakpass1 https://db.example.com/x",
        "password=weakpass1" + " " * 500 + "AKIA" + "Q" * 12,
        None,
        "",
    ]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secret_scan.scan_report(df).collect()}
    pattern = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in pattern.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        r = got[i or None]
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, _, s in sorted(base)).encode()).hexdigest(), i
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
    assert "weak_access" in got[4].spans and "weak_assign" in got[4].spans and "endpoint" in got[4].spans
    assert "weak" not in got[5].spans
    masked = secret_scan.redacted(docs)
    assert masked.columns == docs.columns and masked.count() == 7
    assert masked.where("text like '%hunter2%'").count() == 0 and masked.where("text = '[SECRET] and a word'").count() == 1
    assert secret_scan.scan_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pieces = ["password=weakpass1", "secret = abcdefghijklmnop", "AKIA" + "Q" * 12, "AKIA" + "Z" * 16, "0123abcd0123", "user: mani_7", "a.b@mail.example.com", "https://db.example.com:80/x", "10.20.30.40", "token=" + "x" * 300, "plain words "]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " " * 90, " word" * 30, " " * 230]) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    got = {r.doc_id: r.spans for r in secret_scan.scan_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assign, user, endpoint = (re.compile(p.removeprefix("(?i)"), re.I | re.A) for p in (secret_scan.ASSIGN, secret_scan.USER, secret_scan.ENDPOINT))
    for i, t in enumerate(texts):
        parts = [(m.start(), m.end(), "assign" if len(m[2]) >= 12 else "weak_assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        parts += [(m.start(), m.end(), "access" if len(m[0]) >= 18 else "weak_access") for m in re.finditer("AKIA[A-Z0-9]{12,}", t)]
        parts += [(m.start(), m.end(), "hex" if len(m[0]) >= 16 else "weak_hex") for m in re.finditer("[0-9a-f]{12,}", t) if len(m[0]) >= 16 or (re.search("[0-9]", m[0]) and re.search("[a-f]", m[0]))]
        parts += [(m.start(), m.end(), "user") for m in user.finditer(t)] + [(m.start(), m.end(), "endpoint") for m in endpoint.finditer(t)]
        role = secret_scan._ROLE
        beside = lambda p, r: any(role[k] == r and max(a - p[1], p[0] - b) <= secret_scan.SCOPE for a, b, k in parts)
        needs = {"secret": ("id",), "id": ("secret",), "endpoint": ("id", "secret")}
        told = [p for p in parts if p[2] in secret_scan.KINDS[:3] or all(beside(p, r) for r in needs[role[p[2]]])]
        want = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(told, key=lambda p: (p[0], secret_scan.KINDS.index(p[2]))))
        assert got[i] == want, t


# op7

TOY = ["<unk>", "a", "b", "ab", "ba", "aab", "abab", "▁", "▁a", "▁ab", "c"]


def toy(model):
    scores = [0.0, -3.0, -3.1, -4.0, -4.6, -6.1, -7.3, -2.0, -4.4, -6.0, -3.3] if model == sentencepiece_codec.UNIGRAM else [0.0, *(-float(i) for i in (20, 21, 1, 2, 3, 4, 22, 0, 5, 23))]
    return sentencepiece_codec.Codec(TOY, scores, [2] + [1] * (len(TOY) - 1), model)


def test_viterbi_matches_brute_force():
    codec = toy(sentencepiece_codec.UNIGRAM)

    def best(word):
        if not word:
            return 0.0
        return max(codec.score_of[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in codec.score_of)

    rng = random.Random(0)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(200)})
    for w, pieces in zip(words, codec.segment(words)):
        assert "".join(pieces) == w and sum(codec.score_of[p] for p in pieces) == pytest.approx(best(w))


def test_merging_matches_merge():
    codec = toy(sentencepiece_codec.BPE)
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("abx▁") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    assert list(codec.segment(words)) == [codec.merge(w) for w in words]


def test_production_merges_match_merge():
    codec = sentencepiece_codec.Codec.load()
    rng = random.Random(1)
    syllables = ["in", "ter", "nat", "ion", "al", "é", "ß", "日本", "𝄞", "x", "ing", "the", "▁", "ü", "tt", "0", "42"]
    words = sorted({"▁" + "".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {"▁" + "ab" * 2000, "x" * 3000})
    short = [w for w in words if len(w) < 100]
    assert list(codec.segment(short)) == [codec.merge(w) for w in short]
    assert ["".join(p) for p in codec.segment(words)] == words


def test_columns_match_texts():
    import pyarrow as pa

    codec = sentencepiece_codec.Codec.load()
    texts = ["a b", "a  b", " a", "a ", "", None, "one\ntwo three\t four", "▁ x", "\n", "x" * 700 + " y", "same same same"]
    for part in (texts, texts[2:], texts[:1], [None], []):
        got = codec.encode_column(pa.array(part, pa.string())).to_pylist()
        assert got == [x.tolist() for x in codec.encode(part)]


def test_library_agrees(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = ["", " ", "a  b\n\n c\t", "naïve 日本語 𝄞 \u0000", "x" * 500, "The quick brown fox. Internationalization!", "\n a"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sentencepiece_codec.encode_documents(df).orderBy("doc_id").collect()
    assert [r.ids for r in got] == library.encode(texts) and all(r.exact for r in got)
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(df)).orderBy("doc_id").collect()
    assert [r.text for r in back] == texts
    odd = sentencepiece_codec.encode_documents(docs).collect()
    assert len(odd) == 7 and all(r.exact for r in odd) and {r.n_ids for r in odd if r.doc_id in (3, 4)} == {0}


# op8 and op9


def labelled(spark, n=300):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileness", "vilest", "scumbag"]))
        text = " ".join(words) if good else " ".join(w.upper() + "%%%" for w in words)
        rows.append((i, text, "en"))
        labels.append((i, int(good), int(toxic)))
    rows += [(None, "plain words", "en"), (n + 1, None, "en"), (n + 2, "", None)]
    labels += [(n + 5, 1, 1), (n + 6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: (q, t) for a, q, t in labels}


@pytest.mark.parametrize(("scores", "which"), [(quality_classifier.quality_scores, 0), (toxicity.toxicity_scores, 1)])
def test_classifiers_on_held_out_rows(spark, scores, which):
    docs, labels, truth = labelled(spark)
    got = scores(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id][which] for r in held) >= 0.95 * len(held)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = scores(docs, labels.limit(0)).collect()
    assert len(none) == 303 and len({round(r.score, 9) for r in none}) <= (1 if which == 0 else 303)
    assert scores(docs.limit(0), labels).count() == 0


def test_keeping_good_documents(spark):
    docs, labels, truth = labelled(spark)
    kept = quality_classifier.keep_good(docs.withColumnRenamed("lang", "score"), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    ids = {r.doc_id for r in kept.collect()}
    assert all(i in ids for i, (q, _) in truth.items() if q == 1 and i < 300) and not any(i in ids for i, (q, _) in truth.items() if q == 0)


def test_segments_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        s = [rng.choice([-1.0, -1.0, 2.0, 3.5]) for _ in range(n)]
        found = toxicity.segments([(i, v) for i, v in enumerate(s) if v > 0], 1.0, n)
        best = max((sum(s[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((x for _, _, x in found), default=0) == pytest.approx(max(best, 0))
        assert all(sum(s[a:b]) == pytest.approx(x) for a, b, x in found)
        assert all(p[1] <= q[0] for p, q in zip(found, found[1:]))


def test_toxic_passages(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.learn(docs, labels)
    text = "una mira tonse " * 30 + "vileness " + "una mira " * 30
    (first, end, p), *rest = model.passages(text)
    assert (first, end) == (90, 91) and p <= toxicity.P_VALUE and not rest
    assert model.passages(None) == []


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark)
    docs = docs.selectExpr("doc_id", "text", "lang", "concat('s', coalesce(doc_id, 0) % 3) AS source", "cast(length(text) AS bigint) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "encode"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
    want = at.count()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == want > 100 and all(r.exact for r in got)
