"""Each dealt operator against brute force or held-out rows, and on inputs with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.llm import common, exact_dedup, fingerprints, html_text, jaccard_join, language_model, mixing, packing, quality, toxicity, url_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))


# --- 1 quality ---


def test_quality_held_out(spark, data):
    t = quality.op1_quality(spark, data)
    lab = spark.read.parquet(f"{data}/labels.parquet")
    rows = t.join(lab, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in t.collect())


def plain_features(text):
    """What quality.features counts, by loops over characters and words."""
    data, n = text.encode(), max(len(text.encode()), 1)
    kind = lambda c: next((k for k, codes in quality._CLASSES.items() if c in codes), "other")
    odd_kinds = {"shout", "mark", "bar", "bracket", "other"}
    names = [*quality._CLASSES, "other"]
    odd_kinds = {names[k] for k in (6, 7, 8, 9)} | {"other"}
    share = {k: sum(kind(c) == k for c in data) / n for k in names}
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0d]+", text)]
    low = [x.lower() for x in w]
    m = max(len(w), 1)
    cnt = lambda x, kinds: sum(kind(c) in kinds for c in x)
    part = lambda f: sum(map(f, w)) / m
    odd = lambda x: cnt(x, odd_kinds)
    repeated = sum(c - 1 for c in Counter(low).values()) / m
    return [*(math.sqrt(share[k]) for k in names), part(len), math.sqrt(part(lambda x: cnt(x, {"upper"}) > 1 and cnt(x, {"lower"}) == 0)), math.sqrt(part(lambda x: odd(x) > 0)), math.sqrt(part(lambda x: odd(x) > 0 and cnt(x, {"lower", "upper"}) > 0)), math.sqrt(part(lambda x: odd(x) == len(x))), math.sqrt(sum(a == b for a, b in zip(low, low[1:], strict=False)) / m), repeated * math.log1p(len(w)) / 10, math.sqrt(part(lambda x: len(x) > 20)), math.log1p(len(w)) / 10, math.sqrt(sum(kind(c) == "line" for c in data) / m)]


def test_quality_features_and_fit_by_hand(spark, data):
    import pyarrow as pa

    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["", "A", "a A a", "!!! ??", "WOW WOW x" + "y" * 30, "é | {b}\n\n"]
    got = quality.features(*common.string_buffers(pa.array(texts)))
    want = np.array([plain_features(x) for x in texts])
    assert got == pytest.approx(want, abs=1e-9)
    # The weights are where the gradient of the penalised pairwise loss is zero, over the same pairs.
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 3)), np.arange(80) % 4 > 0
    x[y] += 0.7
    model = quality.fit(x, y.astype(int))
    z, draw = (x - model["mean"]) / model["sd"], np.random.default_rng(11)
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    m = quality.PAIRS_PER_ROW * len(bad)
    diff = z[good[draw.integers(0, len(good), m)]] - z[np.resize(bad, m)]
    assert diff.T @ (1 / (1 + np.exp(diff @ model["w"]))) / m - 1e-2 * model["w"] == pytest.approx(np.zeros(3), abs=1e-6)
    assert (z @ model["w"] < model["cut"]).sum() == len(bad)


def test_quality_fit_sees_every_label(spark):
    """Bad rows that only come after the first 20,000 labels in order of a hash of doc_id are of a kind of their own: learned."""
    order = [r.id for r in spark.range(22_000).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "Some plain words, and more.", 1) if at % 2 else (i, "x%% ##&& $$" if at < 20_000 else "Some plain words, and 4567.", 0) for at, i in enumerate(order)]
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    model = quality.learn(t.select("doc_id", "text"), t.select("doc_id", "quality"))
    assert {r.quality for r in quality.accepted(t, model).select("quality").distinct().collect()} == {1}


def test_quality_blocks(spark):
    """Sums over blocks: the weights are where the gradient over the pairs of all blocks is zero; the cut is that of all scores."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, quality.N_FEATURES))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=900) > -1).astype(int)
    dealt = rng.permutation(900)
    model = quality.fit_blocks(spark.createDataFrame([(int(k), int(v), r.tolist()) for k, v, r in zip(dealt, y, x, strict=True)], "dealt long, label int, x array<double>").repartition(7), 3)
    assert model["mean"] == pytest.approx(x.mean(0)) and model["sd"] == pytest.approx(x.std(0) + 1e-6)
    z, m, grad = (x - model["mean"]) / model["sd"], 0, 0
    for block in range(3):
        own = np.flatnonzero(dealt % 3 == block)
        own = own[np.lexsort((dealt[own], y[own]))]
        better, worse = quality._pairs(y[own], quality.PAIRS_PER_ROW, [11, block])
        assert (y[own][better] == 1).all() and (y[own][worse] == 0).all() and len(better) == 40 * (y[own] == 0).sum()
        diff = z[own][better] - z[own][worse]
        m, grad = m + len(diff), grad + diff.T @ (1 / (1 + np.exp(diff @ model["w"])))
    assert grad / m - 1e-2 * model["w"] == pytest.approx(np.zeros(quality.N_FEATURES), abs=1e-6)
    s, k = np.sort(z @ model["w"]), (y == 0).sum()
    assert model["cut"] == pytest.approx((s[k - 1] + s[k]) / 2) and model["scale"] == pytest.approx(s.std())


def test_quality_nasty(nasty, empty, labels):
    model = quality.learn(nasty, labels)
    got = quality.score(nasty, model)
    assert got.count() == nasty.count() and got.where("score is null or predicted not in (0, 1)").isEmpty()
    by = defaultdict(set)
    for r in got.select("text", "score").collect():
        by[r.text or ""].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    assert quality.accepted(nasty, model).columns == nasty.columns
    assert quality.score(empty, model).isEmpty()
    none = quality.learn(nasty, labels.where("quality = 7"))
    assert {r.score for r in quality.score(nasty, none).collect()} == {0.5}
    assert quality.accepted(nasty, none).count() == nasty.count()


# --- 2 packing ---


def test_packing_round_trip(nasty, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(nasty, 64).collect()
    texts = [(r.doc_id, r.text or "") for r in nasty.select("doc_id", "text").collect()]
    want = Counter()
    for i, x in texts:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want[i, len(ids)] += 1
    got = Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)
    assert got == want
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    end = 0
    for s, o, n in at:
        assert 64 * s + o == end and o + n <= 64
        end += n
    assert end == sum(n * c for (_, n), c in want.items())
    long = [p for p in pieces if p.doc_id == 9]
    ids = [*t.encode(next(x for i, x in texts if i == 9), add_special_tokens=False).ids, 2]
    for p in long:
        assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert packing.pack(empty).isEmpty()


def test_encoder_agrees_with_the_tokenizer():
    import pyarrow as pa

    enc = packing.Encoder(packing.tokenizers(packing.TOKENIZER), limit=300)
    rng = random.Random(1)
    letters = "ab'stLVEdMÉß²½İΣσ×÷éœ_.,!#0９ \n\t\xa0漢<|>́\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["a<|endoftext|>b", "", "<|ENDOFTEXT|>", "don't stop 12ab!!"]
    for i in range(0, len(texts), 200):
        ids, counts = enc.encode(*common.string_buffers(pa.array(texts[i : i + 200])))
        want = [x.ids for x in enc.tokenizer.encode_batch(texts[i : i + 200], add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [j for x in want for j in x]


# --- 3 mixing ---


def test_mixing_matches_targets(spark, nasty, empty):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 100, 200)
    t = spark.createDataFrame([(i, int(tokens[i]), p[i].tolist()) for i in range(200)], "doc_id long, tokens long, posterior array<double>")
    have = (tokens[:, None] * p).sum(0)
    targets = (have * [0.5, 1.5, 0.8]).tolist()
    rated, misfit = mixing.fit_rates(t, targets, tolerance=1e-5)
    x = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
    assert (x >= 0).all() and max(map(abs, misfit)) < 1e-4
    assert (tokens[:, None] * p * x[:, None]).sum(0) == pytest.approx(targets, rel=1e-3)
    # The same as plain projected gradient on all rows at once.
    y = np.ones(200)
    m = (p.T * tokens) @ p / sum(targets)
    for _ in range(3000):
        y = np.maximum(0, y - p @ (((tokens * y) @ p - targets) / sum(targets)) / np.linalg.eigvalsh(m).max())
    assert np.abs(x - y).max() < 0.05
    capped, _ = mixing.fit_rates(t, targets, max_rate=1.0)
    assert capped.where("rate > 1 or rate < 0").isEmpty()


def test_posteriors_against_numpy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labelled = mixing.by_language(docs, spark.read.parquet(f"{data}/labels.parquet"))
    names = sorted(mixing.TARGETS)
    rows = {r.doc_id: r for r in docs.collect()}
    split = {i: [w for w in re.split("[\x20\x09-\x0d]+", r.text or "") if w] for i, r in rows.items()}
    vocab = sorted({w for x in split.values() for w in x})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in vocab], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    count, docs_by = defaultdict(lambda: np.zeros(len(names))), np.zeros(len(names))
    for r in labelled.collect():
        docs_by[names.index(r.domain)] += 1
        for w in split[r.doc_id]:
            count[bucket[w]][names.index(r.domain)] += 1
    total = sum(count.values())
    like = {b: np.log((c + 0.5) / (total + 0.5 * mixing.BUCKETS)) for b, c in count.items()}
    for r in mixing.mix(docs, labelled, mixing.TARGETS).collect():
        known = [like[bucket[w]] for w in split[r.doc_id] if bucket[w] in like]
        z = np.log((docs_by + 1) / (docs_by.sum() + len(names))) + sum(known, np.zeros(len(names))) / math.sqrt(max(1, len(known)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert [r.posterior[d] for d in names] == pytest.approx(p.tolist(), abs=1e-9) and r.tokens == len(split[r.doc_id])
        assert r.misfit < 1e-2


def test_unmet_targets_are_told(spark):
    t = spark.createDataFrame([(1, 10, [1.0, 0.0])], "doc_id long, tokens long, posterior array<double>")
    _, misfit = mixing.fit_rates(t, [5.0, 5.0])
    assert misfit == pytest.approx([0, -0.5], abs=1e-3)


def test_mixing_nasty(spark, nasty, empty):
    labelled = nasty.select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(nasty, labelled, mixing.TARGETS).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in nasty.select("doc_id").collect())
    assert all(abs(sum(r.posterior.values()) - 1) < 1e-9 and r.rate >= 0 for r in got)
    assert mixing.chosen(nasty, mixing.mix(nasty, labelled, mixing.TARGETS, 1.0)).columns == nasty.columns
    assert mixing.mix(empty, labelled, mixing.TARGETS).isEmpty()
    assert len(mixing.mix(nasty, labelled.where("domain = 'zz'"), mixing.TARGETS).collect()) == len(got)


# --- 4 fingerprints ---


def shingles(text, n=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_sketch(text):
    h = sorted({hashlib.md5(" ".join(x).encode()).hexdigest()[:16] for x in shingles(text)})
    return [x for x in h if x < "4" + "0" * 15] or h[:1]


def plain_likeness(a, b):
    return len({*a} & {*b}) / len({*a, *b}) if a or b else 1.0


def test_fingerprints(spark, data, nasty, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs.repartition(7)).collect()}
    error, prints = [], defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        error.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)))
        s, e, f = (plain_sketch(x) for x in (text, edited, follow))
        assert (r.fingerprint, r.edited_fingerprint) == (" ".join(s), " ".join(e))
        assert r.near_edited == pytest.approx(plain_likeness(s, e)) and r.near_next == pytest.approx(plain_likeness(s, f))
        prints[text].add(r.fingerprint)
    assert np.mean(error) < 0.08 and all(len(x) == 1 for x in prints.values())
    sure = {r.doc_id: r for r in fingerprints.fingerprint_edits(nasty).collect()}
    assert fingerprints.fingerprint_edits(nasty).count() == nasty.count()
    assert sure[2].fingerprint == "" and sure[2].n_chars == 0 and sure[9].fingerprint == " ".join(plain_sketch(nasty.where("doc_id = 9").first().text))
    assert fingerprints.fingerprint_edits(empty).isEmpty()
    one = fingerprints.fingerprint_edits(docs.limit(1)).first()
    assert one.near_next == 1


def test_containment_and_merge(spark):
    w = [f"w{i}" for i in range(4000)]
    t = spark.createDataFrame([(" ".join(w), " ".join(w[:800]), " ".join(w[3000:]))], "a string, b string, c string").select(*(fingerprints.sketch(F.col(x)).alias(x) for x in "abc"))
    r = t.select(fingerprints.containment(F.col("b"), F.col("a")).alias("in"), fingerprints.containment(F.col("a"), F.col("b")).alias("out"), fingerprints.merged(F.col("b"), F.col("c")).alias("m"), "b", "c").first()
    assert r["in"] == 1 and r["out"] == pytest.approx(0.2, abs=0.05) and r.m == sorted({*r.b, *r.c})


# --- 5 url rules ---


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(3)
    rules = url_rules.RULES + [("block", "b.net", "/a"), ("allow", "b.net", "/a/b/"), ("block", "com", ""), ("allow", "x.com", ""), ("allow", "x.com", ""), ("block", "x.com", "/q"), ("allow", "x.com", "/q")]
    hosts = ["net", "b.net", "a.b.net", "EXAMPLE.net", "m.example.com", "example.com", "x.com", "y.x.com", "org", "a.org", "", "net.", "xnet"]
    paths = ["", "/", "/a", "/a/b/", "/a/b/c", "/en/1", "/de/", "/fr/x", "/q", "?q", "#a", "/en/?a#b"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "http://", "://a.net/", "http://a.net/" + "x" * 50_000, "http://a.net/\n/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(1, urls[1], "x"), (None, urls[2], None)], "page_id long, url string, host string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == pages.count()
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == brute_url(urls[r.page_id], rules)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_rules.judge(pages, none).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), none).isEmpty()


# --- 6 toxicity ---


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    t = toxicity.op6_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    clean = [r for r in t if r.held_out and r.toxic == 0]
    assert sum(r.predicted == 0 for r in clean) / len(clean) > 0.8
    toxic = [r for r in t if r.held_out and r.toxic == 1]
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.5


def test_toxicity_gradient():
    """Every parameter's gradient against finite differences of the loss."""
    rng = np.random.default_rng(0)
    texts = [(rng.integers(1, 50, 6).astype(np.int32), rng.integers(1, 50, 6).astype(np.int32)) for _ in range(6)]
    y, weight = np.array([0, 1, 1, 0, 1, 0]), np.array([1, 2, 1, 0.5, 1, 1])
    i, j = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
    model = {k: np.asarray(v, np.float64) for k, v in toxicity.train(texts, y).items()}

    def loss():
        z = toxicity.logits(model, i, j, np.array([6] * 6))
        return np.mean(weight * (np.log1p(np.exp(z)) - y * z))

    grads, embedded = toxicity.gradients(model, texts, y, weight)
    for e, (rows, g) in embedded.items():
        grads[e] = np.zeros_like(model[e])
        grads[e][rows] = g
    for name, g in grads.items():
        g = np.atleast_1d(g)
        model[name] = np.atleast_1d(model[name])
        flat = model[name].reshape(-1)
        for at in {int(np.abs(g).argmax()), *rng.integers(0, len(flat), 3).tolist()} - ({*range(toxicity.DIM)} if name in embedded else set()):
            old = flat[at]
            sides = []
            for step in (1e-5, -1e-5):
                flat[at] = old + step
                sides.append(loss())
            flat[at] = old
            assert g.reshape(-1)[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6), name


def test_toxicity_logit_by_hand():
    """Of one text against loops over positions, widths and filters."""
    rng = np.random.default_rng(1)
    texts = [(rng.integers(1, 50, 7).astype(np.int32), rng.integers(1, 50, 7).astype(np.int32)) for _ in range(4)]
    model = toxicity.train(texts, np.array([0, 1, 1, 0]))
    first, second = texts[1]
    x = [model["e1"][a].astype(float) + model["e2"][b] for a, b in zip(first, second, strict=True)] + [np.zeros(toxicity.DIM)] * 2
    out, at = float(model["c"]), 0
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[k + s] @ model[f"w{w}"][s][:, f]) for s in range(w)) for k in range(7))
            out += max(0.0, best + model["b"][at]) * model["v"][at]
            at += 1
    assert toxicity.logits(model, first, second, np.array([7]))[0] == pytest.approx(out, rel=1e-4, abs=1e-5)


def test_toxicity_learns_from_every_label(spark):
    """An insult that only comes after the first 4,000 toxic rows in order of a hash of doc_id is learned, by several shards."""
    order = [r.id for r in spark.range(4300).orderBy(F.xxhash64("id")).collect()]
    rng = np.random.default_rng(4)
    fill = lambda: " ".join(f"word{k}" for k in rng.integers(0, 40, 6))
    rows = [(i, f"{fill()} {'drat' if at < 4000 else 'zounds'} {fill()}", 1) for at, i in enumerate(order)] + [(i, f"{fill()} {fill()}", 0) for i in range(5000, 6000)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(t.select("doc_id", "text"), t.select("doc_id", "toxic"), shard_rows=2000)
    new = [(k, f"{fill()} {w} {fill()}", w) for k, w in enumerate(["drat", "zounds", ""] * 20)]
    got = {(r.w, r.predicted) for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string, w string"), model).collect()}
    assert got == {("drat", 1), ("zounds", 1), ("", 0)}


def test_toxicity_nasty(nasty, empty, labels):
    model = toxicity.learn(nasty, labels)
    got = toxicity.score(nasty, model)
    assert got.count() == nasty.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score(empty, model).isEmpty()
    none = toxicity.learn(empty, labels)
    assert {r.predicted for r in toxicity.score(nasty, none).collect()} == {0}


# --- 7 Jaccard join ---


def brute_join(rows):
    sets, up = {}, {}
    for i, (doc, text) in enumerate(rows):
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("rare,seed,paired,bits", [(64, 1, 512, 64), (2, 2, 512, 64), (1, 3, 24, 64), (2, 4, 0, 64), (2, 5, 30, 6)])
def test_jaccard_join(spark, rare, seed, paired, bits):
    """paired 0: no pairs of tokens; bits 6: nearly all sets share their signature with another one."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, bases, rows = draw(40), [draw(rng.randint(5, 60)) for _ in range(8)], []
    for i in range(170):
        kind = rng.random()
        if kind < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += draw(rng.randint(1, 6))
        elif kind < 0.85:
            w = draw(rng.randint(0, 12)) + passage + draw(rng.randint(0, 4))
        else:
            w = draw(rng.randint(0, 30))
        rows.append((1000 - i, " ".join(w)))
    rows += [rows[3], (5, None), (6, ""), (7, "a b"), (8, "A b"), (9, "a  b\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, rare=rare, paired=paired, bits=bits).collect())
    assert got == brute_join(rows)


def test_jaccard_join_nasty(nasty, empty):
    rows = [tuple(r) for r in nasty.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(nasty).collect())
    assert got == brute_join(rows)
    assert jaccard_join.join(empty).isEmpty()


def test_jaccard_join_of_long_texts(spark):
    """70 near copies of a text of 50,000 different shingles, and a text that shares half of it."""
    base = [f"w{i}" for i in range(50_000)]
    rows = [(100 + i, " ".join([*base[: 700 * i], "x", *base[700 * i + 1 :]])) for i in range(70)] + [(5, " ".join([*base[:25_000], *(f"y{i}" for i in range(25_000))]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: 5 if i == 5 else 100 for i, _ in rows}


def test_representatives(spark):
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(5, copy), (5, "quite another text of its own kind"), (7, copy + " more"), (None, copy), (None, "alone with no id"), (3, None), (3, None), (5, copy), (9, "ends with a b c d"), (9, "ends with a b c d")]
    left = jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, left.collect())) == Counter([(5, copy), (5, rows[1][1]), (None, "alone with no id"), (3, None), (3, None), (9, "ends with a b c d")])


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in linked for y in linked)


# --- 8 exact deduplication ---


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return Counter((doc, max((d for d in groups[text or ""] if d is not None), default=None), len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()) for doc, text in rows)


def test_exact_dedup(nasty, empty):
    rows = [tuple(r) for r in nasty.select("doc_id", "text").collect()]
    for out in (exact_dedup.deduplicate(nasty), exact_dedup.deduplicate(nasty.repartition(6), files_per_trigger=1), exact_dedup.deduplicate(nasty, digest=lambda t: F.substring(F.encode(t, "utf-8"), 1, 1))):
        got = out.collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_dedup(rows)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert exact_dedup.deduplicate(empty).isEmpty()
    left = exact_dedup.survivors(nasty)
    assert left.columns == nasty.columns and Counter(r.text or "" for r in left.collect()) == Counter({t or "" for _, t in rows})


# --- 9 pages ---


def truth(page):
    i, j = page.find("<article>") + 9, page.find("</article>")
    import html

    parts = re.split(r"</?(?:p|h1)>", page[i : j if j >= 0 else len(page)])
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in parts) if x)


def test_html_text(spark):
    data = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = html_text.op9_html_text(spark, data).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == truth(pages[r.page_id]) for r in got) / len(got) > 0.98


def test_html_other_layouts(spark):
    data = "/root/testdata/sf0.01"
    model = html_text.learn(spark.read.parquet(f"{data}/pages.parquet"))
    body = "<h1>A title of it</h1><p>Some words of the first paragraph, in full.</p><p>And   the\nsecond &amp; last one.</p>"
    want = "A title of it\nSome words of the first paragraph, in full.\nAnd the second & last one."
    around = "<html><head><title>t</title><script>x</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>{}<div class='cookie-notice'>We use cookies</div><section class=comments><p>Nice post!</p></section><form><label>Mail</label></form><footer>c</footer>"
    pages = spark.createDataFrame([(1, "u", around.format(f"<main>{body}</main>"), 1), (2, "u", around.format(f"<div class='content'>{body}</div>"), 1), (3, None, None, 1), (4, "u", "", 1), (None, "u", "<p", 1), (5, "u", "<article><p>" + "word " * 60_000 + "</p></article>", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract(pages, model).collect()}
    assert got[1].text == want and got[2].text == want
    assert got[3].text == "" and got[4].text == "" and got[5].n_chars == 60_000 * 5 - 1
    assert html_text.extract(pages.limit(0), model).isEmpty()
    assert html_text.extract(pages, html_text.learn(pages.limit(0))).count() == 6


HTML_BODY = "<h1>A title of it</h1><p>Some words of the first paragraph, in full.</p><p>And the second &amp; last one.</p>"
HTML_WANT = "A title of it\nSome words of the first paragraph, in full.\nAnd the second & last one."


@pytest.fixture(scope="module")
def html_model(spark):
    return html_text.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_html_comments_and_headers_go_in_any_layout(html_model):
    around = "<body><header class=masthead><h1>The Daily</h1></header><ul class=menu><li><a href=/>Home</a></ul>{}<div id=comments><h3>Two replies</h3><p>Nice post!</p><p>I don't agree at all.</p></div><footer><p>Imprint</p></footer>"
    layouts = ["<main>{}</main>", "<article>{}</article>", "<div class='content'>{}</div>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<section class='blog-entry'>{}</section>", "<div id='story'><div class='inner'>{}</div></div>", "<center><div class='c1'>{}</div></center>"]
    got = html_text.texts(html_model, [around.format(x.format(HTML_BODY)) for x in layouts])
    assert got == [HTML_WANT] * len(layouts)


def test_html_class_names_in_the_article(html_model):
    """Names alone drop nothing from the article; comments, adverts and forms in it go."""
    names = ["search-results", "notice-text", "related-work", "main-menu", "form-intro", "share-price"]
    pages = [f"<nav><a>m</a></nav><article><h1>A title of it</h1><div class='{c}'><p>Some words of the first paragraph, in full.</p></div><p>And the second &amp; last one.</p></article>" for c in names]
    inside = ["<div class='comments'><p>Nice post!</p></div>", "<aside><p>See also</p></aside>", "<div class='ad'>Buy now</div>", "<form><p>Mail</p></form>", "<nav><ul><li><a>Next</a></ul></nav>"]
    pages += [f"<article>{HTML_BODY.replace('<p>And', c + '<p>And')}</article>" for c in inside]
    assert html_text.texts(html_model, pages) == [HTML_WANT] * len(pages)


def test_html_of_deep_and_broken_pages(html_model):
    import time

    began = time.time()
    assert len(html_text.blocks("<div>x" * 100_000)) == 100_000
    assert len(html_text.blocks("<article>" + "<div>" * 50_000 + "</p>" * 50_000 + "<b>x</b> " * 50_000)) == 1
    assert html_text.blocks("<a <b " * 100_000 + "<p '\"" * 1000) == []
    assert set(html_text.texts(html_model, ["<div>x" * 20_000])[0]) <= {"x", "\n"}
    assert time.time() - began < 60


def test_html_without_article_tags(spark):
    """A crawl none of whose pages has an article or main element yields its articles, and captions stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div class='content'>")), F.lit("</article>"), F.lit("</div>")))
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(plain, html_text.learn(plain)).collect()}
    assert sum(got[i] == x for i, x in want.items()) / len(want) > 0.9
    page = html_text.blocks("<article><h1>T</h1><figure><figcaption>A caption.</figcaption></figure><div class=tags>x</div><div class=comments>y</div></article>")
    assert html_text.taught(page) == [1, 1, 1, 0]


def test_html_of_many_blocks():
    page = "<article>" + "<p>some words of it.</p>" * 50_000 + "</article>"
    model = html_text.train([html_text.blocks("<nav><a>m</a></nav><article><p>words of it.</p></article>")] * 40, [[0, 1]] * 40)
    assert html_text.texts(model, [page, "<nav>m</nav>"])[0].count("\n") == 49_999


def test_lstm_gradient():
    """Analytic gradients against finite differences."""
    page = html_text.blocks("<html><body><nav><a>x y</a></nav><article><p>one two.</p><p>three</p></article></body></html>")
    data = html_text.inputs([page, page[:2]])
    model = {k: v.astype(np.float64) for k, v in html_text.train([page], [[0, 1, 1]], 1).items()}
    y = np.array([0, 1, 1, 0, 1], np.float32)

    def loss():
        p = html_text.label(model, data)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = html_text._gradients(model, data, y)
    rng = np.random.default_rng(0)
    for name in ("v", "wx1", "wh2", "b1", "path", "word"):
        flat, g = model[name].reshape(-1), grads[name].reshape(-1)
        for i in [*rng.integers(0, len(flat), 4), int(np.abs(g).argmax())]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-3, abs=2e-4)


# --- 10 language model ---


def test_language_model(spark, data, nasty, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language_model.score(docs, common.remainder("doc_id", 7) == 2, chunk=5_000).collect()
    texts = {r.doc_id: [*words(r.text), None] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, x in texts.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for r in out:
        x = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
    some = [r for r in out if r.held_out]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)
    again = {r.doc_id: r.score for r in language_model.score(docs.repartition(3), common.remainder("doc_id", 7) == 2, chunk=100_000).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in out)  # chunks change nothing
    got = language_model.score(nasty, F.lit(False)).collect()
    assert len(got) == nasty.count() and all(r.score <= 0 for r in got)
    assert all(r.score <= 0 for r in language_model.score(nasty, F.lit(True)).collect())
    assert language_model.score(empty, F.lit(False)).isEmpty()


def test_language_model_by_hand(spark):
    """Every customer of a small corpus seated one after the other, in dictionaries."""
    lm, rng = language_model, random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(30)]
    held = {i for i, _ in docs if i % 5 == 0}
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 5 == 0, chunk=40).collect()}
    import pyarrow as pa

    code = {w: int(h) for w, h in zip("abcdefgh", common.words(*common.string_buffers(pa.array(list("abcdefgh")))).hashes, strict=True)}
    end, big = int(lm.END), 1 << 64
    tokens = {i: [*(code[w] for w in x.split()), end] for i, x in docs}
    word, pair = Counter(), Counter()
    for i, x in tokens.items():
        if i not in held:
            word.update(x)
            pair.update(zip([end, *x[:-1]], x, strict=True))
    one = lambda key, name: int(common.mixed(np.array([(key + name) % big], np.uint64))[0] >> np.uint64(11)) / (1 << 53)

    def seat(count, pull, d, key, salt):
        tables = min(count, 1)
        for k in range(1, count):
            p = pull / (pull + k - d * tables)
            tables += one(key, k * int(lm._C[1]) + salt * int(lm._C[2])) >= 1 - p
        return tables

    n, v = sum(word.values()), len(word)
    once, twice = (sum(c == k for c in pair.values()) for k in (1, 2))
    d = min(0.95, max(0.1, once / (once + 2 * twice)))
    name = lambda u, w: int(common.mixed(np.array([(u * int(lm._C[0]) + w) % big], np.uint64))[0])
    parent = lambda w: (word[w] + 1) / (n + v + 1)
    below = lambda u: math.ceil(word[u] ** 0.75)
    root, total, models = v, None, []
    for s in range(1, lm.SWEEPS + 1):
        tables = {k: seat(c, (lm.STRENGTH + d * below(k[0])) * parent(k[1]), d, name(*k), s) for k, c in pair.items()}
        t, u = Counter(), Counter()
        for (a, b), m in tables.items():
            t[b] += m
            u[a] += m
        pull = (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * root) / (v + 1)
        seats = {w: seat(c, pull, lm.ROOT_DISCOUNT, w, 1000 + s) for w, c in t.items()}
        root, total = sum(seats.values()), sum(t.values())
        parent = lambda w, t=t, seats=seats, root=root, total=total: (max(t[w] - lm.ROOT_DISCOUNT * seats.get(w, 0), 0) + (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * root) / (v + 1)) / (lm.ROOT_STRENGTH + total)
        below = lambda x, u=u: u[x]
        models.append(lambda a, b, tables=tables, parent=parent, u=u: (max(pair[a, b] - d * tables.get((a, b), 0), 0) + (lm.STRENGTH + d * u[a]) * parent(b)) / (lm.STRENGTH + word[a]))
    for i, x in tokens.items():
        want = sum(math.log10(sum(m(a, b) for m in models[-lm.KEPT :]) / lm.KEPT) for a, b in zip([end, *x[:-1]], x, strict=True))
        assert out[i].score == pytest.approx(want, rel=1e-9)
    assert not [r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("lm_chunks")]


def test_language_model_probabilities_sum_to_one():
    """Of the parent over the known words and the place of unknown ones, and of a context's restaurant."""
    rng = np.random.default_rng(0)
    count = rng.integers(1, 9, (5, 40)) * (rng.random((5, 40)) < 0.4)  # five contexts, forty words
    d, key = 0.6, common.mixed(np.arange(200, dtype=np.uint64))
    tables = language_model.seat(count.ravel(), np.full(200, 0.7), d, key, 1).reshape(5, 40)
    assert ((tables <= count) & ((tables > 0) == (count > 0))).all()
    t = tables.sum(0)
    s = language_model.seat(t, np.full(40, 0.3), language_model.ROOT_DISCOUNT, key[:40], 2)
    stats = {"sweep": 1, "v": 40, "t": t.sum(), "s": s.sum()}
    parent = language_model._parent([np.append(t, 0), np.append(s, 0)], stats)  # last: an unknown word
    assert parent.sum() == pytest.approx(1)
    for c, m in zip(count, tables, strict=True):
        p = (np.append(c - d * m, 0) + (language_model.STRENGTH + d * m.sum()) * parent) / (language_model.STRENGTH + c.sum())
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_seating_follows_the_restaurant_rule():
    """Mean tables of many dishes with the same pull, against the exact expectation."""
    n, pull, d, m = 30, 1.5, 0.5, 20_000
    t = language_model.seat(np.full(m, n), np.full(m, pull), d, common.mixed(np.arange(m, dtype=np.uint64)), 1)
    p = np.zeros(n + 2)
    p[1] = 1
    for k in range(1, n):
        q = np.zeros_like(p)
        for j in range(1, k + 1):
            new = pull / (pull + k - d * j)
            q[j + 1] += p[j] * new
            q[j] += p[j] * (1 - new)
        p = q
    assert t.mean() == pytest.approx((p * np.arange(n + 2)).sum(), rel=0.02)
    # Beyond the customers who are seated one by one: mean and spread.
    n, pull, d = 1500, 20.0, 0.6
    t = language_model.seat(np.full(m, n), np.full(m, pull), d, common.mixed(np.arange(m, dtype=np.uint64)), 1)
    p, j = np.zeros(n + 2), np.arange(n + 2)
    p[1] = 1
    for k in range(1, n):
        new = np.minimum(1, pull / np.maximum(pull + k - d * j, 1e-9))
        q = p * (1 - new)
        q[1:] += (p * new)[:-1]
        p = q
    mean = (p * j).sum()
    assert t.mean() == pytest.approx(mean, rel=0.005) and t.std() == pytest.approx(math.sqrt((p * j * j).sum() - mean**2), rel=0.03)
    d = 0.5
    assert (language_model.seat(np.array([0, 1, 100_000]), np.ones(3), d, np.arange(3, dtype=np.uint64), 1)[:2] == [0, 1]).all()
