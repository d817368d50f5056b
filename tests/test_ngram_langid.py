import math
from collections import Counter

import pytest

from inkprint.config import RatioConfig
from inkprint.operators import langid, ngram

CFG = RatioConfig()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def brute(train, text):
    """The two interpolated models written out over token lists."""
    docs = [t.lower().split()[:CFG.max_tokens] for t in train]
    uni, bi, tri = {}, {}, {}
    for t in docs:
        for i, w in enumerate(t):
            uni[w] = uni.get(w, 0) + 1
            if i >= 1:
                bi.setdefault(t[i - 1], []).append(w)
            if i >= 2:
                tri.setdefault((t[i - 2], t[i - 1]), []).append(w)
    z = sum(uni.values()) + len(uni) + 1
    t = text.lower().split()[:CFG.max_tokens]
    if len(t) < 2:
        return 1.0
    h2 = h3 = 0.0
    for i in range(1, len(t)):
        p = (uni.get(t[i], 0) + 1) / z
        after = bi.get(t[i - 1])
        if after:
            p = CFG.bigram_weight * after.count(t[i]) / len(after) + (1 - CFG.bigram_weight) * p
        h2 -= math.log(p)
        after = tri.get((t[i - 2], t[i - 1])) if i >= 2 else None
        if after:
            p = CFG.trigram_weight * after.count(t[i]) / len(after) + (1 - CFG.trigram_weight) * p
        h3 -= math.log(p)
    return (h2 / (len(t) - 1)) / max(h3 / (len(t) - 1), CFG.floor)


TRAIN = ["the cat sat on the mat", "the dog sat on the log", "The cat  ate", "x"]
SCORED = ["", "one", "the cat", "the cat sat on the log today", "unseen words only here", "the the the the the"]


def test_ratio_equals_brute_force(spark):
    model = ngram.fit(frame(spark, TRAIN))
    got = {r["doc_id"]: r["ratio"] for r in ngram.ratios(frame(spark, SCORED), model).collect()}
    assert got == pytest.approx({i: brute(TRAIN, t) for i, t in enumerate(SCORED)})


def test_copies_change_nothing(spark):
    model = ngram.fit(frame(spark, TRAIN))
    many = frame(spark, [SCORED[3]] * 500 + [SCORED[4]])
    got = ngram.ratios(many, model).collect()
    assert len(got) == 501 and len({round(r["ratio"], 9) for r in got}) == 2


def test_whole_texts_count(spark):
    model = ngram.fit(frame(spark, TRAIN))
    long = " ".join(["the cat sat"] * 200 + ["unseen words only here"] * 50)
    got = ngram.ratios(frame(spark, [long]), model).first()["ratio"]
    assert got == pytest.approx(brute(TRAIN, long))


def test_language(spark):
    train = spark.createDataFrame(
        [("the quick brown fox and the other thing", "en"), ("der schnelle braune fuchs und das ding", "de")] * 5,
        "text string, lang string")
    got = {r["doc_id"]: r["detected"] for r in langid.detect(
        frame(spark, ["another thing and the fox", "das braune ding und der", "", "ab", "日本語日本語"]),
        langid.fit(train)).collect()}
    assert got == {0: "en", 1: "de", 2: None, 3: None, 4: None}


def plain_counts(texts):
    rows = [["", "", *t.lower().split()] for t in texts]
    tri = Counter((a, b, c) for r in rows for a, b, c in zip(r, r[1:], r[2:]))
    return tri


def plain_model(texts, cfg):
    """P2 and P3 of the fitting text, and the bound on each trigram's loss."""
    import math

    tri = plain_counts(texts)
    uni, bi, one, two = Counter(), Counter(), Counter(), Counter()
    for (u, v, w), c in tri.items():
        uni[w] += c
        bi[v, w] += c
        if v != "":
            one[v] += c
        if u != "":
            two[u, v] += c
    n = sum(uni.values())

    def p2(v, w):
        p1 = (uni[w] + 1) / (n + len(uni) + 1)
        return cfg.bigram_weight * bi[v, w] / one[v] + (1 - cfg.bigram_weight) * p1 if v in one else p1

    def p3(u, v, w):
        return cfg.trigram_weight * tri[u, v, w] / two[u, v] + (1 - cfg.trigram_weight) * p2(v, w) if (u, v) in two else p2(v, w)

    loss = {k: c * (math.log(p3(*k)) - math.log((1 - cfg.trigram_weight) * p2(*k[1:]))) for k, c in tri.items() if k[0] != ""}
    return tri, uni, two, n, p2, p3, loss


@pytest.mark.parametrize("max_loss", [0.0, 0.02, 0.3, 50.0])
def test_pruned_trigrams(spark, max_loss):
    """What goes, the new weights, probabilities that add up to 1, and the loss of the fitting text within its bound."""
    import math
    import random

    rng, cfg = random.Random(3), ngram.RatioConfig()
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.8)), 12)}" for _ in range(rng.randrange(0, 30))) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram.pruned(spark, ngram.fit(d, cfg), max_loss)
    tri, uni, two, n, p2, p3, loss = plain_model(texts, cfg)
    kept = {(r["u"], r["v"], r["w"]): r["c"] for r in model.table(spark, "trigrams").collect()}
    gone = [k for k in loss if k not in kept]
    order, spent, want = sorted(loss.items(), key=lambda e: e[1]), 0.0, []
    for value in sorted({round(x, 9) for _, x in order}):  # equal losses go together
        same = [k for k, x in order if round(x, 9) == value]
        spent += sum(loss[k] for k in same)
        if spent > max_loss * n:
            break
        want += same
    assert sorted(gone) == sorted(want) and all(tri[k] == c for k, c in kept.items())
    weight = {(r["u"], r["v"]): r["b"] for r in model.table(spark, "after_two").collect()}

    def after(u, v, w):
        return p3(u, v, w) if (u, v, w) in kept else weight[u, v] * p2(v, w)

    lost = 0.0
    for u, v in two:
        # Words outside the vocabulary share what smoothing leaves.
        total = sum(after(u, v, w) for w in uni) + weight[u, v] * (1 - sum(p2(v, w) for w in uni))
        assert total == pytest.approx(1) and weight[u, v] >= 1 - cfg.trigram_weight - 1e-12
    for (u, v, w), c in tri.items():
        if u != "":
            lost += c * (math.log(p3(u, v, w)) - math.log(after(u, v, w)))
    assert -1e-9 <= lost <= max_loss * n + 1e-9
    assert bool(gone) == (max_loss > 0) and (max_loss < 50 or not set(loss) & set(kept))
    got = {r["doc_id"]: r["ratio"] for r in ngram.ratios(d, model).collect()}
    for i, text in enumerate(texts):
        t = ["", *text.split()]
        pairs = [(u, v, w) for u, v, w in zip(t, t[1:], t[2:])]
        h2 = [-math.log(p2(v, w)) for _, v, w in pairs]
        h3 = [-math.log(p2(v, w) if (u, v) not in two else after(u, v, w)) for u, v, w in pairs]
        assert got[i] == pytest.approx(sum(h2) / max(sum(h3), 1e-6 * len(h3)) if pairs else 1.0)


def test_tokens_are_shuffled_to_their_ngrams_once(spark):
    d = spark.createDataFrame([(1, "a b a b c"), (2, "c c c"), (2, "a b"), (None, "a b")], "doc_id long, text string")
    got = ngram.ratios(d, ngram.fit(d))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # One aggregate by document, none by document and n-gram.
    assert sum("Aggregate [doc_id" in line for line in plan.splitlines()) == 1 and got.count() == 4


def test_ngram_tables_are_never_broadcast(spark, tmp_path):
    from inkprint.operators import ngram

    d = spark.createDataFrame([(1, "a b c a b d"), (2, "a b c"), (3, "x")], "doc_id long, text string")
    out = ngram.ratios(d, ngram.fit(d, path=str(tmp_path / "n")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") >= 4
    assert {r["doc_id"]: r["ratio"] for r in out.collect()}[3] == 1.0
