"""Every stage of the pipeline, and the whole of it, against plain versions: rows kept and rows removed."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkprint.llm import op4_mixing, op10_quality
from inkprint.llm.common import table
from test_brute_force import brute_components, brute_tiles, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    """(doc_id, text, lang, source): banners, copies, near copies, leaks, repeats, short and empty texts."""
    rng = random.Random(seed)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (16, 24)]
    docs = []
    for i in range(70):
        body = prose(rng, rng.randrange(15, 60), 10**6)
        if i % 5 == 0:
            body = f"Banner of host 7\n{body}"
        if i % 7 == 0:
            body += " " + " ".join(items[i % 2][:rng.choice([4, 20])])
        if i % 11 == 0:
            body = " ".join([prose(rng, 9, 50)] * 6)
        docs.append([i, body, rng.choice(["en", "en", "fr", None]), rng.choice(["src0", "src0", "src1", None])])
    for i in range(70, 95):
        words = docs[rng.randrange(1, 60)][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "edit"
        docs.append([i, " ".join(words), "en", "src0"])
    for i in range(95, 130):
        docs.append([i, "Banner of host 3\n" + prose(rng, 40, 10**6), "en", "src0"])
    docs += [[130, None, "en", "src0"], [131, "", None, None], [132, "few words", "en", "src2"], [None, prose(rng, 30, 10**6), "en", "src1"]]
    return [tuple(d) for d in docs], items


def plain_quality(docs):
    def line_key(line):
        return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")

    hosts, holders = defaultdict(set), defaultdict(set)
    for _, text, _, source in docs:
        hosts[source or ""].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[source or "", line_key(line)].add(text or "")
    hot = {k for k, v in holders.items() if len(v) > 20 and len(v) > min(0.1 * len(hosts[k[0]]), 200)}
    out = []
    for doc, text, lang, source in docs:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        repeat = len({j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)})
        kept = [x for x in (text or "").split("\n") if not (WORD.search(x) and (source or "", line_key(x)) in hot)]
        left = len(WORD.findall("\n".join(kept)))
        if len(words) >= 20 and 100 * repeat <= 30 * len(words) and left >= 20 and left >= 0.3 * len(words):
            out.append((doc, "\n".join(kept), lang, source))
    return out


def plain_near(docs):
    """The smallest id of every component; a null id goes last."""
    components = brute_components([d[1] for d in docs], 5, 80, 100)
    best = {}
    for at, doc in enumerate(docs):
        if not WORD.search(doc[1] or ""):
            best[at, "alone"] = at
            continue
        key = components[at]
        rank = (doc[0] is None, doc[0] or 0)
        if key not in best or rank < (docs[best[key]][0] is None, docs[best[key]][0] or 0):
            best[key] = at
    return [docs[i] for i in sorted(best.values())]


def plain_clean(docs, items):
    return [d for d in docs if all(2 * brute_tiles(it, re.findall("[a-z0-9]+", (d[1] or "").lower()), 5) < len(it) for it in items)]


def plain_mix(spark, docs, targets, budget):
    """Fitting by plain loops; draws by the same hash of the id."""
    import xxhash

    cells, of = Counter(), {}
    for at, (_, text, lang, source) in enumerate(docs):
        words = (text or "").split()
        counts = Counter(w for w in words if len(w) > 4 and w.isalpha())
        top = min((w for w, n in counts.items() if n == max(counts.values())), default=None)
        topic = "none" if top is None else f"topic{xxhash.xxh64_intdigest(top.lower()) % op4_mixing.TOPICS}"
        own = {"source": source, "lang": lang, "topic": topic}
        of[at] = tuple(own[c] if own[c] in targets[c] and own[c] != op4_mixing.REST else op4_mixing.REST for c in targets)
        cells[of[at]] += len(words)
    total = budget * sum(cells.values())
    mass = {c: n * budget for c, n in cells.items()}
    for _ in range(op4_mixing.SWEEPS):
        for place, margin in enumerate(targets):
            have = Counter()
            for c, m in mass.items():
                have[c[place]] += m
            goals = {k: v for k, v in targets[margin].items() if have[k] > 0}
            mass = {c: min(cells[c], m * goals[c[place]] / sum(goals.values()) * total / have[c[place]] if have[c[place]] > 0 else m)
                    for c, m in mass.items()}
    ids = spark.createDataFrame([(d[0],) for d in docs], "doc_id long")
    draws = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64(F.lit(op4_mixing.SEED), "doc_id"), F.lit(1 << 53)) / float(1 << 53)).collect()}
    return [d for at, d in enumerate(docs) if draws[d[0]] < (min(1.0, mass[of[at]] / cells[of[at]]) if cells[of[at]] else budget)]


def plain_tokens(docs):
    library, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc, text, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def held(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def home(spark, make):
    docs, items = corpus()
    return make(docs, items=[(i, " ".join(it), "b", "w") for i, it in enumerate(items)])


def test_stages_and_run(spark, home):
    docs, items = corpus()
    given = table(spark, home, "documents")
    quality = plain_quality(docs)
    assert held(corpus_pipeline.quality(spark, given, home)) == sorted(quality, key=str) and 60 < len(quality) < len(docs)
    assert any(d[1].startswith("Banner") for d in docs if d[1]) and not all(d in docs for d in quality)
    near = plain_near(docs)
    assert held(corpus_pipeline.near_duplicates(spark, given, home)) == sorted(near, key=str) and len(near) < len(docs) - 15
    clean = plain_clean(docs, items)
    assert held(corpus_pipeline.decontaminated(spark, given, home)) == sorted(clean, key=str) and len(clean) < len(docs)
    mix = plain_mix(spark, docs, corpus_pipeline.MIX, corpus_pipeline.MIX_BUDGET)
    assert held(corpus_pipeline.mixed(spark, given, home)) == sorted(mix, key=str) and len(mix) < len(docs)
    got = corpus_pipeline.tokens(spark, given, home).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain_tokens(docs), key=str)

    chain = plain_clean(plain_near(quality), items)
    chain = plain_tokens(plain_mix(spark, chain, corpus_pipeline.MIX, corpus_pipeline.MIX_BUDGET))
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, home).collect()), key=str) == sorted(chain, key=str)


def test_results_held_unsaved_can_be_read(spark, home, tmp_path):
    given = table(spark, home, "documents")
    first = corpus_pipeline.quality(spark, given, home)
    second = corpus_pipeline.near_duplicates(spark, given, home)
    n = first.count()
    assert n and second.count() and first.count() == n
    # Saved and read again, as the next stage's input: then the folders go.
    first.write.parquet(str(tmp_path / "saved"))
    before = corpus_pipeline._before.get()[0]
    corpus_pipeline.mixed(spark, spark.read.parquet(str(tmp_path / "saved")), home).count()
    assert before and not set(before) & set(corpus_pipeline._before.get()[0])


def test_margins_that_cannot_be_met_are_told(spark):
    rows = spark.createDataFrame([(i, 10, "a" if i < 5 else "b") for i in range(100)], "doc_id long, n_tokens long, source string")
    found = {r["category"]: (r["target"], r["reached"]) for r in op4_mixing.residuals(
        rows, {"source": {"a": 1.0, "b": 1.0, "c": 2.0, "*": 0.0}}, 0.5).collect()}
    assert found["a"] == (0.25, pytest.approx(1 / 6)) and found["b"][1] == pytest.approx(5 / 6)  # a has 50 tokens
    assert found["c"] == (0.5, 0.0) and found["*"] == (0.0, 0.0)


def test_quality_equals_plain_equations(spark, small):
    """The whole chain in plain Python: standard scores, features one by one, a direct ridge, exact pooling, straight lines."""
    import math

    rows = {r["doc_id"]: r["x"] for r in op10_quality.described(table(spark, small, "documents")).collect()}
    label = {}
    for r in table(spark, small, "labels").where("quality IS NOT NULL").collect():
        label[r["doc_id"]] = max(r["quality"], label.get(r["doc_id"], 0))
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in rows}
    train, held = ([i for i in rows if i in label and test(fold[i])] for test in (lambda f: f > 1, lambda f: f == 1))
    size, features = len(op10_quality.STATISTICS), op10_quality.FEATURES
    mean = [sum(rows[i][j] for i in train) / len(train) for j in range(size)]
    scale = [math.sqrt(sum((rows[i][j] - mean[j]) ** 2 for i in train) / len(train)) for j in range(size)]
    scale = [s if s > 1e-9 else 1.0 for s in scale]
    rng = np.random.default_rng(op10_quality.SEED)
    w, b = rng.normal(size=(size, features)) / op10_quality.WIDTH, rng.uniform(0, 2 * np.pi, features)

    def seen(x):
        z = [max(-op10_quality.CLIP, min(op10_quality.CLIP, (v - m) / s)) for v, m, s in zip(x, mean, scale)]
        return [math.sqrt(2 / features) * math.cos(sum(z[j] * w[j, f] for j in range(size)) + b[f]) for f in range(features)] + z + [1.0]

    a, y = np.array([seen(rows[i]) for i in train]), np.array([label[i] for i in train], float)
    # Ridge as least squares with rows for the penalty; the constant is hardly held.
    weight = np.sqrt(np.full(a.shape[1], op10_quality.RIDGE * len(train) / features))
    weight[-1] = math.sqrt(1e-9)
    beta = np.linalg.lstsq(np.vstack([a, np.diag(weight)]), np.concatenate([y, np.zeros(a.shape[1])]), rcond=None)[0]
    raw = {i: float(np.dot(seen(x), beta)) for i, x in rows.items()}
    place = lambda v: min(max(math.floor((v + 0.5) / 2 * op10_quality.BINS), 0), op10_quality.BINS - 1)
    bins = defaultdict(lambda: [0, 0])
    for i in held:
        bins[place(raw[i])][0] += label[i]
        bins[place(raw[i])][1] += 1
    good, n = [bins[k][0] for k in range(op10_quality.BINS)], [bins[k][1] for k in range(op10_quality.BINS)]
    curve = op10_quality.pooled(np.array(good, float), np.array(n, float))
    # The pools, by the formula of largest lower and smallest upper means, have the curve's order of means.
    some = [k for k in range(op10_quality.BINS) if n[k]]
    share = {k: max(min(sum(good[i] for i in some if a_ <= i <= b_) / sum(n[i] for i in some if a_ <= i <= b_)
                        for b_ in some if b_ >= k) for a_ in some if a_ <= k) for k in some}
    assert all((curve[x] < curve[y_]) <= (share[x] < share[y_]) for x in some for y_ in some)

    def score(v):
        at = min(max((v + 0.5) / 2 * op10_quality.BINS - 0.5, 0.0), op10_quality.BINS - 1.0)
        low = min(math.floor(at), op10_quality.BINS - 2)
        return curve[low] + (curve[low + 1] - curve[low]) * (at - low)

    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in op10_quality.op10_quality(spark, small).collect()}
    assert set(got) == set(rows)
    for i, (out, value, predicted) in got.items():
        assert out == (fold[i] == 0) and predicted == (value >= 0.3)
        assert value == pytest.approx(score(raw[i]), abs=2e-3)
