"""Operators without SQL against brute force, exact round trips or planted cases."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkprint.llm import common, op1_repeats, op2_warc, op3_repair, op4_mixing, op5_line_frequency
from inkprint.llm import op6_ngram_join, op7_tiling, op8_language, op9_secrets, op10_quality, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def near_copies(seed=1):
    """Families with few and many edits, exact copies, a boilerplate passage, and short texts."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 40, 100_000), []
    for family in range(12):
        base = prose(rng, rng.randrange(6, 120), 100_000).split()
        for _ in range(rng.randrange(2, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**9)}"
            texts += [" ".join(own)] * rng.choice([1, 1, 3])
    texts += [f"{prose(rng, rng.randrange(0, 60), 100_000)} {passage}" for _ in range(60)]
    texts += [passage, passage.upper(), "a b c", "a  b\tc", "a", "", "A b C", None]
    return texts


def shingles(text, k):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
@pytest.mark.parametrize("frequent,block", [(50, 2_000), (2, 3)])
def test_components(spark, monkeypatch, k, num, den, frequent, block):
    """Also with almost all shared tokens in frequent classes and tiny blocks."""
    monkeypatch.setattr(op6_ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(op6_ngram_join, "LOCAL", min(frequent, 3))
    monkeypatch.setattr(op6_ngram_join, "BLOCK", block)
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in op6_ngram_join.components(frame(spark, texts), k=k, num=num, den=den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_signatures_meet():
    """Linked sets share an indexed signature of the shorter and one of the longer, whatever is frequent."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(2, 200))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        swaps = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[swaps:], rng.integers(0, 1 << 62, int(rng.integers(0, swaps + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) < 2 or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        x, y = sorted((a, b), key=len)
        often = set(rng.permutation(np.union1d(a, b))[:int(rng.integers(0, n + 1))].tolist())
        own = []
        for s, probes in ((x, False), (y, True)):
            common_ = np.array(sorted(t for t in s.tolist() if t in often), np.uint64)
            rare = np.array(sorted(t for t in s.tolist() if t not in often), np.uint64)
            sig, index = op6_ngram_join.signatures(rare, common_, len(s), op6_ngram_join._band(len(y)), probes, 85, 100)
            own.append(set(sig[index].tolist()) if not probes else set(sig.tolist()))
        assert own[0] & own[1]


def test_connected(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    near, root = defaultdict(set), {}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = root.get(x, x)
                todo += near[y]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == root


# --- substring dedup ---


def brute_repeats(texts, least):
    seen, out = {}, {}
    cut = [[(m.start(), m.end()) for m in re.finditer(r"[^\s].*?(?:[.!?](?=\s|$)|(?=\s*(?:\n|$)))", t or "")] for t in texts]
    keys = [[" ".join((t or "")[a:b].lower().split()) for a, b in c] for t, c in zip(texts, cut)]
    for i, own in enumerate(keys):
        for key in own:
            seen.setdefault(key, i)
    for i, own in enumerate(keys):
        here, repeat = set(), []
        for key in own:
            repeat.append(seen[key] < i or key in here)
            here.add(key)
        line = [(texts[i] or "").count("\n", 0, a) for a, _ in cut[i]]
        gone = [all(r for r, x in zip(repeat, line) if x == here) for here in line]
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and repeat[end]:
                end += 1
            if sum(len(k.split()) for k in own[at:end]) >= least:
                gone[at:end] = [True] * (end - at)
            at = max(end, at + 1)
        out[i], at = [], 0
        while at < len(own):
            end = at
            while end < len(own) and gone[end]:
                end += 1
            if end > at:
                out[i].append((cut[i][at][0], cut[i][end - 1][1]))
            at = max(end, at + 1)
    return out


def test_repeats(spark):
    rng = random.Random(4)
    common_ = [prose(rng, 6, 9_000) + "." for _ in range(12)]
    passage = " ".join(common_[:8])
    texts = []
    for i in range(40):
        own = [prose(rng, rng.randrange(2, 14), 9_000).capitalize() + rng.choice(".!?") for _ in range(8)]
        if i % 4 == 0:
            own.insert(3, passage if i % 8 else passage.replace(" ", "\n", 2))
        if i % 3 == 0:
            own.insert(1, common_[9])
        texts.append(rng.choice([" ", "\n"]).join(own))
    texts += ["", None, passage, "é ü 😀 " + passage, (passage + "\n") * 3]
    got = {r["doc_id"]: r for r in op1_repeats.without_repeats(frame(spark, texts)).collect()}
    want = brute_repeats(texts, op1_repeats.MIN_WORDS)
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == want[i], i
        edges = [0, *[x for s in want[i] for x in s], len(t or "")]
        assert (got[i]["text"] or "") == "".join((t or "")[a:b] for a, b in zip(edges[::2], edges[1::2]))
    assert sum(map(bool, want.values())) > 8


def test_short_repeats_are_cut(spark):
    """Repeated lines of any length go, and a passage on both sides of an edited sentence; three words in a new line stay."""
    line = "Licensed to all under the terms of the free licence of 2004"
    head, tail = "The mill stood by the river.", "Nobody had lived there for years."
    texts = [f"One is new here\n{line}\n{head} It was old. {tail}", f"Two is new here\n{line}\n{head} It was grey. {tail}",
             f"{line}\nThree is new here", "Four is new. It was old. And so it ends", "The.\nFive is new", "Six is new.\nThe."]
    got = {r["doc_id"]: r["text"].split() for r in op1_repeats.without_repeats(frame(spark, texts)).collect()}
    assert got == {0: texts[0].split(), 1: "Two is new here It was grey.".split(), 2: "Three is new here".split(),
                   3: texts[3].split(), 4: texts[4].split(), 5: "Six is new.".split()}


# --- archives ---


def test_archives_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 900) + "</p>") for i in range(120)]
    seen = []
    for n in (1, 7):
        home = str(tmp_path / f"w{n}")
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        listed = op2_warc.write(pages, home, shard_bytes=9_000, roll_bytes=1_500).orderBy("file").collect()
        seen.append({r["file"]: (tmp_path / f"w{n}" / r["file"]).read_bytes() for r in listed})
        assert {p.name for p in (tmp_path / f"w{n}").iterdir() if not p.name.startswith(".")} == set(seen[-1])
        ids = [r["first_id"] for r in listed]
        assert ids == sorted(ids) and len(listed) > 8
    assert seen[0] == seen[1]


def test_archive_ids_are_whole_numbers(spark, tmp_path):
    """Ids above 2^53 next to a null: the largest keeps the payload, all others refer to exactly that id."""
    big = 1 << 62
    rows = [(big + 1, "u", "<p>same</p>"), (big + 2, "v", "<p>same</p>"), (None, "w", "<p>same</p>"), (None, "x", "<p>own</p>"),
            (None, "y", "<p>own</p>"), (7, None, None), (big + 1, "z", "<p>other</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    home = str(tmp_path / "w")
    listed = op2_warc.write(pages, home, shard_bytes=12)
    assert listed.count() > 2  # rows without an id are in several shards
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in op2_warc.read(listed, home).collect()), key=str)
    want = [(big + 1, "u", "revisit", big + 2), (big + 2, "v", "response", None), (None, "w", "revisit", big + 2), (None, "x", "response", None),
            (None, "y", "response", None), (7, "about:blank", "response", None), (big + 1, "z", "response", None)]
    assert got == sorted(want, key=str)


# --- token shards ---


def test_ids_equal_the_library(spark):
    rng, encoder, library = random.Random(5), op3_repair.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    parts = ["a", "Word", " ", "  ", "\n", ".", "'s", "é", "12", "!", "\t", "\x1c", "<|endoftext|>", "_", "²", "ß", "́", "漢", " ", "\r\n"]
    for _ in range(3_000):
        text = "".join(rng.choices(parts, k=rng.randrange(16)))
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_round_trip():
    rng = np.random.default_rng(6)
    docs = [rng.zipf(1.4, rng.integers(1, 300)) % 50_000 for _ in range(200)] + [np.zeros(500, np.int64), np.array([0])]
    docs += [np.tile([5, 6, 7, 8], 400)]
    shard = op3_repair.Shard(op3_repair.pack(list(range(len(docs))), [d.astype("<u4").tobytes() for d in docs])[0])
    assert len(shard.rules) > 10 and len(shard.sequence) < sum(map(len, docs))
    for i, (d, back) in enumerate(zip(docs, shard.documents())):
        assert back.tolist() == d.tolist() == shard.document(i).tolist()
        at = len(d) // 2
        assert shard.token(i, at) == d[at]


@pytest.mark.parametrize("bits", [2, 18])
def test_no_frequent_pair_is_left(monkeypatch, bits):
    """Also where many pairs share a bucket; a long copy ends up as one symbol a document."""
    monkeypatch.setattr(op3_repair, "BUCKET_BITS", bits)
    rng = np.random.default_rng(12)
    copy = rng.integers(0, 50_000, 600)
    docs = [copy] * 40 + [rng.zipf(1.4, rng.integers(1, 300)) % 50_000 for _ in range(200)] + [np.full(500, 7)]
    ids, last = np.concatenate(docs).astype(np.uint32), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    _, _, seq, ends = op3_repair.compress(ids, last)
    pairs = np.stack([seq[:-1], seq[1:]], 1)[~ends[:-1]]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < op3_repair.MIN_COUNT
    assert np.flatnonzero(ends)[:40].tolist() == list(range(40))
    shard = op3_repair.Shard(op3_repair.pack(list(range(len(docs))), [d.astype("<u4").tobytes() for d in docs])[0])
    assert all(back.tolist() == d.tolist() for d, back in zip(docs, shard.documents()))


def test_shard_query(spark, small):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    rows = common.table(spark, small, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op3_repair.op3_repair(spark, small).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_added_tokens_in_texts(spark, make):
    """The query's ids are the library's, its switches left as they are."""
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["plain words", "<|endoftext|>", "a page <|endoftext|> and the next<|endoftext|>one", "< |endoftext|>", "\x1c <|endoftext|>  x"]
    got = op3_repair.op3_repair(spark, make([(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert want[1] == [50256, 0]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    assert [r["start"] for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]


# --- mixing ---


def test_margins_are_met():
    rng = np.random.default_rng(7)
    tokens = rng.integers(500, 1_500, 60).astype(float)
    a, b = np.arange(60) % 3, np.arange(60) % 5
    mass = op4_mixing.rake(tokens, [(a, np.array([3., 2, 1])), (b, np.ones(5))], 0.3 * tokens.sum())
    assert mass.sum() == pytest.approx(0.3 * tokens.sum()) and (mass <= tokens).all()
    assert np.bincount(a, mass) / mass.sum() == pytest.approx([1 / 2, 1 / 3, 1 / 6])
    assert np.bincount(b, mass) / mass.sum() == pytest.approx([0.2] * 5)


def test_exhausted_cells_stay_whole():
    mass = op4_mixing.rake(np.array([10., 1_000]), [(np.array([0, 1]), np.array([1., 1]))], 500)
    assert mass[0] == 10 and mass[1] <= 1_000


def test_sample_follows_probabilities(spark):
    rows = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("n_tokens"),
                                      F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    out = op4_mixing.mixed(rows, {"source": {"s0": 2.0, "s1": 1.0, "*": 1.0}}, 0.4)
    got = {r["source"]: (r["p"], r["share"]) for r in out.groupBy("source").agg(
        F.max("probability").alias("p"), F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert {s: p for s, (p, _) in got.items()} == pytest.approx({"s0": 0.6, "s1": 0.3, "s2": 0.3})
    assert all(abs(p - share) < 0.02 for p, share in got.values())


# --- frequent lines ---


def test_frequent_lines(spark, make):
    """A banner in many texts of a host goes; copies of one text don't make its lines frequent."""
    rng = random.Random(8)
    copied = "\n".join(prose(rng, 12, 9_000) for _ in range(4))
    docs = [(i, "Banner 7 HERE\n" + prose(rng, 30, 9_000), "en", "a") for i in range(60)]
    docs += [(100 + i, copied, "en", "a") for i in range(40)] + [(200, "banner 1 here\nbanner 2  here\n" * 12, "en", "a")]
    docs += [(300, "Banner 7 here\n" + prose(rng, 30, 9_000), "en", "b")]
    got = {r["doc_id"]: r for r in op5_line_frequency.op5_line_frequency(spark, make(docs)).collect()}
    assert all(got[i]["kept"] and got[i]["removed_lines"] == "0" and got[i]["n_removed_words"] == 3 for i in range(60))
    assert all(got[100 + i]["kept"] and got[100 + i]["removed_lines"] == "" for i in range(40))
    assert not got[200]["kept"] and got[300]["kept"] and got[300]["removed_lines"] == ""


def test_cleaned_texts(spark, make):
    home = make([(i, f"Banner\n{prose(random.Random(i), 30)}\nend {i}", "en", "a") for i in range(40)])
    docs = common.table(spark, home, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in op5_line_frequency.cleaned(docs).collect()}
    # "end 00" is one line after digits are normalised, for ids of equal length.
    assert after == {i: "\n".join(x for x in t.split("\n") if x != "Banner" and not (x.startswith("end") and i > 9))
                     for i, t in before.items()}


# --- tiling ---


def test_tiling(spark):
    rng = random.Random(9)
    item = prose(rng, 40, 10**6).split()
    moved = item[20:30] + ["x"] + item[0:20] + ["y"] + item[30:]
    texts = [" ".join(item), prose(rng, 50, 10**6) + " " + ", ".join(item[:25]).upper() + " tail", " ".join(moved),
             " ".join(item[:10]), prose(rng, 60, 10**6), " ".join(w for i, w in enumerate(item) if i % 4), None, ""]
    items = spark.createDataFrame([(5, " ".join(item)), (6, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in op7_tiling.tiled(frame(spark, texts), items).collect()}
    assert {i: r["matched_words"] for i, r in got.items()} == {0: 40, 1: 25, 2: 40}
    assert got[2]["tiles"] == 3 and got[2]["longest"] == 20
    many = op7_tiling.tiled(frame(spark, texts), items.union(items.selectExpr("item_id + 10", "text")), block_words=10)
    assert sorted((r["doc_id"], r["item_id"]) for r in many.collect()) == [(d, i) for d in range(3) for i in (5, 15)]


def test_short_items_and_null_ids(spark):
    """Three and four words are found inside texts; fewer only as whole texts; items without an id count."""
    rows = [(None, "the quick brown fox jumps over"), (1, "red green blue"), (2, "one two"), (3, "single"), (3, "A, b; c. D!"), (4, "")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = ["all of red, GREEN blue and more red green blue", "red green", "one two", "there is one two here", "single", "a single word",
             "x a b c d", "see the quick brown fox jumps over it", "a b c", None, ""]
    got = sorted((r["doc_id"], str(r["item_id"]), r["matched_words"], r["coverage"]) for r in op7_tiling.tiled(frame(spark, texts), items).collect())
    assert got == [(0, "1", 3, 1.0), (2, "2", 2, 1.0), (4, "3", 1, 1.0), (6, "3", 4, 1.0), (7, "None", 6, 1.0)]


def brute_tiles(item, doc, least):
    """The textbook rounds: all longest common unmarked runs, marked from the left, until too short."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = []
        most = least
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and not a[j + n] and not b[i + n]:
                    n += 1
                if n > most:
                    most, best = n, [(j, i)]
                elif n == most:
                    best.append((j, i))
        if not best:
            return covered
        for j, i in best:
            if not any(a[j:j + most]) and not any(b[i:i + most]):
                a[j:j + most] = [True] * most
                b[i:i + most] = [True] * most
                covered += most


def test_tiled_words_equal_the_textbook():
    """Words under tiles are the textbook's count, with and without tiles."""
    rng, none, some = random.Random(10), 0, 0
    for _ in range(150):
        item = [f"v{rng.randrange(6)}" for _ in range(rng.randrange(3, 30))]
        doc = [f"v{rng.randrange(6)}" for _ in range(rng.randrange(0, 40))]
        own = [w for w, *_ in op7_tiling.plain_words(pa.array([" ".join(item), " ".join(doc)]))][0]
        y = own[len(item):]
        block = op7_tiling.Block([0], [" ".join(item)], 3)
        there, _ = words.shingle_hashes(y, np.array([0, len(y)]), 3)
        tiles = [t for _, t in block.pairs(y, there, block.places(there))]
        want = brute_tiles(item, doc, 3)
        assert (sum(n for n, *_ in tiles[0]) if tiles else 0) == want
        none, some = none + (not tiles), some + bool(tiles)
    assert none > 20 and some > 20


def test_decontamination_stage_both_ways(spark, make):
    """The pipeline's stage removes the documents that brute force finds, and no other."""
    import corpus_pipeline

    rng = random.Random(13)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (16, 24, 30)]
    texts = []
    for _ in range(60):
        item, at = rng.choice(items), rng.randrange(10)
        texts.append(prose(rng, rng.randrange(5, 40), 10**6).split() + item[at:at + rng.randrange(0, 24)] + prose(rng, 5, 10**6).split())
    clean = {i for i, t in enumerate(texts) if all(2 * brute_tiles(it, t, 5) < len(it) for it in items)}
    home = make([(i, " ".join(t), "en", "a") for i, t in enumerate(texts)],
                items=[(i, " ".join(it), "b", "w") for i, it in enumerate(items)])
    out = corpus_pipeline.decontaminated(spark, common.table(spark, home, "documents"), home).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(clean) and 10 < len(clean) < 50


# --- language, secrets, quality ---


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in common.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in op8_language.op8_language(spark, sf).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def plain_language(labelled, texts, fit_rows, max_words, max_grams):
    """The method in plain Python: counts by language, each language's most frequent entries, longest known n-grams."""
    import math
    from collections import Counter

    langs = sorted({x for _, t, x in labelled if x is not None and t is not None})
    word_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    words_, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for _, t, x in labelled:
        if x is not None and t is not None:
            for w in word_of(t):
                words_[x][w] += 1
                for n in range(1, 5):
                    grams[x].update(f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n))

    def table(counts, most):
        own = {w for x in langs for w, _ in sorted(counts[x].items(), key=lambda e: (-e[1], e[0]))[:most // len(langs)]}
        rows = {w: [math.log((counts[x][w] + 0.5) / (sum(counts[x].values()) + 0.5 * most)) for x in langs] for w in own}
        return {w: [v - max(r) for v in r] for w, r in rows.items()}

    by_word, by_gram, out = table(words_, max_words), table(grams, max_grams), []
    for t in texts:
        heard = word_of(t or "")
        total = [0.0] * len(langs)
        for w in heard:
            row = by_word.get(w)
            for n in range(4, 0, -1):
                if row is None:
                    spelt = f"<{w}>" if n > 1 else w
                    known = [by_gram[g] for i in range(len(spelt) - n + 1) if (g := spelt[i:i + n]) in by_gram]
                    row = [sum(v) / len(known) for v in zip(*known)] if known else None
            total = [a + b for a, b in zip(total, row or total and [0.0] * len(langs))]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        odds = sum(math.exp((v - total[best]) / max(len(heard), 1) * min(len(heard), 20)) for v in total)
        out.append((langs[best], 1 / odds) if heard else ("und", 0.0))
    return out


@pytest.mark.parametrize("most", [40, 4_000])
def test_languages_equal_a_plain_scorer(spark, most):
    """Words, back-off and scores; with small tables a rare language keeps its words beside a common one."""
    rng = random.Random(most)
    spell = {"de": "aeinrstüß", "en": "aehinorst", "fr": "aeéinrstu"}
    text = lambda x, n: " ".join("".join(rng.choices(spell[x], k=rng.randrange(1, 7))) for _ in range(n))
    labelled = [(i, text(x, 30), x) for i, x in enumerate(["en"] * 40 + ["de"] * 10 + ["fr"] * 2)] + [(90, None, "en"), (91, "x y", None)]
    texts = [text(x, n) for x in spell for n in (1, 5, 60)] + ["", None, "12 !", "日本 the", "it's a-b 3c", "x" * 9_000, "a " * 5_000]
    model = op8_language.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"), max_words=most, max_grams=most)
    want = plain_language(labelled, texts, 4_000, most, most)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op8_language.predict(frame(spark, texts), model).collect()}
    for i, (name, score) in enumerate(want):
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=1e-4), texts[i][:40]


def test_unseen_words_fall_back(spark):
    docs = spark.createDataFrame([(i, "the thing with thought", "en") for i in range(9)]
                                 + [(20 + i, "der schnelle zug und schnee", "de") for i in range(9)], "doc_id long, text string, lang string")
    model = op8_language.fit(docs)
    scorer = op8_language.Scorer(model)
    assert scorer("thinking thorough")[0] == "en" and scorer("Schnecke schnell")[0] == "de"
    assert scorer("12 34 ² !")[0] == scorer(None)[0] == scorer("")[0] == "und"
    assert scorer("日本語") == ("de", 0.5)  # letters without evidence: a tie


def test_secrets_equal_plain_matching(spark, make):
    rng = random.Random(11)
    parts = ["password", "=", ": ", "token", "'", '"', "secret", "API_KEY", "apikey", "AKIA", "ABCD0123", "deadbeef", "0123456789ab",
             " ", "xyz", "é😀", "hunter2hunter2", "-----BEGIN RSA PRIVATE KEY-----", "://", "http", "u:p@", "ghp_" + "a1" * 20]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(300)]
    want = {}
    for i, t in enumerate(texts):
        found = []
        for rank, rule in enumerate(op9_secrets.RULES):
            for m in re.finditer(rule.pattern, t, re.ASCII):
                if len(m[rule.group]) >= rule.least:
                    found.append((m.start(), rank, m.end(), rule.kind))
        want[i] = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
    got = {r["doc_id"]: r["spans"] for r in op9_secrets.secrets(frame(spark, texts)).collect()}
    assert got == want


def test_trigram_queries():
    q = op9_secrets.trigram_query
    assert q("AKIA[A-Z]+") == ("and", ("aki", "kia")) and q("[0-9a-f]+") is True and q("ab?c?") is True
    assert q("(?:abc|xyzw)d*") == ("or", ("abc", ("and", ("xyz", "yzw"))))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in op10_quality.op10_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_pooling():
    assert op10_quality.pooled(np.array([0., 3, 1, 4]), np.array([4., 4, 4, 4])).tolist() == sorted(
        op10_quality.pooled(np.array([0., 3, 1, 4]), np.array([4., 4, 4, 4])).tolist())
