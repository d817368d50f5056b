import os

import pytest
from pyspark.sql import functions as F

from inkprint.operators import scoring


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr).first()[0]


@pytest.mark.parametrize("p,band", [(0.35, "Human"), (0.351, "Uncertain"), (0.4999, "Uncertain"), (0.5, "AI")])
def test_sentence_bands(spark, p, band):
    assert one(spark, "p double", (p,), scoring.sentence_band(F.col("p"))) == band


@pytest.mark.parametrize("p,frac,want", [
    (0.80, 0.149, "document_ai_sentences_human"), (0.80, 0.15, "none"), (0.799, 0.0, "none"),
    (0.20, 0.851, "document_human_sentences_ai"), (0.20, 0.85, "none"), (0.201, 1.0, "none")])
def test_conflicts(spark, p, frac, want):
    assert one(spark, "p double, f double", (p, frac), scoring.score_conflict(F.col("p"), F.col("f"))) == want


def test_verdict_edges(spark):
    d = spark.createDataFrame([(1, 0.65, 0.35, 0.5)], "doc_id int, a double, b double, c double")
    got = {r["signal"]: r["verdict"] for r in scoring.explain_signals(d, ["a", "b", "c"]).collect()}
    assert got == {"a": "AI", "b": "Human", "c": "Uncertain"}
    assert one(spark, "p double", (0.5,), scoring.verdict(F.col("p"))) == "AI"
    assert one(spark, "p double", (0.2,), scoring.confidence(F.col("p"))) == pytest.approx(0.8)


def test_long_document_edge(spark):
    d = spark.createDataFrame([(49,), (50,)], "n int")
    assert [r[0] for r in d.select(scoring.long_document(F.col("n"))).collect()] == [False, True]


def test_detector_end_to_end(spark, small, tmp_path):
    """Trains once, then scores documents, reloads, and runs the inbox twice."""
    from inkprint.plans.model_queries import fitted
    from inkprint.plans.sql import documents
    from inkprint.streaming.inbox import score_inbox

    detector = fitted(spark, small).detector
    docs = documents(spark, small)
    got = detector.report(docs)
    rows = got.select("doc_id", "status", "final_prob", "label", "n_total").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["status"] == "scored":
            assert 0 <= r["final_prob"] <= 1 and r["label"] == ("AI" if r["final_prob"] >= 0.5 else "Human")
        else:
            assert r["final_prob"] is None

    detector.save(str(tmp_path / "model"))
    again = scoring.Detector.load(str(tmp_path / "model")).score(docs).select("doc_id", "final_prob")
    pairs = again.join(got.select("doc_id", F.col("final_prob").alias("p")), "doc_id")
    assert pairs.where(F.abs(F.col("p") - F.col("final_prob")) > 1e-9).count() == 0

    inbox, out = tmp_path / "inbox", tmp_path / "out"
    paths = (str(inbox), str(out), str(tmp_path / "state"))

    def deliver(folder, name, words):
        (inbox / folder).mkdir(parents=True, exist_ok=True)
        (inbox / folder / name).write_text(words)

    def rows():
        return {r["name"]: r for r in score_inbox(spark, detector, *paths).collect()}

    old = "This is a longer sentence that is here. " * 8
    deliver("one", "a.txt", old)
    deliver("one", "b.txt", "too short")
    first = rows()
    assert {k: r["status"] for k, r in first.items()} == {"a.txt": "scored", "b.txt": "too_short"}
    # Replay of one document, a changed one, a new one.
    deliver("two", "a.txt", old)
    deliver("two", "b.txt", "Another sentence arrives a little later. " * 8)
    deliver("two", "c.txt", "A third of them came with the second post. " * 8)
    second = rows()
    assert {k: r["status"] for k, r in second.items()} == {"a.txt": "scored", "b.txt": "scored", "c.txt": "scored"}
    assert second["a.txt"] == first["a.txt"] and second["b.txt"]["path"].endswith("two/b.txt")
    # A late arrival with an old date, and one more replay.
    deliver("three", "d.txt", old.upper())
    os.utime(inbox / "three" / "d.txt", (86_400, 86_400))
    deliver("three", "c.txt", "A third of them came with the second post. " * 8)
    third = rows()
    assert set(third) == {"a.txt", "b.txt", "c.txt", "d.txt"} and third["d.txt"]["status"] == "scored"
    assert all(third[k] == second[k] for k in second)
    assert spark.read.parquet(str(out)).count() == 5  # a, b twice, c, d: nothing was scored again


def test_no_row_is_scored_by_a_model_that_saw_it(spark, small, monkeypatch):
    """Every text, tree and count model of a fold is fitted without that fold's rows, and scores no others."""
    from inkprint.operators import models, ngram
    from inkprint.plans.model_queries import fitted

    full = fitted(spark, small)
    training = scoring.Training(full.corpus, full.genres)
    training.__dict__.update(semantic=full.semantic, genre=full.genre, ngrams=full.ngrams, features=full.features,
                             trees=full.trees, signals=full.signals)
    key, seen = training.key, []
    ids = lambda rows: {r[0] for r in rows.select(key).collect()}

    def watch(module, name):
        real = getattr(module, name)

        def spy(rows, *a, **k):
            model = real(rows, *a, **k)
            seen.append((name, model, ids(rows)))
            return model
        monkeypatch.setattr(module, name, spy)

    watch(models, "fit_semantic")
    watch(models, "fit_stylometric")
    watch(ngram, "fit")
    scored = []
    real = training._scored
    monkeypatch.setattr(training, "_scored", lambda rows, *used: scored.append((ids(rows), used)) or real(rows, *used))
    out = training.head_signals
    assert out.count() == full.signals.count() and out.columns == full.signals.columns
    train = ids(training.corpus.where("split = 'train'"))
    assert len(scored) == training.fuse_cfg.folds and set().union(*(s for s, _ in scored)) == train
    for rows, used in scored:
        fits = [f for _, model, f in seen if any(model is u for u in used)]
        assert len(fits) == 3 and all(f == train - rows for f in fits)
    rest = full.signals.where("split <> 'train'").select(key, "semantic")
    assert out.where("split <> 'train'").select(key, "semantic").exceptAll(rest).count() == 0


def test_independent_fits_run_at_the_same_time(spark):
    from threading import Barrier

    from inkprint.session import together

    meet = Barrier(3, timeout=30)
    assert together(*[lambda k=k: meet.wait() >= 0 and k for k in range(3)]) == [0, 1, 2]
