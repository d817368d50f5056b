from pyspark.sql import functions as F

from inkprint.config import StyloConfig
from inkprint.functions.lexicons import GENRES
from inkprint.operators import models

QUICK = StyloConfig(trees=12, rounds_per_job=6, patience=3, depth=3, step=0.3)


def labelled(spark, n=300):
    return spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 10 == 0, "test").when(F.col("id") % 10 < 3, "val").otherwise("train").alias("split"),
        ((F.col("id") % 2) * 5 + F.rand(1)).alias("strong"), F.rand(2).alias("noise"),
        F.lit(4.0).alias("constant"))


def test_trees_learn_and_pruning_drops_noise(spark, tmp_path):
    d = labelled(spark).cache()
    model = models.fit_stylometric(d, ["strong", "noise", "constant"], QUICK)
    scored = model.probability(d)
    assert scored.where((F.col("stylometric") >= 0.5) == (F.col("label") == 1)).count() == 300
    assert scored.where("constant = 4.0").count() == 300
    assert models.pruned_names(model, 0.2) == ["strong"]
    ranked = [r["feature"] for r in model.importances(spark).collect()]
    assert ranked[0] == "strong" and len(ranked) == 3
    model.save(str(tmp_path / "m"))
    again = models.StyloModel.load(str(tmp_path / "m")).probability(d)
    assert again.agg(F.sum("stylometric")).first() == scored.agg(F.sum("stylometric")).first()


def test_scaling_uses_population_deviation(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    stats = models.fit_scaler(d, ["x"])
    assert abs(stats["x"][1] - (2 / 3) ** 0.5) < 1e-12
    assert abs(models.scale(d, stats).agg(F.sum("x")).first()[0]) < 1e-12


def test_text_model(spark):
    d = spark.createDataFrame(
        [("alpha beta gamma " * 5, 0), ("delta epsilon zeta " * 5, 1)] * 20, "text string, label int")
    model = models.fit_text_model(d, 512, 1 << 10, 20, 1e-3)
    p = {r["text"][:5]: r["semantic"] for r in models.semantic_probability(d, model).collect()}
    assert p["alpha"] < 0.2 and p["delta"] > 0.8


def test_external_scores_replace_the_model(spark):
    d = spark.createDataFrame([("a",), ("b",)], "fp string")
    s = spark.createDataFrame([("a", 0.9)], "fp string, prob double")
    got = {r["fp"]: r["semantic"] for r in models.external_probability(d, s).collect()}
    assert got == {"a": 0.9, "b": 0.5}


def test_genre_of_probabilities(spark):
    d = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1],), ([0.0, 0.1, 0.2, 0.7],)], "p array<double>")
    got = d.select(models.best_genre(F.col("p")).alias("g"), models.formality(F.col("p")).alias("f")).collect()
    assert [r["g"] for r in got] == [GENRES[1], GENRES[3]]
    assert [round(r["f"], 9) for r in got] == [0.5, 0.1]


def test_registered_models_use_the_published_boosting(spark, small):
    """The trees of every query come from one training with the published settings."""
    from inkprint.functions.lexicons import FEATURE_NAMES
    from inkprint.plans import model_queries
    from inkprint.plans.registry import queries

    training = model_queries.fitted(spark, small)
    assert training.stylo_cfg == StyloConfig() and training is model_queries.fitted(spark, small)
    assert len(training.first_trees.names) == len(FEATURE_NAMES)
    for name in ("m03_stylometric_trees", "m04_stylometric_scoring"):
        scores = [r["stylometric"] for r in queries()[name](spark, small).collect()]
        assert scores and all(0 <= p <= 1 for p in scores)
    assert "detector" not in vars(training)  # trees alone were fitted


def test_scaled_features_come_from_one_pass_over_the_text(spark, small):
    from inkprint.plans.model_queries import QUERIES

    plan = QUERIES["m02_feature_scaling"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "documents.parquet" not in plan


def test_text_is_tokenised_once_in_a_fit(spark):
    """The passes of a fit read hashed terms that are kept until it is done."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        calls.add(1)
        return t

    d = spark.createDataFrame([("alpha beta " * 5, 0), ("delta zeta " * 5, 1)] * 20, "text string, label int")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    models.fit_text_model(d.withColumn("text", seen("text")), None, 1 << 10, 5, 1e-3)
    assert calls.value == 40 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_hashed_terms_leave_the_executors_memory_to_the_learner(spark, monkeypatch):
    """Nothing is cached for a fit; its terms are written, and deleted when it is done."""
    import glob

    from pyspark.sql import DataFrame

    from inkprint import session

    made, real = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: made.append(real(s, name)) or made[-1])
    monkeypatch.setattr(DataFrame, "persist", lambda *a, **k: 1 / 0)
    d = spark.createDataFrame([("alpha beta " * 5, 0), ("delta zeta " * 5, 1), (None, 1)] * 20, "text string, label int")
    model = models.fit_text_model(d, None, 1 << 10, 5, 1e-3)
    assert models.semantic_probability(d, model).count() == 60
    assert [p.rpartition("/")[2].partition("-")[0] for p in made] == ["terms"] and not glob.glob(made[0].removeprefix("file:"))
