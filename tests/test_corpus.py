from pyspark.sql import functions as F

from inkprint.config import CorpusConfig, GenreConfig
from inkprint.operators import corpus


def labelled(spark, n, parts=8):
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))


def test_published_split_sizes(spark):
    d = corpus.stratified_split(labelled(spark, 171_356), 0.15, 0.15)
    got = {r["split"]: r["n"] for r in d.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 119_949, "val": 25_703, "test": 25_704}


def test_split_is_stratified_and_whole(spark):
    d = spark.range(1_003).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") < 100, 1).otherwise(0).alias("label"))
    s = corpus.stratified_split(d, 0.15, 0.15)
    assert s.count() == 1_003 and s.select("doc_id").distinct().count() == 1_003
    got = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got[(1, "train")] == 70 and got[(1, "val")] + got[(1, "test")] == 30


def test_split_ignores_partitioning(spark):
    a = corpus.stratified_split(labelled(spark, 5_000, 1), 0.15, 0.15)
    b = corpus.stratified_split(labelled(spark, 5_000, 13).orderBy(F.desc("doc_id")), 0.15, 0.15)
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_balanced_sample_follows_the_smaller_class(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, 1).otherwise(0).alias("label"))
    for want, each in ((1_000, 40), (30, 15)):
        got = corpus.balanced_sample(d, want).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in got} == {0: each, 1: each}


def test_balanced_sample_needs_both_classes(spark):
    d = labelled(spark, 10).withColumn("label", F.lit(0))
    assert corpus.balanced_sample(d, 100).count() == 0


def test_keep_first_with_a_hot_fingerprint(spark):
    d = spark.range(9_000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3).alias("source_rank"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("fp"))
    once = corpus.keep_first(d, corpus.load_order())
    assert once.count() == 6_001
    assert once.where("fp = 'hot'").first()["doc_id"] == 1
    assert corpus.keep_first(once, corpus.load_order()).count() == 6_001


def test_first_source_wins_a_label_conflict(spark):
    a = spark.createDataFrame([(9, "Same text", 0)], "doc_id long, text string, label int")
    b = spark.createDataFrame([(1, "same text ", 1)], "doc_id long, text string, label int")
    merged = corpus.with_fingerprint(corpus.union_sources([a, b]))
    assert corpus.keep_first(merged, corpus.load_order()).first()["label"] == 0
    narrow = corpus.first_values(merged, corpus.load_order(), ["label"])
    assert narrow.first()["label"] == 0


def test_quota_prefers_earlier_sources(spark):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("label"),
                                (F.col("id") % 4).alias("source_rank"))
    got = corpus.fill_quota(d, 30).groupBy("source_rank").count().collect()
    assert {r["source_rank"]: r["count"] for r in got} == {0: 25, 1: 5}


def test_build_corpus(spark):
    texts = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("text number "), (F.col("id") % 350).cast("string")).alias("text"),
        (F.col("id") % 2).cast("int").alias("label"), F.lit("s").alias("source"), F.lit("m").alias("model"))
    built = corpus.build_corpus([texts.where("label = 1"), texts.where("label = 0")], CorpusConfig(total_samples=200))
    assert built.count() == 200 and built.select("fp").distinct().count() == 200
    sizes = {r["split"]: r["count"] for r in built.groupBy("split").count().collect()}
    assert sizes == {"train": 140, "val": 30, "test": 30}


def test_split_moves_no_text(spark):
    d = labelled(spark, 1_000).withColumn("text", F.repeat(F.lit("x"), 100))
    plan = corpus.stratified_split(d, 0.15, 0.15)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "text" not in line


def test_genre_corpus(spark):
    """Quota from the first source first, then the next; exact stratified splits."""
    frame = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = corpus.genre_corpus([[frame(0, 30), frame(100, 200)], [frame(300, 400)], [frame(500, 520)]],
                               GenreConfig(samples_per_class=50)).collect()
    by = {y: [r for r in rows if r["label"] == y] for y in range(3)}
    assert {y: len(r) for y, r in by.items()} == {0: 50, 1: 50, 2: 20}
    assert sum(r["doc_id"] < 30 for r in by[0]) == 30
    assert {s: sum(r["split"] == s for r in rows) for s in ("train", "val", "test")} == {"train": 96, "val": 12, "test": 12}


def test_source_rank_of_five_digits(spark):
    d = spark.createDataFrame([(i, 0, r) for i, r in enumerate([10_000, 9_999, 1_000, 10_001])], "doc_id long, label int, source_rank long")
    assert sorted(r["source_rank"] for r in corpus.fill_quota(d, 2, groups=[0]).collect()) == [1_000, 9_999]


def test_load_order_is_wide(spark):
    big = (1 << 62) + 5
    d = spark.createDataFrame([(0, big), (1, 0), (1_000_000, big), (0, 1)], "source_rank long, doc_id long")
    got = d.select("source_rank", "doc_id", corpus.load_order().alias("o")).orderBy("o").collect()
    assert [(r[0], r[1]) for r in got] == sorted((r[0], r[1]) for r in got) and len({r["o"] for r in got}) == 4


def test_other_languages_go(spark):
    from inkprint.operators import langid
    train = spark.createDataFrame([("the quick brown fox and the other thing", "en"), ("der schnelle braune fuchs und das ding", "de")] * 5,
                                  "text string, lang string")
    rows = spark.createDataFrame([(0, "another thing and the fox"), (1, "das braune ding und der"), (2, "日本語日本語")], "load_order long, text string")
    assert sorted(r["load_order"] for r in corpus.speaking(rows, langid.fit(train), ("en",)).collect()) == [0, 2]
