import gzip
import json
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from inkprint.functions.lexicons import FEATURE_NAMES
from inkprint.operators.corpus import with_fingerprint
from inkprint.sources import probe, readers, sinks


def texts(df):
    return sorted((r["text"], r["label"], r["model"]) for r in df.collect())


def test_qa_pairs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([
        json.dumps({"human_answers": ["h1", "h2"], "chatgpt_answers": ["c1"]}), "", "   ",
        '{"human_answers": ["cut', json.dumps({"chatgpt_answers": []}), json.dumps({"human_answers": ["h3"]})]))
    (tmp_path / "b.json").write_text(json.dumps({"chatgpt_answers": ["c2"]}))
    (tmp_path / "notes.md").write_text("ignored")
    assert texts(readers.qa_pairs(spark, str(tmp_path))) == [
        ("c1", 1, "chatgpt"), ("c2", 1, "chatgpt"), ("h1", 0, "human"), ("h2", 0, "human"), ("h3", 0, "human")]


def test_missing_source_is_empty(spark, tmp_path):
    d = readers.or_empty(lambda: readers.transcripts(spark, str(tmp_path / "none")), spark, "transcripts")
    assert d.count() == 0 and d.columns == ["doc_id", "text", "label", "source", "model"]


def test_detect_columns():
    assert readers.detect_columns(["id", "Content", "generation", "MODEL"]) == ("Content", "MODEL")
    assert readers.detect_columns(["id", "body"]) == (None, None)


def test_multi_generator(spark, tmp_path):
    rows = [("a", "Human "), ("b", "human"), ("c", "gpt4"), ("d", None)]
    spark.createDataFrame(rows, "Text string, Model string").coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("e",)], "generation string").coalesce(1).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("x",)], "body string").coalesce(1).write.parquet(str(tmp_path / "r"))
    (tmp_path / "s.csv").write_text('content,model\n"two\nlines ""quoted""",llama\n')
    got = readers.multi_generator(spark, [str(tmp_path / n) for n in ("s.csv", "p", "q", "r", "gone")])
    assert texts(got) == [("a", 0, "Human"), ("b", 0, "human"), ("c", 1, "gpt4"), ("d", 1, "None"),
                          ("e", 1, "unknown"), ('two\nlines "quoted"', 1, "llama")]
    assert got.select("doc_id").distinct().count() == 6


def test_chat_log_takes_the_first_rows_of_each_file(spark, tmp_path):
    chat = "array(struct('user' as role, 'q' as content), struct('assistant' as role, concat('t', id) as content))"
    for i in (0, 1):
        spark.range(i * 100, i * 100 + 20, 1, 1).select(
            F.when(F.col("id") % 2 == 0, "gpt-4").otherwise("other").alias("model"),
            F.expr(chat).alias("conversation")).coalesce(1).write.parquet(str(tmp_path / f"c{i}"))
    got = readers.chat_log(spark, str(tmp_path / "c*"), limit=3)
    assert sorted(r["text"] for r in got.collect()) == ["t0", "t100", "t102", "t104", "t2", "t4"]
    first = readers.chat_log(spark, str(tmp_path / "c0"), role=None)
    assert {r["text"] for r in first.collect()} == {"q"}


def test_chat_log_other_shapes(spark, tmp_path):
    rows = [('[{"role":"user","content":"q"},{"role":"assistant","content":"r"}]',), ("[]",), ("{broken",), (None,)]
    d = spark.createDataFrame(rows, "conversation string")
    assert [r[0] for r in d.select(readers.conversation_text(d)).collect()] == ["r", None, None, None]
    plain = spark.createDataFrame([(["first", "second"],), ([],)], "conversation array<string>")
    assert [r[0] for r in plain.select(readers.conversation_text(plain)).collect()] == ["first", None]


def test_transcripts(spark, tmp_path):
    lines = [{"chosen": "Human: a\n\nAssistant: x\n\nHuman: b\n\nAssistant:  last one \n"}, {"chosen": "no mark"}, {"other": 1}]
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "u.jsonl").write_text(json.dumps({"chosen": "Assistant: plain"}))
    assert texts(readers.transcripts(spark, str(tmp_path))) == [("last one", 1, "claude"), ("plain", 1, "claude")]


def test_first_paragraph(spark):
    long = " ".join(["w"] * 50)
    d = spark.createDataFrame([(f"short one\n\n {long} \n\nlater {long}",), ("short",)], "t string")
    assert [r[0] for r in d.select(readers.first_paragraph(F.col("t"), 50)).collect()] == [long, None]


def test_genre_bounds_and_cap(spark):
    d = spark.createDataFrame([(n, " ".join(["word"] * n)) for n in (39, 40, 300, 301)], "doc_id int, text string")
    got = readers.genre_rows(d, F.col("text"), 2, 40, 300).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in got) == [(40, 199), (300, 1499)]
    assert max(len(r["text"]) for r in readers.genre_rows(d, F.col("text"), 2, 40).collect()) == 1500


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9 ok".encode("latin-1") + "é".encode())
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("keeps � and\nlines")
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("caf oké", "ok") and got["c.txt"] == ("keeps � and\nlines", "ok")
    assert got.get("b.txt", ("", "empty"))[1] == "empty"


def test_page_text(spark):
    html = ("<!DOCTYPE html><title>T&amp;C</title><!-- <nav> --><script>if (a<b) '</p>'</script><p>one<b>two</b> 1 < 2</p>"
            "<header class='x'>gone<nav>menu</nav>back</header><STYLE>p{}</STYLE><footer>never closed")
    d = spark.createDataFrame([(html,)], "h string")
    assert d.select(readers.page_text(F.col("h"))).first()[0] == "T&C one two 1 < 2 back"


def test_feature_cache_computes_only_new_rows(spark, tmp_path):
    d = with_fingerprint(spark.createDataFrame([("One two three.",), ("Four five.",), ("one two three. ",)], "text string"))
    names = FEATURE_NAMES[:7]
    first = sinks.cached_features(d, str(tmp_path), names)
    assert first.count() == 2
    sinks.cached_features(d, str(tmp_path), names)
    stored = spark.read.parquet(f"{tmp_path}/features-{sinks.feature_set_id(names)}")
    assert stored.count() == 2
    assert sinks.feature_set_id(names) != sinks.feature_set_id(FEATURE_NAMES)


def test_read_split_prunes_partitions(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\nb", "train"), (2, 'c "q", d', "val")], "doc_id long, text string, split string")
    sinks.write_splits(d, str(tmp_path / "p"))
    val = readers.read_split(spark, str(tmp_path / "p"), "val")
    assert [r["doc_id"] for r in val.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_signal_cache_has_a_row_per_text(spark, tmp_path):
    """Repeated texts are computed once and never multiply rows."""
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "fp string, v double")
    compute = lambda x: x.withColumn("semantic", F.col("v") / 4)
    stored = sinks.cached_signal(d.where("fp = 'a'"), str(tmp_path), "semantic", compute)
    assert [tuple(r) for r in stored.collect()] == [("a", 0.25)]
    stored = sinks.cached_signal(d, str(tmp_path), "semantic", compute)
    assert sorted(tuple(r) for r in stored.collect()) == [("a", 0.25), ("b", 0.5)]
    assert sorted(r["semantic"] for r in sinks.with_signal(d, stored, "semantic", 0.5).collect()) == [0.25, 0.25, 0.5]


def test_first_rows_of_each_file(spark, tmp_path, monkeypatch):
    """The cut falls inside a run, at its end, and past the file's end."""
    monkeypatch.setattr(readers, "RUN_ROWS", 8)
    for n, size in enumerate((100, 20, 5)):
        spark.range(size).select("id", F.lit(n).alias("file")).coalesce(1).write.parquet(str(tmp_path / f"f{n}"))
    for limit in (1, 10, 16):
        rows = readers.first_rows_per_file(spark, str(tmp_path / "*"), F.col("id") % 2 == 0, limit)
        got = {f: sorted(r["id"] for r in rows.where(F.col("file") == f).collect()) for f in range(3)}
        assert got == {f: list(range(0, size, 2))[:limit] for f, size in enumerate((100, 20, 5))}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan


class _Visible(HTMLParser):
    """What Python's parser calls data outside skipped elements."""

    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], False

    def handle_starttag(self, tag, attrs):
        self.skip = self.skip or tag in readers.SKIPPED_TAGS.split("|")

    def handle_endtag(self, tag):
        self.skip = self.skip and tag not in readers.SKIPPED_TAGS.split("|")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_pages_equal_the_parser(spark):
    """1,000 pages of tags with quoted ``>``, comments, raw text, nested and unclosed elements, entities, stray signs."""
    rng = random.Random(12)
    bits = ["word", " two words ", "\n", "1 < 2", "a > b", "&lt;x&gt;", "&amp;", "&eacute;", '<p title="1 > 0">', "</p>", "<a href='x>y' b>", "</a>",
            "<b>", "</b>", "<br/>", "<!-- c > <nav> -->", "<script>if (a < b) { '</nav>' }</script>", '<style type="a>b">p > q {}</style>', "<nav>",
            "</nav>", "<NAV class=\"m>n\">", "</Nav >", "<footer>", "</footer>", "<header id=h>", "</header>", "<nav-bar>", "</nav-bar>",
            "<!DOCTYPE html>", "<p don't>", "<i a = \"x > y\" b=c>", "é日本", "<td colspan=2>", "< notag", "'quoted \"text\"'"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1_000)]
    d = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r["i"]: r["t"] for r in d.select("i", readers.page_text(F.col("html")).alias("t")).collect()}
    for i, page in enumerate(pages):
        parser = _Visible()
        parser.feed(page)
        parser.close()
        want = " ".join(" ".join(parser.parts).split())
        assert got[i].replace(" ", "") == want.replace(" ", ""), page
    odd = ['<p title="1 > 0">x</p>', "<script>no end <b>x", "plain", "", "\x01x\x02", "<nav>gone</footer>kept", "a<b", "x" * 50_000 + "<i a=" + "y" * 50_000 + ">"]
    d = spark.createDataFrame(list(enumerate(odd)), "i int, html string")
    got = [r["t"] for r in d.orderBy("i").select(readers.page_text(F.col("html")).alias("t")).collect()]
    assert got == ["x", "", "plain", "", "x", "kept", "a", "x" * 50_000]


def test_broken_files_cost_themselves_only(spark, tmp_path, caplog):
    """A truncated Parquet file and a truncated gzip stream beside sound ones."""
    home = tmp_path / "mixed"
    for i in range(3):
        spark.createDataFrame([(f"text {i}", "gpt4")], "text string, model string").coalesce(1).write.parquet(str(home / f"p{i}"))
    part = next((home / "p1").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-20])
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(3):
        lines = "\n".join(json.dumps({"chosen": f"Human: q Assistant: reply {i} {j} " + "x" * 500}) for j in range(200))
        data = gzip.compress(lines.encode())
        (logs / f"{i}.jsonl.gz").write_bytes(data[:len(data) // 2] if i == 1 else data)
    (logs / "two.jsonl.gz").write_bytes(gzip.compress(b'{"chosen": "Assistant: a"}\n') + gzip.compress(b'{"chosen": "Assistant: b"}\n'))
    got = readers.multi_generator(spark, [str(home)])
    assert sorted(r["text"] for r in got.collect()) == ["text 0", "text 2"]
    said = readers.transcripts(spark, str(logs))
    assert said.count() == 402 and said.where("text LIKE 'reply 1 %'").isEmpty()
    files = probe.probe(spark, [str(home), str(logs), str(tmp_path / "none")])
    broken = [(r["path"][-8:], r["kind"]) for r in files.where("status = 'broken'").collect()]
    assert sorted(k for _, k in broken) == ["gz", "parquet"] and files.where("status = 'ok' AND kind = 'gz'").count() == 3
    assert {r["path"].rpartition("/")[2] for r in files.where("status = 'broken' AND kind = 'gz'").collect()} == {"1.jsonl.gz"}


def test_a_thousand_files_of_three_schemas(spark, tmp_path, monkeypatch):
    """One scan for each set of columns that matters, and no two rows with one id."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(1_000):
        columns = [{"generation": [f"g{i}"], "model": ["human"]}, {"id": [i], "text": [f"t{i}"]}, {"Content": [f"c{i}"], "MODEL": ["gpt4"], "n": [1.5]}][i % 3]
        pq.write_table(pa.table(columns), tmp_path / f"{i:04d}.parquet")
    got = readers.multi_generator(spark, [str(tmp_path)])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 3
    rows = got.collect()
    assert sorted(r["text"] for r in rows) == sorted(f"{'gtc'[i % 3]}{i}" for i in range(1_000))
    assert len({r["doc_id"] for r in rows}) == 1_000
    assert {(r["text"][0], r["label"], r["model"]) for r in rows} == {("g", 0, "human"), ("t", 1, "unknown"), ("c", 1, "gpt4")}
