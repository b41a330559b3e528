"""Readers, stores and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmend.functions import code
from sparkmend.operators import governance, linkage, ranking
from sparkmend.plans import kb
from sparkmend.sources import store, tables
from sparkmend.streaming import claims


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,name,year\n1,"Smith, Bob",\n2,,1990\n')
    rows = [tuple(r) for r in tables.read_csv(spark, str(p), required=["id", "name"]).collect()]
    assert rows == [("1", "Smith, Bob", None), ("2", None, "1990")]
    kept = [tuple(r) for r in tables.read_csv(spark, str(p), empty_is_null=False).collect()]
    assert kept == [("1", "Smith, Bob", ""), ("2", "", "1990")]
    with pytest.raises(ValueError, match="lacks city, zip"):
        tables.read_csv(spark, str(p), required=["city", "id", "zip"])
    text = tables.read_document(spark, str(p)).orderBy("text").collect()
    assert [r.text for r in text] == ["id: 1 | name: Smith, Bob", "id: 2 | year: 1990"]
    with pytest.raises(ValueError, match="no reader"):
        tables.read_document(spark, "a.xyz")


def test_mail_tree_and_pages(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"From: a@x.org\nTo: b@x.org\nSubject: Hi\n\nHello there\n")
    assert tables.read_mail(spark, str(tmp_path / "m.eml")).first().text == "From: a@x.org\nTo: b@x.org\nSubject: Hi\n\nHello there"
    (tmp_path / "src/.git").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/.git/b.py").write_text("y = 2")
    (tmp_path / "src/c.txt").write_text("z")
    assert [r.text for r in tables.read_tree(spark, str(tmp_path / "src"), [".py"]).collect()] == ["x = 1"]
    html = "<html><title>T &amp; U</title><script>no()</script><body><nav>menu</nav><p>" + "word " * 30 + "</p></body></html>"
    pages = spark.createDataFrame([("u", html), ("v", "<p>short</p>")], "url string, html string")
    assert [(r.url, r.text.split("\n")[:2]) for r in tables.read_pages(pages).collect()] == [("u", ["# T &amp; U", "Source: u"])]


def test_transcript(spark):
    lines = ["intro", "User: hello", "more", "AI: hi", "", "user: bye"]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(lines)], "k string, n int, t string")
    got = [tuple(r) for r in tables.transcript(df, "k", "n", "t").orderBy("message").collect()]
    assert got == [("k", 1, "user", "hello\nmore"), ("k", 2, "assistant", "hi"), ("k", 3, "user", "bye")]


def test_upsert_and_export(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "id long, v string")
    assert {tuple(r) for r in store.changed_rows(new, old, ["id"]).collect()} == {(3, "c"), (4, "d")}
    assert {tuple(r) for r in store.upsert(new, old, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    store.export({"t": new.withColumn("w", F.array(F.lit("x"), F.lit("y")))}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/t")).where("w = 'x,y'").count() == 3


def test_code_symbols():
    py = "class A:\n    def f(self):\n        # WHY: it is slow otherwise\n        return 1\n"
    assert [(s[1], s[2], s[3]) for s in code.file_symbols("a.py", py)] == [("A", "class", 1), ("f", "function", 2), ("WHY", "reason", 3)]
    assert [s[1] for s in code.file_symbols("a.js", "export const go = (x) => {\n}\nfunction stop() {}\n")] == ["go", "stop"]
    assert code.file_symbols("b.py", "def broken(:\n")[0][1] == "broken"


def test_leaders_and_copies(spark):
    items = spark.createDataFrame([(1, "one", 0.9, "2"), (2, "i", 0.5, "1"), (3, "three", 0.5, "3"), (4, "four", 0.1, "4")], "id long, name string, c double, t string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r.item: (r.leader, r.canonical) for r in ranking.leader_clusters(items, pairs, "id", "name").collect()}
    assert got == {1: (1, "i"), 2: (1, "i"), 3: (3, "three"), 4: (4, "four")}
    assert {tuple(r) for r in ranking.supersede_copies(items, pairs, "id", "c", "t").collect()} == {(2, 1)}


def test_injected_errors_are_repeatable(spark):
    df = spark.createDataFrame([(i, f"value number {i}") for i in range(400)], "id long, v string")
    (a, log), (b, _) = (linkage.injected(df, "id", "v", share=0.2) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and 40 < log.count() < 120
    assert a.join(df.withColumnRenamed("v", "w"), "id").where("v <> w").count() <= log.count()


def test_retention(spark):
    calls = spark.sql("select 1 as episode_id, timestamp'2024-01-01' as ts union all select 2, timestamp'2024-01-01' union all select 3, timestamp'2024-03-01'")
    eps = spark.createDataFrame([(1, "FAILURE"), (2, "SUCCESS")], "episode_id int, outcome string")
    assert {r.episode_id for r in governance.retained(calls, eps, F.lit("2024-03-02").cast("timestamp")).collect()} == {1, 3}


def test_streamed_gate_is_the_batch_gate(spark, tmp_path):
    rows = [(i, "n", f"s{i % 5}", "r", str(i % 3), f"a{i % 2}", None, None, (i % 10) / 10, i) for i in range(60)]
    schema = "claim_id long, namespace string, subject string, relation string, canonical string, claimant string, valid_from int, valid_until int, confidence double, asserted_at long"
    df = spark.createDataFrame(rows, schema)
    src = str(tmp_path / "in")
    for k in range(3):
        df.where(F.col("claim_id").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = claims.gated(stream).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("verdicts").collect()}
    assert got == {tuple(r) for r in governance.admit(df).collect()}


def test_streamed_hours(spark, tmp_path):
    ev = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 05:00", "2024-01-01 09:00"]), "user_id": [1, 1, 1, 1], "event_type": ["a"] * 4})
    src = str(tmp_path / "in")
    df = spark.createDataFrame(ev)
    df.coalesce(1).write.parquet(src)
    q = claims.hourly_usage(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.calls for r in spark.table("hours").collect()) == [1, 2]


def test_knowledge_base(spark, sf_dir):
    given = kb.from_tables(spark, sf_dir)
    done = kb.repair(**given)
    people, links = done.people, done.relationships
    assert given["people"].count() - people.count() == people.where("source_records like '%,%'").count() > 0
    assert people.where("birth_date = 'N/A'").count() == 0
    ids = people.select(F.col("person_id").alias("k")).union(done.events.select("event_id"))
    assert links.join(ids, F.col("dst") == F.col("k"), "left_anti").count() == 0
    assert links.groupBy("src", "rel", "dst").count().where("count > 1").count() == 0
    held = links.where("rel = 'received'").join(done.events.select(F.col("event_id").alias("dst"), F.col("year").alias("y")), "dst")
    assert held.where("not year <=> y").count() == 0
    assert done.actions.where("confidence < 0 or confidence > 1").count() == 0
    assert {r.kind for r in done.actions.select("kind").distinct().collect()} >= {"NORMALIZE", "MERGE", "CORRECT", "FLAG"}
    with pytest.raises(ValueError, match="people lacks"):
        kb.repair(given["people"].drop("gender"), given["places"], given["events"], given["relationships"])
