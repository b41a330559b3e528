"""Views and readers that SQL does not cover, against plain Python."""

import json
import zipfile

from pyspark.sql import functions as F

from sparkmend.functions.similarity import ratio
from sparkmend.operators import blocking, retrieval, views
from sparkmend.sources import office, tables


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path):
    p = lambda *texts: "".join(f"<w:p><w:r><w:t>{t}</w:t><w:tab/></w:r><w:r><w:t>end</w:t></w:r></w:p>" for t in texts)
    packed(tmp_path / "a.docx", {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p("One", "Two")}<w:p/></w:body></w:document>'})
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    packed(tmp_path / "b.pptx", {f"ppt/slides/slide{k}.xml": slide(f"slide text {k}") for k in (10, 2, 1)})
    cell = lambda r, v, t="": f'<c r="{r}"{t}><v>{v}</v></c>'
    s = ' t="s"'
    packed(tmp_path / "c.xlsx", {
        "xl/workbook.xml": '<workbook><sheets><sheet name="Stock"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>ap</t></r><r><t>ple</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cell('A1', 0, s)}</row><row>{cell('A2', 1, s)}{cell('C2', 7)}</row><row/></sheetData></worksheet>",
    })
    packed(tmp_path / "d.odt", {"content.xml": '<o:c xmlns:o="o" xmlns:t="t"><t:h>Head</t:h><t:p>a <t:span>b</t:span></t:p></o:c>'})
    packed(tmp_path / "e.epub", {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="in/book.opf"/></rootfiles></container>', "in/book.opf": '<package><manifest><item id="x" href="t/x.html"/><item id="y" href="y.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>', "in/t/x.html": "<html><head><title>no</title></head><body><p>last</p></body></html>", "in/y.html": "<p>first</p>"})
    (tmp_path / "broken.docx").write_bytes(b"PK no")
    got = {}
    for r in office.read_office(spark, str(tmp_path)).orderBy("path", "seq").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.part, r.text))
    assert got == {
        "a.docx": [("", "One end\nTwo end")], "b.pptx": [("slide 1", "slide text 1"), ("slide 2", "slide text 2"), ("slide 3", "slide text 10")], "c.xlsx": [("Stock", "name: apple, col2: 7")],
        "d.odt": [("", "Head\na b")], "e.epub": [("chapter 1", "first"), ("chapter 2", "last")],
    }
    assert tables.read_document(spark, str(tmp_path / "b.pptx")).first().text == "slide text 1\nslide text 2\nslide text 10"


def test_scratchpads_and_graphs(spark, tmp_path):
    for name, data in (("a", {"session": "s1", "started": "1", "ended": "2", "notes": ["x"]}), ("b", {"session": "s2", "started": "1"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "c.json").write_text("{not json")
    assert [r.session for r in office.read_scratchpads(spark, str(tmp_path)).collect()] == ["s1"]
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.parquet(f"{tmp_path}/g/nodes")
    spark.createDataFrame([(1, 2, "r"), (1, 3, "r"), (4, 2, "r")], "src long, dst long, relation string").write.parquet(f"{tmp_path}/g/edges")
    assert [tuple(r) for r in office.read_graph(spark, f"{tmp_path}/g")[1].collect()] == [(1, 2, "r")]


def test_name_grounded(spark):
    q = spark.createDataFrame([(1, "When was Marie Curi born?", 0), (2, "Who is Bohr", 0)], "qid long, question string, block int")
    r = spark.createDataFrame([(1, "Marie Curie", 0), (2, "Niels Bohr", 0), (3, None, 0)], "rid long, name string, block int")
    got = {(x.qid, x.rid): (x.share, x.found) for x in views.name_grounded(q, r, "question", "name").collect()}
    for (i, asked) in ((1, "when was marie curi born"), (2, "who is bohr")):
        for (j, name) in ((1, "marie curie"), (2, "niels bohr"), (3, "")):
            words = name.split()
            share = sum(any(ratio(w, a) >= 85 for a in asked.split()) for w in words) / len(words) if words else 0.0
            assert got[i, j] == (share, share >= 0.5)


def test_near_values_lose_nothing(spark):
    import random

    from sparkmend.functions.similarity import osa_similarity

    r = random.Random(4)
    base = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(60)]

    def damaged(t):
        for _ in range(r.randrange(4)):
            k = r.randrange(len(t)) if t else 0
            t = r.choice([t[:k] + t[k + 1 :], t[:k] + r.choice("abcd") + t[k:], t[:k] + t[k + 1 : k + 2] + t[k : k + 1] + t[k + 2 :]])
        return t

    left = sorted({damaged(b) for b in base for _ in range(3)} - {""})
    pairs = blocking.near_values(spark.createDataFrame([(x,) for x in left], "v string"), spark.createDataFrame([(x,) for x in sorted(set(base))], "w string"))
    got = {tuple(x) for x in pairs.collect()}
    assert {(a, b) for a in left for b in set(base) if osa_similarity(a, b) >= 0.8} <= got


def test_batches_rank_as_tables_do(spark, sf_dir):
    d, q = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    args = (d, q, "doc_id", "text", "item_id", "text")
    for whole, best in ((retrieval.bm25, retrieval.bm25_top_k), (retrieval.overlap_score, retrieval.overlap_top_k)):
        want = retrieval.top_k(whole(*args), ["query_id"], "score", "doc_id", 10).select("query_id", "rank", F.round("score", 4).alias("s"))
        got = best(*args, 10).select("query_id", "rank", F.round("score", 4).alias("s"))
        assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
