"""The pipeline's stages on the driver's tables: nothing clean goes, nothing dirty stays."""

import random
import re
import zlib

import corpus_pipeline
import public_tokenizers
import sentencepiece
from sparkmend.llm import decontam, langid, line_dedup, simhash
from test_llm import brute_language, brute_lines, brute_near


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    frames = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        frames.append(docs)
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts == sorted(counts, reverse=True)
    model = langid.fit(frames[0])
    assert langid.language_id(frames[0], model).where("lang_pred = 'und'").count() == 0
    assert line_dedup.line_classes(frames[1]).where("not kept").count() == 0
    parts = simhash.simhash_components(frames[2])
    assert parts.select("component_id").distinct().count() == parts.count()
    assert decontam.decontamination(frames[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    assert frames[4].where("size(piece_ids) = 0 and length(text) > 0").count() == 0


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_what_plain_python_gives(spark, tmp_path):
    """Every stage once more, on lists: languages by counts, lines and near copies by all pairs, passages by search."""
    r = random.Random(21)
    words = {"de": ["haus", "über", "katze", "und", "nicht", "straße", "ging", "wald"], "en": ["house", "over", "cat", "and", "not", "street", "went", "forest"]}
    line = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "", "s", "er"]) for _ in range(n))
    items = [(1, line("en", 14)), (2, line("de", 11)), (None, line("en", 12))]
    shared = [line("en", 25), line("de", 8)]
    rows = []
    for k in range(40):
        lang = r.choice(["de", "en"])
        lines = [line(lang, r.randrange(3, 60)) for _ in range(r.randrange(1, 6))]
        if k % 7 == 0:
            lines.insert(0, shared[k % 2])
        if k % 9 == 0:
            lines.append("so " + r.choice(items)[1] + " end")
        rows.append((k, "\n".join(lines), lang))
    for k in (3, 8, 11):
        rows.append((100 + k, rows[k][1], rows[k][2]))  # copies
        changed = rows[k][1].split(" ")
        changed[len(changed) // 2] = "changed"
        rows.append((200 + k, " ".join(changed), rows[k][2]))
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 !!", "de"), (303, "日本語", None), (None, line("en", 30), None)]
    docs = spark.createDataFrame([(i, t, lang, "x", len(t or ""), "y") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars int, __row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    train = [(t, lang) for i, t, lang in rows if t and lang and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    known = {c for t, _ in train for c in t.lower() if c.isalpha()}
    stay = [(i, t) for i, t, _ in rows if any(c in known for c in (t or "").lower()) and brute_language(train, [t])[0][0] != "und"]
    order = sorted(stay, key=lambda x: (x[0] is not None, x[0] or 0))
    kept_lines: dict = {}
    for (i, k, first, first_k), t in zip(brute_lines(order), [x for _, t in order for x in t.split("\n") if x.strip()]):
        if (i, k) == (first, first_k):
            kept_lines.setdefault(i, []).append((k, t))
    lined = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (k, x) in kept_lines.get(i, []))) for i, t in order]
    by_id = sorted(lined, key=lambda x: (x[0] is None, x[0] or 0))
    label = brute_near([t for _, t in by_id])
    single = [by_id[k] for k in sorted(set(label))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[a : a + 10]) for _, t in items if (w := word.findall(t.lower())) for a in range(max(1, len(w) - 9))}

    def cleaned(text):
        while True:
            found = list(word.finditer(text.lower()))
            hit = sorted({p for a in range(len(found)) for n in {len(w) for w in windows} if tuple(m[0] for m in found[a : a + n]) in windows for p in range(a, a + n)})
            if not hit:
                return text
            out, at, k = [], 0, 0
            while k < len(hit):
                first = hit[k]
                while k + 1 < len(hit) and hit[k + 1] == hit[k] + 1:
                    k += 1
                out.append(text[at : found[first].start()])
                at, k = found[hit[k]].end(), k + 1
            text = "".join(out) + text[at:]

    want = [(i, cleaned(t)) for i, t in single]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert len(want) < len(rows) - 5 and any(t != dict(by_id)[i] for i, t in want)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(model.decode(list(x.piece_ids)) == x.text and x.n_chars == len(x.text) and x["__row"] == "y" for x in got)
