"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmend.llm import decontam, langid, licences, line_dedup, lm_scoring, matroska, piece_sampling, simhash, token_counts, token_output

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n\n a", "a", "it's 'll  's", "aaaaaaaa aaa", "x<|endoftext|> y<|endoftext|>", "é ß 日本語 😀", "▁ under ▁▁bars", "tab\tand  \n blanks   ", "\x1c odd \x85 　 blanks\xa0",
    "word " * 5000, "z" * 30000, "\x00 nul", "12,345.67 %%%!!", "the same text", "the same text", "foo  \nbar a \n b",
]
SCHEMA = "doc_id long, text string, lang string, fp string, line string, chunk string, n_tokens string"


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "w") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "id again"), (3, "id again")]
    return frame(spark, rows), rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(rows):
    return sorted(rows, key=repr)


# 1


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    df, rows = odd
    got = [tuple(r) for r in token_counts.token_counts(df, BPE, 5).collect()]
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in rows]
    assert key(got) == key(want)
    assert token_counts.token_counts(df.limit(0), BPE).count() == 0


def test_merging_is_the_library(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    r = random.Random(2)
    pieces = ["".join(r.choice(["a", "aa", "the", "in", "!", "é", " "]) for _ in range(r.randrange(1, 9))).strip() or "q" for _ in range(500)]
    pieces = [p for p in pieces if re.fullmatch("[a-z]+", p)]
    counts = token_counts.MergeTable(BPE).surviving([p.encode() for p in pieces])
    assert counts.tolist() == [len(e.ids) for e in tok.encode_batch(pieces, add_special_tokens=False)]


# 2


def brute_losses(rows, good, prior):
    words = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    counts = Counter(w for ws in words for w in ws)
    whole = sum(counts.values()) + len(counts) + 1
    pairs, firsts = [Counter(), Counter()], [Counter(), Counter()]
    for (i, _), ws in zip(rows, words):
        for a, b in zip([None, *ws], ws):
            for m in (0, 1) if i in good else (0,):
                pairs[m][a, b] += 1
                firsts[m][a] += 1
    out = []
    for (i, _), ws in zip(rows, words):
        loss = [-sum(math.log((pairs[m][a, b] + prior * (counts[b] + 1) / whole) / (firsts[m][a] + prior)) for a, b in zip([None, *ws], ws)) / max(1, len(ws)) for m in (1, 0)]
        out.append((i, len(ws), *loss))
    return out


@pytest.mark.parametrize("chunk", [6 << 20, 1])
def test_lm_scoring(spark, odd, docs, monkeypatch, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    rows = odd[1] + [(100 + r.doc_id, r.text) for r in docs.limit(40).collect()]
    df = clashing(spark, rows)
    good = spark.createDataFrame([(4,), (6,), (6,), (None,), (999,), *((100 + k,) for k in range(0, 40, 3))], "doc_id long")
    got = key(tuple(r) for r in lm_scoring.cross_entropy_difference(df, good, prior=8.0).collect())
    want = key(brute_losses(rows, {4, 6, *range(100, 140, 3)}, 8.0))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:4] for g in got], [w[2:4] for w in want], atol=2e-6)
    assert all(abs(g[4] - (g[2] - g[3])) < 1e-5 for g in got)
    assert lm_scoring.cross_entropy_difference(df.limit(0), good).count() == 0


# 3


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(rows, fps):
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[r] for r in root]


def test_simhash(spark, odd):
    df, rows = odd
    r = random.Random(1)
    base = [r.choice("abcdefgh") * 3 for _ in range(400)]
    near = []
    for k in range(40):
        words = base[:]
        words[r.randrange(400)] = f"new{k}"
        near.append((100 + k, " ".join(words)))
    rows = rows + near
    fps = [brute_fingerprint(t) for _, t in rows]
    got = [tuple(x) for x in simhash.simhash_components(frame(spark, rows)).collect()]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(rows, fps))]
    assert key(got) == key(want)
    assert simhash.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("gathered", [2048, 4])
def test_crowded_keys_lose_no_link(spark, monkeypatch, gathered):
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centres for _ in range(120)})
    monkeypatch.setattr(simhash, "CROWDED", 2)
    monkeypatch.setattr(simhash, "GATHERED", gathered)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").select("fp", F.lit(0).cast("long").alias("own"), F.col("fp").alias("node"))
    got = {x.node: x.component for x in simhash.near_classes(df, ["fp"]).collect()}
    rows = [(f - (1 << 64) if f >> 63 else f, "") for f in fps]
    want = dict(zip([i for i, _ in rows], brute_components(rows, fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_classes_of_large_groups_are_those_of_small_ones():
    r = random.Random(4)
    open_ = list(range(3, 21))
    fps = np.array(sorted({sum(1 << b for b in r.sample(open_, r.randrange(8))) for _ in range(600)}), np.int64)
    large = simhash.classes(fps, open_)
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert large.tolist() == [int(fps[x]) for x in label]


def members_of_few_fingerprints():
    """fps, own, nodes: 900 members of some 30 fingerprints, whose second fingerprints make chains."""
    r = random.Random(11)
    centre, fps, own = r.getrandbits(63), [], []
    near = [centre] + [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))) for _ in range(30)]
    while len(fps) < 900:
        second = r.getrandbits(64)
        for _ in range(r.randrange(1, 7)):
            fps.append(r.choice(near))
            own.append(second)
            second ^= sum(1 << b for b in r.sample(range(64), r.randrange(12, 18)))
    nodes = r.sample(range(10_000), len(fps))
    return np.array(fps, np.uint64).view(np.int64), np.array(own, np.uint64).view(np.int64), np.array(nodes, np.int64)


def test_members_of_one_fingerprint_keep_their_own_links(spark, monkeypatch):
    fps, own, nodes = members_of_few_fingerprints()
    want = dict(zip(nodes.tolist(), simhash.nearest_roots(fps.view(np.uint64), own.view(np.uint64), nodes, 16).tolist()))
    assert 300 < len(set(want.values())) < 800
    open_ = list(range(3, 21))
    inside = np.int64(sum(1 << b for b in open_))
    for tile in (1 << 18, 8):  # many blocks at once, and each in tiles
        monkeypatch.setattr(simhash, "TILE", tile, raising=False)
        got = simhash.classes(fps & inside, open_, own, nodes, 16)
        assert got.tolist() == simhash.nearest_roots((fps & inside).view(np.uint64), own.view(np.uint64), nodes, 16).tolist()
    monkeypatch.undo()
    monkeypatch.setattr(simhash, "CROWDED", 2)
    monkeypatch.setattr(simhash, "GATHERED", 4)
    df = spark.createDataFrame([*zip(fps.tolist(), own.tolist(), nodes.tolist())], "fp long, own long, node long")
    got = {x.node: x.component for x in simhash.near_classes(df, ["fp"], 16).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_each_difference_has_one_group_of_its_own():
    r = random.Random(12)
    for n in [0, *(1 + k % 3 for k in range(300))]:
        step = sum(1 << b for b in r.sample(range(64), n))
        own = 0
        for table in range(16):
            for three in range(20):
                places = simhash.open_bits(table, three)
                if all(b in places for b in range(64) if step >> b & 1):
                    own += sum(1 << k for k, b in enumerate(places) if step >> b & 1) in simhash.own_steps(table, three)
        assert own == 1


def brute_near(texts):
    """The component of each text, all pairs of fingerprints compared."""
    *tables, own = (x.view(np.uint64) for x in simhash.near_fingerprints(texts, simhash.TABLES, simhash.SHINGLE))
    near = np.zeros((len(texts), len(texts)), bool)
    for fp in tables:
        near |= np.bitwise_count(fp[:, None] ^ fp) <= simhash.BUDGET
    near &= np.bitwise_count(own[:, None] ^ own) <= simhash.NEAR_BITS
    label = np.arange(len(texts))
    while True:
        new = np.where(near, label, len(texts)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("crowded", [32, 2])
def test_one_document_of_each_stays(spark, odd, docs, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(3)
    base = [r.choice(["ab", "cd", "efg", "hi", "jkl", "m"]) + str(r.randrange(60)) for _ in range(120)]
    near = []
    for k in range(60):
        words = base[:]
        for at in r.sample(range(120), 1 + k % 3):
            words[at] = f"new{k}"
        near.append((1000 + k, " ".join(words)))
    rows = sorted(odd[1] + near, key=lambda x: (x[0] is None, x[0] or 0))
    df = clashing(spark, rows)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    label = brute_near([t for _, t in rows])
    assert key(x.doc_id for x in kept.collect()) == key(rows[k][0] for k in sorted(set(label)))
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_near_copies_and_others(spark):
    """Copies whose five-word shingles are 0.8 alike go, texts of the same vocabulary stay."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 3) for k in range(400)]
    rows = [(i, r.choices(vocabulary, weights, k=r.randrange(60, 300))) for i in range(300)]
    copies = []
    for i, words in rows[:150]:
        words, n = words[:], len(words)
        for at in r.sample(range(n), max(1, n // 50)):
            words[at] = "changed"
        copies.append((1000 + i, words))
    alike = lambda a, b: len(x & y) / len(x | y) if (x := {*zip(*(a[k:] for k in range(5)))}) and (y := {*zip(*(b[k:] for k in range(5)))}) else 0
    near = {1000 + i for (i, a), (_, b) in zip(rows, copies) if alike(a, b) >= 0.8}
    kept = {x.doc_id for x in simhash.keep_one_of_each(frame(spark, [(i, " ".join(w)) for i, w in rows + copies])).collect()}
    assert {i for i, _ in rows} <= kept
    assert len(near) > 100 and len(near - kept) >= 0.9 * len(near)


# 4


def test_pieces(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df, rows = odd
    got = piece_sampling.sampled_digests(df, PIECES).collect()
    assert all(r.lossless for r in got) and len(got) == len(rows)
    assert key((r.doc_id, r.decoded_sha256) for r in got) == key((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    ids = piece_sampling.with_pieces(df, PIECES)
    assert ids.columns == [*df.columns, "piece_ids"]
    for r in ids.collect():
        if r.text and "▁" not in r.text and "\x00" not in r.text:
            assert model.decode(r.piece_ids) == r.text
    assert piece_sampling.with_pieces(clashing(spark, rows[:3]), PIECES).columns[-1] == "__piece_ids"
    back = piece_sampling.decoded_texts(ids.select("doc_id", "piece_ids"), PIECES)
    assert key(tuple(r) for r in back.collect()) == key((i, t or "") for i, t in rows)
    again = piece_sampling.sampled_digests(df.repartition(7), PIECES).collect()
    assert key(map(tuple, got)) == key(map(tuple, again))
    assert piece_sampling.sampled_digests(df.limit(0), PIECES).count() == 0


def test_draws_follow_the_lattice():
    s = piece_sampling.PieceSampler(PIECES, theta=0.3)
    n = 6000
    ids, counts = s.encode(["there"] * n, list(range(n)))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - c : e].tolist()) for c, e in zip(counts, ends))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text, weight = "▁there", {}
    for mask in range(1 << 5):
        cuts = [0, *(i + 1 for i in range(5) if mask >> i & 1), 6]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        numbers = tuple(model.piece_to_id(p) for p in parts)
        if all(model.id_to_piece(k) == p for k, p in zip(numbers, parts)):
            weight[numbers] = math.exp(sum(-0.3 * math.log(10 - model.get_score(k)) for k in numbers))
    whole = sum(weight.values())
    assert set(seen) <= set(weight)
    for numbers, w in weight.items():
        assert abs(seen[numbers] / n - w / whole) < 0.03


# 5


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 40, 1 << 63])
def test_simple8b(top):
    r = np.random.default_rng(7)
    for n in (0, 1, 59, 240, 4096, 4097, 20000):
        ids = r.integers(0, top, n, dtype=np.uint64)
        ids[: n // 3] %= np.uint64(2)
        words, offsets = token_output.pack_blocks(ids)
        assert len(offsets) == -(-n // token_output.BLOCK)
        assert (token_output.unpack_blocks(words, offsets, n) == ids).all()


def test_token_output(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    df, rows = odd
    got = {}
    for r in token_output.token_output(df, BPE).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    at, order = 0, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    i = 0
    while i < len(order):
        same = [x for x in order if x[0] == order[i][0]]
        coded = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t in same]
        mine = sorted(got[order[i][0]])
        assert sorted(n for _, n, _ in mine) == sorted(map(len, coded))
        assert sorted(c for _, _, c in mine) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in coded)
        for start, n, _ in mine:
            assert start == at
            at += n
        i += len(same)
    assert token_output.token_output(df.limit(0), BPE).count() == 0


# 6


def linked(a, b):
    """Whether lines are near, as the operator's docstring says it."""
    words = a.split(), b.split()
    longer = max(map(len, words))
    if distance(*words) <= min(4, longer // 10):
        return True
    return longer < 20 and distance(a, b) <= min(2, max(len(a), len(b)) // 10)


def brute_lines(rows):
    lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for *_, x in lines})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and find(a) != find(b) and linked(a, b):
                root[find(a)] = find(b)
    first = {}
    for i, k, x in lines:
        place = (i is not None, i or 0, k)
        first[find(x)] = min(first.get(find(x), place), place)
    places = [first[find(x)] for *_, x in lines]
    return [(i, k, p[1] if p[0] else None, p[2]) for (i, k, _), p in zip(lines, places)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, times):
    out = list(text)
    for _ in range(times):
        k, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out.insert(k, r.choice("abé"))
        elif kind == 1:
            del out[k]
        else:
            out[k] = r.choice("abé")
    return "".join(out)


@pytest.mark.parametrize("crowded", [256, 3, 1])
def test_line_classes(spark, monkeypatch, crowded):
    r = random.Random(6)
    bases = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(3, 40))) for _ in range(8)]
    worded = [[r.choice(["ab", "cd", "ef", "gh", "é", "xyz"]) for _ in range(n)] for n in (9, 10, 19, 20, 25, 40, 45)]
    rows = [(None, "no id\n" + bases[0]), (1, None), (2, ""), (3, "  \n\t\n"), (4, "\n".join(bases)), (4, "\n".join(bases))]
    rows += [(10 + i, "\n".join(edited(r, x, r.randrange(4)) if len(x := r.choice(bases)) > 4 else x for _ in range(4))) for i in range(25)]
    for i in range(25):
        lines = []
        for _ in range(3):
            words = r.choice(worded)[:]
            for _ in range(r.randrange(6)):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = r.choice([[], ["new"], [r.choice(words)]])
            lines.append(" ".join(words))
        rows.append((50 + i, "\n".join(lines)))
    rows += [(80, "short one"), (81, "short onex"), (82, "x" * 9), (83, "x" * 10), (84, "x" * 21), (85, "x" * 19), (86, "word " * 3000), (87, "word " * 2997)]
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(line_dedup, "TILE", 2 if crowded == 1 else 4096)
    got = line_dedup.line_classes(frame(spark, rows)).collect()
    assert key((x.doc_id, x.line_no, x.class_doc_id, x.class_line_no) for x in got) == key(brute_lines(rows))
    assert all(x.kept == ((x.doc_id, x.line_no) == (x.class_doc_id, x.class_line_no)) for x in got)
    assert line_dedup.line_classes(frame(spark, rows).limit(0)).count() == 0


def test_distance():
    r = random.Random(9)
    for _ in range(4000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(30)))
        b = edited(r, a, r.randrange(6)) if len(a) > 6 else "".join(r.choice("ab") for _ in range(r.randrange(8)))
        for most in (0, 1, 2, 3, 4):
            assert line_dedup.within(a, b, most) == (distance(a, b) <= most)
            assert line_dedup.within(list(a), list(b), most) == (distance(a, b) <= most)


def test_rows_of_a_crowd_grow_with_its_lines(spark):
    """Lines that have a third in common, of one parity: each round gives a line a bounded number of rows."""
    counts = {}
    for n in (400, 800):
        r = random.Random(5)
        lines = ["the same beginning " + "".join(r.choices("abcdefgh", k=18) * 2) for _ in range(n)]
        df = spark.createDataFrame([(i, x, hash(x)) for i, x in enumerate(lines)], "doc_id long, text string, line long")
        links = line_dedup.line_classes(df)
        assert links.select("class_doc_id").distinct().count() == len(set(lines))
        texts = df.select(F.col("line"), "text")
        keys = line_dedup.line_keys(lines)
        crowd = spark.createDataFrame([(int(g), df_line) for kind, k, row, *_ in keys for g, df_line in zip(line_dedup.group_of(k, 16).tolist(), (hash(lines[i]) for i in row.tolist()))], "grp long, line long")
        many = crowd.groupBy("grp").count().where("count > 256").select("grp")
        counts[n] = line_dedup.crowds_dealt(crowd.join(many, "grp").distinct(), texts, 16)[0].count()
    assert counts[800] <= 2.5 * counts[400] + 100


CLASHING = {"fp": "row", "line": "drop", "chunk": "__row", "n_tokens": "piece_ids"}


def clashing(spark, rows):
    """Documents whose other columns have the names that stages give their own."""
    df = frame(spark, rows)
    for a, b in CLASHING.items():
        df = df.withColumnRenamed(a, b)
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["fp", "__fp", "__drop", "line", "place", "id", "component", "picked", "_piece_ids", "hits", "n_words", "items", "copy", "o"])))


def test_repeated_lines_go(spark):
    rows = [(1, "a line that is long enough\nshort\n\nshort"), (2, "a line that is long enouhg\nshort\nown"), (3, None), (4, "short")]
    df = clashing(spark, rows)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a line that is long enough\nshort\n", 2: "own", 3: None, 4: ""}


# 7


@pytest.mark.parametrize("lacing", [matroska.NO_LACING, matroska.XIPH, matroska.EBML_LACING])
def test_lacing(lacing):
    frames = [b"a" * 5, b"b" * 700, b"", b"c" * 255, b"x", b"d" * 40000]
    data = matroska.mux(frames, lacing)
    found = matroska.demux(data)
    assert [data[p.offset : p.offset + p.size] for p in found.packets] == frames
    assert found.tracks[1][matroska.BIT_DEPTH] == 8 and found.cues[0][:2] == (0, 1)


def test_unknown_sizes_groups_and_voids():
    m = matroska
    block = m.block([b"one", b"two"], 1, 7, m.FIXED)
    cluster = m.number(m.TIMESTAMP, 100) + m.element(m.VOID, b"12345") + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block))
    unknown = b"\x01" + b"\xff" * 7
    data = m.HEAD + m.SEGMENT.to_bytes(4, "big") + unknown + m.TRACK + m.CLUSTER.to_bytes(4, "big") + unknown + cluster + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 200) + m.element(m.SIMPLE_BLOCK, m.block([b"three"], 1, -5, m.NO_LACING)))
    got = [(p.cluster, p.timestamp, data[p.offset : p.offset + p.size]) for p in m.demux(data).packets]
    ms = 192 * 1000 // 8000  # the track's default duration
    assert got == [(0, 107, b"one"), (0, 107 + ms, b"two"), (1, 195, b"three")]


def test_groups_laces_and_cues():
    m = matroska
    block = lambda *frames: m.element(m.BLOCK, m.block(list(frames), 1, 0, m.FIXED))
    key_group = m.element(m.BLOCK_GROUP, block(b"aa", b"bb", b"cc"))
    other = m.element(m.BLOCK_GROUP, m.element(m.REFERENCE_BLOCK, b"\xff") + block(b"dd", b"ee"))
    bare = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1)))
    lasting = m.element(m.BLOCK_GROUP, block(b"ff", b"gg") + m.number(m.BLOCK_DURATION, 40))
    for track, groups, want in ((m.TRACK, key_group + other, [(0, True), (24, True), (48, True), (0, False), (24, False)]), (bare, lasting, [(0, True), (20, True)])):
        data = m.HEAD + m.element(m.SEGMENT, track + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 0) + groups))
        assert [(p.timestamp, p.keyframe) for p in m.demux(data).packets] == want
    frames = [bytes([k % 251]) * 192 for k in range(1000)]
    found = m.demux(m.mux(frames))
    assert [p.timestamp for p in found.packets] == [24 * k for k in range(1000)]
    per_cluster = m.FRAMES_A_BLOCK * m.BLOCKS_A_CLUSTER
    for k in (0, 1, 255, 256, 700, 999):
        assert found.sought(24 * k, 1) == k // per_cluster * per_cluster
    assert found.sought(-1, 1) == found.sought(5000, 2) == 0


def test_media(spark, odd):
    df, rows = odd
    got = matroska.media_features(df).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert key(tuple(r)[:5] for r in got) == key(want)
    media = spark.createDataFrame([(1, bytearray(matroska.stored(b"q" * 192 * 20))), (2, None), (3, bytearray(b"\x1a\x45junk"))], "doc_id long, media binary")
    packets = matroska.packet_table(media).collect()
    assert {r.doc_id for r in packets} == {1} and len(packets) == 20 and [r.timestamp for r in packets][8] == 192
    assert [tuple(r) for r in matroska.track_table(media).collect()] == [(1, 1, 2, "A_PCM/INT/LIT", 8000.0, 1, 8, 24_000_000)]
    data = matroska.stored(b"q" * 192 * 300)
    cues = matroska.cue_table(media.select(F.col("doc_id"), F.lit(bytearray(data)).alias("media")).limit(1)).collect()
    assert [(r.track, r.timestamp, r.first_packet) for r in cues] == [(1, 0, 0), (1, 256 * 24, 256)]
    assert all(data[r.cluster_offset : r.cluster_offset + 4] == matroska.CLUSTER.to_bytes(4, "big") for r in cues)
    for r, (_, t) in zip(key(matroska.media_features(df).collect()), key(rows)):
        payload = matroska.padded(t)[1]
        media_file = matroska.mux([payload[k : k + 192] for k in range(0, len(payload), 192)])
        n = len(payload) // 192
        assert (r.media_bytes, r.media_sha256) == (len(media_file), hashlib.sha256(media_file).hexdigest())
        rising = sum(payload[k] < payload[k + 1] for k in range(0, len(payload) - 1, 64))
        assert r.feature == f"A_PCM/INT/LIT;rate=8000;bits=8;packets={n};clusters={-(-n // 256)};cues={-(-n // 256)};ms={24 * n};last_ts={24 * (n - 1)};mean={sum(payload) / len(payload):.4f};peak={max(payload)};rising={rising}"
    assert matroska.media_features(df.limit(0)).count() == 0


# 8


def test_language_id(spark, docs, odd):
    df, rows = odd
    model = langid.fit(docs)
    got = langid.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    got = [(r.doc_id, r.lang_pred == "und") for r in langid.language_id(df, model).collect()]
    assert key(got) == key((i, not any(c.isalpha() for c in t or "")) for i, t in rows)
    kept = langid.keep_with_language(df, model)
    assert kept.columns == df.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.language_id(df, empty).collect()} == {"und"}


def brute_language(train, texts):
    """The docstring's rule with plain dictionaries."""
    langs = sorted({lang for _, lang in train})
    counts = {}
    for text, lang in train:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            if plain := "".join(c for c in word if c.isalpha()):
                for item in [(0, plain)] + [(n, f" {plain} "[i : i + n]) for n in range(2, 5) for i in range(len(plain) + 3 - n)] + [(1, c) for c in plain]:
                    counts.setdefault(item, Counter())[lang] += 1
    own = Counter()
    for (n, _), by in counts.items():
        for lang, k in by.items():
            own[n, lang] += k

    def logs(item):
        by, n = counts[item], item[0]
        usual = sum(by[lang] / own[n, lang] for lang in langs if own[n, lang]) / len(langs)
        return [math.log((by[lang] + 1000 * usual) / (own[n, lang] + 1000)) for lang in langs]

    out = []
    for text in texts:
        rows = []
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            if not (plain := "".join(c for c in word if c.isalpha())):
                continue
            found = [(0, plain)] if (0, plain) in counts else []
            for n in range(4, 0, -1):
                if not found:
                    grams = [(n, f" {plain} "[i : i + n]) for i in range(len(plain) + 3 - n)] if n > 1 else [(1, c) for c in plain]
                    found = [g for g in grams if g in counts]
            part = [logs(g) for g in found]
            rows.append([sum(c) / len(part) for c in zip(*part)] if part else [0.0] * len(langs))
        if not rows:
            out.append(("und", 0.0))
            continue
        mean = [sum(c) / len(rows) * min(len(rows), 20) for c in zip(*rows)]
        p = [math.exp(x - max(mean)) for x in mean]
        out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def test_language_scores_by_another_way(spark, docs, odd):
    train = [(r.text, r.lang) for r in docs.select("text", "lang", "doc_id").collect() if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["qzx", "日本語", "Schönes Haus xyzzyq", "été 12 abc"]
    model = langid.fit(docs)
    got = langid.language_id(frame(spark, list(enumerate(texts))), model).collect()
    want = brute_language(train, texts)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert np.allclose([r.score for r in got], [w[1] for w in want], atol=1e-4)
    kept = langid.keep_with_language(clashing(spark, [(1, "ここ"), (2, "the house"), (3, None), (4, "12")]), model)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_a_language_of_few_words_wins_no_other_text(spark):
    r = random.Random(12)
    kinds = {"a": "abcde", "b": "fghij"}
    words = {k: ["".join(r.choice(c) for _ in range(r.randrange(3, 8))) for _ in range(3000)] for k, c in kinds.items()}
    rows = [(i, " ".join(r.choice(words["ab"[i % 2]]) for _ in range(60)), "ab"[i % 2]) for i in range(400)]
    rare = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.createDataFrame([*rows, (rare, "klmno pqrst uvwxy klmno", "rare")], "doc_id long, text string, lang string")
    got = langid.language_id(df, langid.fit(df, train_rows=30)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang_pred == x.lang for x in got) == len(rows) + 1


def test_held_out_rows_and_fields_teach_nothing(spark):
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "zzz qqq", "bad") for i in kept] + [(i, "aaa bbb", "good") for i in range(200) if i not in kept]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["good"]


# 9


@pytest.fixture(scope="module")
def licence_model(docs):
    return licences.fit(docs)


def brute_paragraphs(text):
    """Lines, each joined to the one behind it if it ends no sentence and that one is not blank."""
    lines = (text or "").lower().split("\n")
    out = [lines[0]]
    for line in lines[1:]:
        before = out[-1].rstrip(" \t")
        if before and not before[-1].isspace() and before[-1] not in ".!?:;" and line and not line[0].isspace():
            out[-1] = before + " " + line
        else:
            out.append(line)
    return out


def brute_licences(rows, model, least=0.5):
    out = set()
    for i, t in rows:
        for k, p in enumerate(brute_paragraphs(t)):
            words = [w for w in re.split("[^a-z0-9]+", p) if w]
            pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
            z = [b + sum(model.weights[f][c] for f in {*words} | pairs if f in model.weights) for c, b in enumerate(model.bias)]
            e = [math.exp(x) for x in z]
            best = max(range(len(model.families)), key=lambda c: (e[c], -c))
            cover = max(len(x & pairs) / len(x) for f, x in licences.templates() if f == model.families[best])
            if 1 - e[-1] / sum(e) >= least and e[best] > e[-1] and cover >= 0.6 - 1e-9:
                out.add((i, k, model.families[best], round(e[best] / sum(e), 4), round(cover, 4)))
    return out


def test_licences(spark, docs, odd, licence_model):
    words = " und anderes wort" * 30
    rows = [(1, "Released under the MIT License."), (2, "x.\n" + "Licensed under the Apache License, Version 2.0." + words), (3, "The Apache helicopter was hit under fire."), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (None, "released UNDER the mit license"), (7, "He lost his driving license in May."), (8, "All rights reserved.")]
    rows += [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "All rights reserved.")]
    got = licences.licence_paragraphs(clashing(spark, rows), licence_model).collect()
    assert key((r.doc_id, r.paragraph_no, r.family) for r in got) == key([(1, 0, "mit"), (1, 0, "proprietary"), (2, 1, "apache-2.0"), (6, 0, "gpl-3.0"), (6, 1, "cc-by-nc"), (None, 0, "mit"), (8, 0, "proprietary")])
    every = rows + odd[1] + [(1000 + r.doc_id, r.text) for r in docs.collect()]
    got = licences.licence_paragraphs(frame(spark, every), licence_model).collect()
    assert len(got) == len({(r.doc_id, r.paragraph_no, r.family) for r in got}) and all(0 <= r.coverage <= 1 for r in got)
    assert {(r.doc_id, r.paragraph_no, r.family, round(r.probability, 4), round(r.coverage, 4)) for r in got} == brute_licences(every, licence_model)
    planted = {(1000 + r.doc_id) for r in docs.collect() if re.search("the MIT License|Apache License, Version|GNU General Public License, version 3|CC BY-NC 4.0|All rights reserved", r.text or "")}
    assert {r.doc_id for r in got if r.doc_id and r.doc_id >= 1000} == planted
    assert licences.licence_paragraphs(docs.limit(0), licence_model).count() == 0


# Wordings that the model does not learn from.
UNSEEN = [
    ("mit", "This plugin is offered to you under the MIT license, see below."), ("mit", "Copyright 2019. Use, copy and share under the terms of the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("apache-2.0", "You can find the whole code on the web under the Apache License 2.0"), ("apache-2.0", "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "Licensed under GPLv3"), ("gpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("gpl-2.0", "We share all of this under the GNU General Public License, version 2, and hope you like it."), ("lgpl", "The parser is covered by the GNU Lesser General Public License."), ("agpl-3.0", "The server itself is under the GNU Affero General Public License."),
    ("bsd-3-clause", "Everything here is under the BSD 3-Clause License."), ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"),
    ("bsl-1.0", "Subject to the Boost Software License, Version 1.0."), ("zlib", "A small library under the zlib license."), ("mpl-2.0", "Each file is under the Mozilla Public License, v. 2.0, as stated."), ("epl", "The bundle comes under the Eclipse Public License 2.0."),
    ("isc", "Shared with everyone under the ISC License."), ("cc0", "The data set is under the CC0 1.0 Universal licence."), ("cc-by", "Pictures: under the Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "Text of this page is under CC BY-SA 4.0 unless noted."), ("cc-by-nd", "Songs under CC BY-ND 4.0, by the band."),
    ("ofl-1.1", "The typeface falls under the SIL Open Font License."), ("proprietary", "Copyright 2020 by the firm. All rights reserved."),
]
HARMLESS = [
    "The public library is open to all under the new law.", "A licence to drive is not a licence to kill.", "Version 3 of the public plan was released in 2004.", "The MIT press published a book about the history of software.", "He wrote that the Apache License is longer than the others.",
    "Common creative work is under discussion.", "The eclipse was public and free.", "Nothing in the mozilla browser was modified.", "The conditions of the boat were poor, and so were ours.", "She holds all the rights to her songs.", "They attribute this to a public source.", "The author has waived his fee.",
]


def test_licences_in_other_words(spark, licence_model):
    rows = [(i, t) for i, (_, t) in enumerate(UNSEEN)] + [(100 + i, t) for i, t in enumerate(HARMLESS)]
    got = {r.doc_id: (r.family, r.probability) for r in licences.licence_paragraphs(frame(spark, rows), licence_model).collect()}
    right = [i for i, (f, _) in enumerate(UNSEEN) if got.get(i, ("", 0))[0] == f]
    assert len(right) >= 0.9 * len(UNSEEN) and len(got) <= len(right) + 2
    assert abs(sum(p for _, p in got.values()) / len(got) - len(right) / len(got)) < 0.2  # probabilities say how often they're right


def test_licence_main_path_runs_no_python(docs, licence_model):
    plan = licences.licence_paragraphs(docs, licence_model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(k))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if s := wins.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= s
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 1])
def test_decontamination(spark, odd, monkeypatch, block):
    r = random.Random(12)
    vocab = ["ab", "Cd", "ef", "gh", "é"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randrange(1, 30))) for k in range(6)] + [(6, None), (7, ""), (8, "..."), (None, text(12)), (2, "own words here"), (9, "ab cd")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd[1] + [(200 + k, text(300)) for k in range(10)] + [(300, " x ".join(t for _, t in items if t)), (301, "ab " * 400)]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    df = frame(spark, rows)
    got = [tuple(x) for x in decontam.decontamination(df, bench).collect()]
    assert key(got) == key(brute_hits(rows, [x for x in items if x[0] is not None]))
    assert decontam.with_hits(clashing(spark, rows[:3]), bench).columns[-3:] == ["_n_words", "_hits", "_items"]
    df = clashing(spark, rows)
    clean = decontam.remove_hits(df, bench)
    assert clean.columns == df.columns and not decontam.decontamination(clean, bench).where("contaminated").count()
    same = {h[0] for h in got if not h[5]}
    before = key((i, t) for i, t in rows if i in same and i not in (None, 3))
    assert key((x.doc_id, x.text) for x in clean.collect() if x.doc_id in same and x.doc_id not in (None, 3)) == before
    assert decontam.decontamination(df.limit(0), bench).count() == 0
    assert not decontam.decontamination(df, bench.limit(0)).where("contaminated").count()


def test_nothing_of_nameless_items_or_earlier_blocks_stays(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1)
    items = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (None, "n o p q")], "item_id long, text string")
    df = frame(spark, [(1, "s a b x y z c d t"), (2, "s n o p q t"), (3, None)])
    got = {r.doc_id: r.text and r.text.split() for r in decontam.remove_hits(df, items, window=4).collect()}
    assert got == {1: ["s", "t"], 2: ["s", "t"], 3: None}


def test_fm_index_finds_every_place():
    r = random.Random(13)
    seq = [r.randrange(1, 4) for _ in range(300)] + [0] + [1] * 90 + [0] + [r.randrange(1, 4) for _ in range(200)] + [0]
    index = decontam.FMIndex(np.array(seq))
    for n in (1, 2, 5, 10):
        for _ in range(30):
            a = r.randrange(len(seq) - n)
            phrase = seq[a : a + n]
            if 0 in phrase:
                continue
            low, high = index.search(np.array([[0] * (10 - n) + phrase]), np.array([n]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(len(seq) - n + 1) if seq[i : i + n] == phrase]
