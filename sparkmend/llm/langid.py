"""Language ID: word-first backoff.

A known word adds its log frequency in every language. An unseen word is read as padded character n-grams of
the longest length of which any is known, and adds their mean. The model is fitted on a bounded sample of
labelled documents of each language (train_rows divided among the languages, or LEAST_ROWS if that is more, in expectation;
chosen by a hash of the id, the same in every run), read whole, and holds every word and n-gram of that sample with its
counts in all languages; the sample's bound is the model's. Every language is smoothed by the same prior, the mean of all languages' shares with
the weight of PRIOR tokens: one of few tokens gains nothing by that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmend.llm.columns import keyed_text, slices
from sparkmend.operators.shared import written

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
UNKNOWN = "und"
LEAST_ROWS, PRIOR = 1_000, 1_000.0
COUNTS_SCHEMA = "lang string, size int, item string, n long"
OUT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class Model(NamedTuple):
    """Log frequencies, a column for each language, of words and of n-grams, which are strung together by line breaks: workers keep what is sent
    to them, and one string is a fraction of many."""

    langs: list[str]
    words: str
    word_rows: np.ndarray
    grams: str
    gram_rows: np.ndarray


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """crc32 of the id as text falls in the fold kept for testing; a null id never does."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)] if size > 1 else list(word)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and character n-grams by language, summed in each batch."""
    for batch in slices(batches):
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            by.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, counts in by.items():
            grams: Counter = Counter()
            for word, n in counts.items():
                if word := letters(word):
                    rows.append((lang, 0, word, n))
                    for size in range(1, LONGEST_GRAM + 1):
                        for g in grams_of(word, size):
                            grams[g] += n
            rows += [(lang, len(g), g, n) for g, n in grams.items()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "item", "n"])


def fit(docs: DataFrame, train_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that have a text and a language and are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # reads two columns only
    each, grain = max(LEAST_ROWS, train_rows // max(1, len(there))), 1 << 30
    cuts = docs.sparkSession.createDataFrame([(lang, int(min(1.0, each / n) * grain)) for lang, n in there.items()], "lang string, cut long")
    drawn = rows.where(F.col("text").isNotNull()).join(F.broadcast(cuts), "lang")
    sample = drawn.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(grain)) < F.col("cut")).select("doc_id", "text", "lang")
    counts = sample.mapInArrow(gathered, COUNTS_SCHEMA).groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    counts = written(counts, "language_counts")
    table = counts.toArrow()  # as large as the sample allows
    names, sizes = table["lang"].to_numpy(), table["size"].to_numpy()
    langs = sorted(set(names.tolist()))
    lang = np.searchsorted(np.array(langs, object), names) if langs else np.zeros(0, np.int64)
    parts: list = []
    for mine in (sizes == 0, sizes > 0):
        coded = pc.dictionary_encode(table["item"].filter(pa.array(mine))).combine_chunks()
        if not len(coded):
            parts += ["", np.zeros((0, len(langs)), np.float32)]
            continue
        item, own_lang, own_size = coded.indices.to_numpy(), lang[mine], sizes[mine]
        n = np.zeros((len(coded.dictionary), len(langs)))
        n[item, own_lang] = table["n"].filter(pa.array(mine)).to_numpy()
        totals = np.zeros((LONGEST_GRAM + 1, len(langs)))
        np.add.at(totals, (own_size, own_lang), n[item, own_lang])
        size_of = np.zeros(len(n), np.int64)
        size_of[item] = own_size
        own = totals[size_of]
        usual = np.divide(n, own, out=np.zeros_like(n), where=own > 0).sum(axis=1, keepdims=True) / len(langs)
        parts += ["\n".join(coded.dictionary.to_pylist()), np.log((n + PRIOR * usual) / (own + PRIOR)).astype(np.float32)]
    return Model(langs, *parts)


class Scorer:
    """Predicts; the rows of words it has met are kept, up to a bound."""

    def __init__(self, model: Model, most_kept: int = 100_000):
        self.model, self.most_kept = model, most_kept
        self.reset()

    def reset(self) -> None:
        """Rows: 0 for what has no letter, then the known words, then words met. Columns: languages, whether known, whether a word."""
        k, known = len(self.model.langs), len(self.model.word_rows)
        self.index = {w: i + 1 for i, w in enumerate(self.model.words.split("\n") if known else [])}
        self.matrix = np.zeros((max(1024, known + self.most_kept // 4), k + 2), np.float32)
        self.matrix[1 : known + 1, :k] = self.model.word_rows
        self.matrix[1 : known + 1, k:] = 1
        self.used, self.known = known + 1, known
        self.grams = {g: i for i, g in enumerate(self.model.grams.split("\n") if len(self.model.gram_rows) else [])}

    def backoff(self, word: str) -> np.ndarray | None:
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = [g for g in map(self.grams.get, grams_of(word, size)) if g is not None]
            if known:
                return self.model.gram_rows[known].mean(axis=0)
        return None

    def learn(self, words: set[str]) -> None:
        while self.used + len(words) > len(self.matrix):
            self.matrix = np.r_[self.matrix, np.zeros_like(self.matrix)]
        for word in sorted(words):
            plain = letters(word)
            if not plain:
                self.index[word] = 0
                continue
            at = self.index.get(plain, 0)
            row = self.model.word_rows[at - 1] if 0 < at <= self.known else self.backoff(plain)
            self.matrix[self.used, -1] = 1
            if row is not None:
                self.matrix[self.used, :-2] = row
                self.matrix[self.used, -2] = 1
            self.index[word] = self.used
            self.used += 1

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Of each text the language, its score, and whether any word of it or n-gram is known."""
        split = [words_of(t) for t in texts]
        index = self.index
        self.learn({w for ws in split for w in ws if w not in index})
        k = len(self.model.langs)
        preds, scores, known = [], [], []
        for ws in split:
            rows = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            total = self.matrix[rows].sum(axis=0, dtype=np.float64)
            n = total[-1]
            known.append(bool(total[-2] > 0) and k > 0)
            if not n or not k:
                preds.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = total[:k] / n * min(n, 20.0)  # evidence of up to twenty words, else every score were 1
            p = np.exp(mean - mean.max())
            best = int(np.argmax(p))
            preds.append(self.model.langs[best])
            scores.append(float(p[best] / p.sum()))
        if self.used - self.known > self.most_kept:
            self.reset()
        return preds, scores, known


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, and so is all text if nothing was learned (an
    empty or unlabelled table). Of equally likely languages the first by name is taken. Null ids are never held
    out. Repeated rows stay; other columns (lang and source among them) are not read.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bound.value)
        for batch in slices(batches, 2 << 20):
            preds, scores, _ = scorer.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = keyed_text(docs, id_col, text_col)
    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, OUT_SCHEMA)


def keep_with_language(docs: DataFrame, model: Model, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents, all their columns, that have a language: not `und`, with a word or n-gram that the model knows, and no score below least_score.

    So null texts, texts without a letter and texts in scripts that the model never met go. Other columns may have any names.
    """
    bound, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bound.value)
        for batch in slices(batches, 2 << 20):
            _, scores, known = scorer.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([k and s >= least_score for k, s in zip(known, scores)]))

    return docs.mapInArrow(run, docs.schema)
