"""Language identification by words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import boxed, crc_remainder, small_batches

#: Documents that the model learns from, about; with more labelled ones, a hash of the id picks them.
SAMPLE = 8_000
LONGEST = 4
FOLDS = 5
UNKNOWN = "und"
#: Distinct words whose scores a worker remembers at most.
REMEMBERED = 150_000

_letters = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _letters.findall(text.lower()) if text else []


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, words(text)))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word, its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def entry_hash(entry: str) -> int:
    """As Spark's xxhash64 of the entry; among a million entries an unseen one passes for known once in 10^13 times."""
    return xxhash.xxh64_intdigest(entry.encode(), 42)


class WordFirst:
    """Per-language log frequencies of words and n-grams.

    A known word scores by its own frequencies. An unseen one backs off: the longest n for which any of its n-grams is
    known scores it, by the mean over those n-grams; without any it says nothing.
    Words and the n-grams of each n have a table of their own: sorted hashes of the entries, and a row of logs for each.
    """

    def __init__(self, kinds: np.ndarray, hashes: np.ndarray, langs: list[str], counts: np.ndarray):
        """Parallel rows: n, or 0 for words; the entry's hash as a signed long; its language; its count there."""
        self.langs = sorted(set(langs))
        place = {x: i for i, x in enumerate(self.langs)}
        col = np.fromiter((place[x] for x in langs), np.int64, len(langs))
        self.keys, self.logs = [], []
        for n in range(LONGEST + 1):
            own = kinds == n
            keys, row = np.unique(hashes[own].view(np.uint64), return_inverse=True)
            table = np.zeros((len(keys), len(self.langs)))
            np.add.at(table, (row, col[own]), counts[own])
            self.keys.append(keys)
            self.logs.append(np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(keys) + 0.5)).astype(np.float32))
        self.clear()

    @classmethod
    def of(cls, table: Iterable[tuple[int, str, str, int]]) -> WordFirst:
        """From rows of (n, entry, language, count)."""
        rows = list(table)
        hashes = np.array([entry_hash(r[1]) for r in rows], np.uint64).view(np.int64)
        return cls(np.array([r[0] for r in rows], np.int64), hashes, [r[2] for r in rows], np.array([r[3] for r in rows], np.int64))

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def _looked_up(self, n: int, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each entry is in the table of n, and where."""
        keys, wanted = self.keys[n], np.fromiter(map(entry_hash, entries), np.uint64, len(entries))
        if not len(keys):
            return np.zeros(len(entries), bool), np.zeros(len(entries), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of logs for each word, all words at once: first by the table of words, then n by n those left over."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known, at = self._looked_up(0, words)
        out[known] = self.logs[0][at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            cut = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), np.fromiter(map(len, cut), np.int64, len(cut)))
            known, at = self._looked_up(n, [g for c in cut for g in c])
            owner, at = owner[known], at[known]
            found = np.bincount(owner, minlength=len(left))
            sums = np.stack([np.bincount(owner, self.logs[n][at, k], len(left)) for k in range(len(self.langs))], axis=1)
            some = found > 0
            out[left[some]] = sums[some] / found[some, None]
            left = left[~some]
        return out

    def predict_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior) of each text."""
        split = [words(t) for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(split)
        if len(self.index) > REMEMBERED:
            self.clear()
        new = list(dict.fromkeys(w for found in split for w in found if w not in self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.word_scores(new)])
        return [self._decided([self.index[w] for w in found]) if any(map(str.isalpha, found)) else (UNKNOWN, 0.0) for found in split]

    def _decided(self, at: list[int]) -> tuple[str, float]:
        total = self.scores[at].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(docs: DataFrame, *, train: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> WordFirst:
    """Counts words and n-grams by language in about `sample` labelled documents, picked by a hash of the id.

    Counts are combined in the tasks, then summed over the cluster; every word and n-gram of the sample stays, and its
    hash, language and count reach the driver. Null texts and languages are left out, repeated rows count each, and
    without any row to learn from the model knows no language.
    """
    usable = docs.filter(docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    if train is not None:
        usable = usable.filter(train)
    n = usable.count()
    picked = F.pmod(F.xxhash64(usable[id_col]), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words(text))
        if not seen:
            return
        rows: Counter = Counter()
        for (lang, w), k in seen.items():
            rows[0, w, lang] += k
            for m in range(1, LONGEST + 1):
                for g in grams(w, m):
                    rows[m, g, lang] += k
        keys = list(rows)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part]), pa.array([k[2] for k in part]), pa.array([rows[k] for k in part], pa.int64())], ["n", "entry", "lang", "count"])

    counts = small_batches(usable).filter(picked).select(usable[text_col].alias("text"), usable[lang_col].cast("string").alias("lang")).mapInArrow(count, "n int, entry string, lang string, count long")
    table = counts.groupBy("n", "entry", "lang").agg(F.sum("count").alias("count")).select("n", F.xxhash64("entry").alias("hash"), "lang", "count").toArrow()
    return WordFirst(table.column("n").to_numpy(), table.column("hash").to_numpy(), table.column("lang").to_pylist(), table.column("count").to_numpy())


def predict(docs: DataFrame, model: WordFirst, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the model, of bounded size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in batches:
            found = own.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [id_col, "lang_pred", "score"])

    return small_batches(docs).select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def decided(docs: DataFrame, model: WordFirst, text_col: str = "text") -> DataFrame:
    """(box, lang_pred, score, lettered) of every row; box holds the row's own columns, whatever their names.

    Null texts and texts without a letter are `und` with score 0 and not lettered; so is the language of every text if
    the model knows none; repeated rows are predicted each, whole; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lettered boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.predict_all(texts)
        return pd.DataFrame([(*x, x[0] != UNKNOWN or lettered(t)) for x, t in zip(found, texts, strict=True)], columns=["lang_pred", "score", "lettered"])

    return small_batches(docs).select(boxed(docs).alias("box"), run(docs[text_col]).alias("found")).select("box", "found.*")


def identify(docs: DataFrame, *, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of the language) of every row.

    Rows whose crc32 of the id is divisible by `folds` are held out of learning. Null texts and texts without a letter
    are `und` with score 0, and so is every text if there is nothing to learn from; of equal scores the language first
    in the alphabet wins; repeated rows are predicted each; an empty table gives an empty one.
    """
    held_out = crc_remainder(docs[id_col], folds) == 0
    model = fit(docs, train=~held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = predict(docs, model, id_col=id_col, text_col=text_col)
    return found.select(F.col(id_col).alias("doc_id"), (crc_remainder(F.col(id_col), folds) == 0).alias("held_out"), "lang_pred", "score")
