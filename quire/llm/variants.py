"""Spelling variants of the words of a corpus, found in groups of words with one place left open, without pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, stored

#: A run of the occurrences of a word loses a letter if this number divides its hash.
DROPPED = 31
SHORTEST, RAREST, RATIO = 7, 2, 10
#: Distinct words whose counts a task holds before it hands them on, and rows of an Arrow batch.
HELD, ROWS = 200_000, 50_000

_run = re.compile("[a-zÀ-ÿ]+")

# Words, words less a letter and words with an open place share one space of keys: a polynomial over code points modulo a
# prime of 127 bits. The open place counts as a code point of its own, so it takes no part in any word.
PRIME = (1 << 127) - 1
BASE = 0x2545F4914F6CDD1D_9E3779B97F4A7C15
OPEN = 0x110000


def key(word: str) -> bytes:
    """The key of a word."""
    found = 0
    for c in word:
        found = (found * BASE + ord(c) + 1) % PRIME
    return found.to_bytes(16)


def neighbours(word: str) -> Iterator[tuple[bytes, int]]:
    """(key, code point left open) of the word with each place open, and (key, -1) of the word less each letter.

    Of equal letters in a row only the last is left out, as each gives the same. All keys follow from sums over the
    letters before and behind a place, so they take time in proportion to the word.
    """
    codes = [ord(c) + 1 for c in word]
    behind, power = [0], [1]
    for c in reversed(codes):
        behind.append((behind[-1] + c * power[-1]) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    before, last = 0, len(codes) - 1
    for i, c in enumerate(codes):
        rest, place = behind[last - i], power[last - i]
        yield (((before * BASE + OPEN + 1) * place + rest) % PRIME).to_bytes(16), c - 1
        if i == last or codes[i + 1] != c:
            yield ((before * place + rest) % PRIME).to_bytes(16), -1
        before = (before * BASE + c) % PRIME


def misspelt(doc: int | None, run: str, dropped: int = DROPPED) -> str:
    """The run, or the run less one letter if its hash with the document's id is divisible by `dropped`; a null id counts as empty."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % dropped:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, shortest: int = SHORTEST, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text", dropped: int = DROPPED, most: int = HELD) -> DataFrame:
    """(word, n) of all words with `shortest` letters and `rarest` occurrences or more; tasks count up to `most` words before they hand them on."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(r for r in _run.findall((text or "").encode().lower().decode()) if len(r) >= shortest)
                for word, n in own.items():
                    if len(said := misspelt(doc, word, dropped)) >= shortest:
                        held[said] += n
                if len(held) > most:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    each = small_batches(docs).select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def _keyed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, own, word, n) of all words, own being the key, and (key, open, id, n) of their neighbours; ids are short, as rows repeat them."""

    def own(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key(w) for w in batch.column(0).to_pylist()], pa.binary()), *batch.columns], ["own", "word", "n"])

    def near(batches):
        kinds, held = (pa.binary(), pa.int32(), pa.int64(), pa.int64()), []
        for batch in batches:
            for id, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, code in neighbours(word):
                    held.append((k, code, id, n))
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["key", "open", "id", "n"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["key", "open", "id", "n"])

    known = stored(words.select("word", "n").mapInArrow(own, "own binary, word string, n long").withColumn("id", F.monotonically_increasing_id()))
    return known, stored(small_batches(known).select("id", "word", "n").mapInArrow(near, "key binary, open int, id long, n long"))


def _replies(known: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, n, near, of, of_n): for a word, how many near words a group of it holds, and which of them occurs most.

    Words that agree but for an open place differ in nothing but the letter there, so a group has no more words than
    letters; it keeps its size and its top two words, the second for the first one. A word less a letter meets the
    vocabulary: both words of such a meeting hear of each other.
    """
    same = rows.filter("open >= 0")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "open", "id"))), 1, 2)
    groups = same.groupBy("key").agg(F.count(F.lit(1)).alias("size"), top.alias("top")).filter("size > 1")
    best = F.when(F.col("top")[0]["id"] == F.col("id"), F.col("top")[1]).otherwise(F.col("top")[0])
    replaced = same.join(groups, "key").select("id", "n", (F.col("size") - 1).alias("near"), best["id"].alias("of"), (-best["rank"]).alias("of_n"))
    shorter = known.select(F.col("own").alias("key"), F.col("id").alias("short"), F.col("n").alias("short_n"))
    met = rows.filter("open < 0").join(shorter, "key")
    both = F.array(F.struct("id", "n", F.lit(1).cast("long").alias("near"), F.col("short").alias("of"), F.col("short_n").alias("of_n")), F.struct(F.col("short").alias("id"), F.col("short_n").alias("n"), F.lit(1).cast("long").alias("near"), F.col("id").alias("of"), F.col("n").alias("of_n")))
    return replaced.union(met.select(F.inline(both)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each join doubles the steps that are known.

    A form occurs `RATIO` times as often as its word, so chains are no longer than a count has digits.
    """
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return known


def spelling_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; words: word, n, each word once.

    Words are near if one letter inserted, left out or replaced makes them equal. A word's form is its near word with the
    largest n, then the smallest one, if that n is `ratio` times its own. Words of any length take rows in proportion to
    their letters: keys stand for letters, and texts come back for those words alone that may be a form. An empty table
    gives an empty one.
    """
    known, rows = _keyed(words)
    replies = stored(_replies(known, rows))
    near = replies.groupBy("id").agg(F.sum("near").alias("n_near"))
    named = known.select(F.col("id").alias("of"), F.col("word").alias("of_word"))
    able = replies.filter(F.col("of_n") >= ratio * F.col("n")).join(named, "of")
    best = F.min(F.struct((-F.col("of_n")).alias("rank"), F.col("of_word").alias("form")))
    forms = stored(able.groupBy("id").agg(best.alias("best")).join(known, "id").select("id", "word", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")))
    found = known.join(near, "id", "left").join(forms.drop("word"), "id", "left").join(_roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def document_variants(docs: DataFrame, **options) -> DataFrame:
    """The variants of the words of all texts; options are those of `word_counts`.

    Words are runs of letters up to U+00FF, A-Z in lower case. Null texts hold none; a null id counts as the empty text;
    repeated rows count as often as they stand there; other columns are not read; an empty table gives an empty one.
    """
    return spelling_variants(word_counts(docs, **options))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS step FROM range(256) r(i) UNION ALL
                        SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT doc_id, run, n, list_transform(range(0, CAST(octet_length(encode(said)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(said)), 2 * i + 1, 2) AS UBIGINT)) AS b FROM own),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda c, x: xor(t[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256)), CAST(4294967295 AS UBIGINT)) AS h FROM bytes, crc),
told AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM told WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
opened AS (SELECT word, n, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS k FROM spots),
cut AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM spots),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM opened a JOIN opened b ON a.k = b.k AND a.word <> b.word
          UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.k = b.word
          UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.k = b.word),
near AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
form AS (SELECT word, other AS form, other_n AS form_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM pairs) WHERE r = 1 AND other_n >= 10 * n),
walk AS (SELECT word, form AS root, 1 AS step FROM form UNION ALL SELECT w.word, f.form, w.step + 1 FROM walk w JOIN form f ON f.word = w.root)
SELECT v.word, f.form, coalesce((SELECT max_by(w.root, w.step) FROM walk w WHERE w.word = v.word), v.word) AS root, v.n, coalesce(near.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN near ON near.word = v.word LEFT JOIN form f ON f.word = v.word
"""
