"""Spelling variants: words of a corpus that differ by one code point, each led to its more frequent form.

Words are counted by Spark from each text's distinct words. Two words near each other share one of their rarest bigrams: one edit touches two bigrams at most, so of three bigrams that come first in one
order of all bigrams (the rarest first), one is whole in both words, at places that differ by no more than the words' lengths. What the single edit leaves of a
word lies before or behind such a shared bigram, so one side of it is equal in both: words meet by bigram, place, length and that side, not by the bigram alone. All bigrams of a word that
equal one of its three rarest count, since equal ones have no order. Pairs are then verified by edit distance.

A frequent bigram is met by few words only, those that have no three rarer ones; a frequent word is one row. Counts are combined before they are shuffled.

Edge cases: a null text has no words; a null id is written as nothing before the colon; a run of one letter that loses it is no word; ties between forms go to the word that is smallest in code-point order; repeated rows count
each; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.llm.checksums import CRC_TABLE, crc32
from quietus.session import TEXTS, cut, if_small, kept

#: Words of fewer code points, or seen less often, take no part.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Bigrams that one edit can touch, and one more.
PREFIX = 3
#: One in so many words of a document loses a code point.
LOSS = 97
#: Different words that a task counts before it hands them on.
HELD = 400_000
#: A form is at least so many times as frequent.
RATIO = 2


def _letters() -> bytes:
    """Latin-1 bytes: A-Z become a-z, letters stay, all else becomes a blank."""
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b >= 0xC0
    return bytes(ord(chr(b).lower()) if b < 0x80 and letter(b) else b if letter(b) else 0x20 for b in range(256))


_TABLE = _letters()


def words_of(text: str | None, id_: int | None, loss: int = LOSS, least: int = 1) -> Counter:
    """The words of ``least`` letters or more of a text (Latin-1 bytes) and how often each occurs, some without one of their letters."""
    found = Counter((text or "").encode("latin-1", "replace").translate(_TABLE).split())
    head = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        if (size := len(word)) < least:
            continue
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
        if h % loss == 0:
            at = h % size
            if size > least:
                out[word[:at] + word[at + 1 :]] += n
        else:
            out[word] += n
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, loss: int = LOSS) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def rows_of(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in frames:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(text.as_py(), id_, loss, LEAST_LENGTH).items():
                    found[word] += n
                if len(found) >= HELD:
                    yield rows_of(found)
                    found = Counter()
        yield rows_of(found)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _bigrams(word: str) -> Column:
    """(at, gram) of every bigram of a word, places from 0."""
    return F.transform(F.sequence(F.lit(0), F.char_length(word) - 2), lambda i: F.struct(i.alias("at"), F.substring(word, i + 1, 2).alias("gram")))


def rarest(words: DataFrame) -> DataFrame:
    """(word, places): the bigrams of every word that are among its three rarest over all words, by (frequency, bigram), or equal to one of these."""
    grams = words.select("word", F.explode(_bigrams("word")).alias("b")).select("word", "b.at", "b.gram")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    # At most the square of the letters: 39,000 rows.
    ranked = grams.join(if_small(cut(often)), "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("bs"))
    third = F.col("bs")[F.least(F.lit(PREFIX), F.size("bs")) - 1]
    first = F.filter("bs", lambda b: (b["often"] < third["often"]) | ((b["often"] == third["often"]) & (b["gram"] <= third["gram"])))
    return ranked.select("word", F.transform(first, lambda b: b["at"]).alias("places"))


def _meetings(words: DataFrame, less: int) -> DataFrame:
    """(word, size, key) of the keys at which a word meets others: those of ``size``, ``less`` code points shorter than it.

    An edit lies behind a shared bigram, and all up to it is equal, or before it, and all from it on is. What is on the edit's side is halved: the edit lies in one half, and the other one is equal too.
    """
    length = F.char_length("word")
    rows = words.select("word", (length - less).alias("size"), F.explode("places").alias("at"))
    end = F.col("at") + 2
    side = lambda k, text: F.struct(F.lit(k).alias("side"), text.alias("text"))
    behind, before = F.col("size") - end, F.col("at") - less  # code points of the edit's side in the shorter word
    one, two = F.floor(behind / 2).cast("int"), F.floor(before / 2).cast("int")
    tail = lambda n: F.substring("word", length - n + 1, n)
    sides = F.array(
        F.when(behind >= 0, side(0, F.concat_ws(" ", F.substring("word", F.lit(1), end), F.substring("word", end + 1, one)))),
        F.when(behind >= 0, side(1, F.concat_ws(" ", F.substring("word", F.lit(1), end), tail(behind - one)))),
        F.when(before >= 0, side(2, F.concat_ws(" ", F.substring("word", F.col("at") + 1, length), F.substring("word", F.lit(1), two)))),
        F.when(before >= 0, side(3, F.concat_ws(" ", F.substring("word", F.col("at") + 1, length), F.substring("word", F.col("at") + 1 - (before - two), before - two)))),
    )
    met = rows.select("word", "size", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s"))
    return met.select("word", "size", F.xxhash64("size", "s.side", "s.text").alias("key"))


def near(words: DataFrame) -> DataFrame:
    """(word, other): all pairs of words that differ by exactly one inserted, deleted or replaced code point, once each, the shorter or smaller first."""
    first = kept(rarest(words), "rarest")
    # The longer word of a pair, or the larger one of equally long ones, asks for partners of its own length and of one less.
    asks = _meetings(first, 0).unionByName(_meetings(first, 1)).select(F.col("word").alias("other"), "key")
    # Spark sizes exploded rows as their source, which may look small enough to broadcast: the joins of words are sorted ones, whatever it expects.
    pairs = _meetings(first, 0).join(asks.hint("merge"), "key").where((F.char_length("other") > F.col("size")) | (F.col("word") < F.col("other")))
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()


def roots(forms: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(word, root): where the chain of forms (word, form) ends, by pointer doubling. Each form is more frequent than its word, so chains end."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        further = cut(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = further.select("word", "root")
        if further.where("moved").isEmpty():
            return at
    raise RuntimeError("forms did not end within max_rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form (its near word of largest n, if that is ``ratio`` times its own at least), root, n, n_near, form_n."""
    words = kept(counted(docs, id_col, text_col, loss), "words", TEXTS)
    pairs = kept(near(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    has = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    found = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for ``variants`` of ``documents``: words that lack one code point at the same place, or that are another word without one."""
    return rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
found AS (SELECT doc_id, w, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT w, c, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM found, t),
kept AS (SELECT CASE WHEN h % {LOSS} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
form AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN (SELECT min(encode(other)) FROM pairs p WHERE p.word = words.word AND p.n = top) END AS form, CASE WHEN top >= {RATIO} * n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
forms AS (SELECT * REPLACE (decode(form) AS form) FROM form),
chain AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN forms f ON f.word = chain.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
