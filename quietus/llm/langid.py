"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the text's byte trigrams, the language that markup declares (through an error table learned from the
corpus), the address suffix, and a host's prior, smoothed by its domain's, which is smoothed by the corpus's. All tables are grouped
sums over the whole corpus: trigrams by declared language, then declared language, suffix, domain and host by the language the text alone suggests.

A row is accepted if it has letters and its best posterior reaches ``min_posterior``.

Languages declared by fewer than ``min_share`` of the rows, and those beyond ``max_languages``, share one class, ``other``. A row of that class has the language it declares,
if that is one of them; if it declares none or another one, it is rejected as ``other``: a rare language is never taken for a frequent one for want of a profile.

Edge cases: a null or empty text, or one without letters, gives no text evidence and is rejected; null declared language, host or suffix is no evidence; a language declared as ``other`` is of that class;
ties go to the candidate declared most often; repeated rows are judged alike; ids may be
null; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.llm.names import fresh
from quietus.session import TEXTS, cut, if_small

BUCKETS = 1 << 15
#: The class of all languages without a profile of their own.
OTHER = "other"
#: Overlapping trigrams are not independent: a trigram weighs this much.
TEMPER = 0.3
#: Pseudo-counts that tie a host to its domain and a domain to the corpus.
STRENGTH = 20.0
#: ASCII that is no letter reads as a blank.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lowered text; blanks run together, and stand at both ends."""
    raw = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    key = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def profile(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities [language, bucket], add-half smoothed, from all rows by declared language; each task sums before the shuffle."""
    at = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            for declared, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid and (k := at.get(declared, at.get(OTHER))) is not None:
                    k *= BUCKETS
                    sums[k : k + BUCKETS] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(sums[cell], pa.int64())], names=["cell", "n"])

    # len(languages) * BUCKETS rows at most reach the driver.
    got = rows.select("declared", "text").where("declared is not null").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(len(languages) * BUCKETS)
    sums[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    sums = sums.reshape(len(languages), BUCKETS) + 0.5
    return np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with ``ll`` and ``n`` in place of ``text``: tempered log likelihoods and number of trigrams of every whole text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, count = [], []
            for text in batch.column(len(kept)):
                keys = trigrams(text.as_py() or "")
                found.append((TEMPER * np.array([row[keys].sum(dtype=np.float64) for row in table])).tolist())
                count.append(len(keys))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.list_(pa.float64())), pa.array(count, pa.int64())], names=[*kept, "ll", "n"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    return rows.select(*kept, "text").mapInArrow(run, schema)


def _counted(seen: DataFrame, key: str, size: int) -> DataFrame:
    """(key, counts): rows of each language the text suggests, by ``key``."""
    return seen.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy(key).agg(F.array(*[F.sum((F.col("guess") == k).cast("double")) for k in range(size)]).alias(f"{key}_counts"))


def _smoothed(counts: Column, below: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, below, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def _shares(counted: DataFrame, key: str, size: int, floor: float) -> DataFrame:
    """(key, key_logs): log P(key | language) of every value seen."""
    whole = counted.agg(*[F.sum(F.col(f"{key}_counts")[k]).alias(str(k)) for k in range(size)], F.count("*").alias("n")).first()
    below = F.array(*[F.lit((whole[str(k)] or 0.0) + floor * max(1, whole["n"])) for k in range(size)])
    return counted.select(key, F.zip_with(f"{key}_counts", below, lambda c, t: F.log((c + floor) / t)).alias(f"{key}_logs"))


class Evidence:
    """The corpus's tables: trigram profiles, and by declared language, suffix, domain and host the languages that texts alone suggest.

    Languages declared by fewer than ``min_share`` of the rows, and beyond ``max_languages``, share one class, ``other``, with a profile of all their rows.
    """

    def __init__(self, rows: DataFrame, min_share: float, max_languages: int):
        counts = rows.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
        named = counts.orderBy(F.desc("n"), "declared").limit(max_languages).collect()
        self.languages = [r["declared"] for r in named if r["n"] >= min_share * total]
        if total > sum(r["n"] for r in named if r["declared"] in set(self.languages)):
            self.languages.append(OTHER)
        if not self.languages:
            return
        self.size = len(self.languages)
        self.profile = profile(rows, self.languages)
        seen = self.seen = cut(self.guessed(rows), TEXTS)
        whole = seen.where("n > 0").agg(*[F.sum((F.col("guess") == k).cast("double")).alias(str(k)) for k in range(self.size)]).first()
        corpus = np.array([whole[str(k)] or 0.0 for k in range(self.size)]) + 1.0
        self.corpus = F.array(*[F.lit(float(x)) for x in corpus / corpus.sum()])
        self.tables = {}
        for key, floor in (("declared", 0.5), ("suffix", 1.0), ("domain", None), ("host", None)):
            counted = cut(_counted(seen, key, self.size))
            self.tables[key] = if_small(counted if floor is None else _shares(counted, key, self.size, floor), 1_000_000 // self.size)

    def guessed(self, rows: DataFrame) -> DataFrame:
        return text_evidence(rows, self.profile).withColumn("guess", _best(F.col("ll")))

    def judged(self, guessed: DataFrame, min_posterior: float) -> DataFrame:
        """``guessed`` with language, posterior, text_language and accepted."""
        rows = guessed
        for key, table in self.tables.items():
            rows = rows.join(table, key, "left")
        zeros = F.array(*[F.lit(0.0)] * self.size)
        add = lambda a, b: F.zip_with(a, F.coalesce(b, zeros), lambda x, y: x + y)
        # A row's own text is evidence already: it is left out of its host's and domain's counts.
        others = lambda c: F.coalesce(F.transform(c, lambda x, k: x - ((F.col("n") > 0) & (F.col("guess") == k)).cast("double")), zeros)
        prior = _smoothed(others(F.col("host_counts")), _smoothed(others(F.col("domain_counts")), self.corpus))
        rows = rows.withColumn("evidence", add(add("ll", F.col("declared_logs")), F.col("suffix_logs")))
        rows = rows.withColumn("log", F.zip_with("evidence", prior, lambda a, p: a + F.log(p)))
        rows = rows.withColumn("top", F.array_max("log")).withColumn("best", _best(F.col("log")))
        posterior = 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
        names = F.array(*map(F.lit, self.languages))
        found = names[F.col("best")]
        # A language without a profile of its own is known by what the row declares, if that is such a language too.
        rare = F.col("declared").isNotNull() & ~F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))
        language = F.when(found != OTHER, found).otherwise(F.when(rare, F.col("declared")).otherwise(OTHER))
        return rows.withColumns({"language": language, "posterior": posterior, "text_language": F.when(F.col("n") > 0, names[F.col("guess")]), "accepted": (F.col("n") > 0) & (posterior >= min_posterior) & ((found != OTHER) | rare)})


def _best(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def _rows(docs: DataFrame, id_col: str, text: Column, declared: Column, host: Column, suffix: Column | None = None, domain: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), declared.alias("declared"), (suffix if suffix is not None else none).alias("suffix"), (domain if domain is not None else host).alias("domain"), host.alias("host"), text.alias("text"))


def identify(docs: DataFrame, id_col: str, text: Column, declared: Column, host: Column, suffix: Column | None = None, domain: Column | None = None, min_posterior: float = 0.5, min_share: float = 0.001, max_languages: int = 64) -> DataFrame:
    """(doc_id, digest, language, posterior, text_language, declared, accepted) of every row of ``docs``."""
    rows = _rows(docs, id_col, text, declared, host, suffix, domain)
    evidence = Evidence(rows, min_share, max_languages)
    none = F.lit(None).cast("string")
    if not evidence.languages:
        return rows.select("doc_id", "digest", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), "declared", F.lit(False).alias("accepted"))
    return evidence.judged(evidence.seen, min_posterior).select("doc_id", "digest", "language", "posterior", "text_language", "declared", "accepted")


def of_documents(docs: DataFrame) -> DataFrame:
    """``documents``: the stated language is the declared one, a source is a host; there is no address, and so no suffix."""
    return identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def of_pages(pages: DataFrame) -> DataFrame:
    """``pages``: visible text, the language of the html element, and the url's host, domain and suffix."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1>|\z)|<[^<>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    return identify(pages, "page_id", text, declared, host, F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))


def keep_identified(docs: DataFrame, min_posterior: float = 0.5, min_share: float = 0.001, max_languages: int = 64) -> DataFrame:
    """The rows of ``docs`` that are accepted, all columns, with the language found in ``lang``. Where no row declares a language, there is nothing to tell languages by: all rows stay as they are.

    Texts stay where they lie, if only few rows are rejected or get another language than they declare: those verdicts alone are joined to them, broadcast where counted to be few.
    """
    rows = _rows(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    evidence = Evidence(rows, min_share, max_languages)
    if not evidence.languages:
        return docs
    found = evidence.judged(evidence.seen, min_posterior).where(~(F.col("accepted") & F.col("language").eqNullSafe(F.col("declared"))))
    # Rows that are equal in all that they are judged by have one verdict.
    i_id, i_digest, i_declared, i_host, i_nulls, i_language, i_accepted = fresh(docs, "i_id", "i_digest", "i_declared", "i_host", "i_nulls", "i_language", "i_accepted")
    texts = {name: F.coalesce(F.col(c), F.lit("")) for name, c in ((i_declared, "declared"), (i_host, "host"))}
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in ("doc_id", "declared", "host")]).alias(i_nulls)
    moves = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias(i_id), F.col("digest").alias(i_digest), *[c.alias(n) for n, c in texts.items()], nulls).agg(F.first("language").alias(i_language), F.first("accepted").alias(i_accepted))
    match = (
        (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col(i_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(i_digest))
        & (F.coalesce("lang", F.lit("")) == F.col(i_declared)) & (F.coalesce("source", F.lit("")) == F.col(i_host))
        & (F.concat(*[F.col(c).isNull().cast("string") for c in ("doc_id", "lang", "source")]) == F.col(i_nulls))
    )
    kept = docs.join(if_small(cut(moves)), match, "left").where(F.coalesce(i_accepted, F.lit(True)))
    return kept.select(*[F.coalesce(i_language, "lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])
