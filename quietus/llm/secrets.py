"""Secret scans weighed by corpus-wide ownership.

Every text yields base spans (assignments, access keys, long hex) and further candidates (long mixed tokens). Each candidate's
value is hashed; over the whole corpus a hash is counted by the distinct repositories and owners that hold it. A value that more than ``max_owners`` owners or
``max_repos`` repositories hold is an example that people copy; one that few hold looks live. Base spans are always reported; a further
candidate is reported, as kind ``owned``, only where it looks live.

Where a table has no repository column, each text is a repository of its own, under its owner: copies of one text count once for an owner.

Edge cases: a null text is empty; a null owner or repository counts as one unnamed owner or repository; repeated rows are all returned and count
once for ownership; ids may be null or repeated; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.llm.names import fresh
from quietus.session import TEXTS, cut, if_small

#: In the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "owned"]
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: what [0-9a-f]+ finds, without the shorter runs
_MIXED = re.compile(r"(?a)(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_MIX = re.compile(r"(?a)(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")

SPANS = "array<struct<start:long,kind:int,end:long,hash:string>>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, min_entropy: float = 3.5) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind; positions in code points, end exclusive. A mixed token inside a base span is no candidate."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((a, b) for a, _, b, _ in found)
    at, last = 0, -1
    for m in _MIXED.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            last = max(last, base[at][1])
            at += 1
        if m.start() >= last and _MIX.match(m[0]) and entropy(m[0]) >= min_entropy:
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None, min_entropy: float = 3.5) -> DataFrame:
    """(doc_id, digest, owner, repo, spans) of every row; ``spans`` is SPANS, the hash that of the span's value."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for a, k, b, v in candidates(text.as_py() or "", min_entropy)] for text in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, kind)], names=["doc_id", "digest", "owner", "repo", "spans"])

    repo = F.col(repo_col) if repo_col else digest_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, digest long, owner string, repo string, spans {SPANS}")


def digest_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): the distinct repositories and owners that hold each candidate value."""
    held = scanned.select(F.explode("spans.hash").alias("hash"), "owner", "repo")
    repos = held.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return repos.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def judged(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(doc_id, digest, spans) of the rows of ``scanned`` (kept in the shared folder) that hold candidates; each span has n_repos, n_owners and live."""
    rows = scanned.where(F.size("spans") > 0).select("doc_id", "digest", F.explode("spans").alias("s")).select("doc_id", "digest", "s.*")
    rows = rows.join(ownership(scanned), "hash")
    span = F.struct("start", "kind", "end", "hash", "n_repos", "n_owners", ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).alias("live"))
    return rows.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 50) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_examples (base and further spans by judgement), most_repos, most_owners (of the row's most copied value)."""
    scanned = cut(scan(docs, id_col, text_col, owner_col, repo_col), TEXTS)
    found = judged(scanned, max_owners, max_repos).toDF("j_id", "j_digest", "j_spans")
    rows = scanned.select("doc_id", "digest").join(found, F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("digest") == F.col("j_digest")), "left")
    rows = rows.withColumn("j_spans", F.coalesce("j_spans", F.array().cast(found.schema["j_spans"].dataType)))
    base = F.filter("j_spans", lambda s: s["kind"] < 3)
    shown = F.filter("j_spans", lambda s: (s["kind"] < 3) | s["live"])
    count = lambda test: F.size(F.filter("j_spans", test)).cast("long")

    def of_kind(k: int) -> Column:
        return count(lambda s: s["kind"] == k)

    return rows.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(shown).alias("spans"),
        count(lambda s: (s["kind"] == 3) & s["live"]).alias("n_owned"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_examples"),
        *[F.coalesce(F.array_max(F.col(f"j_spans.{c}")), F.lit(0)).cast("long").alias(f"most_{c[2:]}") for c in ("n_repos", "n_owners")],
    )


def _masked(mark: str):
    """Texts with ``mark`` in place of their cuts (start, end), which are in order; cuts that overlap are one. Each text is cut once into pieces."""

    def run(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text: str | None, spans) -> str | None:
            out, at = [], 0
            for start, end in spans if spans is not None else ():
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        return pd.Series([one(*row) for row in zip(texts, cuts, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 2, max_repos: int = 50, mark: str = "<secret>") -> DataFrame:
    """``docs``, all rows and columns, with ``mark`` in place of every span that looks live. Overlapping spans share one mark; a text's time is in proportion to its length and its spans."""
    scanned = cut(scan(docs, id_col, text_col, owner_col, repo_col), TEXTS)
    j_id, j_digest, j_cuts, j_text, j_masked = fresh(docs, "j_id", "j_digest", "j_cuts", "j_text", "j_masked")
    live = judged(scanned, max_owners, max_repos).select(F.col("doc_id").alias(j_id), F.col("digest").alias(j_digest), F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.array(s["start"], s["end"])).alias(j_cuts)).where(F.size(j_cuts) > 0)
    keyed = docs.withColumn(j_text, digest_of(text_col))
    rows = keyed.join(if_small(cut(live)), keyed[id_col].cast("long").eqNullSafe(F.col(j_id)) & (F.col(j_text) == F.col(j_digest)), "left")
    # Texts without a cut stay in the JVM: to Python goes a null in their place.
    found = F.when(F.col(j_cuts).isNotNull(), F.col(text_col))
    rows = rows.withColumn(j_masked, _masked(mark)(found, j_cuts))
    return rows.select(*[F.when(F.col(j_cuts).isNotNull(), F.col(j_masked)).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
