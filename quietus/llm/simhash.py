"""SimHash near-duplicates linked through anchor points of a covering code.

A fingerprint has 64 bits in two halves. Fingerprints that differ in at most 3 bits differ in at most 1 bit of some half.
A half is covered by the code (Hamming[31,26] x one free bit), of covering radius 1: every half lies within 1 bit of
exactly one code word, its home anchor. So each fingerprint is placed at every anchor within radius + threshold = 2 bits of each half
(at most 17), and at an anchor those at home there are compared with all placed there. Every link is met that way.

An anchor with many rows is dealt out in chunks: its home chunks meet all its chunks in separate groups of bounded size. A group
yields a spanning forest of its links, never its pairs. Equal fingerprints are one vertex, whatever the number of copies.

Edge cases: a null text counts as an empty one; texts without words have fingerprint zero and link like others; a text of one or two words
has one shingle, the whole sequence; repeated rows all stay; an id that is null gets a component all the same (the smallest id that is not null
of its component, or null); an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.graph.components import contracted, weak_components
from quietus.llm import resemblance
from quietus.llm.names import fresh
from quietus.session import TEXTS, cut, if_small

THRESHOLD = 3
#: Rows of an anchor that one group compares: beyond it the anchor is dealt out in chunks of this size.
CHUNK = 2048
#: Positions 0..30 of a half have the columns 1..31 of the Hamming check matrix; position 31 is free.
CHECKS = [sum(1 << p for p in range(31) if (p + 1) >> b & 1) for b in range(5)]


def simhash(text: bytes | None, seed: int = 42, width: int = 3) -> int:
    """The 64-bit fingerprint of the ``width``-word shingles of ``text`` (UTF-8), as a signed integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and blanks are x20, x09-x0D
    if not words:
        return 0
    line = b" ".join(words)
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= width:
        hashes = np.array([digest(line, seed)], np.uint64)
    else:
        hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp) of every row; digest tells texts under a repeated id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(text.as_py()) for text in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "digest", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest long, fp long")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")


def _flips() -> np.ndarray:
    """By syndrome: the flips of a half that lead to each anchor within 2 bits, the home anchor first; -1 fills the rows."""
    free, out = 1 << 31, np.full((32, 17), -1, np.int64)
    out[0, :2] = 0, free
    for s in range(1, 32):
        home = 1 << (s - 1)
        out[s] = [home, home | free, *((1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s)]
    return out


def placements(distinct: DataFrame) -> DataFrame:
    """(fp, rep) -> a row (anchor, home, fp, rep) for each anchor within reach."""
    flips, names = _flips(), ["anchor", "home", "fp", "rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k in (0, 1):
                half = (fp.view(np.uint64) >> np.uint64(32 * k) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                syndrome = sum((np.bitwise_count(half & mask) % 2).astype(np.int64) << b for b, mask in enumerate(CHECKS))
                flip = flips[syndrome]
                row, place = np.nonzero(flip >= 0)
                anchor = (half[row] ^ flip[row, place]) + (k << 32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, place == 0, fp[row], rep[row])], names=names)

    return distinct.select("fp", "rep").mapInArrow(run, "anchor long, home boolean, fp long, rep long")


def _forest(a: np.ndarray, b: np.ndarray, threshold: int, block: int = 512) -> list[tuple[int, int]]:
    """Edges that join what the links between ``a`` and ``b`` (fingerprints) join; ends are positions in a, then in b."""
    n = len(a)
    label = np.arange(n + len(b))
    while True:
        before = label.copy()
        for at in range(0, n, block):
            near = np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= threshold
            mine, theirs = label[at : min(at + block, n)], label[n:]
            mine[:] = np.minimum(mine, np.where(near, theirs[None, :], n + len(b)).min(axis=1))
            theirs[:] = np.minimum(theirs, np.where(near, mine[:, None], n + len(b)).min(axis=0))
        label = label[label]
        if (label == before).all():
            break
    return [(x, int(y)) for x, y in enumerate(label) if x != y]


def _compare(threshold: int):
    def edges_of(fp: np.ndarray, rep: np.ndarray, home: np.ndarray, other: np.ndarray) -> set[tuple[int, int]]:
        a, b = np.flatnonzero(home), np.flatnonzero(other)
        if not len(a) or not len(b):
            return set()
        reps = np.concatenate([rep[a], rep[b]])
        return {(int(reps[x]), int(reps[y])) for x, y in _forest(fp[a], fp[b], threshold) if reps[x] != reps[y]}

    def flush(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
        key, fp, rep = pdf["anchor"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        home, other = pdf["as_home"].to_numpy(), pdf["as_other"].to_numpy()
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(pdf["home_chunk"].to_numpy()) != 0) | (np.diff(pdf["other_chunk"].to_numpy()) != 0)) + 1
        bounds = np.concatenate([[0], new, [len(key)]])
        sizes = np.diff(bounds)
        for at in np.flatnonzero(sizes > 1):
            s = slice(bounds[at], bounds[at + 1])
            if home[s].any():
                yield from edges_of(fp[s], rep[s], home[s], other[s])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group = None, ["anchor", "home_chunk", "other_chunk"]
        for pdf in frames:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[group] == pdf[group].iloc[-1]).all(axis=1).to_numpy()
            held = pdf[last]
            found = set(flush(pdf[~last]))
            if found:
                yield pd.DataFrame(sorted(found), columns=["src", "dst"])
        if held is not None and (found := set(flush(held))):
            yield pd.DataFrame(sorted(found), columns=["src", "dst"])

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) over ``rep`` of ``distinct`` (fp, rep): edges that join exactly what links of at most ``threshold`` bits join."""
    if threshold != THRESHOLD:
        raise ValueError("the anchors are laid out for 3 bits")
    placed = placements(distinct)
    # Anchors with no row at home, or with one row, compare nothing; the others learn how many chunks they are dealt in.
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("used")).where("n > 1 and used").select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    placed = placed.join(sizes, "anchor")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # A row at home stands in its own home chunk beside every other chunk; any row stands in its own chunk beside every home chunk.
    place = lambda home_chunk, other_chunk, as_home, as_other: F.struct(home_chunk.alias("home_chunk"), other_chunk.alias("other_chunk"), as_home.alias("as_home"), as_other.alias("as_other"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    one = F.array(place(zero, zero, F.col("home"), yes))
    others = F.transform(every, lambda x: place(x, mine, no, yes))
    homes = F.when(F.col("home"), F.transform(every, lambda x: place(mine, x, yes, no))).otherwise(F.array().cast("array<struct<home_chunk:int,other_chunk:int,as_home:boolean,as_other:boolean>>"))
    groups = placed.select("anchor", "fp", "rep", F.explode(F.when(F.col("chunks") == 1, one).otherwise(F.concat(homes, others))).alias("g")).select("anchor", "g.home_chunk", "g.other_chunk", "fp", "rep", "g.as_home", "g.as_other")
    keys = ["anchor", "home_chunk", "other_chunk"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_compare(threshold), "src long, dst long").distinct()


def _classes(prints: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, component_id, keeper) of every fingerprint; keeper is the (doc_id, digest) of the component's smallest row, null ids last.

    Given ``docs``, texts of similar shingles (``resemblance``) are linked as well.
    """
    # A vertex is a distinct fingerprint, named by its value, so that null or repeated ids do not matter to the links.
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest")).alias("least")))
    edges = links(distinct.select("fp", F.col("fp").alias("rep")))
    if docs is not None:
        edges = cut(edges)
        known = contracted(edges).withColumnRenamed("node", "fp")
        roots = cut(prints.select("digest", "fp").distinct().join(known, "fp", "left").select("digest", F.coalesce("label", "fp").alias("root")))
        edges = edges.unionByName(resemblance.links(_texts(docs, prints, id_col, text_col), prints.count(), roots))
    roots = weak_components(edges)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("keeper"))
    return cut(rooted.join(named, "root").select("fp", F.col("keeper.doc_id").alias("component_id"), "keeper"))


def _texts(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, text) of the distinct texts; only rows that are equal in id and text may repeat."""
    least = prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(prints.join(least, "digest").where(~F.col("doc_id").eqNullSafe(F.col("least"))).select(F.coalesce("doc_id", F.lit(0)).alias("q_id"), F.col("doc_id").isNull().alias("q_absent"), F.col("digest").alias("q_digest")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col), F.col(text_col).cast("binary").alias("text"))
    return rows.join(if_small(copies), (F.coalesce("doc_id", F.lit(0)) == F.col("q_id")) & (F.col("doc_id").isNull() == F.col("q_absent")) & (F.col("digest") == F.col("q_digest")), "left_anti").select("digest", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col), TEXTS)
    return prints.join(_classes(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that a smaller row of their component stands for. Of equal rows one stays.

    Beside fingerprints within the threshold, texts of similar shingles are linked: near copies lie up to ten bits and more apart.
    """
    prints = cut(fingerprints(docs, id_col, text_col), TEXTS)
    rows = prints.join(_classes(prints, docs, id_col, text_col).select("fp", "keeper"), "fp").groupBy("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("digest") == F.col("keeper.digest"))).agg(F.count("*").alias("n"))
    q_id, q_digest, q_kept, q_n, q_text = fresh(docs, "q_id", "q_digest", "q_kept", "q_n", "q_text")
    rows = cut(rows.toDF(q_id, q_digest, q_kept, q_n).where(~F.col(q_kept) | (F.col(q_n) > 1)))
    keyed = docs.withColumn(q_text, _digest(text_col))
    match = keyed[id_col].cast("long").eqNullSafe(F.col(q_id)) & (F.col(q_text) == F.col(q_digest))
    rest = keyed.join(if_small(rows), match, "left_anti").drop(q_text)
    repeated = rows.where(F.col(q_kept))
    if repeated.isEmpty():
        return rest
    return rest.unionByName(keyed.join(repeated, match, "left_semi").dropDuplicates([id_col, q_text]).drop(q_text))
