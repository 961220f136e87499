"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: what such pairs join, found by prefixes and settled exactly.

All shingles have one order. Sets of similarity 0.8 or more share at least four fifths of either, so the first shingle they share lies among the first
``n - ceil(0.8 n) + 1`` of both: texts that meet at no shingle of their prefixes are no pair, and no pair is lost. A meeting is a candidate only if the sizes, what
is left of both sets behind the shingle, and the parities of 1024 bins of both sets still admit the similarity; candidates are settled on both whole texts.

Pairs are not emitted for whole groups of near copies. First every text meets two others at each shingle of its prefix (the first of about its size, and the next smaller one):
a number of candidates in proportion to the texts. What these join is one class. Then each text is held against those that stand near it at a shingle, in an order drawn anew
for every shingle, and the closest two of any two classes are settled. Only then all texts of classes that are still different are candidates at the shingles they share.

The order puts shingles that a sample of texts often holds last, so that lines many texts share are seldom in a prefix. The sample decides the work, never the result.

Edge cases: words are those of ``simhash``; a text of fewer than five words has one shingle, the whole sequence; a text without words is similar to none; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietus.graph.components import contracted
from quietus.session import TEXTS, cut, if_small, kept

WIDTH = 5
#: Texts that the order of shingles is learned from, and shingles that it puts last.
SAMPLED, FREQUENT = 16_384, 100_000
PARITIES = [f"p{k}" for k in range(16)]
#: Bits that choose a sketch's bin, at most: 2 KB a sketch.
MOST_BITS = 14
#: Pairs of whole texts that are settled at once.
PAIRS = 250
#: Rows on either side that a text is held against at a shingle, while classes are joined by their closest texts.
NEAR = 128
#: Words hashed at once, which bounds a task's memory.
PIECE = 1 << 14
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the ``width``-word shingles of ``text`` (UTF-8), in rising order."""
    words = (text or b"").lower().split()
    found = []
    for at in range(0, max(1, len(words) - width + 1) if words else 0, PIECE):
        raw = np.frombuffer(b" ".join(words[at : at + PIECE + width - 1]), np.uint8)
        blanks = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
        starts, ends = (starts[:1], ends[-1:]) if len(starts) <= width else (starts[: 1 - width], ends[width - 1 :])
        power, inverse = _powers(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[: len(raw)])])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(h ^ (h >> np.uint64(31)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, in rising order, have a Jaccard similarity of 0.8 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 9 * shared >= 4 * (len(a) + len(b))


def _frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles that at least three sampled texts hold, the rarer first; FREQUENT rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("digest"), F.lit(max(1, n // SAMPLED))) == 0).select("text")
    seen = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    return seen["h"].to_numpy(np.int64)[::-1].view(np.uint64)


def parities(h: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 1024 bins, as 16 longs: sets that differ in d shingles differ in at most d parities."""
    odd = (np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def sketch(h: np.ndarray) -> bytes:
    """Parities of the shingles in two to four times as many bins as there are shingles, within bounds: they tell more pairs apart than a fixed number does."""
    bits = int(min(MOST_BITS, max(10, np.ceil(np.log2(2 * len(h))))))
    odd = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many parities two sketches differ, at most in how many shingles the sets do; bins of the finer one are joined by twos."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[::2] ^ x[1::2]
        else:
            y = y[::2] ^ y[1::2]
    return int(np.count_nonzero(x != y))


def _profiles(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(digest, size, prefix, sketch, p0 .. p15) of every text that has words."""
    order = np.argsort(frequent)
    ordered = frequent[order]
    names = ["digest", "size", "prefix", "sketch", *PARITIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, found, odd, wide = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                h = shingles(text.as_py())
                n = len(h)
                if not n:
                    continue
                odd.append(parities(h))
                wide.append(sketch(h))
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    rank = np.where(ordered[at] == h, order[at] + 1, 0)
                    h = h[np.argsort(rank, kind="stable")]
                rows.append(k)
                sizes.append(n)
                found.append(h[: n - (4 * n + 4) // 5 + 1].view(np.int64))
            if rows:
                held = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(held), pa.array(np.concatenate(found)))
                odd = np.stack(odd)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes, pa.int32()), prefix, pa.array(wide, pa.binary()), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(len(PARITIES)))], names=names)

    return texts.select("digest", "text").mapInArrow(run, "digest long, size int, prefix array<long>, sketch binary, " + ", ".join(f"{p} long" for p in PARITIES))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, size, digest), those whose shingle another row has too, with the first row of about its size and the row before.

    Only the last row of a batch is carried to the next one, whatever the number of rows of a shingle.
    """
    names = ["h", "digest", "size", "place", "first", "before"]
    carried, first_seen = None, None

    def step(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried, first_seen
        if carried is not None:
            cols = [np.concatenate([c, x]) for c, x in zip(carried, cols, strict=True)]
        n = len(cols[0])
        if not n:
            return
        h, digest, size, place, met = cols
        klass = np.floor(np.log(size) / np.log(1.25)).astype(np.int64)
        same = np.concatenate([[False], h[1:] == h[:-1]])
        new = ~(same & np.concatenate([[False], klass[1:] == klass[:-1]]))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first, before = digest[start], np.concatenate([digest[:1], digest[:-1]])
        if first_seen is not None and carried is not None:  # the carried row's class began in an earlier batch
            first[start == 0] = first_seen
        out = slice(0, n if last else n - 1)  # whether the last row's shingle is met again is not known yet
        met = met.astype(bool) | same
        shared = (met | np.concatenate([same[1:], [False]]))[out]
        if shared.any():
            none = np.zeros(int(shared.sum()), bool)
            apart = lambda x, off: pa.array(x[out][shared], pa.int64(), mask=none | off)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[out][shared]), pa.array(digest[out][shared]), pa.array(size[out][shared], pa.int32()), pa.array(place[out][shared], pa.int32()), apart(first, first[out][shared] == digest[out][shared]), apart(before, ~same[out][shared])], names=names
            )
        carried = [h[-1:], digest[-1:], size[-1:], place[-1:], met[-1:].astype(np.int8)]
        first_seen = first[-1]

    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            yield from step([*cols, np.zeros(batch.num_rows, np.int8)], False)
    if carried is not None:
        yield from step([np.zeros(0, c.dtype) for c in carried], True)


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, each with the closest of the NEAR rows on either side that has its shingle and another class, if the two may be similar.

    Only the last NEAR rows of a batch are carried to the next one, whatever the number of rows of a shingle; they are returned with the closest of either batch.
    """
    carried = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        old = 0 if carried is None else len(carried[0])
        if old:
            cols = [np.concatenate([c, x]) for c, x in zip(carried, cols, strict=True)]
        carried = [c[-NEAR:] for c in cols]
        h, digest, root = cols[:3]
        size, place = (c.astype(np.int64) for c in cols[3:5])
        odd = np.stack(cols[5:], axis=1)
        least, partner = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), -1)
        for back in range(1, NEAR + 1):
            y = np.arange(max(old, back), len(h))
            y = y[h[y] == h[y - back]]
            if not len(y):
                break
            x = y - back
            both, left = size[x] + size[y], np.minimum(size[x] - place[x], size[y] - place[y])
            may = (root[x] != root[y]) & (5 * np.minimum(size[x], size[y]) >= 4 * np.maximum(size[x], size[y])) & (9 * left >= 4 * both)
            x, y, both = x[may], y[may], both[may]
            differ = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)
            may = 9 * differ <= both
            for one, other in ((x[may], y[may]), (y[may], x[may])):
                better = differ[may] < least[one]
                least[one[better]], partner[one[better]] = differ[may][better], other[better]
        x = np.flatnonzero(partner >= 0)
        y = partner[x]
        a, b = np.where(root[x] < root[y], x, y), np.where(root[x] < root[y], y, x)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (digest[a], digest[b], root[a], root[b], least[x])], names=["digest_a", "digest_b", "root_a", "root_b", "differ"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[int, np.ndarray] = {}
        keep = []
        for (one, other), a, b in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(4), batch.column(5), strict=True):
            if len(held) > 256:
                held.clear()
            for name, text in ((one, a), (other, b)):
                if name not in held:
                    held[name] = shingles(text.as_py())
            keep.append(similar(held[one], held[other]))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (2, 3)], names=["src", "dst"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(4).to_numpy(zero_copy_only=False)
        keep = [9 * apart(a, b) <= n for a, b, n in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(4)], names=["digest_a", "digest_b", "root_a", "root_b"])


def _settled(texts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): the roots of those ``pairs`` (digest_a, digest_b, root_a, root_b) whose whole texts are similar; most others fall by their sketches first."""
    ends = ["digest_a", "digest_b", "root_a", "root_b"]
    of = lambda s: profiles.select(F.col("digest").alias(f"digest_{s}"), F.col("size").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    sketched = pairs.select(*ends).join(of("a"), "digest_a").join(of("b"), "digest_b").select(*ends, (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b")
    pairs = cut(sketched.mapInArrow(_likely, "digest_a long, digest_b long, root_a long, root_b long"))
    needed = cut(pairs.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")).distinct())
    held = texts.join(if_small(needed), "digest", "left_semi").select("digest", "text").repartition("digest").dropDuplicates(["digest"])
    whole = pairs.join(held.toDF("digest_a", "text_a").hint("merge"), "digest_a").join(held.toDF("digest_b", "text_b").hint("merge"), "digest_b")
    return cut(whole.select(*ends, "text_a", "text_b").mapInArrow(_settle, "src long, dst long").distinct(), PAIRS)


def _sizes(a: str, b: str) -> Column:
    """Whether the sizes of two sets admit the similarity."""
    return 5 * F.least(f"size_{a}", f"size_{b}") >= 4 * F.greatest(f"size_{a}", f"size_{b}")


def _admitted(a: str, b: str) -> Column:
    """Whether sizes and parities of two sets admit the similarity; sizes come before parities, so most rows need the first alone."""
    sizes = F.col(f"size_{a}") + F.col(f"size_{b}")
    apart = sum((F.bit_count(F.col(f"{p}_{a}").bitwiseXOR(F.col(f"{p}_{b}"))) for p in PARITIES), F.lit(0))
    return _sizes(a, b) & (9 * apart <= sizes)


def _unsettled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (h, digest, size, place) at shingles where several classes meet, with what is ``known`` of their texts; ``main`` is a shingle's most frequent class."""
    rows = rows.join(known.select("digest", "root"), "digest")
    main = rows.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("classes")).where("classes > 1").select("h", "main")
    return kept(rows.join(main, "h").join(known.drop("root"), "digest"), "rest")


def _renamed(known: DataFrame, labels: DataFrame) -> DataFrame:
    """``known`` with the roots that ``labels`` (root, label) gives."""
    return cut(known.join(labels, "root", "left").select("digest", F.coalesce("label", "root").alias("root"), *PARITIES))


def links(texts: DataFrame, n: int, roots: DataFrame) -> DataFrame:
    """(src, dst) over ``root``: links that join what similar texts of different roots join.

    ``texts``: digest, text, one row for each text (equal rows may repeat); ``n`` of them, about. ``roots``: digest, root; texts of one root are known to hang together.
    """
    profiles = kept(_profiles(texts, _frequent(texts, n)), "profiles", TEXTS)
    rows = profiles.select(F.posexplode("prefix").alias("place", "h"), "digest", "size").select("h", "digest", "size", "place")
    met = kept(rows.repartition("h").sortWithinPartitions("h", "size", "digest").mapInArrow(_meetings, "h long, digest long, size int, place int, first long, before long"), "meetings")
    known = cut(profiles.select("digest", "size", *PARITIES).join(roots, "digest"))
    side = lambda s: known.select(*[F.col(c).alias(f"{c}_{s}") for c in ("digest", "root", "size")])
    few = met.select(F.explode(F.array("first", "before")).alias("x"), F.col("digest").alias("y")).where("x is not null and x <> y").select(F.least("x", "y").alias("digest_a"), F.greatest("x", "y").alias("digest_b")).distinct()
    few = few.join(side("a"), "digest_a").join(side("b"), "digest_b").where((F.col("root_a") != F.col("root_b")) & _sizes("a", "b"))
    first = _settled(texts, profiles, few)
    # What is left: pairs of texts that are not known to hang together yet. A class that another is close to at many texts needs one of these pairs, not all.
    known = _renamed(known, contracted(first).withColumnRenamed("node", "root"))
    rows = _unsettled(met.select("h", "digest", "size", "place"), known)
    # Two late places leave too little of either set. Early ones stand together; of these, texts within a quarter of each other's size are neighbours by chance, at each shingle others.
    late = 9 * F.col("place") > F.col("size")
    order = F.log("size") / F.log(F.lit(1.25)) + F.pmod(F.xxhash64("h", "digest"), F.lit(1 << 20)) / (1 << 20)
    near = rows.select("h", "digest", "root", "size", "place", *PARITIES).repartition("h").sortWithinPartitions("h", late, order).mapInArrow(_closest, "digest_a long, digest_b long, root_a long, root_b long, differ long")
    near = near.groupBy("root_a", "root_b").agg(F.min(F.struct("differ", "digest_a", "digest_b")).alias("pair")).select("pair.digest_a", "pair.digest_b", "root_a", "root_b")
    second = _settled(texts, profiles, near)
    known = _renamed(known, contracted(second).withColumnRenamed("node", "root"))
    # A shingle's rows of its most frequent class need no comparison with each other, so only the others meet all.
    rows = _unsettled(rows.select("h", "digest", "size", "place"), known)
    columns = ("digest", "root", "size", "place", *PARITIES)
    a = rows.where("root <> main").select("h", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select("h", "main", *[F.col(c).alias(f"{c}_b") for c in columns])
    left = 1 + F.least(F.col("size_a") - F.col("place_a") - 1, F.col("size_b") - F.col("place_b") - 1)
    behind = 9 * left >= 4 * (F.col("size_a") + F.col("size_b"))
    once = (F.col("root_b") == F.col("main")) | (F.col("digest_a") < F.col("digest_b"))
    rest = a.join(b.hint("merge"), (a["h"] == b["h"]) & (F.col("root_a") != F.col("root_b")) & once & behind & _admitted("a", "b"))
    return first.unionByName(second).unionByName(_settled(texts, profiles, rest.select("digest_a", "digest_b", "root_a", "root_b").distinct()))
