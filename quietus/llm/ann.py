"""Nearest neighbours from randomly rotated one-bit codes.

A candidate's unit vector, padded to whole 64-bit words and turned by a fixed random rotation, is kept as its signs and two scalars: ``ip``, the inner product of
the vector with the direction its signs stand for, and the spread that follows from it. A query is turned likewise and quantised to 8-bit levels, whose
bit planes meet the packed signs by AND and popcount. That estimates the inner product as <signs, query>/ip, off by at most
epsilon * sqrt(1-ip^2)/(ip * sqrt(d-1)) up to the concentration of a random direction (epsilon standard deviations), plus the exact bound of the query's levels.
Candidates whose upper bound reaches the query's k-th best exact score so far are computed again on the original vectors.

Queries and candidates meet in groups of bounded size, a block of queries by a block of candidates; a group yields k rows a query.

Edge cases: null, empty and zero vectors, and those with null or non-finite components, take no part; vectors of different lengths do not meet; every row but the query's own is a candidate,
so rows that repeat an id count each, and a query id that repeats is a query each; rows with a null id take no part; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietus.llm.vectors import packed, rows_of, unit
from quietus.session import cut

#: Candidates and queries of a group; candidates whose exact scores set a query's first bar; standard deviations that the error bound allows.
CANDIDATES, QUERIES, FIRST, EPSILON = 8192, 8192, 16, 3.5
LEVELS = 255


def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, width]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 64)))


class BitIndex:
    """One-bit codes of unit rows with their correction scalars."""

    def __init__(self, x: np.ndarray, epsilon: float = EPSILON):
        x = padded(x)
        self.width = x.shape[1]
        self.turn = rotation(self.width)
        turned = x @ self.turn
        self.bits = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        ip = np.abs(turned).sum(axis=1) / np.sqrt(self.width)
        self.scale = 1 / ip
        self.spread = epsilon * np.sqrt(np.maximum(0, 1 - ip * ip)) / (ip * np.sqrt(max(1, self.width - 1)))

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, error bounds) of the inner products of unit ``queries`` with every row."""
        turned = padded(queries) @ self.turn
        low, step = turned.min(axis=1), np.maximum(np.ptp(turned, axis=1), 1e-12) / LEVELS
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        hits = np.zeros((len(queries), len(self.bits)))
        for plane in range(8):
            words = np.packbits(levels >> plane & 1, axis=1, bitorder="little").view("<u8")
            count = np.zeros(hits.shape, np.int32)
            for w in range(words.shape[1]):
                count += np.bitwise_count(words[:, w, None] & self.bits[None, :, w])
            hits += count * float(1 << plane)
        said = 2 * low[:, None] * self.ones + 2 * step[:, None] * hits - (self.width * low + step * levels.sum(axis=1, dtype=np.int64))[:, None]
        root = np.sqrt(self.width)
        return said / root * self.scale, self.spread + (step / 2 * root)[:, None] * self.scale


def nearest(raw: np.ndarray, ids: np.ndarray, nodes: np.ndarray, queries: np.ndarray, query_nodes: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(query's node, candidate's node, its id, cosine) of each query's k best here."""
    order = np.lexsort((nodes, ids))
    raw, ids, nodes = raw[order], ids[order], nodes[order]
    # Equal vectors share a code; of their rows, by rising id, at most k+1 can matter.
    _, first, group = np.unique(np.ascontiguousarray(raw).view([("", "V", raw.shape[1] * 8)]).ravel(), return_index=True, return_inverse=True)
    x = unit(raw[first])
    members: list[list[tuple[int, int]]] = [[] for _ in first]
    for g, vec_id, node in zip(group.tolist(), ids.tolist(), nodes.tolist(), strict=True):
        if len(members[g]) <= k:
            members[g].append((vec_id, node))
    least = np.array([m[0][0] for m in members])
    index, q, out = BitIndex(x), unit(queries), []
    for at in range(0, len(q), 64):
        about, off = index.estimate(q[at : at + 64])
        for row in range(len(about)):
            own, query = q[at + row], int(query_nodes[at + row])
            bar_rows = np.argpartition(-about[row], min(FIRST + k, len(x)) - 1)[: FIRST + k]
            bar = (x[bar_rows] * own).sum(axis=1)
            # One of the rows may be the query's own; the k-th best without it is at least the (k+1)-th best.
            bar = np.sort(bar)[-(k + 1)] if len(bar) > k else -2.0
            chosen = np.flatnonzero(about[row] + off[row] >= bar - 1e-12)
            score = (x[chosen] * own).sum(axis=1)
            best = np.lexsort((least[chosen], -score))[: k + 1]
            found = sorted((-float(score[b]), vec_id, node) for b in best for vec_id, node in members[chosen[b]] if node != query)
            out += [(query, node, vec_id, -s) for s, vec_id, node in found[:k]]
    return out


def search(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row whose id is divisible by ``every``, among all other rows."""
    rows = cut(packed(table, id_col, vector_col).where("vec_id is not null").withColumn("node", F.monotonically_increasing_id()))
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    cb, qb = max(1, -(-n // candidates)), max(1, -(-m // queries))
    spread = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    of = lambda b: F.pmod(F.xxhash64("node"), F.lit(b)).cast("int")
    sides = rows.select("node", "vec_id", "dim", "vec", F.lit(False).alias("asks"), spread(qb).alias("q"), of(cb).alias("c"))
    sides = sides.unionByName(asked.select("node", "vec_id", "dim", "vec", F.lit(True).alias("asks"), of(qb).alias("q"), spread(cb).alias("c")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, asks = int(pdf["dim"].iloc[0]), pdf["asks"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            here, there = pdf[~asks], pdf[asks]
            found = nearest(rows_of(here["vec"], dim), here["vec_id"].to_numpy(), here["node"].to_numpy(), rows_of(there["vec"], dim), there["node"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query", "node", "vec_id", "score"]).astype({"query": "int64", "node": "int64", "vec_id": "int64", "score": "float64"})

    best = sides.groupBy("dim", "q", "c").applyInPandas(group, "query long, node long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
