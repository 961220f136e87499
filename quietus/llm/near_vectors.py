"""Embedding near-duplicates by int8 quantised tile products.

Distinct vectors are dealt into blocks of bounded size; each pair of blocks is one group, to which only codes are sent: int8 components, scale, and the lengths
of what the code says and of its error (x = q/s + e with |e| known). A product of codes is off by at most |x'||e_y| + |e_x||y'| + |e_x||e_y|, so it proves most pairs to be linked or not.
The vectors of the pairs in between, and no others, are sent to a second group, which computes those pairs again in double precision: no link is lost, none is made up.
A group yields, for each vector, its number of links and one edge of a spanning forest, never the pairs. Equal vectors are one vertex with a weight.

A cosine in double precision is the sum of the products of unit components, in one order of summation wherever the pair is met.

All pairs of distinct vectors are looked at, in blocks, since no bound on cosines rules out blocks of spread vectors: work grows with the
square of their number, at some 10^10 code products a second and core.

Edge cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing and stand alone; vectors of different
lengths never link; repeated rows count as other vectors of their own; null ids link like others; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.graph.components import weak_components
from quietus.llm.vectors import packed, rows_of, unit
from quietus.session import cut

#: Vectors of a block at most and at least (fewer blocks send less, more of them keep more cores busy), and of a tile within a pair of blocks.
BLOCK, SMALL, TILE = 16_384, 4096, 1024
#: Above the rounding of bounds and of products in double precision.
SLACK = 1e-5
#: Components of a block at most, where vectors are long.
COMPONENTS = 1 << 23
#: Pairs settled at once, which bounds memory.
PIECE = 1 << 16
FOUND = "node long, links long, label long, i int, j int, doubted boolean"


class Codes:
    """int8 codes of unit rows: ``q``, scale ``s``, ``length`` of what the code says and of its ``error``."""

    def __init__(self, q: np.ndarray, s: np.ndarray, length: np.ndarray, error: np.ndarray):
        self.s, self.length, self.error = s, length, error
        # Held as floats: sums of products of codes stay below 2^24 up to this length, so single precision holds them exactly.
        self.q = q.astype(np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64)

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        s = 127 / np.abs(x).max(axis=1)
        q = np.rint(x * s[:, None]).astype(np.int8)
        said = q / s[:, None]
        return cls(q, s, np.sqrt((said**2).sum(axis=1)), np.sqrt(((x - said) ** 2).sum(axis=1)))


def encoded(distinct: DataFrame) -> DataFrame:
    """(node, dim, n, code, s, length, error) of (node, dim, n, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                c = Codes.of(unit(rows_of(part.column(3).to_pylist(), int(dim))))
                code = [row.tobytes() for row in c.q.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(code, pa.binary()), pa.array(c.s), pa.array(c.length), pa.array(c.error)], names=["node", "dim", "n", "code", "s", "length", "error"])

    return distinct.select("node", "dim", "n", "vec").mapInArrow(run, "node long, dim int, n long, code binary, s double, length double, error double")


def decoded(pdf: pd.DataFrame, dim: int) -> Codes:
    return Codes(np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(-1, dim), *(pdf[c].to_numpy() for c in ("s", "length", "error")))


def bounds(a: Codes, b: Codes, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """(products, what they may be off by) of a tile, by each vector's own error."""
    product = (a.q[i] @ b.q[j].T) / (a.s[i][:, None] * b.s[j][None, :])
    # Element by element, not as a product of matrices: a pair's bound must not depend on the tile it is met in.
    return product, a.length[i][:, None] * b.error[j][None, :] + a.error[i][:, None] * (b.length[j] + b.error[j])[None, :] + SLACK


def reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of unit rows, pair by pair, reach ``threshold``: the one sum that decides."""
    return (x * y).sum(axis=1) >= threshold


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component under the edges a - b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def _dense_forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column or row) that join what the links of a tile join; columns are numbered after rows."""
    rows, cols = linked.shape
    label, far = np.arange(rows + cols), rows + cols
    while True:
        before = label.copy()
        label[:rows] = np.minimum(label[:rows], np.where(linked, label[None, rows:], far).min(axis=1))
        label[rows:] = np.minimum(label[rows:], np.where(linked, label[:rows, None], far).min(axis=0))
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(far))
            return moved, label[moved]


def compare(a: Codes, b: Codes, wa: np.ndarray, wb: np.ndarray, same: bool, threshold: float, vectors: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (weights of linked rows), component label and doubt of every row of a, then of b. ``same``: b is a, and a row is not compared with itself.

    Without ``vectors`` the links that codes prove, and the rows of pairs that they leave in doubt; with the unit ``vectors`` of both sides the links among the pairs in doubt.
    """
    n, m = len(a.q), len(b.q)
    links, doubted, edges = np.zeros(n + m, np.int64), np.zeros(n + m, bool), []
    for i in range(0, n, TILE):
        for j in range(i if same else 0, m, TILE):
            at, to = slice(i, min(i + TILE, n)), slice(j, min(j + TILE, m))
            product, off = bounds(a, b, at, to)
            sure, open_ = product - off >= threshold, np.abs(product - threshold) < off
            if same and i == j:
                sure, open_ = np.triu(sure, 1), np.triu(open_, 1)
            if vectors is None:
                doubted[at] |= open_.any(axis=1)
                doubted[n + j : n + to.stop] |= open_.any(axis=0)
                near = sure
            else:
                near, (r, c) = np.zeros_like(open_), np.nonzero(open_)
                for k in range(0, len(r), PIECE):
                    rows, cols = r[k : k + PIECE], c[k : k + PIECE]
                    near[rows, cols] = reaches(vectors[0][at][rows], vectors[1][to][cols], threshold)
            if not near.any():
                continue
            r, c = _dense_forest(near)
            r, c = (np.where(k < near.shape[0], k + i, k - near.shape[0] + n + j) for k in (r, c))
            links[at] += near @ wb[to]
            links[n + j : n + to.stop] += near.T @ wa[at]
            edges.append((r, c))
    r, c = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
    if same:  # the second copy of a row is the row
        r, c = (np.where(k >= n, k - n, k) for k in (r, c))
        links[:n] += links[n:]
        doubted[:n] |= doubted[n:]
        links[n:], doubted[n:] = 0, False
    return links, settle(n + m, r, c), doubted


def _group(threshold: float, whole: bool):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, dim = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["dim"].iloc[0])
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        a = b = decoded(left, dim)
        x = y = unit(rows_of(left["vec"], dim)) if whole and len(left) else None
        if i != j:
            b = decoded(right, dim)
            y = unit(rows_of(right["vec"], dim)) if whole and len(right) else None
        nodes = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        links, label, doubted = compare(a, b, left["n"].to_numpy(), right["n"].to_numpy(), i == j, threshold, (x, y) if whole else None)
        out = pd.DataFrame({"node": nodes, "links": links, "label": nodes[label] if len(nodes) else nodes, "i": i, "j": j, "doubted": doubted}).astype({"i": "int32", "j": "int32"})
        return out[(out["links"] > 0) | out["doubted"]]

    return group


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = cut(packed(table, id_col, vector_col))
    distinct = cut(rows.groupBy("dim", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    size, longest = distinct.agg(F.count("*"), F.max("dim")).first()
    block = max(64, min(block, COMPONENTS // (longest or 1))) if block > 64 else block
    blocks = max(1, -(-size // block), min(4, -(-size // small)))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    codes = cut(encoded(distinct).withColumn("block", own))
    dealt = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    sure = cut(dealt.groupBy("dim", "i", "j").applyInPandas(_group(threshold, False), FOUND))
    asked = sure.where("doubted").select("node", "i", "j").join(codes, "node").join(distinct.select("node", "vec"), "node")
    settled = cut(asked.groupBy("dim", "i", "j").applyInPandas(_group(threshold, True), FOUND))
    found = sure.unionByName(settled).where("links > 0")
    roots = weak_components(found.select(F.col("node").alias("src"), F.col("label").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = distinct.join(roots, "node", "left").join(links, "node", "left").select("dim", "vec", "least", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(named, "root").select("dim", "vec", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links")))
    linked = rows.join(classes, ["dim", "vec"]).select("vec_id", "n_links", "component_id")
    # Rows that take no part are those the packing left out; they are told apart as it does, in SQL.
    v = F.col(vector_col)
    sound = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    alone = table.where(~sound).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
