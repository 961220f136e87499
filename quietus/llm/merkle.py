"""Merkle manifest of a dataset: a digest for each row, a tree for each source, a tree over the sources, and a proof for each row.

Rows are dealt out in ranges of (source, id), so a task holds runs of neighbouring leaves. Each task combines by key as events come in: a child's digest goes to its parent, which is
partial until it holds as many children as the group's size says it must have; then the parent's digest is at once an event for its own parent. What is left at the end of a task
are the partial parents at its edges. These frontiers are shuffled again, by spans of leaves that grow with each round, until none is left. Every finished parent keeps the
digests of its run; read downwards, these reverse links give each leaf its siblings on all levels, and so its proof. No task holds more than its own rows and 16 children for each open parent; a hot source
is dealt to as many tasks as any other rows.

Edge cases: null values are written as ``-``; a null source is a source of its own, before all others; a null id is smaller than any other and is not tampered with; rows of equal source and id are
ordered by their leaves, and equal rows are all returned; a source of one row is its own subroot; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietus.llm.checksums import CRC_TABLE, crc32
from quietus.session import if_small, kept

#: Children of a parent.
ARITY = 16
#: Spans of leaves whose frontiers meet in the first round, as a power of the arity, and by how much that grows with each round.
FIRST_SPAN, SPAN_STEP = 5, 2
#: Letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHILD = "struct<at:int,digest:string,key:string,other:string>"
RUN = f"g string, n long, height int, idx long, digest string, last boolean, children array<{CHILD}>"


def leaf(*values: Column) -> Column:
    """Digest of a row's values, each as its length in UTF-8 bytes and itself, or as ``-`` if it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with idx, the place from 0 within column ``g``, and n, the rows of ``g``: by running counts of sorted ranges, so no group is sorted in one task.

    Only a row for each range and group in it is joined back.
    """
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = kept(placed.withColumns({"r_part": F.spark_partition_id(), "r_at": F.monotonically_increasing_id()}), "ranked")
    ends = placed.groupBy("g", "r_part").agg(F.min("r_at").alias("r_first"), F.count("*").alias("r_n"))
    group = Window.partitionBy("g")
    ends = ends.select("g", "r_part", "r_first", (F.sum("r_n").over(group.orderBy("r_part")) - F.col("r_n")).alias("r_before"), F.sum("r_n").over(group).alias("n"))
    found = placed.join(if_small(kept(ends, "ranges")), ["g", "r_part"])
    return found.withColumn("idx", F.col("r_at") - F.col("r_first") + F.col("r_before")).drop("r_part", "r_at", "r_first", "r_before")


class _Parents:
    """Partial parents of one task. ``add`` returns the finished runs that a child's arrival brings about."""

    def __init__(self) -> None:
        self.open: dict[tuple[str, int, int], tuple[int, list[dict]]] = {}

    def add(self, g: str, n: int, height: int, idx: int, child: dict) -> Iterator[tuple]:
        """``child`` goes to the parent ``idx`` at ``height``; ``n`` leaves say how many children it has."""
        while True:
            _, children = self.open.setdefault((g, height, idx), (n, []))
            children.append(child)
            below = -(-n // ARITY ** (height - 1))
            if len(children) < min(ARITY, below - ARITY * idx):
                return
            del self.open[g, height, idx]
            children.sort(key=lambda c: c["at"])
            digest = hashlib.sha256("".join(c["digest"] for c in children).encode()).hexdigest()
            last = below <= ARITY
            yield g, n, height, idx, digest, last, children
            if last:
                return
            child, height, idx = {"at": idx % ARITY, "digest": digest, "key": None, "other": None}, height + 1, idx // ARITY

    def frontier(self) -> Iterator[tuple]:
        for (g, height, idx), (n, children) in self.open.items():
            yield g, n, height, idx, None, False, children


def _frames(rows: Iterator[tuple], at_once: int = 2000) -> Iterator[pd.DataFrame]:
    names, held = ["g", "n", "height", "idx", "digest", "last", "children"], []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves (g, n, idx, digest, key, other) of a task: its finished runs, and its frontier with null digests."""

    def rows() -> Iterator[tuple]:
        parents = _Parents()
        for pdf in frames:
            for g, n, idx, digest, key, other in zip(*(pdf[c].tolist() for c in ("g", "n", "idx", "digest", "key", "other")), strict=True):
                child = {"at": idx % ARITY, "digest": digest, "key": key, "other": other}
                if n == 1:
                    yield g, n, 0, 0, digest, True, [child]
                else:
                    yield from parents.add(g, n, 1, idx // ARITY, child)
        yield from parents.frontier()

    return _frames(rows())


def _refold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frontier rows of whole spans: what they finish, and what is still open."""

    def rows() -> Iterator[tuple]:
        parents = _Parents()
        for pdf in frames:
            for g, n, height, idx, children in zip(*(pdf[c].tolist() for c in ("g", "n", "height", "idx", "children")), strict=True):
                for child in children:
                    yield from parents.add(g, n, height, idx, {k: child[k] for k in ("at", "digest", "key", "other")})
        yield from parents.frontier()

    return _frames(rows())


def runs(leaves: DataFrame) -> DataFrame:
    """RUN, one row for each parent of every group's tree with the digests of its children, from g, n, idx, digest, key, other. A group of one leaf gives a row of height 0. ``last`` marks a group's root."""
    made = kept(leaves.select("g", "n", "idx", "digest", "key", "other").mapInPandas(_fold, RUN), "runs")
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    whole, span = made.where("digest is not null"), FIRST_SPAN
    while True:
        open_ = made.where("digest is null")
        if open_.isEmpty():
            return whole
        if ARITY ** (span - SPAN_STEP) >= most and span > FIRST_SPAN:
            raise RuntimeError("parents are left without all of their children")
        first = F.floor(F.col("idx") * F.pow(F.lit(float(ARITY)), F.col("height") - F.lit(float(span))))
        made = kept(open_.withColumn("span", first).repartition("g", "span").drop("span").mapInPandas(_refold, RUN), "runs")
        whole, span = whole.unionByName(made.where("digest is not null")), span + SPAN_STEP


STEPS = "array<struct<before:string,after:string>>"


def _step(children: Column | str, at: Column) -> Column:
    """What stands before and after the child ``at`` of a run."""
    side = lambda test: F.array_join(F.transform(F.filter(children, test), lambda c: c["digest"]), "")
    return F.struct(side(lambda c: c["at"] < at).alias("before"), side(lambda c: c["at"] > at).alias("after"))


def paths(made: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """The runs of leaves (height 1, or 0 in a group of one) with ``steps``, the siblings of all levels above them, and ``subroot``, their group's root.

    ``tops`` (g, top_steps) continues a group's path above its root. A level is joined to the one above it by the parent's place, from the roots down.
    """
    ends = made.where("last")
    if tops is None:
        ends = ends.withColumn("steps", F.array().cast(STEPS))
    else:
        ends = ends.join(if_small(tops), "g").withColumnRenamed("top_steps", "steps")
    ends = ends.withColumn("subroot", F.col("digest"))
    height = ends.agg(F.max("height").alias("h")).first()["h"] or 0
    above, base = None, ends.where("height = 0")
    for h in range(height, 0, -1):
        here = ends.where(F.col("height") == h)
        if above is not None:
            up = above.select("g", F.col("idx").alias("up"), F.col("children").alias("up_children"), F.col("steps").alias("up_steps"), "subroot")
            below = made.where((F.col("height") == h) & ~F.col("last")).withColumn("up", F.floor(F.col("idx") / ARITY))
            step = _step("up_children", F.col("idx") % ARITY)
            here = here.unionByName(below.join(up, ["g", "up"]).withColumn("steps", F.concat(F.array(step), "up_steps")).drop("up", "up_children", "up_steps"))
        above = here
    return base if above is None else base.unionByName(above)


def leaves_of(base: DataFrame) -> DataFrame:
    """(g, key, other, digest, subroot, steps, proof) of every leaf below the runs that ``paths`` gives; proof is all siblings, level by level, as one text."""
    upper = F.array_join(F.flatten(F.transform("steps", lambda s: F.array(s["before"], s["after"]))), "")
    rows = base.withColumn("upper", upper).select("g", "height", "subroot", "steps", "upper", "children", F.explode("children").alias("c"))
    own = F.when(F.col("height") == 1, F.array(_step("children", F.col("c.at")))).otherwise(F.array().cast(STEPS))
    rows = rows.select("g", "c.key", "c.other", "c.digest", "subroot", own.alias("own"), "steps", "upper")
    return rows.select("g", "key", "other", "digest", "subroot", F.concat("own", "steps").alias("steps"), F.concat(F.array_join(F.transform("own", lambda s: F.concat(s["before"], s["after"])), ""), "upper").alias("proof"))


def folded(start: Column, steps: Column | str) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(steps, start, lambda done, s: F.sha2(F.concat(s["before"], done, s["after"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", value_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` says which rows are folded with a text whose A-Z are lower-cased; without it, rows whose decimal id has a crc32 that 5 divides.
    """
    id_ = F.col(id_col).cast("long")
    values = lambda text: [text if c == text_col else F.col(c) for c in value_cols]
    changed = tampered if tampered is not None else F.crc32(id_.cast("string")) % 5 == 0
    other = F.when(changed, leaf(*values(F.translate(F.col(text_col), UPPER, LOWER))))
    group = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))  # bytewise, the null source first
    rows = docs.select(group.alias("g"), id_.alias("id"), leaf(*values(F.col(text_col))).alias("digest"), other.alias("other"))
    leaves = ranked(rows, [F.asc_nulls_first("id"), "digest"]).withColumn("key", F.col("id").cast("string"))
    made = runs(leaves)
    subroots = ranked(made.where("last").select(F.lit("").alias("g"), F.col("g").alias("key"), "digest"), ["key"]).withColumn("other", F.lit(None).cast("string"))
    above = runs(subroots)
    root = above.where("last").first()
    tops = kept(leaves_of(paths(above)).select(F.col("key").alias("g"), F.col("steps").alias("top_steps")), "tops")
    found = leaves_of(paths(made, tops))
    end = F.lit(root["digest"] if root else None).cast("string")
    return found.select(
        F.col("key").cast("long").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        end.alias("root"),
        F.sha2("proof", 256).alias("proof_sha256"),
        folded(F.coalesce("other", "digest"), "steps").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}))::VARCHAR || ':' || {v} END" for v in values) + ")"


def oracle() -> str:
    """DuckDB SQL for ``manifest`` of ``documents``: levels and folds by recursion."""
    return f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf_sql('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents, t),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS h, idx, leaf AS digest, n FROM placed
  UNION ALL SELECT g, h + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY g, h, idx // 16, n),
subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS h, place AS idx, subroot AS digest, n FROM subroots
  UNION ALL SELECT h + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM above WHERE n > 1 GROUP BY h, idx // 16, n),
runs AS (
  SELECT g, h, idx // 16 AS p, list(digest ORDER BY idx) AS d FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, h, idx // 16, list(digest ORDER BY idx) FROM above WHERE n > 1 GROUP BY ALL),
own AS (
  SELECT doc_id, leaf, g, 0 AS h, idx, coalesce(other, leaf) AS cur, '' AS proof FROM placed
  UNION ALL SELECT doc_id, leaf, o.g, o.h + 1, o.idx // 16,
    sha256(array_to_string(d[:o.idx % 16], '') || cur || array_to_string(d[o.idx % 16 + 2:], '')), proof || array_to_string(d[:o.idx % 16], '') || array_to_string(d[o.idx % 16 + 2:], '')
  FROM own o JOIN runs r ON r.g = o.g AND r.h = o.h AND r.p = o.idx // 16),
tops AS (SELECT o.*, subroot, place FROM own o JOIN subroots s USING (g) WHERE o.h = (SELECT max(h) FROM nodes WHERE nodes.g = o.g)),
whole AS (
  SELECT doc_id, leaf, subroot, 0 AS h, place AS idx, cur, proof FROM tops
  UNION ALL SELECT doc_id, leaf, subroot, o.h + 1, o.idx // 16,
    sha256(array_to_string(d[:o.idx % 16], '') || cur || array_to_string(d[o.idx % 16 + 2:], '')), proof || array_to_string(d[:o.idx % 16], '') || array_to_string(d[o.idx % 16 + 2:], '')
  FROM whole o JOIN runs r ON r.g IS NULL AND r.h = o.h AND r.p = o.idx // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM whole, (SELECT digest AS root FROM above WHERE n = 1) WHERE h = (SELECT max(h) FROM above)"""
