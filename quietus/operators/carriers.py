"""What hand-written code carries on into generated code: the walk in which references inside a generated member are that member's own, and opaque sources are sealed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietus.graph.edges import reads_of
from quietus.graph.walk import reach, walk

#: Lines of a block on which references and members meet.
BLOCK = 64


def owned_by_members(references: DataFrame, members: DataFrame) -> DataFrame:
    """``references`` with from_id moved to the innermost member of its declaration that the reference is written in: spans nest, so the one that starts last.

    A place within a declaration has one innermost member, whatever is written there. ``references``: from_id, line, col and others. ``members``: key, within (the declaration), from_line, from_col, to_line, to_col. References and members of a declaration meet on blocks of lines.
    """
    span = F.sequence(F.floor(F.col("from_line") / BLOCK), F.floor(F.col("to_line") / BLOCK))
    spans = members.select("key", F.col("within").alias("from_id"), "from_line", "from_col", "to_line", "to_col", F.explode(span).alias("block"))
    place = ["from_id", "line", "col"]
    at = references.select(*place, F.floor(F.col("line") / BLOCK).alias("block")).distinct()
    inside = (F.struct("line", "col") >= F.struct("from_line", "from_col")) & (F.struct("line", "col") <= F.struct("to_line", "to_col"))
    owner = at.join(spans, ["from_id", "block"]).where(inside).groupBy(*place).agg(F.max_by("key", F.struct("from_line", "from_col", "key")).alias("owner"))
    return references.join(owner, place, "left").withColumn("from_id", F.coalesce("owner", "from_id")).drop("owner")


def sealed_by(symbols: DataFrame, opaque: DataFrame) -> DataFrame:
    """(id): the declarations ``opaque`` (id) and all they contain."""
    down = symbols.select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"))
    return reach(down, opaque.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))


def carry(symbols: DataFrame, references: DataFrame, exports: DataFrame, seeds: DataFrame, members: DataFrame, opaque: DataFrame, reads: DataFrame, member_reads: DataFrame) -> DataFrame:
    """(id, member): the declarations and generated members that hand-written code reaches.

    No write, no test reference and nothing out of an opaque declaration, or a member of one, is followed. ``reads`` (from_id, to_id) and ``member_reads`` (from_id, member) reach what they name and nothing beyond.
    ``seeds`` (id): hand-written roots, records on hand-written evidence, and what is held. A member's references are followed once the member is read.
    """
    members = members.dropDuplicates(["key"])
    known = symbols.select("id").distinct()
    sealed = sealed_by(symbols, opaque)
    sealed = sealed.unionByName(members.join(sealed.select(F.col("id").alias("within")), "within", "left_semi").select(F.col("key").alias("id")))
    own = owned_by_members(references.join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi"), members)
    nodes = known.select(F.col("id").alias("from_id")).unionByName(members.select(F.col("key").alias("from_id"))).withColumn("known", F.lit(True))
    edges = own.join(nodes, "from_id", "left").withColumn("inside", F.col("known").isNotNull() & (F.col("consumer") == "")).withColumn("reads", reads_of())
    edges = edges.where("use <> 'write' and not test").select("from_id", "to_id", "reads", "test", "guessed", "inside")
    more = reads.select("from_id", "to_id").unionByName(member_reads.select("from_id", F.col("member").alias("to_id")))
    edges = edges.unionByName(more.select("from_id", "to_id", F.lit("none").alias("reads"), F.lit(False).alias("test"), F.lit(False).alias("guessed"), F.lit(True).alias("inside")))
    edges = edges.join(sealed.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    start = seeds.select(F.col("id").alias("node"), F.lit(False).alias("holds"), F.lit(True).alias("passes")).join(known.withColumnRenamed("id", "node"), "node", "left_semi").distinct()
    reached = walk(edges, start, exports, guessed=True).select(F.col("node").alias("id"))
    return reached.join(members.select(F.col("key").alias("id"), F.lit(True).alias("member")), "id", "left").select("id", F.coalesce("member", F.lit(False)).alias("member"))


def needed_with_peers(declared: DataFrame, peers: DataFrame, needed: DataFrame) -> DataFrame:
    """(dir, name): the declared dependencies ``needed`` or run, and those that the installed manifest of one of them names as a peer, declared in its own manifest or one above it, and so on.

    ``declared``: dir, name. ``peers``: dir, name, peer. A declaration's peers meet the declarations above it by the directories above it, so a step's key changes with containment.
    """
    from quietus.functions.paths import ancestors

    key = lambda d, n: F.concat_ws("\u0000", d, n)
    held = declared.select("dir", "name").distinct()
    up = peers.select("dir", "name", "peer", F.explode(ancestors("dir")).alias("at")).join(held.select(F.col("dir").alias("at"), F.col("name").alias("peer")), ["at", "peer"])
    steps = up.select(key("dir", "name").alias("from_id"), key("at", "peer").alias("to_id"))
    found = reach(steps, needed.join(held, ["dir", "name"], "left_semi").select(key("dir", "name").alias("node")))
    parts = F.split("node", "\u0000")
    return found.select(parts[0].alias("dir"), parts[1].alias("name"))
