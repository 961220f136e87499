"""Paths held against very many globs: an equi-join on what a glob states literally, and its expression only where that agrees.

A glob's alternatives are taken apart once. The directories that lead it, below the glob's own base, are its anchor; its last segment's whole name, a whole segment in its middle, or its
last segment's extension is its key, in this order of choice. A path meets the globs anchored at one of its directories under its name, its extension or one of its segments. So a
path is held only against globs of its own directory and key, however many others there are; there is no nested loop and nothing is collected.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.functions.globs import MAX_LENGTH, PatternError, alternative_regex, expand_braces
from quietus.functions.paths import ancestors, dirname
from quietus.session import cut, if_small

#: Keys of globs that are broadcast to where the paths lie; beyond, the planner joins.
FEW_KEYS = 100_000
_WILD = re.compile(r"[*?\[]")


def key_of(glob: str) -> tuple[str, str, str]:
    """(anchor, kind, key) of one alternative of a glob: every path it matches lies below the anchor and has the key."""
    *dirs, last = glob.split("/")
    lead = next((k for k, s in enumerate(dirs) if _WILD.search(s)), len(dirs))
    anchor, middle = "/".join(dirs[:lead]), [s for s in dirs[lead:] if s and not _WILD.search(s)]
    if last and not _WILD.search(last):
        return anchor, "name", last
    if middle:
        return anchor, "segment", max(middle, key=len)
    ending = re.split(r"[*?\]]", last)[-1]
    if "." in ending and "[" not in ending:
        return anchor, "extension", ending.rsplit(".", 1)[1]
    return anchor, "any", ""


def keys_of(glob: str) -> list[tuple[str, str, str, str]]:
    """(anchor, kind, key, regex) of a glob; alternatives that share a key share an expression."""
    if len(glob) > MAX_LENGTH:
        raise PatternError("a pattern is too long")
    found: dict[tuple[str, str, str], list[str]] = {}
    for one in expand_braces(glob):
        found.setdefault(key_of(one), []).append(alternative_regex(one))
    return [(*key, "^(?:" + "|".join(regexes) + ")$") for key, regexes in found.items()]


_KEYS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("anchor", "kind", "key", "regex")]))


@F.pandas_udf(_KEYS)
def _keys(globs: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("anchor", "kind", "key", "regex"), k, strict=True)) for k in keys_of(g)] for g in globs], dtype=object)


def matched(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, and the columns of ``patterns``): each distinct path with every glob that matches it below the glob's base.

    ``patterns``: base (a directory, empty at the top) and glob, beside any others. Rows with a null path, base or glob match nothing; equal patterns match each for themselves.
    """
    names = patterns.columns
    at = F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.when(F.col("k.anchor") != "", F.col("k.anchor")))
    rows = patterns.where("base is not null and glob is not null").withColumn("_k", _keys("glob")).select(F.struct(*names).alias("p"), F.col("base"), F.explode("_k").alias("k"))
    keys = cut(rows.select("p", at.alias("at"), F.when(F.col("base") == "", 0).otherwise(F.length("base") + 1).alias("skip"), "k.kind", "k.key", "k.regex"))
    paths = files.select("path").where("path is not null").distinct().withColumn("dir", dirname("path"))
    # Which of a directory's ancestors are anchors is found once a directory, not once a file.
    anchors = keys.select("at").distinct()
    near = paths.select("dir").distinct().withColumn("at", F.explode(ancestors("dir"))).join(if_small(anchors, FEW_KEYS), "at")
    name = F.substring_index("path", "/", -1)
    probe = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    probes = F.concat(
        F.array(probe("name", name), probe("any", F.lit(""))),
        F.when(F.instr(name, ".") > 0, F.array(probe("extension", F.substring_index(name, ".", -1)))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")),
        F.transform(F.array_distinct(F.split("dir", "/")), lambda s: probe("segment", s)),
    )
    met = paths.join(near, "dir").select("path", "at", F.explode(probes).alias("b")).select("path", "at", "b.kind", "b.key")
    hits = met.join(if_small(keys, FEW_KEYS), ["at", "kind", "key"]).where(F.expr("substring(path, skip + 1) rlike regex"))
    return hits.select("path", "p").distinct().select("path", *[F.col(f"p.{n}").alias(n) for n in names])
