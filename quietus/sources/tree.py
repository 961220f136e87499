"""Files below a root as tables: listing, bounded documents, ignore rules, classes of files by pattern."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietus.functions.globs import glob_regex, ignore_rule
from quietus.functions.paths import ancestors, extension

#: Directories no listing enters, and the largest document that is read. Fixed values.
SKIPPED = ["node_modules", ".git", ".hg", ".svn"]
MOST_BYTES = 16 << 20
#: Source extensions. Fixed values.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".d.ts", ".d.mts", ".d.cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".astro"]


def files_below(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, content): files below ``root``, paths relative to it; installed packages and version control are left out before any content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # Spark gives paths as URIs; what follows the root's own path, with or without a scheme, is the relative path.
    root = root if root.startswith("/") or ":" in root else os.path.abspath(root)
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*(?=/)", ""), "^" + re.escape(re.sub("/+", "/", base)) + "/+", "")
    inside = listed.where(~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    return inside.select(path.alias("path"), "length", "content")


def documents(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, text, refusal): decoded contents; a document beyond the bound is refused, and not decoded."""
    over = F.col("length") > most
    return files.select("path", F.when(~over, F.decode("content", "UTF-8")).alias("text"), F.when(over, F.lit("over the size bound")).alias("refusal"))


def source_files(files: DataFrame) -> DataFrame:
    """(path, ref, end_line): source files with their reference and last line."""
    text = F.decode("content", "UTF-8")
    lines = F.size(F.split(text, "\r\n|\r|\n"))
    return files.where(extension("path").isin(EXTENSIONS)).select("path", F.concat(F.lit("ts://"), F.col("path")).alias("ref"), lines.alias("end_line"))


def ignored(paths: DataFrame, lines: list[str]) -> DataFrame:
    """(path, ignored): whether the last rule that matches the path, or any directory above it, ignores it. What is below an ignored directory stays ignored."""
    rules = [(k, rule) for k, rule in enumerate(map(ignore_rule, lines)) if rule]

    def last(at: Column, directory: bool) -> Column:
        """Order of the last matching rule, positive if it ignores, negative if it does not."""
        hits = [F.when(at.rlike(regex) & F.lit(directory or not only_dirs), F.lit(-(k + 1) if negated else k + 1)) for k, (regex, negated, only_dirs) in rules]
        return F.coalesce(*reversed(hits), F.lit(0)) if hits else F.lit(0)

    above = F.exists(F.slice(ancestors("path"), 2, 10_000), lambda d: (d != "") & (last(d, True) > 0))
    return paths.select("path", (above | (last(F.col("path"), False) > 0)).alias("ignored"))


def classed(paths: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(path, class): every class one of whose patterns matches."""
    found = F.array(*[F.when(F.exists(F.array(*map(F.lit, map(glob_regex, globs))), lambda g: F.rlike("path", g)), F.lit(name)) for name, globs in rules.items()])
    return paths.select("path", F.explode(F.array_compact(found)).alias("class"))


def rule_hits(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(pattern, files): distinct files each pattern matches, those of none too."""
    hits = paths.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in globs]))).alias("pattern"))
    every = paths.sparkSession.createDataFrame([(g,) for g in globs], "pattern string")
    return every.join(hits.groupBy("pattern").agg(F.count("*").alias("files")), "pattern", "left").na.fill(0, ["files"])


#: Names of minified files, and the size and mean line from which a text counts as minified. Fixed values.
MINIFIED_NAMES = ["*.min.js", "*.min.cjs", "*.min.mjs"]
MINIFIED_BYTES, MINIFIED_LINE = 10_240, 500


def minified(text: str = "text", path: str = "path") -> Column:
    """Whether a JavaScript file is minified: by its name, or by a text of MINIFIED_BYTES at least whose mean line is longer than MINIFIED_LINE UTF-16 units."""
    content = F.col(text)
    lines = F.size(F.split(content, "\r?\n"))
    units = (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("long")
    named = reduce(Column.__or__, [F.regexp_extract(path, "[^/]*$", 0).rlike(glob_regex(g)) for g in MINIFIED_NAMES])
    long_lines = (F.octet_length(content) >= MINIFIED_BYTES) & (units / lines > MINIFIED_LINE)
    return F.col(path).rlike(r"\.(js|jsx|mjs|cjs)$") & (named | F.coalesce(long_lines, F.lit(False)))


#: Marks that generators leave in a file's leading comment. Fixed values.
GENERATED = r"(?is)^\s*(?:#![^\n]*\n)?\s*(?:/\*(?:(?!\*/).)*?(?:@generated|do not edit|auto-?generated)|(?://[^\n]*\n\s*)*//[^\n]*(?:@generated|do not edit|auto-?generated))"


def generated(text: str = "text") -> Column:
    """Whether the leading comment says that the file is generated."""
    return F.col(text).rlike(GENERATED)
