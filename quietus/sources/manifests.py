"""Documents that say what is used: package manifests, workspaces, suppression and edge documents, workflows, pages, configuration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.functions.jsonpos import placed_udf
from quietus.functions.paths import dirname, normalized, package_of
from quietus.functions.text import shell_words, yaml_json_udf

#: Sections of a manifest that declare dependencies. Fixed values.
SECTIONS = ["dependencies", "devDependencies", "optionalDependencies"]
MANIFEST = "name string, version string, main string, module string, types string, browser string, bin string, exports string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>, _corrupt string"


def manifests(docs: DataFrame) -> DataFrame:
    """(path, dir, state, m): documents named package.json, read (m), unreadable, or absent where the text is null."""
    m = F.from_json("text", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = docs.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("m", m)
    state = F.when(F.col("text").isNull(), "absent").when(F.col("m._corrupt").isNotNull() | F.col("m").isNull(), "unreadable").otherwise("read")
    return rows.select("path", dirname("path").alias("dir"), state.alias("state"), "m")


def declared(rows: DataFrame) -> DataFrame:
    """(dir, name, section, range): declared dependencies; a name in two sections is two rows."""
    sections = [rows.where("state = 'read'").select("dir", F.explode(f"m.{s}").alias("name", "range"), F.lit(s).alias("section")) for s in SECTIONS]
    out = sections[0]
    for more in sections[1:]:
        out = out.unionByName(more)
    return out.select("dir", "name", "section", "range")


def json_values(docs: DataFrame) -> DataFrame:
    """(path, pointer, kind, value, start, end, line, col): every value of the documents that are strict JSON, and where it stands; a member stands where its name does."""
    read = docs.where("text is not null").select("path", placed_udf("text").alias("p"))
    return read.select("path", F.explode("p.values").alias("v")).select("path", "v.*")


def json_faults(docs: DataFrame) -> DataFrame:
    """(path, line, col, message): the first fault of each document that is no strict JSON."""
    return docs.where("text is not null").select("path", placed_udf("text").alias("p")).where("p.fault is not null").select("path", "p.fault.*")


def _segment(pointer: str, n: int) -> Column:
    return F.replace(F.replace(F.get(F.split(pointer, "/"), F.lit(n)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def declared_sites(docs: DataFrame) -> DataFrame:
    """(path, name, section, range, line, col): each dependency a manifest declares, where its name stands; the range is null where it is no string. An empty name is no dependency."""
    rows = json_values(docs.where(F.col("path").rlike(r"(^|/)package\.json$"))).where(F.col("pointer").rlike(f"^/({'|'.join(SECTIONS)})/[^/]+$"))
    return rows.select("path", _segment("pointer", 2).alias("name"), _segment("pointer", 1).alias("section"), F.when(F.col("kind") == "string", F.col("value")).alias("range"), "line", "col")


def entry_sites(docs: DataFrame, member: str) -> DataFrame:
    """(path, record_ord, line, col): where each entry of an ignore or baseline document's list ``member`` stands."""
    rows = json_values(docs).where(F.col("pointer").rlike(f"^/{member}/[0-9]+$"))
    return rows.select("path", _segment("pointer", 2).cast("int").alias("record_ord"), "line", "col")


def entry_points(rows: DataFrame) -> DataFrame:
    """(dir, kind, target): files a manifest names: main, module, types, browser; bin and exports at every depth."""
    read = rows.where("state = 'read'")
    plain = F.array(*[F.struct(F.lit("manifest-entry").alias("kind"), F.col(f"m.{c}").alias("target")) for c in ("main", "module", "types")])
    deep = lambda member, kind: F.transform(F.regexp_extract_all(F.coalesce(F.col(f"m.{member}"), F.lit("")), F.lit(r'(?:^|[:\[,]\s*|^)"?(\.{0,2}/?[^"{}\[\]:,]*\.[A-Za-z0-9]+)"?')), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    found = read.select("dir", F.explode(F.concat(plain, deep("browser", "manifest-entry"), deep("exports", "manifest-entry"), deep("bin", "manifest-binary"))).alias("e"))
    target = F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.col("e.target"))
    return found.where("e.target is not null and e.target <> ''").select("dir", F.col("e.kind").alias("kind"), normalized(target).alias("target")).distinct()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def commands_udf(lines: pd.Series) -> pd.Series:
    """Static words of each command of a shell line."""
    return lines.map(lambda t: None if t is None else shell_words(t))


def commands(rows: DataFrame) -> DataFrame:
    """(dir, script, word_ord, tool, word): words of each script's commands; the first word of a command is its tool."""
    lines = rows.where("state = 'read'").select("dir", F.explode("m.scripts").alias("script", "line"))
    split = lines.select("dir", "script", F.explode(commands_udf("line")).alias("words"))
    return split.select("dir", "script", F.element_at("words", 1).alias("tool"), F.posexplode("words").alias("word_ord", "word"))


def words_to_files(words: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, word, path): files that a word spells, as it stands or with an extension or index file added; an equi-join on the spellings."""
    base = normalized(F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.col("word")))
    endings = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".mjs", ".cjs", "/index.ts", "/index.js"]
    spelled = words.select("dir", "word", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in endings])).alias("k", "path"))
    hits = spelled.join(files.select("path"), "path")
    return hits.groupBy("dir", "word").agg(F.min_by("path", "k").alias("path"))


def words_to_packages(words: DataFrame, declared_: DataFrame) -> DataFrame:
    """(dir, word, name): packages a word names: the declared package itself or a path within it."""
    return words.withColumn("name", package_of("word")).join(declared_.select("dir", "name").distinct(), ["dir", "name"]).select("dir", "word", "name").distinct()


def suppressions(docs: DataFrame, member: str) -> DataFrame:
    """(record_ord, code, symbol, path, reason, refusal) of an ignore or baseline document's entries, in reading order; an entry without a reason, code or scope is refused."""
    entry = "array<struct<code:string,symbol:string,path:string,reason:string>>"
    rows = docs.select(F.posexplode(F.from_json("text", f"{member} {entry}")[member]).alias("record_ord", "e")).select("record_ord", "e.*")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    refusal = F.when(~F.coalesce(F.col("code"), F.lit("")).rlike(r"^[A-Z]{2}\d{4}$"), "no code").when(blank("symbol") | blank("path"), "DS9002").when(blank("reason"), "DS9001")
    return rows.withColumn("refusal", refusal)


def edge_sides(docs: DataFrame) -> DataFrame:
    """(edge, side, symbol) of an edges document."""
    edge = "edges map<string,struct<provides:array<string>,used_by:array<string>,because:string>>"
    rows = docs.select(F.explode(F.from_json("text", edge)["edges"]).alias("edge", "e"))
    sides = [rows.select("edge", F.lit(s).alias("side"), F.explode(f"e.{s}").alias("symbol")) for s in ("provides", "used_by")]
    return sides[0].unionByName(sides[1])


#: An inline directive: ok, ok without a reason, or malformed. Fixed values.
DIRECTIVE = r"^\s*(?://|/\*+|<!--|#)\s*quietus[:-]ignore\b\s*(.*?)\s*(?:\*/|-->)?\s*$"
DIRECTIVE_BODY = r"^([A-Z]{2}\d{4}(?:\s*,\s*[A-Z]{2}\d{4})*)(?:\s*(?:--|:)\s*(.*))?$"


def inline_directives(lines: DataFrame) -> DataFrame:
    """(path, line, state, codes, reason) of comment lines that hold a directive; one binds the declaration of the next line."""
    body = F.regexp_extract("text", DIRECTIVE, 1)
    codes, reason = F.regexp_extract("body", DIRECTIVE_BODY, 1), F.trim(F.regexp_extract("body", DIRECTIVE_BODY, 2))
    rows = lines.where(F.col("text").rlike(DIRECTIVE)).withColumn("body", body).select("path", "line", codes.alias("listed"), reason.alias("reason"))
    state = F.when(F.col("listed") == "", "malformed").when(F.col("reason") == "", "no-reason").otherwise("ok")
    return rows.select("path", "line", state.alias("state"), F.when(F.col("listed") != "", F.split("listed", r"\s*,\s*")).otherwise(F.array().cast("array<string>")).alias("codes"), "reason")


def bound_directives(directives: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, code, symbol, reason): each code of a directive with the declaration that starts on its line or the next; several configurations' symbols are one."""
    at = symbols.select("path", F.col("line").alias("at"), F.col("id").alias("symbol")).distinct()
    rows = directives.where("state = 'ok'").select("path", "line", "reason", F.explode("codes").alias("code"), F.explode(F.array("line", F.col("line") + 1)).alias("at"))
    return rows.join(at, ["path", "at"], "left").groupBy("path", "line", "code", "reason").agg(F.coalesce(F.min("symbol"), F.lit("")).alias("symbol"))


def workflow_commands(docs: DataFrame) -> DataFrame:
    """(path, line): shell lines of the steps of workflow documents (a YAML subset), in any job."""
    value = yaml_json_udf("text")
    jobs = F.from_json(value, "jobs map<string,struct<steps:array<struct<run:string>>>>")["jobs"]
    steps = docs.select("path", F.explode(F.flatten(F.transform(F.map_values(jobs), lambda j: j["steps"]))).alias("s"))
    return steps.where("s.run is not null").select("path", F.explode(F.split("s.run", "\n")).alias("line")).where("line <> ''")


def document_imports(docs: DataFrame) -> DataFrame:
    """(path, specifier): what MDX documents import."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:import|export)\b[^'\"\n]*?\bfrom\s+['\"]([^'\"]+)['\"]"))
    bare = F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]"))
    return docs.select("path", F.explode(F.concat(found, bare)).alias("specifier"))


def resolved(layers: list[dict], keyed: tuple[str, ...] = ("severity",)) -> dict[str, tuple]:
    """Setting -> (value, layer number) of layered configuration, the first layer strongest; keyed maps merge member by member."""
    out: dict[str, tuple] = {}
    for k, layer in reversed(list(enumerate(layers))):
        for name, value in layer.items():
            if name in keyed and isinstance(value, dict):
                held = out.get(name, ({}, k))[0]
                out[name] = ({**held, **value}, k)
            elif value is not None:
                out[name] = (value, k)
    return out
