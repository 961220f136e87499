"""Paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: str | Column) -> Column:
    """``.`` and empty segments dropped, ``..`` resolved; what leads above the start stays. An absolute path stays absolute."""
    p = F.col(path) if isinstance(path, str) else path
    up = F.lit("..")
    folded = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == up) & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == up) & p.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    body = F.array_join(folded, "/")
    return F.when(p.startswith("/"), F.concat(F.lit("/"), body)).when(body == "", F.lit(".")).otherwise(body)


def dirname(path: str) -> Column:
    """The directory part, empty at the top."""
    return F.regexp_replace(F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("")), r"/+$", "")


def ancestors(path: str) -> Column:
    """The directory itself and all above it; the last is the empty top."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def extension(path: str) -> Column:
    """The part from the last dot of the file name, declaration files' two dots together; empty where there is none."""
    return F.regexp_extract(path, r"(\.d\.[cm]?ts|\.[^./]+)$", 1)


def is_relative(spec: str) -> Column:
    """``.``, ``..`` and what starts with either and a slash."""
    return F.col(spec).rlike(r"^\.\.?(/|$)")


def is_absolute(spec: str) -> Column:
    return F.col(spec).startswith("/") | F.col(spec).rlike(r"^[A-Za-z]:[\\/]")


def has_scheme(spec: str) -> Column:
    """A URL scheme of two letters or more, so that drive letters are none."""
    return F.col(spec).rlike(r"^[A-Za-z][A-Za-z0-9+.-]+:")


def package_of(spec: str) -> Column:
    """The package a bare specifier names: one segment, or two under a scope; null for paths, URLs and built-ins with a scheme."""
    bare = ~(is_relative(spec) | F.col(spec).startswith("/") | F.col(spec).startswith("#") | has_scheme(spec))
    return F.when(bare, F.nullif(F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1), F.lit("")))


def relative_to(path: str, base: str) -> Column:
    """``path`` as seen from directory ``base``; both normalized and relative to one top."""
    a, b = (F.filter(F.split(c, "/"), lambda s: (s != "") & (s != ".")) for c in (base, path))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.coalesce(F.try_element_at(a, k), F.lit("")) == F.coalesce(F.try_element_at(b, k), F.lit("/"))), k).otherwise(n))
    up = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.coalesce(F.nullif(F.array_join(F.concat(up, F.slice(b, shared + 1, F.size(b))), "/"), F.lit("")), F.lit("."))
