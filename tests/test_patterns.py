"""Globs by index against every glob on every path; conventions on literal trees."""

import random
import re

import pytest

from quietus.functions.globs import glob_regex
from quietus.operators.patterns import key_of, matched
from quietus.sources import conventions

DIRS, NAMES = ["a", "b", "src", "x.y", "_p"], ["m.ts", "m.test.ts", "index", ".hidden", "a.b.c", "n.[x", "é.ts"]
PARTS = ["a", "src", "**", "*", "?", "[ab]*", "{a,src}", "_*", "x.y"]
LASTS = ["m.ts", "*.ts", "*.{ts,c}", "**", "m*", "*", "[mn]*", "{index,a.b.c}", "*.[x", "m{,.test}.ts", "?.ts", ".*"]


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_what_every_glob_on_every_path_finds(spark, seed):
    rng = random.Random(seed)
    paths = ["/".join([*rng.choices(DIRS, k=rng.randrange(4)), rng.choice(NAMES)]) for _ in range(120)]
    globs = [(k, rng.choice(["", "", "a", "src/a"]), "/".join([*rng.choices(PARTS, k=rng.randrange(3)), rng.choice(LASTS)])) for k in range(80)]
    found = matched(spark.createDataFrame([(p, 1) for p in [*paths, *paths[:5], None]], "path string, dir int"), spark.createDataFrame([*globs, (900, None, "*"), (901, "", None)], "ord int, base string, glob string"))
    below = lambda p, b: p if not b else p[len(b) + 1 :] if p.startswith(b + "/") else None
    want = sorted((p, k) for p in set(paths) for k, b, g in globs if below(p, b) is not None and re.match(glob_regex(g), below(p, b)))
    assert sorted((r.path, r.ord) for r in found.collect()) == want
    assert want


def test_empty_sides_give_no_rows(spark):
    none = spark.createDataFrame([], "base string, glob string")
    assert matched(spark.createDataFrame([("a",)], "path string"), none).isEmpty()
    assert matched(spark.createDataFrame([], "path string"), spark.createDataFrame([("", "**")], "base string, glob string")).isEmpty()


def test_keys_take_what_is_literal():
    assert key_of("src/app/page.ts") == ("src/app", "name", "page.ts")
    assert key_of("src/**/*.ts") == ("src", "extension", "ts")
    assert key_of("**/__tests__/**/*.js") == ("", "segment", "__tests__")
    assert key_of("a/*") == ("a", "any", "")


def test_conventions_follow_versions_moves_and_exclusions(spark):
    files = ["site/src/pages/a.astro", "site/src/pages/_b.astro", "site/src/pages/_c/d.ts", "site/other/pages/a.astro", "site/.astro/types.ts", "web/app/page.tsx", "web/src/app/x/route.ts", "web/page.tsx", "old/app/page.tsx", "t/a.test.js", "t/_a.test.js", "t/test/node_modules/x.js"]
    declared = spark.createDataFrame([("site", "astro", "5.2.0"), ("web", "next", "14.0.0"), ("old", "next", "13.3.0"), ("t", "ava", "8.0.0"), ("t", "unknown", "1.0.0")], "dir string, name string, version string")
    rows = spark.createDataFrame([(f,) for f in files], "path string")
    table = conventions.table_of(spark)
    got = {(r.path, r["class"]) for r in conventions.convention_files(rows, declared, table).collect()}
    assert got == {("site/src/pages/a.astro", "entry"), ("site/.astro/types.ts", "generated"), ("web/app/page.tsx", "entry"), ("web/src/app/x/route.ts", "entry"), ("t/a.test.js", "test")}
    moved = spark.createDataFrame([("site", "astro", "src", "other")], "dir string, tool string, id string, to string")
    got = {r.path for r in conventions.convention_files(rows, declared, table, moved).collect() if r.tool == "astro"}
    assert got == {"site/other/pages/a.astro", "site/.astro/types.ts"}


def test_placeholders_have_every_default():
    assert conventions.expand("nuxt", "<pages>/**/*.vue", {}) == ["app/pages/**/*.vue", "pages/**/*.vue"]
    assert conventions.expand("nuxt", "<pages>/**/*.vue", {"srcDir": "web"}) == ["web/pages/**/*.vue"]
