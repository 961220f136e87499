"""What installed tools make entries, tests and generated files by convention: a table of globs below the manifest that declares the tool."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietus.functions.semver import satisfies_udf
from quietus.operators.patterns import matched

# The file conventions of public tools, as their documentation states them.
SCRIPT = "{js,jsx,ts,tsx}"
MODULE = "{js,mjs,ts,mts}"
ANY_MODULE = "{js,mjs,cjs,ts,mts,cts}"
ANGULAR = ["src/{main,main.server,server,polyfills,test}.ts", "server.ts", "projects/*/src/{main,main.server,server,polyfills,test,public-api}.ts", "projects/*/server.ts"]
APP_DIRECTORY = [f"<app>/root.{SCRIPT}", f"<app>/routes.{MODULE}", f"<app>/entry.{{client,server}}.{SCRIPT}", f"<app>/routes/**/*.{SCRIPT}"]
SVELTEKIT = [
    "<routes>/**/+{page,layout,server,page.server,layout.server,error}.{js,ts,svelte}",
    "<routes>/**/+{page,layout,server,page.server,layout.server,error}@*.{js,ts,svelte}",
    "<hooksClient>{,/index}.{js,ts}",
    "<hooksServer>{,/index}.{js,ts}",
    "<hooksUniversal>{,/index}.{js,ts}",
    "<serviceWorker>{,/index}.{js,ts}",
]
VITEST = [f"**/{{vitest,vite}}.config.{ANY_MODULE}", f"**/{{vitest,vite}}.config.*.{ANY_MODULE}", f"**/{{vitest,vite}}.*.config.{ANY_MODULE}"]
AVA = ["test", "{src,source}/test", "**/__tests__/**/*", "**/*.spec", "**/*.test", "**/test-*", "**/test/**/*", "**/tests/**/*"]
NODE_TEST = ["**/*.test", "**/*-test", "**/*_test", "**/test-*", "**/test", "**/test/**/*"]
JEST = ["**/__tests__/**/*", "**/{spec,test}", "**/*.{spec,test}"]

#: (tool, package that enables it, range of its versions, what the files are, globs). A glob of class ``not`` takes files out of what else the tool names; ``<id>`` stands for a directory of MOVES.
CONVENTIONS: list[tuple[str, str, str, str, list[str]]] = [
    ("angular", "@angular/build", ">=17.0.0 <22.0.0", "entry", ANGULAR),
    ("angular-devkit", "@angular-devkit/build-angular", ">=12.0.0 <22.0.0", "entry", ANGULAR),
    ("astro", "astro", ">=5.0.0 <8.0.0", "entry", ["<src>/pages/**/*.{astro,js,ts}", "<src>/middleware{,/index}.{js,ts}", "<src>/actions/index.{js,ts}", f"<src>/{{content,live}}.config.{MODULE}", f"<src>/content/config.{MODULE}"]),
    ("astro", "astro", ">=5.0.0 <8.0.0", "not", ["<src>/pages/**/_*", "<src>/pages/**/_*/**"]),
    ("astro", "astro", ">=5.0.0 <8.0.0", "generated", [".astro/**"]),
    ("ava", "ava", ">=6.0.0 <8.0.0", "test", [f"{one}.{{cjs,mjs,js}}" for one in AVA]),
    ("ava", "ava", ">=8.0.0 <9.0.0", "test", [f"{one}.{{mjs,js}}" for one in AVA]),
    ("ava", "ava", ">=6.0.0 <9.0.0", "not", ["**/{.git,.log,.nyc_output,.sass-cache,.yarn,bower_components,coverage,node_modules}/**", "**/_*"]),
    ("docusaurus", "@docusaurus/core", ">=2.0.0 <4.0.0", "entry", [f"src/pages/**/*.{SCRIPT}", f"src/theme/**/*.{SCRIPT}"]),
    ("eslint", "eslint", ">=10.0.0 <11.0.0", "entry", [f"**/eslint.config.{ANY_MODULE}"]),
    ("expo", "expo", ">=44.0.0 <60.0.0", "entry", [f"{{index,App}}.{SCRIPT}"]),
    ("expo-router", "expo-router", ">=3.0.0 <59.0.0", "entry", [f"{{,src/}}app/**/*.{SCRIPT}"]),
    ("jest", "jest", ">=29.0.0 <30.0.0", "test", [f"{one}.{{js,jsx,ts,tsx}}" for one in JEST]),
    ("jest", "jest", ">=30.0.0 <31.0.0", "test", [f"{one}.{{,m,c}}{{js,jsx,ts,tsx}}" for one in JEST]),
    ("mocha", "mocha", ">=10.0.0 <13.0.0", "test", ["test/*.{js,cjs,mjs}"]),
    (
        "next",
        "next",
        ">=13.4.0 <17.0.0",
        "entry",
        [
            f"{{,src/}}app/**/{{layout,page,loading,not-found,error,route,template,default,forbidden,unauthorized}}.{SCRIPT}",
            f"{{,src/}}app/global-{{error,not-found}}.{SCRIPT}",
            f"{{,src/}}app/**/{{icon,apple-icon,opengraph-image,twitter-image}}.{SCRIPT}",
            "{,src/}app/**/sitemap.{js,ts}",
            "{,src/}app/{robots,manifest}.{js,ts}",
            "{,src/}app/(*)/{robots,manifest}.{js,ts}",
            f"{{,src/}}pages/**/*.{SCRIPT}",
            f"{{,src/}}{{proxy,middleware,instrumentation,instrumentation-client,mdx-components}}.{SCRIPT}",
        ],
    ),
    ("next", "next", ">=13.4.0 <17.0.0", "generated", [".next/**"]),
    (
        "nuxt",
        "nuxt",
        ">=3.0.0 <5.0.0",
        "entry",
        [
            "<srcDir>/{app,error}.{vue,jsx,tsx}",
            f"<srcDir>/app.config.{MODULE}",
            "<srcDir>/router.options.{js,ts}",
            "<pages>/**/*.{vue,js,jsx,ts,tsx}",
            "<layouts>/**/*.{vue,jsx,tsx}",
            "<middleware>/**/*.{js,ts}",
            "<plugins>/**/*.{js,ts}",
            "<modules>/*.{js,ts}",
            "<modules>/*/index.{js,ts}",
            f"<serverDir>/{{api,routes,middleware,plugins,tasks}}/**/*.{MODULE}",
            f"layers/*/nuxt.config.{MODULE}",
        ],
    ),
    ("nuxt", "nuxt", ">=3.0.0 <5.0.0", "generated", [".nuxt/**"]),
    ("oclif", "@oclif/core", ">=1.0.0 <5.0.0", "entry", [f"src/{{commands,hooks}}/**/*.{SCRIPT}"]),
    ("panda", "@pandacss/dev", ">=0.1.0 <2.0.0", "generated", ["<output>/**"]),
    ("playwright", "@playwright/test", ">=1.0.0 <2.0.0", "entry", [f"playwright.config.{ANY_MODULE}"]),
    ("playwright", "@playwright/test", ">=1.0.0 <2.0.0", "test", ["**/*.{spec,test}.{js,ts,jsx,tsx,cjs,cts,cjsx,ctsx,mjs,mts,mjsx,mtsx}"]),
    ("prettier", "prettier", ">=3.0.0 <4.0.0", "entry", [f"{{prettier.config,.prettierrc}}.{ANY_MODULE}"]),
    ("react-router", "@react-router/dev", ">=7.0.0 <9.0.0", "entry", APP_DIRECTORY),
    ("react-router", "@react-router/dev", ">=7.0.0 <9.0.0", "generated", [".react-router/**"]),
    ("react-scripts", "react-scripts", ">=1.0.0 <6.0.0", "entry", [f"src/index.{SCRIPT}", "src/setupProxy.js", f"src/setupTests.{SCRIPT}"]),
    ("remix", "@remix-run/dev", ">=2.0.0 <3.0.0", "entry", APP_DIRECTORY),
    ("solidstart", "@solidjs/start", ">=1.0.0 <3.0.0", "entry", [f"<appRoot>/app.{SCRIPT}", f"<appRoot>/entry-{{client,server}}.{SCRIPT}", "<appRoot>/middleware{,/index}.{js,ts}", f"<routeDir>/**/*.{SCRIPT}"]),
    ("storybook", "storybook", ">=7.0.0 <11.0.0", "entry", ["**/*.stories.{js,jsx,mjs,ts,tsx,mts,svelte,vue}"]),
    ("stryker", "@stryker-mutator/core", ">=7.0.0 <11.0.0", "entry", ["{stryker,.stryker}.{conf,config}.{js,mjs,cjs}"]),
    ("sveltekit", "@sveltejs/kit", ">=2.0.0 <3.0.0", "entry", [*SVELTEKIT, "<params>/*.{js,ts}"]),
    ("sveltekit", "@sveltejs/kit", ">=3.0.0 <4.0.0", "entry", [*SVELTEKIT, "<params>.{js,ts}"]),
    ("sveltekit", "@sveltejs/kit", ">=2.0.0 <4.0.0", "generated", [".svelte-kit/**"]),
    ("tanstack-router", "@tanstack/router-plugin", ">=1.0.0 <2.0.0", "entry", [f"<routes>/**/*.{SCRIPT}"]),
    ("vitepress", "vitepress", ">=1.0.0 <2.0.0-0 || >=2.0.0-alpha.0 <3.0.0", "entry", [f".vitepress/config.{ANY_MODULE}", f".vitepress/theme/index.{ANY_MODULE}", f"**/*.data.{ANY_MODULE}", "**/*.vue"]),
    ("vitest", "vitest", ">=3.2.0 <4.0.0", "entry", [*VITEST, f"{{vitest.workspace,vitest.projects}}.{ANY_MODULE}"]),
    ("vitest", "vitest", ">=4.0.0 <6.0.0", "entry", VITEST),
    ("node-test", "", "", "test", [f"{one}.{{cjs,mjs,js}}" for one in NODE_TEST]),
]

#: (tool, id): where a placeholder's directory lies unless configuration moves it; several defaults all hold.
MOVES: dict[tuple[str, str], list[str]] = {
    ("astro", "src"): ["src"],
    ("nuxt", "srcDir"): ["app", "."],
    ("nuxt", "pages"): ["<srcDir>/pages"],
    ("nuxt", "layouts"): ["<srcDir>/layouts"],
    ("nuxt", "middleware"): ["<srcDir>/middleware"],
    ("nuxt", "plugins"): ["<srcDir>/plugins"],
    ("nuxt", "modules"): ["modules"],
    ("nuxt", "serverDir"): ["server"],
    ("panda", "output"): ["styled-system"],
    ("react-router", "app"): ["app"],
    ("remix", "app"): ["app"],
    ("solidstart", "appRoot"): ["src"],
    ("solidstart", "routeDir"): ["<appRoot>/routes"],
    ("sveltekit", "src"): ["src"],
    ("sveltekit", "routes"): ["<src>/routes"],
    ("sveltekit", "params"): ["<src>/params"],
    ("sveltekit", "hooksClient"): ["<src>/hooks.client"],
    ("sveltekit", "hooksServer"): ["<src>/hooks.server"],
    ("sveltekit", "hooksUniversal"): ["<src>/hooks"],
    ("sveltekit", "serviceWorker"): ["<src>/service-worker"],
    ("tanstack-router", "routes"): ["src/routes"],
}


def expand(tool: str, glob: str, moved: dict[str, str]) -> list[str]:
    """The glob with each placeholder replaced by where it lies, one for each default of a placeholder that is not moved."""
    at = glob.find("<")
    if at < 0:
        return ["/".join(s for s in glob.split("/") if s not in ("", "."))]
    end = glob.index(">", at)
    name = glob[at + 1 : end]
    places = [moved[name]] if name in moved else MOVES[tool, name]
    return [e for place in places for e in expand(tool, glob[:at] + place + glob[end + 1 :], moved)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _expanded(tool: pd.Series, glob: pd.Series, moved: pd.Series) -> pd.Series:
    return pd.Series([expand(t, g, dict(m) if m is not None else {}) for t, g, m in zip(tool, glob, moved, strict=True)], dtype=object)


def live_conventions(declared: DataFrame, conventions: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(base, tool, row, class, glob): the globs that each manifest's installed tools bring, its directory as their base.

    ``declared``: dir, name, version as installed. ``conventions``: tool, package, range, class, glob. ``moved``: dir, tool, id, to, the directories that configuration sets.
    """
    live = declared.join(F.broadcast(conventions), F.col("name") == F.col("package")).where(satisfies_udf("version", "range"))
    if moved is None:
        live = live.withColumn("moved", F.lit(None).cast("map<string,string>"))
    else:
        own = moved.groupBy("dir", "tool").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("id", "to")))).alias("moved"))
        live = live.join(own, ["dir", "tool"], "left")
    return live.select(F.col("dir").alias("base"), "tool", "class", F.explode(_expanded("tool", "glob", "moved")).alias("glob")).distinct()


def table_of(spark, rows: list[tuple[str, str, str, str, list[str]]] = CONVENTIONS) -> DataFrame:
    """The table of conventions as a DataFrame, a row a glob; test runners that no package enables are left out."""
    return spark.createDataFrame([(t, p, r, c, g) for t, p, r, c, globs in rows if p for g in globs], "tool string, package string, range string, class string, glob string")


def convention_files(files: DataFrame, declared: DataFrame, conventions: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(path, base, tool, class): files that the conventions of tools declared by a manifest above them make entries, tests or generated files, but for those a row excludes."""
    hits = matched(files, live_conventions(declared, conventions, moved)).select("path", "base", "tool", "class").distinct()
    out = hits.where("class = 'not'").select("path", "base", "tool")
    named = hits.where("class in ('entry', 'test')").join(out, ["path", "base", "tool"], "left_anti")
    return named.unionByName(hits.where("class not in ('entry', 'test', 'not')"))
