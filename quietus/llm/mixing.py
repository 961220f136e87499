"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token weights are summed by cell (source, language, topic). Each round rakes the cells to the target share of every source, then language, then
topic, until the margins are met. A document of a cell whose weight grew by the factor f is kept with probability f / max f, by a hash of its id against that
probability, so the kept tokens have the target marginals in expectation and no document is taken twice.

Only cells are raked, never documents; a hot source is one partial sum per task. The table of cells goes to the documents by broadcast where its
counted size allows, else by a join that adaptive execution may split.

Edge cases: a null source, language or topic is a value of its own; a null text has no tokens and topic ``short``; cells without any token keep weight zero and
their documents are dropped (they add nothing to any margin); values without a stated target keep their natural share; columns that have the names added here are renamed; repeated rows share their fate; a null id is hashed as an empty one; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietus.llm.names import fresh
from quietus.session import cut, if_small

DIMS = ["source", "lang", "topic"]
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that may be broadcast: some 100 bytes each.
BROADCAST_CELLS = 50_000
#: Shares that margins may be off by: they are settled to the rounding of doubles.
TOLERANCE = 1e-12
#: What margins may be off by without a warning.
UNSETTLED = 1e-6
#: Rounds between two looks at the error, where cells are few.
ROUNDS = 6


def tokens(text_col: str) -> Column:
    """Words of a text, which stand for its tokens."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(n_tokens: str) -> Column:
    """Where a table states no topic, its register by length stands for one."""
    return F.when(F.col(n_tokens) < 128, "short").when(F.col(n_tokens) < 1024, "medium").otherwise("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """Token weight ``w0`` of each cell, from columns m_source, m_lang, m_topic, m_tokens."""
    return docs.groupBy(*[f"m_{d}" for d in DIMS]).agg(F.sum("m_tokens").cast("double").alias("w0"))


def with_targets(cells: DataFrame, alpha: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Adds t_<dim>: a stated target share, or the natural share to the power ``alpha``, scaled to sum to 1 over the values that have tokens.

    Where shares are stated for some values of a dimension, those not listed keep their natural share before the scaling; only a stated 0 drops a value.
    """
    for d in DIMS:
        natural = cells.groupBy(f"m_{d}").agg(F.sum("w0").alias("w"))
        whole = natural.agg(F.sum("w").alias("w")).first()["w"] or 1.0
        if d in targets:
            stated = F.create_map(*[F.lit(x) for pair in targets[d].items() for x in pair]) if targets[d] else F.create_map().cast("map<string,double>")
            natural = natural.withColumn("t", F.when(F.col("w") > 0, F.coalesce(F.try_element_at(stated, F.col(f"m_{d}")), F.col("w") / F.lit(whole))).otherwise(F.lit(0.0)))
        else:
            natural = natural.withColumn("t", F.pow("w", F.lit(alpha)))
        total = natural.agg(F.sum("t").alias("t")).first()["t"]
        cells = cells.join(_small(natural.select(f"m_{d}", (F.col("t") / F.lit(total or 1.0)).alias(f"t_{d}"))), f"m_{d}")
    return cells


def _small(table: DataFrame) -> DataFrame:
    return if_small(table, BROADCAST_CELLS)


def _raked(cells: DataFrame, d: str) -> DataFrame:
    """Weights raked to one margin by a sum over its values, where all cells are one partition: no shuffle."""
    margin = F.sum("w").over(Window.partitionBy(f"m_{d}"))
    return cells.withColumn("w", F.when(margin > 0, F.col("w") * F.col(f"t_{d}") / margin).otherwise(F.lit(0.0)))


def rake(cells: DataFrame, tolerance: float = TOLERANCE, max_rounds: int = 100) -> tuple[DataFrame, float]:
    """(cells with w, margins' error): ``w0`` raked to each margin in turn until no margin is off by more than ``tolerance``.

    Some rounds are one query, between which the error is looked at. Margins that contradict each other (cells that do not exist cannot be raked) never settle: raking ends when the error no longer falls, or after ``max_rounds``, and says so.
    """
    cells, off, before = cells.withColumn("w", F.col("w0")), 0.0, float("inf")
    few = cells.count() <= BROADCAST_CELLS
    small = {d: few or cells.select(f"m_{d}").distinct().count() <= BROADCAST_CELLS for d in DIMS}
    at_once = ROUNDS if few else 1
    for _ in range(0, max_rounds, at_once):
        if few:
            cells = cells.coalesce(1)  # BROADCAST_CELLS rows at most
            for _ in range(at_once):
                for d in DIMS:
                    cells = _raked(cells, d)
            cells = cut(cells)
        else:
            for d in DIMS:
                margin = cells.groupBy(f"m_{d}").agg(F.sum("w").alias("margin"))
                cells = cells.join(F.broadcast(margin) if small[d] else margin, f"m_{d}")
                cells = cut(cells.withColumn("w", F.when(F.col("margin") > 0, F.col("w") * F.col(f"t_{d}") / F.col("margin")).otherwise(F.lit(0.0))).drop("margin"))
        errors = [cells.groupBy(f"m_{d}").agg(F.abs(F.sum("w") - F.first(f"t_{d}")).alias("off")) for d in DIMS[:-1]]
        off = reduce(DataFrame.unionByName, [e.select("off") for e in errors]).agg(F.max("off").alias("off")).first()["off"] or 0.0
        if off <= tolerance or off > 0.99 * before:
            break
        before = off
    return cells, off


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, alpha: float = 0.75, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with m_tokens, m_topic, m_probability (6 decimals), m_error (what the margins are off by at most) and m_kept, drawn against the unrounded probability. Warns if the margins are off by more than ``UNSETTLED``.

    A column of the table that has one of these names is kept under the name with an underscore behind it.
    """
    none = F.lit("(none)")
    own = ["m_tokens", "m_topic", "m_probability", "m_error", "m_kept", "m_source", "m_lang", *[f"c_{d}" for d in DIMS], "c_chance"]
    for c in docs.columns:
        if c.lower() in own:
            (other,) = fresh(docs, c)
            docs = docs.withColumnRenamed(c, other)
    rows = docs.withColumn("m_tokens", tokens(text_col))
    rows = rows.withColumns({"m_source": F.coalesce(F.col(source_col).cast("string"), none), "m_lang": F.coalesce(F.col(lang_col).cast("string"), none), "m_topic": F.coalesce(topic if topic is not None else topic_of("m_tokens"), none)})
    cells, off = rake(cut(with_targets(cut(cells_of(rows)), alpha, targets or {})), tolerance)
    if off > UNSETTLED:
        warnings.warn(f"the targets contradict each other: margins are off by up to {off:.3g}", stacklevel=2)
    factor = F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(F.lit(0.0))
    cells = cut(cells.select(*[F.col(f"m_{d}").alias(f"c_{d}") for d in DIMS], factor.alias("f")))
    top = cells.agg(F.max("f").alias("f")).first()
    chances = _small(cells.select(*[f"c_{d}" for d in DIMS], (F.col("f") / F.lit(top["f"] or 1.0)).alias("c_chance")))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.join(chances, [F.col(f"m_{d}") == F.col(f"c_{d}") for d in DIMS]).drop(*[f"c_{d}" for d in DIMS])
    return rows.withColumns({"m_probability": F.round("c_chance", 6), "m_error": F.lit(off), "m_kept": drawn < F.col("c_chance")}).drop("m_source", "m_lang", "c_chance")


def oracle(alpha: float = 0.75, rounds: int = 30) -> str:
    """DuckDB SQL for doc_id, n_tokens, topic, probability, kept, margin_error over ``documents``; ``rounds`` are more than settle the margins of these tables."""
    steps = [
        rf"""docs AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang FROM documents)""",
        """rows_ AS (SELECT *, CASE WHEN n_tokens < 128 THEN 'short' WHEN n_tokens < 1024 THEN 'medium' ELSE 'long' END AS topic FROM docs)""",
        """cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w0 FROM rows_ GROUP BY ALL)""",
    ]
    steps += [f"n_{d} AS (SELECT {d}, pow(sum(w0), {alpha}) AS t FROM cells GROUP BY {d})" for d in DIMS]
    steps.append("k0 AS (SELECT cells.*, w0 AS w, " + ", ".join(f"n_{d}.t / (SELECT sum(t) FROM n_{d}) AS t_{d}" for d in DIMS) + " FROM cells " + " ".join(f"JOIN n_{d} USING ({d})" for d in DIMS) + ")")
    for k in range(rounds * len(DIMS)):
        d = DIMS[k % len(DIMS)]
        steps.append(f"k{k + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM k{k})")
    steps.append(f"f AS (SELECT source, lang, topic, CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END AS f FROM k{rounds * len(DIMS)})")
    steps.append("p AS (SELECT source, lang, topic, f / (SELECT max(f) FROM f) AS chance FROM f)")
    off = " UNION ALL ".join(f"SELECT abs(sum(w) - any_value(t_{d})) AS off FROM k{rounds * len(DIMS)} GROUP BY {d}" for d in DIMS)
    steps.append(f"e AS (SELECT round(max(off), 6) AS margin_error FROM ({off}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, n_tokens, topic, round(chance, 6) AS probability, margin_error, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < chance AS kept FROM rows_ JOIN p USING (source, lang, topic), e"
