"""Mixing of sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: scaled in turn to the target shares of sources, of
languages and of topics, until all three hold. A cell's factor, times the wanted share of all tokens, is the chance of each of its documents (at most
1), and a document stays if a hash of its id lies below its chance. Where chances are cut to 1, the sample has fewer of these cells' tokens than wanted. With
`bounded` the raking itself holds every chance to at most 1 and gives the missing tokens to other cells, until the marginals of the sample meet the targets; a warning
names the residual if they can't. `marginals` reports what a sample is expected to hold.

Null sources, languages and topics form cells of their own (as the empty string). Texts without tokens (null, empty, blank) have weight 0 and go. A null id
counts as the empty one. With no tokens at all nothing stays. Extra columns are kept; those named as the ones added are replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm.common import dropped, written

DIMENSIONS = ("source", "lang", "topic")
#: Exponent that turns the tokens' shares into targets: 1 keeps them, 0 makes all equal.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 12
#: Share of all tokens that the sample is aimed at, where no chance is above 1.
SHARE = 0.6
#: Cells up to which the raking runs in numpy on the driver; more are raked by Spark, with the same targets, steps, rounds, end and share.
CELLS_AT_ONCE = 50_000
#: A marginal is met if it is off by at most a hundredth of its target and a ten-thousandth of all tokens. Bounded raking ends when all are met, or after so many
#: rounds.
TOLERANCE = (0.01, 1e-4)
BOUNDED_ROUNDS = 500
#: Step by which the share is lowered where the targets can't be met, and where that ends.
LOWERED, LEAST_SHARE = 0.9, 0.01
#: Rounds of Spark's raking between two tables in the shared folder, which cut the lineage.
PLAN_ROUNDS = 4


def topic_of(text: Column) -> Column:
    """A plain topic from the look of a whole text: tables, shouting, symbols, lists of short lines, or prose by length."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, "[^A-Z]", "")) / size
    symbols = F.length(F.regexp_replace(text, r"[^#$%&*!|=<>{}\[\]]", "")) / size
    lines = F.length(F.regexp_replace(text, "[^\n]", "")) + 1
    return (
        F.when(symbols >= 0.08, "symbols")
        .when(letters >= 0.5, "capitals")
        .when(size / lines < 60, "lines")
        .when(size < 2000, "short")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Number of words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from an id, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rake(cells: DataFrame, rounds: int = ROUNDS, temperatures: dict[str, float] | None = None, at_once: int = CELLS_AT_ONCE) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with `raked`, the tokens scaled to the targets.

    A target is a value's share of the tokens to the power of its temperature, normalised. There is one cell for each combination of values that occurs.
    """
    temperatures = temperatures or TEMPERATURES
    head = cells.limit(at_once + 1).collect()
    if len(head) <= at_once:
        return _raked_here(cells.sparkSession, [(*[r[d] for d in DIMENSIONS], float(r["tokens"])) for r in head], rounds, temperatures)
    out = cells.withColumn("raked", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n"))
        power = F.pow("n", F.lit(temperatures[d]))
        whole = sums.agg(F.sum("n").alias("all"), F.sum(power).alias("powers"))
        out = out.join(sums.crossJoin(F.broadcast(whole)).select(d, (power / F.col("powers") * F.col("all")).alias(f"target_{d}")), d)
    out = written(out, "raking")
    for r in range(rounds):
        for d in DIMENSIONS:
            sums = out.groupBy(d).agg(F.sum("raked").alias("sum"))
            out = out.join(sums, d).withColumn("raked", F.col("raked") * F.col(f"target_{d}") / F.col("sum")).drop("sum")
        if (r + 1) % PLAN_ROUNDS == 0 and r + 1 < rounds:
            out = written(out, "raking")
    return out.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"), "raked")


def _raked_here(spark: SparkSession, cells: list[tuple], rounds: int, temperatures: dict[str, float]) -> DataFrame:
    cells = sorted(cells)
    tokens = np.array([c[3] for c in cells])
    raked = tokens.copy()
    which, targets = [], []
    for k, d in enumerate(DIMENSIONS):
        number = np.unique([c[k] for c in cells], return_inverse=True)[1] if cells else np.zeros(0, int)
        sums = np.bincount(number, weights=tokens)
        power = sums ** temperatures[d]
        which.append(number)
        targets.append(power / power.sum() * sums.sum())
    for _ in range(rounds):
        for number, target in zip(which, targets, strict=True):
            raked = raked * target[number] / np.bincount(number, weights=raked)[number]
    rows = [(*c, float(r)) for c, r in zip(cells, raked, strict=True)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens double, raked double")


def _shares(values: list[str], sums: np.ndarray, temperature: float, given: dict[str, float] | None) -> np.ndarray:
    """Target shares of values: those given, and the rest split among the others by the power of their tokens. Without others the given ones count as weights."""
    power = sums**temperature
    if not given:
        return power / power.sum() if len(sums) else power
    fixed = np.array([v in given for v in values])
    out = np.array([float(given.get(v, 0.0)) for v in values])
    rest = 1.0 - out.sum()
    if not fixed.all() and rest > 0:
        out[~fixed] = rest * power[~fixed] / power[~fixed].sum()
    if out.min(initial=0.0) < 0 or out.sum() <= 0:
        raise ValueError("targets are shares, and those of the values that occur can't all be 0")
    return out / out.sum()


def _bounded(tokens: np.ndarray, most: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], rounds: int | None) -> tuple[np.ndarray, float]:
    """Raked tokens, at most `most`, after so many rounds or once the targets are met; and by how much of all tokens a target is missed beyond its tolerance."""
    free, kept, off = tokens.copy(), np.minimum(tokens, most), 0.0
    for _ in range((BOUNDED_ROUNDS if rounds is None else rounds) if len(tokens) else 0):
        for number, target in sides:
            step = target / np.maximum(np.bincount(number, weights=np.minimum(free, most)), 1e-300)
            free = np.clip(free * step[number], tokens * 1e-100, tokens * 1e100)
        kept = np.minimum(free, most)
        off = max((np.abs(np.bincount(n, weights=kept) / tokens.sum() - t / tokens.sum()) - TOLERANCE[0] * t / tokens.sum()).max() - TOLERANCE[1] for n, t in sides)
        if rounds is None and off <= 0:
            break
    return kept, max(off, 0.0)


def rake_bounded(cells: DataFrame, share: float = SHARE, temperatures: dict[str, float] | None = None, at_once: int = CELLS_AT_ONCE, targets: dict[str, dict[str, float]] | None = None, rounds: int | None = None) -> tuple[DataFrame, float]:
    """As rake, with raked at most tokens / share, and the share: factors of sources, languages and topics grow until the bounded cells sum up to the targets.

    A factor's step is the target over the sum with bounds, so that cells at their bound stay there and the others take what they miss. Where no mix of what there
    is meets the targets, the share is lowered until one does, unless the rounds are given. targets: by dimension and value, in place of powers of the
    tokens.
    """
    temperatures = temperatures or TEMPERATURES
    head = cells.limit(at_once + 1).collect()
    if len(head) <= at_once:
        rows = sorted((*[r[d] for d in DIMENSIONS], float(r["tokens"])) for r in head)
        tokens = np.array([c[3] for c in rows])
        sides = []
        for k, d in enumerate(DIMENSIONS):
            values, number = np.unique([c[k] for c in rows], return_inverse=True) if rows else (np.zeros(0, str), np.zeros(0, int))
            sides.append((number, _shares(values.tolist(), np.bincount(number, weights=tokens), temperatures[d], (targets or {}).get(d)) * tokens.sum()))
        while True:
            kept, residual = _bounded(tokens, tokens / share, sides, rounds)
            if rounds is not None or residual <= 0 or share < LEAST_SHARE:
                break
            share *= LOWERED
        _warned(residual)
        return cells.sparkSession.createDataFrame([(*c, float(r)) for c, r in zip(rows, kept, strict=True)], "source string, lang string, topic string, tokens double, raked double"), share
    out = cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"))
    for d in DIMENSIONS:
        out = out.join(_targets(out, d, temperatures[d], (targets or {}).get(d)), d)
    out = written(out, "raking")
    total = out.agg(F.sum("tokens")).first()[0]
    while True:
        kept, residual = _bounded_by_spark(out, total, share, rounds)
        if rounds is not None or residual <= 0 or share < LEAST_SHARE:
            break
        dropped(cells.sparkSession, kept)
        share *= LOWERED
    _warned(residual)
    return kept.select(*DIMENSIONS, "tokens", F.least("free", F.col("tokens") / share).alias("raked")), share


def _targets(cells: DataFrame, d: str, temperature: float, given: dict[str, float] | None) -> DataFrame:
    """(d, target_d): tokens wanted of each value of a dimension, by the rule of _shares."""
    sums = cells.groupBy(d).agg(F.sum("tokens").alias("n")).withColumn("power", F.pow("n", F.lit(temperature)))
    own = cells.sparkSession.createDataFrame(list((given or {}).items()), f"{d} string, given double")
    sums = sums.join(F.broadcast(own), d, "left")
    one = sums.agg(F.sum("n").alias("n"), F.sum("given").alias("given"), F.min("given").alias("least"), F.sum(F.when(F.col("given").isNull(), F.col("power"))).alias("powers")).first()
    fixed, rest = one["given"] or 0.0, 1.0 - (one["given"] or 0.0)
    others = rest / one["powers"] if one["powers"] and rest > 0 else 0.0
    whole = fixed + others * (one["powers"] or 0.0)
    if (one["least"] or 0.0) < 0 or whole <= 0:
        raise ValueError("targets are shares, and those of the values that occur can't all be 0")
    return sums.select(d, (F.coalesce("given", F.col("power") * others) / whole * one["n"]).alias(f"target_{d}"))


def _bounded_by_spark(cells: DataFrame, total: float, share: float, rounds: int | None) -> tuple[DataFrame, float]:
    """As _bounded, over cells with their targets: a table with `free`, of which at most tokens / share count, and what is missed."""
    spark, out, before, off = cells.sparkSession, cells.withColumn("free", F.col("tokens")), None, 0.0
    kept = F.least(F.col("free"), F.col("tokens") / share)
    last = BOUNDED_ROUNDS if rounds is None else rounds
    for r in range(1, last + 1):
        for d in DIMENSIONS:
            sums = out.groupBy(d).agg(F.sum(kept).alias("sum"))
            moved = F.col("free") * (F.col(f"target_{d}") / F.greatest("sum", F.lit(1e-300)))
            out = out.join(sums, d).withColumn("free", F.greatest(F.least(moved, F.col("tokens") * 1e100), F.col("tokens") * 1e-100)).drop("sum")
        ends = rounds is None or r == last
        if ends or r % PLAN_ROUNDS == 0:
            out = written(out, "raking")
            if before is not None:
                dropped(spark, before)
            before = out
        if ends:
            missed = None
            for d in DIMENSIONS:
                one = out.groupBy(d).agg(F.sum(kept).alias("kept"), F.first(f"target_{d}").alias("target"))
                one = one.select((F.abs(F.col("kept") / total - F.col("target") / total) - F.col("target") * (TOLERANCE[0] / total)).alias("off"))
                missed = one if missed is None else missed.unionByName(one)
            off = missed.agg(F.max("off")).first()[0] - TOLERANCE[1]
            if rounds is None and off <= 0:
                break
    return out, max(off, 0.0)


def _warned(residual: float) -> None:
    if residual > 0:
        warnings.warn(f"mixing: a marginal of the sample is off its target by {residual:.6f} of all tokens more than it may be", stacklevel=3)


def marginals(weighed: DataFrame, temperatures: dict[str, float] | None = None) -> DataFrame:
    """(dimension, value, wanted, expected) of weighed rows: the target share of each value, and its expected share of the sample's tokens."""
    temperatures = temperatures or TEMPERATURES
    cells = weighed.groupBy(*[F.coalesce(F.col(d), F.lit("")).alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").cast("double").alias("n"), F.sum(F.col("n_tokens") * F.col("chance")).alias("kept")).where("n > 0")
    out = None
    for d in DIMENSIONS:
        one = cells.groupBy(F.col(d).alias("value")).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).withColumn("power", F.pow("n", F.lit(temperatures[d])))
        whole = one.agg(F.sum("power").alias("powers"), F.sum("kept").alias("all"))
        one = one.crossJoin(F.broadcast(whole)).select(F.lit(d).alias("dimension"), "value", (F.col("power") / F.col("powers")).alias("wanted"), (F.col("kept") / F.col("all")).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def counted(docs: DataFrame, topic: Column, text_col: str = "text") -> DataFrame:
    """docs with topic, any expression over docs, and n_tokens."""
    return docs.drop("topic", "n_tokens").withColumn("topic", F.coalesce(topic, F.lit(""))).withColumn("n_tokens", tokens_of(F.col(text_col)))


def weigh(rows: DataFrame, id_col: str = "doc_id", share: float = SHARE, rounds: int | None = None, bounded: bool = True, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Counted rows with weight (raked over own tokens of the cell), chance and stays.

    The cells meet the rows in a broadcast join only if Spark finds them small; else in a join that can be split.
    """
    rows = rows.drop("weight", "chance", "stays")
    keys = [F.coalesce(F.col(d), F.lit("")) for d in DIMENSIONS]
    cells = written(rows.groupBy(*[k.alias(d) for k, d in zip(keys, DIMENSIONS, strict=True)]).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    raked, share = rake_bounded(cells, share, targets=targets, rounds=rounds) if bounded else (rake(cells, rounds or ROUNDS), share)
    raked = raked.select(*[F.col(d).alias(f"_cell_{d}") for d in DIMENSIONS], (F.col("raked") / F.col("tokens")).alias("_cell_factor"))
    met = rows.join(raked, [k == F.col(f"_cell_{d}") for k, d in zip(keys, DIMENSIONS, strict=True)], "left")
    weight = F.when(F.col("n_tokens") > 0, F.coalesce("_cell_factor", F.lit(0.0))).otherwise(0.0)
    out = met.withColumn("weight", weight).withColumn("chance", F.least(F.lit(1.0), F.col("weight") * share)).withColumn("stays", uniform(F.col(id_col)) < F.col("chance"))
    return out.drop(*[f"_cell_{d}" for d in DIMENSIONS], "_cell_factor")


def oracle_sql(share: float, rounds: int) -> str:
    """The same in SQL for given rounds: bounded raking as a chain of common table expressions."""
    size = "greatest(length(text), 1)"
    symbols = r"length(regexp_replace(text, '[^#$%&*!|=<>{}\[\]]', '', 'g'))"
    parts = [
        f"""rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          CASE WHEN text IS NULL THEN 'long'
               WHEN {symbols}::DOUBLE / {size} >= 0.08 THEN 'symbols'
               WHEN length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / {size} >= 0.5 THEN 'capitals'
               WHEN {size}::DOUBLE / (length(regexp_replace(text, '[^\\n]', '', 'g')) + 1) < 60 THEN 'lines'
               WHEN {size} < 2000 THEN 'short' ELSE 'long' END AS topic,
          coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS (SELECT {d}, pow(n, {TEMPERATURES[d]}) / (sum(pow(n, {TEMPERATURES[d]})) OVER ()) * (sum(n) OVER ()) AS target FROM (SELECT {d}, sum(tokens) AS n FROM c GROUP BY {d}))")
    parts.append("r0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens AS raked FROM c)")
    step = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"r{step + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, greatest(least(r.raked * t.target / sum(least(r.raked, r.tokens / {share})) OVER (PARTITION BY r.{d}), r.tokens * 1e100), r.tokens * 1e-100) AS raked FROM r{step} r JOIN t_{d} t USING ({d}))")
            step += 1
    return f"""WITH {", ".join(parts)},
      w AS (SELECT doc_id, rows.source, rows.lang, rows.topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(least(raked, tokens / {share}) / tokens, 0.0) ELSE 0.0 END AS weight
            FROM rows LEFT JOIN r{step} r ON rows.source = r.source AND rows.lang = r.lang AND rows.topic = r.topic)
      SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, weight * {share}), 6) AS chance,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < least(1.0, weight * {share}) AS stays FROM w"""
