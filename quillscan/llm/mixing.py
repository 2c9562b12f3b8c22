"""Operator 1 (native): mixing sources to target weights by iterative proportional fitting.

Token counts are summed in the cells of (source, language, topic); the cell weights are raked until their marginals
meet the targets of all three, and documents are sampled with the calibrated probabilities that follow. A document's
token count is its number of runs of characters other than white space.

Targets are given for each margin as a dict of shares or as a temperature: a margin's natural shares to that power, scaled to one.
Raking scales the weights of one margin after the other, up to `rounds` times, and stops when no marginal is off by more than CLOSE. It works on the table of cells, whose size the
numbers of sources, languages and topics bound, and writes it to the shared folder every few rounds, which keeps the plans short.

The expected number of sampled tokens is `budget` times all tokens, in the proportions of the raked weights; a cell whose
probability would exceed one is taken whole and the rest is scaled up for it, so that the budget is met as far as
the documents allow. A document is taken when a number in [0, 1) derived from its id alone is below its cell's probability: the same at every
size and in every partitioning.

Topics: a given column, or else bands of document length. Defined results: an empty table gives no rows, and very long texts are counted whole. Nulls in source, language or topic form cells of
their own (written as the empty string); a null text has no tokens; documents without tokens have their cell's
probability, and if a cell has no tokens at all, zero. Categories without a target get weight zero; targets for categories that don't
occur are left out and the others scaled to one. Repeated rows share their id's fate, null ids share one. Extra columns are ignored by `weigh` and
kept by `sample`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.llm.common import free_names, materialize

MARGINS = ("source", "lang", "topic")
#: Upper ends, in tokens, of the default topics' bands.
BANDS = (("short", 150), ("medium", 600))
#: A marginal's distance from its target at which raking ends.
CLOSE = 1e-13
#: One beyond which unmet targets are reported.
MET = 1e-6
Target = dict[str, float] | float


def token_count(text: Column) -> Column:
    """Runs of other characters than the six ASCII white-space characters."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))).cast("long")


def _keyed(docs: DataFrame, topic: str | None) -> tuple[DataFrame, list[str]]:
    """docs with its tokens and the three margins, and these columns' names, which no column of docs has."""
    tokens, *names = free_names(docs, "__tokens", *(f"__{m}" for m in MARGINS))
    have = docs.withColumn(tokens, token_count(F.col("text").cast("string")))
    band = F.lit("long")
    for name, most in reversed(BANDS):
        band = F.when(F.col(tokens) <= most, name).otherwise(band)
    for m, name in zip(MARGINS, names, strict=True):
        own = band if m == "topic" and topic is None else F.col(topic if m == "topic" else m).cast("string")
        have = have.withColumn(name, F.coalesce(own, F.lit("")))
    return have, [tokens, *names]


def _targets(cells: DataFrame, margin: str, target: Target) -> DataFrame:
    """(margin, share) over the categories that have tokens."""
    found = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0")
    if isinstance(target, dict):
        shares = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]) if target else F.create_map().cast("map<string,double>")
        found = found.withColumn("raw", F.coalesce(F.try_element_at(shares, F.col(margin)), F.lit(0.0)))
    else:
        found = found.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(float(target))))
    total = found.agg(F.sum("raw")).first()[0] or 1.0
    return found.select(margin, (F.col("raw") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int = 24, every: int = 4) -> DataFrame:
    """cells(source, lang, topic, docs, tokens) with `weight`: raked shares that sum to one. Targets that can't all be met (cells that they need are
    missing) leave the weights of the last round, with a warning that says how far off they are; `residual` tells it, too."""
    out = cells
    for m in MARGINS:
        out = out.join(_targets(cells, m, targets[m]).withColumnRenamed("share", f"t_{m}"), m, "left")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = materialize(out.withColumn("weight", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total)).otherwise(0.0)), "cells")
    off = 0.0
    for done in range(1, rounds + 1):
        for m in MARGINS:
            held = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.coalesce(f"t_{m}", F.lit(0.0)) / held).otherwise(0.0))
        if done % every == 0 or done == rounds:
            out = materialize(out, "cells")
            off = residual(out)
            if off <= CLOSE:
                break
    if off > MET:
        warnings.warn(f"targets not met after {rounds} rounds: a marginal is {off:.3g} of all weight away from its own", stacklevel=2)
    return out.select(*MARGINS, "docs", "tokens", "weight")


def residual(cells: DataFrame) -> float:
    """The largest distance of a marginal of cells(..., weight, t_source, t_lang, t_topic) from its target, as a share of all weight."""
    off = [cells.groupBy(m).agg((F.sum("weight") - F.coalesce(F.first(f"t_{m}"), F.lit(0.0))).alias("d")).select("d") for m in MARGINS]
    return off[0].unionByName(off[1]).unionByName(off[2]).agg(F.max(F.abs("d"))).first()[0] or 0.0


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with `probability`, such that the expected tokens are the budget's share of all, if there are as many.

    Cells that the scale would lift above one are taken whole, and the scale of the rest rises for it: (wanted - their tokens) /
    (weight of the rest). As it only rises, each step takes at least the cells of the one before, and a few steps end it. A step is one
    aggregate over the cells; the driver gets its sums."""
    cells = cells.withColumn("density", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    held = F.col("density") > 0
    wanted = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    least, taken = None, -1  # the scale so far, and how many cells it takes whole
    while True:
        whole = F.lit(False) if least is None else held & (F.col("density") * F.lit(least) > 1)
        r = cells.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens"))).alias("t"), F.sum(F.when(held & ~whole, F.col("weight"))).alias("w")).first()
        if r["n"] <= taken or not r["w"]:
            break
        taken, least = r["n"], max(wanted - (r["t"] or 0), 0.0) / r["w"]
    chance = F.lit(0.0) if least is None else F.when(whole, 1.0).otherwise(F.least(F.lit(1.0), F.col("density") * F.lit(least)))
    return cells.withColumn("probability", F.round(F.when(held, chance).otherwise(0.0), 9)).select(*MARGINS, "docs", "tokens", "weight", "probability")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


DEFAULT_TARGETS: dict[str, Target] = {"source": 0.7, "lang": 0.8, "topic": 1.0}


def _placed(docs: DataFrame, targets: dict[str, Target], budget: float, topic: str | None, rounds: int, seed: int) -> tuple[DataFrame, list[str]]:
    """docs with tokens, margins, probability, weight and whether it is sampled, and these columns' names."""
    keyed, (tokens, *margins) = _keyed(docs, topic)
    p, w, taken = free_names(keyed, "__p", "__w", "__sampled")
    cells = keyed.groupBy(*[F.col(c).alias(m) for c, m in zip(margins, MARGINS, strict=True)]).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("tokens"))
    chance = calibrate(rake(materialize(cells, "cells"), targets, rounds), budget)
    chance = chance.select(*[F.col(m).alias(c) for c, m in zip(margins, MARGINS, strict=True)], F.col("probability").alias(p), F.col("weight").alias(w))
    # The cells are aggregates of three category columns; Spark broadcasts them while they are small and shuffles otherwise.
    return keyed.join(chance, margins, "left").withColumn(taken, draw(F.col("doc_id"), seed) < F.col(p)), [tokens, *margins, p, w, taken]


def weigh(docs: DataFrame, targets: dict[str, Target] = DEFAULT_TARGETS, budget: float = 0.5, topic: str | None = None, rounds: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, n_tokens, topic, cell_weight, probability, sampled for every row of docs."""
    own = [c for c in dict.fromkeys(("doc_id", "text", "source", "lang", topic)) if c]
    out, (tokens, _, _, band, p, w, taken) = _placed(docs.select(*own), targets, budget, topic, rounds, seed)
    return out.select(F.col("doc_id").cast("long"), F.col(tokens).alias("n_tokens"), F.col(band).alias("topic"), F.round(w, 9).alias("cell_weight"), F.col(p).alias("probability"), F.col(taken).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, Target] = DEFAULT_TARGETS, budget: float = 0.5, topic: str | None = None, rounds: int = 24, seed: int = 17) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    out, names = _placed(docs, targets, budget, topic, rounds, seed)
    return out.where(F.col(names[-1])).select(*docs.columns)


def oracle_sql(budget: float = 0.5, rounds: int = 24, seed: int = 17) -> str:
    """`weigh` with the default targets and topics for DuckDB."""
    band = "".join(f"WHEN n_tokens <= {most} THEN '{name}' " for name, most in BANDS)
    scaled = lambda prior, m: f"SELECT source, lang, topic, docs, tokens, t_source, t_lang, t_topic, it, CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * coalesce(t_{m}, 0) / sum(weight) OVER (PARTITION BY {m}) ELSE 0 END AS weight FROM ({prior})"
    step = scaled(scaled(scaled("SELECT * REPLACE (it + 1 AS it) FROM raked WHERE it < " + str(rounds), "source"), "lang"), "topic")
    targets = ", ".join(f"t_{m} AS (SELECT {m}, n ** {float(DEFAULT_TARGETS[m])} / sum(n ** {float(DEFAULT_TARGETS[m])}) OVER () AS t_{m} FROM (SELECT {m}, sum(tokens)::DOUBLE AS n FROM cells GROUP BY {m}) WHERE n > 0)" for m in MARGINS)
    return f"""
WITH RECURSIVE counted AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens FROM documents),
keyed AS (SELECT *, CASE {band}ELSE 'long' END AS topic FROM counted),
cells AS (SELECT source, lang, topic, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM keyed GROUP BY source, lang, topic),
{targets},
raked AS (SELECT source, lang, topic, docs, tokens, t_source, t_lang, t_topic, 0 AS it, CASE WHEN tokens > 0 THEN tokens / sum(tokens) OVER () ELSE 0 END AS weight
    FROM cells LEFT JOIN t_source USING (source) LEFT JOIN t_lang USING (lang) LEFT JOIN t_topic USING (topic)
  UNION ALL SELECT * FROM ({step})),
dense AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS density FROM raked WHERE it = {rounds}),
ordered AS (SELECT *, row_number() OVER w AS k, ({budget} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM dense WINDOW w AS (ORDER BY density DESC, source, lang, topic)),
chosen AS (SELECT *, min(CASE WHEN density > 0 AND scale * density <= 1 THEN k END) OVER () AS right_k FROM ordered),
scaled AS (SELECT *, min(CASE WHEN k = right_k THEN scale END) OVER () AS right_scale FROM chosen),
chance AS (SELECT source, lang, topic, weight, round(greatest(CASE WHEN density = 0 THEN 0.0 WHEN right_k IS NULL OR k < right_k THEN 1.0 ELSE least(1.0, right_scale * density) END, 0.0), 9)::DOUBLE AS probability FROM scaled)
SELECT doc_id, n_tokens, topic, round(weight, 9) AS cell_weight, probability,
  ('0x' || substring(md5('{seed}/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << 52)} < probability AS sampled
FROM keyed JOIN chance USING (source, lang, topic)"""
