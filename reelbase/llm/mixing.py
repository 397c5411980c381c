"""Temperature mixing of sources, in DataFrame functions only.

Source weights are token shares to the power alpha. alpha is bisected on dyadic steps to the largest value (up to
MOST_ALPHA) at which the weights' entropy reaches a target, or to the smallest at which no source is repeated more
often than a limit. Sources may be many: sums over them are aggregates, each for several trial exponents at once. The
mixture's budget is the least with which every source that has tokens is seen in full, so weighting up
repeats documents and drops none, unless a budget is given. A source's documents are dealt into hashed blocks; each
pass over the source is a permutation of its blocks, and the last, partial pass takes blocks in its permuted order
until the quota is met, documents of the last block in hashed order.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged

#: Documents of a block on average, and the most blocks that a source has.
BLOCK_DOCS, MOST_BLOCKS = 1024, 65_536
STEPS = 30
#: The largest exponent that is tried for an entropy, and bisections that one pass over the sources decides.
MOST_ALPHA, AT_ONCE = 4, 5
WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column) -> Column:
    """A whole number below 2^32 from the texts of the parts; nulls count as the text of none."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None, repetition_limit: float | None) -> DataFrame:
    """One row (alpha) from (source, tokens, ...); 1 where no source has tokens."""
    x = sources.where("tokens > 0").agg(F.max("tokens").cast("double").alias("top"), F.min("tokens").cast("double").alias("low"))
    if target_entropy is not None:
        return x.select(F.lit(entropy_exponent(sources.where("tokens > 0"), float(target_entropy))).alias("alpha"))
    # the ratio of passes over the rarest and the commonest source falls as alpha rises
    met = f"pow(top / low, 1D - m) <= {float(repetition_limit or 1.0)!r}D"
    move = f"if({met}, named_struct('lo', s.lo, 'hi', m), named_struct('lo', m, 'hi', s.hi))"
    halve = f"(s, i) -> element_at(transform(array((s.lo + s.hi) / 2), m -> {move}), 1)"
    return x.select(F.expr(f"if(top IS NULL, 1D, aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), {halve}, s -> s.hi))").alias("alpha"))


def entropy_exponent(sources: DataFrame, target: float) -> float:
    """The largest alpha whose weights still reach the entropy, which falls as alpha rises.

    A pass sums over the sources for all exponents that the next bisections may try (a fixed number of sums). An
    entropy that no exponent between 0 and MOST_ALPHA gives is an error.
    """
    top = sources.agg(F.max("tokens").cast("double")).first()[0]
    if top is None:
        return 1.0

    def entropies(alphas: list[float]) -> list[float]:
        w = [F.pow(F.col("tokens") / top, F.lit(a)) for a in alphas]
        row = sources.agg(*[f for x in w for f in (F.sum(x), F.sum(x * F.log(x)))]).first()
        return [log(z) - u / z for z, u in zip(row[::2], row[1::2])]

    lo, hi = 0.0, float(MOST_ALPHA)
    most, least = entropies([lo, hi])
    if not least - 1e-9 <= target <= most + 1e-9:
        raise ValueError(f"the sources' entropy can be {least:.4f} to {most:.4f}, not {target}")
    for done in range(0, STEPS, AT_ONCE):
        cells = 1 << min(AT_ONCE, STEPS - done)
        grid = [lo + (hi - lo) * k / cells for k in range(1, cells)]
        reached = sum(e >= target for e in entropies(grid))
        lo, hi = ([lo, *grid][reached], [*grid, hi][reached])
    return lo


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy: float | None, repetition_limit: float | None, budget_tokens: int | None, seed: int) -> DataFrame:
    """Distinct (m_id, m_source, m_tokens) with alpha, weight, block, place and copies."""
    units = staged(
        docs.select(col(id_col).alias("m_id"), col(source_col).alias("m_source"), tokens_of(text_col).alias("m_tokens")).groupBy("m_id", "m_source", "m_tokens").agg(F.count("*").alias("rows")), "mixing-units"
    )
    totals = staged(units.groupBy("m_source").agg(F.sum(F.col("m_tokens") * F.col("rows")).alias("tokens"), F.count("*").alias("units")), "mixing-sources")
    alpha = exponent(totals, target_entropy, repetition_limit)
    top = totals.agg(F.max("tokens").cast("double").alias("top"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).cast("double").alias("low"))
    # weights relative to the source that has the fewest passes: the largest, or the smallest where alpha is over 1
    x = totals.join(F.broadcast(alpha), F.lit(True)).join(F.broadcast(top), F.lit(True)).withColumn("top", F.when(F.col("alpha") > 1, F.col("low")).otherwise(F.col("top")))
    x = x.withColumn("share", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("top"), F.col("alpha"))).otherwise(0.0))
    x = staged(x, "mixing-shares")
    x = x.join(F.broadcast(x.agg(F.sum("share").alias("whole"))), F.lit(True))
    x = x.withColumn("weight", F.when(F.col("whole") > 0, F.col("share") / F.col("whole")).otherwise(0.0))
    quota = F.col("share") * F.col("top") if budget_tokens is None else F.col("weight") * float(budget_tokens)
    x = x.withColumn("quota", F.round(F.round(quota, 3)).cast("long")).withColumn("full", F.expr("if(tokens > 0, quota div tokens, 1)"))
    x = x.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("full") * F.col("tokens")).otherwise(0))
    x = x.withColumn("blocks", F.least(F.ceil(F.col("units") / BLOCK_DOCS), F.lit(MOST_BLOCKS)).cast("long"))
    budget = staged(x.select(F.col("m_source").alias("b_source"), "alpha", "weight", "full", "rest", "blocks"), "mixing-budget")

    y = units.join(budget, F.col("m_source").eqNullSafe(F.col("b_source"))).withColumn("h", digest(F.lit(seed), F.col("m_id"), F.col("m_tokens")))
    y = y.withColumn("block", F.col("h") % F.col("blocks"))
    sizes = y.groupBy("m_source", "block").agg(F.sum(F.col("m_tokens") * F.col("rows")).alias("size"), F.max("full").alias("full"))
    turn = Window.partitionBy("m_source").orderBy("key", "block")
    sizes = sizes.withColumn("key", digest(F.lit(seed), F.col("m_source"), F.col("full"), F.col("block"))).select(
        F.col("m_source").alias("s_source"), F.col("block").alias("s_block"), F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    y = y.join(staged(sizes, "mixing-blocks"), F.col("m_source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    inside = Window.partitionBy("m_source", "block").orderBy("h", "m_id", "m_tokens")
    y = y.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.col("before") + F.sum(F.col("m_tokens") * F.col("rows")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    more = (F.col("rest") > 0) & (F.col("m_tokens") > 0) & (F.col("upto") <= F.col("rest"))
    return y.select("m_id", "m_source", "m_tokens", "alpha", F.round("weight", 9).alias("weight"), "block", F.col("place").cast("long").alias("place"), (F.col("full") + more.cast("long")).alias("copies"))


def tokens_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, repetition_limit: float | None = 1.5, budget_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(<id>, source, n_tokens, alpha, weight, block, place, copies): how often each document is in the mixture.

    Rows that agree in id, source and number of words are one unit and get the same copies (one output row for
    them). Cases: null and empty texts have no words, weigh nothing and get as many copies as their source has
    whole passes (one where the source has no words at all); a null source is a source, a null id an id; ties
    in hashed order are broken by id and words; an empty table gives no rows; other columns are ignored.
    """
    x = plan(docs, id_col, text_col, source_col, target_entropy, repetition_limit, budget_tokens, seed)
    return x.select(F.col("m_id").alias(id_col), F.col("m_source").alias("source"), F.col("m_tokens").alias("n_tokens"), "alpha", "weight", "block", "place", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Docs realised by the plan: each row as often as its copies; same columns."""
    p = mix_plan(docs, id_col, text_col, source_col, **options).select(col(id_col).alias("m__id"), F.col("source").alias("m__source"), F.col("n_tokens").alias("m__tokens"), F.col("copies").alias("m__copies"))
    p = staged(p, "mixing-plan")
    x = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("m__row"), col(id_col).alias("id"), col(source_col).alias("source"), tokens_of(text_col).alias("words"))
    key = F.col("id").eqNullSafe(F.col("m__id")) & F.col("source").eqNullSafe(F.col("m__source")) & (F.col("words") == F.col("m__tokens"))
    # a merge join at every size: were small plans broadcast, cost would jump where they outgrow that
    x = x.join(p.hint("merge"), key)
    return x.withColumn("m__copy", F.explode(F.expr("slice(sequence(1L, greatest(m__copies, 1L)), 1, int(m__copies))"))).select(*[F.col("m__row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _digest(*parts: str) -> str:
    text = " || '|' || ".join(f"coalesce(({p})::VARCHAR, '~')" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


SQL = rf"""
WITH RECURSIVE u AS (SELECT doc_id, source, n_tokens, count(*) AS n FROM
  (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents) GROUP BY ALL),
t AS (SELECT source, sum(n_tokens * n)::BIGINT AS tokens, count(*) AS units FROM u GROUP BY source),
m AS (SELECT max(tokens)::DOUBLE AS top, min(CASE WHEN tokens > 0 THEN tokens END)::DOUBLE AS low FROM t),
b(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 1.5 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 1.5 THEN (lo + hi) / 2 ELSE hi END FROM b, m WHERE i < {STEPS}),
a AS (SELECT hi AS alpha FROM b WHERE i = {STEPS}),
s AS (SELECT t.*, alpha, top, CASE WHEN tokens > 0 THEN pow(tokens / top, alpha) ELSE 0 END AS share FROM t, a, m),
q AS (SELECT *, share / sum(share) OVER () AS weight, round(round(share * top, 3))::BIGINT AS quota FROM s),
g AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, least(ceil(units / {BLOCK_DOCS}), {MOST_BLOCKS})::BIGINT AS blocks FROM q),
f AS (SELECT *, CASE WHEN tokens > 0 THEN quota - passes * tokens ELSE 0 END AS rest FROM g),
d AS (SELECT u.*, f.* EXCLUDE (source), {_digest('0', 'doc_id', 'n_tokens')} AS h FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source),
e AS (SELECT *, h % blocks AS block FROM d),
z AS (SELECT source, block, sum(n_tokens * n) AS size, {_digest('0', 'source', 'max(passes)', 'block')} AS key FROM e GROUP BY source, block),
y AS (SELECT source, block, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
x AS (SELECT e.*, row_number() OVER w AS place, before + sum(n_tokens * n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM e JOIN y ON e.source IS NOT DISTINCT FROM y.source AND e.block = y.block WINDOW w AS (PARTITION BY e.source, e.block ORDER BY h, doc_id, n_tokens))
SELECT doc_id, source, n_tokens, alpha, round(weight, 9) AS weight, block, place, passes + CASE WHEN rest > 0 AND n_tokens > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM x
"""
