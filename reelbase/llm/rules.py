"""Quality rules with adaptive thresholds, in DataFrame functions only.

One pass over the texts makes whole-number statistics of each document. Quantile sketches are counts of
logarithmic buckets (exact below 64, then 32 buckets to a doubling), per language, source and statistic: counts of
two sketches add up, so sketches of small groups are merged into their language's, then into the whole corpus's.
A sketch holds the documents that pass the base rule; of statistics that are zero for most clean documents but not
wrong in themselves (repetition) only those that aren't zero. A cutoff is the upper quartile plus some interquartile
ranges; the range counts as a small least value where all are alike. Cutoffs are joined back to the statistics.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged

SPACE = r"[\x20\x09-\x0D]"
#: Rows that a group's sketch must have, else the next coarser one is used.
LEAST_ROWS = 200


class Rule(NamedTuple):
    """A statistic, unit * n div of, with the population of its sketch and the width of its fence."""

    n: str
    of: str
    unit: int
    nonzero: bool
    ranges: int
    #: Least interquartile range, in the statistic's unit.
    least: int


#: symbols, dup_lines, repeats and upper are in thousandths, word_length in hundredths of a character.
RULES = {
    "symbols": Rule("n_symbols", "word_chars", 1000, False, 4, 5),
    "dup_lines": Rule("n_dup_lines", "n_lines", 1000, True, 2, 20),
    "repeats": Rule("n_repeat_words", "n_words", 1000, True, 2, 20),
    "upper": Rule("n_upper", "word_chars", 1000, False, 4, 8),
    "word_length": Rule("word_chars", "n_words", 100, False, 4, 30),
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, k: int = 8) -> Column:
    """Number of words within k-word windows that occur at least twice in the array."""
    hashes = F.when(F.size(words) > k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))

    def covered(win: Column) -> Column:
        marked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(marked, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda s, p: F.struct((p + k).alias("end"), (s["n"] + k - F.greatest(s["end"] - p, F.lit(0))).alias("n"))
        return F.aggregate(at, start, step, lambda s: s["n"])

    return F.coalesce(let(hashes, lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(0)), F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of whole numbers for each row of docs; a null text is empty."""
    x = docs.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(source_col).alias("source"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    x = x.withColumn("words", F.array_remove(F.split("t", SPACE + "+", -1), ""))
    x = x.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    return x.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )


def per(n: str, of: str, unit: int) -> Column:
    return F.expr(f"({unit} * {n}) div greatest({of}, 1)")


def bucket(x: Column) -> Column:
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", x, e)).cast("long")


def bucket_floor(b: Column) -> Column:
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - e * 32, e)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def cutoffs(rates: DataFrame, rules: dict[str, Rule], least_rows: int) -> DataFrame:
    """(c_lang, c_source, c_<statistic>...): cutoffs of every language and source, from sketches over all rows."""
    counts = lambda k, r: F.when(F.col("failed") | (F.col(k) == 0 if r.nonzero else F.lit(False)), 0).otherwise(1)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), bucket(F.col(k)).alias("bucket"), counts(k, r).alias("n")) for k, r in rules.items()]))
    sketch = staged(rates.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.stat", "x.bucket").agg(F.sum("x.n").alias("n")), "rules-sketch")
    ranges = F.create_map(*[F.lit(x) for k, r in rules.items() for x in (k, r.ranges)])
    least = F.create_map(*[F.lit(x) for k, r in rules.items() for x in (k, r.least)])

    def fences(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "stat", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "stat")
        x = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
        q = lambda k: bucket_floor(F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket"))))
        name = "_".join(["cut", *keys])
        found = x.groupBy(*keys, "stat").agg(F.max("all").alias("n"), q(3).alias("q3"), q(1).alias("q1"))
        found = found.select(*keys, "stat", F.struct("n", (F.col("q3") + ranges[F.col("stat")] * F.greatest(F.col("q3") - F.col("q1"), least[F.col("stat")])).alias("cut")).alias(name))
        return reduce(lambda d, k: d.withColumnRenamed(k, f"{name}_{k}"), [*keys, "stat"], found)

    own, lang, whole = fences(["lang", "source"]), fences(["lang"]), fences([])
    x = own.join(lang, own["cut_lang_source_lang"].eqNullSafe(lang["cut_lang_lang"]) & (own["cut_lang_source_stat"] == lang["cut_lang_stat"]))
    x = x.join(whole, F.col("cut_lang_source_stat") == F.col("cut_stat"))
    chosen = F.when(F.col("cut_lang_source.n") >= least_rows, F.col("cut_lang_source.cut")).when(F.col("cut_lang.n") >= least_rows, F.col("cut_lang.cut")).otherwise(F.col("cut.cut"))
    x = x.select(F.col("cut_lang_source_lang").alias("c_lang"), F.col("cut_lang_source_source").alias("c_source"), F.col("cut_lang_source_stat").alias("stat"), chosen.alias("cut"))
    return x.groupBy("c_lang", "c_source").agg(*[F.max(F.when(F.col("stat") == k, F.col("cut"))).alias(f"c_{k}") for k in rules])


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: dict[str, Rule] | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(<id>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules) for every row of docs.

    kept is false if the base rule fails (fewer than 20 words, or over 30 % of the words repeated) or if a
    statistic is above its adaptive cutoff; failed_rules names those statistics. Cases: null and empty texts have no
    words and fail the base rule; null languages or sources are a group of their own; ids may repeat or be null, rows
    are judged one by one; groups with few rows in a sketch use coarser ones (an empty one has quartiles of zero); an
    empty table gives no rows; other columns are ignored.
    """
    rules = rules or RULES
    stats = staged(statistics(docs, id_col, text_col, lang_col, source_col), "rules-stats")
    rates = stats.withColumns({k: per(r.n, r.of, r.unit) for k, r in rules.items()} | {"failed": base_failed()})
    cuts = staged(cutoffs(rates, rules, least_rows), "rules-cuts")
    x = rates.join(cuts, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source")))
    above = F.concat_ws(",", *[F.when(F.col(k) > F.col(f"c_{k}"), k) for k in rules])
    return x.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"), (~F.col("failed") & (above == "")).alias("kept"), above.alias("failed_rules"))


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rate = ", ".join(f"({r.unit} * {r.n}) // greatest({r.of}, 1) AS {k}" for k, r in RULES.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS stat, {k} AS x, CASE WHEN base_failed{f' OR {k} = 0' if r.nonzero else ''} THEN 0 ELSE 1 END AS n FROM r" for k, r in RULES.items())
    floor = lambda b: f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1)::INT END)"
    of = lambda f: "CASE stat " + " ".join(f"WHEN '{k}' THEN {f(r)}" for k, r in RULES.items()) + " END"

    def fences(keys: str, name: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""{name}_m AS (SELECT {k}stat, bucket, sum(n)::BIGINT AS n FROM sk GROUP BY ALL),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {k}stat ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}stat) AS total FROM {name}_m),
{name}_b AS (SELECT {k}stat, max(total) AS n, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS b3, min(CASE WHEN upto * 4 >= total THEN bucket END) AS b1 FROM {name}_u GROUP BY ALL),
{name} AS (SELECT {k}stat, n, {floor('b3')} + {of(lambda r: r.ranges)} * greatest({floor('b3')} - {floor('b1')}, {of(lambda r: r.least)}) AS cut FROM {name}_b)"""

    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i+7], ' ')) AS n FROM g),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM g2 WHERE n > 1) GROUP BY 1),
s AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, {rate}, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM s),
e AS ({each}),
eb AS (SELECT *, greatest(length(bin(x)) - 6, 0) AS e FROM e),
sk AS (SELECT lang, source, stat, e * 32 + (x >> e::INT) AS bucket, sum(n)::BIGINT AS n FROM eb GROUP BY ALL),
{fences('lang, source', 'own')},
{fences('lang', 'byl')},
{fences('', 'whole')},
c AS (SELECT o.lang, o.source, o.stat, CASE WHEN o.n >= {LEAST_ROWS} THEN o.cut WHEN byl.n >= {LEAST_ROWS} THEN byl.cut ELSE whole.cut END AS cut
  FROM own o JOIN byl ON o.lang IS NOT DISTINCT FROM byl.lang AND o.stat = byl.stat JOIN whole ON o.stat = whole.stat),
p AS (SELECT lang, source, {', '.join(f"max(CASE WHEN stat = '{k}' THEN cut END) AS c_{k}" for k in RULES)} FROM c GROUP BY ALL),
j AS (SELECT r.*, concat_ws(',', {', '.join(f"CASE WHEN {k} > c_{k} THEN '{k}' END" for k in RULES)}) AS failed_rules
  FROM r JOIN p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j
"""


SQL = _sql()
