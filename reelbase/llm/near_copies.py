"""Near copies: SimHash by the generalised pigeonhole principle, checked on whole texts, and the exact join of what fingerprints leave apart.

The fourth operator's method for a similarity of 0.8 over five-word shingles:

1. each text's fingerprint over five-word shingles; bits are grouped into partitions whose thresholds come from dynamic programming, and
   fingerprints within ``max_bits`` of each other meet under a partition's value and are verified on all 64 bits (``simhash.links``);
2. what fingerprints link is checked on the whole sets of shingles: texts of equal fingerprints, and of linked ones, join only where
   they have the similarity;
3. at 0.8 two texts' fingerprints differ in about 10 of 64 bits, and some in 20, which random pairs do once in 550, so no radius that
   can be paid for reaches all pairs. The links between what is still apart are found by the pigeonhole on the sets themselves
   (``ngram_join``), exactly: nothing is missed, and texts that share much without being similar, as by a licence or a form, make no
   candidates, however many they are.

Components and the document that stays are found as for fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, staged
from .ngram_join import class_labels
from .simhash import fingerprints, links, numbered, one_of_labels


def proposed(rows: DataFrame, sets: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(u, v): pairs of set digests, of (uid, t) and sets (id.uid, digest), whose texts' fingerprints are equal or linked."""
    fps = fingerprints(rows, "uid", "t", words)
    of = sets.where("n > 0").select(F.col("id.uid").alias("id"), "digest").join(fps.hint("merge"), "id").select("digest", "fp").distinct()
    of = staged(of, "copies-fingerprints")
    least = staged(of.groupBy("fp").agg(F.min("digest").alias("least")), "copies-classes")
    equal = of.join(least, "fp").select(F.col("least").alias("u"), F.col("digest").alias("v"))
    near = staged(links(least, max_bits), "copies-near")
    ends = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return staged(equal.unionByName(ends).where("u != v").distinct(), "copies-proposed")


def labelled(rows: DataFrame, words: int, percent: int, max_bits: int) -> DataFrame:
    """(id, uid, digest, label) of rows (id, uid, t); texts without words are one class."""
    sets, labels = class_labels(rows.select(F.struct("id", "uid").alias("id"), "t"), words, percent, lambda sets: proposed(rows, sets, words, max_bits))
    named = sets.select("id.*", F.coalesce("digest", F.lit(0)).alias("digest")).join(labels.toDF("digest", "label"), "digest", "left")
    return named.select("id", "uid", "digest", F.coalesce("label", "digest").alias("label"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, max_bits: int = 4) -> DataFrame:
    """(<id>, component_id) for every row of docs: the smallest id reachable over pairs of similarity percent / 100 or more.

    Cases: null and empty texts (and white space) have equal, empty sets; null ids are ignored by the minimum; repeated rows
    come back as often as they came in; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = staged(labelled(numbered(docs.select(col(id_col), col(text_col)), id_col, text_col), words, percent, max_bits), "copies-labels")
    least = rows.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows.join(least, "label").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, max_bits: int = 4) -> DataFrame:
    """Docs with one document of each component; same columns. Which row stays, and the cases: as for fingerprints."""
    rows = numbered(docs, id_col, text_col)
    return one_of_labels(docs, rows, labelled(rows, words, percent, max_bits), "digest", id_col, text_col)
