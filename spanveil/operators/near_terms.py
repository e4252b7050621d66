"""Phrases that are nearly allowlisted terms, by an index join instead of a loop over terms.

A pair is near if first characters are equal, lengths and word counts differ
little, and the ratio of matching blocks is high enough: of T characters in both
at most E = (1 - ratio) * T are left over. So if the term is cut into E + 1
pieces, one stands unchanged in the phrase, moved by no more than what is left
over before it. Pieces and the phrase's substrings in those places are joined on
equality; the ratio is taken only for pairs that share one. No near pair is lost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import bound
from spanveil.functions.text import phrase_words, runs
from spanveil.operators import names
from spanveil.shipping import ship

#: Lengths of a near pair differ by so much at most (see ``names.like_a_term``).
SLACK = 3


def _limits(many: Column) -> tuple[Column, Column]:
    """(share of characters that may be left over, greatest difference of lengths)."""
    return F.when(many, 0.10).otherwise(0.05), F.when(many, SLACK).otherwise(SLACK - 1)


def _left_over(share: Column, total: Column) -> Column:
    return F.floor(share * total + 1e-6).cast("int")


def _pieces(length: Column, left: Column) -> Column:
    """(piece, from, size) of a term of that length cut into one piece more than may be left over; longer pieces last."""
    n = left + 1
    size, more = F.floor(length / n).cast("int"), length % n
    short = n - more
    return F.transform(F.sequence(F.lit(0), left), lambda i: F.struct(i.alias("piece"), (i * size + F.greatest(i - short, F.lit(0))).alias("at"), (size + (i >= short).cast("int")).alias("size")))


def _candidates(phrases: DataFrame, terms: DataFrame, many: bool) -> DataFrame:
    """Pairs that share a piece, of phrases of one word or of several."""
    share, slack = _limits(F.lit(many))
    lengths = lambda n: F.filter(F.sequence(n - slack, n + slack), lambda x: x > 0)
    keys = ["list", "head", "term_length", "phrase_length", "piece", "part"]
    laid = terms.select("list", "term", F.substring("term", 1, 1).alias("head"), F.length("term").alias("term_length"), F.explode(lengths(F.length("term"))).alias("phrase_length"))
    laid = laid.withColumn("p", F.explode(_pieces(F.col("term_length"), _left_over(share, F.col("term_length") + F.col("phrase_length")))))
    indexed = laid.where("p.size > 0").select("list", "head", "term_length", "phrase_length", F.col("p.piece").alias("piece"), F.expr("substring(term, p.at + 1, p.size)").alias("part"), "term")
    asked = phrases.select("list", "phrase", F.substring("phrase", 1, 1).alias("head"), F.length("phrase").alias("phrase_length"), F.explode(lengths(F.length("phrase"))).alias("term_length"))
    asked = asked.withColumn("left", _left_over(share, F.col("term_length") + F.col("phrase_length"))).withColumn("p", F.explode(_pieces(F.col("term_length"), F.col("left"))))
    # of what is left over, a in the phrase and b in the term, a - b is the difference of lengths
    a, b = F.floor((F.col("left") + F.col("phrase_length") - F.col("term_length")) / 2).cast("int"), F.floor((F.col("left") - F.col("phrase_length") + F.col("term_length")) / 2).cast("int")
    moved = asked.where((F.col("p.size") > 0) & (a >= 0) & (b >= 0)).withColumn("at", F.explode(F.sequence(F.col("p.at") - b, F.col("p.at") + a)))
    held = moved.where((F.col("at") >= 0) & (F.col("at") + F.col("p.size") <= F.col("phrase_length")))
    held = held.select("list", "head", "term_length", "phrase_length", F.col("p.piece").alias("piece"), F.expr("substring(phrase, at + 1, p.size)").alias("part"), "phrase")
    pairs = held.join(indexed, keys).select("list", "phrase", "term", _left_over(share, F.col("term_length") + F.col("phrase_length")).alias("left"))
    return pairs.where(F.expr("levenshtein(phrase, term, left) >= 0")).select("list", "phrase", "term").distinct()  # no more edits than characters left over


def near_pairs(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(list, phrase, term): phrases (list, phrase) nearly equal to terms (list, term) of the same list, as ``names.like_a_term`` says.

    Phrases and terms are flat (``names.phrase``). Repeated rows count once; nulls
    and phrases of no, or of more than four, words are near nothing. Candidates
    meet by pieces of terms, so a phrase meets few of a list's terms unless many
    share a piece: terms of several words have short pieces, and a list in which
    thousands begin with the same word makes as many candidates of each phrase
    that does.
    """
    ship(phrases.sparkSession)
    words = F.size(F.split("phrase", " "))
    asked = phrases.select("list", "phrase").where("list is not null and phrase <> ''").distinct().withColumn("_words", words).where("_words <= 4")
    own = terms.select("list", "term").where("list is not null and term <> ''").distinct()
    single = asked.where("_words = 1 and length(phrase) >= 5")
    found = _candidates(single, own, False).unionByName(_candidates(asked.where("_words > 1"), own, True))

    @F.pandas_udf("boolean")
    def near(phrase: pd.Series, term: pd.Series) -> pd.Series:
        return pd.Series([names.like_a_term(p, (t,)) for p, t in zip(phrase, term, strict=True)], dtype=bool)

    return found.where(near("phrase", "term"))


def word_runs(text: Column, longest: int = 4) -> Column:
    """The distinct runs of one to four words of a text's phrase form."""
    return F.array_distinct(bound(phrase_words(text), lambda words: runs(words, longest)))
