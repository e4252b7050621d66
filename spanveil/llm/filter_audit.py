"""How five document filters interact in every order, from one relational pass over words.

Filters, each by its failure condition: A fewer than 200 words; B distinct words
under half of the words; C capitals A-Z over 3 % of the code points; D one of
``#$%&*|``; E the same text as a document of a smaller id. A document's failures
are a set, one of 32, so 32 conditional counts a part, and as many of good and of
toxic documents, hold all that any order of the filters can show.

Words are exploded and aggregated by (document, word), then by document. Texts
are shuffled once, by document, so both aggregations work where the rows are.
What else a document has (capitals, symbols, a digest of its text, labels) is a
narrow row that is outer-joined to its words' figures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The filters in the order of their bits in a set of failures.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Words: maximal runs of other characters.
SPACES = r"[\x20\x09-\x0D]+"
#: Equal rows of a document are dealt to so many groups.
SALTS = 64


def word_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, told, n_words, n_distinct) of each distinct (doc_id, text); ``told`` is a hash of the text.

    A null stands for the row itself beside its words: so texts without a word
    are there, and rows that are equal don't add up their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("told"), text.alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.repartition("doc_id", "told", "salt")  # both aggregations below need no other shuffle
    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    exploded = rows.select("doc_id", "told", "salt", F.explode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("word"))
    by_word = exploded.groupBy("doc_id", "told", "salt", "word").agg(F.count(F.lit(1)).alias("n"))
    same = F.max(F.when(F.col("word").isNull(), F.col("n")))
    by_row = by_word.groupBy("doc_id", "told", "salt").agg(((F.sum("n") - same) / same).cast("bigint").alias("n_words"), F.count("word").alias("n_distinct"))
    return by_row.groupBy("doc_id", "told").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): ``n`` documents of a part (their language) fail the set of filters with the bits of ``failed``.

    A null text is empty; a null language is the part ``""``. Rows that are equal
    count each. A document without an id equals none of a smaller id, and has no
    label; of several labels of a document one that says 1 decides.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    text = F.coalesce(F.col("text"), F.lit(""))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)
    flags = docs.select("doc_id", "part", F.xxhash64(text).alias("told"), F.unhex(F.sha2(text, 256)).alias("digest"), capitals.alias("c"), text.rlike("[#$%&*|]").alias("d"))
    flags = flags.groupBy("doc_id", "told", "digest", "part", "c", "d").agg(F.count(F.lit(1)).alias("n"))  # equal rows are one from here on
    flags = Scratch(docs.sparkSession, "audit").save(flags)
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    figures = word_figures(docs)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))

    f, w, s, m = flags.alias("f"), figures.alias("w"), first.alias("s"), marked.alias("m")
    joined = f.join(w, F.col("f.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("f.told") == F.col("w.told")), "left")
    joined = joined.join(s, (F.col("f.doc_id") == F.col("s.doc_id")) & (F.col("f.digest") == F.col("s.digest")), "left")  # a key is one document: copies don't meet
    joined = joined.join(m, F.col("f.doc_id") == F.col("m.doc_id"), "left")
    n_words, n_distinct = F.coalesce("w.n_words", F.lit(0)), F.coalesce("w.n_distinct", F.lit(0))
    fails = [n_words < 200, 100 * n_distinct < 50 * n_words, F.col("f.c"), F.col("f.d"), F.col("f.doc_id").isNotNull() & F.col("s.first").isNull()]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    told = joined.select("f.part", bits.alias("failed"), yes("m.good").alias("good"), yes("m.toxic").alias("toxic"), F.col("f.n").alias("n"))
    return told.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def conditional_counts(failed: DataFrame) -> DataFrame:
    """(part, every, good, toxic): for each part three arrays of 32 counts, one for each set of failures."""

    def counts(given: Column) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when((F.col("failed") == i) & given, F.col("n"))), F.lit(0)).cast("bigint") for i in range(SETS)))

    return failed.groupBy("part").agg(counts(F.lit(True)).alias("every"), counts(F.col("good")).alias("good"), counts(F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    ``removed`` fail the step's filter and none before it, ``redundant`` fail it
    and one before it, ``unique_fails`` it alone; ``kept`` fail none up to here.
    ``shapley`` is what the filter removes over all orders: of a document that
    fails k filters each is the first in 120 / k orders. An empty table has no
    parts, so no rows.
    """
    orders = list(permutations(FILTERS))
    steps = [("".join(o), i + 1, 1 << FILTERS.index(o[i]), sum(1 << FILTERS.index(x) for x in o[:i])) for o in orders for i in range(len(o))]
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"own":{own},"earlier":{earlier}}}' for o, s, own, earlier in steps) + "]"), "array<struct<o:string,s:int,own:int,earlier:int>>")
    rows = conditional_counts(failures(docs, labels)).withColumn("at", F.explode(table))
    own, earlier = F.col("at.own"), F.col("at.earlier")

    def total(counts: str, keep) -> Column:
        held = F.filter(F.transform(F.col(counts), lambda n, i: F.struct(i.alias("set"), n.alias("n"))), lambda x: keep(x["set"]))
        return F.aggregate(held, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

    has = lambda x, bits: x.bitwiseAND(bits) != 0
    removes = lambda x: has(x, own) & ~has(x, earlier)
    share = F.lit(len(orders)).cast("bigint")
    first = F.aggregate(F.transform(F.col("every"), lambda n, i: F.when(has(i, own), n * (share / F.bit_count(i)).cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        total("every", lambda x: ~has(x, own) & ~has(x, earlier)).alias("kept"),
        total("every", removes).alias("removed"),
        total("every", lambda x: has(x, own) & has(x, earlier)).alias("redundant"),
        total("every", lambda x: x == own).alias("unique_fails"),
        total("good", removes).alias("good_lost"),
        total("toxic", removes).alias("toxic_lost"),
        first.alias("shapley"),
    )
