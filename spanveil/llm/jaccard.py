"""N-gram Jaccard join: documents linked by the overlap of their word shingles.

The document-by-shingle incidence matrix D is multiplied with its transpose in
blocks and only as far as it must be. Columns are ordered from rare to common
(by a count sketch over all documents); the product over a row's first columns
gives the overlap so far, and the sizes give what the rest can still add. Pairs
that cannot reach the threshold are discarded there; the overlap of the others
is completed over their whole sets.

Steps, none of which makes all pairs of a group:

1. Count sketch of shingles (one pass; its counters follow the input's size up
   to 2**26).
2. Each row's set size, set digest and first columns.
3. Equal sets collapse to one class (partial aggregation by digest).
4. Columns that stand in one class only are told by bare counts, before any
   posting moves; what is left are postings of (column, class, position).
5. Blocks: classes that stand in a crowded column meet in a block of bounded
   size (a crowded column is dealt into many), whose whole product is taken.
   Only a spanning forest of the links leaves a block.
6. Star rounds: in each column, classes of like size are tried against one hub
   of another component, while columns hold many pairs of different components
   and a round takes a quarter of them away.
7. What is left is exact. In columns that are still heavy, the product of every
   pair of blocks is taken. All other pairs of classes of different components
   that share a column count their overlap there, are bounded by it, their
   positions and their sizes, and verified.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import SPACES, U64, Words, column_bytes, pieces, shingles
from .scratch import Scratch, bounded_batches

#: The count sketch has a counter for about so many bytes of text, within these powers of two.
BYTES_A_COUNTER, LEAST_BITS, MOST_BITS = 96, 22, 26
_CHUNKS = 16
#: Tables of ids, columns or sets are broadcast up to so many rows (or shingles) of them, after a count; beyond it the same join shuffles.
BROADCAST_IDS = 100_000
#: A task that reads texts takes about so many of them. For the number of files alone: about so many first columns of a text are shared.
TEXTS_A_FILE, _PREFIX_GUESS = 16_000, 4
#: A column is crowded from so many classes on; a block takes about so many, of about so many shingles.
CROWD, BLOCK_ROWS, BLOCK_SHINGLES = 5, 1024, 1 << 20
#: A column is heavy if it holds more than so many pairs of different components for each of its classes.
HEAVY = 16


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _sets(batch_column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text with a word."""
    data, offsets = column_bytes(batch_column)
    for lo, _, part, offs in pieces(data, offsets):
        docs, h = shingles(Words(part, offs, SPACES, lower=True), k)
        order = np.argsort(docs, kind="stable")
        docs, h = docs[order], h[order]
        ends = np.searchsorted(docs, np.arange(len(offs)))
        for d in np.flatnonzero(np.diff(ends)):
            yield lo + int(d), np.unique(h[ends[d] : ends[d + 1]])


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """For each hash bucket, in how many documents' sets its shingles stand, over all documents: 8 times the binary logarithm, in one byte."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (text_bytes // BYTES_A_COUNTER).bit_length()))
    width = (1 << bits) // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, s in _sets(batch.column("text"), k):
                total = np.zeros(1 << bits, np.uint32) if total is None else total
                np.add.at(total, (s >> U64(64 - bits)).astype(np.int64), np.uint32(1))
        if total is not None:
            yield _packed(range(_CHUNKS), [total[i * width : (i + 1) * width] for i in range(_CHUNKS)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        if sums:
            yield _packed(list(sums), [np.minimum(8 * np.log2(np.maximum(x, 1)), 255).astype(np.uint8) for x in sums.values()])

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(_CHUNKS, "chunk").mapInArrow(add, schema).collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:  # _CHUNKS rows
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out


def _packed(chunks, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())], ["chunk", "counts"])


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, told, n, v, last, prefix) of each row: set size, class, the order of the last of its first columns, and these columns. An empty set, and a row without an id, have no class."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = counts.value
        shift = U64(65 - len(weight).bit_length())
        for batch in batches:
            n = batch.num_rows
            size, last, cls, prefix = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, U64)] * n
            for i, s in _sets(batch.column("text"), k):
                key = (weight[(s >> shift).astype(np.int64)].astype(U64) << U64(55)) | (s >> U64(9))
                order = np.argsort(key, kind="stable")
                p = len(s) - -(-num * len(s) // den) + 1
                size[i], last[i] = len(s), key[order[p - 1]]
                cls[i] = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)
                prefix[i] = s[order[:p]]
            cols = [batch.column("id"), batch.column("told"), pa.array(size), pa.array(cls, mask=(size == 0) | batch.column("id").is_null().to_numpy(zero_copy_only=False)), pa.array(last), _longs(prefix)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "told", "n", "v", "last", "prefix"])

    return docs.mapInArrow(sign, f"id {kind}, told bigint, n bigint, v bigint, last bigint, prefix array<bigint>")


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(v, shingles) of the classes in ``ids`` (v, id, told), read from the texts again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch.column("text"), k))
            if found:
                at, sets = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(at)), _longs(list(sets))], ["v", "shingles"])

    wanted = ids.select("v", F.col("id").alias("rep"), F.col("told").alias("rep_told"))
    texts = docs.join(wanted, (F.col("told") == F.col("rep_told")) & (F.col("id") == F.col("rep")))
    return texts.select("v", "text").mapInArrow(whole, "v bigint, shingles array<bigint>")


class _Join:
    """What the rounds share: the texts, the classes and the whole sets read so far."""

    def __init__(self, docs: DataFrame, scratch: Scratch, k: int, num: int, den: int):
        self.docs, self.scratch, self.k, self.num, self.den = docs, scratch, k, num, den
        self.sets: DataFrame | None = None
        self.heads: DataFrame | None = None
        self.n_docs = self.n_posts = self.n_heads = 0

    def like(self, a: str, b: str) -> Column:
        """The sizes allow the threshold."""
        return (F.col(a) * self.den >= F.col(b) * self.num) & (F.col(b) * self.den >= F.col(a) * self.num)

    def enough(self, c: Column, a: str, b: str) -> Column:
        """An overlap of c reaches the threshold for sets of these sizes."""
        return c * (self.num + self.den) >= (F.col(a) + F.col(b)) * self.num

    def reaches(self, c: Column) -> Column:
        """Two rows a and b that share c of their first columns can make up the threshold with those after the earlier end."""
        rest_a, rest_b = F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")
        rest = F.when(F.col("a.last") < F.col("b.last"), rest_a).when(F.col("a.last") > F.col("b.last"), rest_b).otherwise(F.greatest(rest_a, rest_b))
        return self.enough(c + rest, "a.n", "b.n")

    def within_reach(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that share c of their first columns, and can still reach the threshold."""
        a, b = (_small(self.heads.select(F.col("v").alias(x), F.struct("n", "p", "last").alias(y)), self.n_heads) for x, y in (("u", "a"), ("v", "b")))
        return pairs.join(a, "u").join(b, "v").where(self.reaches(F.col("c"))).select("u", "v")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) whose whole sets overlap enough, written. Sets not read before are read from the texts."""
        pairs = self.scratch.save(pairs, self.n_posts)
        n_pairs = pairs.count()
        self.read(pairs.select(F.col("u").alias("v")).unionByName(pairs.select("v")).distinct(), 2 * n_pairs)
        u, v = (_small(pairs.select(F.col(x).alias("v")).distinct(), n_pairs) for x in "uv")
        a, b = self.sets.join(u, "v", "left_semi"), self.sets.join(v, "v", "left_semi")
        held = a.agg(F.sum(F.size("shingles"))).first()[0] or 0, b.agg(F.sum(F.size("shingles"))).first()[0] or 0
        a = _small(a.select(F.col("v").alias("u"), F.col("shingles").alias("s"), F.size("shingles").alias("m")), held[0])
        b = _small(b.select("v", F.col("shingles").alias("t"), F.size("shingles").alias("n")), held[1])
        both = pairs.join(a, "u").join(b, "v").where(self.enough(F.size(F.array_intersect("s", "t")), "m", "n"))
        out = self.scratch.save(both.select("u", "v").distinct(), n_pairs)
        self.scratch.drop(pairs)
        self.scratch.free()
        return out

    def stars(self, posts: DataFrame, turn: int) -> DataFrame:
        """For each class, the hub of another component that it shares the most columns with.

        Hubs are written before they are joined, so that the rows of a crowded
        column are split in that join.
        """
        step = math.log(self.den / self.num)
        rows = posts.withColumn("cls", F.floor(F.log("n") / F.lit(step) + F.lit(turn % 2 / 2)))
        hubs = self.scratch.save(rows.groupBy("token", "cls").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn // 2)).alias("h"), "v", "n", "comp")).alias("hub")), self.n_posts)
        tried = rows.join(hubs, ["token", "cls"]).where("v <> hub.v and comp <> hub.comp").where(self.like("n", "hub.n"))
        counted = tried.groupBy("v", F.col("hub.v").alias("u")).agg(F.count(F.lit(1)).alias("c"))
        best = counted.groupBy("v").agg(F.max(F.struct("c", "u")).alias("best"))
        out = self.scratch.save(self.within_reach(best.select("best.u", "v", "best.c")), self.n_posts)
        self.scratch.drop(hubs)
        return out

    def crossing(self, posts: DataFrame, homes: DataFrame | None) -> DataFrame:
        """All pairs of different components that share a column, aren't of one home, and are within reach.

        A column at positions i and j of two rows leaves an overlap of at most
        min(i, j) before it, itself, and what follows in the shorter rest. In
        light columns each shared one counts. Heavy ones hold many pairs: there
        a pair is made in the first heavy column that it shares, and only if all
        the columns that it shares, light ones too, bring it within reach.
        """

        def side(rows: DataFrame, x: str, y: str, *more: str) -> DataFrame:
            return rows.select("token", F.col("v").alias(x), F.struct("n", "at", "comp", *more).alias(y))

        def met(rows: DataFrame, *more: str) -> DataFrame:
            most = F.least("a.at", "b.at") + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
            pairs = side(rows, "u", "a", *more).join(side(rows, "v", "b", *more), "token")
            return pairs.where("u < v and a.comp <> b.comp").where(self.like("a.n", "b.n") & self.enough(most, "a.n", "b.n"))

        found = met(posts.where("not heavy")).select("u", "v", F.lit(1).alias("c"))
        found = self.within_reach(found.groupBy("u", "v").agg(F.sum("c").alias("c")))
        if homes is None:
            return found
        light = posts.where("not heavy").join(homes.select("v"), "v", "left_semi").groupBy("v").agg(F.collect_set("token").alias("light"))  # its first columns at most
        known = homes.join(self.heads.select("v", "p", "last"), "v").join(light, "v", "left").withColumn("light", F.coalesce("light", F.array().cast("array<bigint>")))
        shared = F.array_intersect("a.tokens", "b.tokens")
        heavy = met(posts.where("heavy").join(known, "v"), "home", "tokens", "light", "p", "last").where("a.home <> b.home").where(F.array_min(shared) == F.col("token"))
        heavy = heavy.where(self.reaches(F.size(shared) + F.size(F.array_intersect("a.light", "b.light"))))
        return found.unionByName(heavy.select("u", "v")).distinct()

    def blocks(self, homes: DataFrame, n: int, every: bool) -> DataFrame:
        """Links (u, v) between classes of one home (v, n, home, comp), a spanning forest of each block.

        A home is dealt into parts of about ``BLOCK_ROWS`` classes and
        ``BLOCK_SHINGLES`` shingles. A block is one part, or, to take ``every``
        pair of a home, two parts. Links within a component are not made anew.
        """
        load = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
        load = self.scratch.save(load, n)
        own = F.pmod(F.xxhash64("v"), "parts").cast("int")
        homes = homes.join(_small(load, n), "home").withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if every else F.col("own")
        dealt = homes.select("v", "home", "comp", "own", other.alias("other")).select("v", "comp", "home", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        self.read(homes.select("v"), n)
        num, den = self.num, self.den
        found = self.sets.join(_small(dealt, n), "v").groupBy("home", "lo", "hi").applyInArrow(lambda rows: _forest(rows, num, den), "u bigint, v bigint")
        return self.scratch.save(found, self.n_heads)

    def read(self, ids: DataFrame, n: int) -> None:
        """Have the whole sets of the classes ``ids`` (v), about ``n`` of them, in ``sets``."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("v"), "v", "left_anti")
        ids = self.scratch.save(self.heads.join(_small(ids, n), "v", "left_semi").select("v", "id", "told"), n)
        some = ids.count()
        if some or self.sets is None:
            new = self.scratch.save(_whole_sets(self.docs, _small(ids, some), self.k), self.n_docs, TEXTS_A_FILE)
            self.sets = new if self.sets is None else self.scratch.union(self.sets, new)
        self.scratch.drop(ids)


def _forest(rows: pa.Table, num: int, den: int) -> pa.Table:
    """The product of a block's rows with each other, row by row; only links that join two trees are kept. Rows of one component are one tree from the start."""
    rows = rows.take(pa.array(np.sort(np.unique(rows.column("v").to_numpy(), return_index=True)[1]))).combine_chunks()
    ids, sets = rows.column("v").to_numpy(), rows.column("shingles").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    _, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(sizes)
    by_column = np.argsort(column, kind="stable")
    row_of = np.repeat(np.arange(len(sets)), sizes)[by_column]
    first = np.searchsorted(column[by_column], np.arange(column.max() + 2))
    up, out = np.unique(rows.column("comp").to_numpy(), return_inverse=True)[1], []
    for i in range(len(sets)):
        mine = column[ends[i] - sizes[i] : ends[i]]
        lengths = first[mine + 1] - first[mine]
        total = lengths.sum()
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[mine], lengths)
        overlap = np.bincount(row_of[at], minlength=len(sets))
        for j in np.flatnonzero((overlap * (num + den) >= num * (sizes + sizes[i])) & (up != up[i])):
            if up[i] != up[j]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                up[up == up[j]] = up[i]
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _linked(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, links' components): (id, told, n, v) of each row of ``docs`` (id, told, text), and (v, component) of each class with a link."""
    op = _Join(docs, scratch, k, num, den)
    n_docs = docs.count()
    op.n_docs = n_docs
    signed = scratch.save(_signatures(docs, k, num, den), n_docs, TEXTS_A_FILE)
    rows = scratch.save(signed.select("id", "told", "n", "v"), n_docs)
    classes = signed.where("v is not null").groupBy("v").agg(F.min(F.struct("id", "told")).alias("rep"), *(F.first(c).alias(c) for c in ("n", "last", "prefix")))
    classes = scratch.save(classes, n_docs, TEXTS_A_FILE)
    scratch.drop(signed)
    tokens = classes.select(F.explode("prefix").alias("token"))
    shared = scratch.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), _PREFIX_GUESS * n_docs, 50_000)
    scratch.free()
    places = classes.select("v", "n", F.posexplode("prefix").alias("at", "token"))
    n_shared = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    posts = scratch.save(places.join(_small(shared, n_shared[0]), "token").withColumn("comp", F.col("v")).withColumn("heavy", F.lit(False)), n_shared[1], 100_000)
    scratch.drop(shared)
    scratch.free()
    op.n_posts = n_posts = posts.count()
    heads = classes.select("v", "rep.id", "rep.told", "n", F.size("prefix").alias("p"), "last")
    ids = posts.select("v").distinct()
    op.heads = scratch.save(heads.join(_small(ids, n_posts), "v", "left_semi"), n_posts)
    op.n_heads = op.heads.count()
    scratch.drop(classes)
    links, n_links, before, stalled, homes = None, 0, math.inf, False, None
    for turn in range(-1, 1000):
        if turn < 0 or stalled:
            crowded = posts.where(F.col("heavy") if stalled else F.col("df") >= CROWD)
            homes = crowded.groupBy("v", "n", "comp").agg(F.max(F.struct("df", "token")).alias("h"), F.array_sort(F.collect_set("token")).alias("tokens"))  # its first columns at most
            homes = scratch.save(homes.select("v", "n", "comp", F.col("h.token").alias("home"), "tokens"), n_posts)
            new = op.blocks(homes.drop("tokens"), homes.count(), stalled)
        else:
            new = op.verify(op.stars(posts, turn))
        scratch.free()
        some = new.count()
        n_links += some
        old, found = posts, None
        if some:
            links = new if links is None else scratch.union(links, new)
            found = scratch.save(components(links, scratch), n_links)
            posts = posts.drop("comp").join(_small(found.select(F.col("id").alias("v"), F.col("component").alias("comp")), 2 * n_links), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        groups = posts.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")).where("g > 1")
        groups = scratch.save(groups.select("token", F.col("m").alias("df"), ((F.col("m") * F.col("m") - F.col("mm")) / 2).alias("pairs")), n_posts)
        n_groups, left = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if stalled:  # which columns are heavy stays, as homes go by them
            posts = posts.join(_small(groups.select("token"), n_groups), "token", "left_semi")
        else:
            heavy = groups.select("token", "df", (F.col("pairs") > HEAVY * F.col("df")).alias("heavy"))
            posts = posts.drop("df", "heavy").join(_small(heavy, n_groups), "token")
        posts = scratch.save(posts, n_posts)
        for done in (old, groups, found):
            scratch.drop(done)
        if stalled:
            break
        stalled = left <= 4 * n_posts or (turn >= 0 and left > 0.75 * before)
        if stalled and not posts.where("heavy").limit(1).count():
            homes = None
            break
        before = left
    homes = None if homes is None else homes.select("v", "home", "tokens")
    last = op.verify(op.crossing(posts, homes))
    found = scratch.save(components(last if links is None else scratch.union(links, last), scratch), n_links)
    for done in (posts, op.heads, op.sets):
        scratch.drop(done)
    scratch.free()
    return rows, found.select(F.col("id").alias("v"), "component")


def _told(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("told"), text.alias("text"))


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs`` (doc_id, text, ...).

    A document's set is its distinct shingles of ``k`` words (separated by ASCII
    white space, A-Z lower-cased); fewer words are one shingle. Two documents
    link when ``den * |A & B| >= num * |A | B|``. ``component_id`` is the least
    doc_id reachable by links. Null, empty or blank texts have no shingles, link
    with nothing and are their own component. Rows are told apart by their texts
    where a doc_id is repeated. A null doc_id has a null component and links
    nothing. doc_id may be of any type that has an order. Other columns are not
    looked at; an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    rows, found = _linked(_told(docs), scratch, k, num, den)
    # Least id of each class, then of each component; every join is on a key whose hot values AQE can split.
    n = rows.count()
    least = scratch.save(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least")).join(found, "v", "left"), n)
    named = scratch.save(least.where("component is not null").groupBy("component").agg(F.min("least").alias("first")), n)
    names = scratch.save(least.join(named, "component", "left").select("v", F.coalesce("first", "least").alias("component_id")), n)
    out = rows.where("v is not null").join(names, "v", "left").select("id", "n", "component_id")
    out = out.unionByName(rows.where("v is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component, that with the least doc_id; columns as they are.

    Of equal texts with the same doc_id any one stays. Rows without a word or a
    doc_id stay.
    Only ids and hashes of texts move: they are broadcast up to
    ``BROADCAST_IDS`` rows and shuffled beyond.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "keep")
    rows, found = _linked(_told(docs), scratch, k, num, den)
    n = rows.count()
    least = scratch.save(rows.where("v is not null").groupBy("v").agg(F.min(F.struct("id", "told")).alias("least"), F.count(F.lit(1)).alias("m")).join(found, "v", "left").withColumn("component", F.coalesce("component", "v")), n)
    first = scratch.save(least.groupBy("component").agg(F.min("least").alias("first"), F.sum("m").alias("m")).where("m > 1"), n)
    crowd = scratch.save(least.join(first.drop("m"), "component").select("v", "first"), n)
    n_crowd = crowd.count()
    if not n_crowd:
        return docs
    # (id, told) of all rows in components of several rows, and whether they stay.
    stays = (F.col("told") == F.col("first.told")) & (F.col("id") == F.col("first.id"))
    known = rows.join(_small(crowd, n_crowd), "v").groupBy("id", "told").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("m")).where("not stays or m > 1")
    known = scratch.save(known.select(F.struct("id", "told").alias("gone"), "stays"), n)
    n_gone, n_again = known.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    text = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text.alias("told"))
    same = (F.col("told") == F.col("gone.told")) & (F.col("id") == F.col("gone.id"))
    out = held.join(_small(known.where("not stays"), n_gone), same, "left_anti")
    if n_again:
        again = _small(known.where("stays"), n_again)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["id", "told"]))
    return out.select("row.*")
