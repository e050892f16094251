"""Near-duplicates by bottom-k sketches of one hash function.

1. A text's shingles are hashed once; the ``K`` smallest hashes are its sketch.
   Texts with the same set form one class, and only class representatives go on.
2. Inverted lists: runs of ``RUN`` retained values that follow one another are the
   list keys.  Two sets of Jaccard similarity 0.8 share no run of three among 64
   retained values with probability below 1e-9, and sets small enough to be kept
   whole always share one (sets of 4 and 5 get runs of two as well).
3. Each list yields the pairs of its smallest member with all others.  Pairs pass
   the size bound and the estimate from the union of their sketches, and are then
   verified on their full sets.
4. Lists whose members are still in different components are looked at again.
   Similar sets share many lists (fewer than ``SHARED`` with probability below 1e-6),
   so each set leaves out its ``SHARED`` - 1 longest such lists: a partner also meets it
   in another one, and sets that share a passage only drop out.  What the remaining
   lists connect are families of heavily edited copies.  A family is cut into blocks,
   and pairs of blocks count common shingles of their full sets as one product; they
   report a forest of links, never the pairs.

Verified pairs are joined to components.  No list is cut, and no list, component or
sketch is gathered in one place.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Sealed, filter_bits, join_groups, materialize, probably_in, release, split_by_filter
from tidewell.llm.components import connected_components, name_components
from tidewell.llm.forest import Forest

K = 64
RUN = 3
#: Standard deviations below the threshold at which the estimate rejects a pair.
MARGIN = 6.0
#: Lists that similar sets share at least; sets kept whole share 0.4 n - 2 or more.
SHARED = 7
#: A block of a family holds about this many sets and shingles at most.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000
#: Weights of counting in pairs against counting by products, and the sizes of their steps.
DENSE, SPARSE_PAIRS, SLICE = 64, 4_000_000, 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_shingles(df: DataFrame, text: str, width: int, name: str = "shingles") -> DataFrame:
    """Add ``name``: sorted distinct 64-bit hashes of the shingles of ``width`` words."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    df = df.withColumn("_w", F.filter(F.split(lowered, r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    n = F.size("_w")
    few = F.array(F.xxhash64("_w"))
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(width))))
    hashed = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, few).otherwise(many)
    # An expression that counts as nondeterministic is never copied into filters or joins
    # above, where it would be evaluated again, words and all, for each shingle.
    once = F.when(F.monotonically_increasing_id() >= 0, F.sort_array(F.array_distinct(hashed)))
    return df.withColumn(name, once).drop("_w")


def _keys(sketch: Column, n: Column) -> Column:
    def runs(length: int) -> Column:
        at = F.sequence(F.lit(0), F.size(sketch) - length)
        return F.transform(at, lambda i: F.xxhash64(F.lit(length), *(F.get(sketch, i + j) for j in range(length))))

    return F.when(n >= 6, runs(RUN)).otherwise(F.concat(runs(2), runs(RUN)))


def estimate(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest values of the union of two sketches that both hold."""
    union = F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class _Corpus:
    """What the steps share: the texts, the classes of equal sets, the threshold.

    A class is a node, numbered when the classes are written; ids only name results, so
    they may repeat or be null.  Each class is read again from one row, its ``pick``.
    """

    def __init__(self, texts: DataFrame, width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        self.texts = texts.withColumn("row", F.xxhash64(F.lit(3), "_id", "_t"))
        sets = with_shingles(self.texts, "_t", width)
        self.rows = materialize(
            sets.select("_id", "row", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("h1"), F.hash("shingles").alias("h2"), F.slice("shingles", 1, K).alias("sketch")),
            "minhash-rows",
        )
        self.same = ["h1", "h2", "n"]
        classes = self.rows.where("n > 0").groupBy(*self.same).agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.min("row").alias("pick"))
        self.classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    def sketches(self) -> DataFrame:
        """(_id, n, sketch) of the classes; from here on ``_id`` is the number of a class."""
        picked = self.classes.select(*self.same, F.col("pick").alias("row"), F.col("node"))
        # Rows that repeat id and text share a pick; the join's partitioning serves to drop them.
        found = self.rows.join(picked, [*self.same, "row"]).dropDuplicates([*self.same, "row"])
        return found.select(F.col("node").alias("_id"), "n", "sketch")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(_id, shingles, n) of the classes among ``ids``, read again from their texts."""
        picked = self.classes.select(*self.same, F.col("pick").alias("row"), F.col("node").alias("_id")).join(ids.distinct(), "_id", "left_semi")
        near = with_shingles(probably_in(self.texts.select("_t", "row"), picked, "row"), "_t", self.width)
        near = near.select("row", "shingles", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("h1"), F.hash("shingles").alias("h2"))
        return near.join(picked, [*self.same, "row"]).dropDuplicates([*self.same, "row"]).select("_id", "shingles", "n")

    def components(self, found: DataFrame) -> DataFrame:
        """(h1, h2, n, members, component_id) of all classes, from (node, component) of the linked ones."""
        named = name_components(self.classes, found).withColumn("in", F.lit(True))
        every = self.classes.join(named, "node", "left")
        return every.select(*self.same, "members", F.when(F.col("in"), F.col("name")).otherwise(F.col("rep")).alias("component_id"))

    def similar(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches do not rule the threshold out."""
        t = self.percent / 100
        least = max(0.0, t - MARGIN * math.sqrt(t * (1 - t) / K))
        one = sketches.select(F.col("_id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        two = sketches.select(F.col("_id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        both = pairs.join(one, "a").join(two, "b")
        whole = (F.col("na") <= K) & (F.col("nb") <= K)
        ok = F.when(whole, 100 * F.size(F.array_intersect("sa", "sb")) >= self.percent * F.size(F.array_union("sa", "sb"))).otherwise(estimate(F.col("sa"), F.col("sb")) >= least)
        return both.where(ok).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets reach the threshold; only their texts are read into sets."""
        ids = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id")))
        sets = self.sets_of(ids)
        one = sets.select(F.col("_id").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
        two = sets.select(F.col("_id").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
        both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _sized(x: str, y: str, percent: int) -> Column:
    """The sizes allow the threshold."""
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def common_counts(a: list, b: list) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b`` (arrays of distinct longs).

    Values in few sets are counted pair by pair, values in many as slices of a matrix product.
    """
    ia, ib = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(both):
        return out
    ka, kb = np.searchsorted(both, va), np.searchsorted(both, vb)
    on_a, on_b = both[np.minimum(ka, len(both) - 1)] == va, both[np.minimum(kb, len(both) - 1)] == vb
    ka, ia, kb, ib = ka[on_a], ia[on_a], kb[on_b], ib[on_b]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, ia, kb, ib = ka[oa], ia[oa], kb[ob], ib[ob]
    na, nb = np.bincount(ka, minlength=len(both)), np.bincount(kb, minlength=len(both))
    dense = na.astype(np.int64) * nb * DENSE > len(a) * len(b)
    flat = out.reshape(-1)
    starts = np.concatenate([[0], np.cumsum(nb)])
    light = np.flatnonzero(~dense[ka])
    for part in np.array_split(light, max(1, int(nb[ka[light]].sum()) // SPARSE_PAIRS + 1)):
        k = ka[part]
        times = nb[k]
        at = np.repeat(starts[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        flat += np.bincount(np.repeat(ia[part], times) * len(b) + ib[at], minlength=flat.size).astype(np.float32)
    heavy = np.flatnonzero(dense)
    for part in np.array_split(heavy, len(heavy) // SLICE + 1):
        if not len(part):
            continue
        to = np.full(len(both), -1)
        to[part] = np.arange(len(part))
        ma, mb = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        ja, jb = to[ka] >= 0, to[kb] >= 0
        ma[ia[ja], to[ka[ja]]] = 1
        mb[ib[jb], to[kb[jb]]] = 1
        out += ma @ mb.T
    return out


def _block_links(percent: int):
    def run(part):
        import pandas as pd

        part = part.sort_values("_id", ignore_index=True)
        left = np.flatnonzero(part["side"] == 1)
        right = np.flatnonzero(part["side"] == 2)
        if not len(right):
            right = left
        ids, label, n = part["_id"].to_numpy(), part["component"].to_numpy(), part["n"].to_numpy()
        sets = part["shingles"]
        forest = Forest(len(part))
        if len(left):
            common = common_counts([sets[i] for i in left], [sets[i] for i in right])
            union = n[left][:, None] + n[right][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (label[left][:, None] != label[right][None, :]))
            forest.add(left[i], right[j])
        root = forest.parent
        moved = root != np.arange(len(part))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return run


def _within_families(corpus: _Corpus, rest: DataFrame) -> DataFrame:
    """Verified links (a, b) between members of different components that share a list of ``rest``."""
    low = rest.groupBy("key").agg(F.min("_id").alias("low"))
    family = connected_components(rest.join(low, "key").select(F.col("_id").alias("a"), F.col("low").alias("b")))
    docs = rest.select("_id", "n", "component").distinct().join(family.select(F.col("node").alias("_id"), F.col("component").alias("family")), "_id")
    docs = materialize(docs, "minhash-families")

    def parts(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    # Sets more than one band of sizes apart cannot reach the threshold.
    docs = docs.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / max(math.log(100 / corpus.percent), 1e-3) + 1e-9).cast("int"))
    # A component that fills blocks of its own is not compared with itself; the others share blocks.
    each = docs.groupBy("family", "band", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    each = each.withColumn("whole", (F.col("c") * 2 >= BLOCK_SETS) | (F.col("w") * 2 >= BLOCK_SHINGLES)).withColumn("parts", parts(F.col("c"), F.col("w")))
    shared = each.where("NOT whole").groupBy("family", "band").agg(parts(F.sum("c"), F.sum("w")).alias("shared"))
    each = each.join(shared, ["family", "band"], "left").select("family", "band", "component", "whole", F.coalesce(F.when(F.col("whole"), F.col("parts")), F.col("shared"), F.lit(1)).alias("parts"))
    number = F.pmod(F.xxhash64(F.when(F.col("whole"), F.col("_id")).otherwise(F.col("component"))), F.col("parts")).cast("int")
    placed = docs.join(each, ["family", "band", "component"]).withColumn("part", number).withColumn("own", F.when(F.col("whole"), F.col("component")))
    placed = materialize(placed.select("_id", "n", "component", "family", "band", "part", "own"), "minhash-blocks")
    block = F.struct("band", F.coalesce(F.col("own"), F.lit(-1).cast("long")).alias("own"), F.col("own").isNull().alias("mixed"), F.col("part")).alias("block")
    blocks = placed.select("family", block, "own").distinct()
    one = blocks.select("family", F.col("block").alias("p"), F.col("own").alias("op"))
    two = blocks.select(F.col("family").alias("f2"), F.col("block").alias("q"), F.col("own").alias("oq"))
    near = (F.col("q.band") - F.col("p.band")).between(0, 1)
    pairs = one.join(two, (F.col("family") == F.col("f2")) & (F.col("p") <= F.col("q")) & near & (F.col("op").isNull() | F.col("oq").isNull() | (F.col("op") != F.col("oq")))).select("family", "p", "q")
    with_sets = placed.select("_id", "component", "family", block).join(corpus.sets_of(placed.select("_id")), "_id")
    first = with_sets.join(pairs.withColumn("block", F.col("p")), ["family", "block"]).withColumn("side", F.lit(1))
    second = with_sets.join(pairs.where("p <> q").withColumn("block", F.col("q")), ["family", "block"]).withColumn("side", F.lit(2))
    rows = first.union(second.select(*first.columns)).select("family", "p", "q", "side", "_id", "component", "n", "shingles")
    return rows.groupBy("family", "p", "q").applyInPandas(_block_links(percent=corpus.percent), "a long, b long")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Sets of shingles of ``width`` words are linked when 100 * intersection >=
    ``percent`` * union; a component is what links connect, named by its smallest id.
    A text with fewer words than ``width`` has the whole sequence as its only shingle;
    one without words (or null) has none and is linked with nothing.  Rows that repeat
    an id each follow their own text.  A row with a null id follows its text too and is
    never kept beside a row with an id; a component in which all ids are null is named
    null, and all its rows count as kept.  Other columns are ignored, whatever their names.
    """
    corpus = _Corpus(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), width, percent)
    found = _linked(corpus)
    by_class = materialize(corpus.components(found), "minhash-named")
    sets, none = corpus.rows.where("n > 0").select("_id", *corpus.same), corpus.rows.where("n = 0").select("_id", *corpus.same)
    out = join_groups(sets, by_class, corpus.same, "members").select("_id", "n", "component_id").union(none.select("_id", "n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(corpus: _Corpus) -> DataFrame:
    """(node, component) of the classes that links connect."""
    percent = corpus.percent
    sketches = materialize(corpus.sketches(), "minhash-sketches")
    lists = sketches.where("n >= 4").select("_id", F.col("n").cast("int").alias("n"), F.explode(_keys(F.col("sketch"), F.col("n"))).alias("key"))
    heads = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("_id", "n")).alias("low")).where("size > 1")
    heads = heads.select("key", "size", F.col("low._id").alias("low"), F.col("low.n").alias("low_n"))
    members = materialize(lists.join(heads, "key").where("_id <> low"), "minhash-members")

    pairs = members.where(_sized("n", "low_n", percent)).select(F.col("_id").alias("a"), F.col("low").alias("b")).distinct()
    pairs = materialize(corpus.similar(pairs, sketches), "minhash-pairs")
    release(sketches)
    links = materialize(corpus.verified(pairs), "minhash-links")
    release(pairs)
    found = materialize(connected_components(links), "minhash-components")

    label = found.select(F.col("node").alias("_id"), F.col("component"))
    # A list with two members has been dealt with: its only pair holds its smallest member.
    open_rows = members.where("size > 2").join(label, "_id", "left").withColumn("component", F.coalesce("component", "_id"))
    mixed = open_rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    mixed_rows = materialize(open_rows.join(mixed, "key", "left_semi").select("key", "_id", "n", "size", "component"), "minhash-mixed")
    release(members)
    by_length = Window.partitionBy("_id").orderBy("size", "key")
    shared = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.col("n") * 0.4 - 2)))
    ranked = mixed_rows.withColumn("_r", F.row_number().over(by_length)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("_id")))
    rest = materialize(ranked.where(F.col("_r") <= F.col("_m") - shared + 1).drop("_r", "_m"), "minhash-rest")
    release(mixed_rows)
    added = materialize(_within_families(corpus, rest), "minhash-links")
    if not added.isEmpty():
        found = materialize(connected_components(links.union(added)), "minhash-components")
    release(rest, added, links)
    return found


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``dedup_near`` keeps, all columns under their names.

    Rows are told apart by id and text: a unique text stays even if its id is repeated,
    and rows that repeat both stay or go together.
    """
    sealed = Sealed(docs)
    rows = sealed.df.withColumn("_row", F.xxhash64(F.lit(3), sealed[id_col], sealed[text]))
    corpus = _Corpus(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")), width, percent)
    by_class = materialize(corpus.components(_linked(corpus)), "minhash-named")
    judged = join_groups(corpus.rows.where("n > 0").select("_id", "row", *corpus.same), by_class, corpus.same, "members")
    gone = materialize(judged.where(~F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("_row"), "_id").distinct(), "minhash-gone")
    maybe, others = split_by_filter(rows, gone.select("_row"), "_row", filter_bits(gone.count()))
    theirs = gone.withColumnsRenamed({"_row": "_row2", "_id": "_id2"})
    left = maybe.join(theirs, (F.col("_row") == F.col("_row2")) & sealed[id_col].eqNullSafe(F.col("_id2")), "left_anti")
    return sealed.restored(others.union(left))
