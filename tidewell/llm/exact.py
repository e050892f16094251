"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every text is normalised and fingerprinted (64 bits).
2. Each partition sorts its fingerprints, cuts them by owner (leading bits) and
   sends every owner the differences in Rice code, the Golomb code whose
   parameter is a power of two.
3. An owner merges what it was sent and answers each partition with a bitmap of
   the fingerprints that occur more than once anywhere.
4. Fingerprints flagged there are suspects.  Only texts of suspects are shuffled,
   grouped by their bytes, and so verified; all other rows are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Sealed, filter_bits, join_groups, materialize, probably_in, release, split_by_filter, width

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Fingerprints of one message at most; a partition with more sends several.
CHUNK = 1 << 20
#: Fingerprints of an owner at most (about); merging them takes some 200 MB.
OWNED = 4 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def rice_encode(values: np.ndarray) -> bytes:
    """Strictly increasing uint64 values as Rice-coded differences."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0)) - np.concatenate([[0], np.ones(len(values) - 1)]).astype(np.uint64)
    k = max(0, int(gaps.astype(np.float64).mean()).bit_length() - 1)
    first = gaps[0]
    gaps = gaps[1:]
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(values), k, len(unary)], dtype="<u4").tobytes() + first.astype("<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(data, "<u4", 3))
    first = np.frombuffer(data, "<u8", 1, 12)
    cut = 20 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, cut - 20, 20), count=bits)
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(data, np.uint8, offset=cut), count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
    low = (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(k)) + low + np.uint64(1)
    return np.concatenate([first, first + np.cumsum(gaps, dtype=np.uint64)])


def _messages(owners: int):
    """Arrow batches of ``fp`` to messages (owner, part, sent, twice)."""
    step = np.uint64((1 << 64) // owners + 1) if owners > 1 else None

    def cut(fps: np.ndarray) -> Iterator:
        import uuid

        import pyarrow as pa

        values, counts = np.unique(fps.view(np.uint64), return_counts=True)
        owner = values // step if step is not None else np.zeros(len(values), dtype=np.uint64)
        ends = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        rows = [(i, rice_encode(values[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
        who, sent, twice = map(list, zip(*rows, strict=True))
        name = uuid.uuid4().hex
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array([name] * len(who)), pa.array(sent, pa.binary()), pa.array(twice, pa.binary())], names=["owner", "part", "sent", "twice"])

    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            held.append(fps)
            n += len(fps)
            if n >= CHUNK:
                yield from cut(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from cut(np.concatenate(held))

    return run


def _answer(messages):
    """All messages to one owner to a bitmap for each of them."""
    import pandas as pd

    sent = [rice_decode(x) for x in messages["sent"]]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool) for x, s in zip(messages["twice"], sent, strict=True)]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    flagged = np.union1d(values[counts > 1], np.concatenate([s[t] for s, t in zip(sent, twice, strict=True)]))
    bitmaps = [np.packbits(np.isin(s, flagged, assume_unique=True)).tobytes() for s in sent]
    return pd.DataFrame({"owner": messages["owner"].astype("int32"), "part": messages["part"], "bitmap": bitmaps})


def _flagged(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for sent, bitmap in zip(b.column("sent"), b.column("bitmap"), strict=True):
            fps = rice_decode(sent.as_py())
            on = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8), count=len(fps)).astype(bool)
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[on].view(np.int64))], names=["fp"])


def suspects(fingerprints: DataFrame, owners: int | None = None) -> DataFrame:
    """Distinct values of the long column ``fp`` that occur in more than one row.

    ``owners`` defaults to the session's shuffle partitions, or more, so that an owner
    gets OWNED fingerprints at most.
    """
    if owners is None:
        owners = max(width(fingerprints.sparkSession), -(-fingerprints.count() // OWNED))
    sent = materialize(fingerprints.select("fp").mapInArrow(_messages(owners), "owner int, part string, sent binary, twice binary"), "exact-sent")
    bitmaps = sent.groupBy("owner").applyInPandas(_answer, "owner int, part string, bitmap binary")
    found = sent.join(bitmaps, ["owner", "part"]).select("sent", "bitmap").mapInArrow(_flagged, "fp long").distinct()
    found = materialize(found, "exact-suspects")
    release(sent)
    return found


def _groups(docs: DataFrame, id_col: str, text: str, owners: int | None) -> tuple[DataFrame, DataFrame]:
    """(_id, text_sha256) of every row, and (text_sha256, keep_id, n) of the groups with copies."""
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text)).alias("_t"))
    narrow = materialize(base.select("_id", F.xxhash64("_t").alias("fp"), F.sha2("_t", 256).alias("text_sha256")), "exact-fp")
    flagged = suspects(narrow, owners)
    texts = probably_in(base.withColumn("fp", F.xxhash64("_t")), flagged, "fp", filter_bits(flagged.count()))
    equal = texts.groupBy("_t").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return narrow, materialize(equal.select(F.sha2("_t", 256).alias("text_sha256"), "keep_id", "n"), "exact-groups")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one
    space; null counts as empty.  The smallest id of equal texts stays.  A null id is
    never the smallest unless all ids of its group are null; its row is kept only
    then.  Rows that repeat an id with the same text all carry that id, so all of
    them count as kept if it is the smallest; ``group_size`` counts rows.  Other
    columns are ignored, whatever their names.
    """
    narrow, groups = _groups(docs, id_col, text, owners)
    out = join_groups(narrow, groups, ["text_sha256"], "n")
    single = F.col("n").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``dedup_exact`` keeps, all columns under their names; of rows that repeat id and text, one.

    A group's rows other than those with its smallest id are dropped where they are
    read; only the rows that stay for a group are shuffled, to keep one of them.
    """
    _, groups = _groups(docs, id_col, text, owners)
    sealed = Sealed(docs)
    marked = sealed.df.withColumn("_sha", F.sha2(normalised(sealed[text]), 256))
    maybe, unique = split_by_filter(marked, groups.select(F.col("text_sha256").alias("_sha")), "_sha", filter_bits(groups.count()))
    facts = groups.select(F.col("text_sha256").alias("_sha"), "keep_id", "n")
    both = join_groups(maybe, facts, ["_sha"], "n")
    kept = both.where(F.col("n").isNotNull() & sealed[id_col].eqNullSafe(F.col("keep_id"))).dropDuplicates(["_sha"])
    return sealed.restored(unique.union(both.where("n IS NULL").select(*unique.columns)).union(kept.select(*unique.columns)))
