"""Byte-level BPE: encoding through a segment tree over byte positions, and decoding.

Each leaf of the tree is a byte position; its key is the rank of the pair that
starts there, or ``NONE``.  Inner nodes hold the smaller of their two keys.  A
key carries its position in the low bits, so the root is the leftmost pair of
minimal rank.  A merge touches three leaves (the merged pair, the pair before it
and the position swallowed), hence three climbs of logarithmic length.

``merge`` does this for one piece of any length.  Most pieces are short, and there
``merge_many`` keeps a tree for each of thousands of pieces and advances all of them by
one merge in a step.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches

NONE = 1 << 62
SHIFT = 32
MASK = (1 << SHIFT) - 1
#: Pieces up to this many bytes are remembered, and merged many at a time.
CACHED_BYTES = 64
#: Bytes of remembered pieces of a Python worker, twice this many at most, and the part of an entry that is not its text and ids.
CACHE_BYTES, ENTRY_BYTES = 16 << 20, 170
#: Leaves of the trees that are stepped together.
TREE_CELLS = 1 << 17
#: Characters whose pieces are held at once.
STRETCH = 1 << 18


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 2).bit_length())
    get = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    leaves = [NONE if (r := get(piece[i : i + 2])) is None else (r << SHIFT) | i for i in range(n - 1)]
    tree = [NONE] * size + leaves + [NONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (top := tree[1]) < NONE:
        i = top & MASK
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        changed = []
        if end < n:
            r = get(piece[i : after[end]])
            changed.append((size + i, NONE if r is None else (r << SHIFT) | i))
            changed.append((size + j, NONE))
        else:
            changed.append((size + i, NONE))
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            changed.append((size + p, NONE if r is None else (r << SHIFT) | p))
        for k, key in changed:
            if tree[k] == key:
                continue
            tree[k] = key
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < key:
                    key = other
                if tree[k] == key:
                    break
                tree[k] = key
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairTable:
    """Rank of the token that two neighbouring tokens form, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a << SHIFT | b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where there is no such token."""
        if not len(self.keys):
            return np.full(len(a), -1, dtype=np.int64)
        key = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_many(pieces: list[bytes], size: int, table: PairTable) -> list[bytes]:
    """Packed ids of pieces of 1 to ``size`` bytes (a power of two): one segment tree a piece, all trees a step at a time.

    Row r of ``tree`` is the tree of piece r, with its leaves from column ``size`` on.  In
    a step every piece that has a pair left makes its merge: the root names it, three
    leaves change, and their ancestors are refreshed level by level.
    """
    n = np.array([len(p) for p in pieces])
    rows, levels = len(pieces), size.bit_length() - 1
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(size)
    alive = place[None, :] < n[:, None]
    flat = table.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    token = flat[np.minimum(starts[:, None] + place, len(flat) - 1)]
    after = np.broadcast_to(np.arange(1, size + 2), (rows, size + 1)).copy()
    before = after - 2
    tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
    r, i = np.nonzero(alive[:, 1:])
    rank = table.find(token[r, i], token[r, i + 1])
    tree[r, size + i] = np.where(rank < 0, NONE, rank << SHIFT | i)
    for k in range(levels - 1, -1, -1):
        at = 1 << k
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
    r = np.arange(rows)
    while True:
        top = tree[r, 1]
        live = top < NONE
        r, top = r[live], top[live]
        if not len(r):
            break
        i = top & MASK
        j = after[r, i]
        end = after[r, j]
        made = top >> SHIFT
        token[r, i] = made
        alive[r, j] = False
        after[r, i] = end
        before[r, end] = i
        prior = before[r, i]
        right = np.where(end < n[r], table.find(made, token[r, np.minimum(end, size - 1)]), -1)
        left = np.where(prior >= 0, table.find(token[r, np.maximum(prior, 0)], made), -1)
        tree[r, size + i] = np.where(right < 0, NONE, right << SHIFT | i)
        tree[r, size + j] = NONE
        has = np.flatnonzero(prior >= 0)
        tree[r[has], size + prior[has]] = np.where(left < 0, NONE, left << SHIFT | prior)[has]
        row = np.concatenate([r, r, r[has]])
        node = np.concatenate([size + i, size + j, size + prior[has]])
        for _ in range(levels):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
    packed = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Pieces:
    """Packed ids by piece, kept for two generations so that frequent pieces stay; bounded by bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.whole = bool((self.table.byte >= 0).all())
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def packed(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces, in order."""
        if self.size > CACHE_BYTES:
            self.now, self.old, self.size = {}, self.now, 0
        now, old = self.now, self.old
        missing = set().union(*lists).difference(now)
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        long = []
        for piece in missing:
            if (got := old.get(piece)) is None:
                raw = piece.encode("utf-8")
                n = len(raw)
                if (rank := self.ranks.get(raw)) is not None:
                    got = rank.to_bytes(4, "little")
                elif n > CACHED_BYTES or not self.whole:
                    ids = merge(raw, self.ranks)
                    got = struct.pack(f"<{len(ids)}I", *ids)
                    long.append(piece)
                else:
                    sizes.setdefault(max(2, 1 << (n - 1).bit_length()), []).append((piece, raw))
                    continue
            now[piece] = got
            self.size += ENTRY_BYTES + len(piece) + len(got)
        for size, some in sizes.items():
            step = max(1, TREE_CELLS // size)
            for a in range(0, len(some), step):
                part = some[a : a + step]
                for (piece, _), got in zip(part, merge_many([raw for _, raw in part], size, self.table), strict=True):
                    now[piece] = got
                    self.size += ENTRY_BYTES + len(piece) + len(got)
        out = [b"".join(map(now.__getitem__, pieces)) for pieces in lists]
        for piece in long:
            self.size -= ENTRY_BYTES + len(piece) + len(now.pop(piece))
        return out


class ByteBPE:
    """Encoder and decoder for one set of ranks and one pre-tokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.pieces = _Pieces(ranks)

    def pack_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; STRETCH characters are taken at a time."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            if len(text) > STRETCH:
                yield from self.pieces.packed(held)
                held, n = [], 0
                found = (m.group() for m in self.pattern.finditer(text))
                yield b"".join(self.pieces.packed([part])[0] for part in iter(lambda: list(islice(found, STRETCH // 4)), []))
                continue
            held.append(self.pattern.findall(text))
            n += len(text)
            if n > STRETCH:
                yield from self.pieces.packed(held)
                held, n = [], 0
        yield from self.pieces.packed(held)

    def encode(self, text: str) -> list[int]:
        (packed,) = self.pack_many([text])
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def _codec(data: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(parse_ranks(data), pattern)


def read_vocabulary(path: str) -> bytes:
    """Bytes of a vocabulary file on the driver (half a megabyte or so; bounded by the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def tokenize(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids again, one row per input row, without a shuffle.

    Columns: those of ``keep`` (default ``doc_id``), n_tokens (long), token_ids
    (array<int>, if ``with_ids``), ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (decoded bytes) and round_trip (boolean: decoded bytes
    equal the text's UTF-8).  Null text counts as empty: no ids.  Texts are encoded
    whole; memory in a worker is that of one Arrow batch, the ids of one text and a
    cache bounded by bytes.  A column of ``keep`` that is named like an output gives
    way to it; columns of ``docs`` that are not in ``keep`` are not read.
    """
    small_batches(docs.sparkSession)
    made = {"n_tokens": "long", **({"token_ids": "array<int>"} if with_ids else {}), "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"}
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in made]
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"{n} {t}" for n, t in made.items()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        codec = _codec(sent.value, pattern)
        for whole in batches:
            sizes = np.cumsum(pa.compute.binary_length(whole.column("_text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                # About a stretch of texts at a time, one at least.
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, "right")))
                batch = whole.slice(at, end - at)
                at = end
                texts = batch.column("_text").to_pylist()
                rows = []
                for body, packed in zip(texts, codec.pack_many(texts), strict=True):
                    flat = np.frombuffer(packed, dtype="<u4")
                    decoded = b"".join(codec.decode(flat[a : a + STRETCH].tolist()) for a in range(0, len(flat), STRETCH))
                    rows.append((len(flat), flat.astype("int32") if with_ids else None, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == body.encode("utf-8")))
                n, ids, a, b, same = map(list, zip(*rows, strict=True))
                cols = [batch.column(c) for c in kept] + [pa.array(n, pa.int64()), *[pa.array(ids, pa.list_(pa.int32()))] * with_ids, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    out = src.mapInArrow(run, ", ".join(fields))
    return out.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


__all__ = ["ByteBPE", "PairTable", "merge", "merge_many", "parse_ranks", "read_vocabulary", "tokenize"]
