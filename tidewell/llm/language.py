"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram's
vector binds (multiplies) its letters' vectors, each permuted by its place; a text's
vector bundles (adds) the vectors of its trigrams; a language's prototype bundles its
training texts.  A text gets the language whose centred prototype has the largest cosine
with it.

Vectors are kept as bits, where binding is XOR and the permutation a rotation by words.
Trigrams are counted per slice over those that occur there, so bundling is one product of
a count matrix with a matrix of trigram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import sampled, small_batches

DIM = 1024
SEED = 20240229
#: Characters bundled at once; longer texts are taken in pieces, which bounds memory.
PIECE = 1 << 18
ROWS = 256
#: Entries of a matrix of counts, and trigram vectors, that are held at once.
CELLS, VECTORS = 1 << 20, 2048
#: Training rows of a language at most; a language with fewer is used whole.
MAX_ROWS_PER_LANGUAGE = 10_000
#: A text with this many different trigrams whose cosine stays below NOISE resembles no learned language.
#: Random letters stay below 0.13 and mostly below NOISE; texts of a learned language with so many trigrams reach 0.3.
ENOUGH_TRIGRAMS, NOISE = 150, 0.1


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Of each code point, the letter it counts as: its lower case, 0 for all that is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for cp in range(0x323B0):  # no letters beyond
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """DIM random bits of each code point as 64-bit words (splitmix64 of code point and place)."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = letters.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + words + np.uint64(SEED)
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def trigram_vectors(letters: np.ndarray) -> np.ndarray:
    """Vectors (+1, -1) of trigrams, given as rows of three code points."""
    a, b, c = (letter_bits(letters[:, k]) for k in range(3))
    bound = np.roll(a, 2, axis=1) ^ np.roll(b, 1, axis=1) ^ c
    return np.unpackbits(bound.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, letters) arrays covering the texts; each text is framed by one non-letter."""
    table = _folded()
    rows: list[int] = []
    parts: list[str] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return np.repeat(np.array(rows, dtype=np.int32), [len(p) for p in parts]), table[cps]

    for i, text in enumerate(texts):
        framed = f" {text} "
        for at in range(0, max(1, len(framed) - 2), PIECE):
            parts.append(framed[at : at + PIECE + 2])
            rows.append(i)
            size += len(parts[-1])
            if size >= PIECE:
                yield flush()
                rows, parts, size = [], [], 0
    if parts:
        yield flush()


def trigrams(row: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and trigrams (code points) of a piece; runs of non-letters count as one, and those in the middle do not count."""
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (row[1:] != row[:-1])
    row, letters = row[keep], letters[keep]
    inside = np.flatnonzero((row[:-2] == row[2:]) & (letters[1:-1] > 0))
    return row[inside], np.stack([letters[inside], letters[inside + 1], letters[inside + 2]], axis=1)


def _distinct(three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and, for each row of ``three``, which it is."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[three.ravel()] = True
    known = np.flatnonzero(seen)
    n = len(known)
    number = np.zeros(0x110000, dtype=np.int32)
    number[known] = np.arange(n)
    key = (number[three[:, 0]].astype(np.int64) * n + number[three[:, 1]]) * n + number[three[:, 2]]
    if n**3 <= 1 << 21:
        used = np.zeros(n**3, dtype=bool)
        used[key] = True
        ids = np.flatnonzero(used)
        at = (np.cumsum(used, dtype=np.int32) - 1)[key]
    else:
        ids, at = np.unique(key, return_inverse=True)
    return np.stack([known[ids // (n * n)], known[ids // n % n], known[ids % n]], axis=1), at


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the texts (texts x DIM), their letter counts, and the most different trigrams of a piece of each."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    letters, kinds = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for row, cps in _pieces(texts):
        letters += np.bincount(row[cps > 0], minlength=len(texts))
        row, three = trigrams(row, cps)
        if not len(row):
            continue
        ids, at = _distinct(three)
        # Rows of a piece follow one another, so a block of rows is a stretch of the piece.
        step = max(1, CELLS // len(ids))
        for first in range(int(row[0]), int(row[-1]) + 1, step):
            a, b = np.searchsorted(row, [first, first + step])
            rows = min(step, len(texts) - first)
            counts = np.bincount((row[a:b] - first).astype(np.int64) * len(ids) + at[a:b], minlength=rows * len(ids)).reshape(rows, len(ids)).astype(np.float32)
            kinds[first : first + rows] = np.maximum(kinds[first : first + rows], (counts > 0).sum(axis=1))
            used = np.flatnonzero(counts.any(axis=0)) if rows < 8 else np.arange(len(ids))
            for k in range(0, len(used), VECTORS):
                some = used[k : k + VECTORS]
                out[first : first + rows] += counts[:, some] @ trigram_vectors(ids[some])
    return out, letters, kinds


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS_PER_LANGUAGE) -> dict:
    """Prototypes from columns ``text``, ``lang`` and ``key`` (any stable value, for the sample).

    About ``max_rows`` rows of each language are read at most, chosen by a hash of
    ``key``; of fewer, all.  One count and one vector per language reach the driver.  Rows
    without text or language teach nothing; texts without letters have no vector.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", "key")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if large := {lang: k for lang, k in n.items() if k > max_rows}:
        share = F.lit(1.0)
        for lang, k in large.items():
            share = F.when(F.col("lang") == lang, max_rows / k).otherwise(share)
        rows = sampled(rows, F.col("key"), share)

    def partial(batches: Iterator) -> Iterator:
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for a in range(0, len(b), ROWS):
                part = b.iloc[a : a + ROWS]
                vectors, _, _ = bundle(part["text"].tolist())
                size = np.linalg.norm(vectors, axis=1)
                vectors /= np.maximum(size, 1e-9)[:, None]
                for lang in part["lang"].unique():
                    sums[lang] = sums.get(lang, np.zeros(DIM)) + vectors[(part["lang"] == lang).to_numpy()].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    sums = rows.select("text", "lang").mapInPandas(partial, "lang string, v array<double>")
    found = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for r in found.collect():
        vectors.setdefault(r.lang, np.zeros(DIM))[r.i] = r.x
    langs = sorted(vectors)
    if lost := set(n) - set(langs):
        raise RuntimeError(f"no training row was drawn for {sorted(lost)}; key has too few distinct values")
    if not langs:
        return {"langs": [], "mean": np.zeros(DIM, np.float32), "prototypes": np.zeros((0, DIM), np.float32)}
    unit = np.stack([vectors[x] / max(np.linalg.norm(vectors[x]), 1e-9) for x in langs])
    mean = unit.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    centred = unit - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1), 1e-9)[:, None]
    return {"langs": langs, "mean": mean.astype(np.float32), "prototypes": centred.astype(np.float32)}


def classify(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and whether each text resembles a learned language (or is too poor to tell)."""
    vectors, letters, kinds = bundle(texts)
    if not model["langs"]:
        return ["und"] * len(texts), np.zeros(len(texts)), letters > 0
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None] - model["mean"]
    cosine = unit @ model["prototypes"].T / np.maximum(np.linalg.norm(unit, axis=1), 1e-9)[:, None]
    best = cosine.argmax(axis=1)
    score = np.where(letters > 0, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
    alike = (letters > 0) & ((kinds < ENOUGH_TRIGRAMS) | (score >= NOISE))
    return [model["langs"][k] if n else "und" for k, n in zip(best, letters, strict=True)], score.astype(float), alike


def predict(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``keep`` (name to expression, default doc_id) plus lang_pred, score and alike, one row per input row.

    ``und`` with score 0 if the text is null or has no letter, or no language was
    learned.  The score is the cosine with the centred prototype, cut to 0 .. 1.
    ``alike`` is false for texts without letters, and for those of at least
    ENOUGH_TRIGRAMS different trigrams whose score is below NOISE.  Ties go to the
    language first in order.  A name of ``keep`` that is an output's gives way to it.
    There is no shuffle.
    """
    small_batches(docs.sparkSession)
    made = {"lang_pred": "string", "score": "double", "alike": "boolean"}
    keep = {n: c for n, c in ({"doc_id": F.col("doc_id")} if keep is None else keep).items() if n.lower() not in made}
    src = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"{n} {t}" for n, t in made.items()]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                lang, score, alike = classify(sent.value, batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(alike)], names=[*kept, *made])

    return src.mapInArrow(run, ", ".join(fields)).withColumnsRenamed(dict(zip(kept, keep, strict=True)))
