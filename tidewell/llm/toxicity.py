"""Toxicity by a linear-chain conditional random field over tokens.

Tags are O (fine) and T (toxic).  A token's features are its word and two prefixes
of it.  Token labels come from document labels: a token of a toxic document counts
as T if one of its features is far more frequent in toxic documents, any token of a
clean document is O.  Forward-backward marginals give offending tokens; a logistic
function of the expected number of T tokens, the largest marginal and the number of
tokens gives the document's score.

Tokens without a learned feature all have the same potential, so a run of g of them
is the g-th power of one 2 x 2 matrix, taken in closed form.  Inference is exact over
the whole text and costs a step per informative token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, sampled, small_batches

#: Bounds of the training: documents of each label (read whole), and features of the model.
MAX_PER_LABEL = 6_000
MAX_FEATURES = 4_000
#: Tokens of a training window; windows follow one another through the whole text.  Windows stepped together.
WINDOW, TOGETHER = 32, 8192
PREFIXES = (4, 5)
MIN_ODDS, TAG_ODDS, MIN_DOCS = 1.5, 3.0, 3
CACHED_TOKENS = 120_000
WORDS = re.compile(r"\w+")


def features(token: str) -> list[str]:
    low = token.lower()
    return ["w" + low, *(f"{n}{low[:n]}" for n in PREFIXES if len(low) > n)]


class _Weights(dict):
    """Emission score of each token, None if it has no learned feature; two generations are kept."""

    def __init__(self, weight: dict[str, float]) -> None:
        super().__init__()
        self.weight, self.old = weight, {}

    def __missing__(self, token: str) -> float | None:
        if token in self.old:
            value = self.old[token]
        else:
            found = [w for f in features(token) if (w := self.weight.get(f)) is not None]
            value = sum(found) if found else None
        if len(self) >= CACHED_TOKENS:
            self.old = dict(self)
            self.clear()
        self[token] = value
        return value


def _sample(docs: DataFrame, labels: DataFrame, max_per_label: int) -> DataFrame:
    """Texts of at most about ``max_per_label`` documents of each label, as (text, y)."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, k in n.items():
        share = F.when(F.col("y") == y, min(1.0, max_per_label / k)).otherwise(share)
    chosen = sampled(one, F.col("doc_id"), share)
    if n and chosen.isEmpty():
        raise RuntimeError("no labelled row was drawn")
    # Twice max_per_label rows of two numbers (and some), so the broadcast has a fixed bound.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").select("text", "y")


def _frequencies(batches: Iterator) -> Iterator:
    import pandas as pd

    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, y in zip(b["text"], b["y"], strict=True):
            counts[int(y > 0)].update({f for t in set(WORDS.findall(text)) for f in features(t)})
    for y, c in counts.items():
        if c:
            yield pd.DataFrame({"f": list(c), "y": y, "n": list(c.values())})


def _power(m: np.ndarray, g: np.ndarray) -> np.ndarray:
    """m to each of the powers g, over m's largest eigenvalue; m is 2 x 2 and positive."""
    values, vectors = np.linalg.eig(m)
    values = values.real / values.real.max()
    with np.errstate(under="ignore"):
        return np.einsum("ij,nj,jk->nik", vectors.real, values[None, :] ** g[:, None], np.linalg.inv(vectors).real)


def marginals(model: dict, lengths: np.ndarray, at: list[np.ndarray], emit: list[np.ndarray]) -> list[np.ndarray]:
    """P(tag = T) of the informative tokens of each text: positions ``at``, scores ``emit``."""
    n = len(lengths)
    k = np.array([len(x) for x in at])
    deep = int(k.max()) if n else 0
    if not deep:
        return [np.zeros(0) for _ in range(n)]
    order = np.argsort(-k, kind="stable")
    live = [int((k > i).sum()) for i in range(deep)]
    pos = np.zeros((n, deep), dtype=np.int64)
    e = np.zeros((n, deep))
    for row, j in enumerate(order):
        pos[row, : k[j]], e[row, : k[j]] = at[j], emit[j]
    trans, bias = np.exp(model["trans"]), model["bias"]
    plain = np.array([1.0, np.exp(bias)])
    step = trans * plain[None, :]  # from a tag to the next, through a plain token

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    gap = np.diff(pos, axis=1, prepend=-1) - 1
    bound = np.minimum(np.maximum(e + bias, -30), 30)
    forward = np.zeros((n, deep, 2))
    state = np.tile(np.exp(model["start"]), (n, 1))  # before any token; start scores stand for a transition
    for i in range(deep):
        m = live[i]
        g = gap[:m, i]
        if i == 0:
            through = state[:m] * plain
            moved = np.einsum("nj,njk->nk", through, _power(step, np.maximum(g - 1, 0))) @ trans
            before = np.where(g[:, None] > 0, moved, state[:m])
        else:
            before = np.einsum("nj,njk->nk", forward[:m, i - 1], _power(step, g)) @ trans
        forward[:m, i] = scaled(before * np.stack([np.ones(m), np.exp(bound[:m, i])], axis=1))
    out = np.zeros((n, deep))
    rest = lengths[order] - 1
    backward = np.ones((n, 2))
    for i in range(deep - 1, -1, -1):
        m = live[i]
        last = k[order[:m]] == i + 1
        tail = np.einsum("njk->nj", _power(step, np.maximum(rest[:m] - pos[:m, i], 0)))
        if i + 1 < deep:
            nxt = np.minimum(i + 1, deep - 1)
            into = np.stack([np.ones(m), np.exp(bound[:m, nxt])], axis=1) * backward[:m]
            inner = np.einsum("njk,nk->nj", _power(step, np.maximum(gap[:m, nxt], 0)), into @ trans.T)
            backward[:m] = scaled(np.where(last[:, None], tail, inner))
        else:
            backward[:m] = scaled(tail)
        both = forward[:m, i] * backward[:m]
        out[:m, i] = both[:, 1] / both.sum(axis=1)
    result: list[np.ndarray] = [np.zeros(0)] * n
    for row, j in enumerate(order):
        result[j] = out[row, : k[j]]
    return result


def _windows(weight: dict[str, int], strong: set[int]):
    """All windows of the training texts as (tokens, positions and numbers of features, toxic positions), sparse."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                tokens = WORDS.findall(text)
                ids = {i: got for i, t in enumerate(tokens) if (got := [weight[f] for f in features(t) if f in weight])}
                found: dict[int, list[tuple[int, int]]] = {}
                for i, got in ids.items():
                    found.setdefault(i // WINDOW, []).extend((i % WINDOW, f) for f in got)
                rows = [(min(WINDOW, len(tokens) - w * WINDOW), [i for i, _ in x], [f for _, f in x], sorted({i for i, f in x if y > 0 and f in strong}), 1) for w, x in found.items()]
                # Windows without features differ by their length only: whole ones, and the last.
                whole, last = divmod(len(tokens), WINDOW)
                rows.append((WINDOW, [], [], [], whole - sum(w < whole for w in found)))
                if last and whole not in found:
                    rows.append((last, [], [], [], 1))
                yield pd.DataFrame([r for r in rows if r[4]], columns=["n", "at", "f", "tags", "m"])

    return run


class _Chains:
    """Weighted windows as arrays, and the penalised negative log-likelihood of their tags."""

    def __init__(self, windows: list, n_features: int) -> None:
        self.n_features = n_features
        self.m = np.array([w.m for w in windows], dtype=float)
        self.row = np.repeat(np.arange(len(windows)), [len(w.at) for w in windows])
        self.col = np.concatenate([np.asarray(w.at, int) for w in windows])
        self.feat = np.concatenate([np.asarray(w.f, int) for w in windows])
        self.mask = np.arange(WINDOW)[None, :] < np.array([w.n for w in windows])[:, None]
        tag = np.zeros((len(windows), WINDOW), dtype=int)
        for i, w in enumerate(windows):
            tag[i, list(w.tags)] = 1
        m, pair = self.m[:, None], self.mask[:, 1:]
        self.gold = np.concatenate([
            np.bincount(self.feat, (tag * m)[self.row, self.col], n_features), [(tag * m * self.mask).sum()],
            np.bincount((tag[:, :-1] * 2 + tag[:, 1:])[pair], np.broadcast_to(m, pair.shape)[pair], 4), np.bincount(tag[:, 0], self.m, 2),
        ])
        # The penalty grows with the windows that hold features, as the evidence does.
        self.l2 = 1e-3 * max(1.0, self.m[np.unique(self.row)].sum())

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient at ``theta``: features, bias, 4 transitions, 2 starts."""
        value, grad = self.l2 / 2 * (theta @ theta) - self.gold @ theta, self.l2 * theta - self.gold
        for a in range(0, len(self.m), TOGETHER):
            v, g = self._expected(theta, a, min(a + TOGETHER, len(self.m)))
            value, grad = value + v, grad + g
        return value, grad

    def _expected(self, theta: np.ndarray, first: int, last: int) -> tuple[float, np.ndarray]:
        k = self.n_features
        lo, hi = np.searchsorted(self.row, [first, last])
        row, col, feat = self.row[lo:hi] - first, self.col[lo:hi], self.feat[lo:hi]
        mask, m, n = self.mask[first:last], self.m[first:last], last - first
        e = theta[k] + np.bincount(row * WINDOW + col, theta[feat], n * WINDOW).reshape(n, WINDOW)
        pot = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
        a = np.exp(theta[k + 1 : k + 5]).reshape(2, 2)
        fw, bw, log = np.zeros((n, WINDOW, 2)), np.ones((n, WINDOW, 2)), np.zeros(n)
        for i in range(WINDOW):
            moved = (fw[:, i - 1] @ a) * pot[:, i] if i else pot[:, 0] * np.exp(theta[k + 5 :])
            fw[:, i] = np.where(mask[:, i : i + 1], moved, fw[:, i - 1])
            size = fw[:, i].sum(1, keepdims=True)
            fw[:, i] /= size
            log += np.where(mask[:, i], np.log(size[:, 0]), 0.0)
        for i in range(WINDOW - 2, -1, -1):
            bw[:, i] = np.where(mask[:, i + 1 : i + 2], (pot[:, i + 1] * bw[:, i + 1]) @ a.T, bw[:, i + 1])
            bw[:, i] /= bw[:, i].sum(1, keepdims=True)
        p = fw * bw
        p = (p / p.sum(2, keepdims=True))[:, :, 1] * mask
        two = fw[:, :-1, :, None] * a[None, None] * (pot[:, 1:] * bw[:, 1:])[:, :, None, :]
        two = two / two.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]
        weighted = p * m[:, None]
        start = np.array([(m * (1 - p[:, 0])).sum(), weighted[:, 0].sum()])
        want = np.concatenate([np.bincount(feat, weighted[row, col], k), [weighted.sum()], np.einsum("n,nijk->jk", m, two).ravel(), start])
        return float(m @ log), want


def _minimise(f, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(steps):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).sum())
        for (s, y), alpha in zip(steps, reversed(alphas), strict=True):
            q += s * (alpha - (y @ q) / (y @ s))
        slope, t = grad @ q, 1.0
        while True:
            new, new_grad = f(x - t * q)
            if new <= value - 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = -t * q, new_grad - grad
        done = abs(value - new) <= 1e-6 * max(1.0, abs(value))
        x, value, grad = x + s, new, new_grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        if done:
            break
    return x


def _train(windows: list, n_features: int) -> dict:
    """The penalised conditional maximum likelihood of the windows' tags."""
    theta = _minimise(_Chains(windows, n_features), np.zeros(n_features + 7))
    return {"w": theta[:n_features], "bias": float(theta[n_features]), "trans": theta[n_features + 1 : n_features + 5].reshape(2, 2), "start": theta[n_features + 5 :]}


def _evidence(model: dict, texts: list[str], cache: _Weights) -> tuple[np.ndarray, list[list[int]], list[np.ndarray]]:
    """Per text: (expected T tokens, largest marginal, tokens), informative token numbers, marginals."""
    lengths, at, emit = [], [], []
    for text in texts:
        tokens = WORDS.findall(text)
        lengths.append(len(tokens))
        hits = [(i, w) for i, w in enumerate(map(cache.__getitem__, tokens)) if w is not None]
        at.append(np.array([i for i, _ in hits], dtype=np.int64))
        emit.append(np.array([w for _, w in hits]))
    p = marginals(model, np.array(lengths), at, emit)
    facts = np.array([(x.sum(), x.max() if len(x) else 0.0, n) for x, n in zip(p, lengths, strict=True)]).reshape(-1, 3)
    return facts, [x.tolist() for x in at], p


def _design(facts: np.ndarray) -> np.ndarray:
    expected, top, n = facts.T
    return np.stack([np.ones(len(facts)), np.log1p(4 * expected), top, np.log1p(n) / 10], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> dict:
    """Model from (doc_id, text) and (doc_id, toxic); only a bounded sample is read closely.

    With no labelled text, or one label only, the score of every text is that label's
    share (0 without labels).
    """
    small_batches(docs.sparkSession)
    sample = materialize(_sample(docs, labels, max_per_label), "toxic-sample")
    n = Counter({int(r.y > 0): r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()})
    empty = {"weight": {}, "bias": 0.0, "trans": np.zeros((2, 2)), "start": np.zeros(2), "final": None, "share": float(n[1] > 0)}
    if not n[0] or not n[1]:
        return empty
    seen = sample.mapInPandas(_frequencies, "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    top = seen.withColumn("odds", odds).where((F.col("t") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "f").limit(MAX_FEATURES).collect()
    if not top:
        return empty | {"share": n[1] / (n[0] + n[1])}
    ids = {r.f: i for i, r in enumerate(top)}
    strong = {i for i, r in enumerate(top) if r.odds >= TAG_ODDS}
    # Equal windows are counted, so what reaches the driver grows with the bounded sample's different windows only.
    windows = sample.mapInPandas(_windows(ids, strong), "n int, at array<int>, f array<int>, tags array<int>, m long").groupBy("n", "at", "f", "tags").agg(F.sum("m").alias("m"))
    windows = list(windows.orderBy("n", "at", "f", "tags").toPandas().itertuples())
    crf = _train(windows, len(ids))
    model = {"weight": {f: float(crf["w"][i]) for f, i in ids.items() if abs(crf["w"][i]) > 1e-3}, "bias": crf["bias"], "trans": crf["trans"], "start": crf["start"], "final": None, "share": 0.0}

    def facts(batches: Iterator) -> Iterator:
        import pandas as pd

        cache = _Weights(model["weight"])
        for b in batches:
            x, _, _ = _evidence(model, b["text"].tolist(), cache)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (b["y"] > 0).astype("int32").to_numpy()})

    got = sample.mapInPandas(facts, "a double, b double, c double, y int").toPandas()
    model["final"] = _logistic(_design(got[["a", "b", "c"]].to_numpy()), got["y"].to_numpy())
    return model


def score(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None, rows: int = 256) -> DataFrame:
    """Columns ``keep`` (name to expression, default doc_id), score, predicted (int) and offsets, one row per input row.

    A name of ``keep`` that is an output's gives way to it.
    ``offsets`` lists start:end of the tokens whose marginal is 0.5 or more, code points,
    end exclusive.  Null text counts as empty; an empty text gets the score of a text
    without evidence.  There is no shuffle.
    """
    small_batches(docs.sparkSession)
    keep = {n: c for n, c in ({"doc_id": F.col("doc_id")} if keep is None else keep).items() if n.lower() not in ("score", "predicted", "offsets")}
    src = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kept = [f"k{i}" for i in range(len(keep))]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["score double", "predicted int", "offsets string"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        cache = _Weights(model["weight"])
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                texts = batch.column("_text").to_pylist()
                if model["final"] is None:
                    value, marks = np.full(len(texts), model["share"]), [""] * len(texts)
                else:
                    facts, at, p = _evidence(model, texts, cache)
                    value = 1 / (1 + np.exp(-np.clip(_design(facts) @ model["final"], -30, 30)))
                    marks = []
                    for t, where, q in zip(texts, at, p, strict=True):
                        bad = {i for i, x in zip(where, q, strict=True) if x >= 0.5}
                        marks.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(WORDS.finditer(t)) if i in bad) if bad else "")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype("int32")), pa.array(marks, pa.string())], names=[*kept, "score", "predicted", "offsets"])

    return src.mapInArrow(run, ", ".join(fields)).withColumnsRenamed(dict(zip(kept, keep, strict=True)))
