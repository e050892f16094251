"""Operators on texts against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact, language, minhash, mixing, pii, secrets, sharding, toxicity
from tidewell.llm.components import connected_components
from tidewell.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=True):
    """Documents 0, 1 ... with clashing extra columns."""
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"_id": F.lit(1), "_t": F.lit("x"), "shard": F.lit(2), "n": F.lit(3), "key": F.lit("k"), "component": F.lit(9)}) if extra else df


AWKWARD = [None, "", " ", "\n\t ", "a", "ß😀 é x", "word " * 3000, "x" * 20_000, "1" * 5000, "a@" * 2000, "token: token: secret=abcdef", "same text here", "same  text\nhere", "same text here"]

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_brute(t):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


def luhn_brute(s):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0


def pii_brute(t):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn_brute(d)]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return ",".join(out)


def mixed_texts(parts, n=150, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_secret_spans(spark):
    parts = ["token", "=", ": ", '"', "secret", "API_KEY", "apikey", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefdeadbeef", " ", "é", "😀", "password", "short", "/+=", "\n", "'"]
    texts = AWKWARD + mixed_texts(parts) + ["token=abcdef " * 700]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts), F.col("source"), F.col("source")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = secret_brute(t or "")
        assert got[i].spans == want, t
        kinds = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert got[i].n_live + got[i].n_example == len([x for x in want.split(",") if x])


def test_secrets_of_many_owners_are_examples(spark):
    texts = ["token=example123"] * 6 + ["token=onlyhere99", "token=example123 token=onlyhere99"]
    got = {r.doc_id: r.classes for r in secrets.scan_secrets(frame(spark, texts), F.col("source"), F.concat("source", "lang")).collect()}
    assert got[0] == "example" and got[6] == "live" and got[7] == "example,live"
    assert secrets.scan_secrets(frame(spark, texts).where("false"), F.col("source"), F.col("source")).count() == 0


def test_secrets_report_owners_and_repositories(spark):
    rows = [(i, "token=copied12345", "one", f"r{i}") for i in range(5)] + [(5, "token=rare123456 token=copied12345", "two", "r0"), (6, "no", "two", "r1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, who string, repo string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df, F.col("who"), F.col("repo")).collect()}
    assert (got[0].classes, got[0].n_owners, got[0].n_repositories) == ("live", "2", "6")
    assert (got[5].classes, got[5].n_owners, got[5].n_repositories) == ("live,live", "1,2", "1,6")
    assert (got[6].classes, got[6].n_owners, got[6].n_repositories) == ("", "", "")
    for least, want in ((6, "live,example"), (7, "live,live")):
        got = {r.doc_id: r for r in secrets.scan_secrets(df, F.col("who"), F.col("repo"), repositories_of_an_example=least).collect()}
        assert got[5].classes == want and got[5].n_live == want.count("live")


def test_pii_spans(spark):
    parts = ["a@b.co", "m_x@", "y-z.org", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0001.02.003.4", "4111 1111 1111 1111", "4111111111111112", "-", " ", "+", "+44 (20) 7946-0958", "12", "é😀", "%", "x", "\n"]
    texts = AWKWARD + mixed_texts(parts)
    got = {r.doc_id: r for r in pii.scan_pii(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base_spans == pii_brute(t or ""), t


def test_pii_checksums_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB82 WEST 1234 5698 7654 33 ok", "phone +44 20 7946 0958", "example +44 20 7946 0958"]
    got = {r.doc_id: r for r in pii.scan_pii(frame(spark, texts)).collect()}
    assert got[0].n_iban == 1 and "iban:5:32" in got[0].spans and got[1].n_iban == 0
    assert float(got[2].scores) == 0.7 and float(got[3].scores) == 0.2
    assert pii.scan_pii(frame(spark, texts).where("false")).count() == 0


def test_bpe_equals_library(spark):
    import tiktoken

    ranks, pattern = vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={})
    texts = AWKWARD + ["<|endoftext|> 日本語 " * 50, "ab" * 5000, "don't 12345 !!??  x\r\n"]
    got = {r.doc_id: r for r in bpe.tokenize(frame(spark, texts), ranks, pattern).collect()}
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids) and got[i].round_trip
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.tokenize(frame(spark, texts).where("false"), ranks, pattern).count() == 0
    clash = bpe.tokenize(frame(spark, ["a b"]).withColumn("N_TOKENS", F.lit("x")), ranks, pattern, keep=["doc_id", "N_TOKENS", "key"], with_ids=False)
    assert clash.columns == ["doc_id", "key", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] and clash.first().n_tokens == 2


def test_merge_on_random_bytes():
    import tiktoken

    rng = random.Random(2)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 700:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if len(a + b) < 9:
            ranks.setdefault(a + b, len(ranks))
    known = tiktoken.Encoding("r", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    tokens, pieces = list(ranks), []
    for _ in range(300):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 40)))
        want = known._core_bpe.encode_single_piece(piece)
        assert bpe.merge(piece, ranks) == want
        if piece not in ranks and len(piece) <= 64:
            pieces.append((piece, struct.pack(f"<{len(want)}I", *want)))
    table = bpe.PairTable(ranks)
    assert len(pieces) > 100 and bpe.merge_many([p for p, _ in pieces], 64, table) == [w for _, w in pieces]
    assert bpe.merge_many([b"ab", b"c"], 2, table) == [struct.pack(f"<{len(i)}I", *i) for i in (bpe.merge(b"ab", ranks), bpe.merge(b"c", ranks))]


def test_bpe_takes_texts_in_stretches_and_forgets(monkeypatch):
    ranks, pattern = vocabulary()
    whole = bpe.ByteBPE(bpe.parse_ranks(ranks), pattern)
    texts = [words(GERMAN, 300, 1), "", words(ENGLISH, 20, 2), "x" * 500, " " * 90, "Zwölf Boxkämpfer jagen 12345"] * 2
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "STRETCH", 40)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 900)
    monkeypatch.setattr(bpe, "TREE_CELLS", 16)
    small = bpe.ByteBPE(bpe.parse_ranks(ranks), pattern)
    assert [np.frombuffer(p, "<u4").tolist() for p in small.pack_many(texts)] == want


def exact_brute(texts):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        groups[t].append(i)
    return [(i, groups[t][0], len(groups[t]), groups[t][0] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)]


def test_exact(spark):
    texts = AWKWARD + ["copy"] * 40 + [f"unique {i}" for i in range(200)] + ["copy "]
    for owners in (1, 5):
        assert sorted(tuple(r) for r in exact.dedup_exact(frame(spark, texts), owners=owners).collect()) == exact_brute(texts)
    kept = {r.doc_id for r in exact.without_copies(frame(spark, texts)).collect()}
    assert kept == {r[0] for r in exact_brute(texts) if r[3]}
    assert exact.dedup_exact(frame(spark, texts).where("false")).count() == 0


def test_exact_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b"), (4, "c"), (4, "d")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.dedup_exact(df).collect()]
    assert Counter(rows) == Counter([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True), (4, 4, 1, True), (4, 4, 1, True)])
    assert sorted((r.doc_id or 0, r.text) for r in exact.without_copies(df).collect()) == [(0, "b"), (3, "a"), (4, "c"), (4, "d")]
    extra = {c: F.lit(i) for i, c in enumerate(("_w", "_at", "_kept", "_i", "_sha", "n", "keep_id", "c0", "__hit", "text_sha256"))}
    left = exact.without_copies(df.withColumns(extra))
    assert left.columns == [*df.columns, *extra] and sorted((r.doc_id or 0, r.text, r._kept, r.keep_id) for r in left.collect()) == [(0, "b", 2, 6), (3, "a", 2, 6), (4, "c", 2, 6), (4, "d", 2, 6)]


def test_rice_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 1000):
        v = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (exact.rice_decode(exact.rice_encode(v)) == v).all()
    v = np.array([0, 1, 2**64 - 1], dtype=np.uint64)
    assert (exact.rice_decode(exact.rice_encode(v)) == v).all()


def near_brute(texts, width):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = list(AWKWARD)
    for size in (3, 4, 5, 6, 9, 20, 60, 200):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(14):
            new = list(base)
            for _ in range(rng.randrange(0, 1 + size // 9)):
                at = rng.randrange(len(new))
                new[at] = rng.choice(words)
            if rng.random() < 0.2:
                new.append("tail")
            texts.append(" ".join(new))
    texts += [" ".join(rng.choice(words) for _ in range(60)) + " " + passage for _ in range(25)]
    family = [rng.choice(words) for _ in range(120)]
    for _ in range(80):
        new = list(family)
        for _ in range(rng.randrange(0, 14)):
            new[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_near(spark, width):
    texts = near_texts()
    got = sorted(tuple(r) for r in minhash.dedup_near(frame(spark, texts), width=width).collect())
    assert got == near_brute(texts, width)
    kept = {r.doc_id for r in minhash.without_near_copies(frame(spark, texts), width=width).collect()}
    assert kept == {r[0] for r in near_brute(texts, width) if r[3]}


def test_near_of_nothing(spark):
    assert minhash.dedup_near(frame(spark, ["a"]).where("false"), width=2).count() == 0
    rows = minhash.dedup_near(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, ""), (5, "a b c")], "doc_id long, text string"), width=2).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter([(None, 5, False), (None, 5, False), (5, 5, True), (5, 5, True)])


def test_near_with_repeated_ids(spark):
    x, y = "one two three four five six seven eight nine ten eleven", "some other words that nobody else has written down here"
    extra = {"_w": F.lit(1), "_at": F.lit(2), "_hit": F.lit(3), "__word": F.lit(4), "row": F.lit(5), "c0": F.lit(6), "_row": F.lit(7), "rep": F.lit(8), "h1": F.lit(9)}
    rows = [(3, x + " twelve"), (5, x), (5, y), (5, y), (7, None), (7, "lone"), (None, y + " now"), (None, "nobody has this at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.dedup_near(df, width=2).collect())
    assert got == Counter([(3, 11, 3, True), (5, 10, 3, False), (5, 9, 5, True), (5, 9, 5, True), (7, 0, 7, True), (7, 1, 7, True), (None, 10, 5, False), (None, 4, None, True)])
    left = minhash.without_near_copies(df, width=2)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text, r._w, r.h1) for r in left.collect()) == Counter((i, t, 1, 9) for i, t in (rows[0], rows[2], rows[3], rows[4], rows[5], rows[7]))


@pytest.mark.parametrize("dense", [0.001, 64, 1e9])
def test_common_counts(monkeypatch, dense):
    monkeypatch.setattr(minhash, "DENSE", dense)
    monkeypatch.setattr(minhash, "SPARSE_PAIRS", 50)
    monkeypatch.setattr(minhash, "SLICE", 7)
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(1, 80))) for _ in range(n)] for n in (40, 30))
    assert (minhash.common_counts(a, b) == np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_sharding(spark):
    texts = AWKWARD + [f"text {i}" for i in range(600)]
    df = frame(spark, texts).union(frame(spark, ["again"]))
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == len(texts) + 1 and {r.law for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
        t = "again" if r.doc_id == 0 and r.size == 6 else texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert min(map(len, slots.values())) > 40
    assert sharding.shard_documents(df.where("false")).count() == 0
    nothing = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert len({r.shard for r in sharding.shard_documents(nothing).collect()}) == 1


def test_weights_confine_movement(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.default_tree(8)
    heavier = {**tree, "g0": {**tree["g0"], "g0/r1": {2: 1.0, 3: 3.0}}}
    rows = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), heavier).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(r.b in (0, 1, 2, 3) for r in moved)
    share = Counter(r.b for r in rows)
    assert share[3] / len(rows) == pytest.approx(3 / 10, abs=0.04)
    assert not any(r.a in (4, 5, 6, 7) and r.b in (4, 5, 6, 7) for r in moved)


def schedule_of(spark, weights, block, period):
    rows = mixing.quotas(spark.createDataFrame(list(weights.items()), "source string, weight double"), block, period)
    rows = {r.source: r for r in rows.collect()}
    table = spark.createDataFrame([tuple(r) for r in rows.values()], "source string, k int, q long, p long, slots long")
    return rows, {r.source: np.array(r["at"]) for r in mixing.schedule(table, stretch=100).collect()}


@pytest.mark.parametrize("case", ["few", "uneven", "many"])
def test_schedule_keeps_within_a_block_of_the_target_weights(spark, case):
    weights = {
        "few": {"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5, "e": 0.01},
        "uneven": {"hot": 99_990.0, "small": 10.0, "tiny": 1e-5, **{f"s{i}": 700.5 + i for i in range(19)}},
        "many": {f"s{i:06}": 50.0 if i < 3 else 1.0 + i % 7 for i in range(100_000)},
    }[case]
    block, period = (8, 50) if case == "few" else (16, 1000)
    rows, at = schedule_of(spark, weights, block, period)
    slots = rows["a" if case == "few" else min(rows)].slots
    taken = np.concatenate([at[k] for k in rows])
    assert sorted(taken) == list(range(slots)) and all(len(at[k]) == rows[k].p for k in rows)
    whole = sum(weights.values())
    checked = list(weights) if case != "many" else [*sorted(weights)[:40], *sorted(weights)[-40:]]
    m = np.arange(max(2, 1_000_000 // slots))[:, None]
    for k in checked:
        r, quota = rows[k], weights[k] / whole * block * period
        start, n = m * r.q // mixing.UNIT, (m + 1) * r.q // mixing.UNIT - m * r.q // mixing.UNIT
        slot = m * slots + at[k][None, :]
        j = np.arange(r.p)[None, :]
        before, after = start + j * n // r.p, start + (j + 1) * n // r.p
        assert (after - before).max() <= block
        assert np.abs(before - quota * slot / slots).max() < block and np.abs(after - quota * (slot + 1) / slots).max() < block


def test_mix_places_every_row(spark):
    odd = {"slot": F.lit(1), "nth": F.lit(2), "_parts": F.lit(3), "q": F.lit(4), "_rank": F.lit(5), "c0": F.lit(6), "MIX_ROW": F.lit("x"), "_g": F.lit(7)}
    df = frame(spark, AWKWARD * 10).withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.when(F.col("doc_id") % 7 > 2, "big").otherwise("small"))).withColumns(odd)
    out = mixing.mix(df, block=4, period=10)
    assert out.columns == [*df.columns[:-2], "_g", "mix_block", "mix_slot", "mix_row"]
    rows = out.collect()
    assert len(rows) == 140 and len({(r.source, r.mix_block, r.mix_row) for r in rows}) == 140 and all(r.nth == 2 and r._rank == 5 for r in rows)
    owner, blocks = defaultdict(set), defaultdict(list)
    for r in rows:
        owner[r.mix_slot].add((r.source, r.mix_block))
        blocks[r.source, r.mix_block].append(r.mix_row)
    assert all(len(v) == 1 for v in owner.values()) and all(sorted(v) == list(range(len(v))) and len(v) <= 4 for v in blocks.values())
    assert mixing.mix(df.where("false")).count() == 0
    some = mixing.mix(df, spark.createDataFrame([("big", 1.0), ("absent", 2.0), (None, 1.0), ("zero", 0.0)], "source string, weight double")).collect()
    assert len(some) == 140 and all((r.mix_slot is None) == (r.source != "big") for r in some)
    twice = spark.createDataFrame([(None, None), (1, "s"), (1, "s")], "doc_id long, source string")
    assert len({(r.mix_slot, r.mix_row) for r in mixing.mix(twice).collect()}) == 3


def test_mix_keeps_to_target_weights_over_many_periods(spark):
    sizes = {"hot": 18_000, **{f"s{i:02}": 1894 for i in range(19)}, "tiny": 6}
    names = F.array(*(F.lit(k) for k in sizes))
    ends = F.array(*(F.lit(sum(list(sizes.values())[: i + 1])) for i in range(len(sizes))))
    total = sum(sizes.values())
    at = F.size(F.filter(ends, lambda e: e <= F.col("doc_id")))
    df = spark.range(total).withColumnRenamed("id", "doc_id").withColumn("source", F.get(names, at))
    weights = {k: float(n) for k, n in sizes.items()}
    rows = mixing.mix(df, block=8, period=100).orderBy("mix_slot", "mix_row").collect()
    assert len(rows) == total and len({(r.mix_slot, r.mix_row) for r in rows}) == total
    # With weights in proportion to sizes all sources run dry together, so every stretch holds the corpus's proportions.
    done = Counter()
    for t, r in enumerate(rows, 1):
        done[r.source] += 1
        if t % 500 == 0:
            assert all(abs(done[k] - w / total * t) < 2 * 8 for k, w in weights.items())


ENGLISH = "the house of the people that were with them and then they have this".split()
GERMAN = "der hund und die katze sind nicht auf dem haus mit der größe über".split()


def words(pool, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(pool) for _ in range(n))


def test_language(spark):
    rows = [(i, words(ENGLISH if i % 2 else GERMAN, 20, i), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    model = language.fit(df.where("key < 100"))
    out = {r.key: r for r in language.predict(df, model, keep={"key": F.col("key")}).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    odd = {r.doc_id: r for r in language.predict(frame(spark, AWKWARD), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3, 8))
    assert all(0 <= r.score <= 1 for r in odd.values())
    empty = language.fit(df.where("false"))
    assert {r.lang_pred for r in language.predict(df, empty, keep={"key": F.col("key")}).collect()} == {"und"}


def test_vectors_of_letters_and_brute_force_bundles(monkeypatch):
    """Bundles against one-by-one binding of permuted letter vectors, on several scripts."""
    monkeypatch.setattr(language, "CELLS", 64)
    monkeypatch.setattr(language, "VECTORS", 5)
    texts = ["Der Hund", "Привет, мир! Привет", "日本語のテキスト", "", "a  b", "Ł ł É é", "12 x3y", "😀 𝒜b"]
    got, letters, kinds = language.bundle(texts)

    def vector(c):
        bits = language.letter_bits(np.array([ord(c) if c else 0]))[0]
        return np.unpackbits(bits.view(np.uint8)).astype(int) * 2 - 1

    for text, v, n, k in zip(texts, got, letters, kinds, strict=True):
        folded = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "" for c in f" {text} "]
        folded = [c for i, c in enumerate(folded) if i == 0 or c or folded[i - 1]]
        tri = [folded[i : i + 3] for i in range(len(folded) - 2) if folded[i + 1]]
        want = sum((np.roll(vector(a), 128) * np.roll(vector(b), 64) * vector(c) for a, b, c in tri), np.zeros(language.DIM, int))
        assert (v == want).all() and n == sum(map(bool, folded)) and k == len(set(map(tuple, tri)))
    a, b = vector("é"), vector("ł")
    assert abs((a @ b) / language.DIM) < 0.15


def test_noise_resembles_no_language(spark):
    rows = [(i, words(ENGLISH if i % 2 else GERMAN, 60, i), "en" if i % 2 else "de") for i in range(100)]
    model = language.fit(spark.createDataFrame(rows, "key long, text string, lang string"), max_rows=20)
    rng = random.Random(0)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(3000)) for _ in range(10)]
    clean = [*(words(ENGLISH, n, n) for n in range(1, 60)), "the " * 900, "x"]
    out = {r.doc_id: r for r in language.predict(frame(spark, noise + clean + [None, "123"]), model).collect()}
    assert sum(out[i].alike for i in range(10)) <= 1
    assert all(out[10 + i].alike for i in range(len(clean))) and not out[10 + len(clean)].alike and not out[11 + len(clean)].alike


def test_languages_of_documents_not_learned_from(spark):
    """Held-out accuracy on the given documents, as the query has it."""
    from tidewell.llm.queries import op5_language_id

    data = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in op5_language_id(spark, data).collect() if r.held_out and truth[r.doc_id]]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97


def test_long_texts_bundle_like_short_ones(monkeypatch):
    text = words(ENGLISH, 400, 1)
    whole, letters, _ = language.bundle([text, "x"])
    monkeypatch.setattr(language, "PIECE", 97)
    pieces, more, _ = language.bundle([text, "x"])
    cosine = (whole[0] @ pieces[0]) / np.linalg.norm(whole[0]) / np.linalg.norm(pieces[0])
    assert cosine > 0.999 and abs(int(letters[0]) - int(more[0])) < 40


def test_marginals_against_all_taggings():
    import itertools

    rng = np.random.default_rng(1)
    model = {"trans": rng.normal(size=(2, 2)), "bias": -2.0, "start": rng.normal(size=2)}
    for n, at in ((7, [0, 3]), (6, [2, 5]), (8, [1, 2, 4]), (1, [0]), (9, [8])):
        emit = rng.normal(size=len(at)) * 3
        e = np.full(n, model["bias"])
        e[at] += emit
        total, mass = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            s = model["start"][tags[0]] + sum(e[i] for i in range(n) if tags[i]) + sum(model["trans"][tags[i], tags[i + 1]] for i in range(n - 1))
            total += np.exp(s)
            mass += np.exp(s) * np.array(tags)
        got = toxicity.marginals(model, np.array([n, 3]), [np.array(at), np.array([1])], [emit, np.array([0.5])])[0]
        assert np.allclose(got, (mass / total)[at])


def test_training_windows_cover_the_whole_text():
    import pandas as pd

    ids = {toxicity.features("house")[0]: 0, toxicity.features("nasty")[0]: 1}
    for n in (1, 31, 32, 33, 64, 500):
        text = " ".join((["house"] + ["the"] * 70) * 7)[: n * 4] + " nasty"
        tokens = text.split()
        made = next(toxicity._windows(ids, {1})(iter([pd.DataFrame({"text": [text], "y": [1]})])))
        assert (made["n"] * made["m"]).sum() == len(tokens) and made["m"].sum() == -(-len(tokens) // toxicity.WINDOW)
        assert sum(len(f) for f in made["f"]) == sum(t in ("house", "nasty") for t in tokens) and sum(len(t) for t in made["tags"]) == 1
    assert not len(next(toxicity._windows(ids, {1})(iter([pd.DataFrame({"text": [""], "y": [1]})]))))


def test_likelihood_and_gradient_against_all_taggings(monkeypatch):
    import itertools
    from types import SimpleNamespace

    monkeypatch.setattr(toxicity, "TOGETHER", 2)
    rng = np.random.default_rng(7)
    windows = [SimpleNamespace(n=5, at=[0, 3, 3], f=[0, 1, 2], tags=[3], m=2), SimpleNamespace(n=4, at=[], f=[], tags=[], m=7), SimpleNamespace(n=1, at=[0], f=[2], tags=[0], m=1)]
    chains = toxicity._Chains(windows, 3)
    theta = rng.normal(size=10)

    def brute(x):
        total = chains.l2 / 2 * (x @ x)
        for w in windows:
            scores = {}
            for tags in itertools.product((0, 1), repeat=w.n):
                s = x[8 + tags[0]] + sum(x[4 + 2 * a + b] for a, b in zip(tags, tags[1:])) + x[3] * sum(tags)
                scores[tags] = s + sum(x[f] * tags[i] for i, f in zip(w.at, w.f))
            gold = tuple(int(i in w.tags) for i in range(w.n))
            total += w.m * (np.log(sum(np.exp(v) for v in scores.values())) - scores[gold])
        return total

    value, grad = chains(theta)
    assert value == pytest.approx(brute(theta))
    steps = np.eye(10) * 1e-5
    assert np.allclose(grad, [(brute(theta + d) - brute(theta - d)) / 2e-5 for d in steps], atol=1e-4)
    best = toxicity._minimise(chains, np.zeros(10))
    assert np.abs(chains(best)[1]).max() < 0.05 and chains(best)[0] < chains(theta)[0]


def test_toxicity_of_documents_not_learned_from(spark):
    """Held-out figures on the given documents, as the query has it."""
    from tidewell.llm.queries import op7_toxicity

    data = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in op7_toxicity(spark, data).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert len(toxic) >= 20 and sum(toxic) / len(toxic) >= 0.85 and sum(clean) / len(clean) <= 0.03


def test_toxicity(spark):
    bad = ["nasty", "vileness", "scumbag"]
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        t = [rng.choice(ENGLISH) for _ in range(40)]
        if i % 4 == 0:
            for w in rng.sample(bad, 2):
                t[rng.randrange(40)] = w
        texts.append(" ".join(t))
        labels.append((i, int(i % 4 == 0)))
    df, known = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known.where("doc_id < 200"))
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(200, 300)]
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) >= 97
    for i in held:
        for span in filter(None, out[i].offsets.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[i][a:b] in bad
    odd = toxicity.score(frame(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, known.where("false"))).collect()} == {0.0}
