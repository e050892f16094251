"""The registered queries of this subpackage: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, embedding, exact, language, minhash, mixing, pii, secrets, sharding, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, owner=F.col("source"), repository=F.col("lang"), repositories_of_an_example=secrets.REPOSITORIES_OF_AN_EXAMPLE)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans", "n_live", "n_example", "classes", "n_owners", "n_repositories")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.dedup_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_iban", "scores", "n_likely")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs.where(~held_out).select("text", "lang", F.col("doc_id").alias("key")))
    return language.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": F.coalesce(held_out, F.lit(False))})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size, as a mixture that favours small ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.natural_weights(docs, power=0.5))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": F.coalesce(held_out, F.lit(False))})


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup_near(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(_table(spark, sf_dir, "documents"))


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """Ranks file and pre-tokenizer pattern of a public vocabulary that is installed here."""
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    return bpe.tokenize(_table(spark, sf_dir, "documents"), ranks, pattern, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii_scan": op4_pii_scan,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

_U = "((('0x' || substr(md5('{node}|' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _sql_tree(tree: sharding.Tree) -> str:
    """The descent of ``sharding.place`` in SQL, for the key ``k``."""

    def descend(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = [f"{{'d': -ln({_U.format(node=n)}) / {w}, 'i': {i}}}" for i, (n, w, _) in enumerate(children)]
        return f"(CASE list_min([{', '.join(draws)}]).i " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(children)) + " END)"

    regions = []
    for region, racks in tree.items():
        inside = [(rack, sum(shards.values()), descend([(f"{rack}/s{s}", w, str(s)) for s, w in shards.items()])) for rack, shards in racks.items()]
        regions.append((region, sum(w for _, w, _ in inside), descend(inside)))
    return descend(regions)


_SPANS = """list_transform(range(len(m_{k})), lambda i: {{'start': (list_sum(list_transform(g_{k}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m_{k}[1:i], lambda x: length(x))), 0))::BIGINT,
      'ord': {o}, 'kind': '{k}', 'm': m_{k}[i + 1]}})"""
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{24,}"))

def _sql_spans(kind: str, pattern: str) -> str:
    return f"""list_transform(range(len(m_{kind})), lambda i: {{'start': (list_sum(list_transform(g_{kind}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m_{kind}[1:i], lambda x: length(x))), 0))::BIGINT, 'm': m_{kind}[i + 1]}})"""


#: The base patterns as they are written down, without the forms that keep Java's matching linear.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_COMPACT = "replace(x.m, ' ', '')"
_PII_VALID = {
    "email": "true",
    "ip": f"regexp_matches(x.m, '{pii.IP_IN_RANGE}')",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda i: (substr(reverse({_DIGITS}), i + 1, 1)::INT * (1 + i % 2)) // 10 + (substr(reverse({_DIGITS}), i + 1, 1)::INT * (1 + i % 2)) % 10)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"length({_COMPACT}) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(length({_COMPACT})), lambda i: ascii(substr({_COMPACT}[5:] || {_COMPACT}[:4], i + 1, 1))::BIGINT), lambda a, c: (CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END) % 97, 0::BIGINT) = 1",
}


def _sql_pii() -> str:
    around = f"(substr(t, greatest(x.start - {pii.REACH}, 0) + 1, x.start - greatest(x.start - {pii.REACH}, 0)) || ' ' || substr(t, x.start + length(x.m) + 1, {pii.REACH}))"

    def scored(k: str) -> str:
        score = f"round({pii.BASE_SCORE[k]}::DOUBLE + CASE WHEN regexp_matches({around}, '{pii.NEAR[k]}') THEN 0.2 ELSE 0.0 END::DOUBLE - CASE WHEN regexp_matches({around}, '{pii.AGAINST}') THEN 0.3 ELSE 0.0 END::DOUBLE, 2)"
        made = f"list_transform(list_filter({_sql_spans(k, _PII[k])}, lambda x: {_PII_VALID[k]}), lambda x: {{'span': '{k}:' || x.start || ':' || (x.start + length(x.m)), 'score': {score}}})"
        return (f"list_filter({made}, lambda y: y.score >= 0.6)" if k == "iban" else made) + f" AS {k}"

    base = "list_concat(list_concat(email, ip), list_concat(card, phone))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  m AS (SELECT doc_id, t, {", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in _PII.items())} FROM t),
  s AS (SELECT doc_id, {", ".join(map(scored, _PII))} FROM m),
  b AS (SELECT *, {base} AS base, list_concat({base}, iban) AS spans FROM s)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in _PII)}, sha256(array_to_string(list_transform(base, lambda y: y.span), ',')) AS base_sha256,
  array_to_string(list_transform(spans, lambda y: y.span), ',') AS spans, array_to_string(list_transform(spans, lambda y: y.score::VARCHAR), ',') AS scores, len(list_filter(spans, lambda y: y.score >= 0.5))::BIGINT AS n_likely
FROM b
"""


#: Quotas, the schedule of a period as a recursion over its slots, and the rows' places in it.
_MIXING = f"""
WITH RECURSIVE w AS (SELECT coalesce(source, '') AS source, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY 1),
  p0 AS (SELECT source, weight / sum(weight) OVER () * {float(mixing.BLOCK * mixing.PERIOD)}::DOUBLE AS quota FROM w),
  p1 AS (SELECT source, greatest(round(quota * {float(mixing.UNIT)}::DOUBLE)::BIGINT, 1) AS q, greatest(ceil(quota / {float(mixing.BLOCK - 2)}::DOUBLE)::BIGINT, 1) AS p FROM p0),
  pl AS (SELECT *, sum(p) OVER ()::BIGINT AS slots FROM p1),
  h AS (SELECT coalesce(list(source ORDER BY source) FILTER (p > 1), []) AS sources, coalesce(list(p ORDER BY source) FILTER (p > 1), []) AS p, max(slots) AS slots FROM pl),
  e AS (SELECT 0::BIGINT AS t, list_transform(p, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM h
    UNION ALL SELECT t + 1, list_transform(range(len(done)), lambda i: done[i + 1] + coalesce(i = c, false)::BIGINT), c FROM (
      SELECT t, done, list_min(list_filter(list_transform(range(len(done)), lambda i: {{'due': (done[i + 1] * slots + slots + p[i + 1] - 1) // p[i + 1], 'i': i, 'ok': (done[i + 1] * slots) // p[i + 1] <= t AND done[i + 1] < p[i + 1]}}), lambda x: x.ok)).i AS c
      FROM e, h WHERE t < slots)),
  g AS (SELECT t - 1 AS slot, row_number() OVER (ORDER BY t) AS nth FROM e WHERE pick IS NULL AND t > 0),
  l AS (SELECT source, row_number() OVER (ORDER BY source) AS nth FROM pl WHERE p = 1),
  s AS (SELECT sources[pick + 1] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM e, h WHERE pick IS NOT NULL
    UNION ALL SELECT source, slot, 0 FROM l JOIN g USING (nth)),
  r AS (SELECT doc_id, documents.source AS original, coalesce(documents.source, '') AS source, row_number() OVER (PARTITION BY coalesce(documents.source, '') ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 5))::BIGINT % {mixing.BUCKETS}, doc_id) - 1 AS rank FROM documents),
  m AS (SELECT r.*, q, p, slots, ((rank + 1) * {mixing.UNIT} - 1) // q AS m FROM r JOIN pl ON r.source = pl.source),
  o AS (SELECT *, rank - (m * q) // {mixing.UNIT} AS off, ((m + 1) * q) // {mixing.UNIT} - (m * q) // {mixing.UNIT} AS n FROM m),
  b AS (SELECT *, ((off + 1) * p - 1) // n AS j FROM o)
SELECT doc_id, original AS source, m * p + b.j AS mix_block, m * slots + s.slot AS mix_slot, off - (b.j * n) // p AS mix_row
FROM b JOIN s ON b.source = s.source AND b.j = s.j
"""


ORACLE_SQL: dict[str, str] = {
    # The CRC goes byte by byte through the usual table, which a fold makes from its polynomial.
    "op1_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
  c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, j: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), i::BIGINT)) AS t),
  e AS (SELECT d.*, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, c),
  p AS (SELECT *, {_sql_tree(sharding.default_tree())} AS shard, {_sql_tree(sharding.grow(sharding.default_tree()))} AS grown_shard, ('0x' || substr(md5(k || '|' || crc), 14, 5))::BIGINT % {sharding.BUCKETS} AS bucket FROM e)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, crc, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM p
""",
    "op2_secret_scan": f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
  m AS (SELECT doc_id, source, lang, {", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in _KINDS)} FROM t),
  c AS (SELECT doc_id, source, lang, list_concat(list_concat({", ".join(_SPANS.format(k=k, o=o) + (")" if o == 1 else "") for o, (k, _) in enumerate(_KINDS))}) AS c FROM m),
  f AS (SELECT doc_id, source, lang, list_sort(list_filter(c, lambda x: (x.kind = 'assign' AND length(regexp_extract(x.m, '{_ASSIGN}', 1)) >= 6) OR (x.kind = 'access' AND length(x.m) >= 20) OR x.kind = 'hex')) AS c FROM c),
  e AS (SELECT doc_id, source, lang, x.start AS start, x.ord AS ord, sha256(CASE WHEN x.kind = 'assign' THEN regexp_extract(x.m, '{_ASSIGN}', 1) ELSE x.m END) AS h FROM (SELECT doc_id, source, lang, unnest(c) AS x FROM f)),
  o AS (SELECT h, count(DISTINCT coalesce('+' || source, '-')) AS owners, count(DISTINCT coalesce('+' || source, '-') || coalesce('+' || lang, '-')) AS repositories FROM e GROUP BY h),
  x AS (SELECT e.*, owners, repositories, owners >= {secrets.OWNERS_OF_AN_EXAMPLE} OR repositories >= {secrets.REPOSITORIES_OF_AN_EXAMPLE} AS example FROM e JOIN o USING (h)),
  j AS (SELECT doc_id, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example, string_agg(CASE WHEN example THEN 'example' ELSE 'live' END, ',' ORDER BY start, ord) AS classes,
    string_agg(owners::VARCHAR, ',' ORDER BY start, ord) AS n_owners, string_agg(repositories::VARCHAR, ',' ORDER BY start, ord) AS n_repositories FROM x GROUP BY doc_id),
  s AS (SELECT doc_id, c, array_to_string(list_transform(c, lambda x: x.kind || ':' || x.start || ':' || (x.start + length(x.m))), ',') AS spans FROM f)
SELECT doc_id, {", ".join(f"len(list_filter(c, lambda x: x.kind = '{k}'))::BIGINT AS n_{k}" for k, _ in _KINDS)}, sha256(spans) AS base_sha256, spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(classes, '') AS classes, coalesce(n_owners, '') AS n_owners, coalesce(n_repositories, '') AS n_repositories
FROM s LEFT JOIN j USING (doc_id)
""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
""",
    "op4_pii_scan": _sql_pii(),
    "op6_mixing": _MIXING,
    "op8_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{minhash.UPPER}', '{minhash.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.a
""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
""",
}
