"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust scores.

DataFrame operations only.  Luhn confirms cards and mod-97 confirms IBANs; the
words within ``REACH`` code points of a span raise or lower its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.spans import joined, with_spans

# Runs are matched from their beginning and without giving characters back, which
# finds the same spans as plain greedy matching but in time linear in the text.
# "\G" allows a run that begins where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
REACH = 40
BASE_SCORE = {"email": 0.6, "ip": 0.4, "card": 0.7, "phone": 0.5, "iban": 0.8}
NEAR = {
    "email": r"(?i)\b(?:e-?mail|contact|write|reply|address)",
    "ip": r"(?i)\b(?:ip|host|server|login|address|client)",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|pay)",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|whatsapp)",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto)",
}
AGAINST = r"(?i)\b(?:example|sample|test|dummy|version|placeholder)"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_IN_RANGE = rf"^{PART}\.{PART}\.{PART}\.{PART}$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if the digit string ``d`` passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(d))

    def value(i: Column) -> Column:
        v = F.ascii(F.substring(d, F.length(d) - i + 1, F.lit(1))) - 48
        twice = v * 2
        return F.when(i % 2 == 1, v).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(x: Column) -> Column:
    """True if the compact IBAN ``x`` has remainder 1 (ISO 13616)."""
    turned = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, F.lit(1), F.lit(4)))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(IP_IN_RANGE)
    n = F.length(digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        compact = F.regexp_replace(s, r"\x20", "")
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", iban_score: float = 0.6) -> DataFrame:
    """One row per input row: counts per kind and confirmed spans with scores.

    Columns: id_col, n_email, n_ip, n_card, n_phone, n_iban (long), base_spans and
    spans (strings), scores (string, one score per span of ``spans``), n_likely
    (long, spans scored 0.5 or more).  IBAN spans are added to the base spans when
    mod-97 holds and their score reaches ``iban_score``; base spans always stay.

    Null or empty text: zero counts and empty strings.  Null and repeated ids are
    kept as they are.  Other columns of ``docs`` are ignored.  There is no shuffle.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    df = with_spans(df, "_text", dict(zip((f"_{k}" for k in KINDS), (EMAIL, IP, CARD, PHONE, IBAN), strict=True)))

    def confirmed(kind: str) -> Column:
        return F.filter(F.col(f"_{kind}"), lambda s: _valid(kind, s["text"])).alias(f"_v_{kind}")

    df = df.select("*", *map(confirmed, KINDS))

    def scored(kind: str) -> Column:
        def one(s: Column) -> Column:
            left = F.greatest(s["start"] - REACH, F.lit(0))
            around = F.concat_ws(" ", F.substring(F.col("_text"), left + 1, s["start"] - left), F.substring(F.col("_text"), s["end"] + 1, F.lit(REACH)))
            score = F.lit(BASE_SCORE[kind]) + F.when(around.rlike(NEAR[kind]), 0.2).otherwise(0.0) - F.when(around.rlike(AGAINST), 0.3).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

        found = F.transform(F.col(f"_v_{kind}"), one)
        return F.filter(found, lambda s: s["score"] >= iban_score) if kind == "iban" else found

    df = df.select(id_col, *(scored(k).alias(k) for k in KINDS))
    df = df.select("*", F.concat(*BASE).alias("_base"), F.concat(*KINDS).alias("_all"))
    return df.select(
        id_col, *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), joined(F.col("_base")).alias("base_spans"), joined(F.col("_all")).alias("spans"),
        F.array_join(F.transform("_all", lambda s: s["score"].cast("string")), ",").alias("scores"), F.size(F.filter("_all", lambda s: s["score"] >= 0.5)).cast("long").alias("n_likely"),
    )
