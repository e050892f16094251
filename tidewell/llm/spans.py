"""Spans of regular expressions as DataFrame expressions, with code point offsets.

Spark has no function that returns the offsets of all matches.  Splitting a text
by a pattern gives the gaps between the matches, so running sums over gap and
match lengths give every start.  The sums run over blocks of ``BLOCK`` matches
and then over block totals, which keeps the work near linear in the matches.

Patterns used with this module match ASCII text only, never an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add one column ``name`` per pattern: array of (start, end, text), leftmost, non-overlapping.

    ``text`` must not be null.  Texts without a match are passed over once; the
    others are read three times.
    """
    lit = {k: F.lit(p) for k, p in patterns.items()}
    none = F.array().cast("array<string>")
    df = df.select(
        "*",
        *(F.when(F.rlike(text, lit[k]), F.regexp_extract_all(text, lit[k], F.lit(0))).otherwise(none).alias(f"_m_{k}") for k in patterns),
    )
    df = df.select(
        "*",
        *(
            F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(text, patterns[k], -1), F.length)).otherwise(F.array().cast("array<int>")).alias(f"_g_{k}")
            for k in patterns
        ),
    )

    def step(k: str) -> Column:
        return F.transform(F.col(f"_m_{k}"), lambda m, i: F.get(f"_g_{k}", i) + F.when(i > 0, F.length(F.get(f"_m_{k}", i - 1))).otherwise(0))

    df = df.select("*", *(step(k).alias(f"_l_{k}") for k in patterns))

    def blocks(k: str) -> Column:
        lens = F.col(f"_l_{k}")
        count = F.ceil(F.size(lens) / F.lit(BLOCK)).cast("int")
        return F.when(F.size(lens) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    df = df.select("*", *(blocks(k).alias(f"_b_{k}") for k in patterns))
    df = df.select("*", *(F.transform(f"_b_{k}", _total).alias(f"_t_{k}") for k in patterns))

    def starts(k: str) -> Column:
        totals = F.col(f"_t_{k}")
        lifted = F.transform(F.col(f"_b_{k}"), lambda x, b: F.struct(x.alias("x"), _total(F.slice(totals, F.lit(1), b)).alias("o")))
        return F.flatten(F.transform(lifted, lambda s: F.transform(s["x"], lambda _, i: s["o"] + _total(F.slice(s["x"], F.lit(1), i + 1)))))

    df = df.select("*", *(starts(k).alias(f"_s_{k}") for k in patterns))

    def spans(k: str) -> Column:
        return F.transform(
            F.arrays_zip(F.col(f"_s_{k}").alias("s"), F.col(f"_m_{k}").alias("m")),
            lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("text")),
        ).cast(_SPAN)

    df = df.select("*", *(spans(k).alias(k) for k in patterns))
    return df.drop(*(f"_{c}_{k}" for c in "mglbts" for k in patterns))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
