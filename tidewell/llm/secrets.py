"""Secret scans by corpus-wide ownership frequency (DataFrame operations only).

Candidates come from three patterns.  Each candidate value is hashed, and the
hashes are counted over the whole corpus by distinct repositories and owners: a
value that many owners (or, on demand, many repositories) hold is a copied example,
one that stays with a single owner looks like a live credential.  Counts are built up in three steps, (value,
owner, repository), then (value, owner), then (value), each with map-side
partial sums, so a value found in a third of all rows costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_groups, materialize
from tidewell.llm.spans import joined, with_spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The two kinds below match maximal runs; a lower bound inside the pattern gives
# the same spans as matching the run and dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
#: A value that so many owners hold, or so many repositories whoever owns them, is a copied example.
OWNERS_OF_AN_EXAMPLE, REPOSITORIES_OF_AN_EXAMPLE = 3, 5


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: array of (start, ord, end, kind, value_hash) ordered by start, then kind."""
    df = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = with_spans(df, "_text", {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX})

    def typed(col: str, kind: str, value: Column | None = None) -> Column:
        order = KINDS.index(kind)

        def one(s: Column) -> Column:
            v = F.regexp_extract(s["text"], ASSIGN, 2) if kind == "assign" else s["text"]
            return F.struct(
                s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"),
                F.length(v).alias("len"), F.sha2(v, 256).alias("value_hash"),
            )

        return F.transform(F.col(col), one)

    every = F.concat(typed("_assign", "assign"), typed("_access", "access"), typed("_hex", "hex"))
    df = df.withColumn("candidates", F.array_sort(F.filter(every, lambda s: (s["kind"] != "assign") | (s["len"] >= 6))))
    return df.drop("_text", "_assign", "_access", "_hex")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, owner, repository) rows to n_owners, n_repositories, n_found per value_hash."""
    per_repository = candidates.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repository.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found"))


def scan_secrets(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    id_col: str = "doc_id",
    text: str = "text",
    owners_of_an_example: int = OWNERS_OF_AN_EXAMPLE,
    repositories_of_an_example: int | None = None,
) -> DataFrame:
    """One row per input row: counts per kind, spans, and how each candidate is held.

    Columns: id_col, n_assign, n_access, n_hex (long), candidates, spans (string),
    n_live and n_example (long), classes (string; ``live`` or ``example`` for each
    span in the order of ``spans``), n_owners and n_repositories (string; for each span
    in that order, how many distinct owners and repositories hold its value).  A value
    is an example when at least ``owners_of_an_example`` distinct owners hold it, or,
    if it is given, at least ``repositories_of_an_example`` distinct repositories; the
    same repository name under two owners is two repositories.

    Null or empty text: no spans, zero counts, empty strings.  Null owners count as
    one owner of their own, null repositories likewise.  A null or repeated id is
    kept as it is; rows with the same id and the same spans get the same result.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    found = secret_spans(narrow, "_t").withColumn("spans", joined(F.col("candidates"))).drop("_t")
    found = materialize(found, "secret-spans")
    each = found.where(F.size("candidates") > 0).select("_id", "owner", "repository", "spans", F.explode("candidates").alias("c"))
    each = each.select("_id", "owner", "repository", "spans", F.col("c.start").alias("start"), F.col("c.ord").alias("ord"), F.col("c.value_hash").alias("value_hash"))
    example = F.col("n_owners") >= owners_of_an_example
    if repositories_of_an_example is not None:
        example = example | (F.col("n_repositories") >= repositories_of_an_example)
    frequency = materialize(ownership(each).withColumn("example", example).select("value_hash", "example", "n_owners", "n_repositories", "n_found"), "secret-values")
    judged = join_groups(each, frequency, ["value_hash"], "n_found").groupBy("_id", "spans", "start", "ord").agg(*(F.max(c).alias(c) for c in ("example", "n_owners", "n_repositories")))
    mark = F.struct("start", "ord", F.when(F.col("example"), "example").otherwise("live").alias("class"), "n_owners", "n_repositories")
    per_doc = judged.groupBy("_id", "spans").agg(
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if("example").alias("n_example"),
        F.array_sort(F.collect_list(mark)).alias("marks"),
    )
    held = {"classes": "class", "n_owners": "n_owners", "n_repositories": "n_repositories"}
    per_doc = per_doc.select(
        F.col("_id").alias("_id2"), F.col("spans").alias("_spans2"), "n_live", "n_example",
        *(F.array_join(F.col(f"marks.{field}").cast("array<string>"), ",").alias(name) for name, field in held.items()),
    )
    zero = F.lit(0).cast("long")

    def n(kind: str) -> Column:
        return F.size(F.filter("candidates", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = found.join(per_doc, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("spans") == F.col("_spans2")), "left")
    return out.select(
        F.col("_id").alias(id_col), *(n(k) for k in KINDS), "candidates", "spans",
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"), *(F.coalesce(c, F.lit("")).alias(c) for c in held),
    )
