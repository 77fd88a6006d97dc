"""Secrets in texts, told apart by how many owners have them.

Spans of several kinds are found with built-in regular expressions. The hash of each span's value is counted over the
corpus by distinct repository and owner: a value that many have is an example that was copied; one that a single owner
has, and that looks random, may be live. Long random-looking words, which are no secret by form, are added as spans of
their own when only one owner has them. Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, prepare

# The base kinds in their order; a pattern, the group that holds the value, and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Runs that are as long as keys of common services; they count only if they mix cases and digits.
OPAQUE = (r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: From so many owners or repositories on a value is widely copied.
COPIED_OWNERS, COPIED_REPOS = 3, 10


def matches_of(text: Column, kind: str, pattern: str, group: int) -> Column:
    """array<struct<gap:int, whole:int, value:string>> of the leftmost matches that don't overlap: the code points before
    each since the one before, its own, and its value. What lies between comes from splitting by the same pattern."""
    # A run that can't be long enough needn't be cut out; where matches are maximal runs the bound can be in the pattern.
    quick = {"access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}.get(kind, pattern)
    pattern = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    found = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), x["value"].alias("value")))
    return F.when(text.rlike(quick), found).otherwise(F.array().cast("array<struct<gap:int,whole:int,value:string>>"))


def looks_random(value: Column) -> Column:
    """Letters and digits of several kinds, and at least eight different characters."""
    mixes = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixes & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def find(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, repo, owner), and their spans (row, repo, owner, start, rank, end, kind, value): base kinds, and opaque ones apart
    from them. A null text has no spans.

    Places are sums over the matches before, taken in the order of a row's matches; overlaps are found among its spans in
    order of their start. So a row costs as much as it has matches.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = {**BASE, "opaque": OPAQUE}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    found = F.filter(F.array(*[F.struct(F.lit(r).alias("rank"), matches_of(F.col("text"), k, *rule[:2]).alias("own")) for r, (k, rule) in enumerate(kinds.items())]), lambda x: F.size(x["own"]) > 0)
    rows = keep(rows.select("row", "doc_id", "repo", "owner", found.alias("found")), "matches")
    each = rows.select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.rank", F.posexplode("x.own").alias("pos", "m"))
    each = each.select("row", "repo", "owner", "rank", "pos", "m.gap", "m.whole", "m.value").repartition("row")
    upto = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("whole"))
    least = F.lit(None)
    for r, (_, _, length) in enumerate(kinds.values()):
        least = F.when(F.col("rank") == r, length).otherwise(least)
    base = F.col("rank") < len(BASE)
    mixes = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    each = each.filter((F.length("value") >= least) & (base | mixes))
    # A base span that begins at or before an opaque one overlaps it if any of them ends after its start; a later one, if the next begins before its end.
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    reach, follows = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(after)
    each = each.withColumns({"reach": reach, "follows": follows})
    hit = (F.coalesce("reach", F.lit(-1)) > F.col("start")) | F.coalesce(F.col("follows") < F.col("end"), F.lit(False))
    each = each.filter(base | ~hit)
    names = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("rank") + 1)
    return rows.select("row", "doc_id"), each.select("row", "repo", "owner", "start", "rank", "end", names.alias("kind"), "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners) from (value_hash, repo, owner): a repository is one of its owner's.

    Three groupings, each summed in the map tasks first, so a value that a third of all rows have is no hot task.
    """
    each = spans.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    owners = each.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def classified(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and their spans (row, start, rank, end, kind, value_hash, n_repos, n_owners, copied, live)."""
    rows, spans = find(docs, repo, owner)
    each = keep(spans.select("row", "repo", "owner", "start", "rank", "end", "kind", F.sha2("value", 256).alias("value_hash"), looks_random(F.col("value")).alias("random")), "spans")
    # Written first: the join is one of two plain exchanges then, which Spark splits at a hot value.
    counts = keep(ownership(each), "ownership")
    told = each.drop("repo", "owner").join(counts, "value_hash")
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    told = told.withColumn("copied", copied).withColumn("live", (F.col("n_owners") == 1) & ~copied & F.col("random")).drop("random")
    return rows, told


def report(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_copied and n_live, its spans whose value
    many have and those with a random-looking value of one owner. Rows of one doc_id stay rows; null owners are one."""
    rows, spans = classified(docs, repo, owner)
    spans = spans.filter(F.col("rank").isin(list(range(len(BASE)))) | F.col("live"))
    held = F.collect_list(F.struct("start", "rank", "end", "kind"))
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE]
    per_row = spans.groupBy("row").agg(*kinds, F.array_sort(held).alias("all"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"), F.count(F.when(F.col("live"), 1)).alias("n_live"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("all", lambda s: s["rank"] < len(BASE))
    per_row = per_row.select("row", *[f"n_{k}" for k in BASE], listed(base).alias("base"), listed(F.col("all")).alias("spans"), "n_copied", "n_live")
    empty = {f"n_{k}": 0 for k in BASE} | {"base": "", "spans": "", "n_copied": 0, "n_live": 0}
    out = rows.join(per_row, "row", "left").fillna(empty)
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_copied", "n_live")
