"""Reports, reconciliation, comparison and queue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .store import scratch


def licence_counts(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Normalised on distinct raw strings first, then summed."""
    raw = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    out = raw.withColumn("licence", S.spdx(F.col(column))).groupBy(*keys, "licence").agg(F.sum("n").alias("n"))
    return out.withColumn("is_osi", S.is_osi(F.col("licence")))


def vulnerability_counts(rows: DataFrame) -> DataFrame:
    """rows: repo_id, vector. Critical by label or score."""
    score = S.cvss_score(F.col("vector"))
    return rows.groupBy("repo_id").agg(F.count("*").alias("total"), F.count_if((S.cvss_label(score) == "CRITICAL") | (score >= 9)).alias("critical"))


def consensus_affiliation(contributors: DataFrame) -> DataFrame:
    """The commonest company of each private mail domain; ties go to the smaller name."""
    rows = contributors.select(S.email_domain(F.col("email")).alias("domain"), S.company(F.col("company")).alias("company")).filter("domain <> '' and company <> ''")
    n = rows.filter(~S.is_public_domain(F.col("domain"))).groupBy("domain", "company").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("company").alias("company"), F.col("n").alias("n")))
    return n.groupBy("domain").agg(best.alias("b")).select("domain", F.col("b.company").alias("company"), F.col("b.n").alias("n"))


def domain_lookup(emails: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Affiliation by the longest suffix of the mail domain. emails: email; affiliations: domain, affiliation."""
    parts = F.split(S.email_domain(F.col("email")), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    tried = emails.select("email").distinct().select("email", suffix.alias("domain"))
    hit = tried.join(affiliations, "domain").groupBy("email").agg(F.max_by("affiliation", F.struct(F.length("domain"), "domain")).alias("affiliation"))
    return emails.select("email").distinct().join(hit, "email", "left")


def resolve_identities(commits: DataFrame, contributors: DataFrame, aliases: DataFrame) -> DataFrame:
    """email, cntrb_id, how: bot, own address, or alias; else null."""
    e = commits.select(F.col("author_email").alias("email")).distinct()
    own = contributors.groupBy("email").agg(F.min("cntrb_id").alias("own"))
    via = aliases.groupBy(F.col("alias_email").alias("email")).agg(F.min("cntrb_id").alias("via"))
    out = e.join(own, "email", "left").join(via, "email", "left")
    how = F.when(S.is_bot(F.col("email")), "bot").when(F.col("own").isNotNull(), "address").when(F.col("via").isNotNull(), "alias")
    return out.select("email", F.when(~S.is_bot(F.col("email")), F.coalesce("own", "via")).alias("cntrb_id"), how.alias("how"))


#: Numbers of a repository that one task counts; longer runs are added up from their counts.
SPAN = 1 << 16


def _running(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Running sum of a flag by number within each repository, in spans of numbers, so that a large repository is many tasks' work."""
    rows = rows.withColumn("__span", F.floor(F.col("number") / SPAN))
    before = Window.partitionBy("repo_id").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("repo_id", "__span").agg(F.sum(flag).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = Window.partitionBy("repo_id", "__span").orderBy("number")
    out = rows.withColumn(name, F.sum(flag).over(within)).join(sums.drop("__n"), ["repo_id", "__span"])
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__span", "__before")


def gaps(expected: DataFrame, collected: DataFrame) -> DataFrame:
    """(repo_id, first, last, n): runs of expected numbers that are not collected. Both: repo_id, number."""
    marked = expected.distinct().join(collected.distinct().withColumn("have", F.lit(1)), ["repo_id", "number"], "left").fillna(0, ["have"])
    runs = _running(marked, "have", "run").filter("have = 0")
    return runs.groupBy("repo_id", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("n")).drop("run")


def gap_edges(found: DataFrame, collected: DataFrame, edge: int = 2) -> DataFrame:
    """Numbers to fetch: all from the first to the last of each gap and up to ``edge`` collected neighbours at each side."""
    ends = found.select("repo_id", F.explode(F.array(*(F.struct(F.col(c).alias("number"), F.lit(side).alias("side")) for c, side in (("first", -1), ("last", 1))))).alias("e"))
    both = collected.distinct().select("repo_id", "number", F.lit(0).alias("side"), F.lit(1).alias("c")).unionByName(ends.select("repo_id", "e.*", F.lit(0).alias("c")))
    both = _running(both, "c", "k")  # an end of a gap: how many are collected below it; a collected number: its rank
    near = F.when(F.col("side") < 0, F.sequence(F.col("k") - edge + 1, F.col("k"))).otherwise(F.sequence(F.col("k") + 1, F.col("k") + edge)) if edge else F.array().cast("array<long>")
    wanted = both.filter("side <> 0").select("repo_id", F.explode(near).alias("k")).distinct()
    sides = both.filter("side = 0").join(wanted, ["repo_id", "k"], "left_semi").select("repo_id", "number")
    inner = found.select("repo_id", F.explode(F.sequence("first", "last")).alias("number"))
    return inner.unionByName(sides).distinct()


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that those who read them several times plan and run them once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fill_plan(expected: DataFrame, collected: DataFrame, told: DataFrame, size: int, threshold: float = 5, edge: int = 2) -> DataFrame:
    """repo_id, number, shard: what to fetch again where more than ``threshold`` percent of the items told of are not collected.

    told: repo_id, n. Numbers are cut in order into as few shards of at most ``size`` as will do, whose sizes differ by one at most.
    """
    gathered = collected.distinct().groupBy("repo_id").agg(F.count("*").alias("gathered"))
    due = told.join(gathered, "repo_id", "left").filter(S.gap_percent(F.coalesce("gathered", F.lit(0)), F.col("n")) > threshold).select("repo_id").distinct()
    have = _written(collected.join(due, "repo_id", "left_semi").distinct(), "collected")
    found = _written(gaps(expected.join(due, "repo_id", "left_semi"), have), "gaps")
    numbers = _written(gap_edges(found, have, edge), "numbers")
    counts = numbers.groupBy("repo_id").agg(F.count("*").alias("all")).withColumn("shards", S.shard_count(F.col("all"), F.lit(size)))
    rows = _running(numbers.withColumn("one", F.lit(1)), "one", "k").join(counts, "repo_id")
    least, more, at = F.floor(F.col("all") / F.col("shards")), F.col("all") % F.col("shards"), F.col("k") - 1
    long_part = more * (least + 1)
    shard = F.when(at < long_part, F.floor(at / (least + 1))).otherwise(more + F.floor((at - long_part) / F.greatest(least, F.lit(1))))
    return rows.select("repo_id", "number", (shard + 1).cast("long").alias("shard"))


def missed(planned: DataFrame, staged: DataFrame) -> DataFrame:
    """Numbers of the plan that no shard has staged: those to fetch once more."""
    return planned.select("repo_id", "number").distinct().join(staged, ["repo_id", "number"], "left_anti")


def compare(series: DataFrame, mode: str) -> DataFrame:
    """series: repo_id, week, value. Missing weeks count 0; mode: raw, percent (of the maximum, at least 1) or zscore (population)."""
    weeks, repos = series.select("week").distinct(), series.select("repo_id").distinct()
    full = repos.crossJoin(weeks).join(series, ["repo_id", "week"], "left").fillna(0, ["value"])  # at most five repositories by a year of weeks
    w = Window.partitionBy("repo_id")
    v = F.col("value").cast("double")
    if mode == "percent":
        v = v / F.greatest(F.max("value").over(w), F.lit(1)) * 100
    elif mode == "zscore":
        sd = F.stddev_pop("value").over(w)
        v = (v - F.avg("value").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return full.select("repo_id", "week", F.round(v, 6).alias("value"))


def semantic_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: missing (only baseline), content (both, different), extra (only candidate); equal rows are left out. Null equals null."""
    rest = [c for c in baseline.columns if c not in keys]
    a = baseline.select(*keys, F.struct(*rest).alias("a"), F.lit(True).alias("in_a"))
    b = candidate.select(*keys, F.struct(*rest).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "content")
    return both.select(*keys, status.alias("status")).filter("status is not null")


def queue_order(queue: DataFrame) -> DataFrame:
    """Collecting first, then queued by priority, due time and id."""
    rank = F.when(F.col("status") == "collecting", 0).when(F.col("status") == "queued", 1).otherwise(2)
    return queue.orderBy(rank, "priority", "due_at", "repo_id")


def sbom(repos: DataFrame, deps: DataFrame) -> DataFrame:
    """One CycloneDX document per repository. Components are collected by repository, as the document itself is."""
    licence = F.coalesce(F.nullif(F.trim("license"), F.lit("")), F.lit("NOASSERTION"))
    component = F.struct(F.lit("library").alias("type"), "name", F.concat(F.lit("pkg:"), F.col("manager"), F.lit("/"), F.col("name")).alias("purl"), licence.alias("licence"))
    parts = deps.groupBy("repo_id").agg(F.array_sort(F.collect_list(component)).alias("components"))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.struct(F.col("repo_name").alias("name")).alias("metadata"), "components"))
    return repos.join(parts, "repo_id", "left").select("repo_id", doc.alias("document"), F.coalesce(F.size("components"), F.lit(0)).cast("long").alias("n"))
