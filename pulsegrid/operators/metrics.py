"""Period and scalar metrics. Every function takes logical tables and covers all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import dealt
from .reports import vulnerability_counts

PERIODS = ("day", "week", "month", "year")


def period_of(name: str | None) -> str:
    """A known period, else month."""
    return name if name in PERIODS else "month"


def bucket(column: str, period: str) -> Column:
    return F.date_trunc(period_of(period), F.col(column)).cast("timestamp_ntz")


def per_period(rows: DataFrame, column: str, period: str, value: Column | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """repo_id, period, value; rows without a time are left out. The range is inclusive."""
    rows = rows.filter(F.col(column).isNotNull())
    if begin and end:
        rows = rows.filter(F.col(column).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return rows.groupBy("repo_id", bucket(column, period).alias("period")).agg((value if value is not None else F.count("*")).cast("long").alias("value"))


def named(df: DataFrame, repos: DataFrame) -> DataFrame:
    return df.join(repos.select("repo_id", "repo_name"), "repo_id")


def days_between(begin: str, end: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(end) - micros(begin)) / 86_400e6


def throughput(issues: DataFrame) -> DataFrame:
    total = F.count("*")
    return issues.groupBy("repo_id").agg(F.when(total == 0, 0.0).otherwise(F.round(F.count_if(F.col("closed_at").isNotNull()) / total, 6)).alias("throughput"))


def durations(rows: DataFrame, end: str) -> DataFrame:
    return rows.filter(F.col(end).isNotNull()).select("id", "repo_id", "created_at", end, F.round(days_between("created_at", end), 6).alias("days"))


def average_resolution(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo_id").agg(F.coalesce(F.round(F.avg(days_between("created_at", "closed_at")), 6), F.lit(0.0)).alias("days"))


def weekly_series(commits: DataFrame, pull_requests: DataFrame, issues: DataFrame, since: str, until: str) -> DataFrame:
    """repo_id, metric, week, value for four metrics in one pass; since inclusive, until exclusive."""
    one = lambda df, metric, ts, key: df.select("repo_id", F.lit(metric).alias("metric"), F.col(ts).alias("ts"), F.col(key).alias("key"))
    rows = one(commits, "commits", "authored_at", "hash").unionByName(one(pull_requests, "prs_opened", "created_at", "id"))
    rows = rows.unionByName(one(pull_requests, "prs_merged", "merged_at", "id")).unionByName(one(issues, "issues", "created_at", "id"))
    rows = rows.filter((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    return rows.groupBy("repo_id", "metric", bucket("ts", "week").alias("week")).agg(F.count_distinct("key").alias("value"))


def contributor_summary(commits: DataFrame, pull_requests: DataFrame, issues: DataFrame, repos: DataFrame, begin: str, end: str) -> DataFrame:
    """Activity per repository and contributor within the range (inclusive), from three pre-aggregated sources; comments are not counted."""
    sources = (("commits", commits, "authored_at", F.count_distinct("hash")), ("issues", issues, "created_at", F.count("*")), ("prs", pull_requests, "created_at", F.count("*")))
    parts = []
    for kind, rows, when, n in sources:
        rows = rows.filter(F.col("author_id").isNotNull() & F.col(when).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        counts = rows.groupBy("repo_id", "author_id").agg(n.alias("n"))
        parts.append(counts.select("repo_id", "author_id", *(F.when(F.lit(k == kind), F.col("n")).otherwise(0).alias(k) for k, *_ in sources)))
    total = F.col("commits") + F.col("issues") + F.col("prs")
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("repo_id", "author_id").agg(*(F.sum(k).alias(k) for k, *_ in sources))
    out = out.select("repo_id", F.coalesce(F.col("author_id").cast("string"), F.lit("unknown")).alias("user_id"), "commits", "issues", "prs", F.lit(0).cast("long").alias("issue_comments"), F.lit(0).cast("long").alias("pr_comments"), total.alias("total"))
    return named(out, repos)


def new_contributors(commits: DataFrame, issues: DataFrame, period: str, dedupe: bool = False) -> DataFrame:
    """First appearances per period; once per source unless dedupe."""
    first = lambda df, ts: df.groupBy("repo_id", "author_id").agg(F.min(ts).alias("first"))
    both = first(commits, "authored_at").unionByName(first(issues, "created_at"))
    if dedupe:
        both = both.groupBy("repo_id", "author_id").agg(F.min("first").alias("first"))
    return per_period(both, "first", period)


def latest_counter(info: DataFrame, column: str) -> DataFrame:
    if column not in ("stars", "forks", "watchers"):
        raise ValueError(f"unknown counter: {column}")
    return info.groupBy("repo_id").agg(F.max_by(column, F.struct("collected_at", "info_id")).alias(column))


def period_aggregates(commits: DataFrame, period: str, keys: tuple[str, ...] = ("repo_id",), parts: int | None = None) -> DataFrame:
    """Sums by author, affiliation and calendar period; ISO weeks carry the calendar year. Empty affiliations are one group."""
    calendar = {"year": [F.year("authored_at").cast("long").alias("year")]}
    calendar["month"] = [*calendar["year"], F.month("authored_at").cast("long").alias("month")]
    calendar["week"] = [*calendar["year"], F.weekofyear("authored_at").cast("long").alias("week")]
    who = F.coalesce(F.nullif(F.trim("affiliation"), F.lit("")), F.lit("(Unknown)")).alias("affiliation")
    # Dealt out once by the groups; a row counts once for its hash and once for its file, and both counts stay where the group lies.
    by, sums = [*keys, "author_email", "affiliation", *dict.fromkeys(("year", period))], ("added", "removed", "whitespace")
    rows = dealt(commits.filter("authored_at is not null").select(*keys, "author_email", who, *calendar[period], *sums, "filename", "hash"), parts, *by)
    once = F.array(F.expr(f"struct(hash, if(false, filename, null) as filename, {', '.join(sums)})"), F.expr(f"struct(if(false, hash, null) as hash, filename, {', '.join(f'if(false, {c}, null) as {c}' for c in sums)})"))
    one = rows.select(*by, F.explode(once).alias("r")).select(*by, "r.*").groupBy(*by, "hash", "filename").agg(*(F.sum(c).alias(c) for c in sums))
    return one.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), F.count("filename").alias("files"), F.count("hash").alias("patches"))


def repo_stats(repos: DataFrame, pulls: DataFrame, issues: DataFrame, commits: DataFrame, info: DataFrame, findings: DataFrame) -> DataFrame:
    """Gathered counts, those of the newest metadata, and vulnerabilities (findings: repo_id, vector)."""
    count = lambda df, name: df.groupBy("repo_id").agg(F.count("*").alias(name))
    c = commits.groupBy("repo_id").agg(F.count_distinct("hash").alias("commits"))
    newest = info.groupBy("repo_id").agg(F.max_by(F.struct("pr_count", "issues_count", "commit_count"), F.struct("collected_at", "info_id")).alias("m"))
    newest = newest.select("repo_id", *(F.col(f"m.{k}").alias(f"meta_{k}") for k in ("pr_count", "issues_count", "commit_count")))
    out = repos.select("repo_id", "repo_name")
    found = vulnerability_counts(findings).withColumnsRenamed({"total": "vulnerabilities", "critical": "critical_vulnerabilities"})
    for df in (count(pulls, "prs"), count(issues, "issues"), c, newest, found):
        out = out.join(df, "repo_id", "left")
    return out.fillna(0)
