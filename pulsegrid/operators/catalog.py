"""Repositories and what hangs on them: groups, releases, clones, memberships, collection status, archive, scan freshness, profiles.

Writers give merges for the store, so several tables change at one commit point; readers are plain projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .merge import dedupe
from .store import Append, Merge

#: Numbers are given out in so many series side by side, so that no task sees all new rows.
SERIES = 1024
DEFAULT_GROUP = "Default"
#: Phases of a collection and the state of one that has not begun.
PHASES, PENDING = ("core", "secondary", "facade", "ml"), "Pending"
REPO_FIELDS = ("repo_name", "repo_owner", "repo_description", "primary_language", "forked_from", "repo_archived")


def numbered(rows: DataFrame, old: DataFrame, id_column: str, *key: str) -> DataFrame:
    """The rows with new ids above all old ones: by key within each series, series interleaved, the same at every run.

    ``key`` tells the rows apart. Ids are unique but not gapless.
    """
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("__top"))  # one row, whatever the table
    series = F.pmod(F.xxhash64(*key), F.lit(SERIES))
    place = F.row_number().over(Window.partitionBy("__s").orderBy(*key))
    out = rows.withColumn("__s", series).withColumn("__k", place).join(F.broadcast(top))
    return out.withColumn(id_column, F.col("__top") + (F.col("__k") - 1) * SERIES + F.col("__s") + 1).drop("__s", "__k", "__top")


def add_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """repo_group_id, rg_name, rg_type, rg_website, rg_description: the groups and those wanted (rg_name, rg_type, rg_website) that
    have no group of their name and type yet. Equal ones are made once, with the least website; null types equal each other."""
    key = lambda df: [F.coalesce(df[c], F.lit("")) for c in ("rg_name", "rg_type")]
    one = wanted.filter("rg_name is not null").groupBy("rg_name", "rg_type").agg(F.min("rg_website").alias("rg_website"))
    (a, b), (x, y) = key(one), key(groups)
    new = one.join(groups, (a == x) & (b == y), "left_anti")
    new = new.withColumn("rg_description", F.concat(F.lit("Auto-created from "), F.coalesce("rg_website", F.lit(""))))
    return groups.unionByName(numbered(new, groups, "repo_group_id", "rg_name", "rg_type"))


def add_repos(repos: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Repositories by address: known ones take the new fields but keep id, group and time of making, new ones get an id.

    rows: repo_git, repo_group_id (null or 0: the default group, which ``groups`` must hold), seq (the greatest of an address counts), created_at,
    updated_at and REPO_FIELDS. Names lose ``.git``; a missing updated_at leaves the old one. Rows without an address are left out.
    """
    default = groups.filter(F.col("rg_name") == DEFAULT_GROUP).agg(F.min("repo_group_id").alias("__default"))
    new = dedupe(rows.filter("repo_git is not null"), ["repo_git"], [F.desc("seq")]).withColumn("repo_name", S.repo_name(F.col("repo_name")))
    new = new.join(F.broadcast(default)).withColumn("repo_group_id", F.coalesce(F.nullif("repo_group_id", F.lit(0)), "__default")).drop("__default", "seq")
    both = repos.alias("a").join(new.withColumn("__new", F.lit(True)).alias("b"), "repo_git", "left")
    take = {f: F.when(F.col("__new"), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")) for f in REPO_FIELDS} | {"updated_at": F.coalesce("b.updated_at", "a.updated_at")}
    known = both.select(*(take.get(c, F.col(c) if c == "repo_git" else F.col(f"a.{c}")).alias(c) for c in repos.columns))
    fresh = numbered(new.join(repos.select("repo_git"), "repo_git", "left_anti"), repos, "repo_id", "repo_git")
    return known.unionByName(fresh.select(*repos.columns))


def move_repos(repos: DataFrame, moves: DataFrame) -> DataFrame:
    """Repositories with new addresses (moves: repo_id, url, once an id): address, owner and name are those of the new one."""
    url = S.repo_address(F.col("__url"))
    parts = F.split(F.regexp_replace(url, "^https?://", ""), "/")
    deep = F.size(parts) >= 3
    to = moves.select("repo_id", F.col("url").alias("__url"))
    new = {
        "repo_git": url,
        "repo_owner": F.when(deep, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise(""),
        "repo_name": F.when(deep, S.repo_name(F.element_at(parts, -1))).otherwise(""),
    }
    out = repos.join(to, "repo_id", "left")
    return out.select(*(F.when(F.col("__url").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in repos.columns))


def archive(repos: DataFrame, gone: DataFrame) -> DataFrame:
    """Repositories with those of ``gone`` (repo_id) marked as archived; their data stay."""
    mark = gone.select("repo_id").distinct().withColumn("__gone", F.lit(True))
    return repos.join(mark, "repo_id", "left").withColumn("repo_archived", F.coalesce("__gone", "repo_archived")).select(*repos.columns)


def dequeue(queue: DataFrame, gone: DataFrame) -> DataFrame:
    return queue.join(gone.select("repo_id"), "repo_id", "left_anti")


def releases(rows: DataFrame) -> Merge:
    """Releases by repository and id: a known one takes name, description and time of change only. rows: of the table and seq."""
    clean = rows.withColumns({c: S.sanitise(F.col(c)) for c in ("release_name", "release_description")})
    return Merge("releases", clean, ["repo_id", "release_id"], order=[F.desc("seq")], update=["release_name", "release_description", "updated_at"])


def release_list(table: DataFrame, repos: DataFrame) -> DataFrame:
    """The releases with their repository's name, newest first, those never published last."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    named = table.join(repos.select("repo_id", "repo_name"), "repo_id")
    rows = named.select("repo_id", "release_id", "release_name", text("release_description"), "release_author", "release_tag_name", text("release_url"), "created_at", "published_at", "repo_name")
    return rows.orderBy("repo_id", F.desc_nulls_last("published_at"), "release_id")


def clones(rows: DataFrame) -> Merge:
    """Clone counts by repository and time. rows: repo_id, clone_timestamp, total_clones, unique_clones, seq."""
    return Merge("repo_clones", rows, ["repo_id", "clone_timestamp"], order=[F.desc("seq")], update=["total_clones", "unique_clones"])


def repo_info(rows: DataFrame) -> Append:
    """A snapshot beside the older ones; truth values are kept as text."""
    flags = {f.name: F.coalesce(F.col(f.name), F.lit(False)).cast("string") for f in rows.schema if f.dataType.typeName() == "boolean"}
    return Append("repo_info", rows.withColumns(flags) if flags else rows)


def memberships(rows: DataFrame) -> Merge:
    """Members of foundations by foundation, project and address. rows: these, status, homepage_url, seq."""
    return Merge("foundation_membership", rows, ["foundation", "project_name", "repo_url"], by="repo_url", order=[F.desc("seq")], update=["status", "homepage_url"])


def collection_status(repos: DataFrame, status: DataFrame) -> DataFrame:
    """repo_id, state, task and last time of each phase; repositories without a row are pending in all, and so is a phase without a state."""
    columns = []
    for p in PHASES:
        columns += [F.coalesce(f"{p}_status", F.lit(PENDING)).alias(f"{p}_status"), F.coalesce(f"{p}_task_id", F.lit("")).alias(f"{p}_task_id"), F.col(f"{p}_data_last_collected")]
    return repos.select("repo_id").join(status, "repo_id", "left").select("repo_id", *columns)


def status_changes(rows: DataFrame) -> Merge:
    """New states and times of phases: what is empty or null leaves the old value. rows: repo_id, {phase}_status, {phase}_data_last_collected, seq."""
    states, times = tuple(f"{p}_status" for p in PHASES), tuple(f"{p}_data_last_collected" for p in PHASES)
    clean = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in states})
    return Merge("collection_status", clean, ["repo_id"], order=[F.desc("seq")], keep_if_null=states + times)


def legacy_repos(rows: DataFrame) -> DataFrame:
    """repo_id, repo_git, repo_name ('' if none) of an older schema; repositories without an address are left out."""
    return rows.filter("repo_git is not null and repo_git <> ''").select("repo_id", "repo_git", F.coalesce("repo_name", F.lit("")).alias("repo_name"))


def read_legacy(spark: SparkSession, url: str, table: str, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """The older schema's repositories over JDBC, read in ranges of ids if their bounds are given (rows beyond them are read, too)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        reader = reader.options(partitionColumn="repo_id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return legacy_repos(reader.load())


def scans_due(repos: DataFrame, scans: DataFrame, now: str, days: int = 30) -> DataFrame:
    """repo_id, last_run of the repositories never scanned or not within so many days. scans: repo_id, collected_at."""
    last = scans.groupBy("repo_id").agg(F.max("collected_at").alias("last_run"))
    due = F.col("last_run").isNull() | (F.col("last_run") < _before(now, days))
    return repos.select("repo_id").join(last, "repo_id", "left").filter(due)


def _before(now: str, days: int) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))


def _cold(now: str, days: int) -> Column:
    """Not enriched, or longer ago than so many days."""
    return F.col("enriched_at").isNull() | (F.col("enriched_at") < _before(now, days))


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def thin_profiles(contributors: DataFrame, now: str, limit: int, days: int = 30) -> DataFrame:
    """login: the newest of those that have neither company nor location and were not enriched within so many days."""
    rows = contributors.filter(~_blank("login") & _blank("company") & _blank("location") & _cold(now, days))
    return rows.orderBy(F.desc_nulls_last("collected_at"), "login").limit(limit).select("login")


def missing_canonical(contributors: DataFrame, now: str, limit: int, days: int = 30) -> DataFrame:
    """cntrb_id, login: of those with a login, no usable canonical address and no enrichment within so many days."""
    rows = contributors.filter(~_blank("login") & (F.length(F.coalesce("canonical", F.lit(""))) < 2) & _cold(now, days))
    return rows.orderBy("login", "cntrb_id").limit(limit).select("cntrb_id", "login")


@dataclass
class Answers:
    """asked: login of all that were looked up; found: login, company, location, email, the answer of each that exists, once a login."""

    asked: DataFrame
    found: DataFrame


def enrich(contributors: DataFrame, answers: Answers, now: str, canonical: bool = False) -> DataFrame:
    """Contributors with the answers' company and location, or with ``canonical`` their address if it is a real one.

    All asked are marked as enriched, also those without an answer, lest they are asked again at the next pass.
    """
    asked = answers.asked.select("login").distinct().withColumn("__asked", F.lit(True))
    found = answers.found.select("login", *(F.col(c).alias(f"__{c}") for c in ("company", "location", "email")))
    out = contributors.join(asked, "login", "left").join(found, "login", "left")
    real = F.col("__email").contains("@") & ~F.lower("__email").contains("noreply")
    new = {"canonical": F.when(F.col("__asked") & real, F.col("__email"))} if canonical else {c: F.when(F.col("__asked"), F.nullif(F.col(f"__{c}"), F.lit(""))) for c in ("company", "location")}
    out = out.withColumns({c: F.coalesce(v, c) for c, v in new.items()} | {"enriched_at": F.when(F.col("__asked"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("enriched_at"))})
    return out.select(*contributors.columns)


def search_queue(queue: DataFrame, repos: DataFrame, text: str) -> DataFrame:
    """Jobs whose repository's owner or name holds the text, in any case; the empty text keeps all."""
    if not text:
        return queue
    # % and _ stay wildcards, as a user of ILIKE expects.
    hit = repos.filter(F.ilike("repo_owner", F.lit(f"%{text}%")) | F.ilike("repo_name", F.lit(f"%{text}%")))
    return queue.join(hit.select("repo_id"), "repo_id", "left_semi")


def seen_companies(commits: DataFrame, contributors: DataFrame) -> DataFrame:
    """author_email, company: of commit addresses that are a contributor's in any case and no noreply address."""
    people = contributors.filter(~_blank("company") & (F.col("company") != "None")).select(F.lower("email").alias("__k"), "company").distinct()
    mails = commits.select("author_email").distinct().filter(~_blank("author_email") & ~F.col("author_email").contains("noreply"))
    return mails.withColumn("__k", F.lower("author_email")).join(people, "__k").select("author_email", "company").distinct()
