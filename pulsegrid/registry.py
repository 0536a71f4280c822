"""Registered queries of the activity operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import catalog, cursors, diff, documents, identity, jobs, merge, metrics, queue, reports, views
from .operators.store import Replace, Store, scratch
from .plans.binding import CTES, MANIFESTS, VECTORS, Tables
from .sources import bundles, manifests, scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2001-06-01"


def query(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    if sql:
        sql = sql.strip()
        ORACLE_SQL[name] = f"{CTES}, {sql[5:]}" if sql.startswith("with ") else f"{CTES} {sql}"


def _trunc(period: str, column: str) -> str:
    return f"cast(date_trunc('{period}', {column}) as timestamp)"


def _period(name: str, rows: Callable[[Tables], DataFrame], column: str, source: str, period: str = "month", value=None, sql_value: str = "count(*)") -> None:
    query(
        name,
        lambda t: metrics.named(metrics.per_period(rows(t), column, period, value() if value else None), t.repos),
        f"select repo_id, repo_name, period, value from (select repo_id, {_trunc(period, column)} as period, cast({sql_value} as bigint) as value from {source} where {column} is not null group by all) join repos using (repo_id)",
    )


# Listings and predicates.
query("repo_groups_list", lambda t: t.repo_groups, "select * from repo_groups")
query("repos_list", lambda t: t.repos.join(t.repo_groups, "repo_group_id").select("repo_id", "repo_name", "rg_name", "repo_git"), "select repo_id, repo_name, rg_name, repo_git from repos join repo_groups using (repo_group_id)")
query("repos_by_group", lambda t: t.repos.filter("repo_group_id = 2").select("repo_id", "repo_name"), "select repo_id, repo_name from repos where repo_group_id = 2")
query("repo_lookup", lambda t: t.repos.filter((F.lower("repo_owner") == "asia") & (F.lower("repo_name") == F.lower(F.lit("Nation_7")))).limit(1), "select * from repos where lower(repo_owner) = 'asia' and lower(repo_name) = 'nation_7' limit 1")
query(
    "repo_search",
    lambda t: t.repos.filter(F.lower("repo_name").contains("nation_1") | F.lower("repo_owner").contains("nation_1") | F.lower("repo_git").contains("nation_1")).orderBy("repo_owner", "repo_name").limit(20).select("repo_id", "repo_owner", "repo_name"),
    "select repo_id, repo_owner, repo_name from repos where lower(repo_name) like '%nation_1%' or lower(repo_owner) like '%nation_1%' or lower(repo_git) like '%nation_1%' order by repo_owner, repo_name limit 20",
)
query("group_page", lambda t: t.repos.filter("repo_group_id < 4").orderBy("repo_name", "repo_id").offset(5).limit(5).select("repo_id", "repo_name"), "select repo_id, repo_name from repos where repo_group_id < 4 order by repo_name, repo_id limit 5 offset 5")
query("repos_in_list", lambda t: t.repos.filter(F.col("repo_id").isin(1, 3, 5, 99)), "select * from repos where repo_id in (1, 3, 5, 99)")
query("items_not_closed", lambda t: t.items.filter(~F.col("state").eqNullSafe(F.lit("closed"))).select("id", "state"), "select id, state from items where state is distinct from 'closed'")
query("commit_resolution_candidates", lambda t: t.commits.join(t.contributors.filter("cntrb_id % 4 <> 0").select(F.col("email").alias("author_email")).distinct(), "author_email", "left_anti").filter("author_email <> ''").select("hash", "author_email").distinct(), "select distinct hash, author_email from commits where author_email not in (select email from contributors where cntrb_id % 4 <> 0)")
query("open_item_numbers", lambda t: t.issues.filter("closed_at is null").select("repo_id", "id"), "select repo_id, id from issues where closed_at is null")
query(
    "abandoned_issues",
    lambda t: t.issues.filter((F.col("state") == "open") & (F.year(F.lit(AS_OF).cast("date")) - F.year("updated_at") >= 1)).select("id", "repo_id", "updated_at"),
    f"select id, repo_id, updated_at from issues where state = 'open' and year(date '{AS_OF}') - year(updated_at) >= 1",
)
query("issue_reporters", lambda t: t.issues.select("id", "repo_id", F.col("author_id").alias("reporter_id"), "created_at", "closed_at"), "select id, repo_id, author_id as reporter_id, created_at, closed_at from issues")
query("pr_files", lambda t: t.pull_requests.join(t.pr_files, "id").select("id", "repo_id", F.coalesce("path", F.lit("")).alias("path")), "select p.id, p.repo_id, coalesce(path, '') as path from pull_requests p join pr_files f on f.id = p.id")
query(
    "compat_pull_requests",
    lambda t: t.pull_requests.select("id", "repo_id", "created_at", "state").withColumnsRenamed({"id": "pull_request_id", "created_at": "pr_created_at", "state": "pr_src_state"}).withColumn("pr_created_at", F.col("pr_created_at").cast("timestamp_ntz")),
    "select id as pull_request_id, repo_id, created_at as pr_created_at, state as pr_src_state from pull_requests",
)
query("url_rewrite", lambda t: t.repos.select("repo_id", F.replace("repo_git", F.lit("forge.example.org"), F.lit("code.example.net")).alias("repo_git")), "select repo_id, replace(repo_git, 'forge.example.org', 'code.example.net') as repo_git from repos")
_SHIFTED = "created_at closed_at merged_at updated_at".split()
query(
    "bad_timestamp_cleanup",
    lambda t: S.without_bad_times(t.items.select("id", *((F.col(c) - F.make_ym_interval(F.lit(26))).alias(c) for c in _SHIFTED)), _SHIFTED),
    f"select id, {', '.join(f'case when year({c} - interval 26 years) >= 1970 then {c} - interval 26 years end as {c}' for c in _SHIFTED)} from items",
)
query("git_suffix_cleanup", lambda t: t.repos.select("repo_id", S.repo_url(F.col("repo_git")).alias("url"), S.url_owner(F.col("repo_git")).alias("owner"), S.url_repo(F.col("repo_git")).alias("repo")), "select repo_id, regexp_replace(repo_git, '\\.git$', '') as url, repo_owner as owner, lower(repo_name) as repo from repos")
query("libyear_list", lambda t: t.deps.select("repo_id", "name", F.coalesce("license", F.lit("")).alias("license"), "libyear"), "select repo_id, name, coalesce(license, '') as license, libyear from deps")
query("page_urls", lambda t: t.raw("pages").select("page_id", S.trailing_number(F.col("url")).alias("number"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host")), r"select page_id, try_cast(nullif(regexp_extract(url, '(\d+)$', 1), '') as bigint) as number, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages")

# Counts and period metrics.
query("all_repo_prs", lambda t: t.pull_requests.groupBy("repo_id").agg(F.count("*").alias("prs")), "select repo_id, count(*) as prs from pull_requests group by 1")
query("all_repos_commits", lambda t: t.commits.groupBy("repo_id").agg(F.count_distinct("hash").alias("commits")), "select repo_id, count(distinct hash) as commits from commits group by 1")
query("all_repos_issues", lambda t: t.issues.groupBy("repo_id").agg(F.count("*").alias("issues")), "select repo_id, count(*) as issues from issues group by 1")
query("entry_list", lambda t: t.repos.join(t.repo_groups, "repo_group_id").select("repo_git", "rg_name").distinct(), "select distinct repo_git, rg_name from repos join repo_groups using (repo_group_id)")
query(
    "daily_commits",
    lambda t: t.commits.join(t.repos.select("repo_id", "repo_name"), "repo_id", "left").groupBy("repo_id", "repo_name", "committer_date").agg(F.count("*").alias("n"), F.count_distinct("committer_email").alias("committers")),
    "select repo_id, repo_name, committer_date, count(*) as n, count(distinct committer_email) as committers from commits left join repos using (repo_id) group by all",
)
query(
    "libyear_by_month",  # every repository, in its own month and year, gets the average over all dependencies: one row, as the view defines it
    lambda t: t.repos.select("repo_id", "repo_name", F.year("collected_at").cast("long").alias("year"), F.month("collected_at").cast("long").alias("month")).crossJoin(F.broadcast(t.deps.agg(F.round(F.avg("libyear"), 6).alias("avg_libyear")))),
    "select r.repo_id, repo_name, year(r.collected_at) as year, month(r.collected_at) as month, round(avg(libyear), 6) as avg_libyear from repos r, deps d group by all",
)
query(
    "libyear_by_month_per_repo",
    lambda t: t.deps.groupBy("repo_id", F.month("collected_at").cast("long").alias("month")).agg(F.round(F.avg("libyear"), 6).alias("libyear")),
    "select repo_id, month(collected_at) as month, round(avg(libyear), 6) as libyear from deps group by all",
)
_DETAIL = ("repo_id", "name", "requirement", "current_version", "latest_version", "libyear")
query("libyear_detail", lambda t: metrics.named(t.deps.groupBy(*_DETAIL).agg(F.max("collected_at").alias("collected_at")), t.repos), f"select {', '.join(_DETAIL)}, repo_name, max(d.collected_at) as collected_at from deps d join repos using (repo_id) group by all")
_period("issues_new", lambda t: t.issues, "created_at", "issues")
_period("issues_new_weekly", lambda t: t.issues, "created_at", "issues", "week")
_period("issues_closed", lambda t: t.issues, "closed_at", "issues")
query(
    "issues_active",
    lambda t: metrics.per_period(t.item_events.drop("cntrb_id").join(t.issues.select(F.col("id").alias("item_id"), "repo_id"), "item_id"), "created_at", "week", F.count_distinct("item_id")),
    f"select repo_id, {_trunc('week', 'e.created_at')} as period, count(distinct item_id) as value from item_events e join issues i on i.id = item_id group by all",
)
query("issue_backlog", lambda t: t.issues.filter("closed_at is null").groupBy("repo_id").agg(F.count("*").alias("n")), "select repo_id, count(*) as n from issues where closed_at is null group by 1")
query("issue_throughput", lambda t: metrics.throughput(t.issues), "select repo_id, round(count(closed_at) / count(*), 6) as throughput from issues group by 1")
query("issue_duration", lambda t: metrics.durations(t.issues, "closed_at"), "select id, repo_id, created_at, closed_at, round(epoch(closed_at - created_at) / 86400, 6) as days from issues where closed_at is not null")
query("issue_resolution", lambda t: metrics.average_resolution(t.issues), "select repo_id, coalesce(round(avg(epoch(closed_at - created_at) / 86400), 6), 0) as days from issues group by 1")
_period("prs_new", lambda t: t.pull_requests, "created_at", "pull_requests")
_period("prs_accepted", lambda t: t.pull_requests, "merged_at", "pull_requests")
_period("prs_declined", lambda t: t.pull_requests.filter("merged_at is null"), "closed_at", "(from pull_requests where merged_at is null)")
query("review_duration", lambda t: metrics.durations(t.pull_requests, "merged_at"), "select id, repo_id, created_at, merged_at, round(epoch(merged_at - created_at) / 86400, 6) as days from pull_requests where merged_at is not null")
_period("committers", lambda t: t.commits, "authored_at", "commits", "month", lambda: F.count_distinct("author_email"), "count(distinct author_email)")
_period("code_changes", lambda t: t.commits, "authored_at", "commits", "week", lambda: F.count_distinct("hash"), "count(distinct hash)")
query(
    "code_changes_lines",
    lambda t: t.commits.groupBy("repo_id", metrics.bucket("authored_at", "month").alias("period")).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")),
    f"select repo_id, {_trunc('month', 'authored_at')} as period, cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed from commits group by all",
)
query(
    "issues_in_range",
    lambda t: metrics.per_period(t.issues, "created_at", "day", begin="1996-01-01", end="1996-12-31"),
    f"select repo_id, {_trunc('day', 'created_at')} as period, count(*) as value from issues where created_at between timestamp '1996-01-01' and timestamp '1996-12-31' group by all",
)
query(
    "contributors",
    lambda t: metrics.contributor_summary(t.commits, t.pull_requests, t.issues, t.repos, "1994-01-01", "1997-12-31"),
    """with s as (select author_id as a, repo_id, count(distinct hash) as c, 0 as i, 0 as p from commits where author_id is not null and authored_at between timestamp '1994-01-01' and timestamp '1997-12-31' group by all
       union all select author_id, repo_id, 0, count(*), 0 from issues where author_id is not null and created_at between timestamp '1994-01-01' and timestamp '1997-12-31' group by all
       union all select author_id, repo_id, 0, 0, count(*) from pull_requests where author_id is not null and created_at between timestamp '1994-01-01' and timestamp '1997-12-31' group by all)
       select repo_id, coalesce(cast(a as varchar), 'unknown') as user_id, cast(sum(c) as bigint) as commits, cast(sum(i) as bigint) as issues, cast(sum(p) as bigint) as prs, cast(0 as bigint) as issue_comments, cast(0 as bigint) as pr_comments,
       cast(sum(c + i + p) as bigint) as total, repo_name from s join repos using (repo_id) group by all""",
)
_FIRST = "select repo_id, author_id, min(authored_at) as f from commits group by all union all select repo_id, author_id, min(created_at) from issues group by all"
query("contributors_new", lambda t: metrics.new_contributors(t.commits, t.issues, "month"), f"select repo_id, {_trunc('month', 'f')} as period, count(*) as value from ({_FIRST}) group by all")
query("contributors_new_deduped", lambda t: metrics.new_contributors(t.commits, t.issues, "month", True), f"select repo_id, {_trunc('month', 'f')} as period, count(*) as value from (select repo_id, author_id, min(f) as f from ({_FIRST}) group by all) group by all")
query("star_series", lambda t: t.repo_info.select("repo_id", F.date_trunc("day", "collected_at").cast("timestamp_ntz").alias("day"), "stars", "forks", "watchers"), "select repo_id, cast(date_trunc('day', collected_at) as timestamp) as day, stars, forks, watchers from repo_info")
query("stars_latest", lambda t: metrics.latest_counter(t.repo_info, "stars"), "select repo_id, max_by(stars, (collected_at, info_id)) as stars from repo_info group by 1")
query("messages_per_period", lambda t: metrics.per_period(t.messages.join(t.items.select(F.col("id").alias("item_id"), "repo_id"), "item_id"), "msg_timestamp", "month"), f"select repo_id, {_trunc('month', 'msg_timestamp')} as period, count(*) as value from messages join items on id = item_id group by all")
query(
    "languages",
    lambda t: t.labor.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum(F.col("code_lines") + F.col("blank_lines") + F.col("comment_lines")).alias("lines"), F.sum("blank_lines").alias("blanks"), F.sum("comment_lines").alias("comments"), F.sum("code_lines").alias("code"), F.sum("complexity").alias("complexity")),
    "select repo_id, language, count(*) as files, cast(sum(code_lines + blank_lines + comment_lines) as bigint) as lines, cast(sum(blank_lines) as bigint) as blanks, cast(sum(comment_lines) as bigint) as comments, cast(sum(code_lines) as bigint) as code, cast(sum(complexity) as bigint) as complexity from labor group by all",
)
_SERIES = """(select repo_id, 'commits' as metric, authored_at as ts, hash as key from commits union all select repo_id, 'prs_opened', created_at, id from pull_requests
    union all select repo_id, 'prs_merged', merged_at, id from pull_requests union all select repo_id, 'issues', created_at, id from issues)"""
query(
    "weekly_series",
    lambda t: metrics.weekly_series(t.commits, t.pull_requests, t.issues, "1996-01-01", "1999-01-01"),
    f"select repo_id, metric, {_trunc('week', 'ts')} as week, count(distinct key) as value from {_SERIES} where ts >= timestamp '1996-01-01' and ts < timestamp '1999-01-01' group by all",
)
_SUMS = "cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed, cast(sum(whitespace) as bigint) as whitespace, count(distinct filename) as files, count(distinct hash) as patches"
_WHO = "coalesce(nullif(trim(affiliation), ''), '(Unknown)') as affiliation"
for _name, _cols in {"year": "year(authored_at) as year", "month": "year(authored_at) as year, month(authored_at) as month", "week": "year(authored_at) as year, week(authored_at) as week"}.items():
    query(f"repo_aggregates_{_name}", lambda t, p=_name: metrics.period_aggregates(t.commits, p, parts=t.parts("lineitem")), f"select repo_id, author_email, {_WHO}, {_cols}, {_SUMS} from commits where authored_at is not null group by all")
    query(
        f"group_aggregates_{_name}",
        lambda t, p=_name: metrics.period_aggregates(t.commits.join(t.repos.select("repo_id", "repo_group_id"), "repo_id"), p, ("repo_group_id",), t.parts("lineitem")),
        f"select repo_group_id, author_email, {_WHO}, {_cols}, {_SUMS} from commits join repos using (repo_id) where authored_at is not null group by all",
    )
query(
    "repo_stats",
    lambda t: metrics.repo_stats(t.repos, t.pull_requests, t.issues, t.commits, t.repo_info, t.vulnerabilities),
    """select r.repo_id, repo_name, coalesce(prs, 0) as prs, coalesce(issues, 0) as issues, coalesce(commits, 0) as commits, coalesce(m.pr_count, 0) as meta_pr_count, coalesce(m.issues_count, 0) as meta_issues_count, coalesce(m.commit_count, 0) as meta_commit_count, coalesce(v, 0) as vulnerabilities, coalesce(x, 0) as critical_vulnerabilities
       from repos r left join (select repo_id, count(*) as prs from pull_requests group by 1) using (repo_id) left join (select repo_id, count(*) as issues from issues group by 1) using (repo_id)
       left join (select repo_id, count(distinct hash) as commits from commits group by 1) using (repo_id)
       left join (select distinct on (repo_id) repo_id, pr_count, issues_count, commit_count from repo_info order by repo_id, collected_at desc, info_id desc) m using (repo_id)
       left join (select p_partkey % 25 as repo_id, count(*) as v, count(*) filter (p_partkey % 4 = 0) as x from part group by 1) using (repo_id)""",
)
query("newest_event", lambda t: t.item_events.groupBy("cntrb_id").agg(F.max("created_at").alias("newest")), "select cntrb_id, max(created_at) as newest from item_events group by 1")
query("event_payloads", lambda t: t.item_events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n")), "select cast(props->>'k' as bigint) as k, count(*) as n from item_events group by 1")
query("duplicate_commit_keys", lambda t: t.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1"), "select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
query("commits_deduped", lambda t: t.commits.select("hash", "filename", "author_id", "added"), "select hash, filename, author_id, added from commits")
query("status_counts", lambda t: t.spark.createDataFrame([("open",), ("closed",), ("merged",), ("lost",)], "state string").join(t.items.groupBy("state").agg(F.count("*").alias("n")), "state", "left").fillna(0), "select s.state, coalesce(n, 0) as n from (values ('open'), ('closed'), ('merged'), ('lost')) s(state) left join (select state, count(*) as n from items group by 1) using (state)")
query("groups_with_repo_counts", lambda t: t.repo_groups.join(t.repos, "repo_group_id", "left").groupBy("repo_group_id", "rg_name").agg(F.count("repo_id").alias("repos")), "select repo_group_id, rg_name, count(repo_id) as repos from repo_groups left join repos using (repo_group_id) group by all")
query(
    "commit_count_backfill",
    lambda t: t.repo_info.join(t.commits.groupBy("repo_id").agg(F.count_distinct("hash").alias("n")), "repo_id", "left").select("info_id", "repo_id", F.when(F.col("commit_count") == 0, F.coalesce("n", F.lit(0))).otherwise(F.col("commit_count")).alias("commit_count")),
    "select info_id, repo_id, case when commit_count = 0 then coalesce(n, 0) else commit_count end as commit_count from repo_info left join (select repo_id, count(distinct hash) as n from commits group by 1) using (repo_id)",
)
query("dependency_counts", lambda t: t.deps.groupBy("manager", "kind").agg(F.count("*").alias("n")), "select manager, kind, count(*) as n from deps group by all")

# Licences, vulnerabilities, people.
_SPDX = """case when upper(trim(license)) in ('', 'NOASSERTION') then 'Unknown' when lower(trim(license)) in ('mit', 'mit license') then 'MIT' when license = 'Apache 2.0' then 'Apache-2.0' when license = 'BSD' then 'BSD-3-Clause'
    when license = 'GPLv3' then 'GPL-3.0-only' when license = 'ISC license' then 'ISC' when license = 'MPL 2.0' then 'MPL-2.0' else license end"""
query("licence_counts", lambda t: reports.licence_counts(t.deps, "license", "repo_id"), f"select repo_id, {_SPDX} as licence, count(*) as n, licence not in ('Unknown', 'Custom terms') as is_osi from deps group by repo_id, licence")
query(
    "document_licence_ids",
    lambda t: t.raw("documents").groupBy(F.coalesce(S.licence_text_id(F.col("text")), F.lit("none")).alias("licence")).agg(F.count("*").alias("n")),
    """select case when contains(l, 'apache license') and contains(l, '2.0') then 'Apache-2.0' when contains(l, 'gnu general public license') and contains(l, 'version 3') then 'GPL-3.0-only'
       when contains(l, 'gnu general public license') and contains(l, 'version 2') then 'GPL-2.0-only' else 'none' end as licence, count(*) as n from (select lower(text) as l from documents) group by 1""",
)
_VECTOR = "case p_partkey % 4 when 0 then 'CVSS:3.1/AV:N/AC:L/C:H/I:H/A:H' when 1 then 'CVSS:3.1/AV:N/AC:L/C:L/I:H/A:N' when 2 then 'CVSS:3.1/AV:L/AC:H' else 'CVSS:3.1/AV:N/AC:H' end"
query(
    "vulnerability_counts",
    lambda t: reports.vulnerability_counts(t.raw("part").select((F.col("p_partkey") % 25).alias("repo_id"), F.expr(_VECTOR).alias("vector"))),
    "select p_partkey % 25 as repo_id, count(*) as total, count(*) filter (p_partkey % 4 = 0) as critical from part group by 1",
)
query(
    "vulnerability_severity",
    lambda t: t.raw("part").select("p_partkey", S.cvss_score(F.expr(_VECTOR)).alias("score")).withColumn("label", S.cvss_label(F.col("score"))),
    "select p_partkey, cast([9.8, 7.5, 4.0, 6.5][p_partkey % 4 + 1] as double) as score, ['CRITICAL', 'HIGH', 'MEDIUM', 'MEDIUM'][p_partkey % 4 + 1] as label from part",
)
query(
    "consensus_affiliation",
    lambda t: reports.consensus_affiliation(t.contributors),
    "with n as (select split_part(email, '@', 2) as domain, company, count(*) as n from contributors group by all) select distinct on (domain) domain, company, n from n order by domain, n desc, company",
)
query(
    "domain_lookup",
    lambda t: reports.domain_lookup(t.contributors, t.spark.createDataFrame([("example.com", "Example"), ("org3.example.com", "Third"), ("org5.example.com", "Fifth")], "domain string, affiliation string")),
    "select distinct email, case split_part(email, '@', 2) when 'org3.example.com' then 'Third' when 'org5.example.com' then 'Fifth' else 'Example' end as affiliation from contributors",
)
query(
    "resolve_identities",
    lambda t: reports.resolve_identities(t.commits, t.contributors.filter("cntrb_id % 3 <> 0"), t.contributors.filter("cntrb_id % 6 = 0").select(F.col("email").alias("alias_email"), "cntrb_id")),
    """with e as (select distinct author_email as email from commits) select e.email, coalesce(o.cntrb_id, a.cntrb_id) as cntrb_id, case when o.cntrb_id is not null then 'address' when a.cntrb_id is not null then 'alias' end as how
       from e left join (from contributors where cntrb_id % 3 <> 0) o using (email) left join (from contributors where cntrb_id % 6 = 0) a on a.email = e.email""",
)
query(
    "person_ids",
    lambda t: t.contributors.select("cntrb_id", S.person_uuid(F.lit(1), F.col("cntrb_id")).alias("uuid")),
    "select cntrb_id, '01' || lpad(lower(to_hex(cntrb_id)), 8, '0')[1:6] || '-' || lpad(lower(to_hex(cntrb_id)), 8, '0')[7:8] || '00-0000-0000-000000000000' as uuid from contributors",
)


def _requirements(t: Tables) -> DataFrame:
    line = F.concat(F.lit("pkg"), F.col("dep_id").cast("string"), F.lit("=="), F.col("libyear").cast("long").cast("string"), F.lit(".0"))
    path = F.concat(F.lit("/"), F.col("repo_id").cast("string"), F.lit("/requirements.txt")).alias("path")
    return t.deps.groupBy("repo_id").agg(F.array_join(F.collect_list(line), "\n").alias("text")).select(path, "text")


query("manifest_dependencies", lambda t: manifests.dependencies(_requirements(t)), "select '/' || repo_id || '/requirements.txt' as path, 'pypi' as manager, 'pkg' || dep_id as name, cast(libyear as bigint) || '.0' as version, 'runtime' as type from deps")
_registry = lambda t: t.deps.select(F.lit("pypi").alias("manager"), F.concat(F.lit("pkg"), F.col("dep_id").cast("string")).alias("name"), F.concat(F.col("libyear").cast("long").cast("string"), F.lit(".0")).alias("version"), F.lit("2020-01-01T00:00:00Z").alias("released_at"), "license", F.lit(True).alias("is_latest")).withColumnRenamed("license", "licence")
query(
    "registry_join",
    lambda t: manifests.registry_join(manifests.dependencies(_requirements(t)), _registry(t)).select("path", "name", "purl", "latest_version", "licence", "libyear"),
    f"select '/' || repo_id || '/requirements.txt' as path, 'pkg' || dep_id as name, 'pkg:pypi/pkg' || dep_id || '@' || cast(libyear as bigint) || '.0' as purl, cast(libyear as bigint) || '.0' as latest_version, {_SPDX} as licence, cast(0 as double) as libyear from deps",
)
query("sbom_documents", lambda t: reports.sbom(t.repos, t.deps))

# Views.
_ACTIVITY = """a as (
    select author_id as cntrb_id, authored_at as created_at, repo_id, 'commit' as action, author_id as actor from (select distinct hash, author_id, repo_id, authored_at from commits)
    union all select author_id, created_at, repo_id, 'issue_opened', author_id from issues
    union all select cntrb_id, e.created_at, repo_id, 'pull_request_closed', cntrb_id from item_events e join pull_requests p on p.id = item_id where merged_at is null and action = 'closed'
    union all select cntrb_id, e.created_at, repo_id, 'pull_request_merged', cntrb_id from item_events e join pull_requests p on p.id = item_id where action = 'merged'
    union all select cntrb_id, e.created_at, repo_id, 'issue_closed', cntrb_id from item_events e join issues i on i.id = item_id where action = 'closed'
    union all select cntrb_id, e.created_at, repo_id, 'pull_request_review_labeled', cntrb_id from item_events e join pull_requests p on p.id = item_id where action = 'labeled'
    union all select author_id, created_at, repo_id, 'pull_request_open', author_id from pull_requests
    union all select cntrb_id, msg_timestamp, repo_id, 'pull_request_comment', cntrb_id from messages join pull_requests p on p.id = item_id
    union all select author_id, msg_timestamp, repo_id, 'issue_comment', cntrb_id from messages join issues i on i.id = item_id where closed_at <> msg_timestamp)"""
_RANKED = "select a.cntrb_id, created_at, a.repo_id, action, login, repo_name, row_number() over (partition by a.cntrb_id, a.repo_id order by created_at desc nulls first, action, login) as rank from a join repos using (repo_id) left join (select cntrb_id as actor, login from contributors) using (actor)"
query("contributor_actions", lambda t: views.contributor_actions(t), f"with {_ACTIVITY} {_RANKED}")
query("contributor_recent_actions", lambda t: views.contributor_actions(t, "1998-05-01"), f"with {_ACTIVITY} {_RANKED} where created_at >= timestamp '1998-05-01'")
query(
    "new_contributors",
    lambda t: views.first_actions(t, parts=t.parts("lineitem")),
    """with c as (select canonical, min(cntrb_id) as canonical_id from contributors where canonical = email group by 1), p as (select cntrb_id, login, canonical, canonical_id from contributors left join c using (canonical)),
       c2 as (select distinct hash, repo_id from commits),
       r as (select canonical_id as id, created_at, i.repo_id, 'issue_opened' as action, login from issues i left join p on author_id = cntrb_id
       union select canonical_id, date_trunc('day', authored_at), m.repo_id, 'commit', login from commits m left join p on author_email = canonical
       union select n.cntrb_id, n.created_at, c2.repo_id, 'commit_comment', login from commit_comments n join c2 using (hash) left join p on p.cntrb_id = n.cntrb_id
       union select e.cntrb_id, e.created_at, i.repo_id, 'issue_closed', login from item_events e join issues i on i.id = item_id left join p on p.cntrb_id = e.cntrb_id where action = 'closed' and e.cntrb_id is not null
       union select author_id, created_at, q.repo_id, 'open_pull_request', login from pull_requests q left join p on author_id = cntrb_id
       union select m.cntrb_id, msg_timestamp, q.repo_id, 'pull_request_comment', login from messages m join pull_requests q on q.id = item_id left join p on p.cntrb_id = m.cntrb_id)
       select *, row_number() over (partition by id, repo_id order by created_at desc nulls first, action, login) as rank from r where id is not null qualify rank <= 7""",
)
for _name in ("pull_requests", "issues"):
    query(
        f"{_name}_assignments",
        lambda t, n=_name: views.assignments(getattr(t, n), t.item_events),
        f"select i.id, repo_id, i.created_at as created, i.closed_at as closed, e.created_at as assign_date, e.action as assignment_action, e.cntrb_id as assignee from {_name} i left join item_events e on item_id = i.id and action in ('assigned', 'unassigned')",
    )
query(
    "pr_response",
    lambda t: views.pr_response(t.pull_requests, t.messages),
    "with m as (select distinct item_id, msg_timestamp, cntrb_id as msg_cntrb_id from messages) select id, repo_id, author_id as cntrb_id, created_at as pr_created_at, closed_at as pr_closed_at, msg_timestamp, msg_cntrb_id from pull_requests left join m on item_id = id",
)
query(
    "pr_response_times",
    lambda t: views.pr_response_times(t),
    f"""with r as (select e.item_id, min(msg_timestamp) as first, max(msg_timestamp) as last, count(distinct msg_timestamp) as comment_count, {", ".join(f"count(*) filter (action = '{a}') as {a}_count" for a in views.ACTIONS)}
       from item_events e join messages m on m.item_id = e.item_id group by 1)
       select p.id, repo_id, repo_name, rg_name as repo_group, state, year(created_at) as created_year, month(closed_at) as closed_month, round(epoch(closed_at - created_at) / 3600, 4) as hours_to_close,
       round(epoch(first - created_at) / 3600, 4) as hours_to_first_response, round(epoch(last - created_at) / 3600, 4) as hours_to_last_response, round(epoch(last - first) / comment_count, 4) as seconds_between_responses,
       comment_count, {", ".join(f"{a}_count" for a in views.ACTIONS)} from pull_requests p join repos using (repo_id) join repo_groups using (repo_group_id) left join r on item_id = p.id""",
)
_SPANS = {"close": "closed_at", "first_response": "first_response_time", "last_response": "last_response_time"}
query(
    "pr_response_view",
    lambda t: views.pr_response_view(t.pull_requests, t.repos, t.repo_groups, t.pr_events, t.messages, t.pr_merges, t.pr_commits, t.pr_meta, t.commits),
    f"""with r as (select p.id, {", ".join(f"count(*) filter (action = '{a}') as {a}_count" for a in views.VIEW_ACTIONS)}, min(msg_timestamp) as first_response_time, max(msg_timestamp) as last_response_time,
         count(distinct msg_timestamp) as comment_count from pr_events e, pull_requests p, repos, messages m where repos.repo_id = p.repo_id and p.id = e.item_id and p.id = m.item_id group by p.id),
       counts as (select c.id, count(distinct c.sha) as commit_count from pr_commits c, pr_merges p, pr_meta m where p.id = c.id and p.id = m.id and c.sha <> p.merge_sha and c.sha <> m.meta_sha group by c.id),
       labels as (select id, head_or_base, meta_label from pr_meta where head_or_base = 'base' group by id, head_or_base, meta_label),
       lines as (select c.id, sum(k.added) as lines_added, sum(k.removed) as lines_removed, count(distinct k.filename) as file_count from pr_commits c, commits k, pr_merges p, pr_meta m
         where k.hash = c.sha and p.id = c.id and p.id = m.id and k.repo_id = p.repo_id and k.hash <> p.merge_sha and k.hash <> m.meta_sha group by c.id)
       select repos.repo_id, p.id, repo_name, rg_name as repo_group, state, merged_at, created_at, closed_at, year(created_at) as created_year, month(created_at) as created_month, year(closed_at) as closed_year,
         month(closed_at) as closed_month, meta_label, head_or_base, {", ".join(f"round(epoch({c} - created_at) / {u}, 4) as {unit}_to_{n}" for n, c in _SPANS.items() for unit, u in (("hours", 3600), ("days", 86400)))},
         first_response_time, last_response_time, round(epoch(last_response_time - first_response_time) / comment_count, 4) as seconds_between_responses, comment_count, {", ".join(f"{a}_count" for a in views.VIEW_ACTIONS)},
         commit_count, cast(lines_added as bigint) as lines_added, cast(lines_removed as bigint) as lines_removed, file_count
       from repos, repo_groups, pull_requests p left join r on p.id = r.id left join counts on p.id = counts.id left join labels on labels.id = counts.id left join lines on labels.id = lines.id
       where repos.repo_group_id = repo_groups.repo_group_id and repos.repo_id = p.repo_id""",
)
query(
    "language_breakdown",
    lambda t: views.language_breakdown(t.labor),
    "with x as (select repo_id, max(analysed_at) as latest from labor group by 1) select repo_id, language, count(*) as files, cast(sum(code_lines) as bigint) as code_lines, max(complexity) as complexity from labor join x using (repo_id) where analysed_at > latest - interval 5 minutes group by all",
)
query("repo_files", lambda t: views.repo_files(t.labor), "select repo_id, file_path, language, code_lines from labor where (repo_id, analysed_at) in (select (repo_id, max(analysed_at)) from labor group by repo_id)")
query(
    "contributors_per_file",
    lambda t: views.contributors_per_file(t.pull_requests, t.pr_files, t.pr_reviews, t.parts("lineitem")),
    """select repo_id, coalesce(path, '') as file_path, coalesce(string_agg(distinct cast(author_id as varchar), ',' order by cast(author_id as varchar)), '') as cntrb_ids,
       coalesce(string_agg(distinct cast(v.cntrb_id as varchar), ',' order by cast(v.cntrb_id as varchar)), '') as reviewer_ids from pull_requests p join pr_files f using (id) left join pr_reviews v using (id) group by all""",
)
query(
    "user_repos",
    lambda t: t.contributors.select("cntrb_id", "login", F.col("repo_id").alias("home")).join(t.repos.select(F.col("repo_id").alias("home"), "repo_group_id"), "home").join(t.repos.select("repo_id", "repo_group_id"), "repo_group_id").select("login", "cntrb_id", "repo_group_id", "repo_id"),
    "select login, cntrb_id, h.repo_group_id, r.repo_id from contributors c join repos h on c.repo_id = h.repo_id join repos r on r.repo_group_id = h.repo_group_id",
)

# Gaps, comparison, reconciliation, merges, queue.
_expected = lambda t: t.items.select("repo_id", F.col("id").alias("number"))
_collected = lambda t: _expected(t).filter("number % 10 not in (3, 4, 7)")
query(
    "gaps",
    lambda t: reports.gaps(_expected(t), _collected(t)),
    """with m as (select repo_id, id as number, id % 10 not in (3, 4, 7) as have from items), r as (select *, sum(case when have then 1 else 0 end) over (partition by repo_id order by number) as run from m)
       select repo_id, min(number) as first, max(number) as last, count(*) as n from r where not have group by repo_id, run""",
)
_half = lambda t: _expected(t).filter("case when repo_id % 2 = 0 then number % 10 not in (3, 4, 7) else number % 50 <> 3 end")
query(
    "gap_fill_plan",
    lambda t: reports.fill_plan(_expected(t), _half(t), t.items.groupBy("repo_id").agg(F.count("*").alias("n")), 40),
    """with m as (select repo_id, id as number, case when repo_id % 2 = 0 then id % 10 not in (3, 4, 7) else id % 50 <> 3 end as have from items),
       due as (select repo_id from m group by 1 having count(*) filter (where not have) * 100.0 / count(*) > 5),
       c as (select *, row_number() over (partition by repo_id order by number) as k from m where have),
       r as (select *, sum(case when have then 1 else 0 end) over (partition by repo_id order by number) as run from m where repo_id in (select repo_id from due)),
       g as (select repo_id, run, min(number) as first, max(number) as last from r where not have group by repo_id, run),
       f as (select repo_id, unnest(range(first, last + 1)) as number from g union select g.repo_id, c.number from g join c on c.repo_id = g.repo_id and c.k between run - 1 and run + 2),
       p as (select *, ceil(count(*) over (partition by repo_id) / 40.0) as shards, count(*) over (partition by repo_id) as n, row_number() over (partition by repo_id order by number) - 1 as pos from f)
       select repo_id, number, cast(1 + case when pos < n % shards * (floor(n / shards) + 1) then floor(pos / (floor(n / shards) + 1)) else n % shards + floor((pos - n % shards * (floor(n / shards) + 1)) / floor(n / shards)) end as bigint) as shard from p""",
)
_shards = lambda t: _expected(t).withColumn("shard", F.ntile(4).over(Window.partitionBy("repo_id").orderBy("number")).cast("long"))
query("shards", _shards, "select repo_id, id as number, ntile(4) over (partition by repo_id order by id) as shard from items")
query("reconcile", lambda t: _expected(t).join(_collected(t), ["repo_id", "number"], "left_anti").distinct(), "select distinct repo_id, id as number from items where id % 10 in (3, 4, 7)")
_weekly = lambda t: t.commits.filter("repo_id < 5").groupBy("repo_id", metrics.bucket("authored_at", "week").alias("week")).agg(F.count_distinct("hash").alias("value"))
_WEEKLY = """with s as (select repo_id, cast(date_trunc('week', authored_at) as timestamp) as week, count(distinct hash) as value from commits where repo_id < 5 group by all),
    f as (select r.repo_id, w.week, coalesce(value, 0) as value from (select distinct repo_id from s) r cross join (select distinct week from s) w left join s on s.repo_id = r.repo_id and s.week = w.week)"""
query("compare_percent", lambda t: reports.compare(_weekly(t), "percent"), f"{_WEEKLY} select repo_id, week, round(value / greatest(max(value) over (partition by repo_id), 1) * 100, 6) as value from f")
query("compare_zscore", lambda t: reports.compare(_weekly(t), "zscore"), f"{_WEEKLY} select repo_id, week, round((value - avg(value) over p) / case when stddev_pop(value) over p = 0 then 1 else stddev_pop(value) over p end, 6) as value from f window p as (partition by repo_id)")
query(
    "semantic_diff",
    lambda t: reports.semantic_diff(
        t.items.filter("id % 5 <> 1").select("repo_id", "id", "state", "closed_at"),
        t.items.filter("id % 7 <> 1").select("repo_id", "id", F.when(F.col("id") % 11 == 0, F.lit("lost")).otherwise(F.col("state")).alias("state"), "closed_at"), ["repo_id", "id"],
    ),
    "select repo_id, id, case when id % 5 = 1 then 'extra' when id % 7 = 1 then 'missing' else 'content' end as status from items where (id % 5 = 1 and id % 7 <> 1) or (id % 7 = 1 and id % 5 <> 1) or (id % 11 = 0 and id % 5 <> 1 and id % 7 <> 1)",
)
query(
    "upsert_items",
    lambda t: merge.upsert(t.items.filter("id % 3 <> 0").select("id", "state", "author_id"), t.items.filter("id % 2 = 0").select("id", F.lit("new").alias("state"), F.when(F.col("id") % 4 == 0, F.col("author_id") + 1).alias("author_id")), ["id"], ["state"], ("author_id",)),
    "select id, case when id % 2 = 0 then 'new' else state end as state, case when id % 4 = 0 then author_id + 1 when id % 3 <> 0 then author_id end as author_id from items where id % 3 <> 0 or id % 2 = 0",
)
query("insert_absent_items", lambda t: merge.insert_absent(t.items.filter("id % 3 = 0").select("id", "state"), t.items.filter("id % 2 = 0").select("id", F.lit("new").alias("state")), ["id"]), "select id, case when id % 3 = 0 then state else 'new' end as state from items where id % 3 = 0 or id % 2 = 0")
query("history_latest", lambda t: merge.latest(t.repo_info.select("repo_id", "collected_at", "info_id", "stars"), ["repo_id"], ["collected_at", "info_id"]), "select distinct on (repo_id) repo_id, collected_at, info_id, stars from repo_info order by repo_id, collected_at desc, info_id desc")
query(
    "queue_listing",
    lambda t: reports.queue_order(t.items.select(F.col("id").alias("repo_id"), F.when(F.col("state") == "open", "queued").when(F.col("state") == "merged", "collecting").otherwise("done").alias("status"), (F.col("id") % 5).alias("priority"), F.col("created_at").alias("due_at"))).offset(20).limit(40),
    "select id as repo_id, case state when 'open' then 'queued' when 'merged' then 'collecting' else 'done' end as status, id % 5 as priority, created_at as due_at from items order by case state when 'merged' then 0 when 'open' then 1 else 2 end, id % 5, created_at, id limit 40 offset 20",
)
query("most_recent", lambda t: t.contributors.join(t.item_events.groupBy("cntrb_id").agg(F.max("created_at").alias("seen")), "cntrb_id", "left").select("cntrb_id", "seen").orderBy(F.desc_nulls_last("seen"), "cntrb_id").limit(100), "select c.cntrb_id, seen from contributors c left join (select cntrb_id, max(created_at) as seen from item_events group by 1) e using (cntrb_id) order by seen desc nulls last, cntrb_id limit 100")
query("top_languages", lambda t: t.labor.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(5), "select language, count(*) as n from labor group by 1 order by n desc, language limit 5")
query("least_recent", lambda t: t.contributors.join(t.item_events.groupBy("cntrb_id").agg(F.max("created_at").alias("seen")), "cntrb_id", "left").select("cntrb_id", "seen").orderBy(F.asc_nulls_first("seen"), "cntrb_id").limit(100), "select c.cntrb_id, seen from contributors c left join (select cntrb_id, max(created_at) as seen from item_events group by 1) e using (cntrb_id) order by seen asc nulls first, cntrb_id limit 100")


def _windows(t: Tables) -> DataFrame:
    from .streaming.ingest import event_windows

    return event_windows(t.item_events)


query("event_windows", _windows, "select date_trunc('hour', created_at) as start, action, count(*) as n from item_events group by all")

# Sinks: written through the store in several commits and read back.


def _rotated(t: Tables) -> DataFrame:
    """Three rounds of snapshots; each moves the snapshots before it to the history."""
    store, rows = Store(t.spark, scratch(t.spark, "repo-info")), t.repo_info.select("repo_id", "info_id", "stars")
    for k in range(3):
        jobs.rotate(store, "repo_info", rows.filter(F.col("info_id") % 3 == k), "info", k)
    return store.table("repo_info").withColumn("live", F.lit(True)).unionByName(store.table("repo_info_history").withColumn("live", F.lit(False)))


def _replaced(t: Tables) -> DataFrame:
    store, rows = Store(t.spark, scratch(t.spark, "deps")), t.deps.select("repo_id", "dep_id", "name")
    store.commit([Replace("deps", rows, t.repos)])
    store.commit([Replace("deps", rows.filter("dep_id % 2 = 0"), t.repos.filter("repo_id < 10"))])
    return store.table("deps")


def _refreshed(t: Tables) -> DataFrame:
    """All repositories up to 1995, then every second one anew from all commits."""
    store = Store(t.spark, scratch(t.spark, "aggregates"))
    jobs.refresh_aggregates(store, t.commits.filter("year(authored_at) < 1996"), t.repos, "aggregates", 0, t.parts("lineitem"))
    jobs.refresh_aggregates(store, t.commits, t.repos.filter("repo_id % 2 = 0"), "aggregates", 1, t.parts("lineitem"))
    return store.table("repo_aggregates_month")


def _bundled(t: Tables) -> DataFrame:
    """Half of the pull requests as they were when open, then all as they are; each round is one commit of all child tables."""
    store, listed = Store(t.spark, scratch(t.spark, "bundles"), buckets=8), scratch(t.spark, "bundle-pages")
    t.pr_bundles.write.parquet(listed)  # staged once, as the collector does, for both rounds
    staged = t.spark.read.parquet(listed)
    early = staged.filter("seq % 2 = 0").withColumn("payload", F.regexp_replace("payload", '"(CLOSED|MERGED)"', '"OPEN"'))
    for k, rows in enumerate((early, staged)):
        path = scratch(t.spark, "bundle-rows")
        bundles.fan_out(rows).write.partitionBy("entity").parquet(path)
        store.commit(bundles.changes(t.spark.read.parquet(path)), "bundles", k)
    text = {"pull_requests": ("", "state"), "pr_files": ("path", "cast(added as string)"), "pr_commits": ("sha", "''"), "pr_reviews": ("cast(review_id as string)", "cast(author_id as string)"), "pr_meta": ("head_or_base", "ref"), "messages": ("cast(msg_id as string)", "msg_text"), "pr_message_refs": ("cast(msg_id as string)", "''")}
    rows = [store.table(e).selectExpr("repo_id", "cast(null as bigint) as number" if e == "messages" else "number", f"'{e}' as entity", f"{k or chr(39) * 2} as key", f"{v} as value") for e, (k, v) in text.items()]
    return reduce(DataFrame.unionByName, rows)


query("repo_info_rotated", _rotated, "select repo_id, info_id, stars, info_id % 3 = max(info_id % 3) over (partition by repo_id) as live from repo_info")
query("deps_replaced", _replaced, "select repo_id, dep_id, name from deps where repo_id >= 10 or dep_id % 2 = 0")
query("aggregates_refreshed", _refreshed, f"select repo_id, author_email, {_WHO}, year(authored_at) as year, month(authored_at) as month, {_SUMS} from commits where authored_at is not null and (repo_id % 2 = 0 or year(authored_at) < 1996) group by all")
query(
    "pr_bundle_children",
    _bundled,
    """select repo_id, id as number, 'pull_requests' as entity, '' as key, state as value from pull_requests
       union all select distinct repo_id, p.id, 'pr_files', path, cast(length(path) as varchar) from pull_requests p join pr_files f on p.id = f.id
       union all select repo_id, p.id, 'pr_commits', cast(sha as varchar), '' from pull_requests p join pr_commits c on p.id = c.id
       union all select repo_id, p.id, 'pr_reviews', cast(event_id as varchar), cast(cntrb_id as varchar) from pull_requests p join item_events e on p.id = e.item_id where action = 'labeled'
       union all select repo_id, id, 'pr_meta', 'head', 'topic' from pull_requests
       union all select repo_id, null, 'messages', cast(msg_id as varchar), msg_text from pull_requests p join messages m on p.id = m.item_id
       union all select repo_id, p.id, 'pr_message_refs', cast(msg_id as varchar), '' from pull_requests p join messages m on p.id = m.item_id""",
)

# The collection queue, with items as its jobs.


def _queue(t: Tables) -> DataFrame:
    held, worker = F.col("state") == "merged", F.concat(F.lit("w"), (F.col("id") % 3).cast("string"))
    values = {
        "repo_id": F.col("id"), "priority": F.col("id") % 5, "status": F.when(held, "collecting").otherwise("queued"), "due_at": F.col("created_at"), "locked_by": F.when(held, worker), "locked_at": F.when(held, F.col("closed_at")),
        "last_collected": F.col("closed_at"), "force_full": F.col("id") % 7 == 0, "last_error": F.lit(None),
    }
    return t.items.select(*(values[c].cast(k).alias(c) for c, k in queue.COLUMNS.items()))


_QUEUE = """with q as (select id as repo_id, cast(id % 5 as int) as priority, case state when 'merged' then 'collecting' else 'queued' end as status, created_at as due_at, case state when 'merged' then 'w' || id % 3 end as locked_by,
    case state when 'merged' then closed_at end as locked_at, closed_at as last_collected, id % 7 = 0 as force_full, cast(null as varchar) as last_error from items)"""
query(
    "queue_claimed",
    lambda t: queue.claim(_queue(t), ["a", "b", "c", "d", "e"], "1996-01-01 00:00:00"),
    f"""{_QUEUE}, c as (select repo_id, chr(96 + cast(row_number() over (order by priority, due_at, repo_id) as int)) as worker from q where status = 'queued' and due_at <= timestamp '1996-01-01' order by priority, due_at, repo_id limit 5)
        select q.* replace (case when worker is null then status else 'collecting' end as status, coalesce(worker, locked_by) as locked_by, case when worker is null then locked_at else timestamp '1996-01-01' end as locked_at) from q left join c using (repo_id)""",
)
query("queue_realigned", lambda t: queue.realign(_queue(t), 14 * 86_400), f"{_QUEUE} select * replace (case when status = 'queued' and last_collected is not null then last_collected + interval 14 days else due_at end as due_at) from q")
query(
    "queue_recovered",
    lambda t: queue.recover_others(queue.recover_stale(_queue(t), 86_400, "1996-06-01 00:00:00"), "w1", "1996-06-01 00:00:00"),
    f"""{_QUEUE}, x as (select *, status = 'collecting' and locked_at < timestamp '1996-05-31' as stale, status = 'collecting' and locked_by <> 'w1' as other from q)
        select * exclude (stale, other) replace (case when stale or other then 'queued' else status end as status, case when stale or other then null else locked_by end as locked_by,
        case when stale or other then null else locked_at end as locked_at, case when other and not stale then timestamp '1996-06-01' else due_at end as due_at) from x""",
)
query(
    "queue_completed",
    lambda t: queue.complete(_queue(t), t.items.filter("id % 4 = 0").select(F.col("id").alias("repo_id"), (F.col("id") % 8 == 0).alias("ok"), F.concat(F.lit("error "), F.col("id").cast("string")).alias("error")), 3_600, "1999-01-01 00:00:00"),
    f"""{_QUEUE} select * replace (case when repo_id % 4 = 0 then 'queued' else status end as status, case when repo_id % 4 = 0 then 100 else priority end as priority, case when repo_id % 4 = 0 then timestamp '1999-01-01 01:00:00' else due_at end as due_at,
        case when repo_id % 4 = 0 then null else locked_by end as locked_by, case when repo_id % 4 = 0 then null else locked_at end as locked_at, case when repo_id % 4 = 0 then timestamp '1999-01-01' else last_collected end as last_collected,
        case when repo_id % 8 = 4 then 'error ' || repo_id end as last_error, force_full and repo_id % 8 <> 0 as force_full) from q""",
)

# Identities: every person is an account; two in a row share a login, some are known by identity or login.


def _people(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, none = F.col("cntrb_id"), F.lit(None).cast("string")
    login = F.concat(F.lit("s"), F.floor(k / 2).cast("string"))
    seen = t.contributors.select(k.alias("seq"), F.lit(1).alias("platform_id"), k.alias("user_id"), login.alias("login"), F.lit("").alias("name"), "email")
    people = t.contributors.filter(k % 6 == 0).select(F.concat(F.lit("c"), k.cast("string")).alias("cntrb_id"), login.alias("login"), none.alias("email"), F.col("login").alias("full_name"), F.when(k % 12 == 0, F.col("canonical")).alias("canonical"))
    known = t.contributors.filter(k % 5 == 0).select(F.lit(1).alias("platform_id"), k.alias("user_id"), F.concat(F.lit("i"), k.cast("string")).alias("cntrb_id"), login.alias("login"), none.alias("name"), "email")
    return seen, people, known


_PEOPLE = """with s as (select cntrb_id as user_id, 's' || cntrb_id // 2 as login, email from contributors where cntrb_id > 0),
    people as (select 'c' || cntrb_id as cntrb_id, 's' || cntrb_id // 2 as login, login as full_name, case when cntrb_id % 12 = 0 then canonical end as canonical from contributors where cntrb_id % 6 = 0),
    r as (select s.*, case when user_id % 5 = 0 then 'i' || user_id end as held, named, '01' || lpad(lower(to_hex(user_id)), 8, '0') || '-' as h from s left join (select login, min(cntrb_id) as named from people group by 1) using (login)),
    o as (select *, '01' || left(lpad(lower(to_hex(user_id)), 8, '0'), 6) || '-' || right(lpad(lower(to_hex(user_id)), 8, '0'), 2) || '00-0000-0000-000000000000' as own from r),
    m as (select login, min_by(own, user_id) as made from o where held is null and named is null group by 1),
    a as (select 1 as platform_id, user_id, coalesce(held, named, made) as cntrb_id, case when held is not null then 'identity' when named is not null then 'login' else 'new' end as how, login, email from o left join m using (login))"""
query("accounts_resolved", lambda t: identity.resolve_accounts(*_people(t)).accounts, f"{_PEOPLE} select platform_id, user_id, cntrb_id, how from a")
query(
    "contributors_merged",
    lambda t: identity.resolve_accounts(*_people(t)).contributors,
    f"""{_PEOPLE}, n as (select cntrb_id, min_by(login, user_id) as login, max_by(email, user_id) as email from a where how <> 'identity' group by 1)
        select cntrb_id, coalesce(p.login, n.login) as login, n.email, p.full_name, p.canonical from people p full join n using (cntrb_id)""",
)


def _addresses(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Addresses of authors, resolved by a part of the contributors and the aliases of others."""
    text = lambda c: F.concat(F.lit("c"), c.cast("string"))
    people = t.contributors.filter("cntrb_id % 4 = 0").select(text(F.col("cntrb_id")).alias("cntrb_id"), F.lit("").alias("login"), "email", F.lit("").alias("full_name"), F.when(F.col("cntrb_id") % 8 == 0, F.lit("")).otherwise(F.col("canonical")).alias("canonical"))
    aliases = t.contributors.filter("cntrb_id % 4 = 1").select(F.col("email").alias("alias_email"), text(F.col("cntrb_id") - 1).alias("cntrb_id"), F.lit("first").alias("canonical_email"))
    known = t.contributors.limit(0).select(F.lit(1).alias("platform_id"), F.col("cntrb_id").alias("user_id"), text(F.col("cntrb_id")).alias("cntrb_id"))
    return people, aliases, identity.resolve_addresses(t.commits.select(F.col("author_email").alias("email")), people, aliases, known)


_ADDRESSES = """with p as (select 'c' || cntrb_id as cntrb_id, email, case when cntrb_id % 8 <> 0 then canonical end as canonical from contributors where cntrb_id % 4 = 0),
    al as (select email as alias_email, 'c' || (cntrb_id - 1) as cntrb_id, 'first' as canonical_email from contributors where cntrb_id % 4 = 1),
    own as (select address, min(cntrb_id) as own from (select cntrb_id, email as address from p union all select cntrb_id, canonical from p) where address is not null group by 1),
    res as (select email, coalesce(own, a.cntrb_id) as cntrb_id from (select distinct author_email as email from commits) left join own on address = email left join al a on alias_email = email)"""
query(
    "aliases_added",
    lambda t: (lambda people, aliases, found: identity.add_aliases(aliases, found, people))(*_addresses(t)),
    f"""{_ADDRESSES} select * from al union all select res.email, res.cntrb_id, coalesce(canonical, res.email) from res left join p using (cntrb_id)
        where res.cntrb_id is not null and res.email is distinct from canonical and res.email not in (select alias_email from al)""",
)
query(
    "unresolved_addresses",
    lambda t: (lambda people, aliases, found: identity.add_unresolved(t.contributors.filter("cntrb_id % 4 = 3 and cntrb_id % 3 = 0").select("email"), found))(*_addresses(t)),
    f"{_ADDRESSES} select email from contributors where cntrb_id % 4 = 3 and cntrb_id % 3 = 0 union select email from res where cntrb_id is null",
)

# Manifests of all formats, in turn over the parts.
_LISTED = ", ".join(f"({k}, '{file}', '{m}', '{n}', '{v}', '{kind}')" for k, (file, _, rows, _) in enumerate(MANIFESTS) for m, n, v, kind in rows)
_NAMED = ", ".join(f"({k}, '{file}', '{'.NET' if file.endswith('.csproj') else manifests.ECOSYSTEM[file]}', '{n}')" for k, (file, _, rows, names) in enumerate(MANIFESTS) for n in (names or [r[1] for r in rows if r[3] not in ("peer", "optional")]))
query(
    "manifest_formats",
    lambda t: manifests.dependencies(t.manifests),
    f"select '/' || p_partkey || '/' || file as path, manager, replace(name, '{{n}}', cast(p_partkey as varchar)) as name, version, kind as type from part join (values {_LISTED}) m(k, file, manager, name, version, kind) on p_partkey % {len(MANIFESTS)} = k",
)
query(
    "manifest_names",
    lambda t: manifests.dependency_names(t.manifests),
    f"select '/' || p_partkey || '/' || file as path, ecosystem, replace(name, '{{n}}', cast(p_partkey as varchar)) as name from part join (values {_NAMED}) m(k, file, ecosystem, name) on p_partkey % {len(MANIFESTS)} = k",
)

# Two copies of the model with other local ids; cursors; a landscape tree.


def _copies(t: Tables) -> tuple[dict[str, DataFrame], dict[str, DataFrame], list[diff.Spec]]:
    """The second copy has its own ids, lacks some items, and has others in another state."""
    specs = [
        diff.Spec("messages", ["item_id", "platform_msg_id"], "msg_id", {"item_id": "items"}),
        diff.Spec("items", ["repo_id", "number"], "id", {"repo_id": "repos"}),
        diff.Spec("repos", ["repo_git"], "repo_id", ignore=("collected_at",)),
    ]
    items = t.items.select("id", "repo_id", F.col("id").alias("number"), "state")
    messages = t.messages.select("msg_id", "item_id", F.col("msg_id").alias("platform_msg_id"), "msg_text")
    repos = t.repos.select("repo_id", "repo_git", "repo_name", "collected_at")
    a = {"repos": repos, "items": items, "messages": messages}
    b = {
        "repos": repos.withColumn("repo_id", F.col("repo_id") + 500).withColumn("collected_at", F.lit(None).cast("timestamp_ntz")),
        "items": items.filter("id % 13 <> 0").select((F.col("id") * 2 + 1).alias("id"), (F.col("repo_id") + 500).alias("repo_id"), "number", F.when(F.col("id") % 17 == 0, "gone").otherwise(F.col("state")).alias("state")),
        "messages": messages.withColumn("item_id", F.col("item_id") * 2 + 1).withColumn("msg_id", -F.col("msg_id")),
    }
    return a, b, specs


query(
    "stable_diff",
    lambda t: diff.compare(*_copies(t)),
    """with k as (select items.id, repo_git || '|' || items.id as item from items join repos using (repo_id))
       select 'items' as table_name, item as key, case when id % 13 = 0 then 'missing' else 'content' end as status from k where id % 13 = 0 or id % 17 = 0
       union all select 'messages', item || '|' || msg_id, 'missing' from messages join k on k.id = item_id where item_id % 13 = 0
       union all select 'messages', '<missing:item_id=' || (item_id * 2 + 1) || '>|' || msg_id, 'extra' from messages join k on k.id = item_id where item_id % 13 = 0
       union all select 'messages', '<missing:item_id=' || item_id || '>|' || msg_id, 'missing' from messages where item_id not in (select id from k)
       union all select 'messages', '<missing:item_id=' || (item_id * 2 + 1) || '>|' || msg_id, 'extra' from messages where item_id not in (select id from k)""",
)
query("since_bounds", lambda t: cursors.since(_queue(t), 7 * 86_400, "1999-01-01 00:00:00"), f"{_QUEUE} select repo_id, case when last_collected is not null and not force_full then timestamp '1998-12-25' end as since from q")


def _appended(t: Tables) -> DataFrame:
    """Reads that overlap: half of the time, then all, then all again."""
    store, rows = Store(t.spark, scratch(t.spark, "activity"), buckets=8), t.item_events.select("event_id", "cntrb_id", "action", "created_at")
    for k, part in enumerate((rows.filter("created_at < timestamp_ntz'2024-01-15 00:00:00'"), rows, rows)):
        cursors.append_new(store, "activity", part, "event_id", "cntrb_id", "created_at", "activity", k)
    return store.table("activity").join(store.table("activity_marks").select("cntrb_id", F.col("created_at").alias("mark")), "cntrb_id")


query("activity_appended", _appended, "select event_id, cntrb_id, action, created_at, max(created_at) over (partition by cntrb_id) as mark from item_events")


def _landscape(t: Tables) -> DataFrame:
    """A landscape document for each group, its repositories as items."""
    k = F.col("repo_id")
    status = F.element_at(F.array(*map(F.lit, ("graduated", "archived", "sandbox", "incubating"))), (k % 4 + 1).cast("int"))
    item = F.struct(F.col("repo_name").alias("name"), status.alias("project"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("repo_git")).alias("repo_url"), F.when(k % 2 == 0, F.array(F.struct(F.concat("repo_git", F.lit("/")).alias("repo_url")))).alias("additional_repos"))
    docs = t.repos.groupBy("repo_group_id").agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct("items")).alias("subcategories"))).alias("landscape"))).alias("json"))
    return scans.landscape_projects(docs).select("status", "name", F.size("repos").cast("long").alias("n"))


query("landscape_projects", _landscape, "with x as (select repo_name as name, ['graduated', 'archived', 'sandbox', 'incubating'][repo_id % 4 + 1] as status, cast(case when repo_id % 3 <> 0 then 1 else 0 end + case when repo_id % 2 = 0 then 1 else 0 end as bigint) as n from repos) select status, name, n from x where status <> 'archived' and n > 0")

# Bills of materials: the parts of their documents.


def _spdx(t: Tables) -> DataFrame:
    repos = t.repos.withColumn("license", F.when(F.col("repo_id") % 2 == 0, "MIT"))
    scanned = t.repos.filter("repo_id % 3 = 0").select("repo_id", F.lit("Apache-2.0").alias("concluded"), F.array(F.lit("A"), F.lit("B")).alias("holders"))
    deps = t.deps.withColumn("purl", F.concat(F.lit("pkg:npm/"), F.col("dep_id").cast("string"))).withColumn("license", S.spdx(F.col("license")))
    return documents.spdx(repos, deps, scanned, "2024-01-01T00:00:00Z", "t-1", "https://example.org/spdx").drop("purl")


query(
    "spdx_parts",
    _spdx,
    f"""with d as (select repo_id, dep_id, name, 'SPDXRef-Package-' || left(sha256(name || '@' || current_version), 16) as ref, current_version, {_SPDX} as l from deps),
       r as (select *, case when repo_id % 2 = 0 then 'MIT' else 'NOASSERTION' end as declared from repos)
       select repo_id, 0 as section, null as name, null as dep_id, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"' || repo_name || '","documentNamespace":"https://example.org/spdx/' || repo_owner || '/' || repo_name || '/' ||
         sha256(repo_git || '/2024-01-01T00:00:00Z') || '","creationInfo":{{"created":"2024-01-01T00:00:00Z","creators":["Tool: t-1"]}},"packages":[{{"SPDXID":"SPDXRef-RootPackage","name":"' || repo_name || '","downloadLocation":"' || repo_git || '","licenseConcluded":"' ||
         case when repo_id % 3 = 0 then 'Apache-2.0' else declared end || '","licenseDeclared":"' || declared || '","copyrightText":"' || case when repo_id % 3 = 0 then 'A\\nB' else 'NOASSERTION' end || '"}}' as text from r
       union all select repo_id, 1, name, dep_id, ',{{"SPDXID":"' || ref || '","name":"' || name || '","versionInfo":"' || current_version || '","downloadLocation":"NOASSERTION","licenseConcluded":"NOASSERTION","licenseDeclared":"' || l ||
         '","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"pkg:npm/' || dep_id || '"}}]}}' from d
       union all select repo_id, 2, null, null, '],"relationships":[' from r
       union all select repo_id, 3, name, dep_id, '{{"spdxElementId":"SPDXRef-RootPackage","relationshipType":"DEPENDS_ON","relatedSpdxElement":"' || ref || '"}},' from d
       union all select repo_id, 4, null, null, '{{"spdxElementId":"SPDXRef-DOCUMENT","relationshipType":"DESCRIBES","relatedSpdxElement":"SPDXRef-RootPackage"}}]}}' from r""",
)


# Repositories and what hangs on them; contributors stand for many repositories where the groups' 25 are too few.
_NOW = "2024-06-01 00:00:00"
_DAY = lambda k: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=k.cast("int"))
_day = lambda k: f"timestamp '2024-01-01' + to_days(cast({k} as int))"


def _many_repos(t: Tables) -> DataFrame:
    k, none = F.col("cntrb_id"), F.lit(None)
    return t.contributors.select(
        k.alias("repo_id"), (k % 4).alias("repo_group_id"), F.concat(F.lit("https://forge.example.org/org/"), "login").alias("repo_git"), F.col("login").alias("repo_name"), F.lit("org").alias("repo_owner"),
        none.cast("string").alias("repo_description"), F.lit("C").alias("primary_language"), none.cast("string").alias("forked_from"), F.lit(False).alias("repo_archived"), _DAY(k % 50).alias("created_at"), _DAY(k % 50).alias("updated_at"),
    )


_MANY = f"""with m as (select cntrb_id as repo_id, cntrb_id % 4 as repo_group_id, 'https://forge.example.org/org/' || login as repo_git, login as repo_name, 'org' as repo_owner, 'C' as primary_language, {_day("cntrb_id % 50")} as updated_at from contributors)"""


def _repos_added(t: Tables) -> DataFrame:
    groups = catalog.add_groups(t.repo_groups.select("repo_group_id", "rg_name", F.lit("").alias("rg_type"), F.lit("").alias("rg_website"), F.lit("").alias("rg_description")), t.spark.createDataFrame([(catalog.DEFAULT_GROUP, "", "")], "rg_name string, rg_type string, rg_website string"))
    new = _many_repos(t).filter("repo_id % 3 = 0").withColumns({"repo_name": F.concat("repo_name", F.lit(".git")), "primary_language": F.lit("Go"), "updated_at": F.when(F.col("repo_id") % 5 > 0, _DAY(F.lit(100))), "seq": F.col("repo_id"), "repo_group_id": F.col("repo_id") % 2})
    out = catalog.add_repos(_many_repos(t).filter("repo_id % 2 = 0"), new.drop("repo_id"), groups)
    default = groups.filter(F.col("rg_name") == catalog.DEFAULT_GROUP).select(F.col("repo_group_id").alias("d"))
    return out.join(F.broadcast(default)).select("repo_git", F.when(F.col("repo_git").rlike("[02468]$"), F.col("repo_id")).alias("known_id"), F.when(F.col("repo_group_id") != F.col("d"), F.col("repo_group_id")).alias("repo_group_id"), "repo_name", "primary_language", "updated_at")


query(
    "repos_upserted",
    _repos_added,
    f"""{_MANY} select repo_git, case when repo_id % 2 = 0 then repo_id end as known_id, case when repo_id % 2 = 0 then repo_group_id else nullif(repo_id % 2, 0) end as repo_group_id, repo_name, case when repo_id % 3 = 0 then 'Go' else 'C' end as primary_language,
        case when repo_id % 3 = 0 and repo_id % 5 > 0 then {_day("100")} when repo_id % 2 = 0 then updated_at end as updated_at from m where repo_id % 2 = 0 or repo_id % 3 = 0""",
)
query(
    "repos_moved",
    lambda t: catalog.archive(catalog.move_repos(_many_repos(t), t.contributors.filter("cntrb_id % 3 = 0").select(F.col("cntrb_id").alias("repo_id"), F.concat(F.lit("https://new.example.org/a/b/"), "login", F.lit(".git/")).alias("url"))), t.contributors.filter("cntrb_id % 4 = 0").select(F.col("cntrb_id").alias("repo_id"))).select("repo_id", "repo_git", "repo_owner", "repo_name", "repo_archived"),
    f"{_MANY} select repo_id, case when repo_id % 3 = 0 then 'https://new.example.org/a/b/' || repo_name else repo_git end as repo_git, case when repo_id % 3 = 0 then 'a/b' else 'org' end as repo_owner, repo_name, repo_id % 4 = 0 as repo_archived from m",
)
query("legacy_repos", lambda t: catalog.legacy_repos(_many_repos(t).select("repo_id", F.when(F.col("repo_id") % 3 > 0, F.col("repo_git")).otherwise(F.nullif(F.lit(""), F.lit("x"))).alias("repo_git"), F.when(F.col("repo_id") % 2 > 0, F.col("repo_name")).alias("repo_name"))), f"{_MANY} select repo_id, repo_git, case when repo_id % 2 > 0 then repo_name else '' end as repo_name from m where repo_id % 3 > 0")


def _releases(t: Tables) -> DataFrame:
    """Half of the releases by one author, then all of them by another: known ones keep their author."""
    store, k = Store(t.spark, scratch(t.spark, "releases"), buckets=8), F.col("dep_id")
    for batch, rows in enumerate((t.deps.filter("dep_id % 2 = 0"), t.deps)):
        new = rows.select(
            "repo_id", k.alias("release_id"), F.concat(F.lit(f"r{batch}\x07-"), k.cast("string")).alias("release_name"), F.when(k % 3 > 0, F.col("name")).alias("release_description"), F.lit(f"author{batch}").alias("release_author"), F.concat(F.lit("v"), k.cast("string")).alias("release_tag_name"),
            F.lit(None).cast("string").alias("release_url"), F.col("collected_at").alias("created_at"), F.when(k % 7 > 0, F.col("collected_at")).alias("published_at"), _DAY(F.lit(batch)).alias("updated_at"), k.alias("seq"),
        )
        store.commit([catalog.releases(new)], "releases", batch)
    return catalog.release_list(store.table("releases"), t.repos)


query(
    "release_list",
    _releases,
    """select repo_id, dep_id as release_id, 'r1-' || dep_id as release_name, case when dep_id % 3 > 0 then name else '' end as release_description, case when dep_id % 2 = 0 then 'author0' else 'author1' end as release_author, 'v' || dep_id as release_tag_name, '' as release_url,
       deps.collected_at as created_at, case when dep_id % 7 > 0 then deps.collected_at end as published_at, repo_name from deps join repos using (repo_id)""",
)


def _sinks(t: Tables) -> DataFrame:
    """Clone counts and memberships written twice in one commit each, snapshots beside both."""
    store, k = Store(t.spark, scratch(t.spark, "sinks"), buckets=8), F.col("cntrb_id")
    for batch, rows in enumerate((t.contributors.filter("cntrb_id % 3 = 0"), t.contributors)):
        clones = rows.select("repo_id", _DAY(k).alias("clone_timestamp"), (k * (batch + 1)).alias("total_clones"), k.alias("unique_clones"), k.alias("seq"))
        members = rows.select(F.lit("cf").alias("foundation"), F.col("login").alias("project_name"), F.col("email").alias("repo_url"), F.lit(f"state{batch}").alias("status"), F.lit("h").alias("homepage_url"), k.alias("seq"))
        info = rows.select("repo_id", k.alias("info_id"), (k % 2 == 0).alias("wiki_enabled"))
        store.commit([catalog.clones(clones), catalog.memberships(members), catalog.repo_info(info)], "sinks", batch)
    c = store.table("repo_clones").select(F.lit("clones").alias("entity"), F.concat(F.col("repo_id").cast("string"), F.lit("/"), F.col("unique_clones").cast("string")).alias("key"), F.col("total_clones").cast("string").alias("value"))
    m = store.table("foundation_membership").select(F.lit("members").alias("entity"), F.concat("project_name", F.lit("/"), "repo_url").alias("key"), F.col("status").alias("value"))
    i = store.table("repo_info").groupBy("info_id").agg(F.max("wiki_enabled").alias("v"), F.count("*").cast("string").alias("n")).select(F.lit("info").alias("entity"), F.col("info_id").cast("string").alias("key"), F.concat("v", F.lit("/"), "n").alias("value"))
    return c.unionByName(m).unionByName(i)


query(
    "sinks_committed",
    _sinks,
    """select 'clones' as entity, repo_id || '/' || cntrb_id as key, cast(cntrb_id * 2 as varchar) as value from contributors union all select 'members', login || '/' || email, 'state1' from contributors
       union all select 'info', cast(cntrb_id as varchar), case when cntrb_id % 2 = 0 then 'true' else 'false' end || '/' || case when cntrb_id % 3 = 0 then 2 else 1 end from contributors""",
)


def _status(t: Tables) -> DataFrame:
    store, k = Store(t.spark, scratch(t.spark, "status"), buckets=8), F.col("repo_id")
    blank = {f"{p}_status": F.lit("") for p in catalog.PHASES} | {f"{p}_data_last_collected": F.lit(None).cast("timestamp_ntz") for p in catalog.PHASES} | {f"{p}_task_id": F.lit(None).cast("string") for p in catalog.PHASES}
    repos = _many_repos(t).select("repo_id")
    first = repos.filter("repo_id % 3 > 0").withColumns(blank | {"core_status": F.lit("Success"), "core_data_last_collected": _DAY(k % 50), "seq": k})
    then = repos.filter("repo_id % 2 = 0 and repo_id % 3 > 0").withColumns(blank | {"facade_status": F.lit("Error"), "core_status": F.when(k % 4 == 0, "Collecting").otherwise(""), "seq": k})
    for batch, rows in enumerate((first, then)):
        store.commit([catalog.status_changes(rows)], "status", batch)
    return catalog.collection_status(repos, store.table("collection_status")).select("repo_id", "core_status", "facade_status", "ml_status", "core_task_id", "core_data_last_collected")


query(
    "collection_status",
    _status,
    f"""{_MANY} select repo_id, case when repo_id % 3 = 0 then 'Pending' when repo_id % 4 = 0 then 'Collecting' else 'Success' end as core_status, case when repo_id % 3 > 0 and repo_id % 2 = 0 then 'Error' else 'Pending' end as facade_status, 'Pending' as ml_status,
        '' as core_task_id, case when repo_id % 3 > 0 then updated_at end as core_data_last_collected from m""",
)
query("scans_due", lambda t: catalog.scans_due(_many_repos(t), t.contributors.filter("cntrb_id % 3 > 0").select(F.col("cntrb_id").alias("repo_id"), _DAY(F.col("cntrb_id") % 150).alias("collected_at")), _NOW), f"{_MANY} select repo_id, case when repo_id % 3 > 0 then {_day('repo_id % 150')} end as last_run from m where repo_id % 3 = 0 or {_day('repo_id % 150')} < timestamp '2024-05-02'")


def _profiles(t: Tables) -> DataFrame:
    k, none = F.col("cntrb_id"), F.lit(None).cast("string")
    return t.contributors.select(k, "login", F.when(k % 3 == 0, F.lit("")).otherwise(F.col("company")).alias("company"), F.when(k % 2 == 0, none).otherwise(F.lit("here")).alias("location"), F.when(k % 5 > 0, F.col("canonical")).otherwise(F.lit("-")).alias("canonical"), F.when(k % 4 > 0, _DAY(k % 150)).alias("enriched_at"), _DAY(k % 9).alias("collected_at"))


_PROFILES = f"""with p as (select cntrb_id, login, case when cntrb_id % 3 > 0 then company else '' end as company, case when cntrb_id % 2 > 0 then 'here' end as location, case when cntrb_id % 5 > 0 then canonical else '-' end as canonical, case when cntrb_id % 4 > 0 then {_day('cntrb_id % 150')} end as enriched_at, {_day('cntrb_id % 9')} as collected_at, email from contributors)"""
_COLD = "(enriched_at is null or enriched_at < timestamp '2024-05-02')"
query("thin_profiles", lambda t: catalog.thin_profiles(_profiles(t), _NOW, 500), f"{_PROFILES} select login from p where company = '' and location is null and {_COLD} order by collected_at desc nulls last, login limit 500")
query("missing_canonical", lambda t: catalog.missing_canonical(_profiles(t), _NOW, 500), f"{_PROFILES} select cntrb_id, login from p where length(canonical) < 2 and {_COLD} order by login, cntrb_id limit 500")


def _enriched(t: Tables, canonical: bool) -> DataFrame:
    k = F.col("cntrb_id")
    asked = t.contributors.filter("cntrb_id % 6 = 0")
    found = asked.filter("cntrb_id % 4 = 0").select("login", F.lit("New").alias("company"), F.lit("").alias("location"), F.when(k % 8 == 0, F.lit("x@NoReply.example.com")).otherwise(F.col("email")).alias("email"))
    return catalog.enrich(_profiles(t), catalog.Answers(asked, found), _NOW, canonical).drop("collected_at")


query("profiles_enriched", lambda t: _enriched(t, False), f"{_PROFILES} select cntrb_id, login, case when cntrb_id % 12 = 0 then 'New' else company end as company, location, canonical, case when cntrb_id % 6 = 0 then timestamp '2024-06-01' else enriched_at end as enriched_at from p")
query("canonical_enriched", lambda t: _enriched(t, True), f"{_PROFILES} select cntrb_id, login, company, location, case when cntrb_id % 12 = 0 and cntrb_id % 8 > 0 then email else canonical end as canonical, case when cntrb_id % 6 = 0 then timestamp '2024-06-01' else enriched_at end as enriched_at from p")
query("queue_search", lambda t: catalog.search_queue(catalog.dequeue(_queue(t), t.items.filter("id % 5 = 0").select(F.col("id").alias("repo_id"))), t.items.select(F.col("id").alias("repo_id"), F.col("state").alias("repo_owner"), F.concat(F.lit("Repo"), F.col("id").cast("string")).alias("repo_name")), "PO1").select("repo_id", "status"), f"{_QUEUE} select repo_id, status from q where repo_id % 5 > 0 and repo_id::varchar like '1%'")
query("seen_companies", lambda t: catalog.seen_companies(t.commits, t.contributors.withColumn("email", F.upper("email"))), "select distinct author_email, company from commits join contributors on author_email = email where company <> 'None'")


def _pages(t: Tables) -> DataFrame:
    """Listing pages: for each day and repository its issues with their messages and its pull requests; a later page closes some."""
    talk = t.messages.groupBy(F.col("item_id").alias("id")).agg(F.collect_list(F.struct(F.col("msg_id").alias("databaseId"), F.col("msg_text").alias("body"))).alias("nodes"))
    i = t.items.join(talk, "id", "left")
    node = F.struct(F.col("id").alias("number"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.upper("state").alias("state"), F.col("merged_at").alias("mergedAt"), F.struct(F.col("author_id").alias("databaseId")).alias("author"), F.struct("nodes").alias("comments"))
    some = lambda kind: F.struct(F.filter(F.collect_list(F.when(kind, node)), lambda n: n.isNotNull()).alias("nodes"))
    page = F.to_json(F.struct(F.struct(some(F.col("is_issue")).alias("issues"), some(~F.col("is_issue")).alias("pullRequests")).alias("repository")))
    pages = i.groupBy("repo_id", F.to_date("created_at").alias("day")).agg(page.alias("payload")).withColumn("seq", F.lit(2))
    return pages.unionByName(pages.withColumns({"payload": F.regexp_replace("payload", '"(CLOSED|MERGED)"', '"OPEN"'), "seq": F.lit(1)}))


def _listing(t: Tables) -> DataFrame:
    path = scratch(t.spark, "listing")
    bundles.split_listing(_pages(t)).write.partitionBy("entity").parquet(path)
    rows = t.spark.read.parquet(path)
    out = [bundles.listed(rows, e).selectExpr("repo_id", "number", f"'{e}' as entity", f"{k} as key", f"{v} as value") for e, k, v in (("issues", "title", "state"), ("pull_requests", "title", "state"), ("issue_messages", "cast(msg_id as string)", "msg_text"))]
    return reduce(DataFrame.unionByName, out)


query(
    "listing_split",
    _listing,
    """select repo_id, id as number, case when is_issue then 'issues' else 'pull_requests' end as entity, 't' || id as key, state as value from items
       union all select repo_id, id, 'issue_messages', cast(msg_id as varchar), msg_text from issues join messages on item_id = id""",
)

# Logs and scanner reports, written from the tables and read back.


def _log(t: Tables, leading: bool) -> DataFrame:
    """A log folder per repository: each commit's header, then a line for each of its files; every seventh file is binary."""
    stat = F.when(F.col("filename") % 7 == 0, F.concat_ws("\t", F.lit("-"), F.lit("-"), F.col("filename").cast("string"))).otherwise(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("added", "removed", "filename"))))
    one = t.commits.groupBy("repo_id", "hash").agg(F.array_join(F.collect_list(stat), "\n").alias("stats"), F.min("author_email").alias("mail"), F.min("authored_at").alias("at"))
    parents = F.when(F.col("hash") % 4 > 0, F.concat_ws(" ", F.lit("p1"), F.when(F.col("hash") % 3 == 0, "p2"))).otherwise("")
    when = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    header = F.concat_ws("\x1e", F.col("hash").cast("string"), parents, F.lit("A"), "mail", when, F.lit("C"), F.lit("c@example.com"), when, F.lit("subject \x1e of its own"))
    text = F.concat(header, F.lit("\n\n"), "stats", F.lit("\n")) if leading else F.concat(header, F.lit("\x1d\n\n"), "stats")
    path = scratch(t.spark, "log")
    one.select(F.col("repo_id").alias("repo"), text.alias("value")).write.partitionBy("repo").option("lineSep", "\x1d" if leading else "\n").text(path)
    return scans.log_commits(scans.read_log(t.spark, f"{path}/*"), leading)


_repo_of = lambda df: df.withColumn("repo_id", F.regexp_extract("file", r"/repo=(\d+)/", 1).cast("long"))
_LOG = "select repo_id, cast(hash as varchar) as hash, case when hash % 4 = 0 then 0 when hash % 3 = 0 then 2 else 1 end as parents, min(author_email) as author_email, cast(min(authored_at) as date) as authored_on, 'subject \x1e of its own' as subject from commits group by repo_id, commits.hash"
for _name, _leading in (("log_commits", False), ("log_commits_leading", True)):
    query(_name, lambda t, leading=_leading: _repo_of(_log(t, leading)).select("repo_id", "hash", F.size("parents").alias("parents"), "author_email", "authored_on", "subject"), _LOG)
query("log_files", lambda t: _repo_of(scans.log_files(_log(t, True))).select("repo_id", "hash", "filename", "added", "removed"), "select repo_id, cast(hash as varchar) as hash, cast(filename as varchar) as filename, case when filename % 7 = 0 then 0 else added end as added, case when filename % 7 = 0 then 0 else removed end as removed from commits")


def _reports(rows: DataFrame, entry: Column, name: str, *keys: str) -> DataFrame:
    """repo_id, json: a report of the repository's rows, in parts as large as the keys say."""
    return rows.groupBy("repo_id", *keys).agg(F.collect_list(entry).alias("l")).select("repo_id", F.to_json(F.struct(F.col("l").alias(name))).alias("json"))


def _sizes(t: Tables) -> DataFrame:
    one = F.struct(F.col("file_path").alias("Location"), F.when(F.col("code_lines") % 20 > 0, F.col("language")).alias("Language"), (F.col("code_lines") + F.col("comment_lines") + F.col("blank_lines")).alias("Lines"), F.col("code_lines").alias("Code"), F.col("comment_lines").alias("Comment"), F.col("blank_lines").alias("Blank"), F.col("complexity").alias("Complexity"))
    files = t.labor.groupBy("repo_id", "language").agg(F.collect_list(one).alias("Files"))
    return scans.code_sizes(files.select("repo_id", F.to_json(F.array(F.struct(F.col("language").alias("Name"), "Files"))).alias("json")))


query("code_sizes", _sizes, "select repo_id, language, file_path, code_lines + comment_lines + blank_lines as lines, code_lines, comment_lines, blank_lines, complexity from labor")
_FOUND = ("MIT", "", " Apache-2.0 ", "GPL-3.0-only AND MIT")


def _scanned(t: Tables) -> DataFrame:
    k = F.col("dep_id")
    named = lambda what: F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.struct(F.concat(F.lit(what), (k % 5 + i).cast("string")).alias(what)))
    one = F.struct(F.concat(F.lit("src/"), k.cast("string")).alias("path"), F.when(k % 11 > 0, "file").otherwise("directory").alias("type"), F.element_at(F.array(*map(F.lit, _FOUND)), (k % 4 + 1).cast("int")).alias("detected_license_expression_spdx"), F.lit(50.0).alias("percentage_of_license_text"), F.when(k % 4 > 0, named("copyright")).alias("copyrights"), named("holder").alias("holders"))
    return scans.licence_scan(_reports(t.deps, one, "files", "manager"))


_SCANNED = f"""with f as (select repo_id, dep_id, 'src/' || dep_id as path, ['{"', '".join(_FOUND)}'][dep_id % 4 + 1] as l from deps where dep_id % 11 > 0), h as (select repo_id, path, 'holder' || (dep_id % 5 + i) as holder from f, unnest([1, 2, 3]) as u(i) where i <= dep_id % 3 + 1)"""
query("scan_file_list", lambda t: scans.scan_file_list(_scanned(t)), f"{_SCANNED} select repo_id, path, trim(l) as licence, case when dep_id % 4 = 0 then '' else 'copyright' || (dep_id % 5 + 1) || case when dep_id % 3 > 0 then ' (+' || (dep_id % 3) || ' more)' else '' end end as copyright from f")
query("source_licence_counts", lambda t: scans.source_licence_counts(_scanned(t)), f"{_SCANNED} select repo_id, trim(l) as licence, count(*) as n, trim(l) in ('MIT', 'Apache-2.0') as is_osi from f where l <> '' group by all")
query("copyright_holders", lambda t: scans.copyright_holders(_scanned(t)), f"{_SCANNED} select repo_id, holder, count(distinct path) as files from h group by all")
query("sbom_enrichment", lambda t: scans.sbom_enrichment(_scanned(t)).select("repo_id", "licence", F.array_join("holders", ",").alias("holders")), f"{_SCANNED}, a as (select repo_id, string_agg(v, ' AND ' order by v) as licence from (select distinct repo_id, trim(l) as v from f where l <> '') group by 1), b as (select repo_id, string_agg(holder, ',' order by holder) as holders from (select distinct repo_id, holder from h) group by 1) select * from a full join b using (repo_id)")
query(
    "scorecard_checks",
    lambda t: scans.scorecard_checks(_reports(t.repo_info, F.struct(F.concat(F.lit("check"), F.col("info_id").cast("string")).alias("name"), (F.col("stars") % 11 - 1).alias("score"), F.when(F.col("info_id") % 2 > 0, "why").alias("reason"), F.when(F.col("info_id") % 3 > 0, F.array(F.lit("d"))).alias("details")), "checks")),
    "select repo_id, 'check' || info_id as name, cast(stars % 11 - 1 as int) as score, case when info_id % 2 > 0 then 'why' end as reason, case when info_id % 3 > 0 then '[\"d\"]' else '[]' end as details from repo_info",
)


def _findings(t: Tables) -> DataFrame:
    """An answer for every second package, with one or two findings; every third has no vector."""
    k, name, purl = F.col("dep_id"), F.concat(F.lit("pkg"), F.col("dep_id").cast("string")), F.concat(F.lit("pkg:npm/"), F.col("dep_id").cast("string")).alias("purl")
    vector = F.element_at(F.array(*map(F.lit, VECTORS)), (k % len(VECTORS) + 1).cast("int"))
    events = F.array(F.struct(F.concat(F.lit("1."), k.cast("string")).alias("introduced"), F.lit(None).cast("string").alias("fixed")), F.struct(F.lit(None).cast("string").alias("introduced"), F.lit("9.9").alias("fixed")))
    other = F.struct(F.struct(F.lit("other").alias("name")).alias("package"), F.array(F.struct(F.array(F.struct(F.lit("0").alias("introduced"), F.lit("0").alias("fixed"))).alias("events"))).alias("ranges"))
    mine = F.struct(F.struct(name.alias("name")).alias("package"), F.array(F.struct(events.alias("events"))).alias("ranges"))
    one = F.struct(F.concat(F.lit("F-"), k.cast("string")).alias("id"), F.array(F.lit("X"), F.concat(F.lit("CVE-"), k.cast("string"))).alias("aliases"), F.when(k % 3 > 0, F.array(F.struct(F.lit("CVSS_V2").alias("type"), F.lit("no").alias("score")), F.struct(F.lit("CVSS_V3").alias("type"), vector.alias("score")))).alias("severity"), F.array(other, mine).alias("affected"))
    bare = F.struct(F.concat(F.lit("G-"), k.cast("string")).alias("id"), *(F.when(k < 0, one[c]).alias(c) for c in ("aliases", "severity", "affected")))
    answers = t.deps.filter("dep_id % 2 = 0").select(purl, F.to_json(F.struct(F.when(k % 4 == 0, F.array(one)).otherwise(F.array(one, bare)).alias("vulns"))).alias("json"))
    return scans.vulnerabilities(t.deps.select("repo_id", purl, name.alias("name")), answers)


query(
    "vulnerabilities_scanned",
    _findings,
    f"""with v as (select repo_id, dep_id, case when dep_id % 3 > 0 then ['{"', '".join(VECTORS)}'][dep_id % {len(VECTORS)} + 1] else '' end as vector from deps where dep_id % 2 = 0),
        s as (select *, case when vector = '' then 0.0 else [9.8, 7.5, 4.0, 6.5][dep_id % 4 + 1] end as score from v)
        select repo_id, 'pkg:npm/' || dep_id as purl, 'pkg' || dep_id as name, 'F-' || dep_id as finding, 'CVE-' || dep_id as cve, vector, cast(score as double) as score, case when score >= 9 then 'CRITICAL' when score >= 7 then 'HIGH' when score >= 4 then 'MEDIUM' else 'UNKNOWN' end as severity, '1.' || dep_id as introduced, '9.9' as fixed from s
        union all select repo_id, 'pkg:npm/' || dep_id, 'pkg' || dep_id, 'G-' || dep_id, '', '', 0, 'UNKNOWN', '', '' from s where dep_id % 4 > 0""",
)
query("foundation_projects", lambda t: scans.foundation_projects(t.repos.groupBy(F.when(F.col("repo_group_id") % 2 == 0, "graduated").otherwise("incubating").alias("status"), "repo_group_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.lower("repo_name"), F.struct(F.col("repo_name").alias("name"), F.col("repo_git").alias("homepage")))))).alias("json"))), "select lower(repo_name) as slug, repo_name as name, repo_git as homepage, case when repo_group_id % 2 = 0 then 'graduated' else 'incubating' end as status from repos")

# A registry with two versions of each package, years apart, and licences that only classifiers tell.
_MANAGED = ("npm", "pypi", "go", "cargo", "rubygems", "maven", "packagist", "hex", "nuget", "pub", "swiftpm", "hackage")


def _versions(t: Tables) -> DataFrame:
    k = F.col("dep_id")
    manager, name = F.element_at(F.array(*map(F.lit, _MANAGED)), (k % len(_MANAGED) + 1).cast("int")).alias("manager"), F.concat(F.lit("pkg"), k.cast("string")).alias("name")
    deps = t.deps.select("dep_id", manager, name, F.when(k % 3 == 0, F.lit("1")).when(k % 3 == 1, F.lit("1.0.0")).otherwise(F.lit("7.7")).alias("version"))
    row = lambda version, at, licence, latest: F.struct(F.lit(version).alias("version"), F.lit(at).alias("released_at"), licence.alias("licence"), F.lit(latest).alias("is_latest"))
    both = F.explode(F.array(row("1.0.0", "2020-01-01T00:00:00Z", F.when(k % 2 == 0, "ISC").otherwise(""), False), row("2.0.0", "2021-01-01T00:00:00Z", F.lit("UNKNOWN"), True)))
    tags = F.array(F.lit("Topic :: X"), F.lit("License :: OSI Approved :: Apache Software License"), F.lit("License :: OSI Approved :: MIT License"))
    registry = t.deps.select(manager, name, both.alias("r"), tags.alias("classifiers")).select("manager", "name", "r.*", "classifiers")
    return manifests.registry_join(deps, manifests.with_classifiers(registry)).select("dep_id", "manager", "latest_version", "current_released", "licence", F.round("libyear", 6).alias("libyear"))


query(
    "registry_versions",
    _versions,
    f"""with d as (select dep_id, ['{"', '".join(_MANAGED)}'][dep_id % {len(_MANAGED)} + 1] as manager from deps)
        select dep_id, manager, '2.0.0' as latest_version, case when dep_id % 3 < 2 then '2020-01-01T00:00:00Z' end as current_released, case when dep_id % 3 < 2 and dep_id % 2 = 0 then 'ISC' when manager = 'pypi' then 'Apache-2.0' else 'Unknown' end as licence,
        case when dep_id % 3 < 2 and manager <> 'maven' then round(366 / 365, 6) else 0.0 end as libyear from d""",
)
