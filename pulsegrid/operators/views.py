"""Composite activity views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parts import dealt


def _branch(df: DataFrame, who: str, when: str, action: str | Column) -> DataFrame:
    a = F.lit(action) if isinstance(action, str) else action
    return df.select(F.col(who).alias("cntrb_id"), F.col(when).alias("created_at"), "repo_id", a.alias("action"))


def activity(t, attribute_to_commenter: bool = False) -> DataFrame:
    """The long-form activity stream: one row per commit, issue, pull request, event, review and comment, with the actor's login.

    Issue comments carry the reporter's id and the commenter's login unless ``attribute_to_commenter``; those on
    open issues are left out. Reviews are labelled events here.
    """
    c = t.commits.select("hash", "author_id", "repo_id", "authored_at").distinct()
    events = t.item_events.withColumnRenamed("created_at", "at").drop("props", "event_id")
    on_pr = events.join(t.pull_requests.select(F.col("id").alias("item_id"), "repo_id", "merged_at"), "item_id")
    on_issue = events.join(t.issues.select(F.col("id").alias("item_id"), "repo_id"), "item_id")
    branches = [
        _branch(c, "author_id", "authored_at", "commit"),
        _branch(t.issues, "author_id", "created_at", "issue_opened"),
        _branch(on_pr.filter("merged_at is null and action = 'closed'"), "cntrb_id", "at", "pull_request_closed"),
        _branch(on_pr.filter("action = 'merged'"), "cntrb_id", "at", "pull_request_merged"),
        _branch(on_issue.filter("action = 'closed'"), "cntrb_id", "at", "issue_closed"),
        _branch(on_pr.filter("action = 'labeled'"), "cntrb_id", "at", F.concat(F.lit("pull_request_review_"), F.col("action"))),
        _branch(t.pull_requests, "author_id", "created_at", "pull_request_open"),
        _branch(t.messages.join(t.pull_requests.select(F.col("id").alias("item_id"), "repo_id"), "item_id"), "cntrb_id", "msg_timestamp", "pull_request_comment"),
    ]
    rows = reduce(DataFrame.unionByName, branches).withColumn("actor", F.col("cntrb_id"))
    notes = t.messages.join(t.issues.select(F.col("id").alias("item_id"), "repo_id", "author_id", "closed_at"), "item_id").filter("closed_at <> msg_timestamp")
    notes = notes.select(F.col("cntrb_id" if attribute_to_commenter else "author_id").alias("cntrb_id"), F.col("msg_timestamp").alias("created_at"), "repo_id", F.lit("issue_comment").alias("action"), F.col("cntrb_id").alias("actor"))
    rows = rows.unionByName(notes)
    people = t.contributors.select(F.col("cntrb_id").alias("actor"), "login")
    return rows.join(people, "actor", "left").drop("actor")


def ranked(rows: DataFrame) -> DataFrame:
    """Newest first per contributor and repository, nulls first; ties by action and login."""
    w = Window.partitionBy("cntrb_id", "repo_id").orderBy(F.desc_nulls_first("created_at"), "action", "login")
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))


def contributor_actions(t, since: str | None = None) -> DataFrame:
    rows = activity(t)
    if since:  # filtered before ranking, below the unions
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return ranked(rows.join(t.repos.select("repo_id", "repo_name"), "repo_id"))


def canonical_people(contributors: DataFrame) -> DataFrame:
    """canonical, canonical_id: one person (the smallest id) per canonical address that is somebody's own."""
    return contributors.filter("canonical = email").groupBy("canonical").agg(F.min("cntrb_id").alias("canonical_id"))


def first_actions(t, keep: int = 7, parts: int | None = None) -> DataFrame:
    """Per contributor and repository the ``keep`` newest distinct actions of seven kinds.

    Issues and commits carry the canonical id of their author (commits count by address and day), closed issues, comments on
    commits, pull requests and their comments the id of who acted. Comments on issues are empty by definition (the
    view compares with a null), so that branch adds nothing and is left out.
    """
    people = t.contributors.select("cntrb_id", "login", "canonical").join(canonical_people(t.contributors), "canonical", "left")
    own = people.select(F.col("cntrb_id").alias("who"), "login", "canonical_id")

    def acts(df: DataFrame, who: str, when: str, action: str) -> DataFrame:
        return df.select(F.col(who).alias("who"), F.col(when).alias("created_at"), "repo_id", F.lit(action).alias("action"))

    # Dealt out twice: by who acted, where repeats go and names are found, and by the person and repository that are ranked.
    c = dealt(t.commits.select("repo_id", "author_email", F.date_trunc("day", "authored_at").cast("timestamp_ntz").alias("created_at")), parts, "author_email").distinct()
    c = c.join(people, c["author_email"] == people["canonical"], "left").select(F.col("canonical_id").alias("id"), "created_at", "repo_id", F.lit("commit").alias("action"), "login")
    pulls, issues = (x.select(F.col("id").alias("item_id"), "repo_id") for x in (t.pull_requests, t.issues))
    notes = t.commit_comments.join(t.commits.select("hash", "repo_id").distinct(), "hash")
    closed = t.item_events.filter("action = 'closed' and cntrb_id is not null").join(issues, "item_id")
    branches = [
        acts(t.issues, "author_id", "created_at", "issue_opened"), acts(notes, "cntrb_id", "created_at", "commit_comment"),
        acts(closed, "cntrb_id", "created_at", "issue_closed"), acts(t.pull_requests, "author_id", "created_at", "open_pull_request"),
        acts(t.messages.join(pulls, "item_id"), "cntrb_id", "msg_timestamp", "pull_request_comment"),
    ]
    rows = dealt(reduce(DataFrame.unionByName, branches), parts, "who").distinct().join(own, "who", "left")
    rows = rows.select(F.when(F.col("action") == "issue_opened", F.col("canonical_id")).otherwise(F.col("who")).alias("id"), "created_at", "repo_id", "action", "login")
    rows = dealt(rows.unionByName(c).filter("id is not null"), parts, "id", "repo_id").distinct()
    w = Window.partitionBy("id", "repo_id").orderBy(F.desc_nulls_first("created_at"), "action", "login")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).withColumn("rank", F.col("rank").cast("long"))


def assignments(items: DataFrame, events: DataFrame) -> DataFrame:
    """All items, with their assignment events if any."""
    e = events.filter(F.col("action").isin("assigned", "unassigned")).select(F.col("item_id").alias("id"), F.col("created_at").alias("assign_date"), F.col("action").alias("assignment_action"), F.col("cntrb_id").alias("assignee"))
    return items.select("id", "repo_id", F.col("created_at").alias("created"), F.col("closed_at").alias("closed")).join(e, "id", "left")


def pr_response(pulls: DataFrame, messages: DataFrame) -> DataFrame:
    """Pull requests with each distinct message time and author, or none. Review and direct messages union without repeats."""
    part = lambda kinds: messages.filter(F.col("kind").isin(*kinds)).select(F.col("item_id").alias("id"), "msg_timestamp", F.col("cntrb_id").alias("msg_cntrb_id"))
    said = part(("assistant", "system")).union(part(("user", "assistant"))).distinct()
    return pulls.select("id", "repo_id", F.col("author_id").alias("cntrb_id"), F.col("created_at").alias("pr_created_at"), F.col("closed_at").alias("pr_closed_at")).join(said, "id", "left")


ACTIONS = ("assigned", "unassigned", "labeled", "closed", "merged")
#: The actions that the view counts; the bound test tables have only those of ACTIONS.
VIEW_ACTIONS = ("assigned", "review_requested", "labeled", "unlabeled", "subscribed", "mentioned", "referenced", "closed", "head_ref_force_pushed", "head_ref_deleted", "milestoned", "merged")


def pr_rollups(pulls: DataFrame, pr_commits: DataFrame, pr_meta: DataFrame, commits: DataFrame) -> DataFrame:
    """id, commit_count, lines_added, lines_removed, file_count per pull request with a commit that counts.

    pulls: id, repo_id, merge_sha; pr_commits: id, sha; pr_meta: id, meta_sha; commits: a row per file. A commit counts
    once for each meta row with another hash, unless it is the merge commit, so lines multiply as in the view's
    definition; the product is a weight and not rows. Nulls compare as in SQL: without a merge commit there is no row.
    Labels are the business of ``pr_response_view``, which gives lines and files only where there is a base label.
    """
    metas = pr_meta.filter("meta_sha is not null")
    every = metas.groupBy("id").agg(F.count("*").alias("every"))
    same = metas.groupBy("id", F.col("meta_sha").alias("sha")).agg(F.count("*").alias("same"))
    c = pr_commits.groupBy("id", "sha").agg(F.count("*").alias("n")).join(pulls.select("id", "repo_id", "merge_sha"), "id").filter("sha <> merge_sha")
    c = c.join(every, "id").join(same, ["id", "sha"], "left").withColumn("by", F.col("n") * (F.col("every") - F.coalesce("same", F.lit(0)))).filter("by > 0")
    lines = c.join(commits.select("repo_id", F.col("hash").alias("sha"), "filename", "added", "removed"), ["repo_id", "sha"])
    lines = lines.groupBy("id").agg(F.sum(F.col("added") * F.col("by")).alias("lines_added"), F.sum(F.col("removed") * F.col("by")).alias("lines_removed"), F.count_distinct("filename").alias("file_count"))
    return c.groupBy("id").agg(F.count("*").alias("commit_count")).join(lines, "id", "left")


def pr_response_times(t, dedup_counts: bool = False, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """Response measures per pull request.

    Events join messages, so counts multiply by the messages of the pull request as in the view's definition; the
    product is computed from two aggregates instead of the joined rows. ``dedup_counts`` gives plain counts.
    Without an event or without a message all measures are null. ``actions=VIEW_ACTIONS`` gives the view's twelve
    counts; commits and lines are in ``pr_rollups``, labels and repeated units of time are left out.
    """
    e = t.item_events.groupBy("item_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in actions))
    m = t.messages.groupBy("item_id").agg(F.count("*").alias("n"), F.min("msg_timestamp").alias("first"), F.max("msg_timestamp").alias("last"), F.count_distinct("msg_timestamp").alias("comment_count"))
    by = 1 if dedup_counts else F.col("n")
    r = e.join(m, "item_id").select(F.col("item_id").alias("id"), "first", "last", "comment_count", *((F.col(a) * by).alias(f"{a}_count") for a in actions))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = lambda c: F.round((micros(c) - micros("created_at")) / 3_600e6, 4)
    out = t.pull_requests.join(t.repos.select("repo_id", "repo_name", "repo_group_id"), "repo_id").join(t.repo_groups, "repo_group_id").join(r, "id", "left")
    return out.select(
        "id", "repo_id", "repo_name", F.col("rg_name").alias("repo_group"), "state", F.year("created_at").cast("long").alias("created_year"), F.month("closed_at").cast("long").alias("closed_month"),
        hours("closed_at").alias("hours_to_close"), hours("first").alias("hours_to_first_response"), hours("last").alias("hours_to_last_response"),
        F.round((micros("last") - micros("first")) / 1e6 / F.col("comment_count"), 4).alias("seconds_between_responses"), "comment_count", *(f"{a}_count" for a in actions),
    )


def pr_response_view(pulls: DataFrame, repos: DataFrame, groups: DataFrame, events: DataFrame, messages: DataFrame, merges: DataFrame, pr_commits: DataFrame, pr_meta: DataFrame, commits: DataFrame) -> DataFrame:
    """The whole response view: twelve counts, response times, base labels, commit and line roll-ups.

    The view chains left joins over nullable aliases: labels hang on the commit counts and lines on the labels. So a
    request without a counted commit has no label, one without a label has no lines, and one with two base labels has two
    rows. Events and messages meet as weights, not as joined rows (see ``pr_response_times``), as do commits and meta rows.
    """
    e = events.groupBy("item_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in VIEW_ACTIONS))
    m = messages.groupBy("item_id").agg(F.count("*").alias("n"), F.min("msg_timestamp").alias("first_response_time"), F.max("msg_timestamp").alias("last_response_time"), F.count_distinct("msg_timestamp").alias("comment_count"))
    r = e.join(m, "item_id").select(F.col("item_id").alias("id"), "first_response_time", "last_response_time", "comment_count", *((F.col(a) * F.col("n")).alias(f"{a}_count") for a in VIEW_ACTIONS))
    counted = pr_rollups(merges, pr_commits, pr_meta, commits).withColumnRenamed("id", "counted_id")
    labels = pr_meta.filter("head_or_base = 'base'").select(F.col("id").alias("labelled_id"), "head_or_base", "meta_label").distinct()
    out = pulls.join(repos.select("repo_id", "repo_name", "repo_group_id"), "repo_id").join(groups, "repo_group_id").join(r, "id", "left")
    out = out.join(counted, F.col("id") == F.col("counted_id"), "left").join(labels, F.col("counted_id") == F.col("labelled_id"), "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    since = lambda c, unit: F.round((micros(c) - micros("created_at")) / unit, 4)
    units = {"hours": 3_600e6, "days": 86_400e6}
    spans = {"close": "closed_at", "first_response": "first_response_time", "last_response": "last_response_time"}
    part = lambda f, c: f(c).cast("long")
    lines = ("lines_added", "lines_removed", "file_count")
    return out.select(
        "repo_id", "id", "repo_name", F.col("rg_name").alias("repo_group"), "state", "merged_at", "created_at", "closed_at",
        part(F.year, "created_at").alias("created_year"), part(F.month, "created_at").alias("created_month"), part(F.year, "closed_at").alias("closed_year"), part(F.month, "closed_at").alias("closed_month"),
        "meta_label", "head_or_base", *(since(c, u).alias(f"{unit}_to_{name}") for name, c in spans.items() for unit, u in units.items()), "first_response_time", "last_response_time",
        F.round((micros("last_response_time") - micros("first_response_time")) / 1e6 / F.col("comment_count"), 4).alias("seconds_between_responses"), "comment_count", *(f"{a}_count" for a in VIEW_ACTIONS),
        "commit_count", *(F.when(F.col("labelled_id").isNotNull(), F.col(c)).alias(c) for c in lines),
    )


def language_breakdown(labor: DataFrame, minutes: int = 5) -> DataFrame:
    """Files and lines by language of each repository's latest scan, rows less than some minutes older included."""
    latest = labor.groupBy("repo_id").agg(F.max("analysed_at").alias("latest"))
    rows = labor.join(latest, "repo_id").filter(F.col("analysed_at") > F.col("latest") - F.make_dt_interval(mins=F.lit(minutes)))
    return rows.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("code_lines").alias("code_lines"), F.max("complexity").alias("complexity"))


def repo_files(labor: DataFrame) -> DataFrame:
    latest = labor.groupBy("repo_id").agg(F.max("analysed_at").alias("analysed_at"))
    return labor.join(latest, ["repo_id", "analysed_at"], "left_semi").select("repo_id", "file_path", "language", "code_lines")


def contributors_per_file(pulls: DataFrame, files: DataFrame, reviews: DataFrame, parts: int | None = None) -> DataFrame:
    """Authors and reviewers of the pull requests that touch each path. files: id, path; reviews: id, cntrb_id.

    Rows are dealt out by request, and by path, in ``parts`` tasks.
    """
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    touched = files.distinct().join(pulls.select("id", "repo_id", F.col("author_id").cast("string").alias("author")), "id")
    said = touched.join(dealt(reviews.select("id", F.col("cntrb_id").cast("string").alias("reviewer")), parts, "id").distinct(), "id", "left")
    people = dealt(said.select("repo_id", F.coalesce("path", F.lit("")).alias("file_path"), "author", "reviewer"), parts, "repo_id", "file_path").distinct()
    return people.groupBy("repo_id", "file_path").agg(joined("author").alias("cntrb_ids"), joined("reviewer").alias("reviewer_ids"))
