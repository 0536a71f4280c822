"""Pull requests as nested bundles: one parse of each record, fanned out to the tables of its children.

A staged record holds up to some ten pull requests under aliases, each with all its children. It is parsed once and
every child becomes a row of one tagged frame; each child table is a projection of the rows of its tag. Children are
named by natural keys (repository, number, and what tells them apart there), so they need no ids of their own and a
message and its bridge row to the request are merged in the same commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_json_nul
from ..operators.merge import dedupe
from ..operators.store import Merge

_USER = "struct<databaseId: long, login: string>"
_REPO = "struct<databaseId: long, nameWithOwner: string>"


def _nodes(fields: str) -> str:
    return f"struct<nodes: array<struct<{fields}>>>"


BUNDLE = f"""struct<number: long, state: string, title: string, createdAt: timestamp, closedAt: timestamp, mergedAt: timestamp,
    author: {_USER}, mergeCommit: struct<oid: string>, headRefName: string, headRefOid: string, baseRefName: string, baseRefOid: string,
    headRepository: {_REPO}, baseRepository: {_REPO}, labels: {_nodes("id: string, name: string, color: string")}, assignees: {_nodes("databaseId: long, login: string")},
    reviewRequests: {_nodes(f"requestedReviewer: {_USER}")}, reviews: {_nodes(f"databaseId: long, state: string, body: string, submittedAt: timestamp, author: {_USER}, `commit`: struct<oid: string>")},
    commits: {_nodes(f"`commit`: struct<oid: string, message: string, committedDate: timestamp, author: struct<email: string, name: string, user: {_USER}>>")},
    files: {_nodes("path: string, additions: long, deletions: long")}, comments: {_nodes(f"databaseId: long, body: string, createdAt: timestamp, author: {_USER}")}>""".replace("\n", " ")

#: Slots of the tagged rows and their types.
SLOTS = {"key": "string", "id": "long", "user_id": "long", "login": "string", "name": "string", "text": "string", "sha": "string", "at": "timestamp", "closed_at": "timestamp", "merged_at": "timestamp", "added": "long", "removed": "long"}
#: Tables: names of the slots that each uses, the key beside repository and number first.
CHILDREN = {
    "pull_requests": {"text": "title", "name": "state", "user_id": "author_id", "login": "author", "sha": "merge_sha", "at": "created_at", "closed_at": "closed_at", "merged_at": "merged_at"},
    "pr_labels": {"key": "node_id", "name": "label", "text": "color"},
    "pr_assignees": {"id": "user_id", "login": "login"},
    "pr_reviewers": {"id": "user_id", "login": "login"},
    "pr_reviews": {"id": "review_id", "name": "state", "text": "body", "user_id": "author_id", "login": "author", "sha": "sha", "at": "submitted_at"},
    "pr_commits": {"key": "sha", "text": "message", "name": "author_email", "user_id": "author_id", "login": "author", "at": "committed_at"},
    "pr_files": {"key": "path", "added": "added", "removed": "removed"},
    "pr_meta": {"key": "head_or_base", "name": "ref", "sha": "meta_sha"},
    "pr_repos": {"key": "head_or_base", "id": "fork_id", "name": "full_name"},
    "messages": {"id": "msg_id", "text": "msg_text", "user_id": "author_id", "login": "author", "at": "msg_timestamp"},
    "pr_message_refs": {"id": "msg_id"},
}
#: Slots that tell the children of one request apart; a message has its number's only in the bridge.
KEYS = {"pull_requests": [], "pr_labels": ["key"], "pr_commits": ["key"], "pr_files": ["key"], "pr_meta": ["key"], "pr_repos": ["key"]}


def pr_state(state: Column, merged_at: Column) -> Column:
    """``merged`` where there is a time of merging, else the state in small letters."""
    return F.when(merged_at.isNotNull(), "merged").otherwise(F.lower(state))


def _row(entity: str, **slots: Column) -> Column:
    return F.struct(F.lit(entity).alias("entity"), *(slots.get(s, F.lit(None)).cast(t).alias(s) for s, t in SLOTS.items()))


def parse(staged: DataFrame) -> DataFrame:
    """seq, repo_id, r (a pull request): one row for each alias of the staged records that is not null and has a number."""
    payload = F.from_json(strip_json_nul(F.col("payload")), f"struct<repository: map<string, {BUNDLE}>>", {"mode": "PERMISSIVE"})
    rows = staged.select("seq", "repo_id", F.explode(F.map_values(payload["repository"])).alias("r"))
    return rows.filter("repo_id is not null and r.number is not null")


def fan_out(staged: DataFrame) -> DataFrame:
    """seq, repo_id, number, entity and slots: the requests and all their children, from one parse."""
    r = lambda path: F.col(f"r.{path}")

    def each(path: str, make) -> Column:
        none = F.array().cast(f"array<struct<entity: string, {', '.join(f'{s}: {t}' for s, t in SLOTS.items())}>>")
        return F.coalesce(F.transform(F.filter(r(f"{path}.nodes"), lambda n: n.isNotNull()), make), none)

    one = lambda row, wanted: F.when(wanted, F.array(row))
    filled = lambda *c: F.greatest(*(F.length(F.coalesce(r(x), F.lit(""))) for x in c), F.lit(0)) > 0
    person = lambda u: {"user_id": u["databaseId"], "login": u["login"]}
    parts = [
        F.array(_row("pull_requests", text=r("title"), name=pr_state(r("state"), r("mergedAt")), **person(r("author")), sha=r("mergeCommit.oid"), at=r("createdAt"), closed_at=r("closedAt"), merged_at=r("mergedAt"))),
        each("labels", lambda n: _row("pr_labels", key=n["id"], name=n["name"], text=n["color"])),
        each("assignees", lambda n: _row("pr_assignees", id=n["databaseId"], login=n["login"])),
        each("reviewRequests", lambda n: _row("pr_reviewers", id=n["requestedReviewer"]["databaseId"], login=n["requestedReviewer"]["login"])),
        each("reviews", lambda n: _row("pr_reviews", id=n["databaseId"], name=n["state"], text=n["body"], sha=n["commit"]["oid"], at=n["submittedAt"], **person(n["author"]))),
        each("commits", lambda n: _row("pr_commits", key=n["commit"]["oid"], text=n["commit"]["message"], name=n["commit"]["author"]["email"], at=n["commit"]["committedDate"], **person(n["commit"]["author"]["user"]))),
        each("files", lambda n: _row("pr_files", key=n["path"], added=n["additions"], removed=n["deletions"])),
        *(one(_row("pr_meta", key=F.lit(s), name=r(f"{s}RefName"), sha=r(f"{s}RefOid")), filled(f"{s}RefName", f"{s}RefOid")) for s in ("head", "base")),
        *(one(_row("pr_repos", key=F.lit(s), id=r(f"{s}Repository.databaseId"), name=r(f"{s}Repository.nameWithOwner")), r(f"{s}Repository").isNotNull()) for s in ("head", "base")),
        each("comments", lambda n: _row("messages", id=n["databaseId"], text=n["body"], at=n["createdAt"], **person(n["author"]))),
        each("comments", lambda n: _row("pr_message_refs", id=n["databaseId"])),
    ]
    empty = F.array().cast(f"array<struct<entity: string, {', '.join(f'{s}: {t}' for s, t in SLOTS.items())}>>")
    rows = parse(staged).select("seq", "repo_id", F.col("r.number").alias("number"), F.explode(F.concat(*(F.coalesce(p, empty) for p in parts))).alias("c"))
    return rows.select("seq", "repo_id", "number", "c.*")


def keys_of(entity: str) -> list[str]:
    names = CHILDREN[entity]
    own = [names[k] for k in KEYS.get(entity, ["id"])]
    return ["repo_id", *own] if entity == "messages" else ["repo_id", "number", *own]


def child(rows: DataFrame, entity: str) -> DataFrame:
    """One table of the tagged rows: the newest row of each key; rows without a key are left out."""
    names, keys = CHILDREN[entity], keys_of(entity)
    first = ["seq", "repo_id"] if entity == "messages" else ["seq", "repo_id", "number"]
    out = rows.filter(F.col("entity") == entity).select(*first, *(F.col(s).alias(n) for s, n in names.items()))
    for k in keys:
        out = out.filter(F.col(k).isNotNull())
    return dedupe(out, keys, [F.desc("seq"), *(F.col(n) for n in out.columns if n not in (*keys, "seq"))]).drop("seq")


def changes(rows: DataFrame) -> list[Merge]:
    """The merges of all child tables, for one commit. rows: of ``fan_out``, written or kept, as each table reads them."""
    return [Merge(entity, child(rows, entity), keys_of(entity), scope=rows.filter(F.col("entity") == entity)) for entity in CHILDREN]


#: Tables of a listing: names of their slots.
LISTED = {
    "issues": {"text": "title", "name": "state", "user_id": "author_id", "login": "author", "at": "created_at", "updated_at": "updated_at", "closed_at": "closed_at"},
    "pull_requests": {"text": "title", "name": "state", "user_id": "author_id", "login": "author", "at": "created_at", "updated_at": "updated_at", "closed_at": "closed_at"},
    "issue_messages": {"id": "msg_id", "text": "msg_text", "user_id": "author_id", "login": "author", "at": "msg_timestamp"},
}
_LIST_SLOTS = {"id": "long", "text": "string", "name": "string", "user_id": "long", "login": "string", "at": "timestamp", "updated_at": "timestamp", "closed_at": "timestamp"}


def split_listing(staged: DataFrame) -> DataFrame:
    """seq, repo_id, number, entity and slots: issues, their messages and pull requests of combined listing pages, from one parse.

    staged: seq, repo_id, payload. Nodes without a number and messages without an id are left out.
    """
    item = f"number: long, title: string, state: string, createdAt: timestamp, updatedAt: timestamp, closedAt: timestamp, mergedAt: timestamp, author: {_USER}"
    comments = _nodes(f"databaseId: long, body: string, createdAt: timestamp, author: {_USER}")
    schema = f"struct<repository: struct<issues: {_nodes(f'{item}, comments: {comments}')}, pullRequests: {_nodes(item)}>>"
    page = staged.select("seq", "repo_id", F.from_json(strip_json_nul(F.col("payload")), schema)["repository"].alias("r"))
    kind = f"struct<number: long, entity: string, {', '.join(f'{s}: {t}' for s, t in _LIST_SLOTS.items())}>"

    def row(entity: str, number: Column, **slots: Column) -> Column:
        return F.struct(number.alias("number"), F.lit(entity).alias("entity"), *(slots.get(s, F.lit(None)).cast(t).alias(s) for s, t in _LIST_SLOTS.items()))

    def items(entity: str, n: Column) -> Column:
        state = F.lower(n["state"]) if entity == "issues" else pr_state(n["state"], n["mergedAt"])
        return row(entity, n["number"], text=n["title"], name=state, user_id=n["author"]["databaseId"], login=n["author"]["login"], at=n["createdAt"], updated_at=n["updatedAt"], closed_at=n["closedAt"])

    def talk(n: Column) -> Column:
        said = F.filter(n["comments"]["nodes"], lambda c: c["databaseId"].isNotNull())
        return F.transform(said, lambda c: row("issue_messages", n["number"], id=c["databaseId"], text=c["body"], user_id=c["author"]["databaseId"], login=c["author"]["login"], at=c["createdAt"]))

    none = F.array().cast(f"array<{kind}>")
    nodes = lambda path: F.filter(F.col(f"r.{path}.nodes"), lambda n: n["number"].isNotNull())
    parts = (F.transform(nodes("issues"), lambda n: items("issues", n)), F.flatten(F.transform(nodes("issues"), lambda n: F.coalesce(talk(n), none))), F.transform(nodes("pullRequests"), lambda n: items("pull_requests", n)))
    return page.select("seq", "repo_id", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("c")).select("seq", "repo_id", "c.*")


def listed(rows: DataFrame, entity: str) -> DataFrame:
    """One table of a split listing: the newest row of each number, or of each message."""
    key = ["repo_id", "id"] if entity == "issue_messages" else ["repo_id", "number"]
    out = dedupe(rows.filter(F.col("entity") == entity), key, [F.desc("seq"), *map(F.col, _LIST_SLOTS)])
    return out.select("repo_id", "number", *(F.col(s).alias(n) for s, n in LISTED[entity].items()))
