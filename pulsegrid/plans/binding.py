"""Logical tables of the data model, bound to the star-schema test tables.

Each property returns a lazily planned DataFrame; ``CTES`` binds the same tables for DuckDB. Operators take
logical tables, so a real deployment only replaces this module. Timestamps stay without time zone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parts import dealt

#: Rows of the given tables for one task, more or less.
TASK_ROWS = 250_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._rows: dict[str, int] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Tasks for rows made from those of a given table; their number stands in the files' footers."""
        if name not in self._rows:
            self._rows[name] = self.raw(name).count()
        return -(-self._rows[name] // TASK_ROWS)

    @cached_property
    def repo_groups(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("repo_group_id"), F.col("r_name").alias("rg_name"))

    @cached_property
    def repos(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        git = F.concat(F.lit("https://forge.example.org/"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")), F.lit("/"), F.lower("n_name"), F.lit(".git"))
        # 25 rows by contract of the binding: the dimension is broadcast by its statistics, not by a hint.
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
            F.col("n_nationkey").cast("long").alias("repo_id"), F.col("n_regionkey").cast("long").alias("repo_group_id"), F.col("n_name").alias("repo_name"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")).alias("repo_owner"), git.alias("repo_git"),
            (F.lit("2023-06-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("n_nationkey") * 15)).alias("collected_at"),
        )

    @cached_property
    def contributors(self) -> DataFrame:
        c = self.raw("customer")
        email = lambda k: F.concat(F.lit("dev"), k.cast("string"), F.lit("@org"), (k % 7).cast("string"), F.lit(".example.com"))
        return c.select(
            F.col("c_custkey").alias("cntrb_id"), F.col("c_name").alias("login"), F.col("c_mktsegment").alias("company"), F.col("c_nationkey").cast("long").alias("repo_id"),
            email(F.col("c_custkey")).alias("email"), F.when(F.col("c_custkey") % 5 == 0, email(F.col("c_custkey") - 1)).otherwise(email(F.col("c_custkey"))).alias("canonical"),
        )

    @cached_property
    def items(self) -> DataFrame:
        o, c = self.raw("orders"), self.raw("customer").select("c_custkey", "c_nationkey")
        end = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 120 + 1).cast("int"))
        return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
            F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("repo_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("merged").alias("state"),
            F.when(F.col("o_orderstatus") != "O", end).alias("closed_at"), F.when(F.col("o_orderstatus") == "P", end).alias("merged_at"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_issue"),
            (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 400).cast("int"))).alias("updated_at"),
        )

    @cached_property
    def issues(self) -> DataFrame:
        return self.items.filter("is_issue").drop("is_issue", "merged_at")

    @cached_property
    def pull_requests(self) -> DataFrame:
        return self.items.filter("not is_issue").drop("is_issue")

    @cached_property
    def commits(self) -> DataFrame:
        """One row per file per commit; surplus rows of a natural key are dropped (the least row stays). Dealt out by hash."""
        line = F.struct("l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
        one = dealt(self.raw("lineitem"), self.parts("lineitem"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.min(line).alias("r"))
        s = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("repo_id"))
        dev = F.col("r.l_suppkey")
        return one.join(s, F.col("r.l_suppkey") == s["s_suppkey"]).select(
            "repo_id", F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("filename"), dev.alias("author_id"),
            F.concat(F.lit("dev"), dev.cast("string"), F.lit("@org"), (dev % 7).cast("string"), F.lit(".example.com")).alias("author_email"),
            F.nullif(F.col("r.l_returnflag"), F.lit("N")).alias("affiliation"), F.col("r.l_shipdate").alias("authored_at"),
            F.col("r.l_quantity").cast("long").alias("added"), F.col("r.l_linenumber").cast("long").alias("removed"), (F.col("r.l_linenumber") % 3).cast("long").alias("whitespace"),
            F.concat(F.lit("push"), (dev % 20).cast("string"), F.lit("@example.com")).alias("committer_email"), F.to_date(F.col("r.l_shipdate") + F.make_dt_interval(days=F.col("r.l_linenumber") % 3)).alias("committer_date"),
        )

    @cached_property
    def pr_files(self) -> DataFrame:
        """id, path: the files of the commits that bear a pull request's id."""
        return self.pull_requests.select("id").join(self.commits.select(F.col("hash").alias("id"), F.col("filename").cast("string").alias("path")), "id")

    @cached_property
    def pr_reviews(self) -> DataFrame:
        """id, cntrb_id: who labelled the pull request."""
        return self.item_events.filter("action = 'labeled'").select(F.col("item_id").alias("id"), "cntrb_id")

    @cached_property
    def commit_comments(self) -> DataFrame:
        """hash, cntrb_id, created_at: system messages of an item are notes on the commit of that id."""
        return self.messages.filter("kind = 'system'").select(F.col("item_id").alias("hash"), "cntrb_id", F.col("msg_timestamp").alias("created_at"))

    @cached_property
    def vulnerabilities(self) -> DataFrame:
        vector = F.element_at(F.array(*map(F.lit, VECTORS)), (F.col("p_partkey") % len(VECTORS) + 1).cast("int"))
        return self.raw("part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_partkey").alias("finding_id"), vector.alias("vector"))

    @cached_property
    def item_events(self) -> DataFrame:
        """Events of items: the event's id names the item."""
        action = F.when(F.col("event_type") == "click", "assigned").when(F.col("event_type") == "view", "closed").when(F.col("event_type") == "signup", "merged")
        action = action.when(F.col("event_type") == "error", "unassigned").otherwise("labeled")
        return self.raw("events").select("event_id", (F.floor(F.col("event_id") / 2) + 1).alias("item_id"), F.col("user_id").alias("cntrb_id"), action.alias("action"), F.col("ts").alias("created_at"), "props")

    @cached_property
    def pr_events(self) -> DataFrame:
        """Events of pull requests with all actions that the response view counts."""
        action = F.element_at(F.array(*map(F.lit, PR_ACTIONS)), (F.col("event_id") % len(PR_ACTIONS) + 1).cast("int"))
        return self.item_events.select("event_id", "item_id", action.alias("action"), "created_at")

    @cached_property
    def pr_merges(self) -> DataFrame:
        """id, repo_id, merge_sha: the merge commit is one of the request's own commits, another one or unknown."""
        sha = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 4 == 0, F.col("id") + 1).otherwise(F.col("id") + 100)
        return self.pull_requests.select("id", "repo_id", sha.alias("merge_sha"))

    @cached_property
    def pr_commits(self) -> DataFrame:
        """id, sha: up to three commits of a request."""
        return self.pull_requests.select("id", F.explode(F.sequence(F.col("id"), F.col("id") + F.col("id") % 3)).alias("sha"))

    @cached_property
    def pr_meta(self) -> DataFrame:
        """id, head_or_base, meta_label, meta_sha: a head, and no, one or two bases."""
        head = F.struct(F.lit("head").alias("head_or_base"), F.lit("topic").alias("meta_label"), (F.col("id") + F.col("id") % 2).alias("meta_sha"))
        base = lambda label, off: F.struct(F.lit("base").alias("head_or_base"), F.lit(label).alias("meta_label"), (F.col("id") + off).alias("meta_sha"))
        rows = F.when(F.col("id") % 7 == 0, F.array(head)).when(F.col("id") % 11 == 0, F.array(head, base("main", 50), base("next", 2))).otherwise(F.array(head, base("main", 50)))
        return self.pull_requests.select("id", F.explode(rows).alias("m")).select("id", "m.*")

    @cached_property
    def pr_bundles(self) -> DataFrame:
        """seq, repo_id, entity_type, payload: each pull request with its children as one nested record."""
        by_id = lambda df: dealt(df, self.parts("lineitem"), "id")
        listed = lambda df, name, *fields: df.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias(name))
        files = listed(self.pr_files.distinct(), "files", "path", F.length("path").cast("long").alias("additions"))
        commits = listed(by_id(self.pr_commits), "commits", F.struct(F.col("sha").cast("string").alias("oid")).alias("commit"))
        reviews = listed(by_id(self.item_events.filter("action = 'labeled'").withColumnRenamed("item_id", "id")), "reviews", F.col("event_id").alias("databaseId"), F.struct(F.col("cntrb_id").alias("databaseId")).alias("author"))
        comments = listed(by_id(self.messages.withColumnRenamed("item_id", "id")), "comments", F.col("msg_id").alias("databaseId"), F.col("msg_text").alias("body"))
        p = by_id(self.pull_requests)
        for df in (files, commits, reviews, comments):
            p = p.join(df, "id", "left")
        nodes = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("nodes"))).alias(c)
        one = F.struct(F.col("id").alias("number"), F.upper(F.col("state")).alias("state"), F.col("merged_at").alias("mergedAt"), F.struct(F.col("author_id").alias("databaseId")).alias("author"), F.lit("topic").alias("headRefName"), *map(nodes, ("files", "commits", "reviews", "comments")))
        payload = F.to_json(F.struct(F.create_map(F.lit("pr0"), one).alias("repository")))
        return p.select(F.col("id").alias("seq"), "repo_id", F.lit("pull_request_bundle").alias("entity_type"), payload.alias("payload"))

    @cached_property
    def messages(self) -> DataFrame:
        hours = F.make_dt_interval(hours=(F.col("conv_id") * 7 + F.col("turn")).cast("int"))
        return self.raw("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("msg_id"), (F.col("conv_id") + 1).alias("item_id"), (F.col("conv_id") % 150 + 1).alias("cntrb_id"),
            (F.lit("1998-01-01").cast("timestamp_ntz") + hours).alias("msg_timestamp"), F.col("text").alias("msg_text"), F.col("role").alias("kind"),
        )

    @cached_property
    def deps(self) -> DataFrame:
        day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("p_partkey") % 365).cast("int"))
        licence = F.element_at(F.array(*map(F.lit, LICENCES)), (F.col("p_partkey") % len(LICENCES) + 1).cast("int"))
        return self.raw("part").select(
            (F.col("p_partkey") % 25).alias("repo_id"), F.col("p_partkey").alias("dep_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manager"), F.col("p_type").alias("kind"),
            licence.alias("license"), F.concat(F.lit("^"), (F.col("p_partkey") % 9).cast("string")).alias("requirement"), F.concat((F.col("p_partkey") % 9).cast("string"), F.lit(".0")).alias("current_version"), F.lit("9.0").alias("latest_version"), F.col("p_size").cast("double").alias("libyear"), day.alias("collected_at"), F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def manifests(self) -> DataFrame:
        """path, text: a manifest for each part, of the formats in turn, with the part's number in its names."""
        k = (F.col("p_partkey") % len(MANIFESTS) + 1).cast("int")
        pick = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in MANIFESTS)), k)
        text = F.replace(pick(1), F.lit("{n}"), F.col("p_partkey").cast("string"))
        return self.raw("part").select(F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"), pick(0)).alias("path"), text.alias("text"))

    @cached_property
    def repo_info(self) -> DataFrame:
        k = F.col("s_suppkey")
        day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 100).cast("int"))
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("long").alias("repo_id"), k.alias("info_id"), day.alias("collected_at"),
            (k * 7 % 1000).alias("stars"), (k * 3 % 500).alias("forks"), (k % 90).alias("watchers"), (k % 4 * 100).alias("commit_count"), (k % 40).alias("issues_count"), (k % 30).alias("pr_count"),
        )

    @cached_property
    def labor(self) -> DataFrame:
        minute = F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("p_partkey") % 8).cast("int"))
        return self.raw("part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_brand").alias("language"), F.col("p_name").alias("file_path"), (F.col("p_size") * 10).cast("long").alias("code_lines"), (F.col("p_size") % 7).cast("long").alias("complexity"), (F.col("p_size") % 5).cast("long").alias("blank_lines"), (F.col("p_size") % 11).cast("long").alias("comment_lines"), minute.alias("analysed_at"))


#: Manifests given to parts by the binding ({n}: the part's number): file, text, rows of the listing with versions (manager,
#: name, version, type), and its names where they are not those of the rows that are neither peers nor optional. Test data of our own.
MANIFESTS = (
    ("package.json", '{"dependencies": {"a{n}": "^1.2"}, "devDependencies": {"c": ">=3,<4"}, "peerDependencies": {"p": "1"}}', [("npm", "a{n}", "1.2", "runtime"), ("npm", "c", "3", "dev"), ("npm", "p", "1", "peer")], None),
    ("requirements.txt", "# note\nf{n}==2.3.0\nrequests[socks]>=2.28.0,<3 # why\npandas\n", [("pypi", "f{n}", "2.3.0", "runtime"), ("pypi", "requests", "2.28.0", "runtime"), ("pypi", "pandas", "", "runtime")], None),
    ("setup.py", "setup(name='x', install_requires=['a{n}>=1.0', \"b\"])", [("pypi", "a{n}", "1.0", "runtime"), ("pypi", "b", "", "runtime")], None),
    ("setup.cfg", "[options]\ninstall_requires =\n    a{n}>=1\n    b\nzip_safe = no\n", [("pypi", "a{n}", "1", "runtime"), ("pypi", "b", "", "runtime")], None),
    ("pyproject.toml", '[project]\ndependencies = [\n  "a{n}[x]>=1",\n]\n[tool.poetry.dependencies]\npython = "^3"\nc = "^2.1"\n', [("pypi", "a{n}", "1", "runtime"), ("pypi", "c", "2.1", "runtime")], None),
    ("Pipfile", '[packages]\na{n} = "*"\nb = {version = "==1.0"}\n[dev-packages]\nc = "*"\n', [("pypi", "a{n}", "", "runtime"), ("pypi", "b", "1.0", "runtime")], None),
    ("go.mod", "module m\n\nrequire x.org/one v1.2.3\n\nrequire (\n\tx.org/p{n} v5.9.1\n\t// note\n)\n", [("go", "x.org/one", "v1.2.3", "runtime"), ("go", "x.org/p{n}", "v5.9.1", "runtime")], ["x.org/p{n}"]),
    ("Cargo.toml", '[dependencies]\na{n} = "1.0"\n[dev-dependencies]\nd = "3"\n', [("cargo", "a{n}", "1.0", "runtime"), ("cargo", "d", "3", "dev")], ["a{n}"]),
    ("Gemfile", "source 'https://x'\ngem 'r{n}', '~> 7.0'\n", [("rubygems", "r{n}", "7.0", "runtime")], None),
    ("pom.xml", "<dependencies><dependency>\n<groupId>g</groupId>\n<artifactId>a{n}</artifactId>\n<version>1</version>\n</dependency></dependencies>", [("maven", "g:a{n}", "1", "runtime")], ["a{n}"]),
    ("build.gradle", "dependencies {\n  implementation 'g:a{n}:1.0'\n  testImplementation(\"h:b:2\")\n}\n", [("maven", "g:a{n}", "1.0", "runtime"), ("maven", "h:b", "2", "dev")], None),
    ("composer.json", '{"require": {"php": ">=8", "v/a{n}": "^1"}, "require-dev": {"v/b": "2"}}', [("packagist", "v/a{n}", "1", "runtime"), ("packagist", "v/b", "2", "dev")], None),
    ("build.sbt", 'libraryDependencies += "org" %% "n{n}" % "1.0"\n', [("maven", "org:n{n}", "1.0", "runtime")], None),
    ("packages.config", '<packages>\n<package id="A{n}" version="1" />\n<Package Id="B" Version="2" />\n</packages>', [("nuget", "A{n}", "1", "runtime"), ("nuget", "B", "2", "runtime")], ["A{n}"]),
    ("App.csproj", '<PackageReference Include="A{n}" Version="1" />\n', [("nuget", "A{n}", "1", "runtime")], None),
    ("Directory.Packages.props", '<PackageVersion Include="A{n}" Version="1" />\n', [("nuget", "A{n}", "1", "runtime")], None),
    ("package.yaml", "name: x\ndependencies:\n- b{n} >= 4.7 && < 5\nlibrary:\n  - no\n", [("hackage", "b{n}", "4.7", "runtime")], None),
    ("mix.exs", 'defp deps do\n [\n  {:p{n}, "~> 1.7.0"},\n  {:bare}\n ]\nend\n', [("hex", "p{n}", "1.7.0", "runtime")], ["p{n}", "bare"]),
    ("pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  h{n}: ^0.13.6\ndev_dependencies:\n  lints: '2.0'\n", [("pub", "h{n}", "0.13.6", "runtime"), ("pub", "lints", "2.0", "dev")], None),
    ("Package.swift", '.package(url: "https://h/o/A{n}.git", from: "5.6.0"),\n', [("swiftpm", "A{n}", "5.6.0", "runtime")], None),
    ("Makefile", "all:\n\tcc x{n}.c\n", [], None),
)

#: Raw licence strings given to dependencies by the binding (test data of our own).
LICENCES = ("MIT License", "Apache 2.0", "BSD", "GPLv3", "", "NOASSERTION", "ISC license", "Custom terms", " mit ", "MPL 2.0")

#: Vectors given to findings by the binding.
VECTORS = ("CVSS:3.1/AV:N/AC:L/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/C:L/I:H/A:N", "CVSS:3.1/AV:L/AC:H", "CVSS:3.1/AV:N/AC:H")

#: Actions given to events of pull requests by the binding.
PR_ACTIONS = ("assigned", "review_requested", "labeled", "unlabeled", "subscribed", "mentioned", "referenced", "closed", "head_ref_force_pushed", "head_ref_deleted", "milestoned", "merged", "renamed")

_END = "o_orderdate + to_days(cast(o_orderkey % 120 + 1 as int))"
CTES = f"""
with repo_groups as (select cast(r_regionkey as bigint) as repo_group_id, r_name as rg_name from region),
repos as (select cast(n_nationkey as bigint) as repo_id, cast(n_regionkey as bigint) as repo_group_id, n_name as repo_name, replace(lower(r_name), ' ', '-') as repo_owner,
    'https://forge.example.org/' || replace(lower(r_name), ' ', '-') || '/' || lower(n_name) || '.git' as repo_git, timestamp '2023-06-01' + to_days(cast(n_nationkey * 15 as int)) as collected_at from nation join region on n_regionkey = r_regionkey),
contributors as (select c_custkey as cntrb_id, c_name as login, c_mktsegment as company, cast(c_nationkey as bigint) as repo_id,
    'dev' || c_custkey || '@org' || (c_custkey % 7) || '.example.com' as email,
    case when c_custkey % 5 = 0 then 'dev' || (c_custkey - 1) || '@org' || ((c_custkey - 1) % 7) || '.example.com' else 'dev' || c_custkey || '@org' || (c_custkey % 7) || '.example.com' end as canonical from customer),
items as (select o_orderkey as id, cast(c_nationkey as bigint) as repo_id, o_custkey as author_id, o_orderdate as created_at,
    case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'merged' end as state,
    case when o_orderstatus <> 'O' then {_END} end as closed_at, case when o_orderstatus = 'P' then {_END} end as merged_at,
    o_orderpriority in ('1-URGENT', '2-HIGH') as is_issue, o_orderdate + to_days(cast(o_orderkey % 400 as int)) as updated_at from orders join customer on o_custkey = c_custkey),
issues as (select * from items where is_issue), pull_requests as (select * from items where not is_issue),
commits as (select cast(s_nationkey as bigint) as repo_id, l_orderkey as hash, l_partkey as filename, l_suppkey as author_id,
    'dev' || l_suppkey || '@org' || (l_suppkey % 7) || '.example.com' as author_email, nullif(l_returnflag, 'N') as affiliation, l_shipdate as authored_at,
    cast(trunc(l_quantity) as bigint) as added, cast(l_linenumber as bigint) as removed, cast(l_linenumber % 3 as bigint) as whitespace,
    'push' || (l_suppkey % 20) || '@example.com' as committer_email, cast(l_shipdate + to_days(cast(l_linenumber % 3 as int)) as date) as committer_date from
    (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey, l_shipdate, l_quantity, l_returnflag) as k from lineitem)
    join supplier on l_suppkey = s_suppkey where k = 1),
item_events as (select event_id, cast(floor(event_id / 2) as bigint) + 1 as item_id, user_id as cntrb_id,
    case event_type when 'click' then 'assigned' when 'view' then 'closed' when 'signup' then 'merged' when 'error' then 'unassigned' else 'labeled' end as action, ts as created_at, props from events),
pr_files as (select p.id, cast(filename as varchar) as path from pull_requests p join commits c on c.hash = p.id),
pr_reviews as (select item_id as id, cntrb_id from item_events where action = 'labeled'),
pr_events as (select event_id, item_id, ['{"', '".join(PR_ACTIONS)}'][event_id % {len(PR_ACTIONS)} + 1] as action, created_at from item_events),
pr_merges as (select id, repo_id, case when id % 5 = 0 then null when id % 4 = 0 then id + 1 else id + 100 end as merge_sha from pull_requests),
pr_commits as (select id, unnest(range(id, id + id % 3 + 1)) as sha from pull_requests),
pr_meta as (select id, 'head' as head_or_base, 'topic' as meta_label, id + id % 2 as meta_sha from pull_requests
    union all select id, 'base', 'main', id + 50 from pull_requests where id % 7 <> 0 union all select id, 'base', 'next', id + 2 from pull_requests where id % 7 <> 0 and id % 11 = 0),
messages as (select conv_id * 100 + turn as msg_id, conv_id + 1 as item_id, conv_id % 150 + 1 as cntrb_id,
    timestamp '1998-01-01' + to_hours(cast(conv_id * 7 + turn as int)) as msg_timestamp, text as msg_text, role as kind from conversations),
commit_comments as (select item_id as hash, cntrb_id, msg_timestamp as created_at from messages where kind = 'system'),
deps as (select p_partkey % 25 as repo_id, p_partkey as dep_id, p_name as name, p_brand as manager, p_type as kind,
    ['{"', '".join(LICENCES)}'][p_partkey % {len(LICENCES)} + 1] as license, '^' || (p_partkey % 9) as requirement, (p_partkey % 9) || '.0' as current_version, '9.0' as latest_version, cast(p_size as double) as libyear, timestamp '2024-01-01' + to_days(cast(p_partkey % 365 as int)) as collected_at, p_retailprice as price from part),
repo_info as (select cast(s_nationkey as bigint) as repo_id, s_suppkey as info_id, timestamp '2024-01-01' + to_days(cast(s_suppkey % 100 as int)) as collected_at,
    s_suppkey * 7 % 1000 as stars, s_suppkey * 3 % 500 as forks, s_suppkey % 90 as watchers, s_suppkey % 4 * 100 as commit_count, s_suppkey % 40 as issues_count, s_suppkey % 30 as pr_count from supplier),
labor as (select p_partkey % 25 as repo_id, p_brand as language, p_name as file_path, cast(p_size * 10 as bigint) as code_lines, cast(p_size % 7 as bigint) as complexity, cast(p_size % 5 as bigint) as blank_lines, cast(p_size % 11 as bigint) as comment_lines,
    timestamp '2024-02-01' + to_minutes(cast(p_partkey % 8 as int)) as analysed_at from part)
"""
