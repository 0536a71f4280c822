"""Version-control logs and scanner reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Separators of fields and of commit headers in the log format.
FIELD, COMMIT = "\x1e", "\x1d"


def date_prefix(raw: Column) -> Column:
    """The date in the first ten characters; null if there is none."""
    return F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def rfc3339(raw: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss Z")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """file, k, value: the pieces between separators, one or more log files per repository."""
    return spark.read.option("lineSep", COMMIT).text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("k"), "value")


def log_commits(pieces: DataFrame, leading: bool = False) -> DataFrame:
    """file, hash, parents, author and committer (name, email, date), subject, stats (the lines that follow the header).

    With the separator after each header, a piece ends with a commit's header and the next one begins with that commit's lines;
    a window over each file brings them together, so a file is one task's work. With ``leading``, the separator stands before each
    header, a piece is a whole commit, and files of any length are read in parallel: ask for logs of this form where they
    are large. Headers of fewer than nine fields are dropped; a separator in the subject stays in it.
    """
    if leading:
        rows = pieces.select("file", F.trim(F.regexp_extract("value", r"\A\n*([^\n]*)", 1)).alias("header"), F.regexp_replace("value", r"\A\n*[^\n]*", "").alias("stats"))
    else:
        header, rest = F.trim(F.regexp_extract("value", r"([^\n]*)\z", 1)), F.regexp_replace("value", r"[^\n]*\z", "")
        rows = pieces.select("file", "k", header.alias("header"), rest.alias("before")).withColumn("stats", F.lead("before").over(Window.partitionBy("file").orderBy("k")))
    rows = rows.withColumn("f", F.split("header", FIELD, 9)).filter(F.size("f") == 9)
    names = ("hash", None, "author_name", "author_email", "author_date", "committer_name", "committer_email", "committer_date", "subject")
    parents = F.filter(F.split(F.col("f")[1], r"\s+"), lambda p: p != "")
    return rows.select("file", *(F.col("f")[i].alias(n) for i, n in enumerate(names) if n), parents.alias("parents"), "stats", date_prefix(F.col("f")[4]).alias("authored_on"), rfc3339(F.col("f")[4]).alias("authored_at"))


def log_files(commits: DataFrame) -> DataFrame:
    """file, hash, added, removed, filename: binary files count 0; other lines are left out."""
    rows = commits.select("file", "hash", F.explode(F.split("stats", "\n")).alias("line"))
    rows = rows.select("file", "hash", F.split("line", "\t", 3).alias("p")).filter(F.size("p") == 3)
    return rows.select("file", "hash", *(F.coalesce(F.col("p")[i].try_cast("int"), F.lit(0)).alias(n) for i, n in ((0, "added"), (1, "removed"))), F.col("p")[2].alias("filename"))


def code_sizes(reports: DataFrame) -> DataFrame:
    """repo_id, language, file_path, total, code, comment and blank lines, complexity. reports: repo_id, json."""
    schema = "array<struct<Name:string, Files:array<struct<Location:string, Language:string, Lines:long, Code:long, Comment:long, Blank:long, Complexity:long>>>>"
    rows = reports.select("repo_id", F.explode(F.from_json("json", schema)).alias("l")).select("repo_id", "l.Name", F.explode("l.Files").alias("f"))
    return rows.select("repo_id", F.coalesce("f.Language", "Name").alias("language"), F.col("f.Location").alias("file_path"), F.col("f.Lines").alias("lines"), F.col("f.Code").alias("code_lines"), F.col("f.Comment").alias("comment_lines"), F.col("f.Blank").alias("blank_lines"), F.col("f.Complexity").alias("complexity"))


def licence_scan(reports: DataFrame) -> DataFrame:
    """repo_id, path, licence, percentage, copyrights (JSON), holders (JSON) of the scanned files. reports: repo_id, json."""
    one = "struct<copyright:string>", "struct<holder:string>"
    schema = f"files array<struct<path:string, type:string, detected_license_expression_spdx:string, percentage_of_license_text:double, copyrights:array<{one[0]}>, holders:array<{one[1]}>>>"
    rows = reports.select("repo_id", F.explode(F.from_json("json", schema)["files"]).alias("f")).filter("f.type = 'file'")
    values = lambda c, k: F.to_json(F.transform(F.coalesce(F.col(c), F.expr(f"cast(array() as array<struct<{k}:string>>)")), lambda x: F.struct(x[k].alias("value"))))
    return rows.select("repo_id", "f.path", F.col("f.detected_license_expression_spdx").alias("licence"), F.col("f.percentage_of_license_text").alias("percentage"), values("f.copyrights", "copyright").alias("copyrights"), values("f.holders", "holder").alias("holders"))


def scan_file_list(scanned: DataFrame) -> DataFrame:
    """repo_id, path, licence (empty if none), copyright (the first, with how many more)."""
    return scanned.select("repo_id", "path", F.coalesce(F.nullif(F.trim("licence"), F.lit("")), F.lit("")).alias("licence"), S.first_copyright(F.col("copyrights")).alias("copyright"))


def source_licence_counts(scanned: DataFrame) -> DataFrame:
    """repo_id, licence, n, is_osi of the files that have a licence."""
    from ..operators.reports import licence_counts

    return licence_counts(scanned.filter("trim(coalesce(licence, '')) <> ''"), "licence", "repo_id")


def copyright_holders(scanned: DataFrame) -> DataFrame:
    """repo_id, holder, files: in how many files a holder is named."""
    rows = scanned.select("repo_id", "path", F.explode(F.from_json("holders", "array<struct<value:string>>")["value"]).alias("holder")).filter("trim(holder) <> ''")
    return rows.distinct().groupBy("repo_id", "holder").agg(F.count("*").alias("files"))


def sbom_enrichment(scanned: DataFrame) -> DataFrame:
    """repo_id, licence (all distinct ones joined with AND), holders (distinct, sorted): one row per repository, as long as its lists."""
    licences = scanned.filter("trim(coalesce(licence, '')) <> ''").select("repo_id", F.trim("licence").alias("v")).distinct().groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("v")), " AND ").alias("licence"))
    holders = copyright_holders(scanned).groupBy("repo_id").agg(F.array_sort(F.collect_list("holder")).alias("holders"))
    return licences.join(holders, "repo_id", "full")


def scorecard_checks(reports: DataFrame) -> DataFrame:
    """repo_id, name, score, reason, details (JSON). reports: repo_id, json."""
    schema = "checks array<struct<name:string, score:int, reason:string, details:array<string>>>"
    rows = reports.select("repo_id", F.explode(F.from_json("json", schema)["checks"]).alias("c"))
    return rows.select("repo_id", "c.name", "c.score", "c.reason", F.to_json(F.coalesce("c.details", F.expr("cast(array() as array<string>)"))).alias("details"))


def vulnerabilities(purls: DataFrame, answers: DataFrame) -> DataFrame:
    """repo_id, purl, name, finding, cve, vector, score, severity, introduced, fixed. purls: repo_id, purl, name; answers: purl, json."""
    event = "array<struct<introduced:string, fixed:string>>"
    schema = f"vulns array<struct<id:string, aliases:array<string>, severity:array<struct<type:string, score:string>>, affected:array<struct<package:struct<name:string>, ranges:array<struct<events:{event}>>>>>>"
    found = answers.select("purl", F.explode(F.from_json("json", schema)["vulns"]).alias("v")).join(purls.distinct(), "purl")
    vector = S.pick_vector(F.col("v.severity"))
    score = F.when(F.coalesce(vector, F.lit("")) == "", 0.0).otherwise(S.cvss_score(vector))
    return found.select(
        "repo_id", "purl", "name", F.col("v.id").alias("finding"), S.pick_cve(F.col("v.aliases")).alias("cve"), F.coalesce(vector, F.lit("")).alias("vector"), score.alias("score"), S.cvss_label(score).alias("severity"),
        S.first_event(F.col("v.affected"), F.col("name"), "introduced").alias("introduced"), S.first_event(F.col("v.affected"), F.col("name"), "fixed").alias("fixed"),
    )


def foundation_projects(answers: DataFrame) -> DataFrame:
    """slug, name, homepage, status of a foundation's projects. answers: json (slug to project), status."""
    rows = answers.select("status", F.explode(F.from_json("json", "map<string, struct<name:string, homepage:string, pmc:string>>")).alias("slug", "p"))
    return rows.select("slug", "p.name", "p.homepage", "status")


#: States of landscape projects that are taken.
TAKEN = ("graduated", "incubating", "sandbox")


def landscape_projects(documents: DataFrame) -> DataFrame:
    """status, name, homepage, repos of a landscape tree (json: categories, subcategories, items; YAML turned into JSON).

    The tree is a variant: what else it holds, and fields of other types, do no harm. Items of other states and those without
    a repository are left out; repositories are the primary one and then the additional ones, normalised, without blanks.
    """
    spark = documents.sparkSession

    def below(df: DataFrame, column: str) -> DataFrame:
        each = spark.tvf.variant_explode(F.col(column).outer()).select(F.col("pos"), F.col("value"))
        return df.lateralJoin(each)

    get = lambda path, kind="string": F.try_variant_get("value", path, kind)
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), F.try_variant_get(F.try_parse_json("json"), F.lit("$.landscape"), "variant").alias("v"))
    for depth, path in enumerate(("$.subcategories", "$.items")):
        rows = below(rows, "v").select("doc", *(f"at{i}" for i in range(depth)), F.col("pos").alias(f"at{depth}"), get(path, "variant").alias("v"))
    items = below(rows, "v").filter(get("$.project").isin(*TAKEN))
    more = F.transform(F.coalesce(get("$.additional_repos", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.repo_url", "string"))
    repos = F.filter(F.transform(F.concat(F.array(get("$.repo_url")), more), lambda u: S.repo_url(F.trim(u))), lambda u: F.coalesce(u, F.lit("")) != "")
    items = items.select(get("$.project").alias("status"), get("$.name").alias("name"), get("$.homepage_url").alias("homepage"), repos.alias("repos"))
    return items.filter(F.size("repos") > 0)
