"""Bills of materials, SPDX 2.3 and CycloneDX 1.5, as ordered parts of each repository's document.

A document may be larger than a row, and a repository may hold a large share of all dependencies, so nothing is
collected by repository: every part is a row with its section and place, and a document is its parts in order of
(section, name, purl, dep_id), a line each. Which dependency comes first, and so takes no comma, is a minimum by
repository. ``write`` sorts parts over ranges, so that a large document lies in several files, in order of their names.

repos: repo_id, repo_owner, repo_name, repo_git, license. deps: repo_id, dep_id, name, current_version, purl, license,
kind (dev or other). scanned: repo_id, concluded, holders (array): what a licence scan found. Null texts are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Licence ids that a document names as such; other names go into a name field.
LICENCE_IDS = """
    0BSD AAL AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CAL-1.0 CAL-1.0-Combined-Work-Exception
    CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 CPAL-1.0 ECL-2.0 EFL-2.0 Entessa EUPL-1.1 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later
    LGPL-3.0-only LGPL-3.0-or-later LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 MIT MIT-0 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA Nokia OFL-1.1 OSL-3.0 PostgreSQL QPL-1.0 RPL-1.1 RPL-1.5
    RPSL-1.0 RSCPL SimPL-2.0 SISSL Sleepycat SPL-1.0 UCL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 VSL-1.0 W3C Watcom-1.0 Xnet Zlib ZPL-2.0 ZPL-2.1 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0
""".split()
ORDER = ["repo_id", "section", "name", "purl", "dep_id"]


def is_licence_id(licence: Column) -> Column:
    return F.coalesce(licence.isin(LICENCE_IDS), F.lit(False))


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _or_none(c: Column) -> Column:
    return F.coalesce(c, F.lit("NOASSERTION"))


def _licences(licence: Column) -> Column:
    """A list with the licence as an id or a name; null without one, which leaves the field out."""
    known = is_licence_id(licence)
    return F.when(licence.isNotNull(), F.array(F.struct(F.struct(F.when(known, licence).alias("id"), F.when(~known, licence).alias("name")).alias("license"))))


def _of_repo(df: DataFrame, section: int, text: Column) -> DataFrame:
    none = F.lit(None)
    return df.select("repo_id", F.lit(section).alias("section"), none.cast("string").alias("name"), none.cast("string").alias("purl"), none.cast("long").alias("dep_id"), text.alias("text"))


def _of_deps(df: DataFrame, section: int, text: Column) -> DataFrame:
    return df.select("repo_id", F.lit(section).alias("section"), "name", "purl", F.col("dep_id").cast("long").alias("dep_id"), text.alias("text"))


def _repos(repos: DataFrame, scanned: DataFrame) -> DataFrame:
    return repos.join(scanned.select("repo_id", _text("concluded").alias("concluded"), F.when(F.size("holders") > 0, F.col("holders")).alias("holders")), "repo_id", "left")


def _deps(deps: DataFrame, repos: DataFrame) -> DataFrame:
    d = deps.select("repo_id", "dep_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "current_version", "purl", "license", "kind")))
    return d.join(repos.select("repo_id"), "repo_id", "left_semi")


def spdx(repos: DataFrame, deps: DataFrame, scanned: DataFrame, created: str, tool: str, namespace: str) -> DataFrame:
    """repo_id, section, name, purl, dep_id, text. namespace: where document names begin; the repository's own follows."""
    r, d, lit = _repos(repos, scanned), _deps(deps, repos), F.lit
    declared = _or_none(_text("license"))
    root = F.struct(
        lit("SPDXRef-RootPackage").alias("SPDXID"), F.col("repo_name").alias("name"), F.col("repo_git").alias("downloadLocation"), F.coalesce("concluded", declared).alias("licenseConcluded"),
        declared.alias("licenseDeclared"), _or_none(F.array_join("holders", "\n")).alias("copyrightText"),
    )
    head = F.struct(
        lit("SPDX-2.3").alias("spdxVersion"), lit("CC0-1.0").alias("dataLicense"), lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("repo_name").alias("name"),
        F.concat_ws("/", lit(namespace), "repo_owner", "repo_name", F.sha2(F.concat_ws("/", "repo_git", lit(created)), 256)).alias("documentNamespace"), F.struct(lit(created).alias("created"), F.array(F.concat(lit("Tool: "), lit(tool))).alias("creators")).alias("creationInfo"),
    )
    name = F.concat(lit("SPDXRef-Package-"), S.package_id(F.col("name"), F.col("current_version")))
    outside = F.when(F.col("purl") != "", F.array(F.struct(lit("PACKAGE-MANAGER").alias("referenceCategory"), lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))))
    package = F.struct(
        name.alias("SPDXID"), "name", _text("current_version").alias("versionInfo"), lit("NOASSERTION").alias("downloadLocation"), lit("NOASSERTION").alias("licenseConcluded"), declared.alias("licenseDeclared"), outside.alias("externalRefs"),
    )
    relation = lambda a, kind, b: F.struct(a.alias("spdxElementId"), lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    opened = F.concat(F.expr("substring(h, 1, length(h) - 1)"), lit(',"packages":['), F.to_json(root))
    parts = [
        _of_repo(r.withColumn("h", F.to_json(head)), 0, opened),
        _of_deps(d, 1, F.concat(lit(","), F.to_json(package))),
        _of_repo(r, 2, lit('],"relationships":[')),
        _of_deps(d, 3, F.concat(F.to_json(relation(lit("SPDXRef-RootPackage"), "DEPENDS_ON", name)), lit(","))),
        _of_repo(r, 4, F.concat(F.to_json(relation(lit("SPDXRef-DOCUMENT"), "DESCRIBES", lit("SPDXRef-RootPackage"))), lit("]}"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def cyclonedx(repos: DataFrame, deps: DataFrame, scanned: DataFrame, created: str, tool: str, author: str = "") -> DataFrame:
    """repo_id, section, name, purl, dep_id, text: components with their licences, and the graph from the repository to each."""
    r, lit = _repos(repos, scanned), F.lit
    place = F.struct("name", "purl", "dep_id")
    d = _deps(deps, repos)
    # The first component and the first with a purl of each repository take no comma.
    firsts = d.groupBy("repo_id").agg(F.min(place).alias("first"), F.min(F.when(F.col("purl") != "", place)).alias("first_ref"))
    d = d.join(firsts, "repo_id")
    comma = lambda first: F.when(F.col(first) == place, lit("")).otherwise(lit(","))
    ref = F.concat(lit("pkg:generic/"), F.col("repo_owner"), lit("/"), F.col("repo_name"))
    more = F.size("holders") - 1
    rights = F.concat(F.element_at("holders", 1), F.when(more > 0, F.concat(lit(" (and "), more.cast("string"), lit(" others)"))).otherwise(""))
    evidence = F.when(F.col("concluded").isNotNull() | F.col("holders").isNotNull(), F.struct(_licences(F.col("concluded")).alias("licenses"), F.transform("holders", lambda h: F.struct(h.alias("text"))).alias("copyright")))
    root = F.struct(lit("application").alias("type"), F.col("repo_name").alias("name"), ref.alias("bom-ref"), rights.alias("copyright"), evidence.alias("evidence"))
    tools = F.struct(F.array(F.struct(lit("application").alias("type"), lit(tool).alias("name"), F.nullif(lit(author), lit("")).alias("author"))).alias("components"))
    h = F.md5(F.concat_ws("/", "repo_git", lit(created)))
    serial = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    head = F.struct(
        lit("CycloneDX").alias("bomFormat"), lit("1.5").alias("specVersion"), F.concat(lit("urn:uuid:"), serial).alias("serialNumber"), lit(1).alias("version"),
        F.struct(lit(created).alias("timestamp"), tools.alias("tools"), root.alias("component")).alias("metadata"),
    )
    component = F.struct(
        lit("library").alias("type"), "name", _text("current_version").alias("version"), _text("purl").alias("purl"), _text("purl").alias("bom-ref"), _licences(_text("license")).alias("licenses"),
        F.when(F.col("kind") == "dev", "excluded").otherwise("required").alias("scope"),
    )
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    named = d.filter("purl <> ''")
    parts = [
        _of_repo(r.withColumn("h", F.to_json(head)), 0, F.concat(F.expr("substring(h, 1, length(h) - 1)"), lit(',"components":['))),
        _of_deps(d, 1, F.concat(comma("first"), F.to_json(component))),
        _of_repo(r.withColumn("ref", ref), 2, F.concat(lit('],"dependencies":[{"ref":'), quoted("ref"), lit(',"dependsOn":['))),
        _of_deps(named, 3, F.concat(comma("first_ref"), quoted("purl"))),
        _of_repo(r, 4, lit("]}")),
        _of_deps(named, 5, F.concat(lit(',{"ref":'), quoted("purl"), lit(',"dependsOn":[]}'))),
        _of_repo(r, 6, lit("]}")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write(parts: DataFrame, path: str, files: int = 8) -> None:
    """Parts in order, a folder for each repository; a document is its files in order of their names."""
    ordered = parts.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
    ordered.select("repo_id", "text").write.partitionBy("repo_id").text(path)
