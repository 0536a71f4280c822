"""Dependency manifests as one Spark job over many files: text becomes lines, lines get the section they stand in,
and the rules of each format take names and versions from them. JSON, XML and bracketed lists are taken from whole texts.

``files``: path, text. A file's lines meet in one task, as the file itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Manifest names and their ecosystems.
ECOSYSTEM = {
    "package.json": "JavaScript", "yarn.lock": "JavaScript", "requirements.txt": "Python", "setup.py": "Python", "setup.cfg": "Python", "pyproject.toml": "Python", "Pipfile": "Python", "poetry.lock": "Python",
    "go.mod": "Go", "go.sum": "Go", "Cargo.toml": "Rust", "Cargo.lock": "Rust", "Gemfile": "Ruby", "Gemfile.lock": "Ruby", "pom.xml": "Java", "build.gradle": "Java", "build.gradle.kts": "Java",
    "composer.json": "PHP", "mix.exs": "Elixir", "Package.swift": "Swift", "pubspec.yaml": "Dart", "Makefile": "C/C++", "CMakeLists.txt": "C/C++", "build.sbt": "Scala",
    "packages.config": ".NET", "Directory.Packages.props": ".NET", "package.yaml": "Haskell", "stack.yaml": "Haskell",
}
#: Folders that are not scanned.
SKIPPED = ("vendor", "node_modules", ".git", "__pycache__")
#: Package URL types of the managers.
PURL = {"npm": "npm", "pypi": "pypi", "go": "golang", "cargo": "cargo", "rubygems": "gem", "maven": "maven", "packagist": "composer", "hex": "hex", "nuget": "nuget", "pub": "pub", "swiftpm": "swift", "hackage": "hackage"}

_TOML = r'^\s*([A-Za-z0-9_.-]+)\s*=\s*(?:"([^"]*)"|\{(?:.*?\bversion\s*=\s*"([^"]*)")?.*)'
_REQUIREMENT = r"([^\s#;<>=!~,\[-][^\s#;<>=!~,\[]*)\s*(?:\[[^\]]*\])?\s*(?:(?:===?|>=|~=)\s*([^,;\s#]+))?()"
_ATTRIBUTES = r'.*?(?i:include)="([^"]+)"(?:.*?(?i:version)="([^"]*)")?()'
#: format, manager, line that opens a section (group 1: its name), line that closes one, sections and their dependency types,
#: entry (groups: name, version, version), whether versions lose their operators, and the listing it is for: of versions, of names, or both.
_RULES = [
    ("requirements.txt", "pypi", None, None, {"": "runtime"}, r"^\s*" + _REQUIREMENT, False, "both"),
    ("setup.cfg", "pypi", r"^([^\s=\[][^=]*?)\s*=", r"^\[", {"install_requires": "runtime"}, r"^\s+" + _REQUIREMENT, False, "both"),
    ("pyproject.toml", "pypi", r"^\s*\[([^\]]+)\]", None, {"tool.poetry.dependencies": "runtime"}, _TOML, True, "both"),
    ("Pipfile", "pypi", r"^\s*\[([^\]]+)\]", None, {"packages": "runtime"}, _TOML, True, "both"),
    ("go.mod", "go", r"^\s*(require) \(\s*$", r"^\s*\)\s*$", {"require": "runtime"}, r"^\s*([^\s/()]\S*)\s+(\S+)()", False, "versions"),
    ("go.mod", "go", r"^\s*(require) \(\s*$", r"^\s*\)\s*$", {"require": "runtime"}, r"^\s*(\S+)()()", False, "names"),
    ("go.mod", "go", None, None, {"": "runtime"}, r"^\s*require\s+([^\s(]\S*)\s+([^\s(]\S*)()", False, "versions"),
    ("Cargo.toml", "cargo", r"^\s*\[([^\]]+)\]", None, {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}, _TOML, True, "versions"),
    ("Cargo.toml", "cargo", r"^\s*\[([^\]]+)\]", None, {"dependencies": "runtime"}, r"^\s*([^=\s]+)\s*=()()", False, "names"),
    ("Gemfile", "rubygems", None, None, {"": "runtime"}, r"""^\s*gem\s+["']?([^"',\s]+)["']?\s*(?:,\s*["']?([^"',]*)["']?)?()""", True, "both"),
    ("build.gradle", "maven", None, None, {"": "runtime"}, r"""^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|testCompileOnly)[^"']*["']([^"':]+:[^"':]+)(?::([^"']*))?["']()""", False, "both"),
    ("build.sbt", "maven", None, None, {"": "runtime"}, r'libraryDependencies(?=.*%)[^"]*"([^"]*"[^"]*"[^"]*)"(?:[^"]*"([^"]*)")?()', False, "both"),
    ("packages.config", "nuget", None, None, {"": "runtime"}, r'<[Pp]ackage\s.*?(?i:\bid)="([^"]+)"(?:.*?(?i:\bversion)="([^"]*)")?()', False, "versions"),
    ("packages.config", "nuget", None, None, {"": "runtime"}, r'<package\s.*?\bid="([^"]+)"()()', False, "names"),
    ("csproj", "nuget", None, None, {"": "runtime"}, "PackageReference" + _ATTRIBUTES, False, "both"),
    ("Directory.Packages.props", "nuget", None, None, {"": "runtime"}, "PackageVersion" + _ATTRIBUTES, False, "both"),
    ("package.yaml", "hackage", r"^\s*(dependencies):\s*$", r"^[^\s-]", {"dependencies": "runtime"}, r"^\s*- ([^ ><=!]+)(?:[^0-9]*([0-9][0-9.]*))?()", False, "both"),
    ("mix.exs", "hex", None, None, {"": "runtime"}, r"""^\s*\{:([^,\s}]+)\s*(?:,\s*["']?([^"',}\]]*))?()""", True, "names"),
    ("mix.exs", "hex", None, None, {"": "runtime"}, r"""^\s*\{:([^,\s}]+)\s*,\s*["']?([^"',}\]]*)()""", True, "versions"),
    ("pubspec.yaml", "pub", r"^(dependencies|dev_dependencies):\s*$", r"^\S", {"dependencies": "runtime", "dev_dependencies": "dev"}, r"""^\s+([^#:\s][^:]*?)\s*:\s*["']?([^"']*?)["']?\s*$()""", True, "both"),
    ("Package.swift", "swiftpm", None, None, {"": "runtime"}, r'\.package\(url:\s*"[^"]*?([^"/]+?)(?:\.git)?/?"(?:[^"]*"([^"]*)")?()', False, "both"),
]
_JSON = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>, require map<string,string>, `require-dev` map<string,string>"


def decode_text(data: Column) -> Column:
    """UTF-8, or UTF-16 by its byte order mark."""
    mark, rest = F.hex(F.substring(data, 1, 2)), F.substring(data, 3, 1 << 30)
    return F.when(mark == "FFFE", F.decode(rest, "UTF-16LE")).when(mark == "FEFF", F.decode(rest, "UTF-16BE")).otherwise(F.decode(data, "UTF-8"))


def scan_files(spark, root: str) -> DataFrame:
    """path, text of the manifests below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(ECOSYSTEM)},*.csproj}}").load(root)
    skipped = F.lit(False)
    for name in SKIPPED:
        skipped = skipped | F.col("path").contains(f"/{name}/")
    return found.filter(~skipped).select("path", decode_text(F.col("content")).alias("text"))


def _base() -> Column:
    base = F.substring_index("path", "/", -1)
    return F.when(base == "build.gradle.kts", "build.gradle").when(base.endswith(".csproj"), "csproj").otherwise(base)


def _by_lines(files: DataFrame, listing: str) -> DataFrame:
    rules = [(i, *rule[:-1]) for i, rule in enumerate(_RULES) if rule[-1] in (listing, "both")]
    schema = "rule int, format string, manager string, open string, close string, sections map<string,string>, entry string, clean boolean"
    rules = F.broadcast(files.sparkSession.createDataFrame(rules, schema))  # a row for each rule above
    rows = files.join(rules, "format").select("path", "rule", "format", "manager", "open", "close", "sections", "entry", "clean", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    rows = rows.withColumn("mark", F.expr("case when open is null then null when line rlike open then regexp_extract(line, open, 1) when line rlike close then '' end"))
    w = Window.partitionBy("path", "rule").orderBy("pos")
    rows = rows.withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("")))
    rows = rows.withColumn("type", F.try_element_at("sections", F.col("section"))).filter("type is not null and mark is null and line rlike entry")
    name, version = F.trim(F.expr("regexp_extract(line, entry, 1)")), F.expr("concat(regexp_extract(line, entry, 2), regexp_extract(line, entry, 3))")
    name = F.when(F.col("format") == "build.sbt", F.regexp_replace(name, r'"[^"]*"', ":")).otherwise(name)
    rows = rows.filter(~((F.col("format") == "pubspec.yaml") & (F.col("line").contains("sdk:") | name.isin("flutter", "flutter_test"))))
    rows = rows.filter(~((F.col("format") == "pyproject.toml") & (name == "python")) & ~F.col("line").rlike(r"^\s*//"))
    kind = F.when((F.col("format") == "build.gradle") & F.col("line").rlike(r"^\s*test"), "dev").otherwise(F.col("type"))
    version = F.when(F.col("clean"), S.version_clean(version)).otherwise(F.trim(version))
    return rows.select("path", "manager", name.alias("name"), F.when(version == "*", "").otherwise(version).alias("version"), kind.alias("type"))


def _by_texts(files: DataFrame, listing: str) -> DataFrame:
    json = files.filter(F.col("format").isin("package.json", "composer.json")).withColumn("j", F.from_json("text", _JSON))
    npm = F.col("format") == "package.json"
    parts = [("dependencies", "runtime", npm), ("devDependencies", "dev", npm), ("peerDependencies", "peer", npm), ("optionalDependencies", "optional", npm), ("require", "runtime", ~npm), ("require-dev", "dev", ~npm)]
    typed = lambda kind: lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("type"))
    entries = [F.transform(F.when(own, F.map_entries(F.col(f"j.`{key}`"))), typed(kind)) for key, kind, own in parts]
    entries = F.flatten(F.array(*(F.coalesce(e, F.expr("array()").cast("array<struct<name:string,version:string,type:string>>")) for e in entries)))
    json = json.select("path", F.when(npm, "npm").otherwise("packagist").alias("manager"), F.explode(entries).alias("e")).select("path", "manager", "e.name", S.version_clean(F.col("e.version")).alias("version"), "e.type")
    json = json.filter(~((F.col("manager") == "packagist") & (F.col("type") == "runtime") & ((F.col("name") == "php") | F.col("name").startswith("ext-"))))

    project = F.regexp_extract("text", r"(?s)(?:^|\n)\[project\](.*?)(?:\n\s*\[[^\"'\]\s]|$)", 1)
    body = F.when(F.col("format") == "setup.py", F.regexp_extract("text", r"(?s)install_requires\s*=\s*\[([^\]]*)\]", 1))
    body = body.when(F.col("format") == "pyproject.toml", F.regexp_extract(project, r"""(?s)\ndependencies\s*=\s*\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""", 1))
    lists = files.filter(F.col("format").isin("setup.py", "pyproject.toml")).select("path", F.explode(F.regexp_extract_all(body, F.lit(r"""["']([^"']+)["']"""), 1)).alias("r"))
    lists = lists.select("path", F.lit("pypi").alias("manager"), F.regexp_extract("r", r"^\s*" + _REQUIREMENT, 1).alias("name"), F.regexp_extract("r", r"^[^=<>!~]*?(?:==|>=|<=|~=|!=|>|<)=?\s*([^,;\s]+)", 1).alias("version"), F.lit("runtime").alias("type"))

    tag = lambda t: F.trim(F.regexp_extract("b", rf"(?s)<{t}>(.*?)</{t}>", 1))
    pom = files.filter("format = 'pom.xml'").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("b"))
    pom = pom.select("path", F.lit("maven").alias("manager"), (tag("artifactId") if listing == "names" else F.concat(tag("groupId"), F.lit(":"), tag("artifactId"))).alias("name"), tag("version").alias("version"), F.lit("runtime").alias("type"))
    return json.unionByName(lists).unionByName(pom.filter("name not like ':%' and name not like '%:'"))


def dependencies(files: DataFrame, listing: str = "versions") -> DataFrame:
    """path, manager, name, version ('' if none), type (runtime, dev, build, peer, optional); files of other names give nothing.

    listing="names" reads a few formats as the plain listing does: only the block of go.mod, only the main section of Cargo.toml,
    artifacts of pom.xml without their groups, small-letter elements of packages.config, entries of mix.exs without a version.
    """
    files = files.select("path", "text", _base().alias("format"))
    return _by_lines(files, listing).unionByName(_by_texts(files, listing)).filter("name <> ''")


def dependency_names(files: DataFrame) -> DataFrame:
    """path, ecosystem, name: what a plain listing counts; peers and options of a package are not listed."""
    ecosystem = F.create_map(*[F.lit(x) for pair in ECOSYSTEM.items() for x in pair])
    names = dependencies(files, "names").filter("type not in ('peer', 'optional')").withColumn("format", F.substring_index("path", "/", -1))
    return names.select("path", F.when(F.col("format").endswith(".csproj"), ".NET").otherwise(ecosystem[F.col("format")]).alias("ecosystem"), "name").distinct()


def package_url(manager: Column, name: Column, version: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in PURL.items() for x in pair])
    plain = F.when(manager == "maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    return F.concat(F.lit("pkg:"), kinds[manager], F.lit("/"), plain, F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))


def with_classifiers(registry: DataFrame) -> DataFrame:
    """The registry (with a column classifiers: array<string>), pypi's missing or unknown licences taken from the classifiers."""
    lacking = (F.col("manager") == "pypi") & F.upper(F.trim(F.coalesce("licence", F.lit("")))).isin("", "UNKNOWN")
    return registry.withColumn("licence", F.when(lacking, S.classifier_licence(F.col("classifiers"))).otherwise(F.col("licence"))).drop("classifiers")


def registry_join(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """deps with purl, latest_version, current_released, latest_released, licence, libyear.

    registry: manager, name, version, released_at (string), licence, is_latest, of all twelve managers. A version matches raw or
    padded to three parts; its licence is its own or else the newest's, normalised; maven has no libyear.
    """
    facts = F.struct("version", "released_at", "licence")
    # Dealt out before anything is sorted, and merged: a small file can hold many packages, whose number no file size tells.
    registry = registry.repartition("manager", "name")
    newest = registry.filter("is_latest").groupBy("manager", "name").agg(F.max_by(facts, F.struct("released_at", "version")).alias("newest")).hint("merge")
    one = registry.groupBy("manager", "name", "version").agg(F.max_by(facts, "released_at").alias("own"))
    deps = deps.filter(~((F.col("manager") == "npm") & F.col("name").startswith("-")))
    padded = one.select("manager", "name", F.col("version").alias("__padded"), F.col("own").alias("__own")).hint("merge")
    out = deps.join(newest, ["manager", "name"], "left").join(one.hint("merge"), ["manager", "name", "version"], "left")
    out = out.withColumn("__padded", S.version_pad(F.col("version"))).join(padded, ["manager", "name", "__padded"], "left").withColumn("own", F.coalesce("own", "__own"))
    licence = S.spdx(F.coalesce(F.nullif(F.trim("own.licence"), F.lit("")), F.col("newest.licence")))
    years = F.when(F.col("manager") == "maven", 0.0).otherwise(S.libyear(F.col("own.released_at"), F.col("newest.released_at")))
    return out.select(
        *deps.columns, package_url(F.col("manager"), F.col("name"), F.col("version")).alias("purl"), F.col("newest.version").alias("latest_version"),
        F.col("own.released_at").alias("current_released"), F.col("newest.released_at").alias("latest_released"), licence.alias("licence"), years.alias("libyear"),
    )
