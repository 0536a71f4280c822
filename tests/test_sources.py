"""Manifests, registry joins, logs and scanner reports on authored texts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import manifests, scans

FILES = {
    "package.json": ('{"dependencies": {"a": "^1.2", "b": "~> 2"}, "devDependencies": {"c": ">=3,<4"}, "peerDependencies": {"p": "1"}}', {("a", "1.2", "runtime"), ("b", "2", "runtime"), ("c", "3", "dev"), ("p", "1", "peer")}),
    "requirements.txt": ("# note\nflask==2.3.0\nrequests[socks]>=2.28.0,<3 # why\nnumpy~=1.24\npandas\n-e ./local\ndjango<2.0\n\nsix ; python_version < '3'\n", {("flask", "2.3.0", "runtime"), ("requests", "2.28.0", "runtime"), ("numpy", "1.24", "runtime"), ("pandas", "", "runtime"), ("django", "", "runtime"), ("six", "", "runtime")}),
    "setup.py": ("setup(name='x', install_requires=['a>=1.0', \"b\",\n 'c==2'], extras_require={'d': ['e']})", {("a", "1.0", "runtime"), ("b", "", "runtime"), ("c", "2", "runtime")}),
    "setup.cfg": ("[options]\npython_requires = >=3\ninstall_requires =\n    a>=1\n    # no\n    b\nzip_safe = no\n    x\n", {("a", "1", "runtime"), ("b", "", "runtime")}),
    "pyproject.toml": ('[project]\nname = "x"\ndependencies = [\n  "a[x]>=1",\n  \'b\',\n]\n[tool.poetry.dependencies]\npython = "^3"\nc = "^2.1"\nd = {version = "~3", extras = ["x"]}\n', {("a", "1", "runtime"), ("b", "", "runtime"), ("c", "2.1", "runtime"), ("d", "3", "runtime")}),
    "Pipfile": ('[packages]\na = "*"\nb = {version = "==1.0"}\n[dev-packages]\nc = "*"\n', {("a", "", "runtime"), ("b", "1.0", "runtime")}),
    "go.mod": ("module m\n\ngo 1.23\n\nrequire github.com/x/y v1.2.3\n\nrequire (\n\tgithub.com/a/b/v5 v5.9.1\n\t// note\n\tgolang.org/x/sync v0.17.0 // indirect\n)\n", {("github.com/x/y", "v1.2.3", "runtime"), ("github.com/a/b/v5", "v5.9.1", "runtime"), ("golang.org/x/sync", "v0.17.0", "runtime")}),
    "Cargo.toml": ('[package]\nname = "x"\n[dependencies]\na = "1.0"\nb = { version = "2", features = ["x"] }\nc = { path = "y" }\n[dev-dependencies]\nd = "3"\n', {("a", "1.0", "runtime"), ("b", "2", "runtime"), ("c", "", "runtime"), ("d", "3", "dev")}),
    "Gemfile": ("source 'https://x'\ngem 'rails', '~> 7.0'\ngem \"pg\"\n", {("rails", "7.0", "runtime"), ("pg", "", "runtime")}),
    "pom.xml": ("<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>\n<dependency>\n<groupId>h</groupId>\n<artifactId>b</artifactId>\n</dependency></dependencies>", {("g:a", "1", "runtime"), ("h:b", "", "runtime")}),
    "build.gradle": ("dependencies {\n  implementation 'g:a:1.0'\n  testImplementation(\"h:b:2\")\n  // api 'n:o:1'\n}\n", {("g:a", "1.0", "runtime"), ("h:b", "2", "dev")}),
    "composer.json": ('{"require": {"php": ">=8", "ext-json": "*", "v/a": "^1"}, "require-dev": {"v/b": "2"}}', {("v/a", "1", "runtime"), ("v/b", "2", "dev")}),
    "build.sbt": ('libraryDependencies += "org" %% "name" % "1.0"\nval x = "a"\n', {("org:name", "1.0", "runtime")}),
    "packages.config": ('<packages>\n<package id="A" version="1" />\n<Package Id="B" Version="2" />\n</packages>', {("A", "1", "runtime"), ("B", "2", "runtime")}),
    "App.csproj": ('<PackageReference Include="A" Version="1" />\n<PackageReference Include="B" />\n', {("A", "1", "runtime"), ("B", "", "runtime")}),
    "Directory.Packages.props": ('<PackageVersion Include="A" Version="1" />\n', {("A", "1", "runtime")}),
    "package.yaml": ("name: x\ndependencies:\n- base >= 4.7 && < 5\n- text\nlibrary:\n  - no\n", {("base", "4.7", "runtime"), ("text", "", "runtime")}),
    "mix.exs": ('defp deps do\n [\n  {:phoenix, "~> 1.7.0"},\n  {:jason, ">= 1.0"}\n ]\nend\n', {("phoenix", "1.7.0", "runtime"), ("jason", "1.0", "runtime")}),
    "pubspec.yaml": ("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^0.13.6\ndev_dependencies:\n  lints: '2.0'\nflutter:\n  uses: yes\n", {("http", "0.13.6", "runtime"), ("lints", "2.0", "dev")}),
    "Package.swift": ('.package(url: "https://h/o/Alamo.git", from: "5.6.0"),\n.package(url: "https://h/o/Kit", .upToNextMajor(from: "10.4.0")),\n', {("Alamo", "5.6.0", "runtime"), ("Kit", "10.4.0", "runtime")}),
    "Makefile": ("all:\n\tcc x.c\n", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"/r/{name}", text) for name, (text, _) in FILES.items()] + [("/r/none/go.mod", None), ("/r/none/package.json", "{broken")], "path string, text string")
    rows = manifests.dependencies(files).collect()
    assert not [r for r in rows if "/none/" in r["path"]]
    return rows


@pytest.mark.parametrize("name", FILES)
def test_manifest(found, name):
    assert {(r["name"], r["version"], r["type"]) for r in found if r["path"] == f"/r/{name}"} == FILES[name][1]


def test_names_leave_out_peers_and_files_are_found(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "package.json").write_text(FILES["package.json"][0])
    (tmp_path / "package.json").write_text(FILES["package.json"][0])
    (tmp_path / "requirements.txt").write_bytes(b"\xff\xfe" + "flask==1\n".encode("utf-16-le"))
    files = manifests.scan_files(spark, str(tmp_path))
    assert {(r["ecosystem"], r["name"]) for r in manifests.dependency_names(files).collect()} == {("JavaScript", "a"), ("JavaScript", "b"), ("JavaScript", "c"), ("Python", "flask")}


def test_names_of_formats_that_list_otherwise(spark):
    texts = {
        "go.mod": ("module m\nrequire one/line v1\nrequire (\n\ta/b v1\n\t// note\n\tbare\n)\n", {"a/b", "bare"}),
        "Cargo.toml": ('[dependencies]\na = "1"\nb.workspace = true\n[dev-dependencies]\nd = "3"\n[build-dependencies]\ne = "1"\n', {"a", "b.workspace"}),
        "pom.xml": (FILES["pom.xml"][0], {"a", "b"}),
        "packages.config": (FILES["packages.config"][0], {"A"}),
        "mix.exs": ("{:phoenix, \"~> 1.7\"},\n{:bare}\n", {"phoenix", "bare"}),
    }
    files = spark.createDataFrame([(f"/r/{n}", t) for n, (t, _) in texts.items()], "path string, text string")
    got = manifests.dependency_names(files).collect()
    assert {n: {r["name"] for r in got if r["path"] == f"/r/{n}"} for n in texts} == {n: want for n, (_, want) in texts.items()}
    versions = manifests.dependencies(files).collect()
    assert {r["name"] for r in versions if r["path"] == "/r/mix.exs"} == {"phoenix"} and "one/line" in {r["name"] for r in versions}


def test_registry_join(spark):
    deps = spark.createDataFrame([("npm", "a", "1.0"), ("npm", "-x", "1"), ("maven", "g:a", "1"), ("cargo", "c", "2"), ("hex", "gone", "")], "manager string, name string, version string")
    registry = spark.createDataFrame(
        [("npm", "a", "1.0", "2020-01-01T00:00:00Z", "MIT License", False), ("npm", "a", "2.0", "2021-01-01T00:00:00Z", "ISC", True), ("maven", "g:a", "1", "2020-01-01T00:00:00Z", "", True), ("cargo", "c", "2.0.0", "2020-01-01T00:00:00Z", "", True)],
        "manager string, name string, version string, released_at string, licence string, is_latest boolean",
    )
    rows = {r["name"]: r for r in manifests.registry_join(deps, registry).collect()}
    assert set(rows) == {"a", "g:a", "c", "gone"}
    assert rows["a"]["purl"] == "pkg:npm/a@1.0" and rows["a"]["licence"] == "MIT" and rows["a"]["libyear"] == pytest.approx(366 / 365) and rows["a"]["latest_version"] == "2.0"
    assert rows["g:a"]["purl"] == "pkg:maven/g/a@1" and rows["g:a"]["libyear"] == 0
    assert rows["c"]["current_released"] == "2020-01-01T00:00:00Z" and rows["gone"]["libyear"] == 0 and rows["gone"]["purl"] == "pkg:hex/gone"


def test_log(spark, tmp_path):
    head = lambda *f: "\x1e".join(f) + "\x1d\n"
    text = head("h1", "", "A", "a@x", "2024-01-02T03:04:05+00:00", "C", "c@x", "2024-01-02", "first \x1e odd") + "\n1\t2\tf.txt\n-\t-\tb.bin\nnoise\n"
    text += head("h2", "h1 h0", "B", "", "bad", "C", "c@x", "2024-01-03", "merge") + head("short", "x") + "\n3\t4\ta\tb\n" + head("h3", "h2", "A", "a@x", "2024-02-02 x", "C", "c@x", "d", "last") + "\n5\t0\tz\n"
    (tmp_path / "one.log").write_text(text)
    commits = scans.log_commits(scans.read_log(spark, str(tmp_path)))
    rows = {r["hash"]: r for r in commits.collect()}
    assert set(rows) == {"h1", "h2", "h3"} and rows["h2"]["parents"] == ["h1", "h0"] and rows["h1"]["parents"] == [] and rows["h1"]["subject"] == "first \x1e odd"
    assert str(rows["h1"]["authored_on"]) == "2024-01-02" and rows["h2"]["authored_on"] is None and str(rows["h3"]["authored_on"]) == "2024-02-02" and rows["h1"]["authored_at"] is not None
    assert {(r["hash"], r["added"], r["removed"], r["filename"]) for r in scans.log_files(commits).collect()} == {("h1", 1, 2, "f.txt"), ("h1", 0, 0, "b.bin"), ("h3", 5, 0, "z")}


def test_reports(spark):
    one = lambda value: spark.createDataFrame([(7, json.dumps(value))], "repo_id long, json string")
    sizes = scans.code_sizes(one([{"Name": "Go", "Files": [{"Location": "a.go", "Language": "Go", "Lines": 10, "Code": 7, "Comment": 2, "Blank": 1, "Complexity": 3}]}])).collect()
    assert [(r["language"], r["file_path"], r["lines"], r["code_lines"]) for r in sizes] == [("Go", "a.go", 10, 7)]
    files = [{"path": "a", "type": "file", "detected_license_expression_spdx": "MIT", "copyrights": [{"copyright": "(c) A"}, {"copyright": "(c) B"}], "holders": [{"holder": "A"}, {"holder": "B"}]}, {"path": "b", "type": "file", "holders": [{"holder": "A"}]}, {"path": "d", "type": "directory"}]
    scanned = scans.licence_scan(one({"files": files}))
    assert {(r["path"], r["licence"], r["copyright"]) for r in scans.scan_file_list(scanned).collect()} == {("a", "MIT", "(c) A (+1 more)"), ("b", "", "")}
    assert [(r["licence"], r["n"], r["is_osi"]) for r in scans.source_licence_counts(scanned).collect()] == [("MIT", 1, True)]
    assert {(r["holder"], r["files"]) for r in scans.copyright_holders(scanned).collect()} == {("A", 2), ("B", 1)}
    assert [(r["licence"], r["holders"]) for r in scans.sbom_enrichment(scanned).collect()] == [("MIT", ["A", "B"])]
    checks = scans.scorecard_checks(one({"checks": [{"name": "Maintained", "score": 9, "reason": "r", "details": ["x"]}, {"name": "Fuzzing", "score": 0}]})).collect()
    assert {(r["name"], r["score"], r["details"]) for r in checks} == {("Maintained", 9, '["x"]'), ("Fuzzing", 0, "[]")}
    vuln = {"id": "G-1", "aliases": ["X", "CVE-1"], "severity": [{"type": "CVSS_V2", "score": "no"}, {"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/C:H/I:H/A:H"}], "affected": [{"package": {"name": "o"}, "ranges": [{"events": [{"introduced": "9"}]}]}, {"package": {"name": "a"}, "ranges": [{"events": [{"introduced": "1"}, {"fixed": "2"}]}]}]}
    answers = spark.createDataFrame([("pkg:npm/a@1", json.dumps({"vulns": [vuln, {"id": "G-2"}]}))], "purl string, json string")
    rows = {r["finding"]: r for r in scans.vulnerabilities(spark.createDataFrame([(7, "pkg:npm/a@1", "a")], "repo_id long, purl string, name string"), answers).collect()}
    assert (rows["G-1"]["cve"], rows["G-1"]["severity"], rows["G-1"]["introduced"], rows["G-1"]["fixed"]) == ("CVE-1", "CRITICAL", "1", "2")
    assert (rows["G-2"]["cve"], rows["G-2"]["severity"], rows["G-2"]["fixed"]) == ("", "UNKNOWN", "")
    projects = spark.createDataFrame([(json.dumps({"x": {"name": "X", "homepage": "h"}}), "graduated")], "json string, status string")
    assert [(r["slug"], r["name"], r["status"]) for r in scans.foundation_projects(projects).collect()] == [("x", "X", "graduated")]
    assert spark.range(1).select(scans.date_prefix(F.lit("2024-13-01"))).first()[0] is None


def test_registry_join_broadcasts_no_packages(spark):
    deps = spark.createDataFrame([(1, "npm", "a", "1")], "dep_id long, manager string, name string, version string")
    registry = spark.createDataFrame([("npm", "a", "1.0.0", "2020-01-01T00:00:00Z", "ISC", True)], "manager string, name string, version string, released_at string, licence string, is_latest boolean")
    out = manifests.registry_join(deps, registry)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["latest_version"], r["current_released"]) for r in out.collect()] == [("1.0.0", "2020-01-01T00:00:00Z")]
