"""SPDX and CycloneDX documents from their parts."""

from __future__ import annotations

import json
from pathlib import Path

from pulsegrid.operators import documents

AT = "2024-01-01T00:00:00Z"


def inputs(spark, deps):
    frame = spark.createDataFrame
    return (
        frame([(1, "o", "n\"1", "https://h/o/n", "MIT"), (2, "o", "n2", "https://h/o/2", None)], "repo_id long, repo_owner string, repo_name string, repo_git string, license string"),
        frame(deps, "repo_id long, dep_id long, name string, current_version string, purl string, license string, kind string"),
        frame([(1, "Apache-2.0", ["A", "B", "C"])], "repo_id long, concluded string, holders array<string>"),
    )


DEPS = [(1, 2, "b", "1", "pkg:npm/b@1", "Custom \"terms\"", "dev"), (1, 1, "a", "", "", "", None), (1, 3, "c", "2", "pkg:npm/c@2", "MIT", "runtime"), (1, 4, "c", "2", "pkg:npm/c@2", "MIT", "runtime"), (9, 5, "x", "1", "", "", "")]


def read(parts, spark, tmp_path):
    documents.write(parts, str(tmp_path / "out"), 3)
    return {int(d.name.split("=")[1]): json.loads("".join(f.read_text() for f in sorted(d.glob("part-*")))) for d in Path(tmp_path / "out").iterdir() if d.is_dir()}


def test_spdx(spark, tmp_path):
    docs = read(documents.spdx(*inputs(spark, DEPS), AT, "t-1", "https://x/spdx"), spark, tmp_path)
    assert docs.keys() == {1, 2}
    one, two = docs[1], docs[2]
    assert (one["spdxVersion"], one["dataLicense"], one["SPDXID"], one["name"], one["creationInfo"]) == ("SPDX-2.3", "CC0-1.0", "SPDXRef-DOCUMENT", 'n"1', {"created": AT, "creators": ["Tool: t-1"]})
    root = one["packages"][0]
    assert (root["licenseDeclared"], root["licenseConcluded"], root["copyrightText"]) == ("MIT", "Apache-2.0", "A\nB\nC")
    assert [p["name"] for p in one["packages"][1:]] == ["a", "b", "c", "c"] and one["packages"][1]["licenseDeclared"] == "NOASSERTION" and "externalRefs" not in one["packages"][1]
    assert one["packages"][2]["externalRefs"] == [{"referenceCategory": "PACKAGE-MANAGER", "referenceType": "purl", "referenceLocator": "pkg:npm/b@1"}]
    assert [r["relationshipType"] for r in one["relationships"]] == ["DEPENDS_ON"] * 4 + ["DESCRIBES"] and one["relationships"][0]["relatedSpdxElement"] == one["packages"][1]["SPDXID"]
    assert two["packages"][0]["licenseDeclared"] == two["packages"][0]["licenseConcluded"] == two["packages"][0]["copyrightText"] == "NOASSERTION" and len(two["relationships"]) == 1


def test_cyclonedx(spark, tmp_path):
    docs = read(documents.cyclonedx(*inputs(spark, DEPS), AT, "t", "me"), spark, tmp_path)
    one, two = docs[1], docs[2]
    assert (one["bomFormat"], one["specVersion"], one["version"]) == ("CycloneDX", "1.5", 1) and one["serialNumber"].startswith("urn:uuid:") and len(one["serialNumber"]) == 45
    root = one["metadata"]["component"]
    assert root["copyright"] == "A (and 2 others)" and root["evidence"] == {"licenses": [{"license": {"id": "Apache-2.0"}}], "copyright": [{"text": "A"}, {"text": "B"}, {"text": "C"}]}
    assert [(c["name"], c["scope"], c.get("licenses")) for c in one["components"]] == [("a", "required", None), ("b", "excluded", [{"license": {"name": 'Custom "terms"'}}]), ("c", "required", [{"license": {"id": "MIT"}}]), ("c", "required", [{"license": {"id": "MIT"}}])]
    refs = ["pkg:npm/b@1", "pkg:npm/c@2", "pkg:npm/c@2"]
    assert one["dependencies"] == [{"ref": 'pkg:generic/o/n"1', "dependsOn": refs}] + [{"ref": r, "dependsOn": []} for r in refs]
    assert two["components"] == [] and two["dependencies"] == [{"ref": "pkg:generic/o/n2", "dependsOn": []}] and "evidence" not in two["metadata"]["component"]


def test_no_dependencies_at_all(spark, tmp_path):
    docs = read(documents.spdx(*inputs(spark, []), AT, "t", "ns"), spark, tmp_path)
    assert [len(d["packages"]) for d in docs.values()] == [1, 1]
