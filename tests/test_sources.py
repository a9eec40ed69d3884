"""Format readers on small files of every format."""

import json

import pytest

from artefold.sources import formats as F
from artefold.sources import sinks as S


def files(spark, *contents, name="x"):
    return spark.createDataFrame([(f"{name}{i}", c) for i, c in enumerate(contents)], "path string, content string")


def lines(df):
    return {(r.path, r.line, r.covered) for r in df.collect()}


LCOV = "TN:\nSF:src/a.rs\nFNDA:1,main\nDA:1,1\nDA:2,0\nDA:3,x\nBRDA:2,0,0,1\nBRDA:2,0,1,0\nend_of_record\nSF:src/a.rs\nFNDA:2,main\nDA:2,5\nend_of_record\nSF:src/cut.rs\nDA:1,1\n"


def test_lcov(spark):
    f = files(spark, LCOV)
    assert lines(F.lcov_lines(f)) == {("src/a.rs", 1, True), ("src/a.rs", 2, True), ("src/a.rs", 3, False)}
    assert [tuple(r) for r in F.lcov_functions(f).collect()] == [("src/a.rs", "main", 3)]
    assert [tuple(r) for r in F.lcov_branches(f).collect()] == [("src/a.rs", 2, 0, 0)]


GO = "mode: set\ngithub.com/u/p/pkg/h.go:10.2,12.3 2 1\ngithub.com/u/p/pkg/h.go:12.3,13.1 1 0\nnot a line\n"


def test_gocov(spark):
    assert lines(F.gocov_lines(files(spark, GO))) == {("pkg/h.go", 10, True), ("pkg/h.go", 11, True), ("pkg/h.go", 12, True), ("pkg/h.go", 13, False)}


LLVM = json.dumps({"type": "llvm.coverage.json.export", "data": [{"files": [{"filename": "m.rs", "segments": [[1, 1, 3, True, True], [3, 1, 0, True, True], [5, 1, 0, False, False], [6, 1, 1]]}]}]})


def test_llvmcov(spark):
    assert lines(F.llvmcov_lines(files(spark, LLVM))) == {("m.rs", 1, True), ("m.rs", 2, True), ("m.rs", 3, False), ("m.rs", 4, False)}


JACOCO = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "x" "y"><report name="r"><package name="com/e"><sourcefile name="A.java"><line nr="3" mi="0" ci="2"/><line nr="4" mi="1" ci="0"/></sourcefile></package></report>'
COBERTURA = '<?xml version="1.0"?><coverage lines-valid="2"><packages><package name="p"><classes><class name="m" filename="main.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'


def test_xml_reports(spark):
    assert lines(F.jacoco_lines(files(spark, JACOCO))) == {("com/e/A.java", 3, True), ("com/e/A.java", 4, False)}
    assert lines(F.cobertura_lines(files(spark, COBERTURA))) == {("main.py", 1, True), ("main.py", 2, False)}


def test_detection_and_mixed_reading(spark):
    f = files(spark, LCOV, GO, LLVM, JACOCO, COBERTURA, "what")
    assert [r.format for r in F.detect(f).orderBy("path").collect()] == ["lcov", "gocov", "llvmcov", "jacoco", "cobertura", "unknown"]
    assert {r.format for r in F.coverage(f).select("format").distinct().collect()} == {"lcov", "gocov", "llvmcov", "jacoco", "cobertura"}
    assert F.coverage(files(spark, LCOV), fmt="lcov").count() == 3
    with pytest.raises(ValueError):
        F.coverage(f, fmt="nope")


def test_detection_by_name_and_structure(spark):
    f = spark.createDataFrame([("a/x.lcov", "?"), ("b.json", '{"data": [{"files": []}]}'), ("c.xml", "<!DOCTYPE report>"), ("d.xml", "<cobertura>"), ("e", " mode: set")], "path string, content string")
    assert [r.format for r in F.detect(f).orderBy("path").collect()] == ["lcov", "llvmcov", "jacoco", "cobertura", "unknown"]


def test_segments_of_two_files_on_one_path(spark):
    one = json.dumps({"data": [{"files": [{"filename": "m.rs", "segments": [[1, 1, 1, True, True], [9, 1, 0, False, False]]}]}]})
    two = json.dumps({"data": [{"files": [{"filename": "m.rs", "segments": [[4, 1, 0, True, True], [6, 1, 0, False, False]]}]}]})
    assert {r[1] for r in lines(F.llvmcov_lines(files(spark, one, two)))} == set(range(1, 9))


def test_tasks_come_from_exactly_one_source(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" a::b \n\nc\n")
    (tmp_path / "i.json").write_text(json.dumps({"selected_tests": ["x"], "stale": False}, indent=1))
    (tmp_path / "k.json").write_text(json.dumps({"tasks": [{"id": " y ", "tags": ["unit"]}, {"id": ""}]}))
    got = lambda **k: [(r.id, r.tags) for r in F.planned_tasks(spark, **k).collect()]
    assert got(tests_file=f"{tmp_path}/t.txt") == [("a::b", []), ("c", [])]
    assert got(impact_json=f"{tmp_path}/i.json") == [("x", [])] and got(tasks_json=f"{tmp_path}/k.json") == [("y", ["unit"])]
    with pytest.raises(ValueError):
        F.planned_tasks(spark, tests_file="a", impact_json="b")


def test_cache_keeps_live_entries_and_counts_the_rest(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert S.load_cache(spark, path, ttl_secs=10, now=100) == (None, {"old_version": 0, "unreadable": 0, "expired": 0})
    rows = spark.createDataFrame([("a", 50), ("b", 95)], "cache_key string, created long")
    S.save_cache(rows, path, ttl_secs=10, now=100)
    got, n = S.load_cache(spark, path, ttl_secs=10, now=104)
    assert [r.cache_key for r in got.collect()] == ["b"] and n["expired"] == 0
    assert S.load_cache(spark, path, ttl_secs=10, now=200)[1]["expired"] == 1
    (tmp_path / "cache" / "version=2").rename(tmp_path / "cache" / "version=1")
    assert S.load_cache(spark, path, ttl_secs=10, now=104) == (None, {"old_version": 1, "unreadable": 0, "expired": 0})


def test_junit(spark):
    x = '<testsuites><testsuite name="s"><testcase classname="a.B" name="t1" time="0.0125"/><testcase classname="a.B" name="t2" time="-1"/></testsuite></testsuites>'
    assert {tuple(r) for r in F.junit_timings(files(spark, x)).collect()} == {("a.B.t1", 13), ("a.B.t2", 0)}
    assert [tuple(r) for r in F.junit_timings(files(spark, x), by_class=True).collect()] == [("a.B", 13)]


def test_sarif(spark):
    def result(rule, uri, line, **more):
        return {"message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line, "startColumn": 5}}}], **rule, **more}

    doc = {"runs": [{"tool": {"driver": {"name": "eslint", "rules": [{"id": "r0"}]}}, "results": [
        result({"ruleId": "no-x"}, "file:///src/a.rs", 10, level="error", fingerprints={"k": "f1"}), result({"ruleId": "no-x"}, "/src/a.rs", 11, fingerprints={"k": "f1"}),
        result({"ruleIndex": 0}, "./b.rs", 2, level="none", partialFingerprints={"k": "p1"}), result({}, "c.rs", 0), result({}, "c.rs", 4)]}]}
    got = {r.path: r for r in F.sarif_issues(files(spark, json.dumps(doc))).collect()}
    assert (got["/src/a.rs"].line, got["/src/a.rs"].severity, got["/src/a.rs"].fingerprint, got["/src/a.rs"].source) == (10, "error", "f1", "eslint")
    assert got["b.rs"].rule_id == "r0" and got["b.rs"].severity == "note" and got["c.rs"].rule_id == "unknown" and got["c.rs"].line == 4
    assert len(got) == 3 and F.sarif_issues(files(spark, '{"runs": []}')).collect() == []


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -10,3 +20,3 @@ def f\n+a\n@@ -1 +2 @@\n+b\n@@ -7,2 +7,0 @@\ndiff --git a/o.py b/n.py\nsimilarity index 9%\nrename from o.py\nrename to n.py\n@@ -1,1 +1,1 @@\ndiff --git a/w.py b/w.py\nnew file mode 100644\n@@ -0,0 +1,2 @@\n"


def test_unified_diff(spark):
    f = files(spark, DIFF)
    assert {(r.path, r.line) for r in F.diff_lines(f).collect()} == {("x.py", 20), ("x.py", 21), ("x.py", 22), ("x.py", 2), ("n.py", 1), ("w.py", 1), ("w.py", 2)}
    assert {tuple(r) for r in F.diff_files(f).collect()} == {("x.py", None, "Modified"), ("n.py", "o.py", "Renamed"), ("w.py", None, "Added")}


def test_json_lines_and_folders(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"test_id": "a", "duration_ms": 5}\n{"test_id": " "}\n')
    assert [tuple(r) for r in F.timing_jsonl(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", 5)]
    (tmp_path / "m.jsonl").write_text('{"test_id": "a", "language": "java", "coverage_report": "x"}\n')
    assert F.manifest_jsonl(spark, str(tmp_path / "m.jsonl")).collect()[0].reports == ["x"]
    (tmp_path / "bad.jsonl").write_text('{"test_id": "a", "language": "perl", "coverage_report": "x"}\n')
    with pytest.raises(Exception, match="bad manifest"):
        F.manifest_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    src = tmp_path / "src"
    (src / "vendor").mkdir(parents=True)
    (src / "a.py").write_text("import os\ndef f():\n")
    (src / "bin.py").write_bytes(b"\0\1")
    (src / "vendor" / "v.py").write_text("x")
    assert {(r.path.rsplit("/", 1)[1], r.line) for r in F.source_lines(spark, str(src)).collect()} == {("a.py", 1), ("a.py", 2), ("a.py", 3)}
    (tmp_path / "e.info").write_text("")
    with pytest.raises(Exception, match="empty input"):
        F.read_files(spark, str(tmp_path / "e.info")).collect()
