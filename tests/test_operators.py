"""Operators on literals: the stated rules, ties, nulls, empty inputs."""

import pytest
from pyspark.sql import functions as F

from artefold.functions import text as T
from artefold.operators import broker as B
from artefold.operators import coverage as C
from artefold.operators import graph as G
from artefold.operators import impact as I
from artefold.operators import issues as S
from artefold.operators import paths as P
from artefold.operators import reduce as L
from artefold.operators import search as X
from artefold.operators import state as A
from artefold.operators.segments import carry_previous


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tokenize, "src/ParseHTTP2_file.rs ok") == ["src/parsehttp2_file.rs", "src", "parsehttp2", "parse", "http", "file", "rs", "ok"] or "parse" in one(spark, T.tokenize, "src/ParseHTTP2_file.rs ok")
    assert one(spark, T.resolve_path, "A\\b/./c/../D.rs") == "a/b/d.rs"
    assert one(spark, T.ascii_lower, "ÀB") == "Àb"
    assert [one(spark, f, "äbcde") for f in (T.tokens_by_bytes, T.tokens_by_chars, T.tokens_at_least_one)] == [1, 2, 2] and one(spark, T.tokens_at_least_one, "") == 1
    assert [one(spark, T.looks_like_path, w) for w in ("a/b", "x.rs", "x.123", "word", "v1.2.3")] == [True, True, False, False, False]
    assert one(spark, T.trigrams, "abcab") == ["abc", "bca", "cab"] and one(spark, T.trigrams, "ab") == []
    assert [one(spark, T.short_count, n, "long") for n in (950, 1200, 3_400_000)] == ["950", "1.2K", "3.4M"]


def test_sql_functions(spark):
    B.registered_functions(spark)
    assert spark.sql("select message_template('Line 12 of ABC'), tokens_by_chars('abcde'), path_basename('a/b')").first() == ("line # of abc", 2, "b")


def test_coverage_gate_nulls_and_unknown_files(spark):
    cov = C.merge(spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, False), (None, 3, True)], "path string, line int, covered boolean"))
    diff = spark.createDataFrame([("a", 1), ("a", 9), ("new", 1), ("new", 2)], "path string, line int")
    added = spark.createDataFrame([("none",)], "path string")
    row = C.gate(cov, diff, added, least_total=50, least_changed=50, least_new=99).first()
    assert (row.total_pct, row.changed_pct, row.new_pct, row.violations, row.passed) == (50.0, 33.333333, None, "changed_pct", False)
    assert C.gate(cov.limit(0), diff.limit(0), added, least_total=1).first().passed
    ranges = C.line_ranges(spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 10, 11)], "path string, line int"))
    assert C.range_text(ranges).first().ranges == "1-3, 7, 10-11"


def test_issue_keep_first_and_paths(spark):
    i = spark.createDataFrame([(3, "./a.rs", 1, "Warn", "r", "m", "f"), (1, "a.rs", 5, "ERROR", "r", "m", "f"), (2, "file:///C:/b\\c.rs", 0, "x", "r", "m", None), (4, None, 2, "note", None, None, None)], "issue_id long, path string, line int, severity string, rule_id string, message string, fingerprint string")
    n = S.normalised(i)
    assert [(r.issue_id, r.path, r.severity) for r in S.keep_first(n).collect()] == [(1, "a.rs", "error")]


def test_lpt_and_greedy(spark):
    tasks = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "id string, est_ms long")
    assert sorted((r.shard_id, r.id) for r in I.lpt_shards(tasks, 2).collect()) == [(0, "a"), (0, "d"), (1, "b"), (1, "c")]
    assert I.lpt_shards(tasks.limit(0), 2).collect() == []
    cells = spark.createDataFrame([("t1", "f", n) for n in (1, 2, 3)] + [("t2", "f", n) for n in (3, 4)] + [("t3", "f", 4)], "test_id string, path string, line int")
    diff = spark.createDataFrame([("f", n) for n in (1, 2, 3, 4, 99)], "path string, line int")
    assert [(r.test_id, r.gain) for r in I.greedy_plan(cells, diff, target=1.0).collect()] == [("t1", 3), ("t2", 1)]
    assert I.greedy_plan(cells, diff.limit(0)).collect() == []


def test_whale_threshold_without_tasks(spark):
    assert I.whale_threshold(spark.createDataFrame([], "id string, est_ms long")).first().threshold_ms == 30_000


def test_path_resolver_cascade_and_root(spark):
    o = spark.createDataFrame([("a/x.rs",), ("old/y.rs",), ("/w/a/x.rs",), ("deep/b/z.rs",), ("nowhere.c",), ("skip.toml",), (None,)], "path string")
    k = spark.createDataFrame([("a/x.rs",), ("new/y.rs",), ("q/z.rs",), ("b/z.rs",)], "path string")
    got = {r.path: (r.strategy, r.target) for r in P.resolved(o, k, ignore=r"\.toml$", rules={"old/": "new/"}, prefixes=("/w/",)).collect()}
    assert got == {"a/x.rs": ("exact", "a/x.rs"), "old/y.rs": ("rule", "new/y.rs"), "/w/a/x.rs": ("prefix", "a/x.rs"), "deep/b/z.rs": ("suffix", "b/z.rs"), "nowhere.c": ("unmapped", None), "skip.toml": ("ignored", None)}
    root = lambda *p: P.common_root(spark.createDataFrame([(x,) for x in p], "path string")).first().root
    assert root("/r/a/x", "/r/a/y/z", "/r/ab") == "/r" and root("/r/a/x", "b") == "" and root("/r/a/x") == "/r/a"


def test_regex_plans():
    assert X.plan("abcd") == X.Plan("grams", ("abc", "bcd"))
    assert X.plan("ab|cd").kind == "all" and X.plan("(?i)abcd").kind == "all" and X.plan("a.c").kind == "all"
    assert X.plan("foo(bar|bazz)+qux").kind == "and"


def test_indexed_search_equals_scan(spark):
    docs = spark.createDataFrame([(1, "fn write_cache\nfn read"), (2, "write only"), (3, None), (4, "xx read_index into\n")], "doc_id long, text string")
    scan = lambda p: {(r.doc_id, r.pos + 1) for r in docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).filter(F.col("t").rlike(p)).collect()}
    for p in ("write", "(write|read)_[a-z]+", "re.d", "^fn", "nothing here", "cache|index"):
        stored = X.index(docs, "doc_id", "text")
        for grams in (None, stored):
            assert {(r.id, r.line_no) for r in X.indexed_search(docs, "doc_id", "text", p, grams=grams).collect()} == scan(p), p


def test_levels_and_cycles(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    d = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "unknown")], "id string, needs string")
    assert {tuple(r) for r in G.levels(n, d).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        G.levels(n, d.union(spark.createDataFrame([("a", "c")], d.schema)))


def test_symbols_imports_and_edges(spark):
    lines = spark.createDataFrame([("src/a.py", 1, "from pkg.util import x"), ("src/a.py", 2, "def run():"), ("src/b.rs", 1, "pub fn no"), ("src/b.rs", 2, "struct Yes {")], "path string, line int, text string")
    assert {(r.path, r.kind, r.name) for r in G.symbols(lines).collect()} == {("src/a.py", "def", "run"), ("src/b.rs", "struct", "Yes")}
    files = spark.createDataFrame([("lib/util.py",), ("src/util.py",), ("src/a.py",)], "path string")
    assert [r.to_path for r in G.import_edges(G.imports(lines), files).collect()] == ["src/util.py"]
    assert G.pattern_regex("if $X = $_ { $$$B }") == r"if\s+[A-Za-z_][A-Za-z0-9_]*\s+=\s+.+?\s+\{\s+.*?\s+\}"


def test_rustc_headers_wait_for_their_place(spark):
    t = ["error[E0308]: mismatched types", "   |", "  --> src/a.rs:3:5", "  --> src/b.rs:3:5", "warning: void", "error: void", "x/y.c:1:2: note: hi [flag]", "f.cs(3,4):\terror CS1: bad", "error: last", "text"]
    rows = L.diagnostics(spark.createDataFrame([("l", i, s) for i, s in enumerate(t)], "log string, line_no int, text string")).orderBy("line_no").collect()
    assert [(r.file, r.line, r.severity, r.code) for r in rows] == [("src/a.rs", 3, "error", "E0308"), ("x/y.c", 1, "note", "flag"), ("f.cs", 3, "error", "CS1"), ("<unknown>", 0, "error", None)]


def test_comments_and_commands(spark):
    assert one(spark, lambda c: B.without_comments(c, "c"), "// a\nx = 1 // b\n/* c\n d */\n\n\ny\n\n") == "x = 1 // b\n\ny"
    assert [one(spark, B.command_family, c) for c in ("A=1 cargo test 2>&1", "ls | head -3", "echo $X", "a && b", "", None)] == ["rust", "fs", None, None, None, None]
    assert one(spark, B.canonical_hash, '{"b": 1, "a": [1]}') == one(spark, B.canonical_hash, '{"a":[1],"b":1}') and one(spark, B.canonical_hash, "{") is None


def test_open_set_with_clears(spark):
    e = spark.createDataFrame([("t", 1, 1, "add", "x"), ("t", 2, 2, "add", "y"), ("t", 3, 3, "remove", "x"), ("t", 4, 4, "clear", None), ("t", 5, 5, "add", "z"), ("u", 1, 6, "add", "x")], "task string, at long, event_id long, kind string, item string")
    assert {tuple(r) for r in A.open_set(e, add=["add"], remove=["remove"], clear=["clear"]).collect()} == {("t", "z"), ("u", "x")}


def test_carry_previous_crosses_segments(spark):
    df = spark.createDataFrame([("k", i, i if i % 10 == 3 else None) for i in range(40)] + [(None, 5, 9), (None, 25, None)], "k string, o int, v int")
    got = {(r.k, r.o): r.got for r in carry_previous(df, ["k"], ["o"], F.floor(F.col("o") / 7), {"got": F.col("v")}).collect()}
    assert got["k", 3] is None and got["k", 4] == 3 and got["k", 13] == 3 and got["k", 39] == 33 and got[None, 25] == 9 and len(got) == 42
