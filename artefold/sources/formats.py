"""Readers of artifact formats: DataFrames of texts in, typed tables out.

Every reader takes ``(path, content)``, one row per file (``read_files``), and
parses inside the JVM.  Files are independent of each other, so a folder of
any number of files is one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from artefold.operators.issues import path as clean_path
from artefold.operators.issues import severity


def read_files(spark: SparkSession, glob: str, *, check_empty: bool = True) -> DataFrame:
    """``path, content`` of whole text files.

    An empty file is an error.  Spark leaves empty files out of its scans, so
    they are looked for in the file listing; for very many files switch that
    off, they then give no rows.
    """
    if check_empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(glob)
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
            if f.isFile() and not f.getLen():
                raise ValueError(f"empty input: {f.getPath()}")
    return spark.read.format("binaryFile").load(glob).select("path", F.col("content").cast("string").alias("content"))


def detect(files: DataFrame) -> DataFrame:
    """``path, format``: by extension, else by the first 512 characters."""
    head = F.substring("content", 1, 512)
    fmt = (
        F.when(F.col("path").endswith(".info") | F.col("path").endswith(".lcov"), "lcov")
        .when(head.rlike("^(TN|SF):") | head.contains("\nSF:"), "lcov")
        .when(head.startswith("mode:"), "gocov")
        .when(head.contains("<coverage") | head.contains("<cobertura"), "cobertura")
        .when(head.contains("<!DOCTYPE report") | head.contains("<report"), "jacoco")
        .when(head.contains('"type"') & head.contains("llvm.coverage.json.export"), "llvmcov")
        .when(F.ltrim(head).startswith("{") & head.contains('"data"') & head.contains('"files"'), "llvmcov")
        .when(head.contains('"$schema"') & F.col("content").contains("sarif"), "sarif")
        .otherwise("unknown")
    )
    return files.select("path", fmt.alias("format"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("pos", "t"))


def lcov_records(files: DataFrame) -> DataFrame:
    """``file, path, t`` for the lines of every record that ends with ``end_of_record``."""
    recs = files.select(F.col("path").alias("file"), F.split(F.regexp_replace("content", "\r", ""), "(?m)^end_of_record\\s*$").alias("r"))
    whole = recs.select("file", F.posexplode(F.slice("r", 1, F.size("r") - 1)).alias("rec", "body"))
    return whole.select("file", "rec", F.regexp_extract("body", "(?m)^SF:(.*)$", 1).alias("path"), F.posexplode(F.split("body", "\n")).alias("pos", "t")).filter("path <> ''")


def lcov_lines(files: DataFrame) -> DataFrame:
    """``path, line, covered``; covered if the count is over 0, an unreadable count is 0; records of one path merge."""
    da = r"^DA:([0-9]+),([^,]*)"
    rows = lcov_records(files).filter(F.col("t").rlike(da))
    return rows.groupBy("path", F.regexp_extract("t", da, 1).cast("int").alias("line")).agg(F.max(F.coalesce(F.regexp_extract("t", da, 2).try_cast("bigint"), F.lit(0)) > 0).alias("covered"))


def lcov_branches(files: DataFrame) -> DataFrame:
    """``path, line, block, taken``: the last branch of a block counts."""
    br = r"^BRDA:([0-9]+),([0-9]+),([^,]*),([0-9-]+)"
    x = lambda k: F.regexp_extract("t", br, k)
    rows = lcov_records(files).filter(F.col("t").rlike(br)).select("path", x(1).cast("int").alias("line"), x(2).cast("int").alias("block"), F.coalesce(x(4).try_cast("bigint"), F.lit(0)).alias("taken"), F.struct("file", "rec", "pos").alias("o"))
    return rows.groupBy("path", "line", "block").agg(F.max_by("taken", "o").alias("taken"))


def lcov_functions(files: DataFrame) -> DataFrame:
    """``path, name, hits``, summed."""
    fn = r"^FNDA:([0-9]+),(.*)$"
    rows = lcov_records(files).filter(F.col("t").rlike(fn))
    return rows.groupBy("path", F.regexp_extract("t", fn, 2).alias("name")).agg(F.sum(F.regexp_extract("t", fn, 1).cast("bigint")).alias("hits"))


GO = r"^(.+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+\s+[0-9]+\s+([0-9]+)$"


def gocov_lines(files: DataFrame) -> DataFrame:
    """``path, line, covered``: blocks expanded to lines; the module prefix (three segments) of the file's first data line is stripped."""
    rows = _lines(files).filter(F.col("t").rlike(GO))
    x = lambda k: F.regexp_extract("t", GO, k)
    rows = rows.select("file", "pos", x(1).alias("p"), x(2).cast("int").alias("a"), x(3).cast("int").alias("b"), x(4).cast("bigint").alias("n"))
    first = rows.groupBy("file").agg(F.min_by("p", "pos").alias("p0"))
    prefix = F.when(F.size(F.split("p0", "/")) > 3, F.concat(F.substring_index("p0", "/", 3), F.lit("/"))).otherwise("")
    rows = rows.join(first, "file").withColumn("prefix", prefix)
    path = F.when((F.col("prefix") != "") & F.col("p").startswith(F.col("prefix")), F.expr("substring(p, length(prefix) + 1)")).otherwise(F.col("p"))
    out = rows.filter("b >= a").select(path.alias("path"), F.explode(F.sequence("a", "b")).alias("line"), "n")
    return out.groupBy("path", "line").agg(F.max(F.col("n") > 0).alias("covered"))


def llvmcov_lines(files: DataFrame) -> DataFrame:
    """``path, line, covered`` from segments ``[line, column, count, has_count, ...]``.

    A segment covers the lines up to the one before the next segment; short
    segments and those without a count give none.
    """
    schema = "data array<struct<files: array<struct<filename: string, segments: array<array<string>>>>>>"
    seg = files.select(F.col("path").alias("file"), F.from_json("content", schema).alias("j")).select("file", F.posexplode("j.data").alias("part", "d")).select("file", "part", F.posexplode("d.files").alias("at", "f"))
    seg = seg.select("file", "part", "at", F.col("f.filename").alias("path"), F.posexplode("f.segments").alias("pos", "s"))
    w = Window.partitionBy("file", "part", "at").orderBy("pos")
    seg = seg.select("path", F.size("s").alias("n"), F.get("s", F.lit(0)).cast("int").alias("line"), F.get("s", F.lit(2)).cast("bigint").alias("count"), F.get("s", F.lit(3)).alias("has"), F.lead(F.get("s", F.lit(0)).cast("int")).over(w).alias("nxt"))
    rows = seg.filter("n >= 5 and has = 'true'").select("path", "count", F.explode(F.sequence("line", F.greatest("line", F.coalesce(F.col("nxt") - 1, F.col("line"))))).alias("line"))
    return rows.groupBy("path", "line").agg(F.max(F.col("count") > 0).alias("covered"))


def _xml(files: DataFrame, root: str, schema: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("content", r"(?s)^\s*<\?xml.*?\?>", ""), r"(?s)<!DOCTYPE.*?>", "")
    return files.select(F.col("path").alias("file"), F.from_xml(F.trim(text), schema, {"rowTag": root, "attributePrefix": "_"}).alias("x"))


def jacoco_lines(files: DataFrame) -> DataFrame:
    """``path, line, covered``: package and source file make the path; covered if any instruction is."""
    schema = "package array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: int, _ci: bigint>>>>>>"
    p = _xml(files, "report", schema).select(F.explode("x.package").alias("p")).select(F.col("p._name").alias("pkg"), F.explode("p.sourcefile").alias("s"))
    rows = p.select(F.concat_ws("/", F.nullif("pkg", F.lit("")), "s._name").alias("path"), F.explode("s.line").alias("l"))
    return rows.groupBy("path", F.col("l._nr").alias("line")).agg(F.max(F.coalesce(F.col("l._ci"), F.lit(0)) > 0).alias("covered"))


def cobertura_lines(files: DataFrame) -> DataFrame:
    """``path, line, covered`` of ``class@filename``; covered if hit."""
    schema = "packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, lines: struct<line: array<struct<_number: int, _hits: bigint>>>>>>>>>"
    p = _xml(files, "coverage", schema).select(F.explode("x.packages.package").alias("p")).select(F.explode("p.classes.class").alias("c"))
    rows = p.select(F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l"))
    return rows.groupBy("path", F.col("l._number").alias("line")).agg(F.max(F.coalesce(F.col("l._hits"), F.lit(0)) > 0).alias("covered"))


def junit_timings(files: DataFrame, *, by_class: bool = False) -> DataFrame:
    """``test_id, duration_ms``: ``class.name`` or the class; seconds to whole milliseconds, negative ones are 0."""
    case = "testcase: array<struct<_classname: string, _name: string, _time: double>>"
    x = _xml(files, "root", f"{case.replace(': ', ' ', 1)}, testsuite array<struct<{case}>>")
    cases = x.select(F.explode(F.concat(F.coalesce("x.testcase", F.array().cast("array<struct<_classname:string,_name:string,_time:double>>")), F.coalesce(F.flatten(F.expr("transform(x.testsuite, s -> s.testcase)")), F.array().cast("array<struct<_classname:string,_name:string,_time:double>>")))).alias("c"))
    key = F.col("c._classname") if by_class else F.concat_ws(".", F.nullif("c._classname", F.lit("")), "c._name")
    ms = F.greatest(F.round(F.coalesce(F.col("c._time"), F.lit(0.0)) * 1000), F.lit(0.0)).cast("bigint")
    return cases.select(key.alias("test_id"), ms.alias("ms")).filter("test_id is not null and test_id <> ''").groupBy("test_id").agg(F.sum("ms").alias("duration_ms"))


def sarif_issues(files: DataFrame) -> DataFrame:
    """``path, line, column_no, end_line, severity, rule_id, message, source, fingerprint``.

    The first location counts, results at line 0 are dropped; the rule comes
    from its id, then its index, else ``unknown``; a result without
    fingerprints gets one; the first of each (path, fingerprint) stays.
    """
    region = "region: struct<startLine: int, startColumn: int, endLine: int>"
    result = f"ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, {region}>>>, fingerprints: map<string,string>, partialFingerprints: map<string,string>"
    schema = f"runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string>>>>, results: array<struct<{result}>>>>"
    runs = files.select(F.col("path").alias("file"), F.from_json("content", schema).alias("j")).select("file", F.posexplode("j.runs").alias("run", "r"))
    rows = runs.select("file", "run", F.col("r.tool.driver.name").alias("source"), F.col("r.tool.driver.rules").alias("rules"), F.posexplode("r.results").alias("pos", "x"))
    loc = F.get("x.locations", F.lit(0))["physicalLocation"]
    rule = F.coalesce("x.ruleId", F.get("rules", F.col("x.ruleIndex"))["id"], F.lit("unknown"))
    own = lambda m: F.get(F.filter(F.array_sort(F.map_entries(m)), lambda e: e["value"] != ""), F.lit(0))["value"]
    level = F.coalesce("x.level", F.lit("warning"))
    flat = rows.select(
        F.struct("file", "run", "pos").alias("o"), clean_path(loc["artifactLocation"]["uri"]).alias("path"), loc["region"]["startLine"].alias("line"), loc["region"]["startColumn"].alias("column_no"),
        loc["region"]["endLine"].alias("end_line"), severity(level).alias("severity"), rule.alias("rule_id"), F.col("x.message.text").alias("message"), "source",
        F.coalesce(own(F.col("x.fingerprints")), own(F.col("x.partialFingerprints"))).alias("fp"),
    )
    flat = flat.filter("path is not null and line > 0")
    flat = flat.withColumn("fingerprint", F.coalesce("fp", F.substring(F.sha2(F.concat_ws(":", "path", F.col("line").cast("string"), "rule_id", F.coalesce("message", F.lit(""))), 256), 1, 32)))
    cols = ["path", "line", "column_no", "end_line", "severity", "rule_id", "message", "source", "fingerprint"]
    first = flat.groupBy("path", "fingerprint").agg(F.min_by(F.struct(*cols), "o").alias("s"))
    return first.select("s.*")


def diff_files(files: DataFrame) -> DataFrame:
    """``path, old_path, status`` of unified diffs: Added, Deleted, Renamed or Modified."""
    s = _sections(files)
    old = F.regexp_extract("s", r"(?m)^rename from (.*)$", 1)
    status = F.when(F.col("s").rlike(r"(?m)^new file mode"), "Added").when(F.col("s").rlike(r"(?m)^deleted file mode"), "Deleted").when(old != "", "Renamed").otherwise("Modified")
    return s.select("path", F.nullif(old, F.lit("")).alias("old_path"), status.alias("status"))


def diff_lines(files: DataFrame) -> DataFrame:
    """``path, line``: lines ``s`` to ``s + c - 1`` of every hunk ``+s,c``; no count is one line, 0 none."""
    hunks = _sections(files).select("path", F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^(@@ -[0-9,]+ \+[0-9,]+ @@)"), F.lit(1))).alias("h"))
    h = r"\+([0-9]+)(?:,([0-9]+))?"
    rows = hunks.select("path", F.regexp_extract("h", h, 1).cast("int").alias("s"), F.coalesce(F.regexp_extract("h", h, 2).try_cast("int"), F.lit(1)).alias("c")).filter("c > 0")
    return rows.select("path", F.explode(F.expr("sequence(s, s + c - 1)")).alias("line")).distinct()


def _sections(files: DataFrame) -> DataFrame:
    text = F.regexp_replace("content", "\r", "")
    parts = files.select(F.explode(F.split(text, r"(?m)^(?=diff --git )")).alias("s")).filter(F.col("s").startswith("diff --git "))
    return parts.withColumn("path", F.regexp_extract("s", r"^diff --git .* b/(.*)", 1))


def timing_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``test_id, duration_ms``; blank ids are skipped, bad JSON is an error."""
    return spark.read.schema("test_id string, duration_ms bigint").option("mode", "FAILFAST").json(path).filter("trim(test_id) <> ''")


def manifest_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``test_id, language, reports``; a record needs an id, a known language if any, and a report."""
    schema = "test_id string, language string, duration_ms bigint, coverage_report string, coverage_reports array<string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    reports = F.array_compact(F.concat(F.array("coverage_report"), F.coalesce("coverage_reports", F.array().cast("array<string>"))))
    ok = (F.trim("test_id") != "") & (F.col("language").isNull() | F.col("language").isin("java", "python")) & (F.size(reports) > 0)
    return rows.select("test_id", "language", "duration_ms", reports.alias("reports"), F.coalesce(ok, F.lit(False)).alias("ok")).filter(F.assert_true("ok", F.concat(F.lit("bad manifest record: "), F.coalesce("test_id", F.lit("")))).isNull()).drop("ok")


def planned_tasks(spark: SparkSession, *, tasks_json: str | None = None, tests_file: str | None = None, impact_json: str | None = None) -> DataFrame:
    """``id, tags`` of exactly one source: a JSON task list, a file with one id a line, or the JSON of an impact result."""
    if sum(x is not None for x in (tasks_json, tests_file, impact_json)) != 1:
        raise ValueError("give exactly one of tasks_json, tests_file and impact_json")
    none = F.array().cast("array<string>").alias("tags")
    if tests_file is not None:
        rows = spark.read.text(tests_file).select(F.trim("value").alias("id"), none)
    elif impact_json is not None:
        read = spark.read.schema("selected_tests array<string>").option("mode", "FAILFAST").option("multiLine", "true").json(impact_json)
        rows = read.select(F.explode("selected_tests").alias("id"), none)
    else:
        read = spark.read.schema("tasks array<struct<id: string, tags: array<string>>>").option("mode", "FAILFAST").option("multiLine", "true").json(tasks_json)
        rows = read.select(F.explode("tasks").alias("t")).select(F.trim("t.id").alias("id"), F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"))
    return rows.filter("id <> ''")


def source_lines(spark: SparkSession, root: str, *, glob: str = "*", skip: str = r"/(vendor|node_modules|target|dist|\.git)/", most_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """``path, line, text`` of the text files below ``root``; vendored, large, empty and binary files are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    raw = raw.filter((F.col("length") > 0) & (F.col("length") <= most_bytes) & ~F.col("path").rlike(skip))
    text = raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("t")).filter("t is not null and instr(t, chr(0)) = 0")
    return text.select("path", F.posexplode(F.split("t", "\r?\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


READERS = {"lcov": lcov_lines, "gocov": gocov_lines, "llvmcov": llvmcov_lines, "jacoco": jacoco_lines, "cobertura": cobertura_lines}


def coverage(files: DataFrame, *, fmt: str | None = None) -> DataFrame:
    """``path, line, covered, format`` of files of any mix of formats, or of the one given."""
    kinds = detect(files)
    out = None
    for name, reader in READERS.items():
        own = files if fmt == name else files.join(kinds.filter(F.col("format") == name), "path", "left_semi") if fmt is None else None
        if own is not None:
            part = reader(own).withColumn("format", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"unknown format {fmt}")
    return out
