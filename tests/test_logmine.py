"""Log entries: against plain line-by-line parsing of the known layouts, and edge cases."""

import calendar
import json
import re
from datetime import datetime, timedelta

from artefold.operators import logmine

T = r"(?P<t>\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)\S*?"
MON = dict(zip("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), range(1, 13)))
HEADS = [
    re.compile(p)
    for p in (
        r"(?P<mond>[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ (?P<c>[\w-]+)\[\d+\]: <(?P<l>\w+)>",
        r"(?P<dmy>\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d)  (?P<c>[\w-]+) +(?P<l>\w+)",
        rf"{T}Z (?P<l>\w+) \[(?P<c>[\w-]+)\]",
        rf"{T}(?P<z>[+-]\d\d:\d\d) ##\[(?P<l>\w+)\](?P<c>[\w-]+)\(",
        r"(?P<e>\d{10})\|(?P<l>\w)\|(?P<c>[\w-]+)\|",
        r"(?P<clock>\d\d:\d\d:\d\d) (?P<c>[\w-]+) \| (?P<l>\w+)\[",
        r"(?P<dmony>\d\d-\w{3}-\d{4} \d\d:\d\d:\d\d)\S* (?P<l>\w+) \[[^\]]*\] \{(?P<c>[\w-]+)\}",
        rf"\[{T},\d+\] (?P<c>[\w-]+)\.(?P<l>\w+):",
        rf"(?P<l>\w+) {T} (?P<z>[+-]\d{{4}}) (?P<c>[\w-]+):",
    )
]
NOISE = re.compile(r"==== step .*====$| *\d+% \[#*\]$|\s*$")


def _moment(g, started):
    at = lambda s, f: datetime.strptime(s, f)
    if g.get("e"):
        return int(g["e"])
    if g.get("mond"):
        t = at(f"{started.year} {g['mond']}", "%Y %b %d %H:%M:%S")
        t = t if t >= started else t.replace(year=t.year + 1)
    elif g.get("clock"):
        t = at(f"{started.date()} {g['clock']}", "%Y-%m-%d %H:%M:%S")
        t = t if t >= started else t + timedelta(days=1)
    elif g.get("dmy"):
        t = at(g["dmy"], "%d.%m.%Y %H:%M:%S")
    elif g.get("dmony"):
        t = at(g["dmony"], "%d-%b-%Y %H:%M:%S")
    else:
        t = at(g["t"].replace("T", " "), "%Y-%m-%d %H:%M:%S")
    seconds = calendar.timegm(t.timetuple())
    if g.get("z"):
        z = g["z"].replace(":", "")
        seconds -= int(z[0] + "1") * (int(z[1:3]) * 3600 + int(z[3:]) * 60)
    return seconds


def _severity(level):
    low = level.lower()
    if low in ("error", "err", "fatal", "critical", "severe", "e", "f"):
        return "error"
    return "warning" if low in ("warn", "warning", "w") else "note"


def brute(lines, started):
    """{report: {line_no: text}} -> the rows of p2_found."""
    out = []
    for report, by in lines.items():
        entry = None
        texts = {n: re.sub(r"\x1b\[[0-9;]*m", "", t or "").rstrip("\r\n") for n, t in by.items()}
        for n in sorted(texts):
            t, g = texts[n], None
            if t.startswith('{"'):
                d = json.loads(t)
                g = {"e": d["time"] // 1000, "l": d["severity"], "c": d["logger"]}
            elif t == "{":
                block = []
                for k in sorted(x for x in texts if x >= n):
                    block.append(texts[k])
                    if texts[k] == "}":
                        break
                d = json.loads("".join(block))
                g = {"e": d["time"] // 1000, "l": d["severity"], "c": d["logger"]}
            elif re.match(r"\w+=", t):
                pairs = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)', t))
                g = {"t": pairs["ts"].rstrip("Z"), "l": pairs["lvl"], "c": pairs["comp"]}
            else:
                m = next((m for h in HEADS if (m := h.match(t))), None)
                g = m and m.groupdict()
            if g:
                entry = [report, n, n, _moment(g, started[report]), _severity(g["l"]), g["c"].lower()]
                out.append(entry)
            elif entry and not NOISE.match(t):
                entry[2] = n
    return sorted(tuple(x) for x in out)


def test_found_equals_brute_force(spark, small):
    lines, reports = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("diag_lines", "diag_reports"))
    by, started = {}, {r.report_id: r.started_at for r in reports.collect()}
    for r in lines.collect():
        by.setdefault(r.report_id, {})[r.line_no] = r.text
    got = logmine.entries(lines, reports, logmine.heads(lines)).select("report_id", "first_line", "last_line", "ts_unix", "severity", "component")
    assert sorted(tuple(r) for r in got.collect()) == brute(by, started)


def _parse(spark, *texts, started=datetime(2025, 12, 31, 23, 59, 0)):
    lines = spark.createDataFrame([(i, "r", i + 1, None, t) for i, t in enumerate(texts)], "line_uid long, report_id string, line_no int, received_at timestamp, text string")
    reports = spark.createDataFrame([("r", started)], "report_id string, started_at timestamp")
    return sorted(logmine.entries(lines, reports, logmine.heads(lines)).collect())


def test_incomplete_times_pass_the_turn_of_the_year(spark):
    got = _parse(spark, "Jan  1 00:00:05 runner-1 lintel[5]: <warn> a/b.c:7: slow [no-slow]", "00:01:00 lintel | error[LIN-001]: bad", "         |   --> a/b.py:3:4", "Dec 31 23:59:30 runner-1 lintel[5]: <info> a/b.c:7: x y")
    assert [(r.ts_unix, r.severity) for r in got] == [(1767225605, "warning"), (1767225660, "error"), (1767225570, "note")]
    assert [(r.issue_path, r.issue_line, r.rule_id) for r in got] == [("a/b.c", 7, "no-slow"), ("a/b.py", 3, "LIN-001"), ("a/b.c", 7, None)]


def test_leap_day_waits_for_the_next_leap_year(spark):
    assert _parse(spark, "Feb 29 00:00:05 runner-1 lintel[5]: <warn> x", started=datetime(2025, 3, 1))[0].ts_unix == calendar.timegm((2028, 2, 29, 0, 0, 5))


def test_blank_tails_noise_nulls_and_lines_before_the_first_head(spark):
    got = _parse(spark, "stray", "1746127887|E|gantryci|no-shared|a/b.py|272|nightly index", "+more", "==== step 1 of 2: map ====", "+last", "", " 38% [####]", None)
    assert [(r.first_line, r.last_line, r.component, r.message, r.issue_line) for r in got] == [(2, 5, "gantryci", "nightly index", 272)]


def test_empty_table_and_repeated_rows(spark):
    assert _parse(spark) == []
    lines = spark.createDataFrame([(i, "r", 1, None, "00:01:00 lintel | error[LIN-001]: bad\r") for i in range(3)], "line_uid long, report_id string, line_no int, received_at timestamp, text string")
    none = spark.createDataFrame([], "report_id string, started_at timestamp")
    assert [(r.first_line, r.ts_unix) for r in logmine.entries(lines, none, logmine.heads(lines)).collect()] == [(1, None)]


def test_templates_have_constants_and_slots():
    a, b = logmine.symbols("took 5 ms in run"), logmine.symbols("took 7 ms for gate")
    t = logmine.with_slots(a, logmine.common(a, b))
    assert t == ["took", "<int>", "ms", "*"]
    assert len(logmine.clustered([logmine.Template(a, 1, ["took 5 ms in run"]), logmine.Template(b, 1, ["took 7 ms for gate"])])) == 1


NEW = "2025/03/13 05:34:{s:02d}.5 {{{c}}} <{l}> n={s} {m}"


def test_a_layout_and_levels_not_seen_before(spark):
    """Slots decide: a level word of no list stands where the others stand, hosts with digits are no component."""
    words = ["ERROR", "WARN", "BLOCKER", "INFO", "ERROR", "WARN", "INFO", "ERROR", "INFO", "WARN"]
    texts = [NEW.format(s=s, c=["brontide", "Lathe"][s % 2], l=words[s], m=["slow probe", "no map for it", "bad"][s % 3]) for s in range(10)]
    got = _parse(spark, *[x for t in texts for x in (t, "  more")])
    assert [(r.first_line, r.last_line, r.severity, r.component) for r in got] == [(2 * s + 1, 2 * s + 2, "error" if words[s] == "ERROR" else "warning" if words[s] == "WARN" else "note", ["brontide", "lathe"][s % 2]) for s in range(10)]
    assert got[3].ts_unix == calendar.timegm((2025, 3, 13, 5, 34, 3))


def test_without_clustering_heads_are_others(spark, monkeypatch):
    """A lone line with an unknown level word has no head of its own; its template gives it one."""
    lone = logmine.Template(logmine.symbols(t := NEW.format(s=2, c="brontide", l="BLOCKER", m="x")), 1, [t])
    assert logmine.head_of(lone) is None
    more = [NEW.format(s=s, c="brontide", l="ERROR", m="x") for s in range(3)]
    (merged,) = logmine.clustered([lone, *[logmine.Template(logmine.symbols(x), 1, [x]) for x in more]])
    assert logmine.head_of(merged)


def test_keys_by_what_they_hold(spark):
    texts = [json.dumps({"zeit": f"2025-03-13T05:34:0{s}Z", "stufe": ["ERROR", "info"][s % 2], "programm": "lathe", "text": f"probe {s} is slow"}) for s in range(6)]
    assert [(r.severity, r.component) for r in _parse(spark, *texts)] == [("error", "lathe"), ("note", "lathe")] * 3


def test_seconds_do_not_depend_on_the_zone_of_the_session(spark, small):
    lines, reports = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("diag_lines", "diag_reports"))
    get = lambda: sorted(tuple(r) for r in logmine.entries(lines, reports, logmine.heads(lines)).select("report_id", "first_line", "ts_unix").collect())
    want = get()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert get() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


NAMES = [a + b + c for a in ("al", "be", "cor", "du", "em", "fa", "go", "hi", "iv", "jo") for b in "aeiouxyzkr" for c in ("na", "ter", "vin", "los", "mik")]


def test_every_line_decides_what_a_place_holds(spark):
    """All lines are of one shape; few of them can't tell the many users at the first place of names from the two programs at the second."""
    texts = [f"2025-03-13T05:{s // 60:02d}:{s % 60:02d}Z ERROR <{who}> {{{['brontide', 'lathe'][s % 2]}}}: slow probe" for s, who in enumerate(NAMES)]
    got = _parse(spark, *texts)
    assert [r.component for r in got] == ["brontide", "lathe"] * (len(texts) // 2)


def test_a_rare_line_is_seen_in_its_template(spark):
    """One line in 3000 has another word, so the word is no constant."""
    lines = spark.createDataFrame([(f"step {'opened' if k == 1234 else 'closed'} at {k} ms",) for k in range(3000)], "text string")
    assert [(r.template, r.n, r.head) for r in logmine.mine(lines.repartition(3)).collect()] == [(["step", "*", "at", "<int>", "ms"], 3000, None)]


def test_all_lines_count_however_often_counts_are_handed_on(spark, small):
    lines = spark.read.parquet(f"{small}/diag_lines.parquet")
    full = lines.select(logmine.cleaned(lines["text"]).alias("line")).filter("trim(line) <> ''").count()
    once, often = logmine.mine(lines).collect(), logmine.mine(lines, held=400).collect()
    assert sum(r.n for r in once) == sum(r.n for r in often) == full
    assert {str(r.head) for r in once} == {str(r.head) for r in often}


def test_a_line_without_a_level_leaves_the_head(spark):
    """It shares the template; the places of the other lines stay."""
    texts = [NEW.format(s=s, c=["brontide", "lathe"][s % 2], l="ERROR", m="x") for s in range(40)] + ["2025/03/13 05:34:59.5 {lathe} <> n=3 x"]
    assert len([r for r in logmine.counted(dict.fromkeys(texts, 1))]) == 2 == 1 + len(logmine.clustered([t for _, t in logmine.counted(dict.fromkeys(texts, 1))]))
    assert [r.component for r in _parse(spark, *texts)] == ["brontide", "lathe"] * 20


def test_a_line_without_a_time_leaves_the_head(spark):
    texts = [f"{['WARN', 'INFO'][s % 2]} 2025-03-13 05:34:{s:02d} -0800 lathe: slow probe n={s}" for s in range(40)]
    shapes = [t for _, t in logmine.counted(dict.fromkeys([*texts, "INFO lathe: slow probe n=3"], 1))]
    timed = max(logmine.clustered(shapes, least=0.3), key=lambda t: t.n)
    assert timed.n == 41 and logmine.head_of(timed)
