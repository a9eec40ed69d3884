"""Entries of semi-structured logs by template mining.

``mine`` clusters the lines.  Every line is read: lines of one shape, the same
types of tokens in the same order, are counted together with what stands at
their places, so a frequent shape costs one row.  The shapes are clustered by
longest common subsequence within each partition, and the partitions' templates
are merged by the same rule.  What all lines of a template have in common are
its constants, the gaps between them its variable slots.

The places of a template are classified by counts of what fills them over all
its lines: times, levels, repeated identifiers.  A template with a time, a
level and a component begins an entry, and its head is compiled to one
expression.
``entries`` parses all lines by these heads in the JVM and joins following
lines to the entry before them.  Only heads reach the driver; they hold
layouts, not data.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artefold.functions.times import utc_seconds
from artefold.operators.segments import carry_previous
from artefold.session import written

# Words for levels, by severity.
LEVELS = {
    "error": ("error", "err", "fatal", "critical", "crit", "severe", "panic", "alert", "emerg", "emergency", "failure"),
    "warning": ("warning", "warn"),
    "note": ("note", "notice", "info", "information", "hint", "debug", "trace", "verbose", "fine", "finer", "finest", "config"),
}
# One-letter levels.
LETTERS = {"E": "error", "F": "error", "C": "error", "A": "error", "W": "warning", "N": "note", "I": "note", "D": "note", "T": "note", "V": "note", "H": "note"}
# Keys of structured lines.
TIME_KEYS = ("time", "ts", "timestamp", "at", "@timestamp", "date", "datetime", "when")
LEVEL_KEYS = ("severity", "lvl", "level", "sev", "loglevel")
COMPONENT_KEYS = ("logger", "comp", "component", "program", "app", "tool", "module", "source", "service", "name")
MESSAGE_KEYS = ("msg", "message", "text", "event")
RULE_KEYS = ("rule", "rule_id", "code", "check")
LINE_KEYS = ("line", "lineno", "line_no")

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
#: Layouts of times, most telling first; each has an expression in ``_unix``.
TIMES = {
    "iso": rf"\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?: ?(?:Z|[+-]\d{{2}}:?\d{{2}}))?",
    "ymd": rf"\d{{4}}[/.]\d{{2}}[/.]\d{{2}}[T ]{_CLOCK}",
    "dmy": rf"\d{{2}}\.\d{{2}}\.\d{{4}} {_CLOCK}",
    "dmony": rf"\d{{1,2}}[-/ ](?:{MONTHS})[-/ ]\d{{4}} {_CLOCK}",
    "mond": rf"(?:{MONTHS}) [ \d]\d {_CLOCK}",
    "clock": _CLOCK,
    "epoch": r"\d{10}(?:\.\d+)?(?!\d)",
    "epoch_ms": r"\d{13}(?!\d)",
}
_LEVEL = "|".join(w for ws in LEVELS.values() for w in ws)
_LEVEL_WORDS = {w for ws in LEVELS.values() for w in ws}
_INITIALS = "".join(sorted({c for w in _LEVEL_WORDS for c in w[0] + w[0].upper()}))
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?=\d)(?:"
    + "|".join(f"(?P<{n}>{p})" for n, p in TIMES.items() if n != "mond")
    + rf")|(?P<mond>{TIMES['mond']})|(?=[{_INITIALS}])(?P<level>(?i:{_LEVEL})(?![\w/-]))|(?P<path>[\w.-]++/[\w./-]+)|(?P<word>[A-Za-z][\w-]*)|(?P<int>\d+)|(?P<punct>.)"
)
_NAME = re.compile(r"[A-Za-z][A-Za-z_-]*")
_STAMPS = {n: re.compile(p) for n, p in TIMES.items()}
GONE = ("gone", "", False)  # lines that have nothing at a place
HELD = 500_000  # values a partition holds before it hands on what it counted
MARK = "\x01"
ANSI = r"\x1B\[[0-9;?]*[A-Za-z]"
STRUCTURED = r'^(?:\{\s*"|\w+=(?:"|\S)(?:.*\s)?\w+=)'
PAIR = re.compile(r'(?:"(?P<jk>[^"]+)"\s*:\s*|(?<![\w"])(?P<lk>[A-Za-z_@][\w.@-]*)=)(?:"(?P<q>(?:[^"\\]|\\.)*)"|(?P<b>[^\s,{}"]+))')
BANNER = r"^\s*([=*#~-])\1{2,}.*\1{3,}\s*$"
PROGRESS = r"^\s*\d{1,3}(?:\.\d+)?\s?%\s*[\[(|].*[\])|]?\s*$"


@dataclass(frozen=True)
class Head:
    """A compiled layout: ``kind`` text, json, pairs or block; for text, the regex with groups time, level, component, message in ``groups``."""

    kind: str
    layout: str
    pattern: str
    groups: tuple[int, ...]
    support: int


@dataclass
class Template:
    """``symbols`` with ``*`` for slots, the number of lines and what stands at their places.

    ``lines`` are lines that are counted at once.  ``places`` counts, for each
    token from the left, (type, text, whether white space is before it), or
    ``GONE``; ``fixed`` has the constant at each place or None, and ``whole``
    tells whether all lines end behind the last place.  For structured lines,
    of the ``style`` json or pairs, ``places`` counts the values of each key.
    It is None for lines that can't begin an entry.
    """

    symbols: list[str]
    n: int
    lines: Iterable[str] = ()
    places: list[Counter] | dict[str, Counter] | None = None
    fixed: list[str | None] | None = None
    whole: bool = True
    style: str = "text"

    def __post_init__(self) -> None:
        self.constants = [x for x in self.symbols if x != "*"]
        self.bag = Counter(self.constants)
        for _, t in counted(Counter(self.lines)):
            if self.fixed is None:
                self.places, self.fixed, self.whole, self.style = t.places, t.fixed, t.whole, t.style
            else:
                self.places, self.fixed, self.whole = aligned(self, t, common(self.constants, t.constants))


def tokens(line: str) -> list[tuple[str, str, bool]]:
    """(type, text, whether white space is before it) of the tokens of a line."""
    out, spaced = [], False
    for m in _TOKEN.finditer(line):
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group(), spaced))
        spaced = m.lastgroup == "space"
    return out


def pairs_of(line: str) -> dict[str, str]:
    """The pairs of a structured line."""
    return {m["jk"] or m["lk"]: m["q"] if m["q"] is not None else m["b"] for m in PAIR.finditer(line)}


def symbol(kind: str, text: str) -> str:
    """What is compared of a token: its literal, but its type for times, levels, numbers and paths."""
    return f"<{kind}>" if kind in TIMES or kind in ("level", "int", "path") else text


def symbols(line: str) -> list[str]:
    """What is compared of a line; structured lines by key."""
    if re.match(STRUCTURED, line):
        return [x for k in sorted(pairs_of(line)) for x in (k, "<value>")]
    return [symbol(t, x) for t, x, _ in tokens(line)]


def bucket_of(row: list[tuple[str, str, bool]]) -> str:
    """Lines of one layout begin alike: the first three tokens by type."""
    first = row[:3]
    return " ".join(x if t == "punct" else "w" if t in ("word", "level") else t for t, x, _ in first) + ("" if first and not first[0][2] else " indented")


def value_of(text: str) -> tuple[str, str, bool]:
    """(type, text, False) of the value of a key; only names keep their text."""
    if _NAME.fullmatch(text):
        return "word", text, False
    return next((n for n, p in _STAMPS.items() if p.fullmatch(text)), "other"), "", False


class Shapes:
    """Counts of lines by shape; names are counted by text, words that are no names by their type."""

    def __init__(self) -> None:
        self.texts: dict[tuple, list] = {}
        self.keyed: dict[tuple, list] = {}
        self.held = 0  # size of what is counted

    def add(self, line: str, n: int) -> None:
        if (line[0] == "{" or "=" in line) and re.match(STRUCTURED, line):
            return self._add_pairs(line, n)
        row = tokens(line)
        key = tuple([(x if t == "punct" else t, s) for t, x, s in row])
        words = [x for t, x, _ in row if t == "word"]
        known = self.texts.get(key)
        if known is None:
            # only these can begin an entry: see head_of
            begins = bool(row) and not row[0][2] and any(t in TIMES for t, _, _ in row[:4])
            known = self.texts[key] = [0, row, words[:], [{} for _ in words] if begins else None]
            self.held += len(row)
        known[0] += n
        if known[2] != words:
            known[2] = [a if a == b else None for a, b in zip(known[2], words)]
        if known[3] is not None:
            for names, x in zip(known[3], words):
                x = x if x.isalpha() or _NAME.fullmatch(x) else ""
                if x in names:
                    names[x] += n
                else:
                    names[x] = n
                    self.held += 1

    def _add_pairs(self, line: str, n: int) -> None:
        pairs = pairs_of(line)
        key = ("json" if line.startswith("{") else "pairs", *sorted(pairs))
        known = self.keyed.get(key)
        if known is None:
            known = self.keyed[key] = [0, {k: Counter() for k in key[1:]}]
            self.held += len(key)
        known[0] += n
        for at, (k, text) in enumerate(pairs.items()):
            value, counts = value_of(text), known[1][k]
            self.held += value not in counts
            counts[value] += n
            counts["place"] += at * n

    def templates(self) -> Iterator[tuple[str, Template]]:
        """(bucket, template) of each shape."""
        for n, row, words, names in self.texts.values():
            rest, fixed = iter(words), []
            for t, x, _ in row:
                fixed.append(next(rest) if t == "word" else symbol(t, x))
            places = None
            if names is not None:
                found = iter(names)
                places = [Counter({("word", x, s): k for x, k in next(found).items()} if t == "word" else {(t, x if t == "punct" else "", s): n}) for t, x, s in row]
            yield bucket_of(row), Template(slotted(fixed), n, places=places, fixed=fixed)
        for (style, *keys), (n, places) in self.keyed.items():
            seq = [x for k in keys for x in (k, "<value>")]
            yield f"{style}:{min(keys, default='')}", Template(seq, n, places=places, fixed=[], style=style)


def counted(lines: dict[str, int]) -> Iterator[tuple[str, Template]]:
    """(bucket, template) of each shape of so many lines."""
    shapes = Shapes()
    for line, n in lines.items():
        shapes.add(line, n)
    return shapes.templates()


def slotted(fixed: list[str | None]) -> list[str]:
    """The symbols of places, one slot for places in a row without a constant."""
    out: list[str] = []
    for x in fixed:
        if x is not None:
            out.append(x)
        elif not out or out[-1] != "*":
            out.append("*")
    return out


def aligned(a: Template, b: Template, constants: list[str]) -> tuple[list | dict | None, list | None, bool]:
    """``places`` (changed in place), ``fixed`` and ``whole`` of two templates as one with these common constants.

    Places agree up to the first gap between constants that differs in
    length.  Behind it those of ``a``, which has more lines, stay, and the
    lines of ``b`` are gone there.  Lines that can't begin an entry are gone
    everywhere.
    """
    if a.places is None or b.places is None:
        own, other = (a, b) if b.places is None else (b, a)
        for x in own.places or ():
            x[GONE] += other.n
        rest = iter([*constants, None])
        c, kept = next(rest), []
        for x in own.fixed:
            kept.append(x if x == c else None)
            c = next(rest) if x is not None and x == c else c
        return own.places, kept, own.whole
    if isinstance(a.places, dict):
        for k, counts in b.places.items():
            a.places.setdefault(k, Counter()).update(counts)
        return a.places, [], True
    i = j = 0
    fixed: list[str | None] = []
    same = True
    for c in [*constants, None]:
        to, up = i, j
        while to < len(a.fixed) and (c is None or a.fixed[to] != c):
            to += 1
        while up < len(b.fixed) and (c is None or b.fixed[up] != c):
            up += 1
        gap = min(to - i, up - j)
        fixed += [None] * gap
        same = to - i == up - j and (to < len(a.fixed)) == (up < len(b.fixed))
        i, j = i + gap, j + gap
        if not same or to == len(a.fixed):
            break
        fixed.append(c)
        i, j = to + 1, up + 1
    for x, y in zip(a.places[: len(fixed)], b.places):
        x.update(y)
    for x in a.places[len(fixed) :]:
        x[GONE] += b.n
    return a.places, fixed + [None] * (len(a.places) - len(fixed)), same and a.whole and b.whole


def common(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence of two templates; ``*`` matches nothing."""
    width = len(b) + 1
    rows = [[0] * width]
    for x in a:
        last, row = rows[-1], [0] * width
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y and x != "*" else (last[j] if last[j] >= row[j - 1] else row[j - 1])
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and a[i - 1] != "*":
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def with_slots(template: list[str], constants: list[str]) -> list[str]:
    """``template`` reduced to ``constants``, a variable slot ``*`` in each gap."""
    out, k = [], 0
    for x in template:
        if k < len(constants) and x == constants[k]:
            out.append(x)
            k += 1
        elif not out or out[-1] != "*":
            out.append("*")
    return out


def holds(constants: list[str], seq: list[str]) -> bool:
    """Whether ``constants`` is a subsequence of ``seq``."""
    rest = iter(seq)
    return all(x in rest for x in constants)


def clustered(given: list[Template], least: float = 0.5) -> list[Template]:
    """Each joins the template it shares most with, at least ``least`` of the longer one's constants; the best supported come first."""
    found: list[Template] = []
    for g in sorted(given, key=lambda t: (-t.n, t.symbols)):
        best, best_at, size = [], None, len(g.constants)
        for at, t in enumerate(found):
            need = max(least * max(size, len(t.constants)), len(best) + 1)
            if (g.bag & t.bag).total() < need:  # no subsequence can be longer
                continue
            lcs = t.constants if holds(t.constants, g.constants) else common(t.constants, g.constants)
            if len(lcs) >= need:
                best, best_at = lcs, at
        if best_at is None:
            own = {k: Counter(c) for k, c in g.places.items()} if isinstance(g.places, dict) else g.places and [Counter(c) for c in g.places]
            found.append(Template(g.symbols, g.n, (), own, g.fixed, g.whole, g.style))
        else:
            t = found[best_at]
            kept = t.symbols if len(best) == len(t.constants) and "*" in t.symbols else with_slots(t.symbols, best)
            places, fixed, whole = aligned(t, g, best)
            found[best_at] = Template(kept if len(best) < len(g.constants) or "*" in g.symbols or kept != t.symbols else t.symbols, t.n + g.n, (), places, fixed, whole, t.style)
    return found


def columns(template: Template) -> list[Counter | None]:
    """What fills the places from the left; None from where more than a tenth of the lines have nothing that belongs there, or where they end differently."""
    out: list[Counter | None] = []
    for col in template.places or ():
        if col[GONE] > 0.1 * template.n:
            return [*out, None]
        out.append(Counter({t: k for t, k in col.items() if t != GONE}))
    return out if template.whole else [*out, None]


def _share(column: Counter, test) -> float:
    return sum(k for t, k in column.items() if test(t)) / column.total()


def _is_name(kind: str, text: str) -> bool:
    return kind == "word" and bool(text)


def _repeats(column: Counter) -> bool:
    """A small vocabulary: at most half as many names as lines; as many as 32 may come once in few lines."""
    return len({t[1].lower() for t in column if _is_name(*t[:2])}) <= max(32, column.total() // 2)


def structured_head(template: Template) -> tuple[str, str, str, tuple[int, ...]] | None:
    """The head of a template of pairs: keys by what their values are, a time and a component in at least nine of ten lines; the names of keys only break ties."""
    at = {k: c["place"] / (c.total() - c["place"]) for k, c in template.places.items()}  # on average
    of = {k: Counter({v: m for v, m in template.places[k].items() if v != "place"}) for k in sorted(at, key=lambda k: (at[k], k))}
    share = lambda k, test: sum(m for v, m in of[k].items() if test(v)) / template.n
    named = lambda names: sorted(of, key=lambda k: (k not in names, names.index(k) if k in names else 0))
    timed = {k: n for k in of for n in TIMES if share(k, lambda v: v[0] == n) >= 0.9}
    time = next((k for k in named(TIME_KEYS) if k in timed), None)
    levels = {k: share(k, lambda v: v[1].lower() in _LEVEL_WORDS) for k in of}
    level = max((k for k in named(LEVEL_KEYS) if levels[k] >= 0.5), key=levels.get, default=None)
    rest = [k for k in named(COMPONENT_KEYS) if k not in (time, level) and share(k, lambda v: _is_name(*v[:2])) >= 0.9 and _repeats(of[k])]
    if not (time and level and rest):
        return None
    # of several, a usual name, then the least vocabulary
    component = rest[0] if rest[0] in COMPONENT_KEYS else min(rest, key=lambda k: len(of[k]))
    return template.style, timed[time], f"{time}|{level}|{component}", ()


def head_of(template: Template) -> tuple[str, str, str, tuple[int, ...]] | None:
    """(kind, layout, pattern, groups) if the slots and constants of the template make its lines the first of an entry, else None.

    The time is the first place that is a time of one layout in at least nine
    of ten lines, at most three tokens into the line.  The level is the first
    place where at least half of the values are words for levels, or nine of
    ten are letters for them between bars; other words at that place are then
    levels too.  The component is the first place behind the time that holds
    names from a small vocabulary.
    """
    if template.style != "text":
        return structured_head(template)
    if template.symbols == ["{"]:
        return "block", "", "", ()
    cols = columns(template)
    if not cols or cols[0] is None or any(t[2] for t in cols[0]):
        return None
    roles: dict[str, int] = {}
    barred = lambda col: bool(col) and _share(col, lambda t: t[1] == "|") >= 0.9
    lettered = lambda i: 0 < i < len(cols) - 1 and barred(cols[i - 1]) and barred(cols[i + 1]) and _share(cols[i], lambda t: t[1] in LETTERS) >= 0.9
    layout = ""
    for i, col in enumerate(cols):
        if col is None:
            break
        stamp = next((n for n in TIMES if _share(col, lambda t: t[0] == n) >= 0.9), None)
        if "time" not in roles and stamp:
            roles["time"], layout = i, stamp
        elif "level" not in roles and (_share(col, lambda t: t[0] == "level") >= 0.5 or lettered(i)):
            roles["level"] = i
        elif "time" in roles and "component" not in roles and _share(col, lambda t: _is_name(*t[:2])) >= 0.9 and _repeats(col):
            roles["component"] = i
        if len(roles) == 3:
            break
    if len(roles) < 3 or roles["time"] > 3:
        return None
    end, pattern, order = max(roles.values()), "^", []
    at = {i: r for r, i in roles.items()}
    for i, col in enumerate(cols[: end + 2]):
        if col is None:
            break
        spaces = {t[2] for t in col}
        between = "" if i == 0 or spaces == {False} else r"\s+" if spaces == {True} else r"\s*"
        kinds = {t[0] for t in col}
        if i > end:
            same = {t[1] for t in col}
            pattern += between if spaces == {True} else re.escape(same.pop()) if len(same) == 1 and kinds == {"punct"} else r"\b"
            break
        pattern += between
        role = at.get(i)
        if role:
            order.append(role)
            pattern += {"time": f"({TIMES[layout]})", "level": r"([A-Za-z]+)", "component": r"([A-Za-z][A-Za-z_-]*)"}[role]
        elif kinds == {"punct"}:
            same = {t[1] for t in col}
            pattern += re.escape(same.pop()) if len(same) == 1 else r"\S"
        else:
            pattern += r"\d+" if kinds == {"int"} else r"\S+?"
    if end + 1 >= len(cols) or cols[end + 1] is None:
        pattern += r"\b"
    pattern += "(.*)$"
    return "text", layout, pattern, tuple(order.index(r) + 1 for r in ("time", "level", "component"))


def cleaned(text: Column) -> Column:
    """A line without colour codes, line ends and the mark that parsing uses."""
    return F.regexp_replace(F.regexp_replace(text, ANSI, ""), rf"[\r\n]+$|{MARK}", "")


def mine(lines: DataFrame, *, text: str = "text", held: int = HELD) -> DataFrame:
    """``bucket, template, n, head``: the templates of all lines.

    ``head`` is the compiled head of a template whose lines begin entries,
    else null.  A partition hands on its templates whenever it has counted
    ``held`` values, so that its memory is bounded.
    """
    part = "bucket string, style string, template array<string>, n bigint, fixed array<string>, whole boolean, places binary"
    done = "bucket string, template array<string>, n bigint, head struct<kind:string,layout:string,pattern:string,groups:array<int>>"

    def handed(shapes: Shapes) -> pd.DataFrame:
        by: dict[str, list[Template]] = defaultdict(list)
        for b, t in shapes.templates():
            by[b].append(t)
        rows = [(b, t.style, t.symbols, t.n, t.fixed, t.whole, pickle.dumps(t.places)) for b, own in by.items() for t in clustered(own)]
        return pd.DataFrame(rows, columns=["bucket", "style", "template", "n", "fixed", "whole", "places"])

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for pdf in batches:
            for line, n in Counter(pdf["line"]).items():
                shapes.add(line, n)
                if shapes.held >= held:
                    yield handed(shapes)
                    shapes = Shapes()
        yield handed(shapes)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        given = [Template(list(t), int(n), (), pickle.loads(p), list(f), bool(w), s) for s, t, n, f, w, p in zip(pdf["style"], pdf["template"], pdf["n"], pdf["fixed"], pdf["whole"], pdf["places"])]
        rows = []
        for t in clustered(given):
            h = head_of(t)
            rows.append((key[0], t.symbols, t.n, h and {"kind": h[0], "layout": h[1], "pattern": h[2], "groups": list(h[3])}))
        return pd.DataFrame(rows, columns=["bucket", "template", "n", "head"])

    read = lines.select(cleaned(F.col(text)).alias("line")).filter("trim(line) <> ''")
    return read.mapInPandas(partition, part).groupBy("bucket").applyInPandas(merge, done)


def heads(lines: DataFrame, *, text: str = "text") -> list[Head]:
    """The distinct heads of the mined templates, best supported first."""
    mined = mine(lines, text=text).filter("head is not null").groupBy("head.kind", "head.layout", "head.pattern", "head.groups").agg(F.sum("n").alias("n"))
    return [Head(r.kind, r.layout, r.pattern, tuple(r.groups), r.n) for r in mined.orderBy(F.desc("n"), "kind", "layout", "pattern").collect()]


def _unix(layout: str, text: Column, started: Column) -> Column:
    """Whole Unix seconds of a time; what its layout leaves out makes it the first such moment at or after ``started``, in Unix seconds."""
    part = lambda pattern, g=1: F.regexp_extract(text, pattern, g)
    number = lambda pattern, g=1: part(pattern, g).try_cast("int")
    clock = r"(\d{2}):(\d{2}):(\d{2})"
    inside = number(clock, 1) * 3600 + number(clock, 2) * 60 + number(clock, 3)
    clocked = F.when((number(clock, 1) < 24) & (number(clock, 2) < 60) & (number(clock, 3) < 60), inside)
    month = lambda name: F.lpad(((F.instr(F.lit(MONTHS.replace("|", "")), name) + 2) / 3).cast("int").cast("string"), 2, "0")
    epoch = F.lit("1970-01-01").cast("date")
    stamp = lambda day: F.datediff(day.try_cast("date"), epoch).cast("bigint") * 86400 + clocked
    if layout == "iso":
        sign = F.when(part(r"([+-])\d{2}:?\d{2}$") == "-", -1).otherwise(1)
        offset = F.coalesce(number(r"[+-](\d{2}):?\d{2}$") * 3600 + number(r"[+-]\d{2}:?(\d{2})$") * 60, F.lit(0))
        zoned = text.rlike(r":\d{2}(?:[.,]\d+)? ?[+-]\d{2}:?\d{2}$")
        return stamp(part(r"^(\d{4}-\d{2}-\d{2})")) - F.when(zoned, sign * offset).otherwise(0)
    if layout == "ymd":
        return stamp(F.concat_ws("-", part(r"^(\d{4})"), part(r"^\d{4}.(\d{2})"), part(r"^\d{4}.\d{2}.(\d{2})")))
    if layout == "dmy":
        return stamp(F.concat_ws("-", part(r"(\d{4})"), part(r"\.(\d{2})\."), part(r"^(\d{2})")))
    if layout == "dmony":
        return stamp(F.concat_ws("-", part(r"[-/ ](\d{4}) "), month(part(rf"({MONTHS})")), F.lpad(part(r"^(\d{1,2})"), 2, "0")))
    today = F.floor(started / 86400)
    if layout == "mond":
        day = F.concat_ws("-", month(part(rf"^({MONTHS})")), F.lpad(F.trim(part(r"^\w+ ([ \d]\d)")), 2, "0"))
        options = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: stamp(F.concat_ws("-", (F.year(F.date_add(epoch, today.cast("int"))) + k).cast("string"), day)))
        return F.array_min(F.filter(options, lambda o: o >= started))
    if layout == "clock":
        return today * 86400 + clocked + F.when(today * 86400 + clocked >= started, 0).otherwise(86400)
    if layout == "epoch":
        return part(r"^(\d+)").try_cast("bigint")
    return F.floor(text.try_cast("decimal(20,0)") / 1000).cast("bigint")


def _pair(line: Column, key: str, style: str) -> Column:
    """The value of a key of a structured line, unescaped."""
    start = rf'"{re.escape(key)}"\s*:\s*' if style == "json" else rf'(?:^|\s){re.escape(key)}='
    quoted = F.regexp_extract(line, start + r'"((?:[^"\\]|\\.)*)"', 1)
    bare = F.regexp_extract(line, start + r'([^\s,{}"]+)', 1)
    value = F.when(quoted != "", F.regexp_replace(quoted, r"\\(.)", "$1")).otherwise(bare)
    return F.when(value != "", value)


def severity(word: Column) -> Column:
    """error, warning or note."""
    low = F.lower(word)
    one = F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), word)
    return F.when(F.length(word) == 1, one).when(low.isin(*LEVELS["error"]), "error").when(low.isin(*LEVELS["warning"]), "warning").otherwise("note")


def _first(line: Column, keys: tuple[str, ...], style: str) -> Column:
    return F.coalesce(*[_pair(line, k, style) for k in keys])


RULE = r"[A-Z]{2,}-\d+|no-[a-z]+(?:-[a-z]+)*|[a-z]+/[a-z]+"
PLACE = r"((?:[\w.-]+/)+[\w.-]+\.\w+)[:(](\d+)"


def parsed_lines(lines: DataFrame, found: list[Head]) -> DataFrame:
    """``report_id, line_no, line`` and what a head gives: ``begins, noise, time, level, component, message``.

    Repeated rows of a line number count once (the least text).  Null texts
    are blank lines; rows without report or line number are left out.
    """
    once = lines.filter("report_id is not null and line_no is not null").groupBy("report_id", "line_no").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    once = once.select("report_id", "line_no", cleaned(F.col("text")).alias("line"))
    line = F.col("line")
    structured = line.rlike(STRUCTURED)
    # one expression for each head: its number, time, level, component and message, parted by MARK
    packed = None
    for k, h in enumerate(found):
        if h.kind == "text":
            t, lv, c = h.groups
            test, value = ~structured & line.rlike(h.pattern), F.regexp_replace(line, h.pattern, MARK.join([str(k), f"${t}", f"${lv}", f"${c}", "$4"]))
        elif h.kind == "block":
            test, value = F.trim(line) == "{", F.lit(MARK.join([str(k), "", "", "", ""]))
        else:
            t, lv, c = (_pair(line, x, h.kind) for x in h.pattern.split("|"))
            test = structured & line.rlike(r"^\{" if h.kind == "json" else r"^\w+=") & t.rlike(f"^(?:{TIMES[h.layout]})$") & lv.isNotNull() & c.isNotNull()
            value = F.concat_ws(MARK, F.lit(str(k)), t, lv, c, F.coalesce(_first(line, MESSAGE_KEYS, h.kind), F.lit("")))
        packed = F.when(test, value) if packed is None else packed.when(test, value)
    once = once.withColumn("packed", packed if packed is not None else F.lit(None).cast("string"))
    parts = F.split("packed", MARK)
    of = lambda get: F.element_at(F.array(*[F.lit(get(h)) for h in found] or [F.lit("")]), parts[0].cast("int") + 1)
    head = F.when(
        F.col("packed").isNotNull(),
        F.struct(of(lambda h: h.layout).alias("layout"), parts[1].alias("time"), parts[2].alias("level"), parts[3].alias("component"), parts[4].alias("message"), of(lambda h: h.kind).alias("style")),
    )
    noise = (F.trim(line) == "") | line.rlike(BANNER) | line.rlike(PROGRESS)
    return once.select("report_id", "line_no", "line", head.alias("head"), (F.col("packed").isNull() & noise).alias("noise"))


def entries(lines: DataFrame, reports: DataFrame, found: list[Head], *, segment: int = 4096) -> DataFrame:
    """One row per entry.

    Columns: ``report_id, first_line, last_line, ts_unix, severity, component,
    message, issue_path, issue_line, rule_id``.  An entry runs from its head
    to the last line before the next head that is neither blank nor a banner
    or progress line.  Lines before the first head of a report belong to no
    entry.  Without ``started_at`` an incomplete time is null.
    """
    read = written(parsed_lines(lines, found), "log-lines")  # read twice
    own = carry_previous(read, ["report_id"], ["line_no"], F.floor(F.col("line_no") / segment), {"first_line": F.when(F.col("head").isNotNull(), F.col("line_no"))}, inclusive=True)
    own = own.filter("first_line is not null and not noise")
    line = F.col("line")
    begins = F.col("head").isNotNull()
    key = lambda keys: F.max(F.when(~begins, _first(line, keys, "json")))
    grouped = own.groupBy("report_id", "first_line").agg(
        F.max("line_no").alias("last_line"),
        F.max(F.when(begins, F.struct("head", "line"))).alias("h"),
        key(TIME_KEYS).alias("k_time"), key(LEVEL_KEYS).alias("k_level"), key(COMPONENT_KEYS).alias("k_component"),
        key(MESSAGE_KEYS).alias("k_message"), key(RULE_KEYS).alias("k_rule"), key(LINE_KEYS).alias("k_line"), key(("file", "path")).alias("k_path"),
        F.min(F.when(~begins & line.rlike(r"-->\s"), F.struct("line_no", "line"))).alias("arrow"),
    )
    block = F.col("h.head.style") == "block"
    pick = lambda k, other: F.when(block, F.col(k)).otherwise(other)
    text = F.concat_ws(" ", F.coalesce("h.head.message", F.lit("")), F.coalesce("arrow.line", F.lit("")))
    styled = lambda keys: F.when(F.col("h.head.style") == "json", _first(F.col("h.line"), keys, "json")).when(F.col("h.head.style") == "pairs", _first(F.col("h.line"), keys, "pairs"))
    place = lambda g: F.when(F.regexp_extract(text, PLACE, g) != "", F.regexp_extract(text, PLACE, g))
    piped = F.col("h.head.layout") == "epoch"
    rule = F.coalesce(
        *[F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1)) for p in (rf"^({RULE})[\])|:]", rf"[\[(]({RULE})[\])]\s*$", rf"[\[(]({RULE})[\])]")]
    )
    full = grouped.join(reports.filter("report_id is not null").groupBy("report_id").agg(F.min(utc_seconds(reports, "started_at")).alias("started")), "report_id", "left")
    layout = F.when(block, F.when(F.col("k_time").rlike(r"^\d{13}$"), "epoch_ms").when(F.col("k_time").rlike(r"^\d{10}$"), "epoch").otherwise("iso")).otherwise(F.col("h.head.layout"))
    full = full.withColumns({"layout": layout, "time": pick("k_time", F.col("h.head.time")), "level": pick("k_level", F.col("h.head.level")), "component": F.lower(pick("k_component", F.col("h.head.component")))})
    ts = None
    for name in TIMES:
        value = _unix(name, F.col("time"), F.col("started"))
        ts = F.when(F.col("layout") == name, value) if ts is None else ts.when(F.col("layout") == name, value)
    message = F.when(block, F.col("k_message")).when(piped, F.regexp_extract("h.head.message", r"([^|]*)$", 1)).otherwise(F.col("h.head.message"))
    return full.select(
        "report_id", F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"), ts.cast("bigint").alias("ts_unix"),
        severity(F.col("level")).alias("severity"), "component", message.alias("message"),
        F.coalesce(pick("k_path", styled(("file", "path"))), place(1), F.when(piped, F.regexp_extract("h.head.message", r"^[^|]*\|([^|]*)\|\d+\|", 1))).alias("issue_path"),
        F.coalesce(pick("k_line", styled(LINE_KEYS)), place(2), F.when(piped, F.regexp_extract("h.head.message", r"\|(\d+)\|", 1))).try_cast("int").alias("issue_line"),
        F.coalesce(pick("k_rule", styled(RULE_KEYS)), rule).alias("rule_id"),
    )
