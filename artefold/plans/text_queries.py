"""Text, log, recall and search operators over documents, diagnostics and checker output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artefold.functions import text as T
from artefold.operators import recall as R
from artefold.operators import reduce as L
from artefold.operators import search as X
from artefold.session import table, written


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null")


def _logs(spark, d) -> DataFrame:
    return table(spark, d, "diag_lines").groupBy(F.col("report_id").alias("log"), "line_no").agg(F.min("text").alias("text"))


def _doc_lines(spark, d) -> DataFrame:
    return L.split_lines(_docs(spark, d), "doc_id", "text")


def tokenize_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term"))


def token_estimates(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.tokens_by_bytes(t).alias("by_bytes"), T.tokens_by_chars(t).alias("by_chars"), T.tokens_at_least_one(t).alias("at_least_one"))


def message_templates(spark, d):
    return table(spark, d, "issues").filter("message is not null").groupBy(T.message_template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


def line_fingerprints(spark, d):
    return table(spark, d, "issues").select("issue_id", T.fingerprint(F.coalesce("path", F.lit("")), F.coalesce("rule_id", F.lit(""))).alias("fp"))


def path_like_words(spark, d):
    w = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \n\r\t]+"))).alias("word"))
    return w.filter(T.looks_like_path(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def summary_priority(spark, d):
    return table(spark, d, "issues").filter("message is not null").select("issue_id", T.summary_priority(F.col("message")).cast("bigint").alias("priority"))


def inferred_relevance(spark, d):
    return table(spark, d, "issues").filter("message is not null").select("issue_id", T.inferred_relevance(F.col("message"), F.lit(2)).alias("relevance"))


def text_truncated(spark, d):
    return _docs(spark, d).select("doc_id", T.truncated(F.col("text"), 180).alias("short"))


def ansi_stripped(spark, d):
    return _logs(spark, d).filter(F.col("text").contains("\x1b")).select("log", "line_no", T.strip_ansi(F.col("text")).alias("plain"))


def run_length_collapse(spark, d):
    return L.run_length(_logs(spark, d), key=L.line_class(F.col("text")))


def blank_collapse(spark, d):
    return L.collapse_blanks(_doc_lines(spark, d)).groupBy("log").agg(F.count("*").alias("n"), F.max("line_no").cast("bigint").alias("last"))


def line_class_histogram(spark, d):
    return L.class_histogram(_doc_lines(spark, d))


def command_first_fit(spark, d):
    return L.command_reduce(_doc_lines(spark, d).select("log", "line_no", F.col("text")), budget_bytes=400).select("log", "line_no", "class")


def stack_frames(spark, d):
    return L.frames(_doc_lines(spark, d)).select("log", "line_no", "file", "line", "actionable")


def stack_blocks(spark, d):
    return L.stack_blocks(_logs(spark, d)).select("log", "block", "title", "n_frames")


def stack_slice(spark, d):
    return L.stack_slice(L.stack_blocks(_logs(spark, d)))


def build_diagnostics(spark, d):
    """Issues written as checkers of four layouts do, and read back."""
    i = table(spark, d, "issues").filter("path is not null and message is not null and line is not null and severity is not null and rule_id is not null")
    file, at, code = F.regexp_replace("path", r".*/", ""), F.col("line"), F.col("rule_id")
    word = F.when(F.lower(F.trim("severity")).isin("error", "warning", "note"), F.lower(F.trim("severity"))).otherwise("note")
    form = F.col("issue_id") % 4
    first = (
        F.when(form == 0, F.concat(file, F.lit(":"), at, F.lit(":1: "), word, F.lit(": "), "message"))
        .when(form == 1, F.concat(file, F.lit("("), at, F.lit(",2): "), word, F.lit(" C"), at, F.lit(": "), "message"))
        .otherwise(F.concat(word, F.lit("["), code, F.lit("]: "), "message"))
    )
    second = F.when(form == 2, F.concat(F.lit("  --> "), file, F.lit(":"), at, F.lit(":3")))
    lines = i.select(code.alias("log"), F.posexplode(F.array(first, second)).alias("p", "text"), "issue_id").filter("text is not null")
    return L.diagnostics(lines.select("log", (F.col("issue_id") * 2 + F.col("p")).alias("line_no"), "text"))


def diagnostic_groups(spark, d):
    i = table(spark, d, "issues").filter("message is not null").select(F.lower(F.trim("severity")).alias("severity"), F.lit(None).cast("string").alias("code"), "message", "path", "line", "issue_id")
    return L.root_causes(i, order=["issue_id"])


def output_counters(spark, d):
    return L.count_output(_doc_lines(spark, d), "git_diff")


def recall_postings(spark, d):
    return R.postings(_docs(spark, d), "doc_id", F.split("text", "\n"))


def _queries(spark, d) -> DataFrame:
    """The searches: every issue whose id is divisible by 20."""
    q = table(spark, d, "issues").filter(F.col("message").isNotNull() & (F.col("issue_id") % 20 == 0))
    return q.select(F.col("issue_id").alias("query_id"), F.explode(T.tokenize(F.col("message"))).alias("term"))


def bm25_recall(spark, d):
    return R.best_bm25(recall_postings(spark, d), _queries(spark, d), 8)


def _entries(spark, d) -> DataFrame:
    return table(spark, d, "packets").select(F.col("record_id").alias("id"), "packet_id", F.unix_timestamp("recorded_at").alias("created"), "kind", F.col("budget_cost.est_tokens").alias("est_tokens"))


def ttl_prune(spark, d):
    return R.fresh(_entries(spark, d), 30 * 86400, F.lit(1767225600)).select("id")


def latest_per_key(spark, d):
    return R.latest_per_key(_entries(spark, d), "packet_id", "created", "id").select("packet_id", "id", "created")


def store_stats(spark, d):
    return R.stats(_entries(spark, d))


def store_page(spark, d):
    return R.page(_entries(spark, d), contains="stack", offset=5, limit=20).select("id", "created", "kind")


def recency_bonus(spark, d):
    return _entries(spark, d).select("id", F.round(R.recency_bonus(F.lit(1767225600) - F.col("created")), 6).alias("bonus"))


PATTERN = r"(write|read)_[a-z]+_(all|into) .*(cache|index)"


def _search_lines(spark, d):
    return _doc_lines(spark, d).withColumnRenamed("log", "id")


def regex_search(spark, d):
    return X.verify(_search_lines(spark, d), PATTERN).select("id", "line_no")


def trigram_search(spark, d):
    docs = _docs(spark, d).withColumn("text", F.regexp_replace("text", "\r", ""))
    grams = written(X.index(docs, "doc_id", "text"), "trigram-index")
    return X.indexed_search(docs, "doc_id", "text", PATTERN, grams=grams).select("id", "line_no")


def fixed_search(spark, d):
    return X.verify(_search_lines(spark, d), "gate report", fixed=True).select("id", "line_no")


def search_shown(spark, d):
    return X.shown(X.verify(_search_lines(spark, d), "report"), per_doc=3, total=60).select("id", "line_no")


def trigram_index_size(spark, d):
    """The document counts of all trigrams of the whole texts."""
    return X.index(_docs(spark, d), "doc_id", "text").groupBy("gram").agg(F.count("*").alias("docs"))


def overlay_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "path")
    return X.overlaid(docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 5 = 0").withColumn("path", F.concat(F.lit("new/"), "path")), docs.filter("doc_id % 11 = 0"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, token_estimates, message_templates, line_fingerprints, path_like_words, summary_priority, inferred_relevance, text_truncated, ansi_stripped,
        run_length_collapse, blank_collapse, line_class_histogram, command_first_fit, stack_frames, stack_blocks, stack_slice, build_diagnostics, diagnostic_groups, output_counters,
        recall_postings, bm25_recall, ttl_prune, latest_per_key, store_stats, store_page, recency_bonus,
        regex_search, trigram_search, fixed_search, search_shown, trigram_index_size, overlay_search,
    )
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_distinct(list_filter(string_split_regex(" + _LOW + ", '[^a-z0-9_]+'), lambda x: strlen(x) >= 2))"
_FRAGMENTS = r"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([^0-9 ])', '\1 \2', 'g'), '([^0-9 ])([0-9])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"
_TERMS = (
    r"list_distinct(list_filter(list_transform(flatten(list_transform(list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}_:/]+'), lambda p: p <> ''), "
    r"lambda p: list_concat([p], flatten(list_transform(list_filter(string_split_regex(p, '[/:._-]+'), lambda s: s <> ''), lambda s: list_concat([s], " + _FRAGMENTS.format("s") + "))))))"
    ", lambda x: " + _LOW.format("x") + "), lambda x: strlen(x) >= 2))"
)
_CLASS = (
    "case when regexp_matches(" + _LOW.format("{0}") + ", 'error|fatal') then 'error' when contains(" + _LOW.format("{0}") + ", 'warn') then 'warning' "
    r"when regexp_matches({0}, '^[MAD]') then 'git_change' when regexp_matches({0}, '([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+|[A-Za-z0-9_./\\-]+/[A-Za-z0-9_./\\-]+)') then 'path' else 'other' end"
)
_LINES = """
with docs as (select doc_id, text from documents where text is not null),
sp as (select doc_id as log, string_split(replace(text, chr(13), ''), chr(10)) as l from docs),
lines as (select log, i::int as line_no, l[i] as text from (select log, l, unnest(range(1, len(l) + 1)) as i from sp))
"""
_LOGS = "with logs as (select report_id as log, line_no, min(text) as text from diag_lines group by 1, 2)"
_FRAME = (
    r"regexp_matches(trim(text), '^at +([\w.$<>]+)\(([^:()]+):([0-9]+)\)') as j, regexp_matches(trim(text), '^File +\"([^\"]+)\", +line +([0-9]+), +in +(.+)$') as p, "
    r"regexp_matches(trim(text), '([A-Za-z0-9_./-]+\.[A-Za-z0-9_+-]+):([0-9]+)(?::[0-9]+)?(?: +in +([\w.$<>:]+))?') as g"
)
_JE, _PE, _GE = r"'^at +([\w.$<>]+)\(([^:()]+):([0-9]+)\)'", r"""'^File +"([^"]+)", +line +([0-9]+), +in +(.+)$'""", r"'([A-Za-z0-9_./-]+\.[A-Za-z0-9_+-]+):([0-9]+)(?::[0-9]+)?(?: +in +([\w.$<>:]+))?'"
_FRAMES = f"""fr0 as (select *, trim(text) as t, {_FRAME} from {{src}}),
frames as (select * exclude (text, j, p, g), case when j then regexp_extract(t, {_JE}, 1) when p then regexp_extract(t, {_PE}, 3) else nullif(regexp_extract(t, {_GE}, 3), '') end as function,
  case when j then regexp_extract(t, {_JE}, 2) when p then regexp_extract(t, {_PE}, 1) else regexp_extract(t, {_GE}, 1) end as file,
  try_cast(case when j then regexp_extract(t, {_JE}, 3) when p then regexp_extract(t, {_PE}, 2) else regexp_extract(t, {_GE}, 2) end as int) as line from fr0 where j or p or g)"""
_BLOCKS = (
    _LOGS
    + r""", h as (select *, regexp_matches(lower(trim(text)), 'exception|panic|fatal|traceback|error:|failed') and not regexp_matches(lower(trim(text)), '^(at |file )') as head, trim(text) = '' as blank from logs),
own0 as (select log, line_no, text, max(case when head then line_no end) over w as block, max(case when blank then line_no end) over w as gap from h window w as (partition by log order by line_no)),
own as (select log, line_no, text, block from own0 where block is not null and (gap is null or gap < block)),
"""
    + _FRAMES.format(src="own")
    + r""", fg as (select log, block, count(*) as n_frames, array_to_string(list(concat_ws('|', coalesce(function, ''), file, line::varchar) order by line_no)[1:3], '|') as top from frames group by 1, 2),
blocks as (select o.log, o.block, trim(o.text) as title, n_frames, substr(sha256(concat_ws('|', """
    + _LOW.format("trim(o.text)")
    + """, top)), 1, 16) as fingerprint from own o join fg on fg.log = o.log and fg.block = o.block where o.line_no = o.block)
"""
)
_PACK = "with e as (select record_id as id, packet_id, epoch(date_trunc('second', recorded_at))::bigint as created, kind from packets)"
_RE = PATTERN.replace("'", "''")
ORACLE = {
    "tokenize_terms": f"select doc_id, unnest({_TERMS.format('text')}) as term from documents where text is not null",
    "token_estimates": "select doc_id, strlen(text) // 4 as by_bytes, (length(text) + 3) // 4 as by_chars, greatest((strlen(text) + 3) // 4, 1) as at_least_one from documents where text is not null",
    "message_templates": f"select trim(regexp_replace({_LOW.format('message')}, '[0-9]+', '#', 'g')) as template, count(*) as n from issues where message is not null group by 1",
    "line_fingerprints": "select issue_id, substr(sha256(concat_ws('|', coalesce(path, ''), coalesce(rule_id, ''))), 1, 16) as fp from issues",
    "path_like_words": r"select doc_id, count(*) as n from (select doc_id, unnest(list_distinct(string_split_regex(text, '[ \n\r\t]+'))) as w from documents where text is not null) where contains(w, '/') or (regexp_matches(w, '\.[A-Za-z0-9]{1,4}$') and regexp_matches(regexp_extract(w, '\.([A-Za-z0-9]{1,4})$', 1), '^[0-9]*[A-Za-z]')) group by 1",
    "summary_priority": r"with m as (select issue_id, trim(message) as t from issues where message is not null) select issue_id, (case when contains(t, '/') or (regexp_matches(t, '\.[A-Za-z0-9]{1,4}$') and regexp_matches(regexp_extract(t, '\.([A-Za-z0-9]{1,4})$', 1), '^[0-9]*[A-Za-z]')) then -40 else 40 end + 2 * least(len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')), 12) + least(strlen(t), 180) // 12 - case when regexp_matches(lower(t), '^(context assemble |assembled context )') then 60 else 0 end - case when regexp_matches(lower(t), '^(repo map files=|diff touched files=|test impact selected_tests=|build diagnostics unique=|correlation findings=|agent snapshot events=)') then 24 else 0 end - case when contains(lower(t), 'truncated=') and contains(lower(t), 'sections=') and contains(lower(t), 'refs=') then 24 else 0 end)::bigint as priority from m",
    "inferred_relevance": f"with m as (select issue_id, {_LOW.format('message')} as s from issues where message is not null) select issue_id, round(0.5 + case when regexp_matches(s, 'critical|fail|error|regression|panic') then 0.7 else 0 end + case when regexp_matches(s, 'warning|uncovered|missing|stale') then 0.3 else 0 end + case when regexp_matches(s, 'passed|ok|green') then 0.1 else 0 end + 0.08, 6)::double as relevance from m",
    "text_truncated": "select doc_id, case when length(text) > 180 then substr(text, 1, 177) || '...' else text end as short from documents where text is not null",
    "ansi_stripped": _LOGS + r" select log, line_no, regexp_replace(text, '\x1B\[[0-9;?]*[A-Za-z]', '', 'g') as plain from logs where contains(text, chr(27))",
    "run_length_collapse": _LOGS + f", k as (select *, {_CLASS.format('text')} as k from logs), s as (select *, case when lag(line_no) over w is null or k is distinct from lag(k) over w then 1 else 0 end as f from k window w as (partition by log order by line_no)), r as (select *, sum(f) over (partition by log order by line_no) as run from s) select log, min(line_no) as first_line, arg_max(text, line_no) as text, count(*) as n from r group by log, run",
    "blank_collapse": _LINES + ", b as (select *, trim(text) = '' as blank, lag(trim(text) = '') over (partition by log order by line_no) as was from lines) select log, count(*) as n, max(line_no)::bigint as last from b where not (blank and coalesce(was, false)) group by log",
    "line_class_histogram": _LINES + f" select {_CLASS.format('text')} as class, count(*) as n, count(distinct log) as logs from lines where trim(text) <> '' group by 1",
    "command_first_fit": _LINES + f""", u as (select log, trim(replace(text, chr(9), ' ')) as text, min(line_no) as line_no from lines where trim(replace(text, chr(9), ' ')) <> '' group by 1, 2),
c as (select log, line_no, strlen(text)::bigint as w, {_CLASS.format('text')} as class from u),
rk as materialized (select *, row_number() over (partition by log order by case class when 'error' then 100 when 'warning' then 90 when 'git_change' then 80 when 'path' then 70 else 50 end desc, line_no) as rk from c),
f as (select * from (with recursive g(log, rk, used, line_no, class, kept) as (select distinct log, 0::bigint, 0::bigint, 0, '', false from rk union all select r.log, r.rk, case when g.used + r.w <= 400 then g.used + r.w else g.used end, r.line_no, r.class, g.used + r.w <= 400 from g join rk r on r.log = g.log and r.rk = g.rk + 1) select * from g))
select log, line_no, class from f where kept""",
    "stack_frames": _LINES + "," + _FRAMES.format(src="lines") + r" select log, line_no, file, line, not regexp_matches(file, '/rustc/|site-packages|node_modules|/usr/lib/|/lib/|java\.base') as actionable from frames",
    "stack_blocks": _BLOCKS + "select log, block, title, n_frames from blocks",
    "stack_slice": _BLOCKS + "select fingerprint, arg_min(title, (log, block)) as title, count(*) as occurrences, arg_min(n_frames, (log, block)) as n_frames from blocks group by 1",
    "build_diagnostics": r"""with i as (select issue_id, issue_id % 4 as form, rule_id as log, regexp_replace(path, '.*/', '') as f, line as l, message as m, case when lower(trim(severity)) in ('error', 'warning', 'note') then lower(trim(severity)) else 'note' end as s from issues where path is not null and message is not null and line is not null and severity is not null and rule_id is not null),
 ok as (select *, regexp_matches(f, '^[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_+-]+$') as placed, max(case when form <> 2 or not regexp_matches(f, '^[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_+-]+$') then issue_id * 2 else issue_id * 2 + 1 end) filter (where form >= 2 or regexp_matches(f, '^[A-Za-z0-9_./\\-]+\.[A-Za-z0-9_+-]+$')) over (partition by log) as last from i)
 select log, issue_id * 2 as line_no, f as file, l::int as line, 1 as column_no, s as severity, case when regexp_matches(m, ' +\[[^\]]+\]$') then regexp_extract(m, ' +\[([^\]]+)\]$', 1) end as code, trim(regexp_replace(m, ' +\[[^\]]+\]$', '')) as message from ok where form = 0 and placed
 union all select log, issue_id * 2, f, l::int, 2, s, 'C' || l, trim(m) from ok where form = 1 and placed
 union all select log, issue_id * 2 + 1, f, l::int, 3, s, log, trim(m) from ok where form = 2 and placed
 union all select log, issue_id * 2, '<unknown>', 0, 0, s, log, trim(m) from ok where (form = 3 or (form = 2 and not placed)) and issue_id * 2 = last""",
    "diagnostic_groups": f"with o as (select distinct lower(trim(severity)) as severity, message, path, line from issues where message is not null) select concat_ws(':', severity, trim(regexp_replace({_LOW.format('message')}, '[0-9]+', '#', 'g'))) as cause, max(severity) as severity, count(*) as n from o group by 1",
    "output_counters": _LINES + r", g as (select log, count(*) filter (where regexp_matches(text, '^\+([^+]|\+[^+]|\+?$)')) as added, count(*) filter (where regexp_matches(text, '^-([^-]|-[^-]|-?$)')) as removed, count(*) filter (where text like 'diff --git %') as files from lines group by log) select * from g where added > 0 or removed > 0 or files > 0",
    "recall_postings": f"with s as (select doc_id as id, unnest(list_distinct(flatten(list_transform(range(1, len(l) + 1), lambda i: list_transform({_TERMS.format('l[i]')}, lambda w: i || ' ' || w))))) as t from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)) select id, split_part(t, ' ', 2) as term, count(*) as tf from s group by 1, 2",
    "ttl_prune": _PACK + " select id from e where 1767225600 - created <= 30 * 86400",
    "latest_per_key": _PACK + " select packet_id, arg_max(id, (created, id)) as id, max(created) as created from e group by 1",
    "store_stats": _PACK + " select count(*) as entries, min(created) as oldest, max(created) as newest, count(distinct kind) as kinds from e",
    "store_page": _PACK + " select id, created, kind from e where contains(kind, 'stack') order by created desc, id limit 20 offset 5",
    "recency_bonus": _PACK + " select id, round(0.25 * least(1 / (1 + greatest(1767225600 - created, 0) / 86400), 1.0), 6) as bonus from e",
    "regex_search": _LINES + f" select log as id, line_no from lines where regexp_matches(text, '{_RE}')",
    "trigram_search": _LINES + f" select log as id, line_no from lines where regexp_matches(text, '{_RE}')",
    "fixed_search": _LINES + " select log as id, line_no from lines where contains(text, 'gate report')",
    "search_shown": _LINES + ", k as (select *, row_number() over (partition by log order by line_no) as k from lines where contains(text, 'report')) select log as id, line_no from k where k <= 3 order by log, line_no limit 60",
    "trigram_index_size": "with g as (select distinct doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) as gram from documents where length(text) >= 3) select gram, count(*) as docs from g group by 1",
    "overlay_search": "with b as (select doc_id, path from documents where doc_id % 7 <> 0), o as (select doc_id, 'new/' || path as path from documents where doc_id % 5 = 0), x as (select doc_id from documents where doc_id % 11 = 0) select * from b where doc_id not in (select doc_id from o) and doc_id not in (select doc_id from x) union all select * from o where doc_id not in (select doc_id from x)",
}
_BM = (
    ORACLE["recall_postings"].replace("with s as", "with s as", 1)
)
ORACLE["bm25_recall"] = f"""with post as ({_BM}), len as (select id, sum(tf) as length from post group by 1), st as (select count(*) as n, avg(length) as avg from len),
q as (select issue_id as query_id, unnest({_TERMS.format('message')}) as term from issues where issue_id % 20 = 0 and message is not null),
df as (select term, count(*) as df from post where term in (select term from q) group by 1),
sc as (select query_id, post.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))), 6) as score, count(*) as matched from q join post using (term) join df using (term) join len on len.id = post.id cross join st group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc) select query_id, id, score, matched, rank::int as rank from r where rank <= 8"""
