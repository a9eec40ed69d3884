"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANSI = r"\x1B\[[0-9;?]*[A-Za-z]"


def ascii_lower(col: Column) -> Column:
    """Lower case of A-Z only, as byte-wise tools do it."""
    return F.translate(col, UPPER, LOWER)


def strip_ansi(col: Column) -> Column:
    return F.regexp_replace(col, ANSI, "")


def message_template(col: Column) -> Column:
    """Lower case, digits as ``#``, trimmed: what groups messages."""
    return F.trim(F.regexp_replace(ascii_lower(col), "[0-9]+", "#"))


def tokens_by_bytes(col: Column) -> Column:
    """Estimate of packets: bytes over four, rounded down."""
    return (F.octet_length(col) / 4).cast("bigint")


def tokens_by_chars(col: Column) -> Column:
    """Estimate of assembly: characters over four, rounded up."""
    return ((F.length(col) + 3) / 4).cast("bigint")


def tokens_at_least_one(col: Column) -> Column:
    """Estimate of limits: bytes over four, rounded up, at least one."""
    return F.greatest(((F.octet_length(col) + 3) / 4).cast("bigint"), F.lit(1).cast("bigint"))


def fingerprint(*cols: Column | str, size: int = 16) -> Column:
    """A prefix of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, size)


def fragments(col: Column) -> Column:
    """The parts of an identifier: camel-case words, acronyms and runs of digits; an array."""
    s = F.regexp_replace(F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2"), "([0-9])([^0-9 ])", "$1 $2")
    return F.split(F.regexp_replace(F.regexp_replace(s, "([^0-9 ])([0-9])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"), " ")


def tokenize(col: Column) -> Column:
    """Search terms: runs of letters, digits, ``_``, ``:`` and ``/``, their segments, and the fragments of those.

    Lower case of A-Z, at least two bytes, unique, in order of appearance.
    """
    some = lambda xs: F.filter(xs, lambda x: x != "")
    parts = some(F.split(col, r"[^\p{L}\p{N}_:/]+"))
    of = lambda p: F.concat(F.array(p), F.flatten(F.transform(some(F.split(p, r"[/:._-]+")), lambda s: F.concat(F.array(s), fragments(s)))))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(parts, of)), ascii_lower), lambda x: F.octet_length(x) >= 2))


def camel_pieces(col: Column) -> Column:
    """The camel-case words and acronyms of a term, digits left where they are; an array."""
    return F.split(F.regexp_replace(F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"), " ")


def words(col: Column) -> Column:
    """Lower-case runs of letters and digits, each once, at least two bytes."""
    return F.array_distinct(F.filter(F.split(ascii_lower(col), "[^a-z0-9_]+"), lambda x: F.octet_length(x) >= 2))


def basename(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def dirname(col: Column) -> Column:
    return F.regexp_replace(col, "/[^/]*$", "")


def resolve_path(col: Column) -> Column:
    """Backslashes to slashes, ``.`` and ``..`` resolved, lower case."""
    parts = F.split(F.regexp_replace(col, r"\\", "/"), "/")
    fold = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x)))
    return ascii_lower(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/"))


def looks_like_path(col: Column) -> Column:
    """A slash, or an extension of at most four letters and digits with a letter in it."""
    return F.coalesce(col.contains("/") | col.rlike(r"\.(?=[A-Za-z0-9]{1,4}$)[0-9]*[A-Za-z]"), F.lit(False))


def truncated(col: Column, size: int) -> Column:
    """At most ``size`` characters, the last three dots where cut."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size - 3), F.lit("..."))).otherwise(col)


# Words that tell how much a section matters.
WORDS_OF_FAILURE = "critical|fail|failed|error|regression|panic"
WORDS_OF_WARNING = "warning|uncovered|missing|stale"
WORDS_OF_SUCCESS = "passed|ok|green"
# How generated summaries begin.
ASSEMBLED_HEADS = "^(context assemble |assembled context )"
COUNTED_HEADS = "^(repo map files=|diff touched files=|test impact selected_tests=|build diagnostics unique=|correlation findings=|agent snapshot events=)"


def inferred_relevance(text: Column, refs: Column) -> Column:
    """0.5, more for words of failure, warning and success, and 0.04 for each reference."""
    low = ascii_lower(text)
    hit = lambda words, w: F.when(low.rlike(words), w).otherwise(0.0)
    return F.round(F.lit(0.5) + hit(WORDS_OF_FAILURE, 0.7) + hit(WORDS_OF_WARNING, 0.3) + hit(WORDS_OF_SUCCESS, 0.1) + refs * 0.04, 6)


def summary_priority(text: Column) -> Column:
    """How well a line sums up: prose over paths, more words, more text, generated summaries last."""
    t = F.trim(text)
    low = ascii_lower(t)
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    counted = low.contains("truncated=") & low.contains("sections=") & low.contains("refs=")
    less = F.when(low.rlike(ASSEMBLED_HEADS), 60).otherwise(0) + F.when(low.rlike(COUNTED_HEADS), 24).otherwise(0) + F.when(counted, 24).otherwise(0)
    return F.when(looks_like_path(t), -40).otherwise(40) + 2 * F.least(n_words, F.lit(12)) + (F.least(F.octet_length(t), F.lit(180)) / 12).cast("int") - less


def trigrams(col: Column) -> Column:
    """The distinct three-character substrings."""
    n = F.length(col)
    parts = F.transform(F.sequence(F.lit(1), n - 2, F.lit(64)), lambda i: F.substring(col, i, F.lit(66)))  # a substring is found by counting from the start
    grams = F.transform(parts, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    return F.when(n >= 3, F.array_distinct(F.flatten(grams))).otherwise(F.array().cast("array<string>"))


def usd(tokens: Column, per_million: float) -> Column:
    return F.round(tokens / 1_000_000 * per_million, 6)


def short_count(col: Column) -> Column:
    """``950``, ``1.2K``, ``3.4M``."""
    return (
        F.when(col >= 1_000_000, F.concat(F.format_string("%.1f", col / 1_000_000), F.lit("M")))
        .when(col >= 1000, F.concat(F.format_string("%.1f", col / 1000), F.lit("K")))
        .otherwise(col.cast("string"))
    )
