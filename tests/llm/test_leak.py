"""Leaks: normalising, exact verification against brute force, measured recall, edge cases."""

import random

import numpy as np

from artefold.llm import leak
from artefold.llm.leak import LeakSpec, verified, word_codes, words

SPEC = LeakSpec()


def test_words_see_through_markup_escapes_and_layout():
    plain = words("The gilded saddler, borrowed eleven.")
    for t in ("> The gilded\n> saddler borrowed eleven", "the <b>gilded</b>&#32;saddler&nbsp;borrowed eleven", "the gil-\nded sad-\n> dler borrowed eleven", "THE gilded ​saddler\xa0borrowed\televen", "the\\ngilded\\tsaddler\\u0020borrowed eleven", "the%20gilded%20saddler **borrowed** _eleven_"):
        assert words(t) == plain, t
    assert words(None) == [] and words("") == []


def _brute(item, doc):
    """By plain dynamic programming over all starts and ends."""
    for a in range(len(item)):
        for c in range(len(doc)):
            if item[a] != doc[c]:
                continue
            # edit distance of all extensions of (a, c)
            n, m = len(item) - a, len(doc) - c
            d = np.zeros((n + 1, m + 1), int)
            d[:, 0], d[0, :] = range(n + 1), range(m + 1)
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (item[a + i - 1] != doc[c + j - 1]))
                    if item[a + i - 1] == doc[c + j - 1] and i >= 12 and 8 * d[i, j] <= i:
                        return True
    return False


def _edited(rng, stretch, edits):
    s = list(stretch)
    for p in sorted(rng.sample(range(1, len(s) - 1), edits), reverse=True):
        what = rng.randrange(3)
        if what == 0:
            s[p] = f"r{rng.randrange(999)}"
        elif what == 1:
            del s[p]
        else:
            s.insert(p, f"i{rng.randrange(999)}")
    return s


def test_verification_equals_brute_force():
    rng = random.Random(3)
    seen = set()
    for _ in range(200):
        item = [rng.choice("abcdefghijklmnop") for _ in range(26)]
        n = rng.choice([9, 11, 12, 13, 16, 17, 24])
        a = rng.randrange(0, len(item) - n + 1)
        doc = ["x", "y"] + _edited(rng, item[a : a + n], rng.randrange(0, 4)) + ["z", "w"]
        want = _brute(item, doc)
        seen.add(want)
        assert verified(word_codes(item), word_codes(doc), SPEC) == want, (item, doc)
    assert seen == {True, False}


def _pairs(spark, docs, items, spec=SPEC):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {tuple(r) for r in leak.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), spec).collect()}


def test_recall_of_the_candidates_is_at_least_99_percent(spark):
    """Against exact verification on planted, edited stretches of the least allowed length."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(40)]
    docs, want = [], {}
    for n, e in ((12, 1), (16, 2)):
        for _ in range(200):
            k = rng.randrange(40)
            w = words(items[k][1])
            a = rng.randrange(0, len(w) - n)
            want[len(docs)] = (k, n)
            docs.append((len(docs), " ".join(["p", "q"] * 5 + _edited(rng, w[a : a + n], e) + ["r", "s"] * 5)))
    found = _pairs(spark, docs, items)
    for n in (12, 16):
        assert sum((d, k) in found for d, (k, m) in want.items() if m == n) >= 198


def test_shorter_quotes_and_likeness_are_no_case(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [
        "x one two three four five six seven eight nine ten eleven y z q",
        "one two three four five six seven eight nine ten eleven twelve",
        "one two three four five six eight nine ten eleven twelve",  # one dropped, ends the text
        "two one four three six five eight seven ten nine twelve eleven thirteen",
    ]
    assert _pairs(spark, list(enumerate(docs)), [(1, item)]) == {(1, 1), (2, 1)}


def test_stock_sentences_with_chance_words_are_no_case(spark):
    stock = "answer briefly and do not repeat the question in full"
    own = {k: " ".join(f"{w}{k}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()) for k in range(6)}
    items = [(k, f"{stock} of the {own[k]}") for k in range(6)]
    docs = [
        (1, f"{stock} or the harbour was closed"),  # ten stock words, one replaced, one that agrees
        (2, f"{stock} of the {own[2]}"),
        (3, f"before {' '.join(own[3].split()[:12])} behind"),
        (4, f"{stock} of the {' '.join(own[4].split()[:4])} and no more"),  # four own words
        (5, f"{stock} of the {' '.join(own[5].split()[:5])} and no more"),
    ]
    assert _pairs(spark, docs, items) == {(2, 2), (3, 3), (5, 5)}
    copies = [(k, own[0]) for k in range(4)]  # copies of a text share no stock
    assert _pairs(spark, [(1, own[0])], copies) == {(1, k) for k in range(4)}
    near = [(k, f"{own[0]} {own[1]} end{k}") for k in range(4)]  # nor does a passage of 24 words or more
    assert _pairs(spark, [(1, own[0])], near) == {(1, k) for k in range(4)}


def test_a_full_filter_loses_nothing(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    assert _pairs(spark, [(1, t), (2, "nothing of it")], [(7, t)], LeakSpec(filter_bits=1 << 15)) == {(1, 7)}


def test_frames_and_edges(spark):
    t = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = spark.createDataFrame([(1, f"> {t}", "c"), (2, None, "c"), (3, "", "c"), (4, "noise " * 30_000 + t, None), (5, t, "c"), (5, t, "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, t), (10, t), (11, None), (12, "too short"), (13, t.upper() + " omicron")], "item_id long, text string")
    want = {(d, i) for d in (1, 4, 5) for i in (10, 13)}
    assert {tuple(r) for r in leak.find_leaks(docs, items).collect()} == want
    assert leak.find_leaks(docs, items.limit(0)).collect() == [] and leak.find_leaks(docs.limit(0), items).collect() == []
