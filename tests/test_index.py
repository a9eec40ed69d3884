"""The n-gram index: whole texts, and searches that read it."""

from collections import Counter

from artefold.operators import search
from artefold.plans import registry, text_queries
from artefold.session import table


def test_index_holds_the_grams_of_all_lines(spark, small):
    texts = [r.text for r in table(spark, small, "documents").collect() if r.text is not None]
    want = Counter(g for t in texts for g in {t[i : i + 3] for i in range(len(t) - 2)})
    assert {r.gram: r.docs for r in registry.queries()["trigram_index_size"](spark, small).collect()} == want


def test_search_reads_the_whole_index(spark, small, monkeypatch):
    built, plain = [], search.index

    def index(*args, only=None):
        built.append(only)
        return plain(*args, only=only)

    monkeypatch.setattr(search, "index", index)
    got = {(r.id, r.line_no) for r in text_queries.trigram_search(spark, small).collect()}
    assert built == [None] and got == {(r.id, r.line_no) for r in text_queries.regex_search(spark, small).collect()}
