"""Inputs that once crashed or slowed down the corpus operators."""

import random
import time

import pytest

from logsieve.llm import decontam, html_text, substrings


@pytest.mark.parametrize("page", [
    "<p>text</p>" + "<span>" * 20_000 + "x" + "</b>" * 20_000,
    "<b><div>" + "<span>" * 20_000 + "x" + "</b>" * 20_000 + "</div>",
    "<div>" * 3_000 + "x" + "</i></p>" * 20_000])
def test_stray_end_tags_cost_no_walk(page):
    start = time.process_time()
    html_text._tree(page)
    assert time.process_time() - start < 3


def test_end_tags_close_what_they_did():
    tree = html_text._tree("<div><b>one<p>two</b> three</p></div>four<ul><li>a<li>b</ul><i>c</div></i>d")
    def flat(node):
        return [x if isinstance(x, str) else (x.tag, flat(x)) for x in node.parts]
    assert flat(tree) == [("div", [("b", ["one", ("p", ["two", " three"])])]), "four",
                          ("ul", [("li", ["a"]), ("li", ["b"])]), ("i", ["c"]), "d"]


def test_items_may_have_text_ids(spark):
    words = [f"word{i} of item" for i in range(12)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing here")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([("q-1", text), (None, text + " more words of another kind")],
                                                     "item_id string, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, "q-1")} and {r.doc_id for r in got} == {1}


def test_repeated_rows_of_one_reference_are_folded(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    rows = [(1, "start " + shared)] * 40 + [(2, shared + " end"), (3, "other words")]
    seen = []
    stored = substrings.scale.materialise

    def spy(df):
        out = stored(df)
        if "text" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(substrings.scale, "materialise", spy)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [2]
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 40 + [(2, 300), (3, 0)]
