"""Edges of contracts: letters of op7, elements that are seldom text in op8."""

import pytest

from siftwright.llm import language_id
from siftwright.llm.html_main import main_text

PAGE = """<html><body><nav><a href=x>Home</a></nav><article><h1>A title</h1><p>First sentence of the article, with words. And more of them, as is usual.</p>%s
<p>Second paragraph of the article, with commas, and a long tail of words. It ends here.</p></article><footer>Copyright</footer></body></html>"""
WHOLE = "A title First sentence of the article, with words. And more of them, as is usual.%s Second paragraph of the article, with commas, and a long tail of words. It ends here."


@pytest.mark.parametrize("name", ["noscript", "template", "svg", "object", "canvas", "select", "math"])
def test_an_element_never_closed_drops_nothing(name):
    assert main_text(PAGE % f"<{name}>") == WHOLE % ""
    assert main_text(PAGE % f"<{name.upper()} class=x>" * 1) == WHOLE % ""


@pytest.mark.parametrize("part,kept", [
    ("<p>Let <math><mi>x</mi></math> be a number, as it is said.</p>", " Let x be a number, as it is said."),
    ("<noscript><p>Please enable JavaScript to read this page.</p></noscript>", ""),
    ("<svg><title>icon</title><text>Logo</text></svg>", ""),
    ("<select><option>One<option>Two</select>", ""),
    ("<template><p>Never shown, this text, not at all.</p></template>", ""),
    ("<script>if (a < b) { document.write('<p>no</p>') }</script>", ""),
])
def test_what_closed_elements_leave(part, kept):
    assert main_text(PAGE % part) == WHOLE % kept


def test_only_letters_make_words():
    assert language_id.letter_words("½ ² 3 Ⅷ _") == []
    assert language_id.letter_words("m² x²y Straße1a É") == ["m", "x", "y", "straße", "a", "é"]


def test_texts_of_number_signs_are_unknown(spark, make_docs):
    docs = make_docs([(i, w * 30, l) for i, (w, l) in enumerate([("the house and ", "en"), ("das haus und ", "de")] * 20)] + [(90, "½ ² 3", "en"), (91, "Ⅷ", "de")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert got[90] == got[91] == ("und", 0.0) and got[0][0] == "en" and got[1][0] == "de"


def test_feature_table_is_the_same_word_by_word():
    words, lexicon = ["a", "haus", "é", "x" * 500, "und", ""], {"haus": 3, "und": 0}
    flat, sizes = language_id._by_word(words, lexicon)
    at = 0
    for w, n in zip(words, sizes):
        assert sorted(flat[at:at + n].tolist()) == sorted(language_id.features(w, lexicon))
        at += n
    assert at == len(flat)
