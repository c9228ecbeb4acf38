"""The pipeline's language stage keeps every text with letters."""

import corpus_pipeline
from siftwright.llm import language_id

LANGS = {"en": "the house and the river were near", "de": "das haus und der fluss waren nah", "fr": "la maison et le fleuve sont proches", "es": "la casa y el rio estaban cerca"}


def test_mixed_texts_stay(spark, make_docs):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(list(LANGS.items()) * 30)]
    rows += [(900, " ".join(LANGS.values()), "en"), (901, "x", None), (902, " ".join(LANGS[k] for k in ("de", "fr", "es")), "de"), (903, "12 -- 34", "en"), (904, None, "en"), (905, "", None)]
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, make_docs(rows), "").collect()}
    assert kept == {r[0] for r in rows} - {903, 904, 905}


def test_no_labels(spark, make_docs):
    rows = [(1, "some words", None), (2, "andere worte hier", None), (3, "1 2 3", None), (4, None, None)]
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, make_docs(rows), "").collect()} == {1, 2}


def test_all_of_a_long_run_counts():
    plain, other = "a" * 300, "a" * 150 + "xyz" + "a" * 147
    assert set(language_id.features(plain, {})) != set(language_id.features(other, {}))
