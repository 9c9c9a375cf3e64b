"""Labels are read from labelled pages alone."""

import pytest

from tallyscope.llm import labelled_pages, pages_html

BODY = "<article><h1>A title</h1><p>First paragraph of the article, with enough words to read.</p></article>"
WANT = "A title\nFirst paragraph of the article, with enough words to read."


@pytest.fixture(scope="module")
def page_model():
    return pages_html.train(labelled_pages.pages())


@pytest.mark.parametrize("value", ["Price", "", "7", "-1", "1"])
def test_captions_of_tables_are_no_labels(spark, page_model, value):
    page = f'<body>{BODY[:-10]}<table><tr><td data-label="{value}">x</td></tr></table></article></body>'
    rows = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert pages_html.extract(rows, page_model).collect()[0].text == WANT + "\nx"
    assert {n.label for n in pages_html.parse(page, labelled=False)[0]} == {None}


def test_labels_other_than_0_and_1_are_ignored():
    assert [n.label for n in pages_html.parse('<p data-label="Price">a<p data-label="1">b<p data-label=0>c')[0]] == [None, None, 1, 0]
