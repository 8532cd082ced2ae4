"""op3 reads texts and pages to their end, as browsers do."""

import pytest

from docketry.llm import htmltree

SAY = "One river came down past the old mill, and the farm, before it met the bay."
MORE = "Boats lay there at low tide, and men waited for the rain to end."


@pytest.fixture(scope="module")
def model():
    return htmltree.fit(htmltree.LABELLED)


def test_capitals_are_counted_to_the_end_of_a_text():
    late, early = (htmltree.parse(f"<p>{t}</p>") for t in ("é b " * 100 + "ÉND " * 100, "ÉND " * 100 + "é b " * 100))
    assert late.nodes[1].upper == early.nodes[1].upper == 300
    upper = htmltree.FEATURES.index("upper")
    assert htmltree.matrix(late)[1, upper] == htmltree.matrix(early)[1, upper] == 300 / 799


@pytest.mark.parametrize("odd", [
    '<p title=5">', "<p don't>", '<p class="a"">', "<p a'b=c>", '<p ="x>', "<!--><p>", "<!---><p>", "<!-- note --!><p>", "<svg><title/><path/></svg><p>", '<svg><script href="a"/></svg><p>',
    "<math><mi>x<p>", "<svg><g><path><p>", "<svg><foreignObject><script>if (1 < 2) '</svg>'</script></foreignObject></svg><p>",
])
def test_odd_markup_does_not_end_the_page(model, odd):
    page = f'<body><nav><a href="/">Home</a></nav><article><h1>A title</h1><p>{SAY}</p>{odd}{MORE}</p><p>{SAY}</p></article>'
    assert htmltree.extract(page, model) == f"A title\n{SAY}\n{MORE}\n{SAY}"


@pytest.mark.parametrize("head", ["<head>", "<head><title>T</title><meta a=b>", "<head><head>\n<link a=b>\n", "<head><script>a='</scripts>'</script>"])
def test_a_head_ends_where_content_begins(model, head):
    assert htmltree.extract(f"<!DOCTYPE html><html>{head}<article><p>{SAY}</p><p>{MORE}</p></article>", model) == f"{SAY}\n{MORE}"
    # Bare text, too.
    assert ("".join(t for _, t, _ in htmltree.parse(f"<html>{head}{SAY}<p>{MORE}").runs)).strip() == SAY + MORE


@pytest.mark.parametrize("cut", ['<a href="x>', "<!-- ", "<script>", "<title>"])
def test_what_browsers_leave_out_to_the_end_stays_out(model, cut):
    assert htmltree.extract(f"<body><article><p>{SAY}</p><p>{MORE}</p>{cut}<p>never shown</p></article>", model) == f"{SAY}\n{MORE}"


def test_whole_pages_through_spark(spark, model):
    n = 400
    page = "<article>" + "".join(f"<p title={i}\">{SAY} {i}</p>" for i in range(n)) + "</article>"
    got = htmltree.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), model).collect()[0]
    assert got.text == "\n".join(f"{SAY} {i}" for i in range(n)) and got.n_chars == len(got.text)
