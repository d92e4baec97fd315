import random

import pytest

from evidentia.operators import structure

ODD = ["<!-- c -->", "<P>", "<br/>", "&amp;", "<a name=x>", "<script>a<b></script>", "<", ">", "<title>t</title>", "<a href='q'>", "</p >", '<a name="a&amp;b">', "<script>"]


@pytest.mark.parametrize("odd", [False, True])
def test_plain_reader_equals_the_parser(odd):
    """Random pages of tags and texts, nested in any way: the plain reader finds what the parser finds, or leaves the page to it."""
    rnd = random.Random(odd)
    bits = ["<p>", "</p>", '<p id="x">', '<a name="a1"></a>', '<a href="u" id="i">', "</a>", "<table>", "</table>", "<s>", "</s>", "<del>", "</del>", "<strike>", "</strike>", "<script>t > 1</script>", "<style>", "</style>", "<td>", "text ", "  ", "\n", " ", "a > b", '<p href="h" name="n">', "</script>", '<span id="z">', '<a name="" href="">']
    plain = 0
    for _ in range(4000):
        page = "".join(rnd.choice(bits + ODD * odd) for _ in range(rnd.randint(0, 25)))
        got = structure._plain_blocks(page, {})
        if got is not None:
            plain += 1
            assert got == structure._parsed_blocks(page), page
    assert plain > (100 if odd else 1500)


def test_columns_asked_for_and_kept_keys(spark):
    pages = spark.createDataFrame([(1, '<p id="k">A<s>b</s></p><p>c'), (2, None), (3, "x"), (4, "<P>&eacute;</P>")], "n long, html string")
    every = {(r.n, r.block): r for r in structure.html_blocks(pages, "n").collect()}
    assert [(k, r.text, r.any_struck, r.fully_struck, r.anchors) for k, r in sorted(every.items())] == [((1, 0), "Ab", True, False, ["k"]), ((1, 1), "c", False, False, []), ((4, 0), "é", False, False, [])]
    assert structure.html_blocks(pages, "n", only=("anchors",)).columns == ["n", "block", "anchors"]
