"""Acts are worked out on lines, which are sorted three times and read once."""

import re

from evidentia.operators import deep
from evidentia.plans import structures


def test_elements_and_coverage_sort_and_read_lines_few_times(spark, sf):
    act = deep.parse_act(structures.act_lines(spark, sf))
    for made, sorts in ((act.elements, 4), (act.coverage, 3)):  # one of them numbers the line items
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bSort \[", plan)) <= sorts
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_tree_order_where_it_is_not_that_of_places(spark):
    """A paragraph below an article that a later heading left open, a preamble within a title, and the same keys twice."""
    lines = ["TÍTULO I", "Art. 1º Um.", "CAPÍTULO I", "DO NOME", "da outra", "§ 1º Dois.", "PREÂMBULO", "Nós", "(Vide Lei 1)", "Art. 2º Três.", "TÍTULO I", "Art. 1º Um (Vide Lei 2)."]
    act = deep.parse_act(spark.createDataFrame([(1, i, x, False) for i, x in enumerate(lines)], "doc_id int, pos int, text string, struck boolean"))
    got = [(r.element_type, r.pos, r.text_status) for r in act.elements.orderBy("document_order").collect()]
    C, U, N = "CURRENT", "UNRESOLVED", "NOT_APPLICABLE"
    assert got == [
        ("DOCUMENT_ROOT", 0, C), ("TITLE", 0, U), ("ARTICLE", 1, C), ("CAPUT", 1, C), ("PARAGRAPH", 5, C), ("NOTE", 8, N), ("CHAPTER", 2, U), ("CHAPTER", 4, C), ("ARTICLE", 9, C), ("CAPUT", 9, C),
        ("PREAMBLE", 6, C), ("TITLE", 10, C), ("ARTICLE", 11, C), ("CAPUT", 11, C), ("NOTE", 11, N),
    ]
    assert [r.text for r in act.elements.filter("element_type = 'CHAPTER'").orderBy("document_order").collect()] == ["CAPÍTULO I\nDO NOME", "da outra"]
