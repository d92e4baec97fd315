"""Findings of acts on single planted faults, clean acts and empty tables."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import act_audit, deep, structure

LINES = ["TÍTULO I", "DO TÍTULO", "Art. 1º Texto (Vide Lei 1) só (Vide Lei 1).", "Parágrafo único. Fica revogado.", "I - inciso um", "a) alínea 1", "1. 1", "Art. 2º (Vide Lei 9)", "solto"]


@pytest.fixture(scope="module")
def act(spark):
    lines = spark.createDataFrame([(1, i, x, False) for i, x in enumerate(LINES)], "doc_id int, pos int, text string, struck boolean")
    a = deep.parse_act(lines)
    elements = a.elements.cache()
    return elements, lines, a.coverage.cache(), structure.distinct_provisions(elements.filter("identity_key is not null"))[0].cache()


def codes(elements, lines, coverage, provisions):
    return sorted((r.code, r.block, r.element_type) for r in act_audit.act_findings(elements, lines, coverage, provisions).collect())


CLEAN = [("IGNORED_BLOCK_DIAGNOSED", 8, None), ("REPEATED_NOTE_TEXT_IN_SOURCE", 2, "NOTE")]


def test_clean_act_has_only_facts(act):
    """Sole paragraphs, items whose text is their label, articles that hold only a note and headings over two lines are in order."""
    assert codes(*act) == CLEAN


@pytest.mark.parametrize("kind, change, want", [
    ("INCISO", {"text": "outro"}, [("SOURCE_TEXT_UNCLAIMED", 4, None), ("TEXT_NOT_IN_SOURCE", 4, "INCISO")]),
    ("INCISO", {"text": "inciso"}, [("SOURCE_TEXT_UNCLAIMED", 4, None)]),
    ("INCISO", {"text_status": "REVOKED"}, [("REVOKED_WITHOUT_TEXTUAL_EVIDENCE", 4, "INCISO")]),
    ("PARAGRAPH", {"text_status": "REVOKED"}, []),
    ("ITEM", {"pos": 99}, [("PROVENANCE_INVALID", None, None)]),
    ("ALINEA", {"document_order": 99}, [("DOCUMENT_ORDER_INVALID", None, None)]),
    ("NOTE", {"content_role": "NORMATIVE"}, [("NOTE_INVALID", 2, "NOTE"), ("NOTE_INVALID", 2, "NOTE"), ("NOTE_INVALID", 7, "NOTE")]),
    ("ITEM", {"element_type": "CAPUT"}, [("ACT_OR_TYPE_IDENTITY_MISMATCH", 6, "CAPUT"), ("HIERARCHY_EDGE_UNEXPECTED", 6, "CAPUT")]),
])
def test_planted(act, kind, change, want):
    elements, *rest = act
    hit = F.col("element_type") == kind
    damaged = elements.select(*(F.when(hit, F.lit(change[c])).otherwise(F.col(c)).alias(c) if c in change else c for c in elements.columns))
    assert codes(damaged, *rest) == sorted(CLEAN + want, key=lambda x: (x[0], x[1] or 0))


def test_repeated_row_and_empty_tables(act):
    elements, lines, coverage, provisions = act
    twice = elements.union(elements.filter("element_type = 'CAPUT' and pos = 2"))
    assert {"ARTICLE_CAPUT_INVALID", "DOCUMENT_ORDER_INVALID", "MULTIPLE_CURRENT_PER_VERSION_PROVISION", "SOURCE_TEXT_OVERLAP"} <= {c[0] for c in codes(twice, lines, coverage, provisions)}
    assert codes(*(x.limit(0) for x in act)) == []


def test_few_sorts_and_no_texts_behind_the_first(act):
    """Windows go by line, order, article and key; what is sorted after the first of these has no texts."""
    plan = act_audit.act_findings(*act)._jdf.queryExecution().executedPlan().toString()
    windows = plan[: plan.index("ObjectHashAggregate")]
    assert windows.count("Sort [") <= 6
    generated = windows[windows.index("Generate explode") :]
    assert " text#" not in generated[: generated.index("Sort [")]
