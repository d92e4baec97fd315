"""Retrieval, decision and stability metrics; campaigns and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.index import top_k
from evidentia.operators.ranks import ranked

ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))


def rank_metrics(cases: DataFrame, cands: DataFrame) -> DataFrame:
    """Per case: rank of the first expected key, its reciprocal, and hits within 1, 3, 5 and 10. ``cases``: case_id, expected; ``cands``: case_id, key, rank."""
    want = cases.select("case_id", F.explode("expected").alias("key")).distinct()
    first = cands.join(want, ["case_id", "key"]).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    j = cases.select("case_id").join(first, "case_id", "left")
    hits = {f"hit_{k}": F.coalesce(F.col("first_rank") <= k, F.lit(False)) for k in (1, 3, 5, 10)}
    return j.withColumns({"reciprocal_rank": F.coalesce(F.round(1.0 / F.col("first_rank"), 6), F.lit(0.0)), **hits})


def recall_at_k(cases: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """Share of expected keys among the first ``k`` (0 if none are expected), and whether any expected or acceptable one is."""
    found = cands.filter(F.col("rank") <= k).groupBy("case_id").agg(F.collect_set("key").alias("found"))
    j = cases.join(found, "case_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return j.select("case_id", ratio(F.size(F.array_intersect("expected", "found")), F.size(F.array_distinct("expected"))).alias("recall"), F.arrays_overlap(F.array_union("expected", "acceptable"), "found").alias("hit"))


def aggregate_metrics(per_case: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means overall (category null) and by category in one pass over grouping sets.

    Values count by millionths, whose sums are exact, so that a mean does not depend on the order of addition.
    """
    millionths = {m: F.round(F.col(m).cast("double") * 1e6).cast("long") for m in metrics}
    g = per_case.groupingSets([[], [by]], by).agg(F.count("*").alias("n"), *((F.round(F.sum(x) / F.count(x)) / 1e6).alias(m) for m, x in millionths.items()), F.grouping(by).alias("overall"))
    return g.select(F.when(F.col("overall") == 0, F.col(by)).alias(by), (F.col("overall") == 1).alias("overall"), "n", *metrics)


def latency_summary(df: DataFrame, by: str, ms: str = "latency_ms") -> DataFrame:
    """Median, mean, maximum, sum and the floor-index 95th percentile, all exact.

    The p95 is the row at max(1, floor(0.95 n)) in order, the median the mean of the one or two middle rows. Places are found in
    ranges of values (see :func:`evidentia.operators.ranks.ranked`), so that no task sorts a category; null values do not count.
    """
    d = df.filter(F.col(ms).isNotNull()).select(F.col(by).alias("by_"), F.col(ms).alias("v"))
    sums = d.groupBy("by_").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("maximum"), F.round(F.sum("v"), 4).alias("total"))
    at = ranked(d, ["by_"], ["v"], "place").withColumnRenamed("by_", "b_").join(sums, F.col("b_").eqNullSafe(F.col("by_")))
    low, high, late = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2), F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    at = at.filter(F.col("place").isin(low, high, late))
    value = lambda place: F.max(F.when(F.col("place") == place, F.col("v")))
    return at.groupBy(F.col("by_").alias(by), "n", "mean", "maximum", "total").agg(F.round((value(low) + value(high)) / 2, 6).alias("p50"), F.round(value(late), 6).alias("p95")).select(by, "n", "p50", "p95", "mean", "maximum", "total")


def decision_confusion(outcomes: DataFrame) -> DataFrame:
    """2 x 2 counts of answers and abstentions, and the rate of right ones."""
    e, a = F.col("expected_answer"), F.col("answered")
    g = outcomes.agg(F.count_if(e & a).alias("answered_right"), F.count_if(e & ~a).alias("false_abstention"), F.count_if(~e & a).alias("unsafe_answer"), F.count_if(~e & ~a).alias("right_abstention"), F.count("*").alias("n"))
    return g.withColumn("correct_rate", ratio(F.col("answered_right") + F.col("right_abstention"), F.col("n")))


def evidence_quality(cases: DataFrame) -> DataFrame:
    """Expected keys among the selected, mean sizes and duplicates, and rates of abstentions and unsafe answers. ``cases``: retrieved, selected, expected, expect_answer, answered."""
    c = cases.withColumns({"in_selected": F.size(F.array_intersect("expected", "selected")) > 0, "dups": F.size("retrieved") - F.size(F.array_distinct("retrieved"))})
    e, a = F.col("expect_answer"), F.col("answered")
    return c.agg(
        ratio(F.count_if(e & F.col("in_selected")), F.count_if(e)).alias("expected_in_selected"),
        F.round(F.avg(F.size("retrieved")), 6).alias("avg_retrieved"),
        F.round(F.avg(F.size("selected")), 6).alias("avg_selected"),
        F.round(F.avg("dups"), 6).alias("avg_duplicates"),
        ratio(F.count_if(~e & ~a), F.count_if(~e)).alias("correct_abstention_rate"),
        ratio(F.count_if(e & ~a), F.count_if(e)).alias("false_abstention_rate"),
        ratio(F.count_if(~e & a), F.count_if(~e)).alias("unsafe_rate"),
    )


def outcome_class() -> Column:
    e, a, hit = F.col("expect_answer"), F.col("answered"), F.col("target_hit")
    return F.when(e & a & hit, "CORRECT_ANSWER").when(e & a, "WRONG_TARGET").when(e, "FALSE_ABSTENTION").when(a, "UNSAFE_ANSWER").otherwise("CORRECT_ABSTENTION")


def classify_outcomes(cases: DataFrame) -> DataFrame:
    """Class of each case and, for wrong ones, the first stage that lost the target (retrieved, selected, cited flags)."""
    c = cases.withColumn("outcome", outcome_class())
    bad = ~F.col("outcome").isin("CORRECT_ANSWER", "CORRECT_ABSTENTION")
    stage = F.when(bad & F.col("expect_answer"), F.when(~F.col("retrieved"), "RETRIEVAL").when(~F.col("selected"), "SELECTION").when(~F.col("answered"), "GENERATION").otherwise("ATTRIBUTION")).when(bad, "SAFETY")
    return c.withColumn("failure_stage", stage).select("case_id", "outcome", "failure_stage")


def campaign_cases(cases: DataFrame) -> DataFrame:
    """Per case: required keys found in retrieval and assembly, automatic pass, and the failure class by fixed precedence.

    ``cases``: required, retrieved, assembled (arrays), contract_ok, citations_ok, decision, expected_decision, review.
    """
    c = cases.withColumns({
        "required_n": F.size("required"),
        "retrieved_n": F.size(F.array_intersect("required", "retrieved")),
        "assembled_n": F.size(F.array_intersect("required", "assembled")),
        "decision_ok": F.col("decision").eqNullSafe(F.col("expected_decision")),
    })
    failure = (
        F.when(F.col("retrieved_n") < F.col("required_n"), F.when(F.col("assembled_n") < F.col("required_n"), "RETRIEVAL"))
        .when(F.col("assembled_n") < F.col("required_n"), "ASSEMBLY")
    )
    failure = F.coalesce(failure, F.when(~F.col("contract_ok"), "CONTRACT").when(~F.col("citations_ok"), "CITATION").when(~F.col("decision_ok"), "DECISION").when(F.coalesce(F.col("review"), F.lit("PASS")) == "FAIL", "REVIEW"))
    passed = (F.col("assembled_n") == F.col("required_n")) & F.col("contract_ok") & F.col("citations_ok") & F.col("decision_ok")
    return c.select("case_id", "category", "required_n", "retrieved_n", "assembled_n", passed.alias("automatic_pass"), failure.alias("failure_class"))


def campaign_metrics(cases: DataFrame) -> DataFrame:
    """One row: counts, micro-averaged required recall (1 if nothing is required) and a histogram of failures as columns."""
    recall = lambda c: F.when(F.sum("required_n") > 0, F.round(F.sum(c) / F.sum("required_n"), 6)).otherwise(1.0)
    classes = ("RETRIEVAL", "ASSEMBLY", "CONTRACT", "CITATION", "DECISION", "REVIEW")
    return cases.agg(F.count("*").alias("n"), F.count_if("automatic_pass").alias("automatic_pass"), recall("retrieved_n").alias("retrieval_recall"), recall("assembled_n").alias("assembly_recall"), F.count_if(F.col("retrieved_n") == F.col("required_n")).alias("full_retrieval"), *(F.count_if(F.col("failure_class") == k).alias(f"failed_{k.lower()}") for k in classes))


def compare_runs(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, before, after, delta for two one-row campaigns."""
    long = lambda df, name: df.select(*(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([], metrics, "metric", name)
    return long(a, "before").join(long(b, "after"), "metric", "full_outer").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def review_template(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "category", *(F.lit(None).cast("string").alias(c) for c in ("legal_correctness", "groundedness", "completeness", "comments")))


def join_review(auto: DataFrame, review: DataFrame) -> DataFrame:
    """Automatic and human results with an error (MISSING, EXTRA, CHANGED, BAD_VALUE or null) and a final status."""
    ok = ("PASS", "FAIL", "NOT_APPLICABLE")
    r = review.select("case_id", F.col("category").alias("r_category"), "legal_correctness", "groundedness", "completeness", F.lit(True).alias("reviewed"))
    j = auto.withColumn("is_case", F.lit(True)).join(r, "case_id", "full_outer")
    marks = [F.col(c) for c in ("legal_correctness", "groundedness", "completeness")]
    bad = pending = failed = F.lit(False)
    for m in marks:
        bad, pending, failed = bad | F.coalesce(~m.isin(*ok), F.lit(False)), pending | m.isNull(), failed | F.coalesce(m == "FAIL", F.lit(False))
    error = F.when(F.col("reviewed").isNull(), "MISSING").when(F.col("is_case").isNull(), "EXTRA").when(~F.col("category").eqNullSafe(F.col("r_category")), "CHANGED").when(bad, "BAD_VALUE")
    final = F.when(error.isNotNull(), "ERROR").when(pending, "PENDING").when(F.col("automatic_pass") & ~failed, "PASS").otherwise("FAIL")
    return j.select("case_id", "category", "automatic_pass", error.alias("error"), final.alias("final_status"))


def review_summary(final: DataFrame) -> DataFrame:
    """Pass rates by category, zero-safe."""
    done = F.col("final_status").isin("PASS", "FAIL")
    return final.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("final_status") == "PASS").alias("passed"), F.count_if(F.col("final_status") == "PENDING").alias("pending"), ratio(F.count_if(F.col("final_status") == "PASS"), F.count_if(done)).alias("pass_rate"))


def hash_stratified_sample(cases: DataFrame, salt: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``n`` cases per category by SHA-256 of salt and id, and the categories that have fewer."""
    scored = cases.withColumn("score", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("case_id").cast("string")), 256))
    return top_k(scored, "category", ["score", "case_id"], n, "pick"), cases.groupBy("category").agg(F.count("*").alias("have")).filter(F.col("have") < n)


def stability(runs: DataFrame) -> DataFrame:
    """Across seeds, per case: whether decision, coverage and citations are the same.

    Coverage counts only where the decision is ANSWER (null if no seed has one); a missing decision is a
    decision of its own; citation order doesn't matter.
    """
    cites = F.array_join(F.sort_array("citations"), ",")
    answered = F.when(F.col("decision") == "ANSWER", F.col("covered"))
    return runs.groupBy("case_id").agg(F.count("*").alias("runs"), (F.count_distinct(F.coalesce("decision", F.lit("∅"))) == 1).alias("decision_stable"), F.when(F.count(answered) > 0, F.count_distinct(answered) == 1).alias("coverage_stable"), F.count_distinct(cites).alias("citation_sets"))


def check_dataset(cases: DataFrame, categories: list[str]) -> DataFrame:
    """Violations (case_id, rule): repeated ids, unknown categories, blank questions, required keys outside the gold ones, a shape that the category forbids."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    c = cases.withColumn("n", n)
    rules = {
        "DUPLICATE_ID": F.col("n") > 1,
        "UNKNOWN_CATEGORY": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)),
        "BLANK_QUESTION": F.trim(F.coalesce("question", F.lit(""))) == "",
        "REQUIRED_NOT_GOLD": F.size(F.array_except("required", "gold")) > 0,
        "SHAPE": ((F.col("category") == "single") & (F.size("required") != 1)) | ((F.col("category") == "composite") & (F.size("required") < 2)) | (F.col("category").isin("insufficient", "ambiguous") & (F.size("required") > 0)),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in rules.items())), lambda r: r.isNotNull())
    return c.select("case_id", F.explode(found).alias("rule"))


def check_pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that aren't one to one: MISSING (left only), EXTRA (right only), DUPLICATE."""
    lc, rc = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    j = lc.join(rc, key, "full_outer")
    return j.select(key, F.when(F.col("r").isNull(), "MISSING").when(F.col("l").isNull(), "EXTRA").when((F.col("l") > 1) | (F.col("r") > 1), "DUPLICATE").alias("problem")).filter("problem is not null")


def judge_benchmark(cases: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of SUPPORTED, unsafe acceptances and possible false abstentions (expected, verdict)."""
    s = lambda c: F.col(c) == "SUPPORTED"
    g = cases.agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("verdict")).alias("ok"), F.count_if(s("expected") & s("verdict")).alias("tp"), F.count_if(s("verdict")).alias("said"), F.count_if(s("expected")).alias("are"), F.count_if(s("verdict") & (F.col("expected") == "UNSUPPORTED")).alias("unsafe_acceptance"), F.count_if(s("expected") & ~s("verdict")).alias("false_abstention_potential"))
    return g.select("n", ratio(F.col("ok"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("said")).alias("supported_precision"), ratio(F.col("tp"), F.col("are")).alias("supported_recall"), "unsafe_acceptance", "false_abstention_potential")


def provenance_consistency(items: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Keys that carry more than one payload."""
    return items.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*payload))).alias("payloads")).filter("payloads > 1")
