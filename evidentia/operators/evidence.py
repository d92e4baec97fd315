"""Evidence assembly, selection and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import fold_tokens
from evidentia.operators.index import top_k


def direct_children(provisions: DataFrame, parents: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` children with text of each wanted parent; text is tested before numbering."""
    kids = provisions.filter(F.col("text").rlike(r"\S")).join(parents.select("version", F.col("key").alias("parent_key")).distinct(), ["version", "parent_key"], "left_semi")
    w = Window.partitionBy("version", "parent_key").orderBy("document_order", "key")
    return kids.withColumn("child_no", F.row_number().over(w)).filter(F.col("child_no") <= n)


def assemble_evidence(cands: DataFrame, provisions: DataFrame, per_parent: int = 8, total: int = 24) -> DataFrame:
    """Each candidate key in rank order with its direct children behind it; first occurrence wins; at most ``total``.

    As sets: a key's place is (rank, 0), a child's (rank of its parent, child number); the least place of
    each provision counts, and the cap counts only rows that are kept.
    """
    keys = cands.select("question_id", "version", "rank", F.col("key"))
    kids = direct_children(provisions, keys, per_parent).select("version", F.col("parent_key").alias("p"), F.col("key").alias("child"), "child_no")
    own = keys.join(provisions.select("version", "key"), ["version", "key"], "left_semi").select("question_id", "key", "rank", F.lit(0).alias("child_no"))
    under = keys.join(kids, (keys["version"] == kids["version"]) & (F.col("key") == F.col("p"))).select("question_id", F.col("child").alias("key"), "rank", "child_no")
    place = own.union(under).groupBy("question_id", "key").agg(F.min(F.struct("rank", "child_no")).alias("place"))
    return top_k(place, "question_id", ["place", "key"], total, "position").select("question_id", "key", "position", F.col("place.child_no").alias("child_no"))


def materialize_keys(keys: DataFrame, provisions: DataFrame) -> DataFrame:
    return keys.join(provisions, ["version", "key"])


def missing_keys(keys: DataFrame, provisions: DataFrame) -> DataFrame:
    return keys.join(provisions, ["version", "key"], "left_anti")


def freeze_evidence(cands: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates whose stored text is the candidate's; codes ``EVnnn`` number candidate positions, gaps kept."""
    j = cands.join(chunks.select("id", F.col("text").alias("stored")), "id").filter("stored = text").drop("stored")
    return j.withColumn("code", F.format_string("EV%03d", F.col("position")))


def relevance(cands: DataFrame) -> DataFrame:
    """Overlap, base score and eligibility of candidates (question, text, parent_text, position). Provisions are kept once, first position first, and positions are numbered again from 0."""
    w = Window.partitionBy("question_id")
    first = cands.withColumn("own", F.row_number().over(Window.partitionBy("question_id", "provision").orderBy("position"))).filter("own = 1").drop("own")
    first = first.withColumn("position", F.row_number().over(w.orderBy("position")) - 1)
    q = fold_tokens(F.col("question"))
    t = F.array_union(fold_tokens(F.col("text")), fold_tokens(F.coalesce("parent_text", F.lit(""))))
    c = first.withColumns({"q_tokens": q, "tokens": t}).withColumn("shared", F.array_intersect("q_tokens", "tokens")).withColumn("overlap", F.size("shared"))
    best = F.max("overlap").over(w)
    least = F.when(F.size("q_tokens") <= 3, 1).otherwise(F.greatest(F.lit(1), F.floor((best + 1) / 2)))
    base = F.when(F.size("q_tokens") > 0, 0.65 * F.col("overlap") / F.size("q_tokens")).otherwise(0.0) + 0.20 / (F.col("position") + 1) + F.when(F.col("parent_text").isNotNull(), 0.15).otherwise(0.0)
    return c.withColumn("eligible", F.col("overlap") >= least).withColumn("base", base)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def select_evidence(cands: DataFrame, limit: int = 3) -> DataFrame:
    """Greedy selection by coverage less redundancy, with its diagnostics, in ``limit`` rounds of windows over one partitioning by question.

    First the best base score, then the best of 0.45 base + 0.40 marginal + 0.15 (1 - redundancy). A later candidate is
    passed over only if it covers nothing new and is weak (base under 0.30) or redundant (0.85 or more). Ties
    go to the earlier position. A question's candidates are never held in Python; any number of them will do.
    """
    w = Window.partitionBy("question_id")
    c = relevance(cands).filter("eligible").select("question_id", "id", "position", "q_tokens", "tokens", "shared", "base")
    c = c.withColumns({"pick": F.lit(None).cast("int"), "covered": F.array().cast("array<string>"), "marginal": F.lit(0.0), "redundancy": F.lit(0.0), "final": F.col("base")})
    for no in range(1, limit + 1):
        free = F.col("pick").isNull()
        if no > 1:
            marginal = F.size(F.array_except("shared", "covered")) / F.size("q_tokens")
            c = c.withColumn("marginal", F.when(free, marginal).otherwise(F.col("marginal")))
            c = c.withColumn("final", F.when(free, 0.45 * F.col("base") + 0.40 * F.col("marginal") + 0.15 * (1.0 - F.col("redundancy"))).otherwise(F.col("final")))
            free = free & ~((F.col("marginal") == 0) & ((F.col("base") < 0.30) | (F.col("redundancy") >= 0.85)))
        best = F.max(F.when(free, F.struct("final", (-F.col("position")).alias("back"), "tokens", "shared"))).over(w)
        c = c.withColumn("best", best)
        c = c.withColumn("pick", F.when(F.col("pick").isNull() & free & (F.col("position") == -F.col("best.back")), no).otherwise(F.col("pick")))
        if no < limit:
            seen = F.greatest("redundancy", jaccard(F.col("tokens"), F.col("best.tokens")))
            c = c.withColumn("redundancy", F.when(F.col("pick").isNull() & F.col("best").isNotNull(), seen).otherwise(F.col("redundancy")))
            c = c.withColumn("covered", F.when(F.col("best").isNull(), F.col("covered")).otherwise(F.array_union("covered", F.col("best.shared"))))
    return c.filter("pick is not null").select("question_id", "pick", "id", *(F.round(x, 6).alias(x) for x in ("base", "marginal", "redundancy", "final")))


def selection_fallbacks(cands: DataFrame, limit: int = 3) -> DataFrame:
    """First pick where nothing is chosen greedily: without question tokens the first ``limit`` by position, without an eligible candidate only the first."""
    r = relevance(cands).withColumn("any", F.max(F.col("eligible").cast("int")).over(Window.partitionBy("question_id"))).withColumn("no", F.row_number().over(Window.partitionBy("question_id").orderBy("position")))
    reason = F.when(F.size("q_tokens") == 0, "NO_QUESTION").when(F.col("any") == 0, "NONE_ELIGIBLE")
    return r.withColumn("reason", reason).filter(((F.col("reason") == "NO_QUESTION") & (F.col("no") <= limit)) | ((F.col("reason") == "NONE_ELIGIBLE") & (F.col("no") == 1))).select("question_id", "id", "reason", F.col("no").alias("pick"))


def sufficiency(questions: DataFrame, cands: DataFrame, out_of_scope: list[str], least_lexical: float = 0.15, least_vector: float = 0.60) -> DataFrame:
    """Status per question with maximal scores and how many candidates both channels found."""
    g = cands.groupBy("question_id").agg(F.count("*").alias("n"), F.max("lexical_score").alias("max_lexical"), F.max("vector_score").alias("max_vector"), F.count_if(F.col("lexical_score").isNotNull() & F.col("vector_score").isNotNull()).alias("agreement"), F.max(F.col("anchored").cast("int")).alias("anchored"))
    q = questions.join(g, "question_id", "left")
    scope = F.lit(False)
    for pattern in out_of_scope:
        scope = scope | F.coalesce(F.lower("question").rlike(pattern), F.lit(False))
    weak = (F.coalesce("max_lexical", F.lit(0.0)) < least_lexical) & (F.coalesce("max_vector", F.lit(0.0)) < least_vector) & (F.coalesce("anchored", F.lit(0)) == 0)
    reason = F.when(scope, "OUT_OF_SCOPE").when(F.col("n").isNull(), "NO_CANDIDATES").when(weak, "WEAK_MATCH")
    return q.select("question_id", F.when(reason.isNull(), "SUFFICIENT").otherwise("INSUFFICIENT").alias("status"), reason.alias("reason"), "max_lexical", "max_vector", F.coalesce("agreement", F.lit(0)).cast("long").alias("agreement"))


def core_evidence(items: DataFrame) -> DataFrame:
    """Best item by (coverage, marginal, base, earlier position, lower code); none if any item lacks a signal."""
    ok = F.min(F.coalesce("coverage", "marginal", "base").isNotNull().cast("int") * (F.col("coverage").isNotNull() & F.col("marginal").isNotNull() & F.col("base").isNotNull()).cast("int"))
    first = F.min_by("code", F.struct(-F.col("coverage"), -F.col("marginal"), -F.col("base"), "position", "code"))
    return items.groupBy("question_id").agg(ok.alias("ok"), first.alias("code")).select("question_id", F.when(F.col("ok") == 1, F.col("code")).alias("core_code"))


def extractive_answer(core: DataFrame, items: DataFrame) -> DataFrame:
    """One literal claim citing the core evidence, else an abstention."""
    j = core.join(items.select("question_id", F.col("code").alias("core_code"), "text"), ["question_id", "core_code"], "left")
    return j.select("question_id", F.when(F.col("text").isNull(), "ABSTAIN").otherwise("ANSWER").alias("decision"), F.col("text").alias("claim"), F.when(F.col("text").isNotNull(), F.array("core_code")).otherwise(F.array().cast("array<string>")).alias("citations"))


def route_mode(queries: DataFrame, modes: DataFrame) -> DataFrame:
    """Declared mode by category; CASE_APPLICATION is clarified without retrieval, an unknown category is rejected."""
    q = queries.join(modes, "category", "left")
    return q.withColumns({"decision": F.when(F.col("mode") == "CASE_APPLICATION", "CLARIFY").when(F.col("mode").isNull(), "REJECT"), "retrieve": F.coalesce(F.col("mode") == "LEGAL_RULE", F.lit(False))})


def abstain_when_empty(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    return queries.join(evidence.select("question_id").distinct(), "question_id", "left_anti").withColumns({"decision": F.lit("ABSTAIN"), "executed": F.lit(False)})


STAGES = ("retrieval", "selection", "sufficiency", "attribution", "locator", "citation", "polarity", "semantic")


def consult_batch(staged: DataFrame, stages: tuple = STAGES) -> DataFrame:
    """First failing stage per attempt (a boolean column per stage, null: not run), and the first attempt without one per question."""
    failed: Column = F.coalesce(*(F.when(~F.coalesce(F.col(s), F.lit(False)), F.lit(s)) for s in stages))
    a = staged.withColumn("failed_stage", failed)
    best = F.min_by(F.struct("attempt", "failed_stage"), F.struct(F.col("failed_stage").isNotNull(), "attempt"))
    return a.groupBy("question_id").agg(best.alias("b"), F.count("*").alias("attempts")).select("question_id", "attempts", F.col("b.attempt").alias("attempt"), F.col("b.failed_stage").alias("failed_stage"), F.when(F.col("b.failed_stage").isNull(), "ANSWER").otherwise("ABSTAIN").alias("decision"))


def persist_citations(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citation rows (claim by evidence code), and each question's rendered answer with its hash."""
    cites = claims.select("question_id", "claim_no", F.posexplode("codes").alias("position", "code"))
    line = F.concat(F.col("claim"), F.lit(" ["), F.array_join("codes", ", "), F.lit("]"))
    rendered = claims.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    return cites, rendered.withColumn("answer_sha256", F.sha2("answer", 256))


def render_evidence(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Evidence as one text per question, in order; a placeholder where there is none."""
    t = items.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "label", "text"))), lambda x: F.concat(F.lit("["), x["label"], F.lit("] "), x["text"])), "\n").alias("evidence_text"))
    return questions.join(t, "question_id", "left").withColumn("evidence_text", F.coalesce("evidence_text", F.lit("(no evidence)")))
