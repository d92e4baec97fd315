"""Answer verification: contract, citations, attribution, polarity, locators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import fold, fold_tokens

DECISIONS = ("ANSWER", "ABSTAIN", "CLARIFY")


def parse_answers(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds decision, answer, citations and ``error`` by a strict JSON contract (null error: valid).

    Three fields and no other, a known decision, an answer that isn't blank, citations exactly when the
    decision is ANSWER, and no citation twice. Trailing text, NaN and the like are not JSON.
    """

    def strict(s: pd.Series) -> pd.DataFrame:
        def no(x):
            raise ValueError(x)

        out = []
        for t in s:
            try:
                d = json.loads(t, parse_constant=no)
            except (ValueError, TypeError, RecursionError):
                out.append((False, None, False, None, None, None))
                continue
            if not isinstance(d, dict):
                out.append((True, None, False, None, None, None))
                continue
            cites = d.get("citations")
            fine = isinstance(d.get("decision"), str) and isinstance(d.get("answer"), str) and isinstance(cites, list) and all(isinstance(x, str) for x in cites)
            out.append((True, sorted(d), fine, d["decision"] if fine else None, d["answer"] if fine else None, cites if fine else None))
        return pd.DataFrame(out, columns=["is_json", "fields", "typed", "decision", "answer", "citations"])

    p = responses.withColumn("p", F.pandas_udf(strict, "is_json boolean, fields array<string>, typed boolean, decision string, answer string, citations array<string>")(raw))
    n = F.size("p.citations")
    error = (
        F.when(~F.col("p.is_json"), "INVALID_JSON")
        .when(F.col("p.fields").isNull(), "NOT_OBJECT")
        .when(F.col("p.fields") != F.array(F.lit("answer"), F.lit("citations"), F.lit("decision")), "BAD_FIELDS")
        .when(~F.col("p.typed"), "BAD_TYPES")
        .when(~F.col("p.decision").isin(*DECISIONS), "BAD_DECISION")
        .when(F.trim("p.answer") == "", "BLANK_ANSWER")
        .when((F.col("p.decision") != "ANSWER") & (n > 0), "CITATIONS_WITHOUT_ANSWER")
        .when((F.col("p.decision") == "ANSWER") & (n == 0), "ANSWER_WITHOUT_CITATIONS")
        .when(F.size(F.array_distinct("p.citations")) < n, "DUPLICATE_CITATION")
    )
    return p.select(*responses.columns, "p.decision", "p.answer", "p.citations", error.alias("error"))


def validate_citations(answers: DataFrame, evidence: DataFrame, keys: DataFrame) -> DataFrame:
    """INVALID_CITATION (outside the corpus) before OUT_OF_EVIDENCE (outside the evidence) before VALID, with the offending keys."""
    c = answers.select("question_id", F.explode_outer("citations").alias("key")).distinct()
    k = keys.select(F.col("key").alias("k_key")).distinct()
    e = evidence.select(F.col("question_id").alias("e_q"), F.col("key").alias("e_key")).distinct()
    j = c.join(k, F.col("key") == F.col("k_key"), "left").join(e, (F.col("question_id") == F.col("e_q")) & (F.col("key") == F.col("e_key")), "left")
    g = j.groupBy("question_id").agg(F.sort_array(F.collect_list(F.when(F.col("k_key").isNull(), F.col("key")))).alias("unknown"), F.sort_array(F.collect_list(F.when(F.col("k_key").isNotNull() & F.col("e_key").isNull(), F.col("key")))).alias("outside"))
    return g.select("question_id", F.when(F.size("unknown") > 0, "INVALID_CITATION").when(F.size("outside") > 0, "OUT_OF_EVIDENCE").otherwise("VALID").alias("status"), F.when(F.size("unknown") > 0, F.col("unknown")).otherwise(F.col("outside")).alias("keys"))


def ambiguous_citations(citations: DataFrame, keys: DataFrame, pattern: str) -> DataFrame:
    """Citations outside a partial namespace that are well-formed keys, so they can't be called invalid."""
    return citations.join(keys.select("key").distinct(), "key", "left_anti").filter(F.col("key").rlike(pattern))


PREDICATE = r"\b(is|are|was|were|has|have|had|will|shall|must|may|can|should)\b"
SPLITTERS = (r";\s*", r",\s+(?=and\b|or\b)", r"\s+(?:and|but)\s+")
PROTECTED = r"\b(unless|except|provided that|only if)\b"


def clause_spans(text: Column, splitter: str) -> Column:
    """What lies between the matches of ``splitter``, without the spaces, commas and semicolons around it: array of (start from 1, length, clause)."""
    gap = r"[ ,;\t\n]+"
    raw = F.zip_with(F.split(text, splitter), F.regexp_extract_all(text, F.lit(splitter), F.lit(0)), lambda p, d: F.struct(p.alias("part"), F.length(F.coalesce(d, F.lit(""))).alias("after")))

    def step(acc: Column, x: Column) -> Column:
        led = F.regexp_replace(x["part"], f"^{gap}", "")
        clause = F.regexp_replace(led, f"{gap}$", "")
        start = (acc["at"] + F.length(x["part"]) - F.length(led)).cast("int")
        span = F.struct(start.alias("start"), F.length(clause).alias("length"), clause.alias("clause"))
        return F.struct((acc["at"] + F.length(x["part"]) + x["after"]).cast("int").alias("at"), F.when(clause == "", acc["spans"]).otherwise(F.array_append(acc["spans"], span)).alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int,clause:string>>")
    return F.aggregate(raw, F.struct(F.lit(1).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def split_clauses(claims: DataFrame, predicate: str = PREDICATE, splitters: tuple = SPLITTERS, protected: str = PROTECTED) -> DataFrame:
    """Clauses of a claim with clause_no, clause, start (from 1) and length: ``substr(claim, start, length)`` is the clause.

    The first splitter counts whose parts, of two at least, all have two tokens and a predicate; protected scopes stay whole. A whole claim
    goes without white space around it, a blank one as it is; a null claim is one null clause.
    """
    text, low = F.col("claim"), F.lower("claim")

    def usable(parts: Column) -> Column:
        return (F.size(parts) > 1) & F.forall(parts, lambda p: (F.size(F.regexp_extract_all(p["clause"], F.lit(r"(\p{L}+)"), F.lit(1))) >= 2) & F.lower(p["clause"]).rlike(predicate))

    led = F.regexp_replace(text, r"^\s+", "")
    bare = F.regexp_replace(led, r"\s+$", "")
    blank = bare == ""
    whole = F.array(F.struct(F.when(blank, 1).otherwise(F.length(text) - F.length(led) + 1).alias("start"), F.length(F.when(blank, text).otherwise(bare)).alias("length"), F.when(blank, text).otherwise(bare).alias("clause")))
    chosen = F.when(low.rlike(protected), whole)
    for s in splitters:
        parts = clause_spans(text, s)
        chosen = chosen.when(usable(parts), parts)
    kept = [c for c in claims.columns if c != "claim"]
    return claims.select(*kept, F.posexplode(chosen.otherwise(whole)).alias("clause_no", "c")).select(*kept, "clause_no", "c.clause", "c.start", "c.length")


def clause_scores(clauses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Score of each evidence item for each clause by an equi-join on (question, token); weights ln((n+1)/(df+1))+1 over the question's evidence."""
    e = evidence.select("question_id", "code", F.explode(fold_tokens(F.col("text"))).alias("token"))
    n = evidence.groupBy("question_id").agg(F.count("*").alias("n_items"))
    df = e.groupBy("question_id", "token").agg(F.count("*").alias("df"))
    c = clauses.select("question_id", "claim_no", "clause_no", F.explode(fold_tokens(F.col("clause"))).alias("token")).join(n, "question_id").join(df, ["question_id", "token"], "left")
    c = c.withColumn("w", F.log((F.col("n_items") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    total = c.groupBy("question_id", "claim_no", "clause_no").agg(F.sum("w").alias("total"), F.count("*").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("weights"))
    s = c.join(e, ["question_id", "token"]).groupBy("question_id", "claim_no", "clause_no", "code").agg(F.sum("w").alias("shared_w"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return s.join(total, ["question_id", "claim_no", "clause_no"]).withColumn("score", F.round(F.col("shared_w") / F.col("total"), 6))


def attribute_claims(clauses: DataFrame, evidence: DataFrame, most: int = 4) -> DataFrame:
    """Evidence codes of each clause and whether it is resolved.

    The best item needs 0.55, or 0.40 with a lead of 0.08; further ones, in score order, need 0.35 and
    new tokens, until ``most`` items or 0.90 of the weight are covered. A clause of several needs covered
    weight and covered share of tokens of 0.60.
    """
    keys = ["question_id", "claim_no", "clause_no"]
    s = clause_scores(clauses, evidence)
    g = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "code", "tokens"))).alias("items"), F.first("weights").alias("weights"), F.first("total").alias("total"), F.first("n_tokens").alias("n_tokens"))
    weigh = lambda tokens: F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.element_at("weights", t))

    def step(acc, x):
        grown = F.array_union(acc["covered"], x["tokens"])
        first = F.size(acc["codes"]) == 0
        take = ~acc["stop"] & (first | ((-x["neg"] >= 0.35) & (F.size(grown) > F.size(acc["covered"]))))
        codes = F.when(take, F.array_append(acc["codes"], x["code"])).otherwise(acc["codes"])
        covered = F.when(take, grown).otherwise(acc["covered"])
        return F.struct(codes.alias("codes"), covered.alias("covered"), (acc["stop"] | (F.size(codes) >= most) | (weigh(covered) / F.col("total") >= 0.90)).alias("stop"))

    start = F.struct(F.array().cast("array<string>").alias("codes"), F.array().cast("array<string>").alias("covered"), F.lit(False).alias("stop"))
    g = g.withColumn("r", F.aggregate("items", start, step)).withColumn("best", -F.col("items")[0]["neg"]).withColumn("second", F.coalesce(-F.get("items", F.lit(1))["neg"], F.lit(0.0)))
    g = g.withColumn("weighted", F.round(weigh(F.col("r.covered")) / F.col("total"), 6)).withColumn("literal", F.round(F.size("r.covered") / F.col("n_tokens"), 6))
    per = F.count("*").over(Window.partitionBy("question_id", "claim_no"))
    j = clauses.select(*keys).join(g, keys, "left").withColumn("parts", per)
    reason = (
        F.when(F.col("best").isNull() | (F.col("best") < 0.40), "NO_EVIDENCE")
        .when((F.col("best") < 0.55) & (F.col("best") - F.col("second") < 0.08), "AMBIGUOUS")
        .when((F.col("parts") > 1) & (F.least("weighted", "literal") < 0.60), "LOW_COVERAGE")
    )
    return j.select(*keys, F.when(reason.isNull(), F.col("r.codes")).otherwise(F.array().cast("array<string>")).alias("codes"), F.col("best").alias("best_score"), reason.alias("reason"))


# Word families of each flag, as patterns over accent-folded lower-case text.
LEXICON = {
    "PROHIBITIVE": r"\b(must not|shall not|may not|cannot|prohibited|forbidden|never)\b",
    "OBLIGATORY": r"\b(must|shall|required|mandatory|obliged)\b",
    "OPTIONAL": r"\b(optional|need not|voluntary)\b",
    "PERMISSIVE": r"\b(may|can|permitted|allowed)\b",
    "EXCEPTION": r"\b(except|unless|provided that|save)\b",
    "AFFIRMATIVE": r"\b(is|are|was|has|have)\b",
}


def polarity_profile(c: Column, lexicon: dict[str, str] = LEXICON) -> Column:
    """Flags of a text; a prohibition silences obligation, permission and affirmation."""
    t = fold(c)
    no = t.rlike(lexicon["PROHIBITIVE"])
    return F.array_compact(F.array(*(F.when(t.rlike(p) & (~no if k in ("OBLIGATORY", "PERMISSIVE", "AFFIRMATIVE") else F.lit(True)), F.lit(k)) for k, p in lexicon.items())))


def polarity_check(pairs: DataFrame, lexicon: dict[str, str] = LEXICON) -> DataFrame:
    """CONSISTENT, CONTRADICTED or UNRESOLVED with a reason, for (claim, evidence) pairs; ``passes`` says whether a pair goes on."""
    p = pairs.withColumns({"cp": polarity_profile(F.col("claim"), lexicon), "ep": polarity_profile(F.col("evidence"), lexicon)})
    targets = lambda c: F.transform(fold_tokens(F.col(c), 4, plural=False, stem=7), lambda t: t)
    has = lambda side, flag: F.array_contains(side, flag)
    clash = lambda a, b: (has("cp", a) & has("ep", b)) | (has("cp", b) & has("ep", a))
    none = ~F.arrays_overlap(targets("claim"), targets("evidence"))
    reason = (
        F.when(none, "NO_TARGET_OVERLAP")
        .when((F.size("cp") == 0) | (F.size("ep") == 0), "NO_POLARITY_RELATION")
        .when(clash("PROHIBITIVE", "PERMISSIVE"), "PROHIBITION_PERMISSION")
        .when(clash("OBLIGATORY", "OPTIONAL"), "OBLIGATION_OPTION")
        .when(has("ep", "EXCEPTION") & ~has("cp", "EXCEPTION"), "EXCEPTION_MISSING")
        .when(F.arrays_overlap("cp", "ep"), "SHARED_FLAG")
        .otherwise("NO_POLARITY_RELATION")
    )
    status = F.when(F.col("reason").isin("PROHIBITION_PERMISSION", "OBLIGATION_OPTION"), "CONTRADICTED").when(F.col("reason") == "SHARED_FLAG", "CONSISTENT").otherwise("UNRESOLVED")
    return p.withColumn("reason", reason).withColumn("status", status).withColumn("passes", (F.col("status") == "CONSISTENT") | (F.col("reason") == "NO_POLARITY_RELATION")).drop("cp", "ep")


def locator_check(claims: DataFrame, pattern: str = r"(?i)\barticle\s+(\d+)") -> DataFrame:
    """Numbers a claim mentions must be among its cited keys; exact extracts are exempt."""
    said = F.array_distinct(F.regexp_extract_all("claim", F.lit(pattern), F.lit(1)))
    c = claims.withColumn("missing", F.when(F.col("is_extract"), F.array().cast("array<string>")).otherwise(F.array_except(said, F.col("cited_numbers"))))
    return c.withColumn("locator_ok", F.size("missing") == 0)


# Fixed value: a place in an act, with article, inciso or paragraph, and letter.
LOCATOR = r"(?iu)\bart\.?\s*(\d+)[ºo]?(?:\s*,?\s*(?:inciso|§)\s*([IVXLCDM]+|\d+))?(?:\s*,?\s*alínea\s*[\"']?([a-z]))?"
EXTRACTS = ("EBCG_V1", "EBCG_V2")  # fixed values: modes whose claims are extracts


def locator_groups(claims: DataFrame, cited: DataFrame, pattern: str = LOCATOR, extracts: tuple = EXTRACTS) -> DataFrame:
    """Claims with ``places`` (how many they name) and ``locator_ok``: one of them must lie in the identity of a cited item.

    ``claims``: question_id, claim_no, claim, mode; ``cited``: question_id, claim_no, identity_key, snapshot_text. A place lies in
    an identity that has its article's step and, where named, one with its inciso or paragraph and its letter; steps are
    found as text, so article 1 also lies in 12. Claims without a place are in order, as is a verbatim extract of the only
    item it cites. A claim without citations has no item to lie in; null identities are empty.
    """
    keys = ["question_id", "claim_no"]
    c = cited.groupBy(*keys).agg(F.collect_list(F.upper(F.coalesce("identity_key", F.lit("")))).alias("identities"), F.count("*").alias("n_cited"), F.max("snapshot_text").alias("only_text"))
    all_of = lambda i: F.regexp_extract_all(F.coalesce("claim", F.lit("")), F.lit(pattern), F.lit(i))
    places = F.transform(F.arrays_zip(all_of(1).alias("article"), all_of(2).alias("sub"), all_of(3).alias("letter")), lambda x: F.struct(F.concat(F.lit("ARTICLE:"), x["article"]).alias("article"), F.concat(F.lit(":"), F.upper(x["sub"])).alias("sub"), F.concat(F.lit("ALINEA:"), F.upper(x["letter"])).alias("letter")))
    lies = lambda p, i: F.contains(i, p["article"]) & ((p["sub"] == ":") | F.contains(i, p["sub"])) & ((p["letter"] == "ALINEA:") | F.contains(i, p["letter"]))
    j = claims.join(c, keys, "left").withColumn("found", places)
    extract = F.col("mode").isin(*extracts) & (F.col("n_cited") == 1) & (F.col("only_text") == F.col("claim"))
    inside = F.exists("found", lambda p: F.exists(F.coalesce("identities", F.array().cast("array<string>")), lambda i: lies(p, i)))
    ok = F.coalesce(extract, F.lit(False)) | (F.size("found") == 0) | inside
    return j.select(*claims.columns, F.size("found").alias("places"), ok.alias("locator_ok"))


def answer_chain_check(answers: DataFrame, claims: DataFrame, items: DataFrame, code_pattern: str = r"\bEV\d{3,}\b") -> DataFrame:
    """All errors (question_id, claim_code, code, error) of answers, from their claims down to the stored documents; each once.

    ``answers``: question_id, answer, abstain; ``claims`` as in :func:`citation_chain_check`; ``items``: question_id, code,
    validated, snapshot_text, stored_text, source_url, stored_url (stored ones null where the chain breaks). An abstained
    answer may have no claims, and is not looked at further; others need one, and name no code in their text that is no item of
    theirs. Of an item that is not validated, or has no chain, nothing else is said.
    """
    open_ = answers.filter(~F.coalesce("abstain", F.lit(False))).select("question_id")
    heads = claims.select("question_id").distinct()
    none = F.lit(None).cast("string")
    row = lambda df, error, code=none: df.select("question_id", none.alias("claim_code"), code.alias("code"), F.lit(error).alias("error"))
    gave_up = row(answers.filter("abstain").join(heads, "question_id", "left_semi"), "CLAIMS_OF_ABSTAINED")
    bare = row(open_.join(heads, "question_id", "left_anti"), "NO_CLAIMS")
    said = answers.join(open_, "question_id", "left_semi").select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(code_pattern), F.lit(0)))).alias("code"))
    foreign = row(said.join(items.select("question_id", "code"), ["question_id", "code"], "left_anti"), "UNKNOWN_IN_ANSWER", F.col("code"))
    live = claims.join(open_, "question_id", "left_semi")
    usable = items.withColumn("sound", F.coalesce("validated", F.lit(False)))
    of_claims = citation_chain_check(live, items.withColumn("stored_text", F.when(F.col("validated"), F.col("stored_text")).otherwise(F.col("snapshot_text"))))
    used = live.select("question_id", "claim_code", F.explode("codes").alias("code")).join(usable, ["question_id", "code"])
    drift = F.when(~F.col("sound"), "NOT_VALIDATED").when(F.col("stored_text").isNotNull() & ~F.col("source_url").eqNullSafe(F.col("stored_url")), "URL_DRIFT")
    of_items = used.select("question_id", "claim_code", "code", drift.alias("error")).filter("error is not null")
    return gave_up.union(bare).union(foreign).union(of_claims).union(of_items).distinct()


def citation_chain_check(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Error rows (question_id, claim_code, code, error): blank or repeated claim code, no text, no citation, unknown code, text drift."""
    n = F.count("*").over(Window.partitionBy("question_id", "claim_code"))
    c = claims.withColumn("n", n)
    row = lambda cond, name: c.filter(cond).select("question_id", "claim_code", F.lit(None).cast("string").alias("code"), F.lit(name).alias("error"))
    errors = row(F.trim(F.coalesce("claim_code", F.lit(""))) == "", "BLANK_CODE").union(row(F.col("n") > 1, "DUPLICATE_CODE")).union(row(F.trim(F.coalesce("claim", F.lit(""))) == "", "NO_TEXT")).union(row(F.size("codes") <= 0, "NO_CITATION"))
    used = c.select("question_id", "claim_code", F.explode("codes").alias("code"))
    j = used.join(items.select("question_id", "code", "snapshot_text", "stored_text", F.lit(1).alias("known")), ["question_id", "code"], "left")
    drift = j.select("question_id", "claim_code", "code", F.when(F.col("known").isNull(), "UNKNOWN_CODE").when(F.col("stored_text").isNull(), "CHAIN_MISSING").when(~F.col("snapshot_text").eqNullSafe(F.col("stored_text")), "TEXT_DRIFT").alias("error")).filter("error is not null")
    return errors.union(drift).distinct()


def semantic_status(claims: DataFrame, judgements: DataFrame) -> DataFrame:
    """SUPPORTED, PARTIALLY or UNSUPPORTED per claim from three booleans; downgraded without a lexical anchor; ``report_valid`` is false where a claim lacks a judgement."""
    j = claims.join(judgements, ["question_id", "claim_no"], "left")
    yes = F.col("entails") & F.col("complete") & ~F.col("contradicts")
    status = F.when(F.col("entails").isNull(), "MISSING").when(yes & F.col("anchored"), "SUPPORTED").when((yes & ~F.col("anchored")) | (F.col("entails") & ~F.col("contradicts")), "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return j.withColumn("status", status).withColumn("report_valid", F.bool_and(F.col("status") != "MISSING").over(Window.partitionBy("question_id")))


def evaluate_answers(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Twelve checks per case and automatic_pass, from expected and observed arrays.

    ``cases``: is_json, schema_ok, decision, expected_decision, citations, evidence, corpus_hit (citations in the
    corpus), required.
    """
    c = F.col
    cites = F.coalesce("citations", F.array().cast("array<string>"))
    checks = {
        "json_valid": c("is_json"),
        "schema_valid": c("schema_ok"),
        "decision_valid": F.coalesce(c("decision").isin(*DECISIONS), F.lit(False)),
        "payload_valid": c("schema_ok") & F.coalesce((c("decision") == "ANSWER") == (F.size(cites) > 0), F.lit(False)),
        "decision_match": c("decision").eqNullSafe(c("expected_decision")),
        "citation_subset": F.size(F.array_except(cites, c("evidence"))) == 0,
        "no_invalid": F.size(F.array_except(cites, c("corpus_hit"))) == 0,
        "no_out_of_evidence": F.size(F.array_except(F.array_intersect(cites, c("corpus_hit")), c("evidence"))) == 0,
        "required_covered": (c("expected_decision") != "ANSWER") | (F.size(F.array_except("required", cites)) == 0),
        "no_false_abstention": ~((c("expected_decision") == "ANSWER") & F.coalesce(c("decision") == "ABSTAIN", F.lit(False))),
        "no_unsafe_answer": ~((c("expected_decision") == "ABSTAIN") & F.coalesce(c("decision") == "ANSWER", F.lit(False))),
        "no_missed_clarification": ~((c("expected_decision") == "CLARIFY") & F.coalesce(c("decision") != "CLARIFY", F.lit(True))),
    }
    passed = None
    for x in checks.values():
        passed = x if passed is None else passed & x
    return cases.select("case_id", *(x.alias(k) for k, x in checks.items()), passed.alias("automatic_pass"))


def target_fidelity(cases: DataFrame) -> DataFrame:
    """Whether any cited key is expected or acceptable; null where an abstention is expected."""
    return cases.select("case_id", F.when(F.col("expected_decision") != "ABSTAIN", F.arrays_overlap("cited", F.array_union("expected", "acceptable"))).alias("target_hit"))


def semantic_report(claims: DataFrame, evidence: DataFrame, judgements: DataFrame) -> DataFrame:
    """Status of each claim (question_id, claim_code, status, reason), where one fault in an answer's judgements voids them all.

    ``claims``: question_id, claim_code, claim, codes; ``evidence``: question_id, code, text; ``judgements``: question_id,
    claim_code, codes, has_supported, all_supported, contradicted. Faults, the first in this order is the answer's reason:
    UNKNOWN_CLAIM (judged, not made), FOREIGN_CODE (judged by a code that the claim does not cite, or citing one that is no
    evidence), BAD_DECISION (a boolean is null, or all is supported and nothing is), OMITTED_CLAIM; status is then null.
    A supported claim needs a token in common with the judged evidence's texts, else it is UNSUPPORTED. A null list
    of codes is empty; claim codes are unique in an answer; a claim judged twice gives two rows.
    """
    keys = ["question_id", "claim_code"]
    nothing = F.array().cast("array<string>")
    known = evidence.groupBy("question_id").agg(F.collect_set("code").alias("available"))
    c = claims.select(*keys, "claim", F.coalesce("codes", nothing).alias("cited"), F.lit(1).alias("made"))
    j = judgements.select(*keys, F.coalesce("codes", nothing).alias("judged"), "has_supported", "all_supported", "contradicted", F.lit(1).alias("given"))
    x = c.join(j, keys, "full").join(known, "question_id", "left").withColumn("available", F.coalesce("available", nothing))
    foreign = (F.size(F.array_except("judged", "cited")) > 0) | (F.size(F.array_except("cited", "available")) > 0)
    sound = F.col("has_supported").isNotNull() & F.col("all_supported").isNotNull() & F.col("contradicted").isNotNull() & ~(F.col("all_supported") & ~F.col("has_supported"))
    fault = F.when(F.col("made").isNull(), F.struct(F.lit(1).alias("no"), F.lit("UNKNOWN_CLAIM").alias("reason"))).when(F.col("given").isNull(), F.struct(F.lit(4).alias("no"), F.lit("OMITTED_CLAIM").alias("reason"))).when(foreign, F.struct(F.lit(2).alias("no"), F.lit("FOREIGN_CODE").alias("reason"))).when(~sound, F.struct(F.lit(3).alias("no"), F.lit("BAD_DECISION").alias("reason")))
    x = x.withColumn("reason", F.min(fault).over(Window.partitionBy("question_id"))["reason"])
    said = x.filter("reason is null").select(*keys, "judged", F.explode(fold_tokens(F.col("claim"))).alias("token")).distinct().select(*keys, "token", F.explode("judged").alias("code"))
    shown = evidence.select("question_id", "code", F.explode(fold_tokens(F.col("text"))).alias("token")).distinct()
    anchored = said.join(shown, ["question_id", "code", "token"], "left_semi").select(*keys).distinct().withColumn("anchored", F.lit(True))
    x = x.join(anchored, keys, "left")
    status = (
        F.when(F.col("reason").isNotNull(), None).when(F.col("contradicted") | ~F.col("has_supported"), "UNSUPPORTED")
        .when(~F.col("all_supported"), "PARTIALLY_SUPPORTED").when(F.col("anchored"), "SUPPORTED").otherwise("UNSUPPORTED")
    )
    return x.select(*keys, status.alias("status"), "reason")
