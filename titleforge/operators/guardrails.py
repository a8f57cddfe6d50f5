"""Checks of a model put in order, doubted, and compared with the fact store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import rupee_forms
from ..functions.surveys import normalize_survey, split_surveys

STATUSES = ("PASS", "FAIL", "WARNING", "NOT_APPLICABLE", "INFO")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "INFO")
#: Words that turn a signal around if they stand within 35 characters before it.
NEGATIONS = (
    "no indication of ", "no evidence of ", "no sign of ",
    "no ", "not ", "without ", "absence of ", "free from ",
    "does not ", "doesn't ", "don't ", "do not ",
    "not found", "no mention of ",
)
LOOK_BACK = 35
#: Signals of failure in the explanation and in the evidence of a check that passed.
SIGNALS = (
    "active mortgage", "mortgage found", "shortfall",
    "mismatch found", "broken chain", "poramboke",
    "fraud detected", "discrepancy found", "not valid",
    "encroachment", "litigation pending", "court attachment",
    "no discharge", "no release",
)
EVIDENCE_SIGNALS = (
    "no discharge entry found", "no release",
    "mismatch", "discrepancy", "inconsisten",
    "shortfall", "below guideline", "poramboke",
)
#: Checks that no document can answer; rules that only the last pass may add.
UNKNOWABLE = ("FLOOD_ZONE", "PHD_BELT", "WATER_BODY_PROXIMITY", "INDUSTRIAL_PROXIMITY", "ENVIRONMENTAL_CLEARANCE")
META = ("MISSING_DOCUMENTS", "OVERALL_TITLE_OPINION", "GROUP5_SKIPPED", "GROUP5_ERROR", "GROUP5_UNKNOWN")
#: The facts that each rule is about.
FACTS_OF_RULE: dict[str, tuple[str, ...]] = {
    "ACTIVE_MORTGAGE": ("ec_transaction_type", "ec_consideration"),
    "MULTIPLE_SALES": ("survey_number", "ec_executant", "ec_claimant", "ownership_transfers"),
    "LIS_PENDENS": ("ec_transaction_type",),
    "MULTIPLE_PATTA": ("patta_number", "survey_number"),
    "SURVEY_SUBDIVISION": ("survey_number",),
    "POA_SALE": ("ec_transaction_type",),
    "STAMP_DUTY_SHORTFALL": ("consideration_amount", "guideline_value", "stamp_duty"),
    "LAYOUT_APPROVAL": ("classification",),
    "PORAMBOKE_DETECTION": ("classification",),
    "SURVEY_NUMBER_MISMATCH": ("survey_number",),
    "OWNER_NAME_MISMATCH": ("seller", "buyer", "patta_owner", "ec_executant", "ec_claimant"),
    "SRO_JURISDICTION": ("sro", "district"),
    "EXTENT_MISMATCH": ("extent",),
    "AGE_FRAUD": ("seller",),
    "BROKEN_CHAIN_OF_TITLE": ("ownership_transfers", "seller", "buyer", "ec_executant", "ec_claimant"),
    "RAPID_FLIPPING": ("registration_date",),
    "PRICE_ANOMALY": ("consideration_amount", "guideline_value", "ec_consideration"),
    "DET_SURVEY_SUBDIVISION": ("survey_number",),
    "DET_SURVEY_OCR_FUZZY": ("survey_number",),
    "DET_SURVEY_MISMATCH": ("survey_number",),
    "DET_PLOT_IDENTITY_MISMATCH": ("property_description",),
    "DET_FINANCIAL_SCALE_JUMP": ("consideration_amount", "ec_consideration"),
    "DET_MORTGAGE_EXCEEDS_SALE": ("ec_consideration", "consideration_amount"),
    "DET_ACTIVE_MORTGAGE_BURDEN": ("ec_transaction_type", "consideration_amount"),
    "DET_MULTI_VILLAGE": ("village",),
    "DET_MULTI_TALUK": ("taluk",),
    "DET_MULTI_DISTRICT": ("district",),
    "DET_SRO_JURISDICTION": ("sro", "district", "village"),
    "DET_MULTIPLE_SALES": ("ownership_transfers", "ec_executant", "ec_claimant"),
}
#: Rules that each group of checks has to answer.
EXPECTED: dict[int, tuple[str, ...]] = {
    1: ("ACTIVE_MORTGAGE", "MULTIPLE_SALES", "LIS_PENDENS"),
    2: ("STAMP_DUTY_SHORTFALL", "POA_SALE", "LAYOUT_APPROVAL"),
    3: ("SURVEY_NUMBER_MISMATCH", "OWNER_NAME_MISMATCH", "PORAMBOKE_DETECTION"),
    4: ("RESTRICTED_LAND", "LAND_CEILING_CHECK", "NA_CONVERSION"),
    5: ("BROKEN_CHAIN_OF_TITLE", "RAPID_FLIPPING", "GOVERNMENT_ACQUISITION"),
}
#: Characters of which the keyword test is made; what a prompt may hold at most.
INPUT_AT_MOST, NARRATIVE_AT_MOST = 480_000, 30_000


def said(text: Column, signal: str) -> Column:
    """Whether a signal stands in a text at least once without a negation just before it."""
    before = F.split(text, F.lit(r"\Q" + signal + r"\E"), -1)
    # what stands before the k-th mention: all pieces up to it, with the mentions between them
    heads = F.transform(F.sequence(F.lit(1), F.size(before) - 1), lambda k: F.right(F.array_join(F.slice(before, 1, k), signal), F.lit(LOOK_BACK)))
    negated = lambda h: F.exists(F.array(*map(F.lit, NEGATIONS)), lambda n: F.contains(h, n))
    return F.coalesce((F.size(before) > 1) & F.exists(F.when(F.size(before) > 1, heads).otherwise(F.array().cast("array<string>")), lambda h: ~negated(h)), F.lit(False))


def first_said(text: Column, signals: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(said(text, s), F.lit(s)) for s in signals), F.lit(None).cast("string"))


def value_found(value: Column, key: Column, text: Column) -> Column:
    """match, skip or mismatch: whether a fact's value (in lower case) stands in a check's text.

    Of several survey numbers one is enough, amounts may be written in any usual way, and
    Tamil values are skipped where the text has no Tamil.
    """
    surveys = F.exists(split_surveys(value), lambda p: F.contains(text, F.lower(p)) | ((normalize_survey(p) != "") & F.contains(text, normalize_survey(p))))
    money = F.exists(rupee_forms(value), lambda f: F.contains(text, f))
    tamil = "[஀-௿]"
    return (
        F.when(F.contains(text, value), "match")
        .when(F.contains(key, F.lit("survey")) & surveys, "match")
        .when(key.rlike("consideration|amount|guideline|stamp|duty") & money, "match")
        .when(value.rlike(tamil) & ~text.rlike(tamil), "skip")
        .otherwise("mismatch")
    )


def normalized(checks: DataFrame) -> DataFrame:
    """Known statuses and severities, texts for what is missing; a failure is MEDIUM at least."""
    status = F.when(F.upper("status").isin(*STATUSES), F.upper("status")).otherwise("WARNING")
    severity = F.when(F.upper("severity").isin(*SEVERITIES), F.upper("severity")).otherwise("MEDIUM")
    out = checks.withColumns({"status": status, "severity": severity, "explanation": F.coalesce("explanation", F.lit("No explanation provided")), "evidence": F.coalesce("evidence", F.lit(""))})
    return out.withColumn("severity", F.when((F.col("status") == "FAIL") & (F.col("severity") == "INFO"), "MEDIUM").otherwise(F.col("severity")))


def guarded(checks: DataFrame, files: Column, n_tools: Column) -> DataFrame:
    """Checks with ``unverified``, ``unreliable`` and warnings: no known file cited, a pass that tells of failure."""
    c = normalized(checks)
    low, proof = F.lower("explanation"), F.lower("evidence")
    short = F.length("evidence") < 10
    cited = F.exists(files, lambda f: F.contains(proof, F.lower(f)))
    passed = F.col("status") == "PASS"
    told, shown = first_said(low, SIGNALS), first_said(proof, EVIDENCE_SIGNALS)
    unknowable = F.col("rule_code").isin(*UNKNOWABLE)
    warnings = F.array(
        F.when((F.size(files) > 0) & F.col("status").isin("FAIL", "WARNING") & ~short & ~cited, "evidence cites no known file"),
        F.when(passed & told.isNotNull(), F.concat(F.lit("passed, but the explanation says: "), told)),
        F.when(passed & shown.isNotNull(), F.concat(F.lit("passed, but the evidence says: "), shown)),
        F.when(unknowable, "no document can answer this"),
    )
    return c.withColumns({"unverified": short | (n_tools == 0), "unreliable": unknowable, "guardrail_warnings": F.filter(warnings, lambda w: w.isNotNull())})


def with_ground_truth(checks: DataFrame, facts: DataFrame, scope: list[str], most: int = 3) -> DataFrame:
    """Checks with the facts of their rules: how many match, are skipped or absent; absent ones become warnings."""
    rules = F.create_map(*(x for k, v in FACTS_OF_RULE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    about = checks.select(*scope, "rule_code", "pos", F.lower(F.concat_ws(" ", "explanation", "evidence")).alias("_t"), F.explode(F.try_element_at(rules, F.upper("rule_code"))).alias("key"))
    tidy = F.replace(F.replace(F.lower("key"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    known = facts.withColumn("key", tidy).withColumn("_v", F.lower(F.trim("value"))).where(F.length("_v") >= 2).select(*scope, "key", "_v", F.col("value").alias("_value"), "source_file", *(["doc_ord"] if "doc_ord" in facts.columns else []))
    met = about.join(known, [*scope, "key"]).withColumn("_verdict", value_found(F.col("_v"), F.col("key"), F.col("_t")))
    label = F.concat(F.col("key"), F.lit("="), F.col("_value"), F.lit(" ("), F.col("source_file"), F.lit(")"))
    g = met.groupBy(*scope, "pos").agg(
        F.count_if(F.col("_verdict") == "match").alias("n_match"), F.count_if(F.col("_verdict") == "skip").alias("n_skip"), F.count_if(F.col("_verdict") == "mismatch").alias("n_mismatch"),
        F.array_sort(F.collect_set(F.when(F.col("_verdict") == "mismatch", label))).alias("_absent"),
    )
    out = checks.join(g, [*scope, "pos"], "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("n_match", "n_skip", "n_mismatch")}
    more = F.transform(F.slice(F.coalesce("_absent", F.array().cast("array<string>")), 1, most), lambda x: F.concat(F.lit("not in the answer: "), x))
    return out.withColumns({**zero, "verified": F.col("n_match").isNotNull(), "guardrail_warnings": F.concat(F.coalesce("guardrail_warnings", F.array().cast("array<string>")), more)}).drop("_absent")


def admitted_meta(meta: DataFrame, checks: DataFrame, scope: list[str]) -> DataFrame:
    """Checks of the last pass: its own rules, and rules that nobody answered yet."""
    known = checks.select(*scope, "rule_code").distinct().withColumn("_known", F.lit(True))
    return meta.join(known, [*scope, "rule_code"], "left").where(F.col("rule_code").isin(*META) | F.col("_known").isNull()).drop("_known")


def reflection_input(checks: DataFrame) -> DataFrame:
    """Checks as a reviewer reads them: no failed or skipped groups, texts cut, by kind of source."""
    kept = checks.where(~F.endswith("rule_code", F.lit("_ERROR")) & ~F.endswith("rule_code", F.lit("_SKIPPED")))
    cut = lambda c, n: F.substr(F.coalesce(c, F.lit("")), F.lit(1), F.lit(n)).alias(c)
    keep = [c for c in kept.columns if c not in ("explanation", "evidence", "source")]
    return kept.select(*keep, cut("explanation", 600), cut("evidence", 800), F.when(F.col("source") == "deterministic", "deterministic").otherwise("llm").alias("source"))


def group_gate(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """case_id, available x group_id, needs, anchors, least -> whether a group runs, and why not.

    A group needs a document that it reads, and enough kinds of its anchors. The groups are a
    static table of a few rows, so that the product is bounded by the cases.
    """
    both = cases.join(F.broadcast(groups.limit(100)), F.lit(True))
    present, anchors = F.array_intersect("needs", "available"), F.array_intersect("anchors", F.array_intersect("needs", "available"))
    why = F.when(F.size(present) == 0, F.concat(F.lit("no "), F.array_join("needs", "/"))).when(F.size(anchors) < F.col("least"), F.format_string("%d of %d anchors", F.size(anchors), "least"))
    return both.withColumn("runs", why.isNull()).withColumn("why_not", why)


def check_roster(gated: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, rule_code, severity, prompt, enriched_by, available of runnable checks -> a numbered list as text."""
    extra = F.array_intersect("enriched_by", "available")
    note = F.when(F.size(extra) > 0, F.concat(F.lit("\n   also read: "), F.array_join(extra, ", "))).otherwise("")
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("rule_code"), F.lit(" ("), F.col("severity"), F.lit("): "), F.col("prompt"), note)
    lines = gated.withColumn("n", n).withColumn("line", line)
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("roster"))


def fit(text: Column, most: int = INPUT_AT_MOST) -> Column:
    """A prompt's text within the model's window, and whether it was cut."""
    return F.struct(F.substr(text, F.lit(1), F.lit(most)).alias("text"), (F.length(text) > most).alias("cut"))


def chat_prompt(summary: Column, narrative: Column, question: Column) -> Column:
    """What a chat is asked: the facts, the narrative (cut), the question."""
    told = F.substr(F.coalesce(narrative, F.lit("")), F.lit(1), F.lit(NARRATIVE_AT_MOST))
    return F.concat_ws("\n\n", F.concat(F.lit("Facts:\n"), F.coalesce(summary, F.lit(""))), F.when(told != "", F.concat(F.lit("Report:\n"), told)), F.concat(F.lit("Question: "), question))


def tool_calls(events: DataFrame, by: list[str]) -> DataFrame:
    """How often each pass called tools, and which."""
    return events.where("event_type = 'tool_call'").groupBy(*by).agg(F.count("*").alias("n_calls"), F.array_sort(F.collect_set("tool")).alias("tools"))
