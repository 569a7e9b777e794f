"""Completeness of datasets from their controls, and the balance equation of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY

#: The controls that an expectation may name.
CONTROLS = ("record_count", "debit_total", "credit_total", "opening_balance", "closing_balance", "running_balance_continuity", "page_sequence", "statement_sequence", "period_coverage", "account_identity", "currency_consistency", "provenance_integrity")


def state_by_specification(results: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each assessment by the written rule: mismatch before unknown before verified.

    ``results``: keys, control_type, outcome, required. ``expected``: keys, control_type, declared (a versioned expectation says with a
    reason that the control does not apply). A control that is expected and has no result is unknown, unless declared.
    """
    both = results.withColumn("seen", F.lit(True)).join(expected.withColumn("wanted", F.lit(True)), [*keys, "control_type"], "full_outer")
    declared = F.coalesce("declared", F.lit(False))
    mismatch = F.coalesce(F.col("required") & (F.col("outcome") == "mismatch"), F.lit(False))
    unknown = F.coalesce(
        F.when(F.col("seen").isNull(), ~declared)
        .when(~F.col("outcome").isin("verified", "mismatch", "unknown", "not_applicable"), True)
        .when(F.col("outcome") == "not_applicable", F.col("required") & ~declared)
        .otherwise(F.col("required") & (F.col("outcome") == "unknown")),
        F.lit(False),
    )
    out = both.groupBy(*keys).agg(F.bool_or(mismatch).alias("m"), F.bool_or(unknown).alias("u"))
    return out.select(*keys, F.when(F.col("m"), "mismatch").when(F.col("u"), "unknown").otherwise("verified").alias("state"))


def state_by_product(results: DataFrame, keys: list[str]) -> DataFrame:
    """The state as stored assessments have it: no required control at all is unknown, and so is one that does not apply."""
    required = results.groupBy(*keys).agg(
        F.count_if("required").alias("n"), F.count_if(F.col("required") & (F.col("outcome") == "mismatch")).alias("m"), F.count_if(F.col("required") & (F.col("outcome") != "verified")).alias("u")
    )
    return required.select(*keys, F.when(F.col("m") > 0, "mismatch").when((F.col("n") == 0) | (F.col("u") > 0), "unknown").otherwise("verified").alias("state"))


def control_rows(metrics: DataFrame, key: str) -> DataFrame:
    """The five controls of a dataset, a row each, from its metrics in one row."""
    control = lambda name, ok: F.struct(F.lit(name).alias("control_type"), F.when(ok.isNull(), "unknown").when(ok, "verified").otherwise("mismatch").alias("outcome"), F.lit(True).alias("required"))
    rows = F.array(
        control("provenance_integrity", F.col("artifact_digest") == F.col("declared_digest")),
        control("record_count", F.col("movements") + F.col("rejected") == F.col("records")),
        control("account_identity", F.col("accounts") == 1),
        control("currency_consistency", F.col("currencies") == 1),
        control("period_coverage", (F.col("first_day") >= F.col("period_start")) & (F.col("last_day") <= F.col("period_end"))),
    )
    return metrics.select(key, F.inline(rows))


#: What an accepted exception must say, and the states it may stand over.
EXCEPTION_FIELDS = ("scope", "reason", "owner_subject_id", "approved_by", "approved_at", "materiality_policy_id", "valid_from", "expires_at", "allowed_actions", "evidence_refs", "audit_event_id")
EXCEPTION_STATES = ("mismatch", "unknown")


def said(c: str) -> Column:
    """Whether a field says anything: neither null nor an empty text."""
    return F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False))


def exception_findings(as_of: Column) -> Column:
    """What is wrong with an accepted exception, as an array of codes. ``allowed_actions`` and ``evidence_refs`` are texts of comma-joined names."""
    needed = [F.when(~said(c), f"missing_{c}") for c in EXCEPTION_FIELDS]
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("base_state").isin(*EXCEPTION_STATES), F.lit(False)), "base_state"),
        *needed,
        F.when(F.col("owner_subject_id") == F.col("approved_by"), "approver_not_independent"),
        F.when(said("expires_at") & F.expr("try_cast(expires_at AS date)").isNull(), "expiry_no_date").when(F.expr("try_cast(expires_at AS date)") <= as_of, "expired"),
        F.when(F.array_contains(F.split(F.coalesce("allowed_actions", F.lit("")), ","), "auto_match"), "auto_match"),
        F.when(F.coalesce("changes_base_state", F.lit(False)), "changes_base_state"),
        F.when(~F.coalesce("disclosed_in_snapshot", F.lit(False)), "not_disclosed"),
    ))


def with_exception(statements: DataFrame, exceptions: DataFrame, as_of: Column) -> DataFrame:
    """Statements (statement_id, unexplained, findings, state) after their exceptions, one each at most: what balances stays; a difference without an exception, or with
    a faulty one, asks for review; a valid one makes it exception_accepted, never balanced."""
    faults = exceptions.withColumn("base_state", F.lit("mismatch")).select("statement_id", F.size(exception_findings(as_of)).alias("faults"))
    out = statements.join(faults, "statement_id", "left")
    exact = (F.col("unexplained") == 0) & (F.coalesce("findings", F.lit(0)) == 0)
    return out.withColumn("state", F.when(exact, F.col("state")).when(F.col("faults") == 0, "exception_accepted").otherwise("review_required")).drop("faults")


#: The controls that may be declared, and what each state of a dataset may be used for.
CONTROL_TYPES = (
    "record_count", "debit_total", "credit_total", "opening_balance", "closing_balance", "running_balance_continuity", "period_coverage", "page_section_coverage", "sequence_cursor",
    "provenance_integrity", "currency_consistency", "account_identity",
)
USES = ("investigation", "match_suggestion", "auto_match", "close_input", "certified_report_input")
ELIGIBILITY = {
    "verified": ("yes", "yes", "no", "yes", "yes"),
    "mismatch": ("yes", "no", "no", "no", "no"),
    "unknown": ("yes", "no", "no", "no", "no"),
    "accepted_exception": ("yes", "yes", "no", "conditional_valid_exception", "conditional_disclosed_exception"),
}


def uses(state: Column) -> Column:
    """An array of (use, allowed) for a completeness state; an unknown word may be used for nothing."""
    allowed = lambda k: F.coalesce(*[F.when(state == s, F.lit(row[k])) for s, row in ELIGIBILITY.items()], F.lit("no"))
    return F.array(*[F.struct(F.lit(u).alias("use"), allowed(k).alias("allowed")) for k, u in enumerate(USES)])


def undeclared(controls: DataFrame) -> DataFrame:
    """Control results of a type that the vocabulary does not have."""
    return controls.where(~F.col("control_type").isin(*CONTROL_TYPES))


def item_findings(item: str = "i", statement: str = "s") -> Column:
    """What is wrong with a reconciling item of a statement, as an array of codes."""
    i, s = (lambda c: F.col(f"{item}.{c}")), (lambda c: F.col(f"{statement}.{c}"))
    return F.array_compact(F.array(
        F.when(i("company_id") != s("company_id"), "company_scope"),
        F.when(i("statement_id") != s("statement_id"), "statement_scope"),
        F.when(i("currency_code") != s("currency_code"), "currency"),
        F.when(~i("adjustment_side").isin("add_to_bank", "deduct_from_bank"), "adjustment_side"),
        F.when(~i("state").isin("proposed", "confirmed", "rejected", "reversed"), "item_state"),
        F.when(i("amount").isNull(), "money").when(i("amount") <= 0, "amount_not_positive"),
        F.when((i("state") == "confirmed") & i("approved_by").isNull(), "confirmed_without_evidence"),
        F.when((i("state") == "confirmed") & (i("approved_by") == i("prepared_by")), "same_person"),
    ))


def statements(balances: DataFrame, items: DataFrame) -> DataFrame:
    """Each statement's equation: bank + additions - deductions = books, exactly; only confirmed items without findings count, and
    a finding on any item asks for review. ``items`` belong to the statement that ``of_statement`` names."""
    joined = items.alias("i").join(balances.alias("s"), F.col("i.of_statement") == F.col("s.statement_id")).select(F.col("s.statement_id").alias("statement_id"), F.col("i.adjustment_side").alias("side"), F.col("i.amount").alias("amount"), F.col("i.state").alias("item_state"), F.size(item_findings()).alias("findings"))
    counts = (F.col("item_state") == "confirmed") & (F.col("findings") == 0)
    total = lambda side: F.coalesce(F.sum(F.when(counts & (F.col("side") == side), F.col("amount"))), F.lit(0)).cast(MONEY)
    sums = joined.groupBy("statement_id").agg(total("add_to_bank").alias("additions"), total("deduct_from_bank").alias("deductions"), F.sum("findings").alias("findings"), F.count_if(counts).alias("counted"))
    zero = F.lit(0).cast(MONEY)
    out = balances.join(sums, "statement_id", "left").withColumn("additions", F.coalesce("additions", zero)).withColumn("deductions", F.coalesce("deductions", zero))
    adjusted = (F.col("bank_closing_balance") + F.col("additions") - F.col("deductions")).cast(MONEY)
    out = out.withColumn("adjusted_bank", adjusted).withColumn("unexplained", (F.col("adjusted_bank") - F.col("books_closing_balance")).cast(MONEY))
    found, counted = F.coalesce("findings", F.lit(0)), F.coalesce("counted", F.lit(0))
    return out.select("statement_id", "adjusted_bank", "unexplained", "additions", "deductions", counted.alias("counted"), found.alias("findings"), F.when((found == 0) & (F.col("unexplained") == 0), "balanced").otherwise("review_required").alias("state"))


#: Steps of an item's decisions.
ITEM_STEPS = {None: ("proposed",), "proposed": ("confirmed", "rejected"), "confirmed": ("reversed",)}


def item_history(decisions: DataFrame) -> DataFrame:
    """Decision versions of items (item_root, decision_version, state, amount, prepared_by, approved_by) with what is wrong in each."""
    w = Window.partitionBy("item_root").orderBy("decision_version")
    before = F.lag("state").over(w)
    allowed = F.lit(False)
    for a, to in ITEM_STEPS.items():
        allowed = allowed | ((before.isNull() if a is None else before == a) & F.col("state").isin(*to))
    amount = F.lag("amount").over(w)
    version = F.coalesce(F.lag("decision_version").over(w), F.lit(0)) + 1
    why = (
        F.when(F.col("decision_version") != version, "version_gap")
        .when(~F.coalesce(allowed, F.lit(False)), "step_not_allowed")
        .when(amount.isNotNull() & (amount != F.col("amount")), "amount_changed")
        .when((F.col("state") == "confirmed") & (F.col("approved_by") == F.col("prepared_by")), "same_person")
    )
    return decisions.withColumn("problem", why)


def running_continuity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each row's balance is the one before plus what moved (ordinal, amount, balance). Beyond the reference: it only declares the control."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    expected = F.lag("balance").over(w) + F.col("amount")
    return rows.withColumn("continuous", F.coalesce(F.col("balance") == expected, F.lit(True)))


def adjustments(items: DataFrame, key: str) -> DataFrame:
    """What confirmed items add to and deduct from the bank's balance of each statement."""
    side = lambda s: F.sum(F.when((F.col("adjustment_side") == s) & (F.col("state") == "confirmed"), F.col("amount")))
    return items.groupBy(key).agg(side("add_to_bank").alias("additions"), side("deduct_from_bank").alias("deductions"))
