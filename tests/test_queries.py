"""Every registered query against its SQL, and rules that no query of a table can show."""

from __future__ import annotations

import datetime as dt
import random
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import completeness, identity, mapping, matching, profiling, publication, quality, reports
from tallyforge.plans import catalogue
from tallyforge.plans.views import movements

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set threads = 2")
    for t in [*TABLES, "documents", "embeddings", "conversations"]:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)[:19].removesuffix(" 00:00:00")
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = df.select(sorted(df.columns)).collect()
    ref = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in ref.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(r[i]) for i in order) for r in ref.fetchall()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(want)


def events(duck):
    return duck.execute("select event_id, user_id, event_type from events order by user_id, event_id").fetchall()


def test_overlay_chains_by_hand(spark, duck):
    """The fold of each user's overlays, one after the other."""
    want: dict = {}
    for n, user, kind in events(duck):
        value, conflicts = want.get(user, ("a", 0))
        if value == "a":
            want[user] = ("[redacted]" if kind == "error" else "b" if n % 4 == 0 else "a", conflicts)
        else:
            want[user] = (value, conflicts + 1)
    got = {r.entity: (r.value, r.conflicts) for r in catalogue.QUERIES["cor03_overlay_chains"](spark, DIR).collect()}
    assert got == want and len({v for v, _ in want.values()}) > 1


def test_inbox_fold_by_hand(spark, duck):
    steps = {("received", "claim"): "processing", ("processing", "succeed"): "succeeded", ("processing", "retryable_failure"): "retryable_failed", ("retryable_failed", "claim"): "processing"}
    want: dict = {}
    for n, user, kind in events(duck):
        state, token, stale = want.get(user, ("received", 0, 0))
        event, fence = {"purchase": "succeed", "error": "retryable_failure"}.get(kind, "claim"), 0 if n % 10 == 0 else n
        want[user] = (state, token, stale + 1) if fence < token else (steps.get((state, event), state), max(fence, token), stale)
    got = {r.user_id: (r.state, r.stale) for r in catalogue.QUERIES["str05_inbox_fold"](spark, DIR).collect()}
    assert got == {u: (s, x) for u, (s, _, x) in want.items()}


def test_document_secrets_by_hand(spark, duck):
    """Lines of all documents: cards by their check digit, access keys and assignments by plain search."""
    got = {(r.doc_id, r.line, r.kind) for r in catalogue.QUERIES["txt02_document_secrets"](spark, DIR).collect()}
    keys = set()
    for i, text in duck.execute("select doc_id, text from documents where text is not null").fetchall():
        for n, line in enumerate(re.split(r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", text), 1):
            if re.search(r"(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Z0-9])", line):
                keys.add((i, n, "aws_access_key"))
    assert {g for g in got if g[2] == "aws_access_key"} == keys
    assert {*catalogue.QUERIES} - {*catalogue.SQL} == {"txt02_document_secrets"}


def test_candidates_are_the_same_from_either_side_and_with_buckets(spark):
    m = movements(spark, DIR, True)
    a, b = m.where("dataset_version_id = 'A'"), m.where("dataset_version_id = 'B'")
    pairs = lambda df, x="left_id", y="right_id": sorted((r[0], r[1]) for r in df.select(x, y).collect())
    one = pairs(matching.candidates(a, b, 3))
    assert one == pairs(matching.candidates(b, a, 3), "right_id", "left_id") == pairs(matching.candidates(a, b, 3, buckets=True)) and one
    with pytest.raises(ValueError, match="31"):
        matching.candidates(a, b, 32)


def test_bucketed_candidates_look_at_few_others(spark):
    """What the join itself finds by its keys is hardly more than what is near in days and opposite; and other directions are opposite to all but themselves."""
    rows = [(str(i), "c", "A" if i % 2 else "B", str(i % 3), "1", "COP", ("inflow", "outflow", "hold")[i % 5 % 3], dt.date(2026, 1, 1 + i // 4), "r", "f", "confirmed", "complete") for i in range(100)]
    kinds = [f"{c} {'date' if c == 'occurred_on' else 'string'}" for c in [*matching.SIDE, "state", "lineage_state"]]
    m = spark.createDataFrame(rows, ", ".join(kinds)).withColumn("amount", F.col("amount").cast("decimal(38,12)"))
    a, b = m.where("dataset_version_id = 'A'"), m.where("dataset_version_id = 'B'")
    for days in (0, 2, 9):
        want = sorted((x[0], y[0]) for x in rows for y in rows if x[2] == "A" and y[2] == "B" and x[3] != y[3] and x[6] != y[6] and abs((x[7] - y[7]).days) <= days)
        got = matching.candidates(a, b, days, buckets=True)
        assert sorted((r.left_id, r.right_id) for r in got.collect()) == want and want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "(l_faces" in plan and days in (0, 9) or "(l_bucket" in plan
    assert {r.amount for r in matching.candidates(a, b, 2, buckets=True, as_text=True).collect()} == {"1.000000000000"}


def alike(spark, n=240):
    """Movements of which many are compared alike: few accounts, days and references, some of these and one id missing."""
    rows = [(None if i == 77 else str(i), "c", "A" if i % 2 else "B", str(i % 3), str(i // 2 % 2), "COP", ("inflow", "outflow")[i // 4 % 2], dt.date(2026, 1, 1 + i % 5), (None, "r", "s")[i // 8 % 3], "f", "confirmed", "complete") for i in range(n)]
    kinds = [f"{c} {'date' if c == 'occurred_on' else 'string'}" for c in [*matching.SIDE, "state", "lineage_state"]]
    m = spark.createDataFrame(rows, ", ".join(kinds)).withColumn("amount", F.col("amount").cast("decimal(38,12)"))
    want = lambda days: sorted((str(x[0]), str(y[0])) for x in rows for y in rows if x[2] == "A" and y[2] == "B" and x[3] != y[3] and x[4] == y[4] and x[6] != y[6] and abs((x[7] - y[7]).days) <= days)
    return m.where("dataset_version_id = 'A'"), m.where("dataset_version_id = 'B'"), want


def test_movements_that_are_compared_alike_are_compared_once(spark):
    a, b, want = alike(spark)
    for days, buckets in ((0, False), (2, True)):
        got = matching.candidates(a, b, days, buckets=buckets, blocks=True)
        assert sorted((str(r.left_id), str(r.right_id)) for r in got.collect()) == want(days) and want(days)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert -1 < plan.find("Generate explode(r_own") < plan.find("Join Inner")
    for blocks in (False, True):
        more = matching.candidates(a.withColumn("n", F.lit(1)), b.withColumn("x", F.col("movement_id").cast("long") * 2), 0, blocks=blocks, left_more=("n",), right_more=("x",)).collect()
        assert sorted((str(r.left_id), str(r.right_id)) for r in more) == want(0) and all(r.left_n == 1 and (r.right_x or 0) == 2 * int(r.right_id or 0) for r in more)


def test_split_candidates_compare_once_for_heavy_keys_only(spark):
    a, b, want = alike(spark)
    # amount 0 is heavy, amount 1 is not
    thin = b.where("amount = 0 OR occurred_on = '2026-01-01'")
    got = matching.split_candidates(a, thin, 2, heavy=40)
    ids = {str(r.movement_id) for r in thin.collect()}
    assert sorted((str(r.left_id), str(r.right_id)) for r in got.collect()) == [p for p in want(2) if p[1] in ids]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.amount for r in matching.heavy_keys(thin, 40).collect()} == {0} and plan.count("Generate explode(r_own") == plan.count("collect_list") == 1


def test_blocks_are_of_bounded_length_and_lose_no_row(spark):
    rows = [("x", str(i)) for i in range(7)] + [("x", None), ("x", "3"), (None, "1"), (None, None)]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [(r.k, v) for r in matching.in_blocks(df, ["k"], ["v"], "vs", 4).collect() if len(r.vs) <= 4 for v in r.vs]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert matching.in_blocks(df, ["k"], ["v"], "vs", 4).count() == 4 and matching.in_blocks(df, ["k"], ["v"], "vs").count() == 2


def test_decisions_by_hand_and_by_one_shuffle_of_pairs(spark):
    rng = random.Random(5)
    ids = sorted({tuple(sorted((f"{rng.randrange(30):02}", f"{rng.randrange(30):02}"))) for _ in range(120)})
    named = matching.named_pairs(spark.createDataFrame([(b, a) for a, b in ids] + ids[:9], "left_id string, right_id string"))
    asked = named.select("*", F.lit("confirmed").alias("decision"), F.lit("same_fee").alias("reason"), F.lit("a").alias("proposed_by"), F.lit("b").alias("decided_by"), F.struct("low_id", "high_id").alias("seq"))
    out = matching.decide(asked)
    seen, want = set(), {}
    for a, b in ids:
        want[f"{a}|{b}"] = "confirmed" if a != b and not {a, b} & seen else "member_already_matched"
        seen |= {a, b}
    assert {r.candidate_id: r.outcome for r in out.collect()} == want
    # the exchanges: by name once for each branch, by member, and of the few that win
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(low_id" not in plan and "windowspecdefinition(member" not in plan


def test_decided_candidates_shuffle_no_pair_and_count_repeated_ids_once(spark):
    """As ``decide`` on all pairs has it; with ids that stand in several rows, on either side, or on both."""
    a, b, want = alike(spark)
    said = {"decision": F.when(F.col("low_id").cast("long") % 5 == 0, "rejected").otherwise("confirmed"), "proposed_by": F.lit("a"), "decided_by": F.when(F.col("high_id").cast("long") % 7 == 0, "a").otherwise("b")}
    said["reason"] = F.when(F.col("low_id").cast("long") % 4 == 0, "no_reason").when(F.col("low_id").cast("long") % 5 == 0, "insufficient_evidence").otherwise("same_fee")
    judge = lambda p: p.withColumns(said)
    rows = lambda df: sorted((r.candidate_id, r.decision, r.outcome) for r in df.select("candidate_id", "decision", "outcome").collect())
    a, b = a.where("movement_id IS NOT NULL"), b.where("movement_id IS NOT NULL")
    twice = lambda m, n, other: m.unionByName(m.where(f"movement_id % {n} = 0").withColumn("dataset_version_id", F.lit(other)))
    outcomes = set()
    for left, right, days in ((a, b, 1), (twice(a, 3, "A"), twice(b, 4, "B"), 0), (a.unionByName(b.where("movement_id < 40")), b, 1)):
        out = matching.decided_candidates(left, right, judge, days)
        plain = judge(matching.named_pairs(matching.candidates(left, right, days))).withColumn("seq", F.struct("low_id", "high_id"))
        assert rows(out) == rows(matching.decide(plain)) and rows(out)
        outcomes |= {r[2] for r in rows(out)}
        if left is a and right is b:
            # what comes out of the join goes through no exchange
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "hashpartitioning(candidate_id" not in plan and -1 < plan.find("Generate inline(r_own") < plan.find("Join") < plan.find("Exchange" if "Exchange" in plan else "Scan") and "Aggregate" not in plan[: plan.find("Join")]
    assert outcomes == {"reason_mismatch", "same_person", "rejected", "confirmed", "member_already_matched"}


def test_of_lines_with_one_number_the_first_is_the_assessment(spark, tmp_path):
    """As the SQL has it when one thread reads the table in order."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in TABLES:
        con.execute(f"copy (select * from '{DIR}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    # each line a second time with the other answer, in a second file, which is larger, so that Spark reads it first
    line = f"select * replace (2 as l_linenumber) from (select distinct on (l_orderkey) * from '{DIR}/lineitem.parquet')"
    turned = f"select * replace (case l_returnflag when 'R' then 'A' else 'R' end as l_returnflag) from ({line})"
    (tmp_path / "lineitem.parquet").unlink()
    (tmp_path / "lineitem.parquet").mkdir()
    con.execute(f"copy ({line}) to '{tmp_path}/lineitem.parquet/a.parquet'")
    con.execute(f"copy ({turned} union all select * replace (6 as l_linenumber) from '{DIR}/lineitem.parquet') to '{tmp_path}/lineitem.parquet/b.parquet'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'lineitem' else ''}'")
    want = sorted(tuple(map(str, r)) for r in con.execute(f"select company_id, period_start, open from ({catalogue.SQL['clo02_close_controls']}) where control = 'completeness_assessments'").fetchall())
    got = catalogue.QUERIES["clo02_close_controls"](spark, str(tmp_path)).where("control = 'completeness_assessments'").select("company_id", "period_start", "open").collect()
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_statement_golden(spark):
    """1,250,000 + 20,000 - 90,000 is what the books have; what is only proposed counts for nothing."""
    money = "decimal(38,12)"
    s = spark.createDataFrame([("s", "c", "COP", "1250000", "1180000")], "statement_id string, company_id string, currency_code string, b string, k string")
    s = s.select("statement_id", "company_id", "currency_code", F.col("b").cast(money).alias("bank_closing_balance"), F.col("k").cast(money).alias("books_closing_balance"))
    items = [("1", "add_to_bank", 20000, "confirmed", "luis"), ("2", "deduct_from_bank", 90000, "confirmed", "luis"), ("3", "add_to_bank", 500000, "proposed", None)]
    i = spark.createDataFrame([("s", "s", "c", "COP", *x, "ana") for x in items], "of_statement string, statement_id string, company_id string, currency_code string, item_id string, adjustment_side string, a long, state string, approved_by string, prepared_by string").withColumn("amount", F.col("a").cast(money))
    r = completeness.statements(s, i).first()
    assert (r.state, r.adjusted_bank, r.unexplained, r.counted) == ("balanced", Decimal(1180000), 0, 2)
    bad = i.withColumn("approved_by", F.when(F.col("item_id") == "1", "ana").otherwise(F.col("approved_by")))
    assert completeness.statements(s, bad).first().state == "review_required"


def test_reports_windows_and_caps(spark):
    assert reports.window(30, dt.date(2026, 1, 30)) == (dt.date(2026, 1, 1), dt.date(2026, 1, 31))
    with pytest.raises(ValueError, match="30"):
        reports.window(31, dt.date(2026, 1, 30))
    m = movements(spark, DIR, True)
    capped = quality.risk_signals(m, 3).groupBy("rule_code").count().collect()
    assert all(r["count"] <= 3 for r in capped)


def test_mapping_findings():
    good = mapping.ColumnMapping({"occurred_on": 0, "description": 1, "amount": 2}, "dmy", "comma", "COP", "signed_amount")
    assert mapping.mapping_findings(good) == []
    profile = [{"index": 0, "inferred_type": "ambiguous_date"}, {"index": 1, "inferred_type": "text"}, {"index": 2, "inferred_type": "decimal_comma"}, {"index": 3, "inferred_type": "text"}]
    assert mapping.mapping_findings(good, profile) == [("undecided_column", "0"), ("column_unaccounted", "3")]
    assert mapping.mapping_findings(good, profile[:3], {0: "dmy"}) == []
    bad = mapping.ColumnMapping({"occurred_on": 0, "amount": 0, "odd": 1}, "ymd", "comma", "GBP", "guess", 0, 0, -1)
    assert {c for c, _ in mapping.mapping_findings(bad)} == {"unknown_field", "missing_field", "direction_mode", "date_format", "currency", "column_used_twice", "header_row", "first_data_row", "last_data_row"}


def test_profiles_of_odd_tables(spark):
    rows = spark.createDataFrame([(["1.234", "", "x"],), (["12", " "],), (["1,5", None],), ([],)], "raw_values array<string>")
    got = {r["index"]: (r.inferred_type, r.non_empty, r.empty) for r in profiling.columns(rows).collect()}
    assert got == {0: ("decimal_comma", 3, 0), 1: ("empty", 0, 3), 2: ("text", 1, 0)}
    t = profiling.table_profile(rows).first()
    assert (t.row_count, t.column_count, t.ragged_rows, t.truncated) == (4, 3, 3, False)


def test_digest_of_a_dataset_knows_order_only_by_ordinal(spark):
    df = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 10, "c")], "k string, n long, r string")
    a = publication.ordered_digest(df, ["k"], "n", "r").first()
    assert a.digest == publication.ordered_digest(df.orderBy("r"), ["k"], "n", "r").first().digest and a.records == 3


def test_scope_fails_closed_and_inbox_folds(spark):
    m = movements(spark, DIR)
    assert identity.scoped(m, None).count() == 0 and identity.scoped(m, "other").count() == 0
    e = spark.createDataFrame([("d", 1, "claim", 5), ("d", 2, "succeed", 4), ("d", 3, "succeed", 5), ("d", 4, "claim", 6)], "k string, seq long, event string, token long")
    r = identity.folded(e, "k").first()
    assert (r.state, r.stale) == ("succeeded", 1)
