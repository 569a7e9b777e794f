"""Queries over movements: matching, quality, reports, latest rows, pages, sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.digests import canonical_json, digest_of
from ..functions.money import money_text
from ..functions.text import contains_ignoring_case, normalised_reference, spreadsheet_safe
from ..operators import latest as L
from ..operators import ledgers as LE
from ..operators import matching as MA
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import sets as S
from .registry import query
from .views import datasets, movements, table

START, END = dt.date(2024, 1, 1), dt.date(2026, 12, 31)

PAIR_SQL = """SELECT l.movement_id AS left_id, r.movement_id AS right_id, l.amount AS amount, l.currency_code AS currency_code, l.dataset_version_id AS left_dataset, r.dataset_version_id AS right_dataset,
abs(l.occurred_on - r.occurred_on) AS date_distance_days, coalesce(l.reference_normalised = r.reference_normalised, FALSE) AS reference_match
FROM {v} l JOIN {v} r ON l.amount = r.amount AND l.currency_code = r.currency_code AND l.direction <> r.direction AND l.financial_account_id <> r.financial_account_id AND abs(l.occurred_on - r.occurred_on) <= {d}
WHERE l.dataset_version_id = 'A' AND r.dataset_version_id = 'B' AND l.state IN ('proposed', 'confirmed') AND r.state IN ('proposed', 'confirmed') AND l.lineage_state = 'complete' AND r.lineage_state = 'complete'"""


def sides(spark, d, coarse):
    m = movements(spark, d, coarse)
    return m.where("dataset_version_id = 'A'"), m.where("dataset_version_id = 'B'")


@query("jon01_match_candidates", PAIR_SQL.format(v="movement", d=3), money="amount", given="amount")
def match_candidates(spark, d):
    return MA.candidates(*sides(spark, d, False), 3, as_text=True)


@query("jon01_match_candidates_coarse", PAIR_SQL.format(v="movement_coarse", d=0) + " AND l.reference_normalised = r.reference_normalised", money="amount", given="amount")
def match_candidates_coarse(spark, d):
    return MA.candidates(*sides(spark, d, True), 0, "matching", as_text=True)


@query("jon01_match_candidates_bucketed", PAIR_SQL.format(v="movement_coarse", d=2) + " AND NOT coalesce(l.reference_normalised = r.reference_normalised, FALSE)", money="amount", given="amount")
def match_candidates_bucketed(spark, d):
    return MA.candidates(*sides(spark, d, True), 2, "different", buckets=True, as_text=True)


@query("jon01_match_candidates_heavy_keys", PAIR_SQL.format(v="movement_coarse", d=2) + " AND NOT coalesce(l.reference_normalised = r.reference_normalised, FALSE)", money="amount", given="amount")
def match_candidates_heavy_keys(spark, d):
    """The same pairs, where amounts that over 20 movements share go by day buckets."""
    return MA.split_candidates(*sides(spark, d, True), 2, "different", heavy=20, as_text=True)


@query("jon02_pairs_in_order", f"SELECT DISTINCT least(left_id, right_id) AS low_id, greatest(left_id, right_id) AS high_id FROM ({PAIR_SQL.format(v='movement', d=3)})")
def pairs_in_order(spark, d):
    return MA.ordered_pairs(match_candidates(spark, d))


REVERSAL = """WITH paired AS (SELECT l.movement_id AS a, r.movement_id AS b FROM movement_coarse l JOIN movement_coarse r ON r.financial_account_id = l.financial_account_id AND r.currency_code = l.currency_code AND r.amount = l.amount
AND r.direction <> l.direction AND r.reference_normalised = l.reference_normalised AND r.occurred_on BETWEEN l.occurred_on AND l.occurred_on + 3 AND r.movement_id <> l.movement_id) SELECT a AS movement_id FROM paired UNION SELECT b AS movement_id FROM paired"""


@query("jon03_rapid_reversal", REVERSAL)
def rapid_reversal(spark, d):
    return Q.rapid_reversal(movements(spark, d, True))


@query("jon05_decision_ledger", "SELECT o.o_orderkey AS candidate_id, l.l_linenumber AS decision, l.l_shipdate AS decided_at, CASE WHEN l.l_linenumber IS NULL THEN 'pending' ELSE 'decided' END AS state FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1")
def decision_ledger(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("decision"), F.col("l_shipdate").alias("decided_at"))
    return MA.with_decisions(o, first)


@query("jon06_customers_with_orders", "SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def with_orders(spark, d):
    return S.present(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_nationkey")


@query("jon07_orders_without_lines", "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def without_lines(spark, d):
    return S.absent(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("jon08_two_way_difference", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'object_only' ELSE 'row_only' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey * 2 AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def two_way_difference(spark, d):
    return S.two_way_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("k")), "k")


@query("jon09_latest_line_per_order", "SELECT o_orderkey, l_shipdate, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey")
def latest_line(spark, d):
    last = L.latest(table(spark, d, "lineitem"), ["l_orderkey"], F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey"))
    return table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_shipdate", "l_linenumber", "l_partkey")


PRIORITY = "CASE state WHEN 'published' THEN 0 WHEN 'validated' THEN 1 ELSE 2 END"


@query("jon10_preferred_dataset", f"SELECT data_source_id, dataset_version_id, state FROM (SELECT *, row_number() OVER (PARTITION BY data_source_id ORDER BY {PRIORITY}, prepared_on DESC, CAST(dataset_version_id AS BIGINT) DESC) AS rn FROM dataset) WHERE rn = 1")
def preferred_dataset(spark, d):
    rank = F.when(F.col("state") == "published", 0).when(F.col("state") == "validated", 1).otherwise(2)
    best = F.max_by(F.struct("dataset_version_id", "state"), F.struct(-rank, "prepared_on", F.col("dataset_version_id").cast("long"))).alias("best")
    return datasets(spark, d).groupBy("data_source_id").agg(best).select("data_source_id", "best.*")


@query("jon11_array_positions", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_positions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query("jon13_latest_version_members", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)")
def latest_version_members(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return o.join(last, ["o_custkey", "o_orderdate"], "left_semi").select("o_custkey", "o_orderkey")


CLOSED = "SELECT DISTINCT o_custkey % 25 AS company, date_trunc('month', o_orderdate)::DATE AS s, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS e FROM orders WHERE o_orderkey % 40 = 0"


@query("jon14_closed_period_overlaps", f"SELECT a.o_orderkey AS o_orderkey, p.s AS period_start FROM orders a JOIN ({CLOSED}) p ON a.o_custkey % 25 = p.company AND CAST(a.o_orderdate AS DATE) <= p.e AND p.s <= CAST(a.o_orderdate AS DATE) + 10", dates="period_start")
def closed_overlaps(spark, d):
    from ..operators.closing import overlapping

    o = table(spark, d, "orders").withColumn("company", F.col("o_custkey") % 25)
    closed = o.where("o_orderkey % 40 = 0").select("company", F.trunc("o_orderdate", "month").alias("period_start"), F.last_day("o_orderdate").alias("period_end")).distinct()
    spans = o.select("o_orderkey", "company", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 10).alias("end"))
    return overlapping(spans, closed, ["company"]).select("o_orderkey", "period_start")


@query("jon15_bank_and_books_pairing", "SELECT a.c_nationkey AS account, a.bal AS bank, b.bal AS books FROM (SELECT c_nationkey, sum(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12))) AS bal FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a JOIN (SELECT c_nationkey, sum(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12))) AS bal FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) b USING (c_nationkey)", money="bank books")
def bank_and_books(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "bank").otherwise("books").alias("side"), F.col("c_acctbal").cast("decimal(38,12)").alias("bal"))
    return LE.paired_balances(c, "c_nationkey", "side", "bal")


@query("jon16_divergence", "SELECT a.o_orderkey AS o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.o_orderstatus IS DISTINCT FROM CASE WHEN b.o_orderkey % 3 = 0 THEN NULL ELSE b.o_orderstatus END")
def divergence(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    other = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return LE.diverging(o, other, "o_orderkey", "o_orderstatus")


@query("jon17_path_join", "SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, r.r_name AS region, s.s_name AS supplier, p.p_brand AS brand FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey")
def path_join(spark, d):
    t = lambda n: table(spark, d, n)
    out = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = out.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return out.select("l_orderkey", "l_linenumber", F.col("r_name").alias("region"), F.col("s_name").alias("supplier"), F.col("p_brand").alias("brand"))


@query("jon19_account_links_valid_on", "SELECT o.o_orderkey AS o_orderkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 0 AND CAST(o.o_orderdate AS DATE) BETWEEN DATE '1993-01-01' + CAST(c.c_custkey % 365 AS INTEGER) AND DATE '1997-01-01' + CAST(c.c_custkey % 365 AS INTEGER)")
def links_valid_on(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    shift = (F.col("c_custkey") % 365).cast("int")
    links = c.select(F.col("c_custkey").alias("o_custkey"), F.date_add(F.lit("1993-01-01"), shift).alias("valid_from"), F.date_add(F.lit("1997-01-01"), shift).alias("valid_to"))
    return LE.valid_on(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), links, "o_custkey", "o_orderdate").select("o_orderkey")


@query("jon20_cross_company_findings", "WITH m AS (SELECT movement_id, amount, occurred_on, dedupe_fingerprint AS f, CAST(financial_account_id AS BIGINT) % 2 AS c FROM movement) SELECT movement_id FROM m l WHERE EXISTS (SELECT 1 FROM m r WHERE l.f <> r.f AND l.amount = r.amount AND l.occurred_on = r.occurred_on AND l.c <> r.c)")
def cross_company(spark, d):
    return MA.cross_company(movements(spark, d).withColumn("company_id", F.col("financial_account_id").cast("long") % 2))


@query("rec01_propose_reviews", f"SELECT DISTINCT least(left_id, right_id) AS low_id, greatest(left_id, right_id) AS high_id FROM ({PAIR_SQL.format(v='movement', d=3)}) WHERE CAST(least(left_id, right_id) AS BIGINT) % 5 <> 0")
def propose_reviews(spark, d):
    pairs = MA.ordered_pairs(match_candidates(spark, d))
    return MA.propose(match_candidates(spark, d), pairs.where(F.col("low_id").cast("long") % 5 == 0))


DECISIONS = f"""SELECT low_id || '|' || high_id AS candidate_id, low_id, high_id, CASE WHEN CAST(low_id AS BIGINT) % 3 = 0 THEN 'rejected' ELSE 'confirmed' END AS decision,
CASE WHEN CAST(low_id AS BIGINT) % 7 = 0 THEN 'because' WHEN CAST(low_id AS BIGINT) % 3 = 0 THEN 'insufficient_evidence' ELSE 'same_transfer' END AS reason, 'ana' AS proposed_by, CASE WHEN CAST(high_id AS BIGINT) % 11 = 0 THEN 'ana' ELSE 'luis' END AS decided_by,
row_number() OVER (ORDER BY low_id, high_id) AS seq FROM (SELECT DISTINCT least(left_id, right_id) AS low_id, greatest(left_id, right_id) AS high_id FROM ({PAIR_SQL.format(v="movement_coarse", d=0)} AND l.reference_normalised = r.reference_normalised))"""


@query("rec02_decide_reviews", f"""WITH dec AS ({DECISIONS}), pre AS (SELECT *, CASE WHEN reason = 'because' THEN 'reason_mismatch' WHEN proposed_by = decided_by THEN 'same_person' END AS o FROM dec),
mem AS (SELECT candidate_id, seq, unnest([low_id, high_id]) AS member FROM pre WHERE o IS NULL AND decision = 'confirmed'), pl AS (SELECT candidate_id, max(p) AS place FROM (SELECT candidate_id, row_number() OVER (PARTITION BY member ORDER BY seq, candidate_id) AS p FROM mem) GROUP BY 1)
SELECT candidate_id, decision, coalesce(o, CASE WHEN decision = 'confirmed' AND place > 1 THEN 'member_already_matched' ELSE decision END) AS outcome FROM pre LEFT JOIN pl USING (candidate_id)""")
def decide_reviews(spark, d):
    low, high = F.col("low_id").cast("long"), F.col("high_id").cast("long")
    reject = low % 3 == 0
    said = {
        "decision": F.when(reject, "rejected").otherwise("confirmed"), "reason": F.when(low % 7 == 0, "because").when(reject, "insufficient_evidence").otherwise("same_transfer"),
        "proposed_by": F.lit("ana"), "decided_by": F.when(high % 11 == 0, "ana").otherwise("luis"),
    }
    return MA.decided_candidates(*sides(spark, d, True), lambda p: p.withColumns(said), 0, "matching").select("candidate_id", "decision", "outcome")


GROUPS = "SELECT CAST(o_custkey AS VARCHAR) AS group_id, CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS VARCHAR) AS anchor_id, CAST(o_orderkey AS VARCHAR) AS id FROM orders"


@query("rec03_group_proposals", f"""WITH x AS ({GROUPS}) SELECT x.group_id AS group_id, x.anchor_id AS anchor_id, count(DISTINCT id) AS members, sum(m.amount) AS related_total, max(a.amount) - sum(m.amount) AS difference,
bool_and(m.company_id = a.company_id AND m.currency_code = a.currency_code AND m.direction <> a.direction AND m.financial_account_id <> a.financial_account_id) AND count(DISTINCT id) BETWEEN 2 AND 49 AS eligible FROM x JOIN movement_coarse m ON m.movement_id = x.id JOIN movement_coarse a ON a.movement_id = x.anchor_id GROUP BY ALL""", money="difference related_total")
def group_proposals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("group_id"), "o_orderkey")
    anchors = o.groupBy("group_id").agg(F.min("o_orderkey").cast("string").alias("anchor_id"))
    return MA.group_proposals(o.join(anchors, "group_id").select("group_id", "anchor_id", F.col("o_orderkey").cast("string").alias("id")), movements(spark, d, True))


@query("rec04_ledger_both_ways", f"WITH p AS (SELECT left_id, right_id FROM ({PAIR_SQL.format(v='movement', d=3)})) SELECT left_id AS movement_id, right_id AS other_id FROM p UNION ALL SELECT right_id, left_id FROM p")
def ledger_both_ways(spark, d):
    p = match_candidates(spark, d)
    return p.select(F.inline(F.array(F.struct(F.col("left_id").alias("movement_id"), F.col("right_id").alias("other_id")), F.struct(F.col("right_id").alias("movement_id"), F.col("left_id").alias("other_id")))))


@query("agg01_duplicate_fingerprint", "SELECT dataset_version_id, dedupe_fingerprint, count(*) AS occurrences FROM movement_coarse GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_fingerprint(spark, d):
    return Q.duplicate_fingerprint(movements(spark, d, True))


@query("agg02_reference_amount_conflict", "SELECT dataset_version_id, reference_normalised, count(*) AS occurrences FROM movement WHERE reference_normalised IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT (amount, currency_code, direction)) > 1")
def reference_conflict(spark, d):
    return Q.reference_amount_conflict(movements(spark, d))


@query("agg03_posting_delay", "SELECT movement_id FROM movement WHERE posted_on - occurred_on > 31")
def posting_delay(spark, d):
    return Q.posting_delay(movements(spark, d))


@query("agg04_amount_outlier", """WITH r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dataset_version_id, currency_code, direction) AS n FROM movement WINDOW w AS (PARTITION BY dataset_version_id, currency_code, direction ORDER BY amount)),
b AS (SELECT dataset_version_id, currency_code, direction, amount AS median_amount, n FROM r WHERE rn = CAST(ceil(n * 0.5) AS BIGINT)) SELECT m.movement_id AS movement_id FROM movement m JOIN b USING (dataset_version_id, currency_code, direction) WHERE n >= 20 AND m.amount > median_amount * 10""")
def amount_outlier(spark, d):
    return Q.amount_outlier(movements(spark, d))


CROSS = "SELECT movement_id FROM movement_coarse WHERE dedupe_fingerprint IN (SELECT dedupe_fingerprint FROM movement_coarse GROUP BY 1 HAVING count(DISTINCT dataset_version_id) > 1)"
REUSE = "SELECT movement_id FROM movement_coarse JOIN (SELECT dataset_version_id, reference_normalised FROM movement_coarse WHERE reference_normalised IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) USING (dataset_version_id, reference_normalised)"
BURST = "SELECT movement_id FROM movement_coarse JOIN (SELECT dataset_version_id, financial_account_id, occurred_on, currency_code, direction, amount FROM movement_coarse GROUP BY ALL HAVING count(*) >= 4 AND count(DISTINCT dedupe_fingerprint) >= 3) USING (dataset_version_id, financial_account_id, occurred_on, currency_code, direction, amount)"


@query("agg05_cross_dataset_duplicate", CROSS)
def cross_dataset(spark, d):
    return Q.cross_dataset_duplicate(movements(spark, d, True))


@query("agg06_reference_reuse", REUSE)
def reference_reuse(spark, d):
    return Q.reference_reuse(movements(spark, d, True))


@query("agg07_same_day_burst", BURST)
def same_day_burst(spark, d):
    return Q.same_day_burst(movements(spark, d, True))


@query("agg08_multiple_risk", f"WITH s AS (SELECT DISTINCT 'a' AS r, movement_id FROM ({CROSS}) UNION ALL SELECT 'b', movement_id FROM ({REUSE}) UNION ALL SELECT 'c', movement_id FROM ({BURST}) UNION ALL SELECT 'd', movement_id FROM (SELECT * FROM (" + REVERSAL.replace("WITH paired AS (", "WITH paired_ AS (").replace("FROM paired", "FROM paired_") + "))) SELECT movement_id, count(DISTINCT r) AS rules FROM s GROUP BY 1 HAVING count(DISTINCT r) >= 2")
def multiple_risk(spark, d):
    return Q.multiple_risk(movements(spark, d, True))


FINDINGS = """SELECT dataset_version_id, 'dataset_completeness_mismatch' AS rule_code, 'high' AS severity, CAST(1 AS INTEGER) AS occurrences FROM dataset WHERE completeness_state = 'mismatch' UNION ALL SELECT dataset_version_id, 'dataset_completeness_unknown', 'warning', 1 FROM dataset WHERE completeness_state = 'unknown'
UNION ALL SELECT dataset_version_id, 'dataset_rejected_records', 'warning', rejected_count FROM dataset WHERE rejected_count > 0 UNION ALL SELECT dataset_version_id, 'lineage_invalidated', 'high', 1 FROM dataset WHERE lineage_state = 'invalidated'"""


@query("agg09_dataset_findings", FINDINGS)
def dataset_findings(spark, d):
    return Q.dataset_findings(datasets(spark, d))


@query("agg10_recent_scope", f"SELECT f.* FROM ({FINDINGS}) f JOIN (SELECT dataset_version_id FROM dataset ORDER BY prepared_on DESC, dataset_version_id LIMIT 100) USING (dataset_version_id)")
def recent_scope(spark, d):
    ds = datasets(spark, d)
    return Q.recent(Q.dataset_findings(ds).join(ds.select("dataset_version_id"), "dataset_version_id"), ds)


@query("agg10_capped_findings", f"SELECT rule_code, dataset_version_id, total > 500 AS truncated FROM (SELECT rule_code, dataset_version_id, row_number() OVER (PARTITION BY rule_code ORDER BY dataset_version_id) AS rn, count(*) OVER (PARTITION BY rule_code) AS total FROM ({FINDINGS})) WHERE rn <= 500")
def capped_findings(spark, d):
    return Q.capped(Q.dataset_findings(datasets(spark, d)), ["dataset_version_id"]).select("rule_code", "dataset_version_id", "truncated")


@query("agg08_multiple_risk_capped", f"WITH s AS (SELECT DISTINCT 'a' AS r, movement_id FROM ({CROSS}) UNION ALL SELECT 'b', movement_id FROM ({REUSE}) UNION ALL SELECT 'c', movement_id FROM ({BURST}) UNION ALL SELECT 'd', movement_id FROM (SELECT * FROM (" + REVERSAL.replace("WITH paired AS (", "WITH paired_ AS (").replace("FROM paired", "FROM paired_") + "))), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY movement_id) <= 500) SELECT movement_id, count(DISTINCT r) AS rules FROM k GROUP BY 1 HAVING count(DISTINCT r) >= 2")
def multiple_risk_capped(spark, d):
    """The report's form: of each rule the first 500 are combined."""
    return Q.multiple_risk(movements(spark, d, True), Q.CAP)


@query("agg11_issue_upsert", f"""WITH f AS (SELECT sha256('quality-v1|' || rule_code || '|dataset|' || dataset_version_id || '|' || dataset_version_id) AS issue_key, occurrences AS n, dataset_version_id FROM ({FINDINGS})),
old AS (SELECT issue_key, CAST(n + CAST(dataset_version_id AS BIGINT) % 3 - 1 AS INTEGER) AS occurrence_count, 'acknowledged' AS status, DATE '2026-01-01' AS first_seen_on, DATE '2026-01-02' AS last_seen_on FROM f WHERE CAST(dataset_version_id AS BIGINT) % 4 <> 0),
new AS (SELECT * FROM f WHERE CAST(dataset_version_id AS BIGINT) % 6 <> 1)
SELECT coalesce(o.issue_key, w.issue_key) AS issue_key, greatest(o.occurrence_count, w.n) AS occurrence_count, coalesce(status, 'open') AS status, coalesce(first_seen_on, DATE '2026-02-01') AS first_seen_on, CASE WHEN w.n IS NULL THEN last_seen_on ELSE DATE '2026-02-01' END AS last_seen_on,
CASE WHEN o.issue_key IS NULL THEN 'created' WHEN w.issue_key IS NULL THEN 'unchanged' ELSE 'refreshed' END AS change FROM old o FULL JOIN new w ON o.issue_key = w.issue_key""", dates="first_seen_on last_seen_on")
def issue_upsert(spark, d):
    f = Q.dataset_findings(datasets(spark, d)).withColumn("issue_key", Q.issue_key(F.col("rule_code"), F.lit("dataset"), F.col("dataset_version_id"), F.col("dataset_version_id"), "quality-v1"))
    n = F.col("dataset_version_id").cast("long")
    old = f.where(n % 4 != 0).select("issue_key", (F.col("occurrences") + n % 3 - 1).cast("int").alias("occurrence_count"), F.lit("acknowledged").alias("status"), F.lit(dt.date(2026, 1, 1)).alias("first_seen_on"), F.lit(dt.date(2026, 1, 2)).alias("last_seen_on"))
    return Q.upserted(old, f.where(n % 6 != 1).select("issue_key", F.col("occurrences").alias("occurrence_count"), F.lit(dt.date(2026, 2, 1)).alias("seen_on")))


@query("qtr01_triage_history", """WITH e AS (SELECT user_id AS issue_key, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'acknowledged' WHEN 'error' THEN 'dismissed' ELSE 'resolved' END AS status FROM events), b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY issue_key ORDER BY seq), 'open') AS prior FROM e)
SELECT issue_key, seq, status, prior = 'open' OR (prior = 'acknowledged' AND status IN ('resolved', 'dismissed')) AS allowed FROM b""")
def triage_history(spark, d):
    status = F.when(F.col("event_type") == "purchase", "acknowledged").when(F.col("event_type") == "error", "dismissed").otherwise("resolved")
    return Q.triage_history(table(spark, d, "events").select(F.col("user_id").alias("issue_key"), F.col("event_id").alias("seq"), status.alias("status")))


@query("agg12_state_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE state = 'staging') AS staging, count(*) FILTER (WHERE state = 'validated') AS validated, count(*) FILTER (WHERE state = 'published') AS published, count(*) FILTER (WHERE state = 'rejected') AS rejected FROM dataset")
def state_counts(spark, d):
    return R.state_counts(datasets(spark, d), "state", ["staging", "validated", "published", "rejected"])


TOTALS = "count(*) AS movement_count, CAST(coalesce(sum(amount) FILTER (WHERE direction = 'inflow'), 0) AS DECIMAL(38,12)) AS inflow_amount, CAST(coalesce(sum(amount) FILTER (WHERE direction = 'outflow'), 0) AS DECIMAL(38,12)) AS outflow_amount"


@query("agg13_money_totals", f"SELECT currency_code, {TOTALS} FROM movement WHERE state <> 'voided' AND lineage_state = 'complete' GROUP BY currency_code", money="inflow_amount outflow_amount")
def money_totals(spark, d):
    return R.money_totals(movements(spark, d).where("state <> 'voided' AND lineage_state = 'complete'"))


def span_of(spark, d):
    first, last = table(spark, d, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return first - dt.timedelta(days=70), last + dt.timedelta(days=40)


SPAN = "SELECT date_trunc('month', min(ts)::DATE - 70)::DATE AS a, (max(ts)::DATE + 39) AS z FROM events"
MONTHS = f"SELECT unnest(generate_series(a::TIMESTAMP, date_trunc('month', z)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM ({SPAN})"


@query("agg14_activity_series", f"SELECT month, coalesce(mv, 0) AS movements, coalesce(dl, 0) AS delayed FROM ({MONTHS}) LEFT JOIN (SELECT date_trunc('month', occurred_on)::DATE AS month, count(*) AS mv FROM movement GROUP BY 1) USING (month) LEFT JOIN (SELECT date_trunc('month', posted_on)::DATE AS month, count(*) AS dl FROM movement, (SELECT max(ts)::DATE + 40 AS e FROM events) WHERE posted_on < e GROUP BY 1) USING (month)", dates="month")
def activity_series(spark, d):
    m = movements(spark, d)
    return R.activity_series(spark, *span_of(spark, d), movements=(m, "occurred_on"), delayed=(m.where("posted_on IS NOT NULL"), "posted_on"))


@query("agg15_money_series", f"SELECT month, currency_code, coalesce(movement_count, 0) AS movement_count, coalesce(inflow_amount, 0::DECIMAL(38,12)) AS inflow_amount, coalesce(outflow_amount, 0::DECIMAL(38,12)) AS outflow_amount FROM ({MONTHS}) CROSS JOIN (SELECT DISTINCT currency_code FROM movement) LEFT JOIN (SELECT date_trunc('month', occurred_on)::DATE AS month, currency_code, {TOTALS} FROM movement GROUP BY 1, 2) USING (month, currency_code)", money="inflow_amount outflow_amount", dates="month")
def money_series(spark, d):
    return R.money_series(spark, movements(spark, d), *span_of(spark, d))


@query("agg16_ordered_digest", """WITH a AS (SELECT dataset_version_id, CAST(movement_id AS BIGINT) >> 12 AS at_, sha256(string_agg(movement_id || ':' || dedupe_fingerprint, '' ORDER BY CAST(movement_id AS BIGINT))) AS t, count(*) AS n FROM movement GROUP BY 1, 2),
b AS (SELECT dataset_version_id, at_ >> 12 AS at_, sha256(string_agg(t, '' ORDER BY at_)) AS t, sum(n) AS n FROM a GROUP BY 1, a.at_ >> 12) SELECT dataset_version_id, sha256(string_agg(t, '' ORDER BY at_)) AS digest, sum(n) AS movements FROM b GROUP BY 1""", longs="movements")
def ordered_digest(spark, d):
    from ..operators.publication import ordered_digest as digest

    m = movements(spark, d).select("dataset_version_id", F.col("movement_id").cast("long").alias("ordinal"), F.concat_ws(":", "movement_id", "dedupe_fingerprint").alias("record"))
    return digest(m, ["dataset_version_id"], "ordinal", "record").withColumnRenamed("records", "movements")


@query("agg17_conservation", "SELECT l_orderkey, sum(l_linenumber) AS expected, sum(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END) AS movements, sum(CASE WHEN l_quantity < 25 THEN l_linenumber ELSE 0 END) AS rejected, bool_and(l_quantity <> 25) AS conserved FROM lineitem GROUP BY 1", longs="expected movements rejected")
def conservation(spark, d):
    from ..operators.publication import conservation as check

    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("expected"), F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).otherwise(0).alias("movements"), F.when(F.col("l_quantity") < 25, F.col("l_linenumber")).otherwise(0).alias("rejected"))
    return check(x, ["l_orderkey"])


@query("agg18_consistency", "SELECT dataset_version_id, count(DISTINCT currency_code) = 1 AS one_currency, bool_and(state <> 'voided') AS none_voided, count(DISTINCT financial_account_id) AS accounts FROM movement GROUP BY 1")
def consistency(spark, d):
    one = (F.min("currency_code") == F.max("currency_code")).alias("one_currency")
    return movements(spark, d).groupBy("dataset_version_id").agg(one, F.bool_and(F.col("state") != "voided").alias("none_voided"), F.countDistinct("financial_account_id").alias("accounts"))


@query("agg20_distinct_sorted", "SELECT financial_account_id, array_to_string(list_sort(list(DISTINCT reference_normalised) FILTER (WHERE reference_normalised IS NOT NULL)), ',') AS refs FROM movement_coarse GROUP BY 1")
def distinct_sorted(spark, d):
    return movements(spark, d, True).groupBy("financial_account_id").agg(F.array_join(F.array_sort(F.collect_set("reference_normalised")), ",").alias("refs"))


@query("agg22_correction_counts", "SELECT o_custkey AS dataset, count(*) FILTER (WHERE o_orderstatus = 'P') AS proposed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS approved_unapplied FROM orders GROUP BY 1")
def correction_counts(spark, d):
    from ..operators.corrections import pending_counts

    state = F.when(F.col("o_orderstatus") == "P", "proposed").when(F.col("o_orderstatus") == "O", "approved").otherwise("rejected")
    return pending_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), state.alias("state"), (F.col("o_orderkey") % 2 == 1).alias("applied")), "dataset")


@query("agg23_missing_accounting_dates", "SELECT dataset_version_id, count(*) FILTER (WHERE accounting_date IS NULL) AS missing, count(DISTINCT reference_normalised) AS refs FROM movement GROUP BY 1")
def missing_accounting_dates(spark, d):
    return R.missing_dates(movements(spark, d))


@query("agg24_usage_to_date", "SELECT user_id % 10 AS company, event_type AS metric, sum(event_id) AS quantity FROM events WHERE ts >= (SELECT date_trunc('month', max(ts)) FROM events) GROUP BY 1, 2", longs="quantity")
def usage_to_date(spark, d):
    e = table(spark, d, "events")
    meter = e.select((F.col("user_id") % 10).alias("company"), F.col("event_type").alias("metric"), F.col("event_id").alias("quantity"), F.col("ts").alias("used_at"))
    return R.usage_to_date(meter, e.agg(F.max("ts").alias("now")))


@query("agg25_platform_counters", "SELECT count(*) AS jobs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS identities FROM events")
def platform_counters(spark, d):
    return R.platform_counters(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"), F.col("user_id").alias("identity")))


@query("agg26_overlay_set_digest", "SELECT o_custkey, sha256(string_agg(p || v, ',' ORDER BY p || v)) AS digest FROM (SELECT o_custkey, left(v, 3) AS p, sha256(string_agg(v, ',' ORDER BY v)) AS v FROM (SELECT o_custkey, sha256(o_orderkey || o_orderpriority) AS v FROM orders) GROUP BY 1, 2) GROUP BY 1")
def overlay_set_digest(spark, d):
    from ..operators.corrections import set_digest

    return set_digest(table(spark, d, "orders"), ["o_custkey"], F.sha2(F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority"), 256))


@query("agg27_account_usage", "SELECT c_custkey, count(o_orderkey) AS movements, count(*) FILTER (WHERE o_orderstatus = 'O') AS active_links FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def account_usage(spark, d):
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "O").alias("active"))
    return R.account_usage(table(spark, d, "customer").select("c_custkey"), m, "c_custkey")


@query("agg28_roll_up", "SELECT n_regionkey, count(*) AS companies, sum(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12))) AS amount, min(c_custkey) AS first_due, max(c_custkey) AS last_due FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 GROUP BY 1", money="amount")
def roll_up(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.roll_up(c.select("n_regionkey", F.col("c_acctbal").cast("decimal(38,12)").alias("amount"), F.col("c_custkey").alias("due_on")), ["n_regionkey"])


@query("win01_latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_version(spark, d):
    return L.latest(table(spark, d, "orders"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win02_highest_override", "SELECT source_record, field, value FROM (SELECT user_id AS source_record, event_type AS field, props AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def highest_override(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("source_record"), F.col("event_type").alias("field")).agg(F.max_by("props", "event_id").alias("value"))


@query("win05_latest_item_decision", "SELECT statement_id, adjustment_side, item_id, decision_version FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, adjustment_side ORDER BY decision_version DESC, item_id) AS rn FROM item) WHERE rn = 1")
def latest_item_decision(spark, d):
    from .views import items

    return L.latest(items(spark, d), ["statement_id", "adjustment_side"], F.desc("decision_version"), F.asc("item_id")).select("statement_id", "adjustment_side", "item_id", "decision_version")


@query("win06_next_version", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_version FROM lineitem GROUP BY 1")
def next_version(spark, d):
    return L.next_version(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("top01_truncation", "SELECT o_orderkey, o_totalprice, TRUE AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def truncation(spark, d):
    return L.with_one_more(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query("top02_severity_order", f"SELECT * FROM (SELECT dataset_version_id, rule_code, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_code, CAST(dataset_version_id AS BIGINT)) AS place FROM ({FINDINGS})) WHERE place <= 200")
def severity_order(spark, d):
    f = Q.dataset_findings(datasets(spark, d))
    order = [F.when(F.col("severity") == "high", 0).when(F.col("severity") == "warning", 1).otherwise(2), F.col("rule_code"), F.col("dataset_version_id").cast("long")]
    top = f.orderBy(*order).limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("dataset_version_id", "rule_code", "place")


@query("top03_keyset_after", "SELECT event_id, ts FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events WHERE event_id = 500) ORDER BY ts DESC, event_id DESC LIMIT 40")
def keyset_after(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    here = e.where("event_id = 500").first()
    return L.after(e, ["ts", "event_id"], [here.ts, here.event_id], 40)


@query("top04_review_queue", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate, o_orderkey LIMIT 100")
def review_queue(spark, d):
    return L.page(table(spark, d, "orders"), [F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), F.asc("o_orderdate"), F.asc("o_orderkey")], 0, 100).select("o_orderkey", "o_orderstatus")


@query("top05_recent_datasets", "SELECT dataset_version_id, state, prepared_on FROM dataset ORDER BY prepared_on DESC, dataset_version_id LIMIT 12", dates="prepared_on")
def recent_datasets(spark, d):
    return datasets(spark, d).orderBy(F.desc("prepared_on"), "dataset_version_id").limit(12).select("dataset_version_id", "state", "prepared_on")


@query("scn01_record_page", "SELECT record_ordinal, fecha, descripcion FROM raw_row ORDER BY record_ordinal LIMIT 200 OFFSET 400")
def record_page(spark, d):
    from ..functions.text import stripped
    from .views import raw_rows

    return L.page(raw_rows(spark, d), [F.asc("record_ordinal")], 400, 5000).select("record_ordinal", F.col("raw_values")[0].alias("fecha"), stripped(F.col("raw_values")[1]).alias("descripcion"))


@query("scn02_movement_page", "SELECT movement_id, amount FROM movement WHERE dataset_version_id = 'A' ORDER BY CAST(movement_id AS BIGINT) LIMIT 50 OFFSET 100", money="amount")
def movement_page(spark, d):
    return L.page(movements(spark, d).where("dataset_version_id = 'A'"), [F.col("movement_id").cast("long").asc()], 100, 50).select("movement_id", "amount")


@query("scn03_dataset_list", "SELECT dataset_version_id, state, c.c_name AS source_name FROM dataset LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = data_source_id WHERE company_id = '3'")
def dataset_list(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("data_source_id"), F.col("c_name").alias("source_name"))
    return datasets(spark, d).where("company_id = '3'").join(c, "data_source_id", "left").select("dataset_version_id", "state", "source_name")


@query("set02_missing_work", "SELECT o_orderkey AS k, 'no_lines' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT c_custkey, 'no_orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_work(spark, d):
    idle = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("k"), F.lit("no_orders").alias("kind"))
    return without_lines(spark, d).select(F.col("o_orderkey").alias("k"), F.lit("no_lines").alias("kind")).unionByName(idle)


@query("set03_expected_minus_assessed", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def expected_minus_assessed(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("set04_array_checks", "WITH a AS (SELECT user_id, list(event_id % 9 ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, len(v) = len(list_distinct(v)) AS all_distinct, list_sort(v) = v AS ordered, list_has_all([0, 1, 2, 3, 4, 5, 6], v) AS subset FROM a")
def array_checks(spark, d):
    return S.sequence_checks(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_id") % 9, [*range(7)])


@query("scl02_money_text", "SELECT movement_id, CAST(amount AS VARCHAR) AS text FROM movement")
def money_as_text(spark, d):
    return movements(spark, d).select("movement_id", money_text(F.col("amount")).alias("text"))


@query("scl05_normalised_reference", "SELECT record_ordinal, 'REF ' || record_ordinal AS reference FROM raw_row")
def reference(spark, d):
    from .views import raw_rows

    return raw_rows(spark, d).select("record_ordinal", normalised_reference(F.col("raw_values")[2]).alias("reference"))


@query("scl06_fingerprint", "SELECT movement_id, dedupe_fingerprint FROM movement")
def fingerprints(spark, d):
    return movements(spark, d).select("movement_id", "dedupe_fingerprint")


@query("scl07_digest_of", "SELECT movement_id, sha256(coalesce(reference_normalised, '')) AS digest FROM movement")
def digests(spark, d):
    return movements(spark, d).select("movement_id", digest_of(F.col("reference_normalised")).alias("digest"))


@query("scl08_canonical_json", """SELECT movement_id, '{"amount":"' || amount || '","reference":' || coalesce('"' || reference_normalised || '"', 'null') || '}' AS json FROM movement""")
def canonical(spark, d):
    return movements(spark, d).select("movement_id", canonical_json(reference=F.col("reference_normalised"), amount=F.col("amount").cast("string")).alias("json"))


@query("scl13_spreadsheet_safe", "SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[ \\t\\r\\n]*[=+@-]') THEN '''' || t ELSE t END AS safe FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || text WHEN 1 THEN ' -' || text ELSE text END AS t FROM conversations)")
def safe_cells(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" -"), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", spreadsheet_safe(t).alias("safe"))


@query("scl19_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '_1') OR contains(lower(c_name), '#00000001')")
def search(spark, d):
    return table(spark, d, "customer").where(contains_ignoring_case(F.col("c_name"), "_1") | contains_ignoring_case(F.col("c_name"), "#00000001")).select("c_custkey")
