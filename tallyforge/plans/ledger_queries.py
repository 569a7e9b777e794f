"""Queries over ledgers, grids, histories and generated rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import latest as L
from ..operators import ledgers as LE
from ..operators import lineage as LI
from ..operators import mapping as MP
from ..operators import reports as R
from ..operators import sets as S
from ..operators.rounds import scratch
from ..sources import admission as A
from ..sources import export as X
from ..sources import ranges as RG
from .registry import query
from .views import datasets, items, movements, table


@query("jon04_recover_ordinals", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def recover_ordinals(spark, d):
    l = table(spark, d, "lineitem").withColumn("dataset_key", F.col("l_orderkey"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_key"), "o_custkey", F.col("o_custkey").alias("account_key"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("account_key"), "c_nationkey")
    return LE.located(l, o, c).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_nationkey")


@query("jon12_months_by_currency", "SELECT n_nationkey, r_name FROM nation CROSS JOIN region")
def months_by_currency(spark, d):
    return table(spark, d, "nation").select("n_nationkey").crossJoin(table(spark, d, "region").select("r_name"))


@query("jon18_array_membership", "SELECT event_id FROM events WHERE user_id IN (SELECT unnest([o_custkey, o_custkey + 1]) FROM orders WHERE o_orderstatus = 'P')")
def array_membership(spark, d):
    owners = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids"))
    return S.members_of(table(spark, d, "events"), "user_id", owners, "ids").select("event_id")


@query("win03_latest_statement", "SELECT o_custkey, period, o_orderkey FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_statement(spark, d):
    o = table(spark, d, "orders").withColumn("period", F.year("o_orderdate"))
    return L.latest(o, ["o_custkey", "period"], F.desc("o_orderkey")).select("o_custkey", "period", "o_orderkey")


@query("win04_latest_promotion", "SELECT user_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1")
def latest_promotion(spark, d):
    return L.latest(table(spark, d, "events"), ["user_id"], F.desc("event_id")).select("user_id", F.col("event_type").alias("decision"))


@query("win07_latest_plan", "SELECT p_brand, max(p_size) AS version FROM part GROUP BY 1")
def latest_plan(spark, d):
    return L.latest(table(spark, d, "part"), ["p_brand"], F.desc("p_size"), F.asc("p_partkey")).select("p_brand", F.col("p_size").alias("version"))


BANK = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,12))"


@query("bal04_derived_statements", f"""WITH s AS (SELECT statement_id, sum(amount) FILTER (WHERE adjustment_side = 'add_to_bank') AS p, sum(amount) FILTER (WHERE adjustment_side = 'deduct_from_bank') AS m FROM item WHERE state = 'confirmed' GROUP BY 1),
b AS (SELECT c_custkey AS k, {BANK} AS bank, CASE WHEN c_custkey % 7 = 0 THEN 'balance_type' WHEN c_custkey % 11 = 0 THEN 'release' WHEN c_custkey % 13 = 0 THEN 'same_source' WHEN c_custkey % 17 = 0 THEN 'assessments_incomplete' END AS error_code FROM customer)
SELECT CAST(k AS VARCHAR) AS statement_id, error_code, CASE WHEN error_code IS NULL THEN coalesce(p, 0) - coalesce(m, 0) - 25 END AS unexplained, CASE WHEN error_code IS NULL THEN CASE WHEN coalesce(p, 0) - coalesce(m, 0) = 25 THEN 'balanced' ELSE 'review_required' END END AS state FROM b LEFT JOIN s ON s.statement_id = CAST(k AS VARCHAR)""", money="unexplained")
def derived_statements(spark, d):
    k = F.col("c_custkey")
    bank = F.col("c_acctbal").cast("decimal(38,12)")
    pairs = table(spark, d, "customer").select(
        k.cast("string").alias("statement_id"), bank.alias("bank_amount"), (bank + 25).cast("decimal(38,12)").alias("books_amount"), F.when(k % 7 == 0, "ledger").otherwise("closing").alias("bank_type"), F.lit("ledger").alias("books_type"),
        F.lit("c").alias("bank_company_id"), F.lit("c").alias("books_company_id"), F.lit("COP").alias("bank_currency_code"), F.lit("COP").alias("books_currency_code"), F.lit("r1").alias("bank_release"), F.when(k % 11 == 0, "r2").otherwise("r1").alias("books_release"),
        F.lit("s1").alias("bank_source_id"), F.when(k % 13 == 0, "s1").otherwise("s2").alias("books_source_id"), F.when(k % 17 == 0, 1).otherwise(2).alias("assessments"), F.lit(2).alias("expected_sources"),
    )
    return LE.derived_statements(pairs, items(spark, d))


@query("clo05_close_violations", """WITH p AS (SELECT o_custkey AS period, o_orderkey AS version, o_orderstatus = 'F' AS reviewed, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders), c AS (SELECT o_custkey AS period, count(DISTINCT o_orderpriority) AS codes, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS op FROM orders GROUP BY 1)
SELECT period, version, 'not_reviewed' AS violation FROM p WHERE NOT reviewed UNION ALL SELECT period, version, 'not_latest' FROM p WHERE version <> last UNION ALL SELECT period, version, 'controls_not_exact' FROM p JOIN c USING (period) WHERE codes <> 5 OR n <> codes UNION ALL SELECT period, version, 'controls_open' FROM p JOIN c USING (period) WHERE op > 0""")
def close_violations(spark, d):
    o = table(spark, d, "orders")
    packets = o.select(F.col("o_custkey").alias("period"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft").alias("state"))
    controls = o.select(F.col("o_custkey").alias("period"), F.col("o_orderpriority").alias("control"), (F.col("o_orderkey") % 10 != 0).alias("passed"))
    return LE.close_violations(packets, controls, ["period"], 5)


@query("lin01_build_plan", "SELECT f AS field, n AS stage, o AS operation, sha256('v1|' || f || '|' || o) AS config_digest FROM (SELECT DISTINCT p_brand || ':' || p_type AS f FROM part), (VALUES (1, 'extract'), (2, 'normalise'), (3, 'parse'), (4, 'map'), (5, 'derive'), (6, 'publish')) b(n, o)")
def build_plan(spark, d):
    """A plan for each field that the table of parts names."""
    fields = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("field"))
    return LI.plan_of(fields, "v1").select("field", "stage", "operation", "config_digest")


@query("lin04_complete_fields", "SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) = [1, 2] AS complete FROM lineitem GROUP BY 1")
def complete_fields(spark, d):
    return LI.complete_fields(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", [1, 2])


@query("lin05_decision_lineage", "SELECT DISTINCT 'balance:' || l_partkey AS from_id, 'statement:' || l_orderkey AS to_id FROM lineitem UNION SELECT DISTINCT 'assessment:' || l_suppkey, 'statement:' || l_orderkey FROM lineitem")
def decision_lineage(spark, d):
    l = table(spark, d, "lineitem").withColumn("entity_id", F.col("l_orderkey"))
    inputs = F.array(F.concat(F.lit("balance:"), F.col("l_partkey").cast("string")), F.concat(F.lit("assessment:"), F.col("l_suppkey").cast("string")))
    return LE.decision_lineage(l, "statement", inputs)[1]


@query("lin07_statement_inputs", "SELECT l_orderkey, count(DISTINCT l_partkey) AS balances, count(DISTINCT l_suppkey) AS assessments FROM lineitem GROUP BY 1")
def statement_inputs(spark, d):
    return LI.input_counts(table(spark, d, "lineitem"), ["l_orderkey"], balances="l_partkey", assessments="l_suppkey")


@query("map08_blockers", "SELECT s_suppkey AS mapping_id, CAST(s_suppkey % 5 AS INTEGER) AS column_index, CASE WHEN s_suppkey % 2 = 0 THEN 'dmy' ELSE 'comma' END AS convention FROM supplier WHERE s_suppkey % 3 <> 0")
def blockers(spark, d):
    k = F.col("s_suppkey")
    a = table(spark, d, "supplier").select(k.alias("mapping_id"), (k % 5).cast("int").alias("column_index"), F.when(k % 2 == 0, "dmy").otherwise("comma").alias("convention"))
    decided = a.where("mapping_id % 3 = 0 OR mapping_id % 4 = 0").withColumn("convention", F.when(F.col("mapping_id") % 3 == 0, F.col("convention")).otherwise("mdy"))
    return LE.mapping_blockers(a, decided)


@query(
    "map12_versions_in_force",
    """WITH v AS (SELECT p_brand AS template_id, p_partkey AS version, p_size AS size, DATE '2024-01-01' + CAST(p_partkey % 400 AS INTEGER) AS validated_on, CASE WHEN p_partkey % 5 = 0 THEN 'draft' WHEN p_partkey % 89 = 0 THEN 'frozen' ELSE 'validated' END AS state, p_partkey % 3 AS ambiguities, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS decisions FROM part),
z AS (SELECT template_id, min(version) AS last FROM v WHERE state = 'frozen' GROUP BY 1), l AS (SELECT v.* FROM v LEFT JOIN z USING (template_id) WHERE state <> 'draft' AND decisions >= ambiguities AND (last IS NULL OR version <= last)),
f AS (SELECT o_orderkey AS file_id, CAST(o_orderkey % 50 + 1 AS INTEGER) AS size, DATE '2024-01-01' + CAST(o_custkey % 500 AS INTEGER) AS uploaded_on FROM orders)
SELECT file_id, arg_max(template_id, (validated_on, template_id, version)) AS template_id, arg_max(version, (validated_on, template_id, version)) AS version FROM f JOIN l ON f.size = l.size AND validated_on <= uploaded_on GROUP BY file_id""",
)
def template_versions_in_force(spark, d):
    n, day = F.col("p_partkey"), lambda k: F.date_add(F.lit(dt.date(2024, 1, 1)), k.cast("int"))
    state = F.when(n % 5 == 0, "draft").when(n % 89 == 0, "frozen").otherwise("validated")
    v = table(spark, d, "part").select(F.col("p_brand").alias("template_id"), n.alias("version"), F.sha2(F.col("p_size").cast("string"), 256).alias("schema_digest"), day(n % 400).alias("validated_on"), state.alias("state"), (n % 3).alias("ambiguities"), F.when(n % 7 == 0, 0).otherwise(2).alias("decisions"))
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(k.alias("file_id"), F.sha2((k % 50 + 1).cast("string"), 256).alias("schema_digest"), day(F.col("o_custkey") % 500).alias("uploaded_on"))
    return MP.versions_in_force(v, f)


@query("map12_template_compatibility", "SELECT a.p_partkey AS template, b.p_partkey AS file FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1")
def template_compatibility(spark, d):
    schema = F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), 256)
    p = table(spark, d, "part").select("p_partkey", schema.alias("schema_digest"))
    return p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "template").join(p.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "file"), "schema_digest").select("template", "file")


@query("ops06_operational_report", "SELECT currency_code, count(*) AS movement_count, CAST(sum(CASE WHEN direction = 'inflow' THEN amount ELSE 0 END) AS DECIMAL(38,12)) AS inflow_amount, CAST(sum(CASE WHEN direction = 'outflow' THEN amount ELSE 0 END) AS DECIMAL(38,12)) AS outflow_amount FROM movement, (SELECT max(ts)::DATE AS z FROM events) WHERE occurred_on > z - 90 AND occurred_on <= z AND state <> 'voided' AND lineage_state = 'complete' GROUP BY 1", money="inflow_amount outflow_amount")
def operational_report(spark, d):
    last = table(spark, d, "events").agg(F.to_date(F.max("ts"))).first()[0]
    m = movements(spark, d).where("state <> 'voided' AND lineage_state = 'complete'")
    return R.money_totals(m.where(R.within("occurred_on", *R.window(90, last))))


@query("ops07_document_history", "SELECT c_custkey AS artifact_id, r.k AS run_id, r.s AS run_state, e.t AS decision FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) r ON r.o_custkey = c_custkey LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) e ON e.user_id = c_custkey")
def document_history(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_on"), F.col("o_orderstatus").alias("state"))
    decisions = table(spark, d, "events").select(F.col("user_id").alias("artifact_id"), F.col("event_id").alias("decision_id"), F.col("event_id").alias("decided_on"), F.col("event_type").alias("decision"))
    return LE.document_history(table(spark, d, "customer").select(F.col("c_custkey").alias("artifact_id")), runs, decisions)


@query("pub03_release_problems", "SELECT s_suppkey AS engine_release_id, CASE WHEN s_suppkey % 5 = 0 THEN 'not_approved' WHEN s_suppkey % 5 = 1 THEN 'not_attested' WHEN s_suppkey % 5 = 2 THEN 'components_changed' END AS problem FROM supplier")
def release_problems(spark, d):
    n = F.col("s_suppkey") % 5
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("engine_release_id"), F.when(n == 0, "draft").otherwise("approved").alias("state"), F.when(n != 1, "signed").alias("attestation"), F.when(n == 2, "x").otherwise("y").alias("components_digest"), F.lit("y").alias("approved_digest"))
    return LE.release_problems(r)


@query("ded04_decision_findings", """WITH d AS (SELECT event_id AS id, user_id AS c, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT id AS event_id, array_to_string(list_filter([CASE WHEN id % 11 = 0 THEN 'missing_reason_code' END, CASE WHEN id % 17 = 0 THEN 'missing_evidence_refs' END, CASE WHEN id % 19 = 0 THEN 'missing_audit_event_id' END, CASE WHEN id % 7 = 0 THEN 'decision_state' END, CASE WHEN id % 4 = 1 THEN 'pair_order' END,
CASE WHEN id % 13 = 0 THEN 'deletes_movement' END, CASE WHEN p IS NOT NULL AND id % 5 = 0 THEN 'reversal_reference' WHEN p IS NULL AND id % 5 = 1 THEN 'reversal_of_nothing' END, CASE WHEN p % 3 = id % 3 THEN 'reversal_by_same_person' END], lambda x: x IS NOT NULL), ',') AS findings FROM d""")
def decision_findings(spark, d):
    from pyspark.sql import Window

    e, n = table(spark, d, "events"), F.col("event_id")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    text = lambda c: c.cast("string")
    x = e.withColumn("p", before).select(
        n.alias("decision_id"), "event_id", F.lit("c1").alias("company_id"), F.col("user_id").alias("candidate_id"), F.when(n % 4 == 1, "b").otherwise("a").alias("left_movement_id"), F.when(n % 4 == 1, "a").otherwise("b").alias("right_movement_id"),
        F.when(n % 7 == 0, "guessed").otherwise("confirmed_distinct").alias("decision"), F.when(n % 11 != 0, "same").alias("reason_code"), F.when(n % 17 == 0, "").otherwise("doc-1").alias("evidence_refs"), text(n % 3).alias("decided_by"), F.col("ts").alias("decided_at"),
        F.lit("v1").alias("rule_version"), F.lit("r1").alias("engine_release_id"), F.when(n % 19 != 0, text(n)).alias("audit_event_id"), (n % 13 == 0).alias("physically_deletes_movement"), F.lit(False).alias("deletes_source_evidence"),
        F.when(F.col("p").isNotNull(), F.when(n % 5 != 0, F.col("p"))).when(n % 5 == 1, n).alias("reverses_decision_id"),
    )
    return I.decision_findings(x).select("event_id", F.array_join("findings", ",").alias("findings"))


@query("sec03_segregation", """WITH a AS (SELECT l_orderkey AS o, l_suppkey % 5 AS s, CASE l_linenumber WHEN 1 THEN 'match.propose' WHEN 2 THEN 'match.confirm' WHEN 3 THEN 'close.prepare' WHEN 4 THEN 'close.approve' WHEN 5 THEN 'dataset.map' ELSE 'dataset.publish' END AS p FROM lineitem),
q AS (SELECT * FROM (VALUES ('match.propose', 'match.confirm'), ('close.prepare', 'close.approve'), ('close.reopen.request', 'close.reopen.approve'), ('dataset.map', 'dataset.publish')) t(f, g))
SELECT DISTINCT x.o AS object_id, x.s AS subject_id, f AS first, g AS second FROM a x JOIN q ON x.p = f JOIN a y ON y.o = x.o AND y.s = x.s AND y.p = g""")
def segregation(spark, d):
    n = F.col("l_linenumber")
    act = F.when(n == 1, "match.propose").when(n == 2, "match.confirm").when(n == 3, "close.prepare").when(n == 4, "close.approve").when(n == 5, "dataset.map").otherwise("dataset.publish")
    return I.segregation_breaches(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), (F.col("l_suppkey") % 5).alias("subject_id"), act.alias("permission")))


@query("sec04_audit_page", "SELECT event_id, event_type FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 30")
def audit_page(spark, d):
    return L.after(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], [400], 30, backwards=True)


@query("txt03_unredacted_logs", "SELECT event_id AS entry_id, CASE WHEN event_id % 6 = 0 THEN 'secret,value' ELSE 'value' END AS fields FROM events WHERE event_id % 3 = 0")
def unredacted_logs(spark, d):
    n = F.col("event_id")
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), F.when(n % 3 == 0, F.col("props")).otherwise("[redacted]"), F.lit("secret"), F.when(n % 6 == 0, F.lit("x")))
    return LE.unredacted(table(spark, d, "events").select(n.alias("entry_id"), fields.alias("fields"))).withColumn("fields", F.array_join("fields", ","))


@query("src16_media_types", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/zip' ELSE 'text/plain' END AS kind, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 = 3 THEN 'interpreter_script' END AS program FROM customer")
def media_types(spark, d):
    n = F.col("c_custkey")
    content = F.when(n % 4 == 0, F.lit("%PDF-1.7")).when(n % 4 == 1, "a;b").when(n % 4 == 2, F.lit("PK\x03\x04")).when(n % 5 == 0, "#!sh").otherwise("text").cast("binary")
    name = F.when(n % 4 == 1, "x.CSV").otherwise("x.bin")
    return table(spark, d, "customer").select("c_custkey", A.media_type(content, name).alias("kind"), A.program(content).alias("program"))


NOTE = "o_orderstatus || chr(10) || '\"' || o_custkey || '\";' || o_orderkey"


@query(
    "src01_records_by_ranges",
    f"SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day, note, strlen(o_orderkey::VARCHAR) + strlen(CAST(o_orderdate AS VARCHAR)) + strlen(replace(note, '\"', '\"\"')) + 9 AS bytes, 3 AS field_count, 'complete' AS state FROM (SELECT *, {NOTE} AS note FROM orders)",
    longs="bytes field_count",
)
def records_by_ranges(spark, d):
    """All orders written as statements with quotes, marks and line ends inside cells, and read back by byte ranges."""
    note = F.concat("o_orderstatus", F.lit('\n"'), F.col("o_custkey").cast("string"), F.lit('";'), F.col("o_orderkey").cast("string"))
    folder = scratch(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").cast("string").alias("day"), note.alias("note"))
    rows.write.options(header=True, quoteAll=True, escape='"', sep=";", lineSep="\n").csv(folder)
    found = RG.read(spark, folder, "*.csv", limits=RG.Limits(rows=None, bytes=None, seconds=None)).records.where("record_ordinal > 1")
    cell = F.col("raw_values")
    return found.select(cell[0].cast("long").alias("o_orderkey"), cell[1].alias("day"), cell[2].alias("note"), (F.col("byte_end") - F.col("byte_start")).alias("bytes"), "field_count", "state")


@query("src20_generated_statement", "SELECT o_orderkey AS record_ordinal, strftime(DATE '2026-02-13' + CAST(o_orderkey % 28 AS INTEGER), '%d/%m/%Y') || ';mov ' || o_orderkey || ';' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || (o_orderkey % 1000) || ',50' AS line FROM orders")
def generated_statement(spark, d):
    """A statement's line for each order, its form decided by the order's key."""
    n = F.col("o_orderkey")
    line = F.concat(F.date_format(F.date_add(F.lit(dt.date(2026, 2, 13)), (n % 28).cast("int")), "dd/MM/yyyy"), F.lit(";mov "), n.cast("string"), F.lit(";"), F.when(n % 2 == 0, "-").otherwise(""), (n % 1000).cast("string"), F.lit(",50"))
    return table(spark, d, "orders").select(n.alias("record_ordinal"), line.alias("line"))


@query("snk03_export_rows", "SELECT movement_id AS record_ordinal, movement_id, CAST(occurred_on AS VARCHAR) AS occurred_on, coalesce(CAST(posted_on AS VARCHAR), '') AS posted_on, '' AS value_date, coalesce(CAST(accounting_date AS VARCHAR), '') AS accounting_date, CAST(amount AS VARCHAR) AS amount, currency_code AS currency, direction, kind, description, coalesce(reference_normalised, '') AS reference, state, 'v1' AS canonical_schema_version, 'r1' AS engine_release, lineage_state FROM movement")
def export_rows(spark, d):
    m = movements(spark, d)
    return X.export_rows(m.withColumn("record_ordinal", F.col("movement_id")).withColumn("canonical_schema_version", F.lit("v1")).withColumn("engine_release", F.lit("r1")))


@query("snk03_preflight", "SELECT dataset_version_id, k % 250001 AS row_count, CASE WHEN NOT (state = 'published' AND completeness_state = 'verified' AND lineage_state = 'complete' AND k % 3 <> 0 AND rejected_count = 0 AND k % 8 <> 0) THEN 'dataset-export-unavailable' WHEN k % 250001 > 200000 THEN 'dataset-export-too-large' END AS refusal FROM (SELECT *, CAST(dataset_version_id AS BIGINT) * 7919 AS k FROM dataset)")
def export_preflight(spark, d):
    k = F.col("dataset_version_id").cast("long") * 7919
    x = datasets(spark, d).withColumn("reproducible", k % 3 != 0).withColumn("movement_count", k % 250001)
    return X.preflight(x.withColumn("record_count", F.col("movement_count") + F.when(k % 8 == 0, 1).otherwise(0)))


@query("scn03_published_by_company", "SELECT company_id, count(*) FILTER (WHERE state = 'published') AS published, max(prepared_on) AS last FROM dataset GROUP BY 1", dates="last")
def published_by_company(spark, d):
    return datasets(spark, d).groupBy("company_id").agg(F.count_if(F.col("state") == "published").alias("published"), F.max("prepared_on").alias("last"))
