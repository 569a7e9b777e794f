"""Mixing sources to target weights, by hierarchical budgets over a domain, language and source tree.

A total of tokens goes down the tree. At each node it is divided among the children by their weights; a child that holds less than its
share gives what it lacks to its siblings, again by weight, and only what all siblings together cannot take was withheld from the
node by its own siblings' level before. A leaf's budget takes whole passes over its documents (epochs) and then a prefix of
one more, in an order seeded for each epoch; the prefix ends with the last document that fits whole.

All is DataFrame operations. The prefix of a leaf is found digit by digit of the order's hash, from sums over 256 values a leaf, so
that no leaf's documents are ever sorted in one place; only those that share the first ``LEVELS`` digits with the end of the
prefix, one in 16 million, are ordered. The hash is of id and text, so that rows of one id, or of none, spread as well.

Rows equal in id, text and leaf are interchangeable: they go through the mixture as one row with their number for each input partition, so that a group of equal rows is
neither sorted nor written by one task, and where a prefix ends among them, as many are taken as fit.

Weights that are missing are 1; nulls in domain, lang or source are a value of their own, ``(none)``. Null and empty texts count one
token. Repeated rows count each, rows without an id as well. A total over what all epochs hold is cut down to that. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, running

LEVELS = 3
NONE = "(none)"
TREE = ("domain", "lang", "source")


def estimated_tokens(text: str = "text") -> Column:
    """Four bytes to a token, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def divided(nodes: DataFrame, parent: list[str], child: str, budget: str, capacity: str, weight: str) -> DataFrame:
    """``nodes`` with ``share``: the budget of the parent divided by weight, no child over its capacity. Children are taken in the
    order of capacity to weight; as long as one cannot take its part of what is left, it gets all it holds."""
    # few rows: one for each node of the tree
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = of.orderBy(F.col(capacity) / F.col(weight), child)
    wide = "decimal(38,0)"
    cap, w = F.col(capacity).cast(wide), F.col(weight).cast(wide)
    before = F.coalesce(F.sum(F.col(capacity)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum(F.col(weight)).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = nodes.withColumn("full_", cap * ahead <= (F.col(budget) - before) * w)
    given = F.coalesce(F.sum(F.when(F.col("full_"), F.col(capacity))).over(of), F.lit(0))
    open_ = F.sum(F.when(~F.col("full_"), F.col(weight))).over(of)
    out = full.withColumn("given_", given).withColumn("open_", open_)
    part = F.expr(f"cast((cast(`{budget}` - given_ as decimal(19,0)) * cast(`{weight}` as decimal(19,0))) div open_ as long)")
    return out.withColumn("share", F.when(F.col("full_"), F.col(capacity)).otherwise(part)).drop("full_", "given_", "open_")


def budgets(leaves: DataFrame, total: int, epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, supply and weights w_domain, w_lang, w_source) with their budget."""
    capacity = leaves.withColumn("cap", F.col("supply") * epochs)
    langs = capacity.groupBy("domain", "lang").agg(F.sum("cap").alias("lang_cap"), F.max("w_lang").alias("w_lang"), F.max("w_domain").alias("w_domain"))
    domains = langs.groupBy("domain").agg(F.sum("lang_cap").alias("domain_cap"), F.max("w_domain").alias("w_domain"))
    whole = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("total", F.least(F.lit(total).cast("long"), F.sum("domain_cap").over(whole)))
    domains = divided(domains, [], "domain", "total", "domain_cap", "w_domain").select("domain", F.col("share").alias("domain_budget"))
    langs = divided(langs.join(domains, "domain"), ["domain"], "lang", "domain_budget", "lang_cap", "w_lang").select("domain", "lang", F.col("share").alias("lang_budget"))
    out = divided(capacity.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", "lang_budget", "cap", "w_source")
    return out.withColumnRenamed("share", "budget").drop("cap", "lang_budget")


def same_text(docs: DataFrame, text: str) -> Column:
    """Tells rows of equal or null ids apart."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))) if text in docs.columns else F.lit("")


def node(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE))


def chosen(docs: DataFrame, weights: dict[str, dict[str, int]], total: int | float, epochs: int, seed: int, domain: Column | None, tokens: Column | None, text: str, doc_id: str) -> DataFrame:
    """``doc_id, same, domain, lang, source, n_tokens, epoch, times, copies``: of equal rows of one input partition, ``copies`` in number, so many are taken in an epoch."""
    base = docs.select(
        F.col(doc_id), node(F.col("domain") if domain is None else domain).alias("domain"), node(F.col("lang")).alias("lang"), node(F.col("source")).alias("source"),
        (estimated_tokens(text) if tokens is None else tokens.cast("long")).alias("n_tokens"), same_text(docs, text).alias("same"), F.spark_partition_id().alias("part"),
    )
    base = cut(base.groupBy(*base.columns).agg(F.count("*").alias("copies")))
    leaves = base.groupBy(*TREE).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("supply"))
    for level in TREE:
        weight = F.lit(None).cast("long")
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, F.lit(w).cast("long")).otherwise(weight)
        leaves = leaves.withColumn(f"w_{level}", F.coalesce(weight, F.lit(1).cast("long")))
    leaves = cut(leaves)
    if isinstance(total, float):
        total = int((leaves.agg(F.sum("supply")).first()[0] or 0) * total)
    budgeted = cut(budgets(leaves, total, epochs))
    plan = budgeted.select(*TREE, F.floor(F.col("budget") / F.col("supply")).cast("int").alias("whole"), F.expr("budget % supply").alias("rest"))
    return taken(base, plan, seed, doc_id)


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], total: int | float, epochs: int = 1, seed: int = 0, domain: Column | None = None, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: one row for each time a document is taken.

    ``weights`` has the weights of ``domain``, ``lang`` and ``source`` values; ``total`` is a number of tokens or, as a float, a
    share of all there are. ``domain`` is an expression, by default the column of that name.
    """
    found = chosen(docs, weights, total, epochs, seed, domain, tokens, text, doc_id)
    return found.select(doc_id, *TREE, "n_tokens", "epoch", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def mix_rows(docs: DataFrame, weights: dict[str, dict[str, int]], total: int | float, seed: int = 0, domain: Column | None = None, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``mix`` takes in one epoch. Of rows equal in id, text and leaf as many stay as the mixture takes, in the
    order of a hash of all their columns."""
    found = chosen(docs, weights, total, 1, seed, domain, tokens, text, doc_id)
    # an epoch that is taken whole counts as epoch 0, as does a prefix of it
    all_ = docs.select(F.col(doc_id).alias("id_"), same_text(docs, text).alias("same_"), node(F.col("lang")).alias("lang_"), node(F.col("source")).alias("source_"), node(F.col("domain") if domain is None else domain).alias("domain_"), F.struct(*docs.columns).alias("row_"))
    sums = found.groupBy(doc_id, "same", *TREE).agg(F.sum("times").alias("times"), F.sum("copies").alias("copies"))
    sums = cut(sums.withColumnRenamed(doc_id, "taken_id").where("times > 0"))
    key = F.col("id_").eqNullSafe(F.col("taken_id")) & (F.col("same_") == F.col("same")) & (F.col("lang_") == F.col("lang")) & (F.col("source_") == F.col("source")) & (F.col("domain_") == F.col("domain"))
    met = all_.join(sums, key).withColumn("part_of", F.col("times") < F.col("copies"))
    some = met.where("part_of").select("row_", "times", F.xxhash64("id_", "same_", "lang_", "source_", "domain_").alias("class_"), F.to_json("row_").alias("order_"), F.lit(1).cast("long").alias("one_"))
    first = running(some, "class_", [F.xxhash64("order_").alias("place_")], F.sum, ["one_"], lambda a, b: a + b).where("one__before < times")
    return met.where("NOT part_of").select("row_.*").unionByName(first.select("row_.*"))


def order_key(seed: int, epoch: Column, doc_id: str) -> Column:
    """48 bits of a seeded hash of id and text, as a number."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "same")
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def taken(base: DataFrame, plan: DataFrame, seed: int, doc_id: str) -> DataFrame:
    # leaves are few, but how few is not known here: Spark chooses the join by the table's size
    placed = cut(base.join(plan, [*TREE]).withColumn("key", order_key(seed, F.col("whole"), doc_id)).withColumn("all", F.col("n_tokens") * F.col("copies")))
    cols = [doc_id, "same", *TREE, "n_tokens"]
    now = F.col("whole").alias("epoch")
    repeats = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*cols, "epoch", F.col("copies").alias("times"), "copies")
    left = placed.where("rest > 0").withColumn("room", F.col("rest"))
    found = []
    leaf = Window.partitionBy(*TREE).orderBy("digit")
    for level in range(LEVELS):
        left = left.withColumn("digit", F.shiftright("key", 40 - 8 * level).bitwiseAND(F.lit(255)))
        sums = left.groupBy(*TREE, "digit").agg(F.sum("all").alias("n"), F.max("room").alias("room"))
        upto = sums.withColumn("upto", F.sum("n").over(leaf))
        # the digit in which the prefix ends, and the room left for it
        end = upto.where(F.col("upto") > F.col("room")).groupBy(*TREE).agg(F.min("digit").alias("end"), F.min_by("upto", "digit").alias("upto"), F.min_by("n", "digit").alias("n"))
        end = cut(end.select(*TREE, "end", (F.col("upto") - F.col("n")).alias("used")))
        tied = left.join(end, [*TREE])
        found.append(tied.where(F.col("digit") < F.col("end")).select(*cols, now, F.col("copies").alias("times"), "copies"))
        left = tied.where(F.col("digit") == F.col("end")).withColumn("room", F.col("room") - F.col("used")).drop("end", "used", "digit")
    last = Window.partitionBy(*TREE).orderBy("key", doc_id, "n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("fit", F.floor((F.col("room") - F.coalesce(F.sum("all").over(last), F.lit(0))) / F.col("n_tokens")))
    found.append(left.where("fit > 0").select(*cols, now, F.least("fit", "copies").alias("times"), "copies"))
    out = repeats
    for part in found:
        out = out.unionByName(part)
    return out


#: The mixture of the query: a domain is told by a hash of the source's name.
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
TOTAL, EPOCHS, SEED = 0.8, 2, 7


def domain_of_source() -> Column:
    return F.when(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 1).isin(*"01234567"), "web").otherwise("books")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, WEIGHTS, TOTAL, EPOCHS, SEED, domain_of_source())


def level_sql(name: str, source: str, parent: str, child: str, budget: str, cap: str, weight: str) -> str:
    of = f"PARTITION BY {parent}" if parent else ""
    order = f"{of} ORDER BY CAST({cap} AS DOUBLE) / {weight}, {child}"
    return f"""{name}_a AS (SELECT *, coalesce(sum({cap}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead_ FROM {source}),
{name}_b AS (SELECT *, {cap}::HUGEINT * ahead_ <= ({budget} - before_)::HUGEINT * {weight} AS full_ FROM {name}_a),
{name}_c AS (SELECT *, coalesce(sum({cap}) FILTER (WHERE full_) OVER ({of}), 0) AS given_, sum({weight}) FILTER (WHERE NOT full_) OVER ({of}) AS open_ FROM {name}_b),
{name} AS (SELECT *, CASE WHEN full_ THEN {cap}::HUGEINT ELSE (({budget} - given_)::HUGEINT * {weight}) // open_::HUGEINT END AS share FROM {name}_c)"""


def oracle() -> str:
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if WEIGHTS.get(level) else "1"
    drop = "EXCLUDE (before_, ahead_, full_, given_, open_)"
    return f"""WITH base AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) IN ('0','1','2','3','4','5','6','7') THEN 'web' ELSE 'books' END AS domain,
  coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, md5(coalesce(text, '')) AS same, greatest(1, CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT)) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, sum(n_tokens)::HUGEINT * {EPOCHS} AS cap, {case("lang")} AS w_lang, {case("domain")} AS w_domain, {case("source")} AS w_source FROM base GROUP BY ALL),
lang_n AS (SELECT domain, lang, sum(cap)::HUGEINT AS lang_cap, max(w_lang) AS w_lang, max(w_domain) AS w_domain FROM leaf GROUP BY ALL),
dom_n AS (SELECT domain, sum(lang_cap)::HUGEINT AS domain_cap, max(w_domain) AS w_domain, (SELECT least(CAST(floor(sum(supply)::DOUBLE * {TOTAL}) AS HUGEINT), sum(cap)::HUGEINT) FROM leaf) AS total FROM lang_n GROUP BY domain),
{level_sql("dom", "dom_n", "", "domain", "total", "domain_cap", "w_domain")},
lang_m AS (SELECT l.*, d.share AS domain_budget FROM lang_n l JOIN dom d USING (domain)),
{level_sql("lng", "lang_m", "domain", "lang", "domain_budget", "lang_cap", "w_lang")},
leaf_m AS (SELECT f.*, l.share AS lang_budget FROM leaf f JOIN lng l USING (domain, lang)),
{level_sql("lf", "leaf_m", "domain, lang", "source", "lang_budget", "cap", "w_source")},
plan AS (SELECT domain, lang, source, CAST(share // supply AS INTEGER) AS whole, share % supply AS rest FROM lf),
placed AS (SELECT b.*, whole, rest, substr(md5('{SEED}|' || whole || '|' || doc_id || '|' || same), 1, 12) AS key FROM base b JOIN plan USING (domain, lang, source)),
prefix AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e.epoch AS INTEGER) AS epoch FROM placed, range(0, {EPOCHS}) e(epoch) WHERE e.epoch < whole
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch FROM prefix WHERE upto <= rest AND rest > 0"""
