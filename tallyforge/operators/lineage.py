"""Lineage: plans by column, reconstruction of a field's path, and checks of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled

#: The stages of a column's way from file to movement, with the type before and after.
STAGES = (("extract", "bytes", "text"), ("normalise", "text", "text"), ("parse", "text", "typed"), ("map", "typed", "typed"), ("derive", "typed", "typed"), ("publish", "typed", "canonical"))


def plan_of(fields: DataFrame, config: str) -> DataFrame:
    """Six steps for each of the different fields (field): by column, not by row, so that a plan is small."""
    steps = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(stage).alias("operation"), F.lit(x).alias("input_type"), F.lit(y).alias("output_type")) for n, (stage, x, y) in enumerate(STAGES, 1)])
    rows = fields.select("field").distinct().select("field", F.inline(steps))
    return rows.withColumn("config_digest", F.sha2(F.concat_ws("|", F.lit(config), "field", "operation"), 256))


def plan(spark, fields: list[str], config: str) -> DataFrame:
    return plan_of(spark.createDataFrame([(f,) for f in fields], "field string"), config)


def plan_problems(steps: DataFrame) -> DataFrame:
    """Fields whose steps are not all there, not in order, or do not fit each other's types."""
    w = Window.partitionBy("field").orderBy("stage")
    chained = steps.withColumn("fits", F.coalesce(F.lead("input_type").over(w) == F.col("output_type"), F.lit(True)))
    by = chained.groupBy("field").agg(F.sort_array(F.collect_set("stage")).alias("stages"), F.count("*").alias("n"), F.bool_and("fits").alias("fits"))
    expected = F.array(*[F.lit(k) for k in range(1, len(STAGES) + 1)])
    why = F.when((F.col("stages") != expected) | (F.col("n") != len(STAGES)), "stages_incomplete").when(~F.col("fits"), "types_do_not_chain")
    return by.select("field", why.alias("problem")).where("problem IS NOT NULL")


def paths(rows: DataFrame, steps: DataFrame, overrides: DataFrame) -> DataFrame:
    """``row_id, field, place, operation, value``: each row's way for each field, overrides after the plan's step of their stage."""
    walked = rows.join(F.broadcast(steps), "field").select("row_id", "field", "stage", F.lit(0).alias("is_override"), "operation", F.lit(None).cast("string").alias("value"))
    over = overrides.join(rows, ["row_id", "field"], "left_semi").select("row_id", "field", "stage", F.lit(1).alias("is_override"), F.lit("override").alias("operation"), "value")
    place = F.row_number().over(Window.partitionBy("row_id", "field").orderBy("stage", "is_override"))
    return walked.unionByName(over).withColumn("place", place).select("row_id", "field", "place", "operation", "value")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no node."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return ends.join(nodes, "node_id", "left_anti")


#: Rounds after which the ways through nodes of one successor are doubled.
SHALLOW = 8


def doubled(hop: DataFrame) -> DataFrame:
    """``node, next, away, low``: walks of the same kind twice as long. ``low`` is the smallest node that a walk comes to; walks end where no step goes on, and
    where they have come to a cycle that has been walked through: its smallest node is then the lowest of its own walk."""
    closed = hop.where("low = node").select("low")
    inside = hop.join(closed, "low", "left_semi").select(F.col("node").alias("next"))
    then = hop.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("away").alias("more"), F.col("low").alias("lower"))
    far = hop.join(then, "next").join(inside, "next", "left_anti")
    return settled(far.select("node", F.col("then").alias("next"), (F.col("away") + F.col("more")).alias("away"), F.least("low", "lower").alias("low")))


def leaps(step: DataFrame) -> DataFrame:
    """``node, next`` at distances 2, 4, 8 and so on along nodes that have one successor each, besides the steps themselves."""
    one = step.groupBy("node").agg(F.count("*").alias("n"), F.min("next").alias("next")).where("n = 1")
    hop, out = settled(one.select("node", "next", F.lit(1).cast("long").alias("away"), F.col("next").alias("low"))), None
    while not (hop := doubled(hop)).isEmpty():
        out = hop.select("node", "next") if out is None else out.unionByName(hop.select("node", "next"))
    return step if out is None else settled(step.unionByName(out).distinct())


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node``: what can be reached along edges. Round by round only new pairs go on, until a round finds none; so cycles end.
    In graphs that go deep, a round also leaps along ways without branches, so that a chain takes rounds with the logarithm of its length.

    The first rounds find the steps out of their nodes before any pair moves: where there are none, the walk ends. Pairs at nodes that nobody came to before are all new; only the others are
    compared with what is known."""
    # edges may repeat, as pairs are made distinct when they are found
    step = settled(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")))
    seen = front = settled(starts.select("start", F.col("start").alias("node")).distinct())
    nodes = known = front.select("node")
    for _ in range(SHALLOW):
        onward = settled(step.join(nodes, "node", "left_semi"))
        if onward.isEmpty():
            return seen
        ahead = settled(onward.select(F.col("next").alias("node")).distinct().join(known.withColumn("old", F.lit(True)), "node", "left"))
        found = front.join(onward, "node").select("start", F.col("next").alias("node")).distinct()
        again = ahead.where("old").select("node")
        if again.isEmpty():
            front, nodes = settled(found), ahead.select("node")
        else:
            front = settled(found.join(seen.join(again, "node", "left_semi"), ["start", "node"], "left_anti"))
            nodes = front.select("node").distinct()
        # every part is written; a union of them is no work of its own
        known, seen = known.unionByName(ahead.where("old IS NULL").select("node")), seen.unionByName(front)
    if front.isEmpty():
        return seen
    # all that is known leaps once, what is new from then on when it is found
    step, front = leaps(settled(step.distinct())), seen
    while not front.isEmpty():
        found = front.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        front = settled(found.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


#: Spark's bound on the rows of a recursive query, a million where nothing is set, and the value that lifts it.
ROW_LIMIT, NO_LIMIT = "spark.sql.cteRecursionRowLimit", "-1"


def reachable_sql(spark, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The same by a recursive query, for graphs without cycles and few ways between two nodes, as every way is walked. Spark ends a
    walk that goes deeper than its recursion limit with an error, so that no result is cut short; the number of rows has no limit.
    The limit of rows counts when the query runs, so that it runs here and the session keeps its own setting."""
    # each round reads the edges
    settled(edges.select("from_id", "to_id")).createOrReplaceTempView("lineage_edges_")
    settled(starts.select("start")).createOrReplaceTempView("lineage_starts_")
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, NO_LIMIT)
    try:
        return settled(spark.sql("""WITH RECURSIVE walk(start, node) AS (
        SELECT start, start FROM lineage_starts_ UNION ALL
        SELECT w.start, e.to_id FROM walk w JOIN lineage_edges_ e ON e.from_id = w.node)
        SELECT DISTINCT start, node FROM walk"""))
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def chains(edges: DataFrame) -> DataFrame:
    """``node, head, away, low``: the inner nodes of chains with the node that theirs begins at and how far they are from it.

    Inner nodes have one predecessor and one successor. Their ways back are doubled in each round. Those of a cycle of inner nodes alone come to no head; their head is null
    and ``low`` the cycle's smallest node, as all of its ways are of one length and have gone round."""
    into = edges.groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("n_in"), F.min("from_id").alias("head"))
    out = edges.groupBy(F.col("from_id").alias("node")).agg(F.count("*").alias("n_out"))
    inner = settled(into.join(out, "node").where("n_in = 1 AND n_out = 1").select("node", "head", F.lit(1).cast("long").alias("away"), F.col("head").alias("low")))
    back = inner
    while not back.isEmpty():
        then = back.select(F.col("node").alias("head"), F.col("head").alias("before"), F.col("away").alias("more"), F.col("low").alias("lower"))
        far = settled(back.join(then, "head", "left").select("node", F.coalesce("before", "head").alias("head"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away"), F.least("low", F.coalesce("lower", "low")).alias("low"), F.col("before").isNotNull().alias("moved")))
        back = far.drop("moved")
        # a cycle has been walked through when its smallest node is the lowest of its own way
        round_ = far.join(far.where("low = node").select("low"), "low", "left_semi").select("node")
        if far.where("moved").join(round_, "node", "left_anti").isEmpty():
            break
    heads = inner.select(F.col("node").alias("head"), F.lit(True).alias("loops"))
    return settled(back.join(heads, "head", "left").select("node", F.when(F.col("loops").isNull(), F.col("head")).alias("head"), "away", "low"))


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``from_id, to_id, weight``, ``node, head, away, low``): chains as one edge each, and their inner nodes as ``chains`` tells them."""
    back = chains(edges)
    ends = edges.join(back.select(F.col("node").alias("to_id")), "to_id", "left_anti")
    placed = ends.join(back.withColumnRenamed("node", "from_id"), "from_id", "left")
    short = placed.select(F.coalesce("head", "from_id").alias("from_id"), "to_id", (F.coalesce("away", F.lit(0)) + 1).alias("weight"))
    return settled(short.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"))), back


#: Edges that one task makes distinct, or one of their ends.
BLOCK = 1 << 19


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows``, of which there are at most ``n``, in tasks of about BLOCK, so that making them distinct takes no more memory as they grow."""
    return rows.repartition(n // BLOCK + 1, *by) if n > BLOCK else rows


def different(edges: DataFrame, n: int, end: str, other: str) -> DataFrame:
    """``node``: the different nodes at one end of ``n`` edges. Those of a node that has many go to several tasks."""
    rows = edges.select(F.col(end).alias("node"), F.pmod(F.xxhash64(other), F.lit(64)).cast("int").alias("share"))
    return dealt(rows, n, "node", "share").select("node").distinct()


def peeled(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, level`` in topological order, the level being the longest way from a node without predecessors; nodes of cycles, and those behind them, have no level.
    Without ``nodes`` these are the ends of the edges.

    A round takes the nodes that no edge leads to and the edges out of them. When it leaves over half of the edges, chains count as one edge from then on, so that the rounds
    are those of the graph's branches and not of its depth."""
    held = edges.select("from_id", "to_id")
    if nodes is not None:
        left = settled(nodes.select("node").distinct())
        # an edge from what is no node holds nobody
        held = held.join(left.select(F.col("node").alias("from_id")), "from_id", "left_semi")
    # edges may repeat, so that only those that a round leaves are made distinct
    held = settled(held)
    out, rounds, more, size = None, 0, held.count(), 0
    if nodes is None:
        # all others are behind an edge
        left = different(held, more, "from_id", "to_id")
    while out is None or 0 < 2 * more <= size:
        behind = settled(different(held.where("to_id IS NOT NULL"), more, "to_id", "from_id"))
        free = left.join(behind, "node", "left_anti").select("node", F.lit(rounds).cast("long").alias("level"))
        out = free if out is None else out.unionByName(free)
        left = behind if nodes is None else settled(left.join(behind, "node", "left_semi"))
        on = held.join(behind.select(F.col("node").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id")
        held = settled(dealt(on, more, "from_id", "to_id").distinct())
        rounds, size, more = rounds + 1, more, held.count()
    # what is left stands at least so far
    left = left.withColumn("level", F.lit(rounds).cast("long"))
    rest = left if more == 0 else peeled_by_chains(held, left)
    return out.unionByName(rest).withColumn("level", F.col("level").cast("int"))


def peeled_by_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level`` of nodes (node, level) that stand at least at their level, all edges being different and from one of them. Chains count as one edge."""
    held, inner = contracted(edges)
    left = settled(nodes.join(inner.select("node"), "node", "left_anti").select("node", "level"))
    out = None
    while not held.isEmpty():
        waiting = held.select(F.col("to_id").alias("node")).distinct()
        free = settled(left.join(waiting, "node", "left_anti"))
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        # nodes behind those that are placed stand at least so far; their edges hold nobody any more
        gone = free.select(F.col("node").alias("from_id"), F.col("level").alias("at"))
        reach = held.join(gone, "from_id").groupBy(F.col("to_id").alias("node")).agg(F.max(F.col("at") + F.col("weight")).alias("least"))
        left = settled(left.join(free.select("node"), "node", "left_anti").join(reach, "node", "left").select("node", F.greatest("level", F.coalesce("least", F.lit(0))).alias("level")))
        held = settled(held.join(gone, "from_id", "left_anti"))
    # where no edge is left, nobody is held; otherwise the others are stuck
    last = left if held.isEmpty() else left.select("node", F.lit(None).cast("long").alias("level"))
    out = settled(last if out is None else out.unionByName(last))
    of_chain = inner.join(out.select(F.col("node").alias("head"), "level"), "head", "left").join(nodes, "node", "left_semi").select("node", (F.col("level") + F.col("away")).alias("level"))
    return out.unionByName(of_chain)


def strongly_connected(edges: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """``node, component``: the nodes that stand in a cycle, by the smallest node of those that reach each other. Nodes behind cycles, or before them, are left out.

    What no cycle reaches, or what reaches none, is peeled off from both sides; ``stuck`` has the nodes without level, where ``peeled`` has told them already.
    Cycles without branches are told by their smallest node. Then colours are sent forward: each node takes the
    largest that reaches it; those of one colour that reach its first node are a component, and what is left goes on within its colour."""
    edges = edges.select("from_id", "to_id").distinct()
    edges = settled(edges) if stuck is None else within(edges, stuck)
    loops = edges.where("from_id = to_id").select(F.col("from_id").alias("node"), F.col("from_id").alias("component"))
    left, out = edges.where("from_id <> to_id"), None
    ends = lambda e: e.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    while not left.isEmpty():
        core = left if stuck is not None else within(left, settled(peeled(left).where("level IS NULL").select("node")))
        stuck = None
        if core.isEmpty():
            break
        back = core.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        core = within(core, settled(peeled(back).where("level IS NULL").select("node")))
        round_ = chains(core).where("head IS NULL").select("node", F.col("low").alias("component"))
        out = round_ if out is None else out.unionByName(round_)
        core = settled(core.join(round_.select(F.col("node").alias("from_id")), "from_id", "left_anti"))
        if core.isEmpty():
            break
        colour = spread(core, settled(ends(core).withColumn("colour", F.col("node"))))
        at = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        own = settled(core.join(at("from_id"), "from_id").join(at("to_id"), "to_id").where("from_id_colour = to_id_colour").select("from_id", "to_id"))
        first = colour.where("node = colour").select(F.col("node").alias("start"))
        met = reachable(own.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), first)
        names = met.groupBy("start").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = settled(met.join(names, "start").select("node", "component"))
        out = out.unionByName(found)
        left = settled(within(own, own.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct().join(met.select("node"), "node", "left_anti")))
    if out is None:
        return loops.distinct()
    return out.unionByName(loops.join(out.select("node"), "node", "left_anti"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between these nodes."""
    return settled(edges.join(nodes.select(F.col("node").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("node").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id"))


def spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """``node, colour``: the largest colour that reaches each node. Ways without branches are leapt along."""
    ways = leaps(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")))
    now = changed = colours
    while not changed.isEmpty():
        sent = changed.join(ways, "node").groupBy(F.col("next").alias("node")).agg(F.max("colour").alias("new"))
        now = settled(now.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
        changed, now = now.where("moved").select("node", "colour"), now.drop("moved")
    return now


def gaps(edges: DataFrame, nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """``node_id, problem``: ends that are no node, edges between companies, nodes of cycles, those that no order can place as they stand behind a cycle, and nodes that no origin reaches.

    ``nodes`` has node_id and company_id; ``origins`` the node_ids that lineage may begin with."""
    # every problem reads them
    edges, nodes = settled(edges.select("from_id", "to_id")), settled(nodes.select("node_id", "company_id"))
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("company_id").alias(f"{end}_company"))
    crossing = edges.join(at("from_id"), "from_id").join(at("to_id"), "to_id").where("from_id_company <> to_id_company").select(F.col("to_id").alias("node_id")).distinct()
    known = within(edges.select("from_id", "to_id"), nodes.select(F.col("node_id").alias("node")))
    stuck = settled(peeled(known).where("level IS NULL").select(F.col("node").alias("node_id")))
    # an acyclic graph, as it should be, needs no search for cycles
    cyclic = stuck if stuck.isEmpty() else settled(strongly_connected(known, stuck.select(F.col("node_id").alias("node"))).select(F.col("node").alias("node_id")))
    # one start for all origins: what matters is whether any reaches a node
    begin = origins.select(F.lit("").alias("from_id"), F.col("node_id").alias("to_id"))
    met = reachable(edges.select("from_id", "to_id").unionByName(begin), edges.sparkSession.createDataFrame([("",)], "start string"))
    lost = nodes.select("node_id").join(met.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    found = {"dangling": dangling(nodes.select("node_id"), edges), "crosses_companies": crossing, "in_cycle": cyclic, "behind_cycle": stuck.join(cyclic, "node_id", "left_anti"), "no_origin": lost}
    out = None
    for problem, rows in found.items():
        part = rows.select("node_id", F.lit(problem).alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


def complete_fields(rows: DataFrame, keys: list[str], stage: str, expected: list[int]) -> DataFrame:
    """Whether the stages recorded for each field are exactly the expected ones. The set is of stages, of which there are few."""
    have = F.array_sort(F.collect_set(stage))
    return rows.groupBy(*keys).agg((have == F.array(*[F.lit(x) for x in sorted(expected)])).alias("complete"))


def input_counts(edges: DataFrame, entity: list[str], **inputs: str) -> DataFrame:
    """For each entity the number of distinct inputs of each kind."""
    return edges.groupBy(*entity).agg(*[F.countDistinct(column).alias(name) for name, column in inputs.items()])


def complete(entities: DataFrame, edges: DataFrame, needed: DataFrame) -> DataFrame:
    """Entities with whether each input that they need is among the sources of their edges, for all entities at once."""
    have = edges.select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("input_id")).distinct()
    lacking = needed.join(have, ["entity_id", "input_id"], "left_anti").groupBy("entity_id").agg(F.count("*").alias("lacking"))
    return entities.join(lacking, "entity_id", "left").select("entity_id", F.coalesce("lacking", F.lit(0)).alias("lacking"), F.col("lacking").isNull().alias("complete"))
