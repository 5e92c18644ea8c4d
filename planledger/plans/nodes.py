"""Plan documents to nodes, and the measures taken from them.

Two shapes of plan log are served. *Documents* hold one plan per row (read by
``sources.plans``); everything per plan is then computed inside the row. *Node tables* hold
one node per row; there the same measures are aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import let

# Fixed list: node field, its JSON name, its type.
NODE_FIELDS = (
    ("node_type", "Node Type", "string"),
    ("operation", "Operation", "string"),
    ("strategy", "Strategy", "string"),
    ("partial_mode", "Partial Mode", "string"),
    ("parallel_aware", "Parallel Aware", "string"),
    ("join_type", "Join Type", "string"),
    ("parent_relationship", "Parent Relationship", "string"),
    ("subplan_name", "Subplan Name", "string"),
    ("scan_direction", "Scan Direction", "string"),
    ("index_name", "Index Name", "string"),
    ("relation_name", "Relation Name", "string"),
    ("alias", "Alias", "string"),
    ("startup_cost", "Startup Cost", "double"),
    ("total_cost", "Total Cost", "double"),
    ("plan_rows", "Plan Rows", "bigint"),
    ("plan_width", "Plan Width", "bigint"),
    ("recheck_cond", "Recheck Cond", "string"),
    ("hash_cond", "Hash Cond", "string"),
    ("group_key", "Group Key", "array<string>"),
    ("sort_key", "Sort Key", "array<string>"),
    ("sort_method", "Sort Method", "string"),
    ("sort_space_used", "Sort Space Used", "bigint"),
    ("sort_space_type", "Sort Space Type", "string"),
    ("join_filter", "Join Filter", "string"),
    ("one_time_filter", "One-Time Filter", "string"),
    ("filter", "Filter", "string"),
    ("index_cond", "Index Cond", "string"),
    ("actual_startup_time", "Actual Startup Time", "double"),
    ("actual_total_time", "Actual Total Time", "double"),
    ("actual_rows", "Actual Rows", "bigint"),
    ("actual_loops", "Actual Loops", "bigint"),
    ("hash_buckets", "Hash Buckets", "bigint"),
    ("original_hash_buckets", "Original Hash Buckets", "bigint"),
    ("hash_batches", "Hash Batches", "bigint"),
    ("original_hash_batches", "Original Hash Batches", "bigint"),
    ("peak_memory_usage", "Peak Memory Usage", "bigint"),
    ("rows_removed_by_filter", "Rows Removed by Filter", "bigint"),
    ("rows_removed_by_join_filter", "Rows Removed by Join Filter", "bigint"),
    ("rows_removed_by_index_recheck", "Rows Removed by Index Recheck", "bigint"),
    ("heap_fetches", "Heap Fetches", "bigint"),
    ("exact_heap_blocks", "Exact Heap Blocks", "bigint"),
    ("lossy_heap_blocks", "Lossy Heap Blocks", "bigint"),
)
_FIELD = {name: (json, kind) for name, json, kind in NODE_FIELDS}

# Fixed list: node types that are never picked.
EXCLUDED = ("Nested Loop", "Aggregate")


def node_field(node: Column, name: str) -> Column:
    """One typed field of a plan node (VARIANT); null where it is absent or of another type."""
    json, kind = _FIELD[name]
    return F.try_variant_get(node, f'$["{json}"]', kind)


def _numbered(path: Column, i: Column) -> Column:
    """The path of a child: six digits, and for longer numbers a letter that tells their length and
    sorts behind all digits. So text order is number order for any number of children."""
    digits = i.cast("string")
    longer = F.concat(F.char(F.length(digits) + (ord("a") - 7)), digits)
    return F.concat(path, F.lit("."), F.when(F.length(digits) <= 6, F.lpad(digits, 6, "0")).otherwise(longer))


def _by_path(nodes: Column) -> Column:
    """Nodes in the order of their paths; sorts (path, place), so only plain text is compared."""
    places = F.array_sort(F.transform(nodes, lambda n, i: F.struct(n["path"].alias("path"), i.alias("i"))))
    return F.transform(places, lambda p: F.get(nodes, p["i"]))


#: Levels of a plan that one conversion reads; the fold walks on below them, however deep a plan is.
READ_LEVELS = 6


def _kind(fields: Sequence[str], below: int) -> str:
    """The type of a node with ``fields`` and, as far as ``below`` levels, of its subplans."""
    plans = _kind(fields, below - 1) if below else "variant"
    return "struct<" + "".join(f"`{_FIELD[f][0]}`:{_FIELD[f][1]}," for f in fields) + f"`Plans`:array<{plans}>>"


def tree(plan: Column, levels: Column, fields: Sequence[str] | None = None) -> Column:
    """All nodes of a plan in pre-order: array of (path, depth, node).

    ``node`` is the VARIANT subtree, or with ``fields`` a struct of those typed fields (under their JSON
    names). Then one conversion reads the upper levels of a plan, and only what lies below them is walked
    as VARIANT: to hand out a subtree is to copy it. That walk is a fold over the levels of the tree;
    ``levels`` is any upper bound of its depth, so no plan is cut. Paths are zero-padded child numbers.
    """
    if fields is None:
        return F.when(plan.isNotNull(), _fold(plan, F.lit("000000"), 0, levels))

    def walk(node: Column, path: Column, depth: int) -> Column:
        own = F.array(F.struct(path.alias("path"), F.lit(depth).alias("depth"), _own(node, fields).alias("node")))

        def below(child: Column, i: Column) -> Column:
            if depth < READ_LEVELS:
                return let(_numbered(path, i), lambda p: walk(child, p, depth + 1))
            return _fold(child, _numbered(path, i), depth + 1, levels, fields)

        return F.when(F.coalesce(F.size(node["Plans"]), F.lit(0)) <= 0, own).otherwise(F.concat(own, F.flatten(F.transform(node["Plans"], below))))

    root = F.try_variant_get(plan, "$", _kind(fields, READ_LEVELS))
    return F.when(plan.isNotNull(), let(root, lambda node: walk(node, F.lit("000000"), 0)))


def _own(node: Column, fields: Sequence[str]) -> Column:
    """The fields of a node without its subplans."""
    if not fields:
        return F.struct(F.lit(None).cast("string").alias("none"))
    return F.struct(*[node[_FIELD[f][0]].alias(_FIELD[f][0]) for f in fields])


def _fold(plan: Column, path: Column, depth: int, levels: Column, fields: Sequence[str] | None = None) -> Column:
    """:func:`tree` level by level, for a subtree that has this path and depth."""
    kind = "variant" if fields is None else _kind(fields, 0)
    rows = f"array<struct<path:string,depth:int,node:{kind}>>"

    def read(node: Column) -> Column:
        return node if fields is None else F.try_variant_get(node, "$", kind)

    def subplans(node: Column) -> Column:
        found = F.try_variant_get(node, "$.Plans", "array<variant>") if fields is None else node["Plans"]
        return F.coalesce(found, F.expr("cast(array() as array<variant>)"))

    root = F.struct(path.alias("path"), F.lit(depth).alias("depth"), read(plan).alias("node"))
    start = F.struct(F.expr(f"cast(array() as {rows})").alias("done"), F.array(root).cast(rows).alias("front"))

    def children(parent: Column) -> Column:
        return F.transform(
            subplans(parent["node"]),
            lambda child, i: F.struct(
                _numbered(parent["path"], i).alias("path"), (parent["depth"] + 1).alias("depth"), read(child).alias("node")
            ),
        )

    def step(acc: Column, _level: Column) -> Column:
        below = F.flatten(F.transform(acc["front"], children))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(
            F.struct(F.concat(acc["done"], acc["front"]).alias("done"), below.alias("front"))
        )

    folded = F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda acc: _by_path(acc["done"]))
    if fields is None:
        return folded
    return F.transform(folded, lambda n: F.struct(n["path"].alias("path"), n["depth"].alias("depth"), _own(n["node"], fields).alias("node")))


def _positions(plans: DataFrame, nodes: Column) -> DataFrame:
    """One row per node: kept columns, node_ord and the node as ``_n``."""
    kept = [c for c in plans.columns if c not in ("plan", "levels")]
    # The null test follows the explosion: before it, the optimizer would parse each document twice.
    return plans.select(*kept, F.posexplode_outer(nodes).alias("node_ord", "_n")).filter("_n is not null")


def _place() -> list[Column]:
    parent = F.expr("nullif(substring_index(_n.path, '.', _n.depth), '')")
    return [F.col("_n.path").alias("path"), parent.alias("parent_path"), F.col("_n.depth").alias("depth"), F.col("node_ord")]


def flatten_plan(plans: DataFrame) -> DataFrame:
    """One row per plan node, each node once: path, parent_path, depth, node_ord, node (VARIANT)."""
    kept = [c for c in plans.columns if c not in ("plan", "levels")]
    rows = _positions(plans, tree(F.col("plan"), F.col("levels")))
    return rows.select(*kept, *_place(), F.col("_n.node").alias("node"))


def plan_nodes(plans: DataFrame, fields: Sequence[str] = tuple(_FIELD)) -> DataFrame:
    """One row per plan node with the typed ``fields`` as columns."""
    kept = [c for c in plans.columns if c not in ("plan", "levels")]
    rows = _positions(plans, tree(F.col("plan"), F.col("levels"), fields))
    return rows.select(*kept, *_place(), *[F.col("_n.node").getField(_FIELD[f][0]).alias(f) for f in fields])


def condition_clause(nodes: DataFrame) -> DataFrame:
    """Adds ``condition``: filter, else recheck condition; never the index condition."""
    return nodes.withColumn("condition", F.coalesce("filter", "recheck_cond"))


def _pick(nodes: DataFrame, value: str, exclude: Sequence[str], keep: Sequence[str], order: str) -> DataFrame:
    usable = F.col("total_cost").isNotNull() & F.col(value).isNotNull()
    if exclude:
        usable = usable & ~F.coalesce(F.col("node_type").isin(*exclude), F.lit(False))
    best = F.min_by(
        F.struct(F.col(value).alias("value"), *keep), F.when(usable, F.struct((-F.col(value)).alias("v"), F.col(order)))
    )
    return (
        nodes.groupBy("plan_id")
        .agg(best.alias("_best"))
        .select("plan_id", F.coalesce("_best.value", F.lit(0.0)).alias("value"), *[F.col(f"_best.{k}").alias(k) for k in keep])
    )


def costliest_node(
    nodes: DataFrame, exclude: Sequence[str] = EXCLUDED, keep: Sequence[str] = ("node_type", "relation_name"), order: str = "node_ord"
) -> DataFrame:
    """Per plan the node of highest total cost; ties go to the first in pre-order.

    Excluded types and nodes without cost are passed over. A plan without a usable node gives
    value 0 and null columns.
    """
    return _pick(nodes, "total_cost", exclude, keep, order)


def slowest_node(
    nodes: DataFrame, exclude: Sequence[str] = EXCLUDED, keep: Sequence[str] = ("node_type", "relation_name"), order: str = "node_ord"
) -> DataFrame:
    """Per plan the node of highest actual time among those with a cost; null times are ignored."""
    return _pick(nodes, "actual_total_time", exclude, keep, order)


def node_picks(nodes: DataFrame, exclude: Sequence[str] = EXCLUDED, order: str = "node_ord") -> DataFrame:
    """Both picks of every plan in one aggregation: ``costliest`` and ``slowest`` as (table_name, condition)."""
    usable = F.col("total_cost").isNotNull() & ~F.coalesce(F.col("node_type").isin(*exclude), F.lit(False))
    what = F.struct(F.col("relation_name").alias("table_name"), F.coalesce("filter", "recheck_cond").alias("condition"))

    def best(value: str) -> Column:
        return F.min_by(what, F.when(usable & F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(order))))

    return nodes.groupBy("plan_id").agg(best("total_cost").alias("costliest"), best("actual_total_time").alias("slowest"))


def document_picks(plans: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """Picks and root measures of plan documents, computed inside each row: no shuffle.

    Keeps the columns of ``plans`` except the document, and adds ``costliest``, ``slowest``,
    ``total_cost``, ``startup_cost`` and ``seq_scan_times``.
    """
    kept = [c for c in plans.columns if c not in ("plan", "levels")]
    wanted = ("node_type", "relation_name", "total_cost", "startup_cost", "actual_total_time", "filter", "recheck_cond")

    def of(n: Column, field: str) -> Column:
        return n["node"].getField(_FIELD[field][0])

    def usable(n: Column) -> Column:
        return of(n, "total_cost").isNotNull() & ~F.coalesce(of(n, "node_type").isin(*exclude), F.lit(False))

    def best(nodes: Column, value: str) -> Column:
        # Nodes are in pre-order, so the smallest (-value, place) is the pick.
        ranked = F.transform(nodes, lambda n, i: F.when(usable(n) & of(n, value).isNotNull(), F.struct((-of(n, value)).alias("v"), i.alias("i"))))
        pick = F.get(nodes, F.array_min(ranked)["i"])
        what = lambda n: F.struct(of(n, "relation_name").alias("table_name"), F.coalesce(of(n, "filter"), of(n, "recheck_cond")).alias("condition"))
        return let(pick, lambda n: F.when(n.isNotNull(), what(n)))

    def measures(nodes: Column) -> Column:
        root = F.get(nodes, F.lit(0))
        near = F.filter(nodes, lambda n: (n["depth"] <= 1) & (of(n, "node_type") == "Seq Scan") & of(n, "actual_total_time").isNotNull())
        return F.struct(
            best(nodes, "total_cost").alias("costliest"),
            best(nodes, "actual_total_time").alias("slowest"),
            of(root, "total_cost").alias("total_cost"),
            of(root, "startup_cost").alias("startup_cost"),
            F.when(of(root, "actual_total_time").isNotNull(), F.transform(near, lambda n: of(n, "actual_total_time"))).alias("seq_scan_times"),
        )

    # Only the measures leave the expression. One row per document; unreadable ones are dropped after the
    # explosion, as in flatten_plan.
    walked = tree(F.col("plan"), F.col("levels"), wanted)
    found = F.when(F.col("plan").isNotNull(), let(walked, measures))
    rows = plans.select(*kept, F.explode_outer(F.array(found)).alias("_m")).filter("_m is not null")
    return rows.select(*kept, "_m.costliest", "_m.slowest", "_m.total_cost", "_m.startup_cost", "_m.seq_scan_times")


def mysql_picks(plans: DataFrame) -> DataFrame:
    """MySQL: both picks are the query block, its only score the block's total time."""
    kept = [c for c in plans.columns if c != "query_block"]
    block = F.col("query_block")
    what = F.struct(
        block["table"]["table_name"].alias("table_name"), block["table"]["attached_condition"].alias("condition")
    )
    return plans.filter("query_block is not null").select(
        *kept, what.alias("costliest"), what.alias("slowest"), block["r_total_time_ms"].alias("execution_time")
    )


def seq_scans(nodes: DataFrame) -> DataFrame:
    """(plan_id, score) for a sequential scan at the root or directly below it.

    The root must have an actual time. A scan without a time gives no row.
    """
    timed = nodes.filter("depth = 0 and actual_total_time is not null").select("plan_id")
    scans = nodes.filter("depth <= 1 and node_type = 'Seq Scan' and actual_total_time is not null")
    return scans.join(timed, "plan_id", "left_semi").select("plan_id", F.col("actual_total_time").alias("score"))


def root_metrics(plans: DataFrame, metrics: Sequence[str] = ("total_cost", "startup_cost", "total_runtime", "execution_time")) -> DataFrame:
    """(plan_id, metric, score) of the plan-level measures that are present."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics if m in plans.columns])
    return plans.select("plan_id", F.explode(pairs).alias("_m")).select("plan_id", "_m.*").filter("score is not null")


def latest_plan(plans: DataFrame, order: str) -> DataFrame:
    """One plan per statement text: the one that arrived last."""
    rest = [c for c in plans.columns if c != "final_text"]
    return plans.groupBy("final_text").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_p")).select("final_text", "_p.*")
