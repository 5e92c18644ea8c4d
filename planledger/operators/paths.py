"""Joins along association paths such as ``order.customer.nation.name``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARRAY_PREFIX
from .metadata import first_links


class PathError(ValueError):
    """A path names a field that no association or column explains."""


@dataclass(frozen=True)
class Association:
    """How a field of an entity reaches another one.

    ``to_one``: left.link_column = right.target_column. ``to_many``: left.link_column =
    right.target_column, many rows on the right. ``via_table``: left.link_column =
    join_table.join_column, then join_table.inverse_column = right.target_column.
    ``embedded``: a struct column of the same table.
    """

    entity: str
    field: str
    kind: str
    target: str
    link_column: str | None = None
    target_column: str | None = None
    join_table: str | None = None
    join_column: str | None = None
    inverse_column: str | None = None


@dataclass
class EntityModel:
    """Registered tables, their associations and field → column names."""

    tables: Mapping[str, DataFrame]
    associations: Sequence[Association]
    columns: Mapping[tuple[str, str], str] = field(default_factory=dict)

    def association(self, entity: str, name: str) -> Association | None:
        return next((a for a in self.associations if (a.entity, a.field) == (entity, name)), None)

    def column(self, entity: str, name: str) -> str:
        return self.columns.get((entity, name), name)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{prefix}__{c}") for c in df.columns])


def _hop(model: EntityModel, left: DataFrame, at: str, link: Association, prefix: str, how: str) -> DataFrame:
    """One association step; the right table's columns get ``prefix``."""
    right = _named(model.tables[link.target], prefix)
    if link.kind == "via_table":
        middle = _named(model.tables[link.join_table], f"{prefix}__link")
        first = F.col(f"{at}__{link.link_column}") == F.col(f"{prefix}__link__{link.join_column}")
        second = F.col(f"{prefix}__link__{link.inverse_column}") == F.col(f"{prefix}__{link.target_column}")
        return left.join(middle, first, how).join(right, second, "left")
    equal = F.col(f"{at}__{link.link_column}") == F.col(f"{prefix}__{link.target_column}")
    return left.join(right, equal, how)


def path_join(model: EntityModel, entity: str, name: str, how: str = "inner") -> DataFrame:
    """All columns of ``entity`` joined with those reached by one association field.

    Columns are named ``<entity>__<column>`` and ``<entity>__<field>__<column>``. A to-one or
    to-many field joins as written (``how``, default inner); a field with a join table joins
    the join table as written and then its target with a left join.
    """
    link = model.association(entity, name)
    if link is None or link.kind == "embedded":
        raise PathError(f"{entity}.{name} is no join")
    return _hop(model, _named(model.tables[entity], entity), entity, link, f"{entity}__{name}", how)


def _needs_no_join(entity: str, path: str) -> bool:
    steps = path.split(".")
    quoted = path.startswith('"')
    rewritten = any(s.startswith(ARRAY_PREFIX) for s in steps)
    return quoted or rewritten or len(steps) == 1 or (len(steps) == 2 and steps[0] == entity)


def path_select(model: EntityModel, entity: str, paths: Iterable[str]) -> DataFrame:
    """The columns at the ends of ``paths``, one output column per path.

    Each path is walked left to right over the model only; a step is joined once and paths
    with the same beginning share it. Steps implied by a path are inner joins. A single name,
    ``entity.column``, a quoted identifier or a rewritten array item needs no join. Output
    names are the paths with dots replaced by underscores.
    """
    rows = _named(model.tables[entity], entity)
    joined = {entity}
    picked = []
    for path in paths:
        out = path.strip('"').replace(".", "_")
        if _needs_no_join(entity, path):
            name = path.strip('"') if path.startswith('"') else path.split(".")[-1]
            picked.append(F.col(f"`{entity}__{model.column(entity, name)}`").alias(out))
            continue
        steps = path.split(".")
        steps = steps[1:] if steps[0] == entity and model.association(entity, steps[0]) is None else steps
        at, current, inside = entity, entity, ""
        for name in steps[:-1]:
            link = model.association(current, name)
            if link is None:
                raise PathError(f"cannot resolve {name!r} of {current!r} in {path!r}")
            if link.kind == "embedded":
                inside += f"`{model.column(current, name)}`."
                current = link.target
                continue
            prefix = f"{at}__{name}"
            if prefix not in joined:
                rows = _hop(model, rows, at, link, prefix, "inner")
                joined.add(prefix)
            at, current, inside = prefix, link.target, ""
        if inside:
            first, _, rest = inside.replace("`", "").rstrip(".").partition(".")
            column = F.col(f"`{at}__{first}`")
            for part in filter(None, rest.split(".")):
                column = column.getField(part)
            column = column.getField(model.column(current, steps[-1]))
        else:
            end = f"{at}__{model.column(current, steps[-1])}"
            if end not in rows.columns:
                raise PathError(f"no column {steps[-1]!r} in {current!r} for {path!r}")
            column = F.col(f"`{end}`")
        picked.append(column.alias(out))
    return rows.select(*picked)


def implied_joins(refs: DataFrame, links: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Join edges implied by path references.

    ``refs``: stmt_id, entity, path (array of names; the last is a column). ``links``:
    entity, field, kind, target, left_table, link_column, right_table, target_column,
    join_table, join_column, inverse_column. Many references share a path, so each distinct
    (entity, path) is walked once, one equi-join with the links per hop up to the longest path
    (measured over them when ``max_hops`` is not given), and the references meet the edges in
    one join. An array item, a quoted name, a single name or the entity itself as qualifier
    makes no edge.
    """
    wanted = refs.filter(
        (F.size("path") > 1)
        & ~F.startswith(F.get("path", F.lit(0)), F.lit('"'))
        & ~F.exists("path", lambda p: F.startswith(p, F.lit(ARRAY_PREFIX)))
        & ~((F.size("path") == 2) & (F.get("path", F.lit(0)) == F.col("entity")))
    )
    own = F.get("path", F.lit(0)) == F.col("entity")
    wanted = wanted.withColumn("path", F.when(own, F.slice("path", F.lit(2), F.size("path") - 1)).otherwise(F.col("path")))
    shapes = wanted.select("entity", "path").distinct()
    if max_hops is None:
        longest = shapes.agg(F.max(F.size("path"))).first()[0]
        max_hops = max((longest or 0) - 1, 0)
    at = shapes.select(F.col("entity").alias("_root"), "path", "entity")
    out = None
    for hop in range(max_hops):
        step = at.filter(F.size("path") > hop + 1).withColumn("field", F.get("path", F.lit(hop)))
        step = step.join(links, ["entity", "field"])
        plain = F.array(
            F.struct(
                F.col("left_table").alias("left_table"),
                F.col("link_column").alias("left_column"),
                F.col("right_table").alias("right_table"),
                F.col("target_column").alias("right_column"),
                F.lit("inner").alias("join_type"),
            )
        )
        double = F.array(
            F.struct(
                F.col("left_table").alias("left_table"),
                F.col("link_column").alias("left_column"),
                F.col("join_table").alias("right_table"),
                F.col("join_column").alias("right_column"),
                F.lit("inner").alias("join_type"),
            ),
            F.struct(
                F.col("join_table").alias("left_table"),
                F.col("inverse_column").alias("left_column"),
                F.col("right_table").alias("right_table"),
                F.col("target_column").alias("right_column"),
                F.lit("left").alias("join_type"),
            ),
        )
        edge = F.when(F.col("kind") == "via_table", double).when(F.col("kind") != "embedded", plain)
        edges = step.select("_root", "path", F.explode_outer(edge).alias("_e")).filter("_e is not null").select("_root", "path", "_e.*")
        out = edges if out is None else out.unionByName(edges)
        at = step.select("_root", "path", F.col("target").alias("entity"))
    if out is None:
        return refs.select("stmt_id", *[F.lit(None).cast("string").alias(c) for c in _EDGE]).limit(0)
    edges = out.distinct().withColumnRenamed("_root", "entity")
    return wanted.join(edges, ["entity", "path"]).select("stmt_id", *_EDGE).distinct()


_EDGE = ("left_table", "left_column", "right_table", "right_column", "join_type")


def learned_links(associations: DataFrame, tables: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``links`` of :func:`implied_joins` from what a corpus says about its entities.

    ``associations``, ``tables`` and ``ids`` come from the metadata operators. A to-one field
    links its column to the target's id; a mapped to-many field its own id to the column of the
    field that maps it; a join table stands between both ids. A to-one field without a column
    takes the one that another entity of the same table declares. An id that no class declares
    is called id; an entity without a table is its own table.
    """
    table = tables.groupBy(F.col("entity").alias("_e")).agg(F.max("table_name").alias("_t"))
    key = ids.groupBy(F.col("entity").alias("_e")).agg(F.max("column_name").alias("_k"))
    names = table.join(key, "_e", "full")
    shared = first_links(associations, tables).select(F.col("table_name").alias("left_table"), "field", F.col("link_column").alias("_shared"))
    back = associations.filter(F.col("kind").isin("many_to_one", "join_column")).groupBy("entity", "field").agg(F.max("link_column").alias("_back"))
    rows = associations.withColumn("target", F.lower("target_entity"))
    for side, at in (("left", "entity"), ("right", "target")):
        own = names.select(F.col("_e").alias(at), F.col("_t").alias(f"_{side}"), F.col("_k").alias(f"_{side}_key"))
        rows = rows.join(own, at, "left").withColumn(f"{side}_table", F.coalesce(f"_{side}", at)).withColumn(f"_{side}_key", F.coalesce(f"_{side}_key", F.lit("id")))
    rows = rows.join(shared, ["left_table", "field"], "left")
    rows = rows.join(back.select(F.col("entity").alias("target"), F.lower("field").alias("mapped_by"), "_back"), ["target", "mapped_by"], "left")
    kind = F.when(F.col("kind").isin("many_to_one", "join_column"), "to_one").when(F.col("kind") == "one_to_many", "to_many").when(F.col("kind") == "join_table", "via_table").otherwise(F.col("kind"))
    via = F.col("kind") == "join_table"
    one = F.col("kind").isin("many_to_one", "join_column")
    found = rows.select(
        "entity",
        "field",
        kind.alias("kind"),
        "target",
        "left_table",
        F.when(one, F.coalesce("link_column", "_shared")).otherwise(F.col("_left_key")).alias("link_column"),
        "right_table",
        F.when(F.col("kind") == "one_to_many", F.col("_back")).otherwise(F.col("_right_key")).alias("target_column"),
        F.when(via, F.col("join_table")).alias("join_table"),
        F.when(via, F.get("join_columns", F.lit(0))).alias("join_column"),
        F.when(via, F.get("inverse_columns", F.lit(0))).alias("inverse_column"),
    )
    whole = (F.col("kind") == "embedded") | (F.col("target").isNotNull() & F.col("link_column").isNotNull() & F.col("target_column").isNotNull())
    return found.filter(whole & ((F.col("kind") != "via_table") | (F.col("join_column").isNotNull() & F.col("inverse_column").isNotNull())))
