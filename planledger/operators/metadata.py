"""Entity metadata learned from annotated classes, and the name lookups built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scale import join_hot

# Fixed set: the column types that need no lookup.
KNOWN_TYPES = ("Boolean", "Long", "Integer", "Date", "String")

# Fixed pairs: Java primitive and its boxed name.
BOXED = {
    "boolean": "Boolean",
    "byte": "Byte",
    "char": "Character",
    "double": "Double",
    "float": "Float",
    "int": "Integer",
    "long": "Long",
    "short": "Short",
}


# In text from ``pair_brackets`` an annotation's brackets are a pair of equal characters; the capture
# that tells them is the one before the last in the patterns that start with annotations.
def _annotations(group: int) -> str:
    return rf"(?:@\w+(?:\.\w+)*+(?:\s*+{text.paired(group)})?+\s*+)++"


_ANNOTATION = rf"(?s)@\w+(?:\.\w+)*+(?:\s*+{text.paired(1)})?+"
_VALUE = rf'"?((?:(?!{text.PAIR})[^",])*)'
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|transient|volatile)\s+)*+"
_TYPE = r"[\w.]+(?:\s*<[^;={}()]*>)?(?:\s*\[\s*\])*"
_FIELD = rf"(?s)({_annotations(2)}){_MODIFIERS}({_TYPE})\s+(\w+)\s*(?:=[^;]*+)?;"
_CLASS = rf"(?s)({_annotations(2)}){_MODIFIERS}(?:class|interface)\s+\w+"


def _pair(annotation: Column, name: str) -> Column:
    """Value of ``name = …`` of an annotation, lower case without quotes; null when absent."""
    own = F.regexp_replace(annotation, rf"(?s)(?<=\S)\s*@\w+(?:\.\w+)*+\s*{text.paired(1)}", "")
    return F.nullif(F.lower(F.trim(text.unshield(F.regexp_extract(own, rf"\b{name}\s*=\s*{_VALUE}", 1)))), F.lit(""))


def _annotation(annotations: Column, name: str) -> Column:
    return F.get(F.filter(annotations, lambda a: a.rlike(rf"^@(?:\w+\.)*{name}\b")), F.lit(0))


def class_facts(corpus: DataFrame) -> DataFrame:
    """One row per file, made in one pass over its text: entity, parent, class annotations, fields.

    Every function below takes a corpus or these facts. Who needs several of them writes the facts
    once and passes them on, so the corpus is read a single time.
    """
    if "class_notes" in corpus.columns:
        return corpus
    source = text.source_without_comments(F.col("content"))
    files = corpus.select("path", "qualified_class", F.lower("class_name").alias("entity"), source.alias("_source"))
    files = files.withColumn("_marked", text.pair_brackets(text.shield_quoted(F.col("_source"))))
    heads = F.array_join(F.regexp_extract_all("_marked", F.lit(_CLASS), F.lit(1)), "\n")
    head = F.regexp_extract("_source", r"\bclass\s+\w+([^{]*)\{", 1)
    parent = _simple(F.regexp_extract(F.regexp_replace(head, r"^\s*<[^{]*?>(?=\s*extends)", ""), r"\bextends\s+([\w.]+)", 1))
    return files.select(
        "path",
        "qualified_class",
        "entity",
        F.lower(parent).alias("parent"),
        F.regexp_extract_all(heads, F.lit(_ANNOTATION), F.lit(0)).alias("class_notes"),
        F.regexp_extract_all("_marked", F.lit(_FIELD), F.lit(0)).alias("field_texts"),
    )


def class_annotations(corpus: DataFrame) -> DataFrame:
    """(path, entity, annotation): the annotations that stand on a class."""
    rows = class_facts(corpus).select("path", "entity", F.explode_outer("class_notes").alias("annotation"))
    return rows.filter("annotation is not null")


def entity_fields(corpus: DataFrame) -> DataFrame:
    """One row per annotated field, in source order. Narrow: everything happens in the file's row."""
    # The text is searched once; the parts are then read from each short block.
    return (
        class_facts(corpus)
        .select("path", "qualified_class", "entity", F.posexplode_outer("field_texts").alias("field_ord", "_field"))
        .filter("_field is not null")
        .select(
            "path",
            "qualified_class",
            "entity",
            "field_ord",
            F.lower(F.regexp_extract("_field", _FIELD, 4)).alias("field"),
            F.regexp_extract("_field", _FIELD, 3).alias("declared"),
            F.regexp_extract_all(F.regexp_extract("_field", _FIELD, 1), F.lit(_ANNOTATION), F.lit(0)).alias("annotations"),
        )
    )


def _simple(type_text: Column) -> Column:
    """Simple name of a type, without arguments and array brackets."""
    return F.regexp_extract(F.regexp_replace(type_text, r"\s*(?:<.*>|\[.*\])", ""), r"([\w]+)\s*$", 1)


def entity_tables(corpus: DataFrame) -> DataFrame:
    """(entity, table_name) from annotations named like Table with a name; also name → itself."""
    named = class_annotations(corpus).filter(F.regexp_extract("annotation", r"^@([\w.]+)", 1).contains("Table"))
    named = named.withColumn("table_name", _pair(F.col("annotation"), "name")).filter("table_name is not null")
    return named.select(F.explode(F.array("entity", "table_name")).alias("entity"), "table_name").distinct()


def embeddables(corpus: DataFrame) -> DataFrame:
    """Classes marked as embeddable."""
    marked = class_annotations(corpus).filter(F.regexp_extract("annotation", r"^@([\w.]+)", 1).contains("Embeddable"))
    return marked.select("entity").distinct()


def _own_columns(fields: DataFrame) -> DataFrame:
    column = _pair(_annotation(F.col("annotations"), "Column"), "name")
    return fields.withColumn("column_name", column).filter("column_name is not null")


def entity_columns(corpus: DataFrame) -> DataFrame:
    """(entity, qualified_class, field, column_name): field → column, and column → itself."""
    own = _own_columns(entity_fields(corpus))
    names = F.explode(F.array("field", "column_name")).alias("field")
    return own.select("entity", "qualified_class", names, "column_name").distinct()


def entity_ids(corpus: DataFrame) -> DataFrame:
    """(entity, qualified_class, field = id, column_name) from a bare ``@Id`` field."""
    fields = entity_fields(corpus)
    marker = F.exists("annotations", lambda a: a.rlike(r"^@(?:\w+\.)*Id\s*$"))
    column = F.coalesce(_pair(_annotation(F.col("annotations"), "Column"), "name"), F.col("field"))
    ids = fields.filter(marker).groupBy("entity", "qualified_class").agg(F.max_by(column, "field_ord").alias("column_name"))
    return ids.select("entity", "qualified_class", F.lit("id").alias("field"), "column_name")


def entity_types(corpus: DataFrame) -> DataFrame:
    """(entity, column_name, type_name): the last ``@Column`` type, else the first ``@JoinColumn`` type."""
    fields = entity_fields(corpus)
    simple = _simple(F.col("declared"))
    boxed = F.create_map(*[F.lit(x) for pair in BOXED.items() for x in pair])
    column = _pair(_annotation(F.col("annotations"), "Column"), "name")
    link = F.when(~simple.isin(*BOXED), _pair(_annotation(F.col("annotations"), "JoinColumn"), "name"))
    rows = fields.select(
        "entity",
        "field_ord",
        F.coalesce(F.try_element_at(boxed, simple), simple).alias("type_name"),
        F.explode(
            F.array(
                F.struct(column.alias("name"), F.lit(True).alias("own")),
                F.struct(link.alias("name"), F.lit(False).alias("own")),
            )
        ).alias("_c"),
    ).filter("_c.name is not null")
    own_order = F.when(F.col("_c.own"), F.col("field_ord"))
    link_order = F.when(~F.col("_c.own"), F.col("field_ord"))
    return rows.groupBy("entity", F.col("_c.name").alias("column_name")).agg(
        F.coalesce(F.max_by("type_name", own_order), F.min_by("type_name", link_order)).alias("type_name")
    )


def associations(corpus: DataFrame) -> DataFrame:
    """One row per field that points to another class: links, mapped sides, join tables, embedded objects."""
    notes = F.col("annotations")
    fields = (
        entity_fields(corpus)
        .withColumn("_table", _annotation(notes, "JoinTable"))
        .withColumn("_link", _annotation(notes, "JoinColumn"))
        .withColumn("_many", _annotation(notes, "OneToMany"))
        .withColumn("_one", _annotation(notes, "ManyToOne"))
        .withColumn("_embedded", _annotation(notes, "Embedded"))
    )
    arguments = F.split(F.regexp_extract("declared", r"<(.*)>", 1), r"\s*,\s*")
    arguments = F.filter(F.transform(arguments, _simple), lambda a: a != "")
    foreign = F.filter(arguments, lambda a: ~a.isin(*KNOWN_TYPES))
    table_target = F.when(F.size(arguments) > 1, F.coalesce(F.get(foreign, F.size(foreign) - 1), F.get(arguments, F.lit(0)))).otherwise(
        F.get(arguments, F.lit(0))
    )

    def nested(pair: str) -> Column:
        body = F.regexp_extract("_table", rf"(?s)\b{pair}\s*=\s*((?:\{{\s*)?(?:@\w+(?:\.\w+)*+\s*{text.paired(2)}\s*,?\s*)+)", 1)
        names = F.regexp_extract_all(body, F.lit(rf"\bname\s*=\s*{_VALUE}"), F.lit(1))
        return F.transform(names, lambda n: F.lower(F.trim(text.unshield(n))))

    target = (
        F.when(F.col("_table").isNotNull(), table_target)
        .when(F.col("_many").isNotNull(), F.get(arguments, F.lit(0)))
        .when(F.col("_one").isNotNull() | F.col("_embedded").isNotNull(), _simple(F.col("declared")))
    )
    kind = (
        F.when(F.col("_table").isNotNull(), "join_table")
        .when(F.col("_many").isNotNull(), "one_to_many")
        .when(F.col("_one").isNotNull(), "many_to_one")
        .when(F.col("_embedded").isNotNull(), "embedded")
        .when(F.col("_link").isNotNull(), "join_column")
    )
    return (
        fields.withColumn("kind", kind)
        .filter("kind is not null")
        .select(
            "entity",
            "field",
            "kind",
            target.alias("target_entity"),
            _pair(F.col("_link"), "name").alias("link_column"),
            _pair(F.col("_many"), "mappedBy").alias("mapped_by"),
            _pair(F.col("_table"), "name").alias("join_table"),
            F.when(F.col("_table").isNotNull(), nested("joinColumns")).alias("join_columns"),
            F.when(F.col("_table").isNotNull(), nested("inverseJoinColumns")).alias("inverse_columns"),
        )
    )


def class_parents(corpus: DataFrame) -> DataFrame:
    """(entity, parent): the simple name of the class a file's first class extends."""
    return class_facts(corpus).select("entity", "parent").filter("parent <> ''")


def _overlay(own: DataFrame, added: DataFrame) -> DataFrame:
    """Union in which an added (entity, field) replaces an own one."""
    both = own.select("entity", "field", "column_name", F.lit(1).alias("_rank")).unionByName(
        added.select("entity", "field", "column_name", F.lit(0).alias("_rank"))
    )
    best = F.min_by("column_name", F.struct("_rank", "column_name"))
    return both.groupBy("entity", "field").agg(best.alias("column_name"))


def inherit(columns: DataFrame, parents: DataFrame) -> DataFrame:
    """Own names plus those of the class each class extends, one level, the parent's winning.

    Only classes with a name of their own inherit. When several classes share the parent's
    simple name, the first by qualified name is taken. Many classes extend one base class,
    so the children are spread over salts and the parents copied.
    """
    owners = columns.select("entity").distinct()
    children = parents.join(owners, "entity", "left_semi")
    first = columns.groupBy(F.col("entity").alias("parent")).agg(F.min("qualified_class").alias("qualified_class"))
    offered = columns.select(F.col("entity").alias("parent"), "qualified_class", "field", "column_name").join(
        first, ["parent", "qualified_class"], "left_semi"
    )
    gained = join_hot(children, offered.drop("qualified_class"), ["parent"], ["entity"])
    gained = gained.select("entity", F.explode(F.array("field", "column_name")).alias("field"), "column_name")
    return _overlay(columns, gained.distinct())


def inherit_types(types: DataFrame, parents: DataFrame) -> DataFrame:
    """Own column types plus those of the class each class extends, one level, the parent's winning.

    Only classes with a type of their own inherit. ``types``: entity, column_name, type_name.
    """
    children = parents.join(types.select("entity").distinct(), "entity", "left_semi")
    offered = types.withColumnRenamed("entity", "parent")
    gained = join_hot(children, offered, ["parent"], ["entity"]).select("entity", "column_name", "type_name", F.lit(0).alias("_rank"))
    both = types.select("entity", "column_name", "type_name", F.lit(1).alias("_rank")).unionByName(gained)
    return both.groupBy("entity", "column_name").agg(F.min_by("type_name", F.struct("_rank", "type_name")).alias("type_name"))


def inline_embedded(columns: DataFrame, links: DataFrame, embeddable: DataFrame) -> DataFrame:
    """Own names plus those of every embedded object, the embedded ones winning."""
    owners = links.filter("kind = 'embedded'").select("entity", F.lower("target_entity").alias("part")).distinct()
    parts = columns.join(embeddable, "entity", "left_semi").select(F.col("entity").alias("part"), "field", "column_name")
    gained = join_hot(owners, parts, ["part"], ["entity"])
    gained = gained.select("entity", F.explode(F.array("field", "column_name")).alias("field"), "column_name")
    return _overlay(columns, gained.distinct())


def with_tables(metadata: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``table_name``: the entity's table, else the entity's own name."""
    names = tables.groupBy("entity").agg(F.max("table_name").alias("table_name"))
    return metadata.join(names, "entity", "left").withColumn("table_name", F.coalesce("table_name", "entity"))


def resolve_types(types: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, column_name, type_name) with class names replaced by the type of that class's same column."""
    typed = with_tables(types, tables).groupBy("table_name", "column_name").agg(F.max("type_name").alias("type_name"))
    names = tables.groupBy(F.col("entity").alias("_entity")).agg(F.max("table_name").alias("_table"))
    target = typed.withColumn("_entity", F.when(~F.col("type_name").isin(*KNOWN_TYPES), F.lower("type_name")))
    target = target.join(names, "_entity", "left").withColumn("_table", F.coalesce("_table", "_entity"))
    found = typed.select(F.col("table_name").alias("_table"), "column_name", F.col("type_name").alias("_type"))
    return target.join(found, ["_table", "column_name"], "left").select(
        "table_name", "column_name", F.coalesce("_type", "type_name").alias("type_name")
    )


def resolve_names(refs: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``table_name`` and ``column_name`` to (table_ref, column_ref); a miss keeps the input.

    The lookups are metadata; where they fit the broadcast limit nothing is shuffled, else
    adaptive execution splits a crowded reference.
    """
    names = tables.groupBy(F.col("entity").alias("_entity")).agg(F.max("table_name").alias("_table"))
    aliases = columns.groupBy(F.col("table_name").alias("_t"), F.col("field").alias("_f")).agg(F.max("column_name").alias("_column"))
    out = refs.join(names, F.lower("table_ref") == F.col("_entity"), "left")
    out = out.withColumn("table_name", F.coalesce("_table", "table_ref"))
    out = out.join(aliases, (F.col("table_name") == F.col("_t")) & (F.col("column_ref") == F.col("_f")), "left")
    return out.withColumn("column_name", F.coalesce("_column", "column_ref")).drop("_entity", "_table", "_t", "_f", "_column")


def qualify(refs: DataFrame, aliases: DataFrame, tables: DataFrame, columns: DataFrame, links: DataFrame) -> DataFrame:
    """Concrete ``out_qualifier`` and ``out_column`` for the column references of statements.

    ``refs``: stmt_id, kind, statement_table, qualifier (may be null), name. The qualifier is
    an alias, an entity, or else the statement's table is meant; then the column map; then the
    link column where the name is an association field. A name without qualifier in a select
    gets the alias or table; a bare alias or entity becomes ``alias.*``; true and false stay.
    """
    names = tables.groupBy("entity").agg(F.max("table_name").alias("_mapped"))
    by_alias = aliases.groupBy("stmt_id", "alias").agg(F.max("table_name").alias("_alias_table"))
    out = refs.join(by_alias.withColumnRenamed("alias", "qualifier"), ["stmt_id", "qualifier"], "left")
    out = out.withColumn("_raw", F.coalesce("_alias_table", "qualifier", "statement_table"))
    out = out.join(names, F.lower("_raw") == F.col("entity"), "left").drop("entity")
    out = out.withColumn("_table", F.coalesce("_mapped", "_raw")).drop("_mapped")
    own = names.withColumnRenamed("_mapped", "_own")
    out = out.join(own, F.lower("statement_table") == F.col("entity"), "left").drop("entity")
    out = out.withColumn("_own", F.coalesce("_own", "statement_table"))
    column_map = columns.groupBy(F.col("table_name").alias("_table"), F.col("field").alias("name")).agg(F.max("column_name").alias("_column"))
    out = out.join(column_map, ["_table", "name"], "left").withColumn("_column", F.coalesce("_column", "name"))
    link_map = first_links(links, tables).select(F.col("table_name").alias("_table"), F.col("field").alias("_column"), "link_column")
    out = out.join(link_map, ["_table", "_column"], "left").withColumn("_column", F.coalesce("link_column", "_column"))
    mapped_aliases = with_tables(by_alias.withColumnRenamed("_alias_table", "entity"), tables)
    table_alias = mapped_aliases.groupBy("stmt_id", F.col("table_name").alias("_table")).agg(F.max("alias").alias("_table_alias"))
    out = out.join(table_alias, ["stmt_id", "_table"], "left")
    as_alias = by_alias.select("stmt_id", F.col("alias").alias("name"), F.lit(True).alias("_is_alias"))
    out = out.join(as_alias, ["stmt_id", "name"], "left")
    as_entity = names.select(F.col("entity").alias("_name_entity"), F.col("_mapped").alias("_name_table"))
    out = out.join(as_entity, F.lower("name") == F.col("_name_entity"), "left")
    bare = F.col("qualifier").isNull()
    whole = bare & (F.coalesce("_is_alias", F.lit(False)) | (F.coalesce("_name_table", "name") == F.col("_own")))
    shown = F.coalesce("_table_alias", "_table")
    free = F.col("_column").isin("true", "false") | (shown == F.col("_column")) | (F.col("kind") != "select")
    return out.select(
        *refs.columns,
        F.when(whole, F.when(F.coalesce("_is_alias", F.lit(False)), F.col("name")).otherwise(shown))
        .when(~bare, F.col("qualifier"))
        .when(~free, shown)
        .alias("out_qualifier"),
        F.when(whole, F.lit("*")).otherwise(F.col("_column")).alias("out_column"),
    )


def first_links(links: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, field, link_column, entity): where entities share a table, the first with a link column."""
    linked = with_tables(links.filter("link_column is not null"), tables)
    return linked.groupBy("table_name", "field").agg(
        F.min_by("link_column", "entity").alias("link_column"), F.min("entity").alias("entity")
    )
