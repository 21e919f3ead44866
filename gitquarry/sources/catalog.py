"""Scans and sinks.

* S1 ``load_table``: a named collection as a DataFrame; the storage format
  is a parameter, so a document-store connector works when the user puts it
  on the classpath.
* S2 ``load_logical``: keep only the fields annotated with requested
  logical types (a field-annotation registry drives a plain ``select``).
* S3 / S4 ``read_pairs_csv`` / ``write_csv``: labelled pair files.
* S5 ``read_document_dump``: JSON-lines dumps in extended form
  (``{"$oid": ...}``, ``{"$date": ...}``), normalised to snake case with
  the parent-held id arrays exploded to child foreign keys;
  ``parse_documents`` and ``Catalog(..., fmt="dump")``: both generations of
  the documents as one schema, broken lines as dead letters.
* S6 ``write_new_table``: write results to a *new* table, never over the
  input.
* S7 ``sql_over``: register a DataFrame as a view and run SQL text on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------- S1
def load_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               **options) -> DataFrame:
    """All rows of collection ``name`` under ``root``."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "parquet":
        return reader.load(f"{root}/{name}.parquet")
    return reader.load(f"{root}/{name}")


class Catalog:
    """Named-table access bound to one root folder and format."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", **options):
        self.spark, self.root, self.fmt, self.options = spark, root, fmt, options

    def load(self, name: str) -> DataFrame:
        """A named table.  With ``fmt="dump"`` the root holds document dumps
        (``name.json``) of either generation, resolved to one schema."""
        if self.fmt != "dump":
            return load_table(self.spark, self.root, name, self.fmt, **self.options)
        own, _ = parse_documents(self._lines(name), name)
        if name not in CHILD_KEYS:
            return own
        parent, ids, key = CHILD_KEYS[name]
        return with_parent_keys(own, parse_documents(self._lines(parent), parent)[0], ids, key)

    def dead_letters(self, name: str) -> DataFrame:
        """The lines of a dump that are no documents, with the reason."""
        return parse_documents(self._lines(name), name)[1]

    def _lines(self, name: str) -> DataFrame:
        return self.spark.read.text(f"{self.root}/{name}.json").withColumnRenamed("value", "line")


# ---------------------------------------------------------------- S2
# Field annotations for the logical collections the jobs read.  Each entry
# is (field path, logical type path); a field is kept when its type path
# starts with one of the requested paths.
LOGICAL_TYPES: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "code_entity_state": [
        ("_id", ("RID",)),
        ("commit_id", ("RID",)),
        ("file_id", ("RID",)),
        ("ce_type", ("AbstractionLevel",)),
        ("long_name", ("Name",)),
        ("metrics.LOC", ("ProductMetric", "JavaClass")),
        ("metrics.WMC", ("ProductMetric", "JavaClass")),
        ("metrics.CBO", ("ProductMetric", "JavaClass")),
        ("metrics.NOM", ("ProductMetric", "JavaMethod")),
    ],
}


def _wanted(type_path: tuple[str, ...], requested: Sequence[Sequence[str]]) -> bool:
    return any(tuple(type_path[:len(r)]) == tuple(r) for r in requested)


def registry_table(spark: SparkSession, registry: dict[str, list[tuple[str, tuple[str, ...]]]] | None = None) -> DataFrame:
    """The registry as a table (table, path, type, subtype), for storing it
    next to the data and loading it through a ``Catalog``."""
    rows = [(table, path, types[0], types[1] if len(types) > 1 else None)
            for table, fields in (registry or LOGICAL_TYPES).items() for path, types in fields]
    return spark.createDataFrame(rows, "table string, path string, type string, subtype string")


def _annotations(registry, table: str) -> dict[str, tuple[str, ...]]:
    """Field path -> logical type path of one table; of a registry that is a
    DataFrame, only this table's rows (one a field) reach the driver."""
    if not isinstance(registry, DataFrame):
        return dict((registry or LOGICAL_TYPES)[table])
    rows = registry.where(F.col("table") == table).select("path", "type", "subtype").collect()
    if not rows:
        raise KeyError(table)
    return {r.path: tuple(t for t in (r.type, r.subtype) if t is not None) for r in rows}


def load_logical(df: DataFrame, table: str, requested: Sequence[Sequence[str]],
                 registry: dict[str, list[tuple[str, tuple[str, ...]]]] | DataFrame | None = None) -> DataFrame:
    """Project ``df`` to the fields whose logical type matches one of
    ``requested`` (each a type path such as ``["ProductMetric", "JavaClass"]``).

    Nested fields, at any depth, are rebuilt as structs with their surviving
    members, so ``metrics`` keeps the name and shape downstream operators
    expect.  The registry, a dict or a table (``registry_table``), is schema metadata only; no data reaches the driver,
    and the result is a plain projection that Catalyst pushes into the scan.
    A member of a registered struct that the registry doesn't know is an
    error: dropping it would lose a metric without a word.
    """
    fields = _annotations(registry, table)
    present = list(_leaf_paths(df.schema))
    structs = {path[:i] for path in fields for i in range(len(path)) if path[i] == "."}
    unknown = sorted(path for path in present if path not in fields and path not in structs
                     and any(path.startswith(s + ".") for s in structs))
    if unknown:
        raise ValueError(f"{table}: the registry has no logical type for {', '.join(unknown)}")
    tree: dict = {}
    for path in present:  # in the order of the data, whatever order the registry has
        if path in fields and _wanted(fields[path], requested):
            node = tree
            for part in path.split("."):
                node = node.setdefault(part, {})
    return df.select(*_rebuilt(tree, ""))


def _rebuilt(tree: dict, prefix: str) -> list:
    return [F.struct(*_rebuilt(members, f"{prefix}{name}.")).alias(name) if members
            else F.col(prefix + name).alias(name) for name, members in tree.items()]


def _leaf_paths(schema: T.StructType, prefix: str = "") -> Iterable[str]:
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        yield path
        if isinstance(field.dataType, T.StructType):
            yield from _leaf_paths(field.dataType, path + ".")


# ---------------------------------------------------------------- S3 / S4
PAIR_COLUMNS = ["Prefix", "Firstname", "Lastname", "Prefix_1", "Firstname_1", "Lastname_1", "Label"]
PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in PAIR_COLUMNS])


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs with header; every column is a string and an empty
    field reads back as null."""
    return spark.read.csv(path, header=True, schema=PAIR_SCHEMA)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists",
              single_file: bool = False) -> None:
    """One CSV with header.  ``mode="ignore"`` keeps an existing file, the
    behaviour of the simple identity job.  ``single_file`` funnels all rows
    through one task; use it only for a small labelling sample."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).csv(path, header=True)


# ---------------------------------------------------------------- S5
COMMIT_DUMP_SCHEMA = T.StructType([
    T.StructField("_id", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("projectId", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("revisionHash", T.StringType()),
    T.StructField("branches", T.ArrayType(T.StringType())),
    T.StructField("tagIds", T.ArrayType(T.StringType())),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("authorId", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("committerId", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("authorDate", T.StructType([T.StructField("$date", T.StringType())])),
    T.StructField("committerDate", T.StructType([T.StructField("$date", T.StringType())])),
    T.StructField("authorOffset", T.IntegerType()),
    T.StructField("committerOffset", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("fileActionIds", T.ArrayType(T.StructType([T.StructField("$oid", T.StringType())]))),
    T.StructField("bugfix", T.BooleanType()),
])

FILE_ACTION_DUMP_SCHEMA = T.StructType([
    T.StructField("_id", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("projectId", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("fileId", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("revisionHash", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("sizeAtCommit", T.IntegerType()),
    T.StructField("linesAdded", T.IntegerType()),
    T.StructField("linesDeleted", T.IntegerType()),
    T.StructField("isBinary", T.BooleanType()),
    T.StructField("hunkIds", T.ArrayType(T.StructType([T.StructField("$oid", T.StringType())]))),
])

DUMP_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def read_document_dump(spark: SparkSession, path: str, schema: T.StructType,
                       mode: str = "FAILFAST") -> DataFrame:
    """JSON-lines dump in extended form -> flat snake-case columns.

    ``{"$oid": s}`` becomes the string ``s``; ``{"$date": s}`` a timestamp;
    arrays of ids become arrays of strings.  A line that is no document is an
    error (``mode="PERMISSIVE"`` reads it as a row of nulls).
    """
    raw = spark.read.schema(schema).option("mode", mode).json(path)
    cols = []
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        dt = field.dataType
        if isinstance(dt, T.StructType) and dt.fieldNames() == ["$oid"]:
            c = c.getField("$oid")
        elif isinstance(dt, T.StructType) and dt.fieldNames() == ["$date"]:
            c = F.to_timestamp(c.getField("$date"), DUMP_DATE_FORMAT)
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):
            c = F.transform(c, lambda e: e.getField("$oid"))
        cols.append(c.alias(_snake(field.name)))
    return raw.select(*cols)


def explode_child_keys(parents: DataFrame, ids_col: str, child_key: str,
                       parent_key: str = "_id") -> DataFrame:
    """Parent-held id arrays -> (child id, parent foreign key) rows, the
    snake-case schema generation where the child holds the key."""
    return parents.select(F.explode(ids_col).alias("_id"), F.col(parent_key).alias(child_key))


# Fields of the documents by snake-case name.  Two generations of the schema exist:
# camel-case fields with the child ids held by the parent, and snake-case fields with the
# parent's id held by the child.  Either may write ids and dates in extended form.
DOCUMENTS: dict[str, dict[str, str]] = {
    "commit": {"_id": "id", "project_id": "id", "vcs_system_id": "id", "revision_hash": "string", "branches": "strings",
               "tag_ids": "ids", "parents": "strings", "author_id": "id", "committer_id": "id", "author_date": "date",
               "committer_date": "date", "author_offset": "int", "committer_offset": "int", "message": "string",
               "file_action_ids": "ids", "bugfix": "boolean"},
    "file_action": {"_id": "id", "project_id": "id", "commit_id": "id", "file_id": "id", "revision_hash": "string", "mode": "string",
                    "size_at_commit": "int", "lines_added": "int", "lines_deleted": "int", "is_binary": "boolean", "hunk_ids": "ids"},
    "hunk": {"_id": "id", "file_action_id": "id", "new_start": "int", "new_lines": "int", "old_start": "int", "old_lines": "int"},
    "message": {"_id": "id", "from_id": "id", "date": "date"},
    "issue_comment": {"_id": "id", "author_id": "id", "created_at": "date"},
    "people": {"_id": "id", "name": "string", "email": "string", "username": "string"},
    "project": {"_id": "id", "name": "string"},
    "vcs_system": {"_id": "id", "project_id": "id"},
}
#: Child -> (parent, the parent's list of child ids, the child's key of the parent).
CHILD_KEYS = {"file_action": ("commit", "file_action_ids", "commit_id"), "hunk": ("file_action", "hunk_ids", "file_action_id")}


def _camel(name: str) -> str:
    return re.sub(r"(?<=[a-z])_([a-z])", lambda m: m.group(1).upper(), name)


def _field(doc: Column, name: str, kind: str) -> Column:
    """A field of a document in either generation; null if absent or of
    another type."""
    spellings = dict.fromkeys((name, _camel(name)))

    def get(tail: str, sql_type: str) -> Column:
        return F.coalesce(*[F.try_variant_get(doc, f"$['{s}']{tail}", sql_type) for s in spellings])

    if kind == "id":
        return F.coalesce(get("['$oid']", "string"), get("", "string"))
    if kind == "date":
        text = F.coalesce(get("['$date']", "string"), get("", "string"))
        return F.coalesce(F.try_to_timestamp(text, F.lit(DUMP_DATE_FORMAT)), F.try_to_timestamp(text))
    if kind == "ids":
        return F.transform(get("", "array<variant>"), lambda x: F.coalesce(
            F.try_variant_get(x, "$['$oid']", "string"), F.try_variant_get(x, "$", "string")))
    return get("", {"strings": "array<string>"}.get(kind, kind))


def parse_documents(lines: DataFrame, table: str, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(documents, dead letters) of a table of JSON lines.

    Documents have the columns of ``DOCUMENTS[table]``, whichever generation
    a line belongs to.  A line that is no JSON object or has no ``_id`` is a
    dead letter (``line``, ``reason``); empty lines are neither."""
    doc = F.try_parse_json(F.col(line_col))
    rows = lines.where(F.trim(line_col) != "").select(F.col(line_col).alias("line"), doc.alias("doc"))
    broken = F.col("doc").isNull() | ~F.schema_of_variant("doc").startswith("OBJECT")
    reason = F.when(broken, "no document").when(_field(F.col("doc"), "_id", "id").isNull(), "no id")
    rows = rows.withColumn("reason", reason)
    fields = [_field(F.col("doc"), name, kind).alias(name) for name, kind in DOCUMENTS[table].items()]
    return rows.where(F.col("reason").isNull()).select(*fields), rows.where(F.col("reason").isNotNull()).select("line", "reason")


def with_parent_keys(children: DataFrame, parents: DataFrame, ids_col: str, key: str) -> DataFrame:
    """Children whose ``key`` is null get it from the parent that lists
    them."""
    listed = explode_child_keys(parents, ids_col, "_parent").dropDuplicates(["_id"])
    return children.join(listed, "_id", "left").withColumn(key, F.coalesce(key, "_parent")).select(*children.columns)


# ---------------------------------------------------------------- S6 / S7
def write_new_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results go to a new table; an existing target is an error, so an
    input collection is never overwritten."""
    df.write.mode("errorifexists").format(fmt).save(path)


def sql_over(spark: SparkSession, df: DataFrame, view: str, query: str) -> DataFrame:
    """Run SQL text over ``df`` registered as a temporary view."""
    df.createOrReplaceTempView(view)
    return spark.sql(query)


def sql_with(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """S7 without a session-wide view: ``{name}`` placeholders in the query
    are bound to the given DataFrames."""
    return spark.sql(query, **frames)


# ---------------------------------------------------------------- L1
def preview(df: DataFrame, n: int, *order) -> DataFrame:
    """L1: the first ``n`` rows in a given order (a top-n, planned as a
    per-partition top-n and a final merge, not a full sort)."""
    return df.orderBy(*order).limit(n)
