"""Deeply nested records to related flat tables.

First a merged schema is inferred from all bodies: a table for every path at which objects occur
(positions left out), its columns with their kinds and how often they occur, and its parent table.
Then the tables are exploded from the root down: the objects that a member of a table's records
holds, in however many levels of arrays, become the rows of the child table, each with its own
surrogate key, that of its parent and its ordinal in every array level. All tables of a body come
out of one pass, so depth costs no shuffle; only the schema aggregates. `records` holds the rows of
all tables, `flat_table` one of them in typed columns.

The list of tables that guides the explosion is broadcast if it has at most MAX_TABLES entries;
where keys are data and there are more, each body is guided by its own objects, with the same rows.

Edge cases: null, empty, blank or cut-off bodies give no rows; a body whose root isn't an object
still gives its objects, with the root ('') as parent; repeated ids count once; a single object
where other bodies have a list lands in the same table with an empty ordinal; a list without any
object is one column; null members are kept as absent. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import jsontree
from tarmac.session import cut

RECORD = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("table", T.StringType()),  # '' is the root; positions are left out, keys joined by '/'
    T.StructField("path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("ordinal", T.ArrayType(T.IntegerType())),  # positions since the parent record; empty: a member object
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),
])


MAX_TABLES = 100_000
KEY, PARENT = "record_key", "parent_key"


def _objects(value, path: str):
    """(path, ordinals, object) of the objects in a value or its arrays, and the plain values beside them."""
    found, plain, todo = [], [], [(path, (), value)]
    while todo:
        p, o, v = todo.pop()
        if isinstance(v, dict):
            found.append((p, o, v))
        elif isinstance(v, list):
            todo += [(f"{p}/{i}", (*o, i), x) for i, x in enumerate(v)][::-1]
        else:
            plain.append(v)
    return found, plain


def explode(root, tables: set[str] | None = None):
    """(table, path, parent_path, ordinal, fields, kinds) of the root and every object below it, table by table."""
    first = [("", None, (), root)]
    if isinstance(root, list):
        first += [(p, "", o, x) for p, o, x in _objects(root, "")[0]]
    todo = [("", first)]
    while todo:
        table, rows = todo.pop()
        below: dict[str, list] = {}
        for path, parent, ordinal, node in rows:
            fields, kinds = {}, {}
            for k, v in node.items() if isinstance(node, dict) else ():
                if isinstance(v, (dict, list)):
                    child = jsontree.pointer(table, k)
                    found, plain = _objects(v, jsontree.pointer(path, k)) if tables is None or child in tables else ((), v)
                    if found:
                        below.setdefault(child, []).extend((p, path, o, x) for p, o, x in found)
                        if not plain:
                            continue
                    else:
                        plain = v
                    fields[k], kinds[k] = jsontree.canonical(plain), "array"
                elif v is not None:
                    fields[k], kinds[k] = (v if isinstance(v, str) else jsontree.canonical(v)), jsontree.kind(v)
            yield table, path, parent, list(ordinal), fields, kinds
        todo += reversed(below.items())


def _bodies(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body_col).cast("string").alias("body"))
    return base.filter("doc_id is not null").dropDuplicates(["doc_id"])


def merged_schema(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """table, parent_table, column (null: the table itself), kinds (sorted), n_records with the column, optional (missing from some record of the table)."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["table", "parent_table", "column", "kind", "n"])

        for pdf in batches:
            for body in pdf["body"]:
                value = jsontree.parse(body)
                if value is jsontree.NOT_JSON or not isinstance(value, (dict, list)):
                    continue
                for table, _, _, _, _, kinds in explode(value):
                    parent = table.rpartition("/")[0] if table else None
                    seen[table, parent, None, None] = seen.get((table, parent, None, None), 0) + 1
                    for c, k in kinds.items():
                        seen[table, parent, c, k] = seen.get((table, parent, c, k), 0) + 1
            if len(seen) > 100_000:
                yield rows()
                seen.clear()
        yield rows()

    part = _bodies(docs, id_col, body_col).mapInPandas(infer, "table string, parent_table string, column string, kind string, n long")
    per = part.groupBy("table", "parent_table", "column").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n_records"))
    # A column may be missing from the table's records; the number of these is in the row without a column.
    rows = F.max(F.when(F.col("column").isNull(), F.col("n_records"))).over(Window.partitionBy("table"))
    return per.withColumn("optional", F.col("n_records") < rows)


def records(docs: DataFrame, id_col: str, body_col: str, schema: DataFrame | None = None) -> DataFrame:
    """The rows of all tables of the schema (inferred here if not given), the root's included (parent_path null)."""
    schema = cut(merged_schema(docs, id_col, body_col)) if schema is None else schema
    listed = schema.filter("column is null").select("table").limit(MAX_TABLES + 1).collect()
    sent = docs.sparkSession.sparkContext.broadcast({r.table for r in listed} if len(listed) <= MAX_TABLES else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["doc_id"], pdf["body"], strict=True):
                value = jsontree.parse(body)
                if value is not jsontree.NOT_JSON and isinstance(value, (dict, list)):
                    out += [(doc, *r) for r in explode(value, sent.value)]
            yield pd.DataFrame(out, columns=RECORD.names)

    return keyed(_bodies(docs, id_col, body_col).mapInPandas(run, RECORD))


def keyed(recs: DataFrame) -> DataFrame:
    """Adds the surrogate keys: a 64-bit hash of id and path, the same in every run."""
    return recs.select(
        "doc_id", "table", F.xxhash64("doc_id", "path").alias("record_key"),
        F.when(F.col("parent_path").isNotNull(), F.xxhash64("doc_id", "parent_path")).alias("parent_key"),
        "path", "parent_path", "ordinal", "fields", "kinds",
    )


def flat_table(recs: DataFrame, schema: DataFrame, table: str, max_columns: int = 1000) -> DataFrame:
    """One table with typed columns: doc_id, its keys, member (last key of the path), ordinal, then its columns by name.

    A table that ends in `/*` joins all tables of that parent, told apart by member: where keys are data. The
    max_columns most frequent columns get a column of their own; others are held in a map, more_fields.
    """
    inside = F.col("parent_table") == table[:-2] if table.endswith("/*") else F.col("table") == table
    cols = schema.filter(inside & F.col("column").isNotNull()).groupBy("column").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.sum("n_records").alias("n"))
    listed = cols.orderBy(F.desc("n"), "column").limit(max_columns + 1).collect()
    wide = sorted((r.column, tuple(r.kinds)) for r in listed[:max_columns])
    parent = F.regexp_extract("table", r"^(.*)/[^/]*$", 1)
    rows = recs.filter(((parent == table[:-2]) & (F.col("table") != "")) if table.endswith("/*") else F.col("table") == table)
    member = F.replace(F.replace(F.regexp_extract("table", r"([^/]*)$", 1), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    out, used = [F.col("doc_id"), F.col(KEY), F.col(PARENT), member.alias("member"), F.col("ordinal")], {"doc_id", KEY, PARENT, "member", "ordinal", "more_fields"}
    for name, kinds in wide:
        value = F.col("fields")[F.lit(name)]
        as_type = {("number",): "double", ("boolean",): "boolean"}.get(kinds)
        col = base = re.sub(r"\W+", "_", name) or "_"
        i = 1
        while col.lower() in used:
            i += 1
            col = f"{base}_{i}"
        used.add(col.lower())
        out.append((value.try_cast(as_type) if as_type else value).alias(col))
    if len(listed) > max_columns:
        out.append(F.map_filter("fields", lambda k, _: ~k.isin([n for n, _ in wide])).alias("more_fields"))
    return rows.select(*out)


def found(docs: DataFrame, id_col: str = "report_id", body_col: str = "body") -> DataFrame:
    """report_id, child_path, parent_path of every object below a root: the links of all child tables."""
    recs = records(docs, id_col, body_col).filter(F.col(PARENT).isNotNull())
    return recs.select(F.col("doc_id").alias("report_id"), F.col("path").alias("child_path"), "parent_path")
