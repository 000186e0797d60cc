"""Entity graphs as XML and back: one element an entity, later mentions as references to the first one's label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write(entities: DataFrame, edges: DataFrame, tag: str, part: str, attributes: list[str], part_attributes: list[str], edge_attributes: list[str] = ()) -> DataFrame:
    """(id, xml): an element of every entity with its parts inside.

    edges (id, part_id, part columns, edge attributes); a part's first element in id order carries label, a later one
    just ref. Booleans are yes and no.
    """
    text = lambda df, c: F.when(F.col(c), "yes").otherwise("no") if df.schema[c].dataType.typeName() == "boolean" else F.col(c).cast("string")
    attr = lambda df, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {c}="'), escape(text(df, c)), F.lit('"'))).otherwise("")
    child = lambda df, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), escape(text(df, c)), F.lit(f"</{c}>"))).otherwise("")
    first = F.row_number().over(Window.partitionBy("part_id").orderBy("id")) == 1
    label = F.lower(F.conv(F.col("part_id").cast("string"), 10, 16))
    role = F.concat(F.lit(f"<{part}"), *[attr(edges, c) for c in edge_attributes])
    element = F.when(first, F.concat(role, F.lit(' label="'), label, F.lit('">'), *[child(edges, c) for c in part_attributes], F.lit(f"</{part}>"))).otherwise(F.concat(role, F.lit(' ref="'), label, F.lit('"/>')))
    inner = edges.withColumn("__x", element).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_id", "__x"))), lambda s: s["__x"]), "").alias("__parts"))
    out = F.concat(F.lit(f'<{tag} id="'), F.col("id").cast("string"), F.lit('">'), *[child(entities, c) for c in attributes], F.coalesce("__parts", F.lit("")), F.lit(f"</{tag}>"))
    return entities.join(inner, "id", "left").select("id", out.alias("xml"))


def read(rows: DataFrame, xml: str, schema: str) -> DataFrame:
    """The columns of schema from each element."""
    return rows.select(F.from_xml(F.col(xml), schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")


def resolve(parts: DataFrame) -> DataFrame:
    """(owner, label, columns): references (ref) take the columns of the part that carries the label."""
    rest = [c for c in parts.columns if c not in ("owner", "label", "ref")]
    named = parts.filter("label is not null").select(F.col("label"), *rest)
    return parts.select("owner", F.coalesce("label", "ref").alias("label")).join(named, "label").select("owner", "label", *rest)
