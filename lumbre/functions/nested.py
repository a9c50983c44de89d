"""Maps, nested structs and JSON leaves."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, functions as F, types as T


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it.

    Inside a lambda an outer expression would be evaluated again for every
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def pairs_to_map(keys: Column, values: Column, keep: str = "last") -> Column:
    """A map from parallel arrays; a repeated key keeps its first or last value.

    The session must let the last of repeated keys win (``spark.sql.mapKeyDedupPolicy``, set by ``configure``); for the first to
    win the pairs are reversed.
    """
    return F.map_from_arrays(F.reverse(keys), F.reverse(values)) if keep == "first" else F.map_from_arrays(keys, values)


def delete_if(m: Column, condition) -> Column:
    return F.map_filter(m, lambda k, v: ~condition(k, v))


def rename_keys(m: Column, renames: dict[str, str]) -> Column:
    def new_name(k: Column, _v: Column) -> Column:
        chain = None
        for old, new in renames.items():
            chain = F.when(k == old, F.lit(new)) if chain is None else chain.when(k == old, F.lit(new))
        return chain.otherwise(k) if chain is not None else k
    return F.transform_keys(m, new_name)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of the leaves; an array of structs contributes its first item's leaves."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += leaf_paths(f.dataType, path + ".")
        else:
            out.append((path, f.dataType))
    return out


def _column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """One column per leaf; arrays give element 0, as far down as structs go."""
    def expand(c: Column, dtype: T.DataType, name: str) -> list[Column]:
        if isinstance(dtype, T.ArrayType):
            return expand(F.get(c, 0), dtype.elementType, name)
        if isinstance(dtype, T.StructType):
            return [x for f in dtype.fields for x in expand(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}")]
        return [c.alias(name)]
    return df.select([x for f in df.schema.fields for x in expand(F.col(f"`{f.name}`"), f.dataType, f.name)])


def nest(columns: dict[str, Column]) -> list[Column]:
    """Columns for a ``select`` that build nested structs out of dotted paths."""
    tree: OrderedDict = OrderedDict()
    for path, c in columns.items():
        node = tree
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, OrderedDict())
        node[leaf] = c

    def build(node, name: str) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(v, k) for k, v in node.items()]).alias(name)
        return node.alias(name)
    return [build(v, k) for k, v in tree.items()]


def promote(df: DataFrame, area: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a work-area struct become columns; clashing names get ``_original``."""
    taken = {c for c in df.columns if c != area} | set(reserved)
    fields = df.schema[area].dataType.fieldNames()
    moved = [F.col(f"`{area}`.`{f}`").alias(f"{f}_original" if f in taken else f) for f in fields]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != area], *moved)


def parse_json(c: Column, schema: str) -> Column:
    """Permissive: a broken text gives NULL leaves instead of failing the row."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()
