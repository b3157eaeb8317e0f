"""Templates for what is wanted of nested rows, made into column expressions and checked against the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Template = str | dict | tuple | list


def extract(template: Template, schema: T.StructType) -> Column:
    """What a template names in rows of a schema, as one column.

    A name is a field; a dict of one name goes down into it; a tuple gives a struct of its members, a list an array of them (of one type). Below an array the rest of the template
    is taken of each element; a name below a map is a key. Members of a tuple are called by the last name that leads to them, by number where names clash. A field that is not
    there, or a dict of more names, raises ValueError with the way to it; nulls on the way give null.
    """
    return _go(template, None, schema, ())[0]


def extracted(template: Template, schema: T.StructType) -> T.DataType:
    """The type that `extract` gives."""
    return _go(template, None, schema, ())[1]


def _go(template: Template, at: Column | None, kind: T.DataType, way: tuple[str, ...]) -> tuple[Column, T.DataType]:
    if at is not None and isinstance(kind, T.ArrayType):
        inner = _go(template, F.lit(None).cast(kind.elementType), kind.elementType, (*way, "[]"))[1]
        return F.transform(at, lambda x: _go(template, x, kind.elementType, (*way, "[]"))[0]), T.ArrayType(inner)
    if isinstance(template, dict):
        if len(template) != 1:
            raise ValueError(f"one name to go down by, not {len(template)}, at {'.'.join(way) or 'the top'}")
        name, rest = next(iter(template.items()))
        below, below_kind = _field(name, at, kind, way)
        return _go(rest, below, below_kind, (*way, str(name)))
    if isinstance(template, (tuple, list)):
        if not template:
            raise ValueError(f"an empty template at {'.'.join(way) or 'the top'}")
        parts = [_go(t, at, kind, way) for t in template]
        if isinstance(template, list):
            if len({p[1].simpleString() for p in parts}) > 1:
                raise ValueError(f"members of a list have one type, not {', '.join(p[1].simpleString() for p in parts)}, at {'.'.join(way) or 'the top'}")
            return F.array(*[p[0] for p in parts]), T.ArrayType(parts[0][1])
        names: list[str] = []
        for i, t in enumerate(template):
            name = _called(t)
            names.append(name if name and name not in names else f"_{i + 1}")
        made = F.struct(*[p[0].alias(n) for p, n in zip(parts, names, strict=True)])
        made = made if at is None else F.when(at.isNotNull(), made)
        return made, T.StructType([T.StructField(n, p[1]) for n, p in zip(names, parts, strict=True)])
    return _field(template, at, kind, way)


def _field(name: str, at: Column | None, kind: T.DataType, way: tuple[str, ...]) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.StructType) and name in kind.names:
        return (F.col(f"`{name.replace('`', '``')}`") if at is None else at.getField(name)), kind[name].dataType
    if at is not None and isinstance(kind, T.MapType):
        return at.getItem(name), kind.valueType
    raise ValueError(f"no {name!r} at {'.'.join(way) or 'the top'}, which is {kind.simpleString()[:200]}")


def _called(template: Template) -> str | None:
    if isinstance(template, str):
        return template
    if isinstance(template, dict):
        name, rest = next(iter(template.items()))
        return _called(rest) or str(name)
    return None


def slim(df: DataFrame, *names: str) -> DataFrame:
    """Those of the named columns that df has, in the order of the names."""
    return df.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names if n in df.columns])
