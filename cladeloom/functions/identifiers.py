"""Group and gene identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the written form of a group identifier.
GROUP_PATTERN = r"^(HOG:([A-Z]+)?(\d+)(?:\.([a-z0-9.]+))?)(?:_(\d+))?"


def parts(group: Column) -> Column:
    return F.split(group, r"\.")


def prefixes(group: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]"""
    p = parts(group)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "."))


def depth(group: Column) -> Column:
    return F.size(parts(group))


def parent(group: Column) -> Column:
    """The identifier without its last component; null for a root."""
    p = parts(group)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "."))


def is_descendant(group: Column, ancestor: Column) -> Column:
    """Whether `ancestor` is a prefix of group by components (or group itself)."""
    return F.coalesce((group == ancestor) | F.startswith(group, F.concat(ancestor, F.lit("."))), F.lit(False))


def relabel(family: Column, group: Column, root: Column) -> Column:
    """The family's number followed by what group has beyond its root."""
    tail = F.slice(parts(group), F.size(parts(root)) + 1, F.greatest(F.lit(1), F.size(parts(group))))
    return F.array_join(F.concat(F.array(family.cast("string")), tail), ".")


def group_id(family: Column, suffix: Column | None = None) -> Column:
    head = F.format_string("HOG:%07d", family)
    return head if suffix is None else F.when(F.coalesce(F.length(suffix), F.lit(0)) > 0, F.concat(head, F.lit("."), suffix)).otherwise(head)


def parse_group(group: Column) -> Column:
    """struct(id, rel, fam, sub, taxid); empty parts are null."""
    get = lambda i: F.nullif(F.regexp_extract(group, GROUP_PATTERN, i), F.lit(""))
    return F.struct(get(1).alias("id"), get(2).alias("rel"), get(3).cast("int").alias("fam"), get(4).alias("sub"), get(5).cast("int").alias("taxid"))


def protein_id(code: Column, number: Column) -> Column:
    """Species code and running number, as in ABCDE00012."""
    return F.format_string("%s%05d", code, number)
