"""Access to the ordered ``fields`` array of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS_TYPE = "array<struct<key:string,val:string,demoted:boolean>>"


def first_field(key: str, fields: str | Column = "fields") -> Column:
    """Value of the first field with ``key``; NULL when there is none."""
    arr = F.col(fields) if isinstance(fields, str) else fields
    return F.get(F.filter(arr, lambda f: f["key"] == key), F.lit(0))["val"]


def field_value(key: str, fields: str | Column = "fields") -> Column:
    """Like ``first_field``, with "" for an absent field."""
    return F.coalesce(first_field(key, fields), F.lit(""))


def pick_fields(keys: tuple[str, ...], fields: str | Column = "fields") -> Column:
    """First non-empty value among ``keys`` in their order of priority, else NULL.

    One pass over the array narrows it to the wanted keys before the priority
    is applied, so records without any of them cost one short scan.
    """
    arr = F.col(fields) if isinstance(fields, str) else fields
    wanted = F.filter(arr, lambda f: f["key"].isin(*keys))
    first_of_key = [F.nullif(first_field(k, wanted), F.lit("")) for k in keys]
    return F.when(F.size(wanted) > 0, F.coalesce(*first_of_key))
