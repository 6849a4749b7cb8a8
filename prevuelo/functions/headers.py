"""Predicates on column names (and the inferred type of the column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts that mark a column as temporal.
TEMPORAL = ["date", "fecha", "timestamp", "time", "created", "updated", "modified", "event"]

# Whole names of primary keys, any case.
PRIMARY_KEY = ["id", ".+_id", "id_.+", "uuid", "guid", "pk", "key"]

# Name parts of business keys, any case.
BUSINESS_KEY = [
    "code", "codigo", "código", "cod", "number", "numero", "número", "nro", "reference", "referencia", "ref",
]

# Name parts of strong incremental markers.
INCREMENTAL_STRONG = [
    "updated_at", "modified_at", "last_modified", "last_update", "update_date", "modification_date",
    "fecha_modificacion", "fecha_actualizacion", "timestamp",
]

# Name parts of secondary incremental markers.
INCREMENTAL_SECONDARY = [
    "created_at", "creation_date", "fecha_creacion", "event_date", "ingestion_date", "load_date",
]


def _holds_one_of(name: Column, parts: list[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def is_temporal(name: Column, inferred_type: Column) -> Column:
    return (inferred_type == "date") | _holds_one_of(name, TEMPORAL)


def names_primary_key(name: Column) -> Column:
    return name.rlike(rf"(?i)^(?:{'|'.join(PRIMARY_KEY)})\z")


def names_business_key(name: Column) -> Column:
    return name.rlike(f"(?iu){'|'.join(BUSINESS_KEY)}")


def names_strong_marker(name: Column) -> Column:
    return _holds_one_of(name, INCREMENTAL_STRONG)


def names_secondary_marker(name: Column) -> Column:
    return _holds_one_of(name, INCREMENTAL_SECONDARY)
