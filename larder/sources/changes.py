"""Table changes as joins: insert with defaults, partial update, delete, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.categories import detect_category
from larder.functions.text import is_filled


def _col(df: DataFrame, name: str, data_type) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(data_type)


def insert_items(inventory: DataFrame, new_rows: DataFrame, detect: bool = False) -> DataFrame:
    """Inventory with new rows; absent fields are 1.0, pcs and pantry (``detect`` takes the category from the name)."""
    defaults = {"quantity": F.lit(1.0), "unit": F.lit("pcs"), "category": F.lit("pantry")}
    filled = {}
    for field in inventory.schema:
        value = _col(new_rows, field.name, field.dataType)
        if field.name == "category" and detect:
            value = F.when(is_filled(value), value).otherwise(detect_category(F.col("item_name")))
        elif field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        filled[field.name] = value.cast(field.dataType)
    return inventory.unionByName(new_rows.select(*[v.alias(c) for c, v in filled.items()]))


def update_items(inventory: DataFrame, changes: DataFrame, keys=("item_id", "user_id"), order=None) -> DataFrame:
    """Fields of ``changes`` replace the old values; null fields keep them.

    A key may change several times: every field takes its last value along
    ``order``, a column or several; without one, its greatest value.
    """
    keys, order = list(keys), _names(order)
    fields = [c for c in changes.columns if c not in keys and c not in order]
    last = {c: F.struct(*order) if order else F.col(c) for c in fields}
    given = [F.max_by(c, F.when(F.col(c).isNotNull(), last[c])).alias(c) for c in fields]
    new = changes.groupBy(*keys).agg(*given).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return inventory.join(new, keys, "left").select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in inventory.columns
    ])


def delete_items(inventory: DataFrame, keys: DataFrame) -> DataFrame:
    """Inventory without the given (id, owner) rows."""
    return inventory.join(keys, keys.columns, "left_anti").select(*inventory.columns)


def upsert(target: DataFrame, source: DataFrame, key, order=None) -> DataFrame:
    """Source rows replace target rows of the same key and add new ones.

    Of several source rows with a key the last along ``order`` counts, a column
    or several; without one, the row whose values sort last.
    """
    keys, order = _names(key), _names(order)
    values = [c for c in target.columns if c not in keys]
    last = F.struct(*order) if order else F.struct(*values)
    row = source.groupBy(*keys).agg(F.max_by(F.struct(*values), last).alias("_row"))
    new = row.select(*keys, "_row.*").select(*target.columns)
    kept = target.join(new.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(new)


def _names(names) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)
