"""Settings blobs: tolerant reading, defaults, panel saves, clean-up.

A blob is free JSON text.  ``variant`` keeps the JSON types, which the rules need
(the text "true" is not a boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack import fixed


def fields(payload: Column) -> Column:
    """S-09: the top-level keys of a blob; anything but an object counts as empty."""
    parsed = F.try_parse_json(payload)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    return F.coalesce(F.when(is_object, parsed.cast("map<string,variant>")), empty)


def _typed(blob: Column, key: str, sql_type: str, want: str) -> Column:
    value = F.try_element_at(blob, F.lit(key))
    return F.when(F.schema_of_variant(value) == want, F.try_variant_get(value, "$", sql_type))


def without(blob: Column, keys: tuple[str, ...]) -> Column:
    """S-09: a panel takes its own keys away (an empty result means: drop the row)."""
    return F.map_filter(blob, lambda k, _: ~k.isin(*keys))


def merged(blob: Column, own: Column) -> Column:
    """S-09: a panel saves its own keys, the rest of the blob stays."""
    names = F.map_keys(own)
    rest = F.map_filter(blob, lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(rest, own)


def validated(settings: DataFrame, payload: str = "payload") -> DataFrame:
    """S-17: adds the effective settings and what to do with the stored blob.

    A present but unknown currency voids the whole blob.  Otherwise each field
    falls back on its own.  Retired keys go, and a blob of only those is deleted.
    """
    staged = settings.withColumn("_raw", fields(F.col(payload)))
    staged = staged.withColumn("_blob", without(F.col("_raw"), fixed.RETIRED_KEYS))
    blob = F.col("_blob")
    active = _typed(blob, "codigoActivo", "boolean", "BOOLEAN")
    value = _typed(blob, "codigoValor", "string", "STRING")
    corner = _typed(blob, "codigoPosicion", "string", "STRING")
    currency = _typed(blob, "moneda", "string", "STRING")
    known = currency.isin(*fixed.CURRENCY_SYMBOLS)
    has_currency = F.map_contains_key(blob, "moneda")
    usable = ~(has_currency & ~F.coalesce(known, F.lit(False))) & (
        active.isNotNull() | value.isNotNull() | corner.isNotNull() | F.coalesce(known, F.lit(False))
    )
    n_raw, n_left = F.size("_raw"), F.size(blob)
    return (
        staged.withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("code_active", F.coalesce(F.when(F.col("usable"), active), F.lit(False)))
        .withColumn("code_value", F.coalesce(F.when(F.col("usable"), value), F.lit("")))
        .withColumn(
            "code_corner",
            F.coalesce(
                F.when(F.col("usable") & corner.isin(*fixed.CODE_CORNERS), corner),
                F.lit(fixed.DEFAULT_CORNER),
            ),
        )
        .withColumn(
            "currency",
            F.coalesce(F.when(F.col("usable") & known, currency), F.lit(fixed.DEFAULT_CURRENCY)),
        )
        .withColumn(
            "storage",
            F.when(n_raw == n_left, "keep").when(n_left == 0, "delete").otherwise("rewrite"),
        )
        .drop("_raw", "_blob")
    )
