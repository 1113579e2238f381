"""Registered queries: settings blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.operators import settings as op
from slipstack.plans.inputs import cte, load

OWN = "parse_json('{\"codigoActivo\":true,\"codigoValor\":\"42\",\"codigoPosicion\":\"inf-izq\"}')"


def _keys(blob):
    return F.array_join(F.array_sort(F.map_keys(blob)), ",")


def s09(spark, d):
    """Save the code panel, save the currency, take the code panel away again."""
    own = F.expr(OWN).cast("map<string,variant>")
    money = F.create_map(F.lit("moneda"), F.parse_json(F.lit('"BOB"')))
    blobs = load(spark, d, "blobs").withColumn("_b", op.fields(F.col("payload")))
    blobs = blobs.withColumn("_code", op.merged(F.col("_b"), own)).withColumn("_money", op.merged(F.col("_b"), money))
    left = op.without(F.col("_b"), fixed.CODE_KEYS)
    return blobs.select(
        "batch_id",
        _keys(F.col("_code")).alias("code_keys"),
        F.variant_get(F.col("_code")["codigoValor"], "$", "string").alias("code_value"),
        _keys(F.col("_money")).alias("money_keys"),
        F.variant_get(F.col("_money")["moneda"], "$", "string").alias("money"),
        _keys(left).alias("left_keys"),
        (F.size(left) == 0).alias("dropped"),
    )


def s17(spark, d):
    return op.validated(load(spark, d, "blobs")).drop("payload")


QUERIES = {"S-09": s09, "S-17": s17}

OBJ = (
    cte("blobs").rstrip() + ", o AS (SELECT batch_id, CASE WHEN json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE '{}' END) = 'OBJECT' THEN payload ELSE '{}' END AS j FROM blobs)"
)
CODE = "['codigoActivo', 'codigoValor', 'codigoPosicion']"


def _joined(keys: str) -> str:
    return f"array_to_string(list_sort(list_distinct({keys})), ',')"


ORACLES = {
    "S-09": OBJ + f""", k AS (SELECT batch_id, json_keys(j) AS ks FROM o)
        SELECT batch_id, {_joined(f'list_concat(ks, {CODE})')} AS code_keys, '42' AS code_value,
        {_joined("list_concat(ks, ['moneda'])")} AS money_keys, 'BOB' AS money,
        {_joined(f'[x for x in ks if NOT list_contains({CODE}, x)]')} AS left_keys, len([x for x in ks if NOT list_contains({CODE}, x)]) = 0 AS dropped FROM k""",
    "S-17": OBJ + """, f AS (SELECT batch_id, json_keys(j) AS ks, json_type(j, '$.codigoActivo') AS ta, json_type(j, '$.codigoValor') AS tv, json_type(j, '$.codigoPosicion') AS tp,
          json_extract_string(j, '$.codigoActivo') AS a, json_extract_string(j, '$.codigoValor') AS v, json_extract_string(j, '$.codigoPosicion') AS p,
          coalesce(json_type(j, '$.moneda') = 'VARCHAR' AND json_extract_string(j, '$.moneda') IN ('USD', 'ARS', 'EUR', 'BOB'), false) AS known, json_extract_string(j, '$.moneda') AS m FROM o),
        g AS (SELECT *, NOT (list_contains(ks, 'moneda') AND NOT known) AND (coalesce(ta = 'BOOLEAN', false) OR coalesce(tv = 'VARCHAR', false) OR coalesce(tp = 'VARCHAR', false) OR known) AS usable,
          [x for x in ks if x NOT IN ('configIA', 'codigoLongitud')] AS rest FROM f)
        SELECT batch_id, usable, usable AND coalesce(ta = 'BOOLEAN' AND a = 'true', false) AS code_active,
        CASE WHEN usable AND tv = 'VARCHAR' THEN v ELSE '' END AS code_value,
        CASE WHEN usable AND tp = 'VARCHAR' AND p IN ('sup-izq', 'sup-der', 'inf-izq', 'inf-der') THEN p ELSE 'inf-der' END AS code_corner,
        CASE WHEN usable AND known THEN m ELSE 'BOB' END AS currency,
        CASE WHEN len(rest) = len(ks) THEN 'keep' WHEN len(rest) = 0 THEN 'delete' ELSE 'rewrite' END AS storage FROM g""",
}
