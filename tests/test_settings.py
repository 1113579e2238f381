from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from slipstack.operators import settings as op

DEFAULT = (False, "", "inf-der", "BOB")


@pytest.mark.parametrize(
    "blob,want,storage",
    [
        ('{"codigoActivo":true,"codigoValor":"123"}', (True, "123", "inf-der", "BOB"), "keep"),
        ('{"codigoActivo":true,"codigoPosicion":"centro"}', (True, "", "inf-der", "BOB"), "keep"),
        ('{"codigoActivo":true,"codigoPosicion":"sup-izq","moneda":"EUR"}', (True, "", "sup-izq", "EUR"), "keep"),
        ("{broken", DEFAULT, "keep"),
        (None, DEFAULT, "keep"),
        ("[1]", DEFAULT, "keep"),
        ('{"moneda":"XXX","codigoActivo":true}', DEFAULT, "keep"),
        ('{"moneda":null,"codigoActivo":true}', DEFAULT, "keep"),
        ('{"codigoActivo":"true","codigoValor":5,"moneda":"USD"}', (False, "", "inf-der", "USD"), "keep"),
        ('{"configIA":{"k":1},"codigoLongitud":6}', DEFAULT, "delete"),
        ('{"configIA":1,"moneda":"ARS"}', (False, "", "inf-der", "ARS"), "rewrite"),
    ],
)
def test_reading(rows, blob, want, storage):
    r = op.validated(rows([(blob,)], "payload string")).first()
    assert (r.code_active, r.code_value, r.code_corner, r.currency) == want
    assert r.storage == storage


def test_panels_keep_what_is_not_theirs(rows):
    df = rows([('{"tema":"x","codigoValor":"1"}',), ('{"codigoActivo":true}',)], "payload string").withColumn("b", op.fields(F.col("payload")))
    own = F.create_map(F.lit("codigoValor"), F.parse_json(F.lit('"9"')))
    saved = [json.loads(r[0]) for r in df.select(F.to_json(op.merged(F.col("b"), own))).collect()]
    assert saved == [{"tema": "x", "codigoValor": "9"}, {"codigoActivo": True, "codigoValor": "9"}]
    left = [r[0] for r in df.select(F.map_keys(op.without(F.col("b"), ("codigoActivo", "codigoValor")))).collect()]
    assert left == [["tema"], []]
