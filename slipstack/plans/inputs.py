"""How the benchmark tables stand in for receipts, files, sheets, boxes and events.

Each input is one SELECT in the dialect that Spark and the checking engine share,
so both sides start from the same rows.  Only inputs are shared: the operators are
DataFrame code here and separate SQL in the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipstack.plans.sql import CAPACITY

TABLES = (
    "orders", "lineitem", "part", "events", "documents", "embeddings", "pages", "customer", "conversations",
)

PLAIN = "CAST(CAST(floor({0} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({0} % 100 AS STRING), 2, '0')"

TEMPLATE_OF_ORDER = """SELECT *, {capacity} AS cap FROM (SELECT CAST(o_custkey AS STRING) AS batch_id, o_orderkey AS order_no,
               CASE o_orderpriority WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'u1' WHEN 'O' THEN 'u2h' ELSE 'u2v' END
                    WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'u3h' WHEN 'O' THEN 'u3v' ELSE 'u3m' END
                    WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'u4x2' WHEN 'O' THEN 'u5m' ELSE 'u6x2' END
                    WHEN '4-NOT SPECIFIED' THEN 'u6m' ELSE CASE o_orderstatus WHEN 'F' THEN 'u9z' ELSE 'u4x2' END END AS layout,
               CASE o_orderstatus WHEN 'F' THEN 'sup-izq' WHEN 'O' THEN 'inf-der' ELSE 'sup-der' END AS corner
        FROM {orders}) o"""

INPUTS = {
    # Receipts with OCR text: one per order, batch = customer.
    "receipts": f"""
        SELECT batch_id, receipt_id, receipt_id AS ord, 'factura-' || CAST(receipt_id AS STRING) || '.png' AS name,
               amt, plain,
               CASE pr WHEN '1-URGENT' THEN 'TOTAL ' || plain
                       WHEN '2-HIGH' THEN ' Total  Bs ' || plain || chr(10) || chr(9) || 'gracias  BOB' || plain
                       WHEN '3-MEDIUM' THEN 'SUBTOTAL ' || plain || ' PROPINA 1.00'
                       WHEN '4-NOT SPECIFIED' THEN 'NOTA - ' || plain
                       ELSE CASE st WHEN 'F' THEN '   ' WHEN 'O' THEN 'sin montos' ELSE '--- ' || plain END END AS text,
               CASE WHEN mon = 1 THEN amt END AS cents,
               mon = 2 AS manual,
               CASE mon WHEN 3 THEN 'pendiente' WHEN 4 THEN 'procesando' WHEN 5 THEN 'error' ELSE 'ok' END AS status,
               CASE mon WHEN 6 THEN '12,5' WHEN 7 THEN '' END AS draft,
               mon = 8 AS removed, pr, st, mon
        FROM (SELECT CAST(o_custkey AS STRING) AS batch_id, o_orderkey AS receipt_id, amt,
                     {PLAIN.format('amt')} AS plain, o_orderpriority AS pr, o_orderstatus AS st, mon
              FROM (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus,
                           CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amt,
                           CAST(month(o_orderdate) AS BIGINT) AS mon FROM {{orders}}) a) b""",
    # Amounts as typed by hand.
    "typed": f"""
        SELECT o_orderkey AS receipt_id, o_custkey AS editor, o_orderdate AS ts, o_orderkey AS seq,
               CASE o_orderpriority WHEN '1-URGENT' THEN '  $ ' || plain || ' '
                    WHEN '2-HIGH' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
                    WHEN '3-MEDIUM' THEN '1,' || plain
                    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN '-' || plain WHEN 'O' THEN '1,234' ELSE '12.5' END
                    ELSE CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'abc' ELSE '1' || plain || plain END END AS typed
        FROM (SELECT *, {PLAIN.format('amt')} AS plain
              FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amt FROM {{orders}}) a) b""",
    # Recognised lines of a receipt.
    "ocr_lines": """
        SELECT l_orderkey AS receipt_id, l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey AS line_no,
               CASE WHEN l_returnflag = 'N' THEN '' ELSE 'ITEM ' || CAST(l_partkey AS STRING) || ' x' || CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS text
        FROM {lineitem}""",
    # Late results: what a reader saw against what the receipt says now.
    "results": """
        SELECT l_orderkey AS receipt_id,
               CASE WHEN max(l_linenumber) > 2 THEN CAST(floor(max(l_extendedprice) * 100 + 0.5) AS BIGINT) END AS new_cents,
               min(l_returnflag) AS flag
        FROM {lineitem} GROUP BY l_orderkey""",
    # The same as a stream of single results: several may reach one receipt.
    "late_lines": """
        SELECT l_orderkey AS receipt_id, (l_linenumber * CAST(1000000 AS BIGINT) + l_partkey) * 1000000 + l_suppkey AS seq,
               CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS new_cents,
               l_returnflag AS flag
        FROM {lineitem}""",
    # Dropped files: one per part, batch = part type.
    "files": """
        SELECT p_type AS batch_id, p_partkey AS seq,
               replace(p_name, ' ', '-') || CASE p_brand WHEN 'Brand#1' THEN '.jpg' WHEN 'Brand#2' THEN '.png'
                    WHEN 'Brand#3' THEN '.webp' WHEN 'Brand#4' THEN '.tiff' WHEN 'Brand#5' THEN '.PDF'
                    WHEN 'Brand#7' THEN '.txt' WHEN 'Brand#10' THEN '' ELSE '.pdf' END AS name,
               CASE p_brand WHEN 'Brand#1' THEN 'image/jpeg' WHEN 'Brand#2' THEN 'IMAGE/PNG' WHEN 'Brand#3' THEN 'image/webp'
                    WHEN 'Brand#4' THEN 'image/tiff' WHEN 'Brand#5' THEN 'application/octet-stream' WHEN 'Brand#6' THEN ''
                    WHEN 'Brand#7' THEN 'text/plain' WHEN 'Brand#11' THEN ' ' WHEN 'Brand#12' THEN ''
                    ELSE 'application/pdf' END AS mime,
               CAST((p_size - 1) * 131072 AS BIGINT) AS size,
               CAST(CAST(floor(p_retailprice * 10 + 0.5) AS BIGINT) % 14 AS INT) AS page_count,
               CASE p_brand WHEN 'Brand#8' THEN 'password' WHEN 'Brand#9' THEN 'other' END AS open_error,
               CASE p_brand WHEN 'Brand#11' THEN 'FFD8FFE0' WHEN 'Brand#12' THEN CASE WHEN p_size > 25 THEN '524946460A0A0A0A57454250' ELSE '524946460A0A0A0A41564920' END
                    WHEN 'Brand#6' THEN CASE WHEN p_size > 25 THEN '89504E470D0A1A0A00' ELSE 'FFD8FF' END ELSE '255044462D' END AS head_hex,
               CAST(p_size * 100 AS DOUBLE) AS img_w, CAST(p_retailprice * 2 AS DOUBLE) AS img_h, p_size > 40 AS trimmed
        FROM {part}""",
    # Measured pages of those files.
    "page_measures": """
        SELECT l_partkey AS seq, l_linenumber AS page_no,
               CASE WHEN min(l_quantity) < 2 THEN CAST('NaN' AS DOUBLE) ELSE min(l_quantity) * 20 END AS width,
               max(l_quantity) * 60 AS height,
               1 - min(l_discount) AS white_ratio, min(l_tax) * 12 + max(l_discount) AS black_ratio
        FROM {lineitem} GROUP BY l_partkey, l_linenumber""",
    # Sheets: as many per order as its lines may need; the lines are the placed receipts.
    "sheets": f"""
        SELECT batch_id, order_no * 8 + k AS sheet_no, layout, corner, order_no, k, cap FROM ({TEMPLATE_OF_ORDER}) p
        JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) n ON k * cap < 7""",
    "placed": f"""
        SELECT s.batch_id, s.order_no * 8 + CAST(floor(l.n / s.cap) AS BIGINT) AS sheet_no, s.layout, s.corner, CAST(l.n % s.cap AS BIGINT) AS slot,
               l.receipt_id, l.width, l.height, l.cents, 'factura-' || CAST(l.receipt_id AS STRING) AS name
        FROM (SELECT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS n, l_orderkey * 8 + l_linenumber AS receipt_id,
                     CAST(max(l_quantity) AS BIGINT) * 37 AS width, CAST(floor(max(l_tax) * 100 + 0.5) AS BIGINT) * 200 AS height,
                     CASE WHEN min(l_returnflag) = 'A' THEN CAST(floor(max(l_extendedprice) * 100 + 0.5) AS BIGINT) END AS cents
              FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) l
        JOIN ({TEMPLATE_OF_ORDER}) s ON s.order_no = l.l_orderkey""",
    # New receipts to place: events, batch = user; and a paste request per batch.
    "arrivals": """
        SELECT CAST(o_custkey AS STRING) AS batch_id, o_orderkey AS seq, o_orderkey + CAST(1000000000000 AS BIGINT) AS receipt_id FROM {orders}""",
    # Boxes of rotation trials.
    "boxes": """
        SELECT receipt_id, deg, row_number() OVER (PARTITION BY receipt_id, deg ORDER BY l_partkey, l_suppkey, l_extendedprice) AS box_no,
               l_extendedprice AS box_score, text, score, width, height, batch_id
        FROM (SELECT l_orderkey AS receipt_id, CASE l_linenumber % 4 WHEN 1 THEN 0 WHEN 2 THEN 270 WHEN 3 THEN 90 ELSE 180 END AS deg,
                     l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN '' ELSE 'x' END AS text,
                     l_discount * 10 AS score, l_quantity * 40 AS width, l_tax * 200 + 1 AS height, l_linestatus AS batch_id
              FROM {lineitem}) a""",
    "masses": """
        SELECT l_orderkey AS receipt_id, CASE l_linenumber % 4 WHEN 1 THEN 0 WHEN 2 THEN 270 WHEN 3 THEN 90 ELSE 180 END AS deg,
               avg(l_tax) / 100 AS det_mass, count(*) AS n
        FROM {lineitem} GROUP BY 1, 2""",
    # Image and crop sizes.
    "sizes": """
        SELECT p_partkey AS image_id, CAST(p_size * 97 - 90 AS BIGINT) AS w, CAST(floor(p_retailprice * p_size / 12) AS BIGINT) AS h,
               CASE p_type WHEN 'SMALL' THEN 90 WHEN 'MEDIUM' THEN 180 WHEN 'LARGE' THEN 270 ELSE 0 END AS deg,
               CAST(p_size * 3 AS DOUBLE) AS rx, CAST(p_size * 2 AS DOUBLE) AS ry, CAST(p_size * 0.9 AS DOUBLE) AS rw,
               CAST((51 - p_size) * 0.7 AS DOUBLE) AS rh, CAST(p_retailprice / 300 AS DOUBLE) AS scale
        FROM {part}""",
    # Attempts and edits: events, key = user.
    "attempts": """
        SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, event_type = 'error' AS failed, event_type, value, props
        FROM {events}""",
    # Settings blobs, one per customer.
    "blobs": """
        SELECT c_custkey AS batch_id,
               CASE c_mktsegment
                    WHEN 'AUTOMOBILE' THEN '{{"codigoActivo":true,"codigoValor":"' || CAST(c_custkey AS STRING) || '","codigoPosicion":"sup-izq","moneda":"USD"}}'
                    WHEN 'BUILDING' THEN CASE WHEN c_nationkey < 12 THEN '{{"codigoValor":"' || CAST(c_nationkey AS STRING) || '","codigoPosicion":"centro"}}' ELSE '{{"codigoActivo":"true","codigoValor":5,"moneda":"EUR"}}' END
                    WHEN 'FURNITURE' THEN CASE WHEN c_nationkey < 12 THEN '{{"codigoActivo":true,"moneda":"XXX"}}' ELSE '{{"codigoActivo":false,"moneda":null}}' END
                    WHEN 'HOUSEHOLD' THEN CASE WHEN c_nationkey < 12 THEN '{{"configIA":{{"a":1}},"codigoLongitud":6}}' ELSE '{{"configIA":1,"moneda":"ARS","tema":"x"}}' END
                    ELSE CASE WHEN c_nationkey < 8 THEN '{{broken' WHEN c_nationkey < 16 THEN '[1,2]' ELSE '' END END AS payload
        FROM {customer}""",
}


def _sql(name: str, tables: dict[str, str]) -> str:
    return INPUTS[name].format(**tables, capacity=CAPACITY)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _derive(spark: SparkSession, name: str, read) -> DataFrame:
    for t in TABLES:
        if "{" + t + "}" in INPUTS[name]:
            read(t).createOrReplaceTempView(f"slipstack_in_{t}")
    return spark.sql(_sql(name, {t: f"slipstack_in_{t}" for t in TABLES}))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input as a DataFrame."""
    return _derive(spark, name, lambda t: table(spark, folder, t))


def load_stream(spark: SparkSession, folder: str, name: str, files: int = 50) -> DataFrame:
    """An input as a stream over the same files (inputs without grouping), some files at a time."""

    def read(t: str) -> DataFrame:
        schema = table(spark, folder, t).schema
        found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
        return found.option("pathGlobFilter", f"{t}.parquet").parquet(folder)

    return _derive(spark, name, read)


def cte(*names: str) -> str:
    """The inputs as SQL common table expressions over the plain tables."""
    plain = {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({_sql(n, plain)})" for n in names) + "\n"
