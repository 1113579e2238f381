"""Registered queries: files, admission, quarantine, pages, notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import quads
from slipstack.operators import composed
from slipstack.operators import intake as op
from slipstack.plans.grids import PX, pictures
from slipstack.plans.inputs import cte, load, table
from slipstack.sinks import blobs
from slipstack.sources.files import bitmap, images, listing
from slipstack.streaming.runner import scratch


def _files(spark, d):
    return load(spark, d, "files")


def _admitted(spark, d):
    return op.split(op.classify(_files(spark, d)))[0].filter("kind = 'pdf'")


def s01(spark, d):
    """The pages written out as one file each, then listed with size and head."""
    folder = scratch(spark, "pages")
    blobs.register(spark)
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    pages = table(spark, d, "pages").select(name.alias("name"), F.col("html").cast("binary").alias("content"))
    pages.write.format(blobs.FORMAT).mode("append").save(folder)
    found = listing(spark, folder, "pages")
    return found.select(F.regexp_extract("name", r"^(-?\d+)", 1).cast("bigint").alias("page_id"), "size", "head_hex")


def s02(spark, d):
    """Pictures written as bitmaps, some of them cut off, then read back: sizes and pixels, or the reason they are refused."""
    folder = scratch(spark, "pictures")
    blobs.register(spark)
    whole = bitmap(F.col("data"), F.col("w"), F.col("h"))
    content = F.when(F.col("image_id") % 10 == 3, F.substring(whole, 1, 40)).otherwise(whole)
    name = F.concat(F.col("image_id").cast("string"), F.lit(".bmp"))
    pictures(spark, d).select(name.alias("name"), content.alias("content")).write.format(blobs.FORMAT).mode("append").save(folder)
    good, bad = images(spark, folder)
    number = lambda path: F.regexp_extract(path, r"(-?\d+)\.bmp$", 1).cast("bigint").alias("image_id")
    shown = good.select(number(F.col("origin")), "width", "height", F.hex("data").alias("bgr"), F.lit(None).cast("string").alias("reason"))
    return shown.unionByName(bad.select(number(F.col("path")), "reason"), allowMissingColumns=True)


def s03(spark, d):
    images = _files(spark, d).filter(op.is_image(F.col("mime")))
    others = _files(spark, d).filter(~op.is_image(F.col("mime"))).drop("trimmed")
    return op.unite(images, None, others).select("batch_id", "seq", "name")


def f01(spark, d):
    return _files(spark, d).select("seq", op.is_image(F.col("mime")).alias("is_image"))


def f02(spark, d):
    return _files(spark, d).select("seq", op.is_pdf(F.col("mime"), F.col("name")).alias("is_pdf"))


def f03(spark, d):
    return _files(spark, d).select("seq", op.route(F.col("mime"), F.col("name")).alias("kind"))


def f04(spark, d):
    direct = op.is_direct_format(F.col("mime"), F.unhex("head_hex"))
    return _files(spark, d).select("seq", direct.alias("direct"))


def f05(spark, d):
    return _files(spark, d).filter(op.size_admits(F.col("size"))).select("seq", "size")


def f06(spark, d):
    return op.classify(_files(spark, d)).filter("kind = 'pdf'").select("seq", "reason")


def f07(spark, d):
    admitted = _admitted(spark, d)
    made = op.receipts_from_pages(admitted, load(spark, d, "page_measures"))
    return op.files_without_pages(admitted, made).select("seq", "reason")


def f08(spark, d):
    safe = quads.is_safe_page(F.col("width"), F.col("height"))
    return load(spark, d, "page_measures").select("seq", "page_no", safe.alias("safe"))


def f11(spark, d):
    direct = op.is_direct_format(F.col("mime"), F.unhex("head_hex"))
    kept = op.passes_through(direct, F.col("img_w"), F.col("img_h"), F.col("trimmed"))
    return _files(spark, d).select("seq", kept.alias("kept"))


def j01(spark, d):
    rejected = op.split(op.classify(_files(spark, d)))[1]
    return op.with_reason_text(rejected).select("seq", "title", "detail")


def s10(spark, d):
    return op.quarantine(op.split(op.classify(_files(spark, d)))[1])


def us1(spark, d):
    ok, bad = op.split(op.classify(_files(spark, d)))
    both = ok.withColumn("side", F.lit("accepted")).unionByName(bad.withColumn("side", F.lit("rejected")))
    return both.groupBy("batch_id", "side").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def p01(spark, d):
    return op.fan_out(_admitted(spark, d)).select(
        "seq", F.col("page_no").cast("bigint").alias("page_no"), F.col("page_total").cast("bigint").alias("page_total")
    )


def j11(spark, d):
    made = op.receipts_from_pages(_admitted(spark, d), load(spark, d, "page_measures"))
    return made.select("batch_id", "seq", F.col("page_no").cast("bigint").alias("page_no"), "name")


def c23(spark, d):
    named = op.page_name(F.col("name"), F.col("page_no"), F.col("page_total"))
    return op.fan_out(_admitted(spark, d)).select("seq", named.alias("name"))


def a16(spark, d):
    refused = op.quarantine(op.split(op.classify(_files(spark, d)))[1])
    fine_batches = F.concat_ws("/", "batch_id", "title")
    notices = refused.select(
        fine_batches.alias("batch_id"), "seq", "title", "file",
        F.when(F.col("batch_id") != "PROMO", "intake").alias("grp"),
    )
    return op.notice_digest(notices)


# What was read on a page: nothing, one amount, two amounts, or a failure.
READ = "CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'TOTAL ' || CAST(seq AS STRING) || '.50' WHEN 2 THEN 'TOTAL 1.00 PROPINA 2.00' ELSE 'x 3.00' END AS text"
BROKEN = "CASE WHEN seq % 4 = 3 THEN 'decoder' END AS ocr_error"


def intake_to_totals(spark, d):
    """Files to pages, receipts, sheets and totals in one plan."""
    pages = load(spark, d, "page_measures")
    numbers = pages.select("seq", F.col("page_no").cast("int").alias("page_no")).unionByName(_files(spark, d).select("seq", F.lit(0).alias("page_no")))
    texts = numbers.selectExpr("seq", "page_no", READ, BROKEN)
    return composed.batch_report(_files(spark, d), pages, texts)


QUERIES = {
    "intake-to-totals": intake_to_totals,
    "S-01": s01, "S-02": s02, "S-03": s03, "S-10": s10, "U-S1": us1, "F-01": f01, "F-02": f02, "F-03": f03, "F-04": f04,
    "F-05": f05, "F-06": f06, "F-07": f07, "F-08": f08, "F-11": f11, "J-01": j01, "J-11": j11, "C-23": c23,
    "P-01": p01, "A-16": a16,
}

FILES = cte("files")
IMAGE = "regexp_full_match(mime, '(?i)image/(jpeg|png|webp|bmp|gif)')"
PDF = "(mime = 'application/pdf' OR lower(name) LIKE '%.pdf')"
KIND = f"CASE WHEN {IMAGE} THEN 'image' WHEN {PDF} THEN 'pdf' ELSE 'unsupported' END"
REASON = (
    "CASE WHEN size = 0 THEN 'ilegible' WHEN size > 5242880 THEN 'tamano' WHEN open_error = 'password' THEN 'cifrado' "
    "WHEN open_error IS NOT NULL THEN 'ilegible' WHEN page_count > 10 THEN 'paginas' END"
)
DIRECT = (
    "CASE WHEN trim(lower(mime)) <> '' THEN trim(lower(mime)) IN ('image/jpeg', 'image/png', 'image/webp') "
    "ELSE length(head_hex) >= 8 AND (head_hex LIKE 'FFD8FF%' OR head_hex LIKE '89504E470D0A1A0A%' "
    "OR head_hex LIKE '52494646________57454250%') END"
)
JUDGED = (
    f"judged AS (SELECT *, {KIND} AS kind, CASE {KIND} WHEN 'unsupported' THEN 'formato' WHEN 'pdf' THEN {REASON} END AS reason FROM files)"
)
REFUSALS = [(k, *v) for k, v in fixed.REASONS.items()] + [("formato", fixed.FORMAT_TITLE, fixed.FORMAT_TEXT)]
TEXTS = "texts(reason, title, detail) AS (VALUES " + ", ".join(map(str, REFUSALS)) + ")"
WITH = FILES.rstrip() + ",\n" + JUDGED + ",\n" + TEXTS + "\n"
VIEW = "NOT isnan({w}) AND NOT isnan({h}) AND {w} >= 1 AND {h} >= 1 AND {h} <= 4000 AND {w} * {h} <= 8000000"
SAFE = (
    "coalesce(" + VIEW.format(w="width", h="height") + " AND "
    + VIEW.format(w="(width * (720.0::DOUBLE / width))", h="(height * (720.0::DOUBLE / width))") + ", false)"
)
PAGES = (
    cte("files", "page_measures").rstrip() + ",\n" + JUDGED
    + ",\n fan AS (SELECT batch_id, seq, name, page_count, unnest(generate_series(1, page_count)) AS page_no FROM judged "
    "WHERE kind = 'pdf' AND reason IS NULL AND page_count BETWEEN 1 AND 10)"
    + f",\n made AS (SELECT batch_id, seq, page_no, regexp_replace(name, '(?i)\\.pdf$', '') || ' p.' || page_no || '/' || page_count AS name "
    f"FROM fan JOIN (SELECT seq, page_no FROM page_measures WHERE {SAFE} AND white_ratio < 0.995 AND black_ratio < 0.995) USING (seq, page_no))\n"
)
ORACLES = {
    "intake-to-totals": PAGES.rstrip() + f""", rec AS (SELECT batch_id, seq FROM made UNION ALL SELECT batch_id, seq FROM judged WHERE kind = 'image' AND reason IS NULL),
        a AS (SELECT batch_id, count(*) AS n, count(*) FILTER (seq % 4 = 1) AS w, sum(CASE WHEN seq % 4 = 1 THEN seq * 100 + 50 ELSE 0 END) AS s FROM rec GROUP BY batch_id),
        no AS (SELECT batch_id, count(*) AS n FROM judged WHERE seq NOT IN (SELECT seq FROM rec) GROUP BY batch_id)
        SELECT batch_id, coalesce(a.n, 0) AS receipts, coalesce(w, 0) AS with_amount, CAST(coalesce(s, 0) AS BIGINT) AS total_cents,
        CAST(coalesce(ceil(a.n / {len(fixed.LAYOUTS[fixed.DEFAULT_LAYOUT][2])}), 0) AS BIGINT) AS sheets, coalesce(no.n, 0) AS refused FROM a FULL JOIN no USING (batch_id)""",
    # A text file ends with a line feed.
    "S-01": f"SELECT page_id, strlen(html) AS size, CASE WHEN strlen(html) <= {fixed.MAX_DOCUMENT_BYTES} THEN left(hex(encode(html)), 24) END AS head_hex FROM pages",
    "S-02": PX + """ SELECT image_id, CASE WHEN image_id % 10 <> 3 THEN 8 END AS width, CASE WHEN image_id % 10 <> 3 THEN 8 END AS height,
        CASE WHEN image_id % 10 <> 3 THEN string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY i) END AS bgr, CASE WHEN image_id % 10 = 3 THEN 'ilegible' END AS reason FROM px GROUP BY image_id""",
    "S-03": FILES + "SELECT batch_id, seq, name FROM files",
    "S-10": WITH + "SELECT batch_id, seq, name AS file, reason, title, detail FROM judged JOIN texts USING (reason)",
    "U-S1": WITH + "SELECT batch_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS side, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM judged GROUP BY 1, 2",
    "F-01": FILES + f"SELECT seq, {IMAGE} AS is_image FROM files",
    "F-02": FILES + f"SELECT seq, {PDF} AS is_pdf FROM files",
    "F-03": FILES + f"SELECT seq, {KIND} AS kind FROM files",
    "F-04": FILES + f"SELECT seq, {DIRECT} AS direct FROM files",
    "F-05": FILES + "SELECT seq, size FROM files WHERE size > 0 AND size <= 5 * 1024 * 1024",
    "F-06": WITH + "SELECT seq, reason FROM judged WHERE kind = 'pdf'",
    "F-07": PAGES + "SELECT seq, 'ilegible' AS reason FROM judged WHERE kind = 'pdf' AND reason IS NULL AND seq NOT IN (SELECT seq FROM made)",
    "F-08": cte("page_measures") + f"SELECT seq, page_no, {SAFE} AS safe FROM page_measures",
    "F-11": FILES + f"SELECT seq, {DIRECT} AND least(1.0, 2000.0 / greatest(img_w, img_h)) = 1.0 AND NOT trimmed AS kept FROM files",
    "J-01": WITH + "SELECT seq, title, detail FROM judged JOIN texts USING (reason)",
    "J-11": PAGES + "SELECT batch_id, seq, page_no, name FROM made",
    "C-23": PAGES + "SELECT seq, regexp_replace(name, '(?i)\\.pdf$', '') || ' p.' || page_no || '/' || page_count AS name FROM fan",
    "P-01": PAGES + "SELECT seq, page_no, CAST(page_count AS BIGINT) AS page_total FROM fan",
    "A-16": WITH.rstrip() + """, n AS (SELECT batch_id || '/' || title AS batch_id, seq, title, name AS file, CASE WHEN batch_id <> 'PROMO' THEN 'intake' END AS grp FROM judged JOIN texts USING (reason)),
        r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY batch_id) AS total FROM n)
        SELECT batch_id, k AS position, title, file, grp FROM r WHERE total <= 4 OR k <= 3
        UNION ALL SELECT batch_id, 4, '…y ' || (total - 3) || ' más descartados', NULL, grp FROM r WHERE k = 1 AND total > 4""",
}
