from __future__ import annotations

import collections
import struct
import zlib

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from slipstack.functions import pixels as px
from slipstack.functions import quads
from slipstack.operators import hooks
from slipstack.operators import intake as op
from slipstack.sinks import blobs
from slipstack.sinks import tables as sink
from slipstack.sources import files as src
from slipstack.streaming.runner import drain_to_table

MIB = 1024 * 1024
FILES = "batch_id string, seq bigint, name string, mime string, size bigint, page_count int, open_error string"


def _pdf(seq, size, pages, error=None):
    return ("b", seq, f"f{seq}.pdf", "application/pdf", size, pages, error)


GATE = [
    (_pdf(1, 5 * MIB, 1), None),
    (_pdf(2, 5 * MIB + 1, 1), "tamano"),
    (_pdf(3, MIB, 10), None),
    (_pdf(4, MIB, 11), "paginas"),
    (_pdf(5, MIB, 12), "paginas"),
    (_pdf(6, 6 * MIB, 12), "tamano"),
    (_pdf(7, MIB, None, "password"), "cifrado"),
    (_pdf(8, MIB, None, "other"), "ilegible"),
    (_pdf(9, 0, 1), "ilegible"),
    (("b", 10, "a.txt", "text/plain", 10, 1, None), "formato"),
    (("b", 11, "A.PDF", "application/octet-stream", 10, 1, None), None),
    (("b", 12, "a.jpg", "IMAGE/JPEG", 99 * MIB, None, None), None),
]


def test_gate(rows):
    got = op.classify(rows([f for f, _ in GATE], FILES))
    assert {r.seq: r.reason for r in got.collect()} == {f[1]: reason for f, reason in GATE}
    accepted, rejected = op.split(got)
    assert accepted.count() + rejected.count() == len(GATE)
    assert accepted.unionByName(rejected).exceptAll(got).isEmpty()
    notes = {r.seq: r.title for r in op.quarantine(rejected).collect()}
    assert notes[2] == "Archivo demasiado pesado" and notes[10] == "Formato no soportado" and len(notes) == 8


@pytest.mark.parametrize(
    "mime,head,want",
    [("image/png", "", True), (" IMAGE/WEBP ", "", True), ("image/bmp", "FFD8FFE0", False), ("", "FFD8FFE0", True), ("", "FFD8FF", False),
     ("", "89504E470D0A1A0A", True), ("", "89504E470D0A1A", False), (" ", "524946460000000057454250", True),
     ("", "524946460000000041564920", False), (None, "FFD8FFE0", True)],
)
def test_direct_format(rows, mime, head, want):
    df = rows([(mime, head)], "m string, h string")
    assert df.select(op.is_direct_format(F.col("m"), F.unhex("h"))).first()[0] is want


def test_pages_and_their_names(rows):
    files = rows([_pdf(1, 10, 3), _pdf(2, 10, 2), _pdf(3, 10, 0)], FILES)
    pages = rows(
        [(1, 1, 600.0, 800.0, 0.5, 0.1), (1, 2, 600.0, 800.0, 0.995, 0.0), (1, 3, 600.0, 800.0, 0.9949, 0.0),
         (2, 1, 1.0, 800.0, 0.5, 0.1), (2, 2, 600.0, 800.0, 0.2, 1.0)],
        "seq bigint, page_no int, width double, height double, white_ratio double, black_ratio double",
    )
    made = op.receipts_from_pages(files, pages)
    assert sorted(r.name for r in made.collect()) == ["f1 p.1/3", "f1 p.3/3"]
    assert sorted(r.seq for r in op.files_without_pages(files, made).collect()) == [2, 3]


@pytest.mark.parametrize("w,h,ok", [(612.0, 792.0, True), (1.0, 792.0, False), (float("nan"), 5.0, False), (1e6, 1e6, False), (float("inf"), 5.0, False), (None, 5.0, False), (0.0, 5.0, False)])
def test_safe_page(rows, w, h, ok):
    df = rows([(w, h)], "w double, h double")
    assert df.select(quads.is_safe_page(F.col("w"), F.col("h"))).first()[0] is ok


@pytest.mark.parametrize("n,shown,last", [(3, 3, None), (4, 4, None), (6, 4, "…y 3 más descartados")])
def test_notice_digest(rows, n, shown, last):
    df = rows([("b", i, f"t{i}", f"f{i}", "intake") for i in range(n)], "batch_id string, seq bigint, title string, file string, grp string")
    got = sorted(op.notice_digest(df).collect(), key=lambda r: r.position)
    assert len(got) == shown
    if last:
        assert got[-1].title == last and got[-1].grp == "intake" and got[-1].file is None


def test_unite_takes_missing_sources(rows):
    a = rows([("b", 1)], "batch_id string, seq bigint")
    assert op.unite(a, None, a.filter("false")).count() == 1


def _png(width, height, colour, alpha=False):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    line = b"\0" + bytes(colour) * width
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")


def test_image_source_and_listing(spark, tmp_path):
    (tmp_path / "white.png").write_bytes(_png(6, 5, (255, 255, 255)))
    (tmp_path / "blue.png").write_bytes(_png(6, 5, (10, 20, 200)))
    (tmp_path / "clear.png").write_bytes(_png(4, 4, (1, 2, 3, 0), alpha=True))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    good, bad = src.images(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == ["broken.png"]
    stats = good.withColumn("rgba", px.rgba_bytes("data", "nChannels")).withColumn("s", px.pixel_stats("rgba", "width", "height"))
    got = {r.origin.rsplit("/", 1)[-1]: (r.blank, r.dark) for r in stats.select("origin", px.is_blank(F.col("s")).alias("blank"), px.is_dark(F.col("s")).alias("dark")).collect()}
    assert got == {"white.png": (True, False), "blue.png": (False, False), "clear.png": (True, True)}
    first = good.filter(F.col("origin").endswith("blue.png")).select(F.hex(F.substring(px.rgba_bytes("data", "nChannels"), 1, 4))).first()[0]
    assert first == "0A14C8FF"
    listed = {r.name: (r.mime, r.size, r.head_hex[:8]) for r in src.listing(spark, str(tmp_path), "b").collect()}
    assert listed["broken.png"][:2] == ("image/png", 13) and listed["white.png"][2] == "89504E47"


def test_heads_are_read_behind_the_gate_in_batch_and_stream(spark, tmp_path):
    inside = tmp_path / "in" / "a b"
    inside.mkdir(parents=True)
    (inside / "näme 1.pdf").write_bytes(b"%PDF-1.7 and more")
    (inside / "empty.png").write_bytes(b"")
    (inside / "large.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    want = {("näme 1.pdf", 17, "255044462D312E3720616E64"), ("empty.png", 0, ""), ("large.pdf", 105, None)}
    told = lambda df: {(r.name, r.size, r.head_hex) for r in df.collect()}
    batch = src.listing(spark, str(tmp_path / "in"), "b", 50)
    assert told(batch) == want
    stream = src.listing_stream(spark, str(tmp_path / "in"), "b", 50, settle=0)
    assert told(drain_to_table(stream, str(tmp_path / "out"))) == want
    (tmp_path / "in" / "later.png").write_bytes(b"\x89PNG")
    (tmp_path / "in" / "_unfinished").mkdir()
    (tmp_path / "in" / "_unfinished" / "half.png").write_bytes(b"x")
    assert told(drain_to_table(stream, str(tmp_path / "out"))) == {*want, ("later.png", 4, "89504E47")}


def _names(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file())


def test_files_are_published_by_commit_and_dropped_by_abort(spark, rows, tmp_path):
    blobs.register(spark)
    folder = tmp_path / "refused"
    files = rows([(f"f{i}.bin", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    files.write.format(blobs.FORMAT).mode("append").save(str(folder))
    assert _names(folder) == sorted(f"f{i}.bin" for i in range(20)) and (next(folder.rglob("f7.bin"))).read_bytes() == b"\x07"
    with pytest.raises(Exception, match="not a file name"):
        rows([("good.bin", b"1"), ("../bad.bin", b"2")], "name string, content binary").write.format(blobs.FORMAT).mode("append").save(str(folder))
    assert len(_names(folder)) == 20 and not [p for p in folder.rglob("*") if "bad" in p.name or "good" in p.name]
    files.limit(3).write.format(blobs.FORMAT).mode("overwrite").save(str(folder))
    assert len(_names(folder)) == 3


def test_a_replayed_epoch_replaces_its_files(tmp_path):
    writer = blobs.StreamWriter(str(tmp_path))
    for content in (b"first", b"again"):
        staged = tmp_path / blobs.STAGING / writer.staged.run / f"task-{content.decode()}" / "0"
        staged.mkdir(parents=True)
        (staged / "a.bin").write_bytes(content)
        writer.commit([blobs.Written(f"{blobs.STAGING}/{writer.staged.run}/task-{content.decode()}", 1), None], 4)
    assert [p.read_bytes() for p in tmp_path.rglob("*.bin")] == [b"again"]
    writer.abort([], 5)


def test_bitmaps_are_read_back(spark, rows, tmp_path):
    blobs.register(spark)
    pixels = bytes(range(5 * 3 * 4))  # five pixels a row: rows are padded
    df = rows([("p.bmp", bytearray(pixels), 5, 3)], "name string, data binary, w int, h int")
    whole = df.select("name", src.bitmap(F.col("data"), F.col("w"), F.col("h")).alias("content"))
    whole.write.format(blobs.FORMAT).mode("append").save(str(tmp_path / "pictures"))
    good, bad = src.images(spark, str(tmp_path / "pictures"))
    (r,) = good.collect()
    assert (r.width, r.height, r.nChannels) == (5, 3, 3) and bad.count() == 0
    assert bytes(r.data) == b"".join(pixels[i : i + 3][::-1] for i in range(0, len(pixels), 4))


def test_sides_are_written_in_buckets(spark, rows, tmp_path):
    got = op.classify(rows([f for f, _ in GATE], FILES))
    accepted, rejected = op.split(got)
    sink.write_sides(accepted, op.quarantine(rejected), str(tmp_path), buckets=4)
    assert spark.read.parquet(f"{tmp_path}/accepted").count() == 4
    assert spark.read.parquet(f"{tmp_path}/rejects").filter("batch_id = 'b'").count() == 8


def test_hooks_turn_failures_into_data(rows):
    def count(data):
        if data == b"locked":
            raise PermissionError
        return int(data)

    df = rows([(1, b"3"), (2, b"locked"), (3, b"junk")], "seq int, content binary")
    got = {r.seq: (r.page_count, r.open_error) for r in hooks.with_page_counts(df, count).collect()}
    assert got == {1: (3, None), 2: (None, "password"), 3: (None, "other")}

    def score(frame):
        if (frame["width"] == 13).any():
            raise ValueError
        return frame[["width"]].assign(twice=frame["width"] * 2)

    def patchy(frame):
        return score(frame[frame["width"] != 50])

    lines = rows([(w,) for w in range(100)], "width bigint")
    got = {r.width: (r.twice, r.error) for r in hooks.scored(lines, patchy, "width bigint, twice bigint", "width", parts=3).collect()}
    want = {w: (2 * w, None) for w in range(100)} | {13: (None, "ValueError"), 50: (None, "no result")}
    assert got == want


def test_failing_lines_of_one_width_are_taken_apart_by_several_tasks(spark):
    def score(frame):
        if (frame["width"] == 40).any():
            raise ValueError(f"thin in {TaskContext.get().partitionId()}")
        return frame[["id"]].assign(twice=frame["width"] * 2)

    lines = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 50 * 8 + 400).alias("width"))
    got = hooks.scored(lines, score, "id bigint, twice bigint", "id", parts=4).collect()
    assert sorted((r.id, r.twice, r.error is not None) for r in got) == [
        (i, None if i % 3 == 0 else (i % 50 * 8 + 400) * 2, i % 3 == 0) for i in range(3000)
    ]
    tasks = collections.Counter(r.error for r in got if r.error)
    assert len(tasks) == 4 and max(tasks.values()) < 400
