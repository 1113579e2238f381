from __future__ import annotations

import random
import textwrap
import time

import pytest
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import licenses


def confirmed(text):
    return sorted(b.name for _, _, b in licenses.blocks_of(text) if b.confirmed)


def test_every_notice_is_found_in_prose(make_docs):
    rows = [(k, f"{prose(k, 60)}\n{text}\n{prose(k + 50, 40)}") for k, text in enumerate(licenses.NOTICES.values())]
    out = licenses.scan(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.license, r.confirmed, r.differing_words) for r in out) == [(k, n, True, 0) for k, n in enumerate(licenses.NOTICES)]
    for r in out:
        assert rows[r.doc_id][1][r.block_start : r.block_start + r.block_chars].split()[0] == licenses.NOTICES[r.license].split()[0]


@pytest.mark.parametrize("sign", ["", " * ", "// ", "# ", "<!-- "])
def test_wrapped_and_commented_notices(sign):
    for name, text in licenses.NOTICES.items():
        for width in (30, 78):
            lines = "\n".join(sign + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
            assert confirmed(f"{prose(3, 30)}\n{lines}\n{prose(4, 30)}") == [name]


def test_notices_inside_one_long_line():
    for name, text in licenses.NOTICES.items():
        assert confirmed(f"{prose(1, 2000)} {text} {prose(2, 2000)}") == [name]
    both = f"{licenses.NOTICES['MIT']} {licenses.NOTICES['CC-BY-SA-4.0']} {licenses.NOTICES['ISC-full']} {licenses.NOTICES['MIT']}"
    assert confirmed(both) == ["CC-BY-SA-4.0", "ISC-full", "MIT", "MIT"]


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def brute(text):
    """Every notice that some run of words differs from by a tenth at most; those that lie in a longer one do not count."""
    words = [w.lower() for w in licenses.WORD.findall(text)]
    out = []
    for name, notice in licenses.NOTICES.items():
        want = [w.lower() for w in licenses.WORD.findall(notice)]
        most = int(len(want) * licenses.DIFFERING)
        for s in range(len(words)):
            for e in range(s + len(want) - most, min(len(words), s + len(want) + most) + 1):
                if len(want) + e - s - 2 * common(want, words[s:e]) <= most:
                    out.append((len(want), name))
                    break
            else:
                continue
            break
    return max(out)[1] if out else None


def test_changed_notices_against_every_run_of_words():
    draw = random.Random(8)
    short = [k for k, v in licenses.NOTICES.items() if len(v.split()) < 45]
    seen = {True: 0, False: 0}
    for case in range(60):
        name = draw.choice(short)
        words = licenses.NOTICES[name].split()
        for _ in range(draw.randint(0, 1 + len(words) // 8)):
            k = draw.randrange(len(words))
            # Words that do not mark are taken out, changed or put in.
            if not licenses.MARK.search(words[k]):
                words[k : k + 1] = draw.choice(([], ["changed"], [words[k], "more"]))
        text = f"{prose(case, 8)} {' '.join(words)} {prose(case + 1, 8)}"
        want = brute(text)
        assert confirmed(text) == ([want] if want else []), text
        seen[bool(want)] += 1
    assert min(seen.values()) > 10


def test_changed_wording():
    (found,) = [b for _, _, b in licenses.blocks_of("Licensed under CC BY-SA 4.0.")]
    assert (found.name, found.missing, found.extra, found.confirmed) == ("CC-BY-SA-4.0", [], [], True) and found.gain > 0.25
    long = licenses.NOTICES["MIT-text"]
    changed = long.replace("free of charge", "without any charge").replace("Software", "Work", 1)
    (found,) = [b for _, _, b in licenses.blocks_of(changed)]
    assert found.name == "MIT-text" and found.confirmed and {"free", "of"} <= set(found.missing) and {"without", "any"} <= set(found.extra)
    assert confirmed(" ".join(long.split()[:30])) == []
    assert confirmed("your licence to drive was renewed in spring") == []
    assert confirmed("Licensed under CC BY-XX 4.0.") == []


def test_blocks_cover_every_mark_in_order():
    text = "a\n" * 2000 + "copyright one\n" + "b " * 9000 + "license " * 400 + "c\n" + "warranty " + licenses.NOTICES["MIT"] + " _license_"
    found = list(licenses.blocks_of(text))
    kept = "".join(text[s : s + n] + "\n" for s, n, _ in found).lower()
    assert kept.count("copyright") + kept.count("license") + kept.count("warrant") == 404
    ends = [s + n for s, n, _ in found]
    assert all(e <= s for e, (s, _, _) in zip(ends, found[1:], strict=False))
    assert list(licenses.blocks_of("")) == [] and list(licenses.blocks_of("nothing here")) == [] and len(list(licenses.blocks_of("_licen"))) == 1


def test_texts_full_of_marks_take_time_in_proportion():
    start = time.monotonic()
    assert confirmed("license copyright " * 20_000 + licenses.NOTICES["MIT"]) == ["MIT"]
    assert time.monotonic() - start < 60


def test_rows_of_every_kind(make_docs):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, mit.upper()), (4, "x" * 50000 + " " + mit + " " + "y" * 50000), (5, "plain"), (6, "__ licen"), (7, "\u0130 " + mit)]
    docs = make_docs(rows).withColumn("license", F.lit("clash")).withColumn("block", F.lit("clash"))
    out = sorted(((r.doc_id, r.license, r.confirmed) for r in licenses.scan(docs).collect()), key=str)
    assert out == sorted([(3, "MIT", True), (3, "MIT", True), (None, "MIT", True), (4, "MIT", True), (6, None, False), (7, "MIT", True)], key=str)
    assert licenses.scan(docs.limit(0)).collect() == []
