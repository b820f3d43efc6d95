"""Merkle audit against a record-by-record comparison."""

import random

import pytest
from pyspark.sql import functions as F

from tickwise.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_finds_what_changed(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, f"http://h/{i}" if i % 9 else None, "x" * rng.randint(0, 200) if i % 11 else None) for i in range(160)]
    other = [(i, u, h) for i, u, h in rows if i not in (77, 140)]
    other = [(i, u, "y" + h[1:] if i in (3, 50) and h else h) for i, u, h in other] + [(1000, "http://new", "n")]
    file = F.expr("abs(page_id) div 40 % 4")
    got = warc.audit(warc.layout(pages(spark, rows), file), warc.layout(pages(spark, other), file), fanout).collect()
    a, b = ({r.id: r for r in warc.layout(pages(spark, x), file).collect()} for x in (rows, other))
    for r in got:
        mine, theirs = a.get(r.id), b.get(r.id)
        want = ("extra" if not mine else "missing" if not theirs else "corrupt" if mine.digest != theirs.digest
                else "intact" if (mine.seq, mine.offset) == (theirs.seq, theirs.offset) else "moved")
        assert r.status == want, r
    assert len(got) == 161 and {r.id for r in got if r.status == "corrupt"} == {3, 50}


@pytest.mark.parametrize("fanout", [2, 16])
def test_records_without_an_id_are_audited(spark, fanout):
    file = F.expr("abs(page_id) div 1000")
    rows = [(i, f"u{i}", "x" * 20) for i in range(5)]

    def statuses(mine, theirs):
        found = warc.audit(warc.layout(pages(spark, rows + mine), file), warc.layout(pages(spark, rows + theirs), file), fanout)
        got = found.collect()
        assert [r.status for r in got if r.id is not None] == ["intact"] * 5
        assert all(r.file is None for r in got if r.id is None)
        return sorted(r.status for r in got if r.id is None)

    one, other = (None, "n", "page"), (None, "n", "pagf")
    assert statuses([one], [one]) == ["intact"]
    assert statuses([one], [other]) == ["corrupt"]
    assert statuses([one], []) == ["missing"]
    assert statuses([], [one]) == ["extra"]
    assert statuses([(None, f"n{i}", "page") for i in range(40)], []) == ["missing"] * 40


def test_layout_offsets_follow_the_records(spark):
    rows = [(2, "u", "héé"), (1, "v", ""), (None, None, None), (2, "u", "héé")]
    got = sorted(warc.layout(pages(spark, rows), F.lit(0)).collect(), key=lambda r: r.seq)
    assert [r.id for r in got] == [None, 1, 2, 2]
    assert all(x.offset + x.length == y.offset for x, y in zip(got, got[1:], strict=False))
    assert got[2].length == len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\n"
                                "Content-Length: 5\r\n\r\nhéé\r\n\r\n".encode())


def test_same_archives_and_empty(spark):
    p = pages(spark, [(i, "u", "h") for i in range(50)])
    file = warc.file_of(p, per_file=10)
    one = warc.layout(p, file)
    assert {r.status for r in warc.audit(one, one).collect()} == {"intact"}
    empty = warc.layout(p.limit(0), F.lit(0))
    assert warc.audit(empty, empty).count() == 0
    assert {r.status for r in warc.audit(one, empty).collect()} == {"missing"}
    assert {r.status for r in warc.audit(empty, one).collect()} == {"extra"}
