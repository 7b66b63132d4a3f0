import pytest

from helpers import LONG
from marlstone.llm import warc as m

PAGES = [
    (1, "http://a.example/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "x\r\ny", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n0\r\n\r\n"),
    (6, "u", LONG), (7, "u", LONG), (None, "u", "<p>one</p>"), (None, "u", "alone"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "ünïcödé" * 9000), (10, "u", "\r\n" * 30000),
]


def expected(least=0):
    out = []
    for i, _, t in PAGES:
        data = (t or "").encode()
        same = [j for j, _, o in PAGES if (o or "") == (t or "") and j is not None]
        first = min(same) if same and len(data) >= least else None
        revisit = first is not None and first != i
        out.append((i, len(data), m.sha1_base32(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 700, "chunk_bytes": 64}, {"least_bytes": 8}])
def test_round_trip(spark, options):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, sha1 string, id string")
    got = m.archive_round_trip(pages, **options)
    assert rows(got) == expected(options.get("least_bytes", 0))
    texts = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert all(texts[i] == (t or "") for i, _, t in PAGES if i in texts)


def test_damage_is_noticed(spark):
    segments = [r for r in m.records("k", 1, "u", b"x" * 5000, m.sha1_base32(b"x" * 5000), None, 1000, 500)]
    assert len(segments) > 4

    def parsed(parts):
        out = []
        for p in parts:
            head, _, block = p.partition(b"\r\n\r\n")
            f = m._fields(head.removeprefix(m.VERSION))
            out.append((m._number(f, "warc-page-id"), f.get("warc-target-uri"), f["warc-type"], None, f.get("warc-payload-digest"), f.get("warc-segment-origin-id", f["warc-record-id"]), m._number(f, "warc-segment-number"), m._number(f, "warc-segment-total-length"), block))
        return spark.createDataFrame(out, m.PARSED)

    assert m.reassemble(parsed(segments[::-1])).first().payload == b"x" * 5000
    for bad in (segments[1:], segments[:-1], segments[:2] + segments[3:], segments + segments[1:2]):
        with pytest.raises(Exception, match="incomplete"):
            m.reassemble(parsed(bad)).collect()
    with pytest.raises(ValueError):
        m.unchunked(b"5\r\nabc")
    with pytest.raises(ValueError, match="inside"):
        list(m._raw(iter([b"", segments[0].removeprefix(m.VERSION)[:-10]])))


def test_empty(spark):
    assert m.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
