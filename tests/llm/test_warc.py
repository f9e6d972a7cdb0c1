import hashlib
import random

from pavescope.llm import warc
from pavescope.llm.warc import LoserTree, archived, capture_index, parse, record, url_key, write_archives


def test_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    bodies = ["x" * 999, "é" * 500, "y" * 1000, "", None, "\r\n\r\n<p>" * 300, "z" * 300_000]
    rows = [(i, rng.choice([None, "", "http://a.org/1", "http://b.a.org/é?q#f", "x://\n h/"]), rng.choice(bodies), 1, "k") for i in range(200)]
    rows += [(500, "u", "once " * 400, 1, "k"), (199, "u", rows[199][2], 1, "k"), (None, "u", "y" * 1000, 1, "k"), (None, "u", "only null " * 200, 1, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int, file string")
    first = {}
    for i, _, html, *_ in rows:
        if html and len(html.encode()) >= 1000:
            first[html] = max(first.get(html, -1), -1 if i is None else i)
    want = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        to = first.get(html) if html in first and first[html] >= 0 and first[html] != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    got = [tuple(r)[:5] for r in archived(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    lines = write_archives(pages, f"file://{tmp_path}/w", run_bytes=100_000)
    for size in (200_000, 7):  # in one range, and in many that cut histories
        monkeypatch.setattr(warc, "RANGE_LINES", size)
        index = [tuple(r) for r in capture_index(lines).orderBy("part", "url_key", "captured_at", "record", "file", "offset").collect()]
        assert len({r[3] for r in index}) > 3 and len(index) == len(rows)
        assert (len({r[6] for r in index}) > 5) == (size == 7)
        assert [r[:6] for r in index] == sorted(r[:6] for r in index)
        last = {}
        for key, _, record, _, _, _, _, place, before in index:
            assert (place - 1, before) == last.get(key, (0, None))
            last[key] = place, record
    history = {}
    for r in sorted(archived(pages).collect(), key=lambda r: (r.url_key, r.captured_at, str(r.page_id))):
        assert r.place == len(history.setdefault(r.url_key, [])) + 1
        history[r.url_key].append(r.page_id)
    assert archived(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_record():
    assert parse(record(7, "http://a/\r\nWARC-Type: x", b"ab", None))[:2] == (7, 2)
    assert parse(record(7, None, b"ab", 9))[3:] == ("revisit", 9)
    assert url_key("http://a.Example.org/x?q#f") == "org,example,a)/x?q"
