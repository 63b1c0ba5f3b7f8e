import base64
import hashlib
import io
import random

import pytest

from tramline.llm import warc
from tramline.llm.common import Workspace


def test_round_trip(spark):
    rng = random.Random(1)
    html = [f"<p>{rng.random()}</p>" * rng.randint(1, 50) for _ in range(30)]
    rows = [(i, f"http://x/{i} y\r\nEvil: 1" if i % 3 else None, html[i % 20], "z", "z") for i in range(40)] + [(100, "u", None, "z", "z"), (101, "u", "", "z", "z"), (None, "u", html[1], "z", "z"), (None, "u", "<i>own</i>", "z", "z"), (3, "u", html[3], "z", "z"), (200, "u", "ß 🙂" * 200_000, "z", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string")
    work = Workspace(spark, "t")
    for least in (0, 10**6):
        manifest = work.store(warc.write_archives(pages, work.path("a"), least, file_bytes=3000), "m")
        assert manifest.count() > 3
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()]
        first = {}
        for i, _, h, *_ in rows:
            p = (h or "").encode()
            if i is not None:
                first[p] = min(first.get(p, i), i)
        want = []
        for i, _, h, *_ in rows:
            p = (h or "").encode()
            other = first.get(p) if len(p) >= least and first.get(p) != i else None
            want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if other is None else "revisit", other))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archives(work.store(warc.write_archives(pages.limit(0), work.path("b")), "m")).count() == 0


def test_damage_is_found():
    good = [warc.record_bytes(1, "u", b"abc" * 100, None), warc.record_bytes(2, "u", b"abc" * 100, 1)]
    data = b"".join(warc.gzip_member(x, 6) for x in good)
    read = lambda d: [warc.page_of(*r) for r in warc.read_records(io.BytesIO(d), 7)]
    assert [r[4] for r in read(data)] == ["response", "revisit"]
    for bad in (
        data[:-5],
        warc.gzip_member(good[0].replace(b"abcabc", b"abdabc", 1), 6),
        warc.gzip_member(good[0][:-4], 6),
        warc.gzip_member(good[0] + b"x", 6),
        warc.gzip_member(good[0].replace(b"WARC/1.1", b"XXXX/1.1"), 6),
        b"\x00" * 50,
    ):
        with pytest.raises(warc.WarcError):
            read(bad)
