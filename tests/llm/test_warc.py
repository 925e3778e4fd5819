import hashlib
import base64

from lodestone.llm.warc import deduplicate, read_archives, write_archives
from lodestone.plans.storage import fresh_dir

SCHEMA = "page_id long, url string, html string, digest string"


def test_revisits(spark):
    rows = [(5, "u5", "x"), (2, "u 2", "x"), (9, None, "x"), (3, "u3", None), (4, "u4", ""), (7, "u7", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "long " * 50_000), (2, "u2b", "x"), (None, "n", "x"), (None, "m", "only")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(map(tuple, deduplicate(pages).collect()), key=str)
    want = []
    first = {"x": 2, "": 3}
    seen = set()
    for page, _, html in rows:
        p = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        origin = first.get(html or "", page)
        response = page == origin and (page, d) not in seen
        seen.add((page, d))
        want.append((page, len(p), d, "response" if response else "revisit", None if response else origin))
    assert got == sorted(want, key=str)


def test_empty_and_headers(spark):
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    folder = fresh_dir(spark, "warc-test")
    files = write_archives(spark.createDataFrame([(1, "u", "a", ""), (2, "v", "a", "")], SCHEMA), folder)
    kinds = {r.page_id: (r.record_type, r.refers_to_record, r.record_id) for r in read_archives(files, folder).collect()}
    assert kinds[2][0] == "revisit" and kinds[2][1] == kinds[1][2]
