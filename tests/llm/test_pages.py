"""Web archives and the URL filter."""

import hashlib
import re
import random

import duckdb
import pytest

from ruletrace.llm import url_filter, warc
from ruletrace.llm.common import shared_path
from ruletrace.llm.queries import ORACLE, QUERIES

PAGES = "page_id long, url string, html string, digest string, keeper int, file string, host string, label int"


def page_rows():
    big, other = "<p>é " * 400, "x" * 1000
    rows = [(1, "http://a.org/1", big), (2, "http://a.org/2", big), (5, "http://b.org/ \n", big), (3, None, "small"),
            (4, "http://b.org", "small"), (6, "ftp", None), (7, "u", ""), (8, "u", other), (9, "u", other + "y"),
            (10, "u", other), (10, "u", other), (None, "v", other), (None, "v", "nobody" * 300), (None, "v", "nobody" * 300),
            (11, "long", "z" * 3_000_000)]
    return rows


def pages(spark, rows=None):
    rows = page_rows() if rows is None else rows
    return spark.createDataFrame([(*r, "d", 1, "f", "h", 2) for r in rows], PAGES).repartition(3)


def test_records_come_back_whole(spark):
    folder = shared_path(spark, "warc-test")
    index = warc.write(pages(spark), folder)
    got = warc.read(index).collect()
    texts = sorted(((r[0], (r[2] or "").encode()) for r in page_rows()), key=repr)
    keep = {}
    for i, t in texts:
        if len(t) >= 1000 and i is not None:
            keep[t] = max(keep.get(t, i), i)
    want = sorted(((i, len(t), hashlib.sha1(t).hexdigest(), *(("revisit", keep[t]) if keep.get(t, i) != i else ("response", None)))
                   for i, t in texts), key=repr)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == want
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert {r["target_uri"] for r in got if r["page_id"] == 5} == {"http://b.org/%20%0A"}
    # Any selection of the index is read alike, and no more files than it names.
    some = warc.read(index.where("page_id IN (1, 7, 9)"), payload=False)
    assert sorted(r["page_id"] for r in some.collect()) == [1, 7, 9]
    ends = index.selectExpr("file", "offset", "offset + length AS stop").collect()
    starts = {(r["file"], r["offset"]) for r in ends}
    assert len(starts) == len(ends) and sum((r["file"], r["stop"]) not in starts for r in ends) == len({r["file"] for r in ends})


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 9), ("b", 209, 3), ("b", 212, 99)]
    assert list(warc.ranges(rows, gap=30, most=100)) == [
        ("a", 0, 45, [0, 1, 2]), ("a", 200, 209, [3]), ("b", 209, 212, [4]), ("b", 212, 311, [5])]


def test_archives_of_no_pages(spark):
    assert warc.read(warc.write(pages(spark, []), shared_path(spark, "warc-none"))).count() == 0


def test_a_damaged_record_is_refused():
    raw, _ = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parsed(__import__("gzip").compress(raw.replace(b"payload", b"pavload")))


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def url_rows():
    rng = random.Random(9)
    hosts = ["example.com", "www.example.com", "x.www.Example.COM", "notexample.com", "a.net", "net", "b.org", "com", "É.com", "a.com:80"]
    paths = ["/en/1", "/en/", "/en", "/es/2", "/fr/3", "", "/de/x", "?q=/en/", "#/es/", "/EN/1"]
    rows = [(i, f"{rng.choice(['http', 'https', 's://t'])}://{rng.choice(hosts)}{rng.choice(paths)}", "") for i in range(300)]
    return rows + [(300, None, ""), (301, "", ""), (302, "no scheme/en/", ""), (303, "http://", ""), (304, "a://b\n.com/\nen", ""),
                   (None, "http://example.com/en/", ""), (1, rows[1][1], ""), (305, "http://x.org/" + "y" * 200_000, "")]


def test_rules_and_parts(spark):
    got = url_filter.url_filter(pages(spark, url_rows())).collect()
    want = []
    for i, url, _ in url_rows():
        host, path = plain_parts(url)
        want.append((i, host, path, *plain_rule(host, path)))
    have = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got), key=repr)
    assert have == sorted(want, key=repr)
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_model_learns_from_a_labelled_table(spark):
    rng = random.Random(1)
    bad = [f"http://{rng.choice(['casino', 'spam', 'win'])}{rng.randrange(999)}.org/offer/{rng.randrange(99)}" for _ in range(150)]
    good = [f"http://{rng.choice(['school', 'library', 'museum'])}{rng.randrange(999)}.org/page/{rng.randrange(99)}" for _ in range(150)]
    labelled = spark.createDataFrame([(u, 1) for u in bad[:100]] + [(u, 0) for u in good[:100]] + [(None, 1), ("http://x.org", None)],
                                     "url string, label int")
    got = url_filter.url_filter(pages(spark, [(i, u, "") for i, u in enumerate(bad[100:] + good[100:])]), labelled).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] < 50) for r in got) >= 97


def test_without_labels_or_rows(spark):
    only = url_filter.url_filter(pages(spark, [(1, "http://b.org/x", "")])).collect()
    assert [(r["verdict"], r["block_score"]) for r in only] == [("allow", 0.0)]
    assert url_filter.url_filter(pages(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).df()
    plain = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
                              .itertuples(index=False, name=None), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
