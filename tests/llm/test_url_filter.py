"""URL filters: oracle, exactness of cascades, several shards and passes, edge rows."""

import random

import numpy as np
import pytest
from helpers import same_rows

from quire.llm import url_filter
from quire.llm.url_filter import ask, build_cascade, judge_urls


def test_oracle(spark, sf):
    same_rows(spark, url_filter.op6_url_filter, url_filter.OP6_SQL, sf)


@pytest.mark.parametrize(("n", "m"), [(0, 10), (1, 0), (1, 5000), (3000, 200), (500, 500)])
def test_cascades_are_exact(n, m):
    rng = random.Random(n + m)
    keys = [f"k{rng.random()}" for _ in range(n + m)]
    levels = [(lv, a, k, np.frombuffer(b, np.uint8)) for lv, a, k, b in build_cascade(keys[:n], keys[n:])]
    assert ask(keys, levels).tolist() == [True] * n + [False] * m


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    cut = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def verdict(host, path, listed):
    fits = sorted(((h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: (-len(x[0]), x[0]))
    return (fits[0][0], fits[0][1]) if fits else (None, "block" if host in listed else "allow")


@pytest.mark.parametrize("small", [False, True])
def test_edge_rows(spark, small):
    urls = [None, "", "no scheme/x", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.Example.ORG/en/12?x#y", "x://b.example.org/es/q", "http://com/de/", "http://a.com/de", "http://a.com/fr/x#/de/",
            "ftp://notexample.org/es/", "http://bad.net?x=/", "http://bad.net/p" + "a" * 50_000, "http://a://b.org/de/", "http://É.com/fr/", "line\n://bad.net/x"] * 2
    pages = spark.createDataFrame([(i if i else None, u, "h", True) for i, u in enumerate(urls)], "page_id long, url string, host string, hits boolean")
    listed = spark.createDataFrame([("bad.net",), ("unseen.org",), (None,)], "host string")
    args = {"shard_keys": 20, "max_bytes": 200} if small else {}
    got = judge_urls(pages, listed, **args).collect()
    assert len(got) == len(urls)
    by = {r.page_id: r for r in got}
    for i, u in enumerate(urls):
        h, p = host_path(u)
        r = by[i or None]
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, *verdict(h, p, {"bad.net"})), u
    assert judge_urls(pages.limit(0), listed).collect() == []
    assert {r.verdict for r in judge_urls(pages, listed.limit(0)).where("host = 'bad.net'").collect()} == {"allow"}
