"""The page source as a stream: each url is fetched once, a stopped run goes on, errors are rows and tried again."""

import collections
import http.server
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire import jobs
from quire.sources import pages
from quire.streaming import incremental


@pytest.fixture
def site():
    asked, gone = collections.Counter(), {"/p3"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            self.send_response(404 if self.path in gone else 200)
            self.end_headers()
            if self.path not in gone:
                self.wfile.write(f"<p>é {self.path}</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, gone
    server.shutdown()


def urls(spark, base, *numbers):
    return spark.createDataFrame([(f"{base}/p{n}",) for n in numbers], "url string")


def test_each_url_once(spark, site, tmp_path):
    base, asked, gone = site
    args = [str(tmp_path / x) for x in ("queue", "cache", "check")]
    options = {"delay": "0", "tries": "1", "pertask": "4"}
    assert pages.cached(spark, args[1]).count() == 0
    assert pages.fetch(urls(spark, base, *range(10), 2, 2), *args, **options) == 10
    assert pages.fetch(urls(spark, base, *range(10)), *args, **options) == 1
    assert asked == {f"/p{i}": 1 + (i == 3) for i in range(10)}
    gone.clear()
    assert pages.fetch(urls(spark, base, *range(12)), *args, **options) == 3
    assert asked == {f"/p{i}": 1 + 2 * (i == 3) for i in range(12)}
    got = {r.url: r.html for r in pages.cached(spark, args[1]).collect()}
    assert got == {f"{base}/p{i}": f"<p>é /p{i}</p>" for i in range(12)}
    errors = spark.read.parquet(args[1]).where("error IS NOT NULL").collect()
    assert [(r.url, r.html, "404" in r.error) for r in errors] == [(f"{base}/p3", None, True)] * 2


def test_goes_on_after_a_stop(spark, site, tmp_path):
    base, asked, _ = site
    queue, cache, check = (str(tmp_path / x) for x in ("queue", "cache", "check"))
    pages.register(spark)
    assert pages.add_urls(urls(spark, base, 10, 11), queue) == 2
    go = lambda **kw: incremental.ingest(spark, queue, pages.SCHEMA, cache, check, fmt="quire-pages", options={"table": queue, "delay": "0"}, **kw)
    assert go() == 2
    pages.add_urls(urls(spark, base, 12, 13, 14), queue)
    with pytest.raises(PySparkException):
        go(transform=lambda d: d.where(F.raise_error(F.lit("stop")).cast("string").isNull()))
    before = dict(asked)
    # The rest is fetched by the next call, which gets the same urls and two more.
    assert pages.fetch(urls(spark, base, *range(10, 17)), queue, cache, check, delay="0") == 5
    assert asked["/p10"] == asked["/p11"] == asked["/p15"] == asked["/p16"] == 1
    assert all(asked[f"/p{i}"] == before.get(f"/p{i}", 0) + 1 for i in (12, 13, 14))
    assert spark.read.parquet(cache).count() == pages.cached(spark, cache).count() == 7


def test_job_with_a_limit(spark, site, tmp_path, capsys):
    base, asked, _ = site
    urls(spark, base, *range(20, 30)).write.parquet(str(tmp_path / "u"))
    args = ["fetch", *[str(tmp_path / x) for x in ("u", "q", "c", "k")], "--delay", "0"]
    assert jobs.main([*args, "--limit", "4"]) == 0 and sorted(asked) == [f"/p{i}" for i in range(20, 24)]
    assert jobs.main(args) == 0 and max(asked.values()) == 1 and len(asked) == 10
    assert capsys.readouterr().out.split() == ["4", "6"]
