"""The web data source against a local server."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quern.sources.web import WebPages


@pytest.fixture(scope="module")
def server():
    hits, times = Counter(), []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            hits[self.path] += 1
            times.append(time.time())
            if self.path.startswith("/moved"):
                self.send_response(302)
                self.send_header("Location", "/a" if self.path == "/moved-listed" else "/secret")
                self.end_headers()
                return
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(f"<p>{self.path}</p>".encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", f"http://localhost:{s.server_port}", hits, times
    s.shutdown()


def test_batch(spark, server):
    one, two, hits, times = server
    spark.dataSource.register(WebPages)
    urls = [f"{one}/a", f"{one}/b", f"{one}/none", f"{one}/moved-listed", f"{one}/moved-away", f"{two}/a", f"{one}/a"]
    times.clear()
    df = spark.read.format("web_pages").option("urls", "\n".join(urls)).option("pace", "0.2").load()
    assert df.rdd.getNumPartitions() == 2  # one a host
    hits.clear()
    got = {r["url"]: r for r in df.collect()}
    assert set(got) == set(urls)
    assert got[f"{one}/a"]["http_status_code"] == 200 and bytes(got[f"{one}/a"]["body"]) == b"<p>/a</p>" and got[f"{one}/a"]["content_length"] == 9
    assert (got[f"{one}/none"]["fetch_status"], got[f"{one}/none"]["http_status_code"]) == ("failed", 404)
    assert got[f"{one}/moved-listed"]["fetch_status"] == "success" and got[f"{one}/moved-away"]["fetch_status"] == "failed"
    assert hits["/secret"] == 0 and hits["/b"] == 1
    assert max(times) - min(times) >= 4 * 0.2
    assert spark.read.format("web_pages").load().count() == 0


def test_stream_reads_a_round_once(spark, server, tmp_path):
    one, _, hits, _ = server
    spark.dataSource.register(WebPages)

    def poll():
        stream = spark.readStream.format("web_pages").option("urls", f"{one}/p\n{one}/q").option("pace", "0").option("every", "100000").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    hits.clear()
    assert poll().count() == 2
    before = dict(hits)
    assert poll().count() == 2 and dict(hits) == before == {"/p": 1, "/q": 1}
