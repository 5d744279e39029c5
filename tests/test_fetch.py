"""Pages from a local server: time limits, retries, errors as rows, sites that are down."""

import http.server
import threading
import time

import pytest

from almanac.operators import ingest
from almanac.sources import fetch


@pytest.fixture(scope="module")
def server():
    """/ok, /busy (503 twice, then ok), /gone (404), /slow, /big, /latin; counts its calls by path."""
    calls: dict[str, int] = {}

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            calls[self.path] = n = calls.get(self.path, 0) + 1
            if self.path.startswith("/slow"):
                time.sleep(3)
            code = 404 if self.path == "/gone" else 503 if self.path.startswith("/busy") and n < 3 or self.path.startswith("/dead") else 200
            body = "café".encode("latin-1") if self.path == "/latin" else b"x" * 2000 if self.path == "/big" else f"<p>page {self.path}</p>".encode()
            try:
                self.send_response(code)
                self.send_header("Content-Type", "text/html; charset=" + ("latin-1" if self.path == "/latin" else "utf-8"))
                self.end_headers()
                self.wfile.write(body)
            except OSError:  # the reader has gone
                pass

        def log_message(self, *args):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", calls
    own.shutdown()


def test_site_pages(spark, server):
    """A registry of sites: a partition each; pages, retries and failures as rows, and a site that is down is left alone."""
    at, calls = server
    sites = [("good", [f"{at}/ok", f"{at}/busy", f"{at}/latin"]), ("mixed", [f"{at}/gone", f"{at}/slow", f"{at}/ok2", "no url"]), ("dead", [f"{at}/dead{k}" for k in range(6)]), ("nowhere", ["http://127.0.0.1:1/x"]), ("none", [])]
    df = fetch.site_pages(spark, sites, timeout=1, tries=3, pause=0.01, down=2)
    assert df.rdd.getNumPartitions() == 5
    got = {(r["source_slug"], r["url"].removeprefix(at)): (r["html"], r["error"], r["tries"]) for r in df.collect()}
    assert got["good", "/ok"] == ("<p>page /ok</p>", None, 1) and got["good", "/busy"] == ("<p>page /busy</p>", None, 3) and got["good", "/latin"][0] == "café"
    assert got["mixed", "/gone"] == (None, "HTTP 404", 1) and got["mixed", "/ok2"][0] == "<p>page /ok2</p>" and got["mixed", "no url"][1:] == ("unknown url type: 'no url'", 1)
    assert got["mixed", "/slow"][2] == 3 and "time" in got["mixed", "/slow"][1].lower()
    assert [got["dead", f"/dead{k}"][2] for k in range(6)] == [3, 3, 0, 0, 0, 0] and all("503" in got["dead", f"/dead{k}"][1] for k in range(6))
    assert calls["/gone"] == 1 and "/dead2" not in calls
    assert "refused" in got["nowhere", "http://127.0.0.1:1/x"][1]


def test_table_of_urls(spark, server, monkeypatch):
    """Given pages through the web: what is fetched equals what was served, failures become rows of the outcome per source."""
    at, _ = server
    rows = spark.createDataFrame([(k, f"s{k % 3}", f"{at}/page{k}" if k % 3 else f"{at}/dead-{k}", "old", "old") for k in range(40)], "id long, source_slug string, url string, html string, error string")
    got = fetch.fetch_pages(rows, "source_slug", ["url"], tries=2, pause=0.0, down=2)
    assert got.columns == ["id", "source_slug", "url", "html", "error", "tries"]
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == 40 and all((r["html"] == f"<p>page /page{k}</p>") == bool(k % 3) and (r["error"] is None) == bool(k % 3) for k, r in found.items())
    out = {r["source_slug"]: tuple(r)[1:4] for r in fetch.site_outcomes(got, "source_slug").collect()}
    assert out == {"s0": (14, 14, 0), "s1": (13, 0, 0), "s2": (13, 0, 0)}
    gate = got.select("id", ingest.gate_reason(got["error"].isNull(), got["html"]).alias("g"))
    assert {r["id"]: r["g"] for r in gate.collect()}[0] == "fetch_failed"
    assert fetch.fetch_pages(rows.limit(0), "source_slug", ["url"]).count() == 0


def test_nulls(spark):
    rows = spark.createDataFrame([(None, None), ("a", None)], "site string, url string")
    assert all(r["html"] is None and r["error"] for r in fetch.fetch_pages(rows, "site", ["url"], tries=1).collect())


def test_too_large(server, monkeypatch):
    monkeypatch.setattr(fetch, "LARGEST", 1000)
    with pytest.raises(fetch.Lasting, match="bytes"):
        fetch.http_get(f"{server[0]}/big")
