"""Downloads and callbacks against a server on this host."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillstone.operators import prepare
from quillstone.sources import downloads
from quillstone.streaming import callbacks

LIMIT = 3 << 20


class Handler(BaseHTTPRequestHandler):
    posts: Counter = Counter()
    refused: Counter = Counter()

    def log_message(self, *args):
        pass

    def answer(self, status, body, headers=()):
        self.send_response(status)
        for k, v in headers:
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        size = ("Content-Length",)
        known = {
            "/small": (200, b"abc", [("Content-Type", "Text/Plain; charset=utf-8"), (*size, "3")]),
            "/large": (200, b"x" * (2 << 20) + b"y", [(*size, str((2 << 20) + 1))]),
            "/declared": (200, b"x", [(*size, str(LIMIT + 1))]),
            "/endless": (200, b"z" * (LIMIT + 5), []),
            "/empty": (200, b"", [(*size, "0")]),
            "/set": (200, json.dumps({"data": [{"record": {"tm": "t"}, "files": ["f"]}]}).encode(), []),
            "/list": (200, b"[1]", []),
        }
        try:
            self.answer(*known.get(self.path, (404, b"none", [(*size, "4")])))
        except (BrokenPipeError, ConnectionResetError):
            pass

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        Handler.posts[body] += 1
        if Handler.refused[body]:
            Handler.refused[body] -= 1
            self.answer(*((500, b"") if "status" in body else (200, b'{"code": 7}')))
        else:
            self.answer(200, b'{"code": 200}')


@pytest.fixture(scope="module")
def server():
    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}"
    held.shutdown()


def plain(rows):
    return {r["url"].rsplit("/", 1)[1]: (r["status"], None if r["content"] is None else len(r["content"]), r["error"]) for r in rows}


def test_downloads_with_caps(spark, server):
    paths = ["small", "large", "declared", "endless", "empty", "gone"]
    urls = [f"{server}/{p}" for p in paths]
    want = {"small": (200, 3, None), "large": (200, (2 << 20) + 1, None), "declared": (200, None, f"declared size {LIMIT + 1} is above {LIMIT}"), "endless": (200, None, f"size is above {LIMIT}"), "empty": (200, None, "empty"), "gone": (404, None, "status 404")}
    got = downloads.from_urls(spark, urls, limit=LIMIT)
    assert got.rdd.getNumPartitions() == len(urls) and plain(got.collect()) == want
    assert downloads.from_urls(spark, urls, limit=LIMIT, together=4).rdd.getNumPartitions() == 2
    assert downloads.from_urls(spark, []).count() == 0
    table = spark.createDataFrame([(u,) for u in [*urls, urls[0], None, "ftp://x/y", "http://127.0.0.1:1/down"]], "url string")
    rows = downloads.downloaded(table, limit=LIMIT).collect()
    held = plain(rows)
    assert len(rows) == len(urls) + 2 and {k: held[k] for k in want} == want
    assert held["y"] == (None, None, "no http(s) URL") and held["down"][0] is None and "refused" in held["down"][2]
    assert [r["content_type"] for r in rows if r["url"] == urls[0]] == ["text/plain"]
    assert {r["url"].rsplit("/", 1)[1] for r in downloads.failures(got).collect()} == {"declared", "endless", "empty", "gone"}


def test_a_training_set_is_fetched_whole_or_not_at_all(spark, server):
    files = downloads.from_urls(spark, [f"{server}/set"])
    got = prepare.records(downloads.payload(files, prepare.PAYLOAD)).collect()
    assert [(r["record"]["tm"], r["files"]) for r in got] == [("t", ["f"])]
    for bad in ("list", "gone"):
        with pytest.raises(Exception, match="no JSON object" if bad == "list" else "status 404"):
            downloads.payload(downloads.from_urls(spark, [f"{server}/set", f"{server}/{bad}"]), prepare.PAYLOAD).collect()


def test_failed_callbacks_come_back_until_sent(spark, server, tmp_path):
    bodies = [json.dumps({"n": i, "kind": "status" if i % 2 else "code"}) for i in range(8)]
    Handler.posts.clear(), Handler.refused.clear()
    Handler.refused.update({bodies[1]: 1, bodies[2]: 2, bodies[3]: 9})
    folder, rows = f"file://{tmp_path}/out", tmp_path / "in"
    spark.createDataFrame([(i, b) for i, b in enumerate(bodies[:5])], "model_id long, payload string").write.parquet(str(rows))
    stream = lambda: spark.readStream.schema("model_id long, payload string").parquet(str(rows))
    run = lambda: callbacks.deliver(stream(), server, folder, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    run()
    assert Handler.posts == Counter(bodies[:5])
    spark.createDataFrame([(i, b) for i, b in enumerate(bodies) if i >= 5], "model_id long, payload string").write.mode("append").parquet(str(rows))
    for _ in range(4):
        run()
    assert Handler.posts == Counter({**{b: 1 for b in bodies}, bodies[1]: 2, bodies[2]: 3, bodies[3]: 3})
    held = callbacks.outcomes(stream(), folder).collect()
    assert len(held) == sum(Handler.posts.values())
    last = {r["model_id"]: r for r in sorted(held, key=lambda r: r["attempts"])}
    assert {i for i, r in last.items() if not r["sent"]} == {3} and last[3]["error"] == "status 500" and last[3]["attempts"] == 3
    assert {(r["model_id"], r["error"]) for r in held if not r["sent"]} == {(1, "status 500"), (2, "code 7"), (3, "status 500")}
    assert {r["batch_id"] for r in held if r["model_id"] < 5 and r["attempts"] == 1} == {0}


def test_a_batch_that_breaks_off_does_not_send_twice(server, tmp_path):
    """A task sends two of three rows, then the third breaks it; the batch runs again."""
    from pyspark.sql import Row

    Handler.posts.clear(), Handler.refused.clear()
    rows = [Row(model_id=i, payload=f'{{"again": {i}}}', attempts=0) for i in range(3)]
    writer = callbacks.CallbackWriter({"url": server, "folder": f"file://{tmp_path}", "payload": "payload"})

    def breaking():
        yield from rows[:2]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaking())
    writer.abort([None], 0)
    message = writer.write(iter(rows))
    writer.commit([message, callbacks.Tried(None)], 0)
    assert Handler.posts == Counter(r.payload for r in rows)
    (file,) = (tmp_path / "outcomes").iterdir()
    assert [json.loads(x)["sent"] for x in file.read_text().splitlines()] == [True] * 3 and not list((tmp_path / "tries").iterdir())
    writer.write(iter([]))
