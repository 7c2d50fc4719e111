"""Calls of a model server: how many at once, and that none is made twice."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import chunking, embed, symbols
from quarryloom.plans.indexer import Index


class Server(ThreadingHTTPServer):
    """Answers after a while; counts what it answered and the most calls at once; fails for texts in bad."""

    daemon_threads = True

    def __init__(self, slow=0.0):
        super().__init__(("127.0.0.1", 0), Answer)
        self.slow, self.bad, self.lock, self.now, self.peak, self.answered, self.calls = slow, None, threading.Lock(), 0, 0, Counter(), 0

    def __enter__(self):
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.shutdown()
        self.server_close()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_address[1]}"


class Answer(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_POST(self):
        s = self.server
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        with s.lock:
            s.now, s.calls = s.now + 1, s.calls + 1
            s.peak = max(s.peak, s.now)
            fails = s.bad is not None and any(s.bad in t for t in texts)
        time.sleep(s.slow)
        with s.lock:
            s.now -= 1
            if not fails:
                s.answered.update(texts)
        body = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)][::-1]}).encode()
        self.send_response(500 if fails else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


def by(server, **how):
    return embed.http_embedder("test", "m", embed.in_batches(server.url, "m"), **({"batch": 2, "dimensions": 2, "wait": 0.01, "tries": 2} | how))


def texts(spark, n, parts):
    return spark.range(0, n, 1, parts).select("id", F.concat(F.lit("text "), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"))


def test_calls_of_a_task_overlap(spark):
    with Server(0.2) as server:
        rows = by(server, in_flight=4).embed(texts(spark, 24, 1), "id", "t").collect()
        assert {r["id"]: r["embedding"] for r in rows} == {i: [5.0 + i, 1.0] for i in range(24)}
        assert server.peak == 4 and server.calls == 12 and set(server.answered.values()) == {1}


def test_one_call_after_the_other_without_a_window(spark):
    with Server(0.01) as server:
        assert by(server).embed(texts(spark, 8, 1), "id", "t").count() == 8
        assert server.peak == 1


@pytest.mark.parametrize(("in_flight", "most", "peak"), [(2, 4, 4), (8, 3, 3), (2, 2, 2), (2, 5, 4)])
def test_all_tasks_together_keep_to_the_cap(spark, in_flight, most, peak):
    with Server(0.1) as server:
        assert by(server, batch=1, in_flight=in_flight, most_calls=most).embed(texts(spark, 32, 8), "id", "t").count() == 32
        assert server.peak <= peak and server.calls == 32


def test_a_failure_is_raised_or_left_out(spark):
    with Server() as server:
        server.bad = "xxxxxxx"
        with pytest.raises(Exception, match="embedding failed"):
            by(server, in_flight=2).embed(texts(spark, 10, 1), "id", "t").collect()
        left = by(server, in_flight=2, on_error="skip").embed(texts(spark, 10, 1), "id", "t").collect()
        assert sorted(r["id"] for r in left) == list(range(6))  # a call of two fails as a whole
    for wrong in ({"in_flight": 0}, {"tries": 0}, {"most_calls": -1}):
        with pytest.raises(ValueError, match="positive"):
            embed.http_embedder("t", "m", lambda ts: [], **wrong)


def test_slices_keep_what_they_have(spark):
    rows = texts(spark, 40, 2).select(F.sha2("t", 256).alias("content_hash"), F.col("t").alias("content"))
    kept = []

    def keep(vectors):
        got = [r["content_hash"] for r in vectors.collect()]
        kept.extend(got)
        return len(got)

    with Server() as server:
        server.bad = "x" * 39
        with pytest.raises(embed.EmbeddingFailed, match="no vector: HTTPError"):
            embed.embed_in_slices(rows, by(server), keep, most=10)
        assert len(kept) == sum(server.answered.values()) < 40
        server.bad = None
        rest = rows.join(spark.createDataFrame([(h,) for h in kept], "content_hash string"), "content_hash", "left_anti")
        n = len(kept)
        assert embed.embed_in_slices(rest, by(server), keep, most=10) == 40 - n
        assert sorted(kept) == sorted(r[0] for r in rows.select("content_hash").collect())
        assert set(server.answered.values()) == {1}
        assert embed.embed_in_slices(rows.limit(0), by(server), keep) == 0


def test_a_run_that_failed_is_taken_up_again(spark, tmp_path):
    files = spark.range(12).select(F.lit("r").alias("repo_root"), F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("line of file "), "id").alias("text"), F.lit("en").alias("language"))
    with Server() as server:
        index = Index(spark, f"file://{tmp_path}/ix", by(server, batch=1), chunking.fixed_chunks, lambda f: symbols.extract_symbols(f, "en", []), buckets=4, slice_rows=4)
        server.bad = "file 7"
        with pytest.raises(embed.EmbeddingFailed):
            index.run(files, "r")
        first = sum(server.answered.values())
        assert index.read("embedding_cache").count() == first and index.read("chunk_locations").count() == 0
        server.bad = None
        done = index.run(files, "r")
        assert (done.added, done.embedded, done.written["embedding_cache"]) == (12, 12 - first, 12 - first)
        assert set(server.answered.values()) == {1} and sum(server.answered.values()) == 12
        assert index.read("embedding_cache").count() == 12 and index.read("chunk_locations").count() == 12
        assert index.run(files, "r").embedded == 0 and sum(server.answered.values()) == 12
