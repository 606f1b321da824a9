import json
import time

import pytest
from pyspark.sql import functions as F

from stratavec.operators import changes
from stratavec.operators.embed import ByteBpe, ClientEmbedder, HashingEmbedder, Truncation, embed
from stratavec.sources import oplog
from stratavec.sources.store import VectorStore, create_index_name, load, parse_index_name
from stratavec.streaming.indexing import index_stream

OPS = [("Inserted", "a", "red fox", None), ("Inserted", "b", "blue whale", None), ("Deleted", "a", None, None), ("Inserted", "a", "red dog", None), ("Error", None, None, "boom"), ("Changed", "b", "blue bird", None), ("Inserted", "c", "", None), ("Deleted", "z", None, None)]
SCHEMA = "op string, id string, string string, message string, seq long"


def ops(spark, rows=OPS, first=0):
    return spark.createDataFrame([(*r, first + k) for k, r in enumerate(rows)], SCHEMA)


def test_latest_and_apply(spark):
    last = {r.id: r.op for r in changes.latest(ops(spark)).collect()}
    assert last == {"a": "Inserted", "b": "Changed", "c": "Inserted", "z": "Deleted"}
    base = spark.createDataFrame([("z", 0), ("k", 1)], "id string, seq long")
    assert {r.id for r in changes.apply_changes(base, ops(spark)).collect()} == {"a", "b", "c", "k"}
    assert changes.apply_changes(base, ops(spark), allow_duplicate_ids=True).count() == 7
    assert changes.latest(ops(spark).limit(0)).count() == 0


def test_validation(spark):
    bad = ops(spark, [("Upsert", "a", "x", None), ("Inserted", "a", None, None), (None, "a", "x", None), ("Replaced", "a", "x", None), ("Deleted", None, None, None)])
    assert [r.problem is None for r in bad.withColumn("problem", changes.problem()).orderBy("seq").collect()] == [False, False, False, True, False]
    assert [r.op for r in changes.validated(bad, strict=False).collect()] == ["Changed"]
    with pytest.raises(Exception, match="operation"):
        changes.validated(bad).collect()


def test_read_in_file_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"op": "Inserted", "id": f"{k}-{i}", "string": "x"}) + "\n" for i in range(5)))
    got = oplog.read_operations(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.id for r in got] == [f"{k}-{i}" for k in range(3) for i in range(5)] and [r.seq for r in got] == list(range(15))
    (tmp_path / "3.json").write_text("{broken\n")
    with pytest.raises(Exception):
        oplog.read_operations(spark, str(tmp_path)).collect()


def test_embedders(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r.embedding for r in embed(df, "t", HashingEmbedder(8)).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] is None and got[2] is None
    client = ClientEmbedder(lambda: lambda texts: [[float(len(t))] for t in texts], batch=1)
    assert [r.embedding for r in embed(df, "t", client).collect()] == [[5.0], [0.0], None]


def test_store_lifecycle(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    assert store.count("d/1") == 0
    assert store.build("d/1", "c1", ops(spark)) == 2  # the empty text has no vector
    live = {r.id: r.vec_id for r in store.manifest("d/1", "c1").collect()}
    assert set(live) == {"a", "b"} and sorted(live.values()) == [0, 1] and store.vector("d/1", 0) and store.vector("d/1", 9) is None
    assert store.build("d/1", "c2", ops(spark, [("Deleted", "a", None, None), ("Inserted", "d", "red dog", None)], 10), "c1") == 2
    assert [r.id for r in store.search("d/1", "c2", "red dog", 1).collect()] == ["d"]
    assert [r.id for r in store.similar("d/1", "c1", "a", 2).collect()][0] == "a"
    store.assign("d/1", "c1", "c3")
    assert {r.id for r in store.manifest("d/1", "c3").collect()} == {"a", "b"}
    assert store.lineage().count() == 2 and store.statistics("d/1").first().n_vectors == 3 and store.vacuum("d/1").count() == 0
    with pytest.raises(KeyError):
        store.manifest("d/1", "nope")
    with pytest.raises(KeyError):
        store.similar("d/1", "c1", "nope")
    task = store.start("d/1", "c4", ops(spark, OPS[:2], 20))
    for _ in range(300):
        if store.check(task)["status"] != "Pending":
            break
        time.sleep(0.1)
    assert store.check(task) == {"status": "Complete", "indexed_documents": 2}
    assert parse_index_name(create_index_name("a b/c", "x@y")) == ("a b/c", "x@y")


def test_a_text_is_sent_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def make():
        def client(texts):
            import uuid

            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return client

    rows = [("Inserted", f"k{i}", f"text number {i}" + " long" * 9000 * (i == 3), None) for i in range(250)]
    cut = Truncation(lambda: (str.split, " ".join), 4000)
    store = VectorStore(spark, str(tmp_path / "s"), ClientEmbedder(make, truncation=cut))
    assert store.build("d", "c", ops(spark, rows)) == 250
    sent = [t for f in log.iterdir() for t in f.read_text().split("\n")]
    assert len(sent) == len(set(sent)) == 250 and max(len(t.split()) for t in sent) == 4000
    assert store.search("d", "c", "text number 7", 1).count() == 1 and len([*log.iterdir()]) > 0
    found = embed(spark.createDataFrame([(k, f"q{k}") for k in range(40)], "k long, t string"), "t", store.embedder).filter("embedding is not null").selectExpr("k", "embedding[0] + embedding[1] as s")
    assert found.count() == 40
    sent = [t for f in log.iterdir() for t in f.read_text().split("\n") if t.startswith("q")]
    assert len(sent) == 40


def test_truncation_by_a_rank_file():
    import os

    folder = os.environ.get("STRATAVEC_TOKENIZERS", "/opt/tokenizers")
    cut = Truncation(ByteBpe(f"{folder}/byte_bpe_50k.tiktoken", r" ?[A-Za-z]+|\s+|[^\sA-Za-z]+"), 3).open()
    assert cut("one two three four five") == "one two three" and cut("a") == "a"


def test_unknown_domain_load_cache_and_approximate(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        store.vectors("nope")
    lines = [{"op": "Inserted", "id": f"k{i}", "string": f"alpha beta {i % 5} {'gamma' if i % 2 else 'delta'}"} for i in range(40)]
    (tmp_path / "ops.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert load(store, str(tmp_path / "ops.json"), "d", "c") == 40
    assert store.cached("d", "c") is store.cached("d", "c")
    assert {tuple(r) for r in store.duplicates("d", "c", 0.05, approximate=True).collect()} <= {(f"k{a}", f"k{b}") for a in range(40) for b in range(40)}
    exact, near = (store.search("d", "c", "alpha beta 3 gamma", 4, approximate=a).collect() for a in (False, True))
    assert [round(r.distance, 5) for r in exact] == [round(r.distance, 5) for r in near]
    store.assign("d", "c", "e")
    old = store.cached("d", "e")
    store.build("d", "e", ops(spark))
    assert store.cached("d", "e") is not old and {r.id for r in store.cached("d", "e").collect()} == {"a", "b"}


def test_http_change_stream(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/a%2Fb?commit_id=c2&previous=c1" and self.headers["X-Forwarded-User"] == "admin"
            body = "".join(json.dumps({"op": "Inserted", "id": f"é{k}", "string": "x"}) + "\n" for k in range(5)) if good else "no such commit"
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    got = oplog.read_http_operations(spark, url, "a/b", "c2", "c1").collect()
    assert [(r.op, r.id, r.seq) for r in got] == [("Inserted", f"é{k}", k) for k in range(5)]
    with pytest.raises(Exception, match="no such commit"):
        oplog.read_http_operations(spark, url, "a/b", "c9").collect()
    server.shutdown()


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [dict(zip(("op", "id", "string", "message"), r)) for r in OPS]
    for k in range(2):
        (src / f"{k}.json").write_text("".join(json.dumps({a: b for a, b in r.items() if b is not None}) + "\n" for r in rows[k * 4 : k * 4 + 4]))
        time.sleep(0.05)
    store = VectorStore(spark, str(tmp_path / "s"))
    q = index_stream(store, "d", oplog.read_operation_stream(spark, str(src)), str(tmp_path / "ck"))
    q.awaitTermination(60)
    streamed = {r.id: [round(x, 5) for x in r.embedding] for r in store.index("d", "stream-000001").collect()}
    store.build("d", "batch", ops(spark))
    assert streamed == {r.id: [round(x, 5) for x in r.embedding] for r in store.index("d", "batch").collect()}


def test_unpack_vectors(spark, tmp_path):
    import numpy as np

    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "d.vecs").write_bytes(x.tobytes())
    got = oplog.unpack_vectors(spark.read.format("binaryFile").load(str(tmp_path / "d.vecs")), dim=4).orderBy("vec_id").collect()
    assert [list(r.embedding) for r in got] == x.tolist()
