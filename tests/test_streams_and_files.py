import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.models import hash_embedding
from corpusloom import config
from corpusloom.operators import messages as M
from corpusloom.operators import telemetry as T
from corpusloom.operators.collection import Collections
from corpusloom.operators.delivery import REPLY_ORDER, MessageStore, message_identifier
from corpusloom.operators.dialog import appended_turns, judged_answers, last_assistant, merged_context, selected_context, skips_retrieval
from corpusloom.sources import files as S
from corpusloom.streaming import workers as W

NOW = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)


def write(path, messages):
    path.mkdir(exist_ok=True)
    n = len(list(path.iterdir()))
    (path / f"{n}.json").write_text("\n".join(json.dumps(m) for m in messages))


def message(offset, value, key="k", headers=None):
    return {"topic": "in", "partition": 0, "offset": offset, "key": key, "value": value, "headers": headers or {}, "timestamp": "2025-01-01T00:00:00Z"}


def test_embedding_worker_goes_on_after_a_restart(spark, tmp_path):
    write(tmp_path / "in", [message(1, '{"texts": ["a b", "c"]}', "one"), message(2, "{nonsense", "two"), message(3, '{"texts": []}', "three")])

    def run():
        q = W.embedding_replies(W.file_stream(spark, str(tmp_path / "in")), hash_embedding).writeStream.format("json").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {r["key"]: json.loads(r["value"]) for r in spark.read.schema("key string, value string, headers map<string,string>").json(str(tmp_path / "out")).collect()}

    first = run()
    assert (first["one"]["status"], first["one"]["count"], first["one"]["dimension"], len(first["one"]["embeddings"])) == ("ok", 2, 64, 2)
    assert first["two"]["status"] == first["three"]["status"] == "failed"
    write(tmp_path / "in", [message(4, '{"texts": ["d"]}', "four")])
    assert set(run()) == {"one", "two", "three", "four"}


def test_requests_and_dead_letters(spark, tmp_path):
    body = {"uuid": "u", "url_download": "f", "lang": "en", "timeout_seconds": 0, "correlation_id": " "}
    write(tmp_path / "in", [message(1, json.dumps(body), "key", {"correlation_id": "head"}), message(2, json.dumps(body | {"more": 1})), message(3, json.dumps(body) + " {}"), message(4, "null")])
    good, bad = W.process_requests(spark.read.schema(W.ENVELOPE).json(str(tmp_path / "in")))
    assert [(r["correlation_id"], r["timeout_seconds"]) for r in good.collect()] == [("head", 180)]
    assert sorted(r["offset"] for r in bad.collect()) == [2, 3, 4]


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    write(tmp_path / "in", [message(i, "x", f"k{i % 3}") for i in range(9)])
    store = MessageStore(spark, message_identifier(F.lit(None).cast("string"), F.col("key"), F.col("headers")), ["offset"])

    def handle(batch, _):
        store.upsert(W.once_by_offset(batch))
        store.upsert(batch)

    W.run_available(W.file_stream(spark, str(tmp_path / "in")), handle, str(tmp_path / "cp"))
    assert sorted((r["identifier"], r["item"]["offset"]) for r in store.compacted().collect()) == [("k0", 0), ("k1", 1), ("k2", 2)]
    assert REPLY_ORDER


def test_first_replies(spark):
    asked = spark.createDataFrame([("a", NOW), ("b", NOW), ("c", NOW)], "cid string, asked_at timestamp")
    after = lambda s: NOW + datetime.timedelta(seconds=s)
    replies = spark.createDataFrame([("a", after(5), " FAILED"), ("a", after(9), "ok"), ("b", after(91), "ok"), ("x", after(1), "ok"), ("c", after(90), "ok")], "cid string, replied_at timestamp, status string")
    assert sorted((r["cid"], r["outcome"], r["n"]) for r in M.first_replies(asked, replies).withColumn("n", F.col("replied_at").isNotNull()).collect()) == [("a", "failed", True), ("b", "timeout", False), ("c", "ok", True)]


def test_output_schema_and_string_fields(spark):
    s = M.output_schema({" a ": "NUMBER", "b": "", "c": '{"type": "array"}', "d": "{bad", "": "x"})
    assert s["properties"] == {"a": {"type": "number"}, "b": {"type": "string"}, "c": {"type": "array"}, "d": {"type": "string"}} and s["required"] == ["a", "b", "c", "d"] and s["additionalProperties"] is False
    assert M.output_schema({}) is None and M.output_schema({" ": "x"}) is None
    df = spark.createDataFrame([('{"a": "x", "b": 1, "c": null, "d": "2"}',), ("[]",), (None,)], "j string")
    assert [r[0] for r in df.select(M.string_fields(F.col("j"))).collect()][0] == {"a": "x", "d": "2"}


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in (0.004, 0.02, 0.02, 30.0)] + [("b", 0.001)], "k string, v double")
    got = {r["k"]: r["value"] for r in T.histogram_quantile(T.bucket_counts(df, ["k"], "v"), ["k"], 0.5).collect()}
    assert abs(got["a"] - (0.01 + 0.015 * 0.5)) < 1e-9 and abs(got["b"] - 0.0025) < 1e-9
    assert T.histogram_quantile(T.bucket_counts(df, ["k"], "v"), ["k"], 0.95).filter("k = 'a'").first()["value"] == 10.0


def test_dialog(spark):
    turns = spark.createDataFrame([("c", 1, "user", "q"), ("c", 2, " Assistant ", " yes "), ("c", 3, "assistant", " "), ("d", 1, "user", "x")], "conv_id string, turn long, role string, text string")
    assert [tuple(r) for r in last_assistant(turns, ["conv_id"]).collect()] == [("c", "yes")]
    more = appended_turns(turns, spark.createDataFrame([("c", "q2", "a2"), ("e", "q", "a")], "conv_id string, question string, answer string"))
    assert sorted((r["conv_id"], r["turn"], r["text"]) for r in more.filter("text IN ('q2', 'a2', 'a')").collect()) == [("c", 4, "q2"), ("c", 5, "a2"), ("e", 2, "a")]
    cases = [("r r r r", " ", None, "empty_postprocess"), ("r", "a b c", None, "too_short"), ("r", "Xin chào bạn nhé ơi", None, "generic_reply"), ("r", "Aa bb cc dd", " aa BB cc dd", "duplicate_last_assistant"), ("zz yy", "aa bb cc dd", None, "low_overlap_with_raw_answer"), ("aa zz", "aa bb cc dd", "x", "accepted")]
    df = spark.createDataFrame(cases, "raw string, post string, last string, want string")
    assert all(r[0] == r[1] for r in judged_answers(df).select("reason", "want").collect())
    gate = spark.createDataFrame([("this", None, True), ("what now", "", False), (None, None, True), ("hello", "i.png", False)], "q string, i string, want boolean")
    assert all(r[0] == r[1] for r in gate.select(skips_retrieval(F.col("q"), F.col("i")), "want").collect())
    hits = spark.createDataFrame([(1, "a", 0.9, 1, " t "), (1, "b", 0.8, 2, "t"), (1, "c", 0.7, 3, "u"), (2, "d", 0.1, 1, None)], "q int, id string, score double, rank int, text string")
    assert sorted((r["q"], r["id"], r["text"]) for r in merged_context(hits, ["q"]).collect()) == [(1, "a", "t\n\n---\n\nu"), (2, "d", None)]
    side = lambda s: F.struct(F.lit(s).alias("score"), F.lit(f"t{s}").alias("text"))
    c = spark.range(1).select(selected_context(F.lit(None).cast("string"), side(0.1), side(0.6), side(0.9)).alias("a"), selected_context(F.lit("i"), side(0.9), side(0.6), side(0.2)).alias("b")).first()
    assert (c["a"]["source"], c["b"]["source"]) == ("current_query", "")


def test_files(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "b.md").write_text("  text ![x](sub/i.png) ")
    (tmp_path / "docs" / "sub" / "a.MARKDOWN").write_text(" \n")
    (tmp_path / "docs" / "sub" / "i.png").write_bytes(b"png")
    (tmp_path / "docs" / "skip.txt").write_text("x")
    found = S.list_artifacts(spark, str(tmp_path / "docs"))
    assert sorted(r["kind"] for r in found.collect()) == ["document", "document", "image"]
    assert S.first_document(found).first()["path"].endswith("docs/b.md")
    docs = S.read_documents(spark, str(tmp_path / "docs"))
    assert [r["text"] for r in docs.collect()] == ["text ![x](sub/i.png)"]
    refs = docs.select("path", F.explode(F.array(F.lit("sub/i.png"), F.lit("none.png"))).alias("image"))
    got = {r["image"]: r["image_path"] for r in S.resolve_images(refs, found).collect()}
    assert got["sub/i.png"].endswith("/docs/sub/i.png") and got["none.png"] == ""
    objects = spark.createDataFrame([("x/u1", "https://h/f.pdf", b"123"), ("u2", "g.bin", b""), ("u3", "h", None)], "folder string, url string, content binary")
    stored = S.write_objects(objects, str(tmp_path / "bucket"))
    assert sorted((r["key"], r["length"]) for r in stored.collect()) == [("u1/f.pdf", 3), ("u2/g.bin", 0)]
    assert sorted(r["key"] for r in S.object_stat(spark, str(tmp_path / "bucket")).collect()) == ["u1/f.pdf"]
    assert S.local_path("file:///a/b") == "/a/b" and S.local_path(" c ") == "c"


def test_objects_and_downloads(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.md").write_text("text of a file")
    (tmp_path / "a" / "i.png").write_bytes(b"12")
    at = S.download(f"file://{tmp_path}/a/f.md", "u1", str(tmp_path / "down"))
    assert at.endswith("/down/u1_f.md") and open(at).read() == "text of a file"
    with pytest.raises(ValueError):
        S.download("https://x.y/z", "u", str(tmp_path))
    found = S.list_artifacts(spark, str(tmp_path / "a")).select("path")
    more = found.unionByName(spark.createDataFrame([(" ",), ("/no/such.md",)], "path string"))
    assert S.upload_artifacts(spark, more, str(tmp_path / "a"), str(tmp_path / "b")).first()["n_stored"] == 2
    keys = spark.createDataFrame([("a/f.md",), ("none",)], "key string")
    assert [(r["key"], bytes(r["content"])) for r in S.read_objects(spark, str(tmp_path / "b"), keys).collect()] == [("a/f.md", b"text of a file")]
    assert S.delete_object(str(tmp_path / "b"), "a/f.md") and not S.delete_object(str(tmp_path / "b"), "a/f.md")
    with pytest.raises(ValueError):
        S.delete_object(str(tmp_path / "b"), "../a/f.md")


def test_upload_and_ingest_streams(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"folder": "u9", "url": f"file://{tmp_path}/x.bin"}))
    stored = []
    W.upload_batches(W.file_stream(spark, str(tmp_path / "in"), "folder string, url string"), str(tmp_path / "bucket"), str(tmp_path / "cp1"), lambda r: stored.extend(map(tuple, r.collect())))
    assert stored == [("u9/x.bin", 3)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "0.json").write_text(json.dumps({"doc_id": "d", "text": "One two three four five six seven eight nine.", "lang": "en", "source_path": "p"}))
    done, listener = [], W.Progress()
    spark.streams.addListener(listener)
    stream = W.file_stream(spark, str(tmp_path / "docs"), "doc_id string, text string, lang string, source_path string")
    W.ingest_batches(stream, Collections(spark, str(tmp_path / "c")), "points", str(tmp_path / "cp2"), lambda r: done.extend(map(tuple, r.collect())))
    spark.streams.removeListener(listener)
    assert done == [("d", 1, True)]


def test_settings(tmp_path):
    env = {"A": " ", "B": "x", "N": "5"}
    assert config.first_set("A", "B", env=env) == "x" and config.first_set("A", env=env, default="d") == "d"
    (tmp_path / "s.json").write_text('{"n": ${N}, "b": "$B-${NONE}"}')
    assert config.load(str(tmp_path / "s.json"), env) == {"n": 5, "b": "x-"}
    assert [config.bucket({"up": "u ", "e": ""}, n, " d ") for n in ("UP", "e", "other", " ", "default")] == ["u", "d", "d", "d", "d"]


def test_history_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"session_id": s, "role": "user", "text": f"{s}{i}", "offset": i, "timestamp": "2025-01-01T00:00:00Z"} for s in "ab" for i in range(2)]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = W.file_stream(spark, str(tmp_path / "in"), "session_id string, role string, text string, offset long, timestamp timestamp")
    q = W.history_stream(stream).writeStream.format("memory").queryName("history").outputMode("append").trigger(processingTime="1 second").start()
    try:
        # A query with state that expires never counts as idle, so it is asked now and then.
        for _ in range(60):
            if spark.table("history").count() == 4:
                break
            time.sleep(1)
        assert sorted((r["session_id"], r["turn"], r["text"]) for r in spark.table("history").collect()) == [("a", 1, "a0"), ("a", 2, "a1"), ("b", 1, "b0"), ("b", 2, "b1")]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_first_replies_of_a_hot_request(spark):
    """Against all pairs: equal times, replies of the next stretch, too late and unnamed ones."""
    import datetime
    import random

    r, t0 = random.Random(4), datetime.datetime(2025, 1, 1)
    at = lambda: t0 + datetime.timedelta(seconds=r.randrange(3000))
    asked = [(r.choice(["hot", "hot", "b", None]), at(), i) for i in range(200)]
    replied = [(r.choice(["hot", "b", None]), at(), r.choice([" OK", "failed"])) for i in range(60)]
    a, b = spark.createDataFrame(asked, "cid string, asked_at timestamp, n int"), spark.createDataFrame(replied, "cid string, replied_at timestamp, status string")
    got = {x["n"]: (x["replied_at"], x["outcome"]) for x in M.first_replies(a, b, 90).collect()}
    for cid, when, n in asked:
        near = sorted((t, s.strip().lower()) for c, t, s in replied if cid and c == cid and when <= t <= when + datetime.timedelta(seconds=90))
        assert got[n] == ((near[0][0], near[0][1]) if near else (None, "timeout"))
    assert M.first_replies(a.limit(0), b).count() == 0 and M.first_replies(a, b.limit(0)).filter("outcome = 'timeout'").count() == 200
