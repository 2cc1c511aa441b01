import collections
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from gritmill import streaming
from gritmill.sources import recorded
from gritmill.streaming import deliveries

SCHEMA = "provider string, signature string, delivery string, event string, body string"


def signed(body, key="secret"):
    return "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


def of_a(number, action, at, delivery, merged=False):
    body = json.dumps({"action": action, "repository": {"full_name": "Org/R"}, "pull_request": {"number": number, "merged": merged, "updated_at": at, "user": {"login": "é"}, "head": {"ref": "x", "sha": "1"}, "base": {"ref": "m", "sha": "2"}}})
    return ("a", signed(body), delivery, "pull_request", body)


def of_b(number, action, at, **more):
    return ("b", "token", None, None, json.dumps({"object_kind": "merge_request", "project": {"name": "ORG/R"}, "object_attributes": {"id": number, "action": action, "updated_at": at, **more}}))


def test_hmac(spark):
    texts = ["", "abc", "é" * 100, "x" * 1000]
    for key in ("k", "long" * 40):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(deliveries.hmac_sha256(F.col("t"), key)).collect()
        assert [r[0] for r in got] == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_routing(spark):
    t = "2024-01-01T00:00:00"
    good = of_a(1, "opened", t, "d")
    rows = [
        good, of_a(2, "closed", t, "d", True), of_a(3, "closed", t, "d"), of_a(4, "labeled", t, "d"), (*good[:3], "push", good[4]), ("a", None, "d", "pull_request", good[4]), ("a", signed(good[4], "other"), "d", "pull_request", good[4]),
        ("a", signed(""), "d", "pull_request", None), ("a", signed("{"), "d", "pull_request", "{"), of_b(5, "merge", t), of_b(6, "update", t, state="closed"), of_b(7, "open", t, iid=70, title="T", source_branch="s"), ("b", "wrong", None, None, "{}"), ("b", "token", None, None, '{"object_kind": "note"}'),
        of_a(8, "opened", None, "d"), (None, "token", None, None, None),
    ]
    got = [tuple(r) for r in deliveries.routed(spark.createDataFrame(rows, SCHEMA), "secret", "token").select("outcome", "number", "status", "repository", "author").collect()]
    assert got == [
        ("change", 1, "open", "org/r", "é"), ("change", 2, "merged", "org/r", "é"), ("change", 3, "closed", "org/r", "é"), ("ignored_action", None, None, None, None), ("ignored_event", None, None, None, None), ("unsigned", None, None, None, None),
        ("forged", None, None, None, None), ("ignored_action", None, None, None, None), ("ignored_action", None, None, None, None), ("change", 5, "merged", "org/r", "unknown"), ("change", 6, "closed", "org/r", "unknown"), ("change", 70, "open", "org/r", "unknown"),
        ("forged", None, None, None, None), ("ignored_event", None, None, None, None), ("malformed", None, None, None, None), ("ignored_event", None, None, None, None),
    ]


def test_states_survive_a_restart_and_stay_bounded(spark, tmp_path):
    rng = random.Random(2)
    events = [(n, rng.choice(["opened", "synchronize", "closed"]), f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}", f"d{k}", rng.random() < 0.5) for k in range(400) for n in [rng.randrange(5)]]
    sent = [e for e in events for _ in range(2)]
    rng.shuffle(sent)
    spark.conf.set(*deliveries.STATE_STORE)
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(part):
        spark.createDataFrame([of_a(n, a, t, d, m) for n, a, t, d, m in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = deliveries.changes(deliveries.routed(stream, "secret", "token").where("outcome = 'change'"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress[-1].stateOperators[0].numRowsTotal

    run(sent[:500])
    assert run(sent[500:]) <= 10  # two values for each of the five changes
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(sent) and sum(r.repeated for r in got) == len(events)
    last = {}
    for n, a, t, d, m in events:
        last[n] = max(last.get(n, ("", "", "")), (t, d, "open" if a != "closed" else "merged" if m else "closed"))
    final = {}
    for r in got:
        if r.applied:
            final[r.number] = max(final.get(r.number, ("", "", "")), (r["at"].strftime("%Y-%m-%dT%H:%M:%S"), r.delivery, r.status))
    assert final == last and all(r.status == "open" for r in got if r.analysed)


def test_ids_are_forgotten_first_in_first_out(spark, tmp_path):
    spark.conf.set(*deliveries.STATE_STORE)
    for k, d in enumerate(["a", "b", "a", "c", "a", "b", None, None]):
        spark.createDataFrame([of_a(1, "opened", "2024-01-01T00:00:00", d)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(f"{tmp_path}/in")
        streaming.drain(deliveries.changes(deliveries.routed(stream, "secret", "token").where("outcome = 'change'").withColumn("at", F.col("at") + F.make_interval(secs=F.lit(k))), 2), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [(r.delivery, r.repeated) for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r["at"])]
    assert got == [("a", False), ("b", False), ("a", True), ("c", False), ("a", False), ("b", False), (None, False), (None, False)]


def test_recorded_answers(spark, tmp_path):
    ok = {"status": 200, "body": json.dumps({"content": "YQ0KYg=="})}
    lines = [
        {"request": "fine", "answers": [ok]}, {"request": "second", "answers": [{"status": 500}, ok]}, {"request": "never", "answers": [{"status": 404}]}, {"request": "none", "answers": []}, {"request": "late", "answers": [{"status": 500}] * 3 + [ok]},
        {"request": "empty", "answers": [{"status": 200, "body": "{}"}]}, {"request": "tree", "answers": [{"status": 200, "body": json.dumps({"truncated": True, "tree": [{"path": "é", "type": "blob", "sha": "s", "size": 3}, {"path": "d", "type": "tree"}]})}]},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\n\ndamaged\n")
    (tmp_path / "b.json").write_text("".join(json.dumps({"request": f"r{i}", "answers": [ok]}) + "\n" for i in range(7)))
    (tmp_path / "_x.json").write_text("{}")
    df = recorded.recorded(spark, str(tmp_path), chunk=3, pause=0)
    assert df.rdd.getNumPartitions() == 6
    got = {r.request: (r.attempts, r.status, r.error) for r in df.collect()}
    assert got["fine"] == (1, 200, None) and got["second"] == (2, 200, None) and got["never"] == (3, 404, "status 404 after 3 attempts") and got["none"] == (3, None, "no answer after 3 attempts") and got["late"][0] == 3 and got[None] == (0, None, "damaged recording")
    assert {r.request for r in recorded.failures(df).collect()} == {"never", "none", "late", None} and len(got) == 15
    b = {r.request: (r.content, r.line_count, r.size) for r in recorded.blobs(df).collect()}
    assert b["fine"] == ("a\nb", 2, 3) and b["empty"] == ("", 0, 0) and "never" not in b
    assert [tuple(r) for r in recorded.trees(df).collect()] == [("tree", True, "é", "s", 3)]
    out, state = tmp_path / "out", tmp_path / "state"
    stream = recorded.recorded(spark, str(tmp_path), stream=True, chunk=4, pause=0)
    (tmp_path / "_x.json").unlink()
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    (tmp_path / "c.json").write_text(json.dumps(lines[0]).replace("fine", "more") + "\n")
    q.processAllAvailable()
    q.stop()
    streamed = collections.Counter(r.request for r in spark.read.parquet(str(out)).collect())
    assert streamed == collections.Counter([*got, "more"])


def test_pauses_double(monkeypatch):
    slept = []
    monkeypatch.setattr(recorded.time, "sleep", slept.append)
    assert recorded.asked(json.dumps({"request": "r", "answers": [{"status": 500}]}), 4, 500)[1] == 4 and slept == [0.5, 1.0, 2.0]


@pytest.mark.parametrize("line", ["[]", "3", "null", "{}", '{"answers": null}'])
def test_odd_recordings(line):
    assert recorded.asked(line, 1, 0)[4]


def test_partitions_follow_bytes_and_hold_each_line_once(tmp_path, monkeypatch):
    lines = [json.dumps({"request": f"é{i}" * (i % 9 + 1), "answers": [{"status": 200}]}, ensure_ascii=False) for i in range(200)]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.json").write_text(lines[0])
    reader = recorded._Reader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 2  # one a file, not one for each 250 requests
    want = [json.loads(x)["request"] for x in [*lines, lines[0]]]
    for part in (1, 7, 50, 100, 1000):
        monkeypatch.setattr(recorded, "PART", part)
        assert [r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()] == want
    (tmp_path / "c.json").write_text("\n".join(lines * 3))
    monkeypatch.setattr(recorded, "PART", 8 << 20)
    assert len(reader.partitions()) == 3
