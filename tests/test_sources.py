"""Data sources by name: attachments and the webhook, with a receiver on this machine; rows replaced by key, SQL names, policies as rows."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lakewarden.functions import sqlnames, validators
from lakewarden.functions.detector import Detector
from lakewarden.operators import forward, inspect, rules, sanitize
from lakewarden.sources import webhook


@pytest.fixture(scope="module")
def named(spark):
    spark.dataSource.register(webhook.Attachments)
    spark.dataSource.register(webhook.Webhook)
    return spark


@pytest.fixture
def receiver():
    """A server that keeps what it gets; ``down`` answers 503, bodies with ``bad`` get 400."""
    got, state = [], {"down": False}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            status = 503 if state["down"] else 400 if "bad" in body else 200
            got.append((status, self.headers["Idempotency-Key"], body))
            self.send_response(status)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/in", got, state
    server.shutdown()


def drained(rows, name, tmp_path, **options):
    query = rows.writeStream.format(name).options(**options).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        return e
    return None


REQUESTS = "key string, url string, method string, headers map<string,string>, body string"


def test_attachments(named, tmp_path):
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("mail me@example.org")
    (folder / "sub" / "b.bin").write_bytes(b"\x00" * 900)
    (folder / "_hidden").write_text("x")
    rows = named.read.format("attachments").option("mostBytes", 500).load(str(folder))
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.content and bytes(r.content)) for r in rows.collect()}
    assert got == {"a.txt": (19, b"mail me@example.org"), "b.bin": (900, None)}
    report = inspect.inspected(rows.select("path", "content")).where("path like '%a.txt'").first()
    assert (report.n, report.true_type) == (1, "text")
    assert named.read.format("attachments").load(str(tmp_path / "none")).count() == 0
    many = named.read.format("attachments").option("partitionBytes", 10).load(str(folder))
    assert many.rdd.getNumPartitions() == 2 and many.count() == 2


def test_attachments_as_a_stream_read_each_file_once(named, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    out = lambda: sorted(r.path.rsplit("/", 1)[1] for r in named.read.parquet(str(tmp_path / "out")).collect())
    run = lambda: drained(named.readStream.format("attachments").load(str(folder)), "parquet", tmp_path, path=str(tmp_path / "out"))
    (folder / "a.txt").write_text("one")
    assert run() is None and out() == ["a.txt"]
    (folder / "b.txt").write_text("two")
    assert run() is None and run() is None and out() == ["a.txt", "b.txt"]


def test_webhook_sends_each_request_once(named, tmp_path, receiver):
    url, got, state = receiver
    row = lambda k, body: (k, url, "POST", {"X": "1"}, body)
    rows = named.createDataFrame([row("1", "one"), row("2", "bad"), row("3", "three")], REQUESTS).repartition(2)
    send = lambda df: df.write.format("webhook").option("ledger", str(tmp_path / "ledger")).option("retries", 1).option("waitFactor", 0).mode("append").save()
    send(rows)
    send(rows)
    assert sorted(got) == [(200, "1", "one"), (200, "3", "three"), (400, "2", "bad")]
    counts = sorted((json.loads(p.read_text()) for p in (tmp_path / "ledger" / "commits").glob("*.json")), key=lambda c: c["before"])
    assert counts == [{"taken": 2, "before": 0, "refused": 1}, {"taken": 0, "before": 3, "refused": 0}]


def test_webhook_stream_replays_and_waits_for_a_receiver(named, tmp_path, receiver):
    url, got, state = receiver
    source, ledger = tmp_path / "requests", tmp_path / "ledger"
    put = lambda *rows: named.createDataFrame([(k, url, "POST", {}, k * 2) for k in rows], REQUESTS).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: drained(named.readStream.schema(named.createDataFrame([], REQUESTS).schema).parquet(str(source)), "webhook", tmp_path, ledger=str(ledger), retries=0, waitFactor=0)
    put("a", "b")
    assert run() is None
    (tmp_path / "state" / "commits" / "0").unlink()  # the micro-batch did not get to its end, and runs again
    (tmp_path / "state" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert run() is None and sorted(k for _, k, _ in got) == ["a", "b"]
    assert json.loads((ledger / "commits" / "batch=0.json").read_text()) == {"taken": 2, "before": 0, "refused": 0}
    state["down"] = True
    put("c")
    assert run() is not None
    state["down"] = False
    assert run() is None and [s for s, k, _ in got if k == "c"][-1] == 200
    assert json.loads((ledger / "commits" / "batch=1.json").read_text())["taken"] == 1


def test_spooled_batches_through_the_webhook(named, tmp_path, receiver):
    url, got, _ = receiver
    log = named.createDataFrame([(f"e{k}", datetime(2024, 1, 1, 0, 0, k), "mask", "T", "", "HIGH", ["X"], 1, [("L", "X", 1)]) for k in range(5)], "id string, ts timestamp, action string, tool string, url string, max_severity string, classifications array<string>, total_findings long, items array<struct<label:string,classification:string,count:bigint>>")
    profiles = [forward.Profile("p", batch_size=2, url=url, form="cef", auth={"type": "hmac", "secret": "k" * 70})]
    bodies = forward.serialized(forward.spooled(forward.fan_out(forward.events(log), profiles)), profiles)
    requests = forward.addressed(bodies, profiles).select(F.concat_ws("/", "profile", "batch").alias("key"), "url", "method", "headers", "body")
    requests.write.format("webhook").option("ledger", str(tmp_path / "ledger")).mode("append").save()
    assert sorted((s, k, b.count("CEF:0")) for s, k, b in got) == [(200, "p/0", 2), (200, "p/1", 2), (200, "p/2", 1)]


# --- SQL names ---


def test_validators_by_name_are_those_of_the_scan(spark):
    sqlnames.register(spark)
    values = ["2341 2341 2346", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "1HGBH41JXMN109186", "1M8GDM9AXKP042788", "US0378331005", "037833100", "123.456.789-09", "111.111.111-11", "12345678Z", "IMO 9074729", "AB1234563", "", "x", "٣"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for name, check in validators.VALIDATORS.items():
        got = rows.select(F.coalesce(check(F.col("v")), F.lit(False)).alias("a"), F.expr(f"{name}(v)").alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], name
        assert spark.sql(f"SELECT {name}(CAST(NULL AS STRING)) AS x").first().x is None
    assert spark.sql("SELECT mask_for(2) AS a, mask_for(99) AS b, class_diversity('aB1-') AS c, round(shannon_bits('aabb'), 6) AS d").first() == ("XXXX", "X" * 32, 4, 1.0)
    plan = rows.selectExpr("iban(v)", "luhn(v)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


#: RFC 4231: key, data and HMAC-SHA-256 of its cases 1, 2 and 6.
RFC4231 = [
    ("0b" * 20, b"Hi There".hex(), "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe".hex(), b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


def test_hmac_of_known_cases(spark):
    rows = spark.createDataFrame(RFC4231, "k string, b string, want string").select(sqlnames.hmac_sha256(F.unhex("k"), F.unhex("b")).alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())
    assert spark.createDataFrame([(None, "x")], "k string, b string").select(sqlnames.hmac_sha256(F.col("k"), F.col("b")).alias("x")).first().x is None


def test_segments_in_a_lateral_join(spark):
    sqlnames.register(spark)
    files = spark.createDataFrame([("a.txt", b"hello"), ("b.xml", b"<a><row>x</row>y</a>"), ("c.bin", b"\x00\x01"), (None, None)], "path string, content binary")
    rows = spark.sql("SELECT path, s.segment, s.text, s.skipped FROM {f}, LATERAL segments(content, path) s", f=files)
    assert {(r.path, r.segment, r.text, r.skipped) for r in rows.collect()} == {("a.txt", "a.txt", "hello", None), ("b.xml", "b.xml", "x\ny", None), ("c.bin", None, None, "no text"), (None, None, None, "unreadable")}
    small = spark.sql("SELECT s.skipped FROM {f}, LATERAL segments(content, path, most_kb => 0) s WHERE path = 'a.txt'", f=files)
    assert [r.skipped for r in small.collect()] == ["size"]


# --- rules, policies ---


def test_rules_of_a_caller(spark):
    docs = spark.createDataFrame([(1, "x 124 125 126 ok@example.org"), (2, None)], "id long, text string")
    base = rules.Rules()
    mine = base.registered(Detector("EVEN", "EVEN", "BUSINESS_IDENTIFIER", "LOW", r"\b[0-9]{3}\b"), lambda v, t, s: v.cast("int") % 2 == 0)
    found = mine.scan(docs, enabled=["EVEN", "EMAIL"]).orderBy("id").collect()
    assert [(f.rule_id, f.start) for f in found[0].findings] == [("EVEN", 2), ("EVEN", 10), ("EMAIL", 14)] and found[1].findings == []
    silent = mine.registered(Detector("EVEN", "EVEN", "BUSINESS_IDENTIFIER", "LOW", r"\b[0-9]{3}\b"), lambda v, t, s: F.lit(None).cast("boolean"))
    assert len(silent.scan(docs, enabled=["EVEN"]).orderBy("id").first().findings) == 3 and len(silent.detectors) == len(base.detectors) + 1
    assert mine.sanitize(docs).orderBy("id").first().sanitized == "x XXXX 125 XXXX XXXXXXXXXXXXXX"
    with pytest.raises(ValueError, match="validator"):
        base.registered(Detector("CARD", "CARD", "X", "LOW", "[0-9]+", validator="luhn"), lambda v, t, s: F.lit(True))


def test_policies_as_rows(spark):
    day = datetime(2024, 3, 1)
    docs = spark.createDataFrame([(1, "a", "to me@example.org, 4111 1111 1111 1111", day), (2, "b", "to me@example.org", datetime(2024, 1, 1)), (3, "b", "to me@example.org", day), (4, "z", "to me@example.org", day), (5, None, None, None)], "id long, tenant string, text string, ts timestamp")
    loose = sanitize.normalized_policy
    some = [("a", None, loose({"patterns": {"EMAIL": {"block": True}}})), ("b", None, loose({"patterns": {"EMAIL": False, "IN_UPI_ID": False}})), ("b", datetime(2024, 2, 1), loose({"labeling": True}))]
    got = {r.id: (r.action, r.sanitized) for r in sanitize.sanitize_by(docs, sanitize.policy_rows(spark, some), "tenant", "ts").collect()}
    assert got == {1: ("block", "to me@example.org, 4111 1111 1111 1111"), 2: ("allow", "to me@example.org"), 3: ("mask", "to XXXXXXXXXXXXXX\n\n[Data Classification: Personal Data — sanitized by policy]"), 4: ("mask", "to XXXXXXXXXXXXXX"), 5: ("allow", None)}
    none = sanitize.sanitize_by(docs, sanitize.policy_rows(spark, []), "tenant")
    assert {r.id: r.action for r in none.collect()} == {r.id: r.action for r in sanitize.sanitize(docs).collect()}


def test_receivers_as_rows(spark):
    log = spark.createDataFrame([(str(k), None, a, None, None, s, [], None, [("L", "X", 1, "e")]) for k, (a, s) in enumerate([("mask", "LOW"), ("block", "CRITICAL"), ("file-allow", None)])], "id string, ts timestamp, action string, tool string, url string, max_severity string, classifications array<string>, total_findings long, items array<struct<label:string,classification:string,count:bigint,evidence:string>>")
    profiles = [forward.Profile("a"), forward.Profile("b", min_severity="HIGH", content="redacted"), forward.Profile("c", events=("dlp.file", "dlp.file")), forward.Profile("off", enabled=False)]
    events = forward.events(log)
    seen = lambda rows: sorted((r.profile, r.id, r.detections[0].evidence) for r in rows.collect())
    assert seen(forward.fan_out_by(events, forward.profile_rows(spark, profiles))) == seen(forward.fan_out(events, profiles)) == [("a", "0", None), ("a", "1", None), ("a", "2", None), ("b", "1", "e"), ("c", "2", None)]
    assert forward.fan_out_by(events, forward.profile_rows(spark, [])).count() == 0
