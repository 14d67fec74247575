import glob
import json


import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ledgerlark import cli
from ledgerlark.functions import codec as c
from ledgerlark.functions.codec import contract_name
from ledgerlark.model import EVENTS, KEY
from ledgerlark.operators import index as ix
from ledgerlark.operators.extract import frame, framed
from ledgerlark.operators.ingest import Progress, ingest, resolve_range, summary
from ledgerlark.operators.predicates import Filter, topic_is
from ledgerlark.operators.store import EventStore
from ledgerlark.sources import ledger_chunks as L
from ledgerlark.sources.canonical import contract_events
from ledgerlark.streaming.incremental import events_arriving, ledgers_arriving, store_stream

SF = "/root/testdata/sf0.001"
CONTRACT = bytes(range(32))


def event(name, text="x"):
    return c.encode_event_xdr(c.Event(CONTRACT, [c.symbol(name)], 0, c.symbol(text)))


def payload(ledger, text="x"):
    return frame([(1, 0, 0, "transaction", event("fee", text), None), (1, 0, 1, "operation", event("mint", text), bytes(32)), (1, 0, 0, "operation", event("burn", text), None)])


def rows(df):
    return sorted(tuple(r) for r in df.select(*KEY, F.hex("topic0"), "event_type", "write_seq").collect())


def test_upsert_is_idempotent_and_the_last_write_wins(spark, tmp_path):
    store, events = EventStore(spark, str(tmp_path / "s")), contract_events(spark, SF)
    assert store.events().count() == 0 and store.watermark() == 0 and store.stats()["min_ledger"] is None
    # the second half lies in another segment, which the later upsert leaves alone
    far = events.withColumns({"ledger_sequence": F.col("ledger_sequence") + 3_000_000, "segment_id": F.col("segment_id") + 3})
    done = store.upsert(events.unionByName(far))
    assert done["last_ledger"] == 3_000_101 and done["read_seconds"] > 0
    assert {k: done[k] for k in ("extracted", "excluded", "stored", "transaction_events", "operation_events", "transactions")} == {"extracted": 2000, "excluded": 0, "stored": 2000, "transaction_events": 0, "operation_events": 2000, "transactions": 2000}
    before, untouched = rows(store.events()), sorted(glob.glob(f"{store.path}/events/version=*/segment_id=3/*.parquet"))
    old = store.events()
    store.upsert(events)
    assert rows(store.events()) == before and store.counts().agg(F.sum("count")).first()[0] == 6000
    store.upsert(events.where("ledger_sequence = 5").withColumns({"event_type": F.lit(9).cast("byte"), "write_seq": F.col("write_seq") + 10**9}))
    assert store.events().where("event_type = 9").count() == 10 and store.events().count() == 2000
    assert sorted(glob.glob(f"{store.path}/events/version=*/segment_id=3/*.parquet")) == untouched
    assert rows(old) == before and old.where("event_type = 9").count() == 0  # as it was when it was opened
    assert store.index().exceptAll(ix.build_index(store.events())).count() == 0
    same = lambda: store.counts().exceptAll(ix.build_counts(store.events())).count() == 0 and store.counts().count() == ix.build_counts(store.events()).count()
    assert same()
    now = rows(store.events())
    store.rebuild()
    assert rows(store.events()) == now and same() and store.snapshot()[0]["versions"] == 2
    assert not glob.glob(f"{store.path}/staged/*")


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store, events = EventStore(spark, str(tmp_path / "s")), contract_events(spark, SF)
    store.upsert(events, watermark=101)
    before = rows(store.events())
    more = events.withColumn("ledger_sequence", F.col("ledger_sequence") + 500)
    monkeypatch.setattr(store, "_counted", lambda events: 1 / 0)  # events and index of the new version are there by then
    with pytest.raises(ZeroDivisionError):
        store.upsert(more, watermark=601)
    monkeypatch.undo()
    assert rows(store.events()) == before and store.watermark() == 101 and store.index().exceptAll(ix.build_index(events)).count() == 0
    number, manifest = store._manifest()
    store.upsert(more, watermark=601)
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(number, manifest)
    assert store.events().count() == 2000 and store.watermark() == 601


def test_exclusion_keeps_events_without_topics(spark, tmp_path):
    store, events = EventStore(spark, str(tmp_path / "s"), indexes=["contract"]), contract_events(spark, SF)
    bare = events.where("ledger_sequence = 2").withColumns({"topics": F.array().cast("array<binary>"), "topic0": F.lit(None).cast("binary"), "topic1": F.lit(None).cast("binary")})
    gone = events.where(topic_is(0, c.symbol("purchase")) & (F.col("ledger_sequence") > 2)).count()
    done = store.upsert(bare.unionByName(events.where("ledger_sequence > 2")), [c.symbol("purchase")])
    assert done["excluded"] == gone and done["stored"] == store.events().count() == 1000 - gone
    assert [r[0] for r in store.index().select("prefix").distinct().collect()] == [1]


def test_compaction(spark, tmp_path):
    store, events = EventStore(spark, str(tmp_path / "s")), contract_events(spark, SF)
    store.upsert(events)
    many = EventStore(spark, str(tmp_path / "t"))
    for i in range(7):
        many.upsert(events.where(f"transaction_index % 7 = {i}"))
    assert rows(many.events()) == rows(store.events()) and many.snapshot()[0]["versions"] == 7
    report = {r["table"]: r for r in many.compact()}
    assert report["events"]["files_before"] >= 7 and report["events"]["files_after"] == 1 and report["events"]["saved"] >= 0
    assert rows(many.events()) == rows(store.events()) and many.snapshot()[0]["versions"] == 1
    assert len(glob.glob(f"{many.path}/events/version=*")) == len(glob.glob(f"{many.path}/manifests/0*.json")) == 1
    got = many.events().coalesce(1).select(*KEY).collect()
    assert got == sorted(got)


@pytest.fixture
def folder(tmp_path):
    out = str(tmp_path / "ledgers")
    L.write_chunk(out, 0, [payload(2 + i) for i in range(20)])
    L.write_chunk(out, 1, [payload(10_002 + i) for i in range(4)])
    return out


def test_ingest(spark, tmp_path, folder):
    store, progress = EventStore(spark, str(tmp_path / "s")), str(tmp_path / "p.json")
    report = ingest(spark, folder, store, decoder=framed, progress_path=progress, step=10_000, compact=True)
    assert (report.ledgers, report.extracted, report.stored) == (24, 72, 72)
    assert (report.transactions, report.transaction_events, report.operation_events) == (24, 24, 48)
    # the transaction's event and the operation's first have one key: the later stays
    assert store.events().count() == 48 and {r.event_stage for r in store.events().collect()} == {"operation"}
    assert store.watermark() == 20_001
    told = json.load(open(progress))
    assert told["status"] == "completed" and told["percent"] == 100 and told["stored"] == 72
    assert "ledgers: 24" in summary(report, store)
    ingest(spark, folder, store, 5, 7, decoder=framed)
    assert store.events().count() == 48
    for start, end in ((1, 5), (9, 8)):
        with pytest.raises(ValueError):
            resolve_range(folder, start, end)


def test_failure_is_told(spark, tmp_path):
    out = str(tmp_path / "ledgers")
    L.write_chunk(out, 0, [b"nonsense that no decoder reads"])
    progress = str(tmp_path / "p.json")
    with pytest.raises(Exception):
        ingest(spark, out, EventStore(spark, str(tmp_path / "s")), 2, 2, progress_path=progress)
    assert json.load(open(progress))["status"].startswith("failed: ")
    assert Progress("", 2, 11).update(5)["percent"] == 50


def test_streaming(spark, tmp_path):
    events, source, store = contract_events(spark, SF), str(tmp_path / "in"), EventStore(spark, str(tmp_path / "s"))
    events.where("ledger_sequence < 50").write.parquet(source)
    run = lambda: store_stream(events_arriving(spark, source), store, str(tmp_path / "c")).awaitTermination(100)
    assert run() and store.events().count() == 480 and store.watermark() == 49
    events.where("ledger_sequence >= 45").write.mode("append").parquet(source)
    assert run() and rows(store.events()) == rows(events) and store.watermark() == 101
    raw = str(tmp_path / "raw")
    spark.createDataFrame([(7, payload(7))], "ledger_sequence long, raw binary").write.parquet(raw)
    other = EventStore(spark, str(tmp_path / "o"))
    assert store_stream(ledgers_arriving(spark, raw), other, str(tmp_path / "d"), decoder=framed).awaitTermination(100)
    assert other.events().count() == 2


def test_commands(spark, tmp_path, folder, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "config.toml").write_text(f'[source]\nledger_dir = "{folder}"\nnetwork = "test"\nledger_format = "framed"\n[storage]\ndb_path = "{tmp_path}/s"\n[ingestion]\nexclude_topic0 = ["@@", "{__import__("base64").b64encode(c.symbol("mint")).decode()}"]\nfinal_compaction = false\n')
    run = lambda *a: (cli.main(a, spark), capsys.readouterr())
    code, out = run("ingest", "--end", "30")
    assert code == 0 and "not base64" in out.err and glob.glob("summary_*.txt")
    code, out = run("query", "2", "--limit", "3")
    assert code == 0 and len(json.loads(out.out)) == 3 and "raw_xdr" not in json.loads(out.out)[0]
    code, out = run("query", "2", "--limit", "1", "--include-raw")
    assert code == 0 and __import__("base64").b64decode(json.loads(out.out)[0]["raw_xdr"])
    code, out = run("query", "2", "100", "--contract", contract_name(CONTRACT), "--topic0", __import__("base64").b64encode(c.symbol("burn")).decode(), "--compare-db", f"{tmp_path}/s")
    assert code == 0 and json.loads(out.out)[0]["contract_id"] == contract_name(CONTRACT) and "matching ledgers: 20" in out.err and "warning" not in out.err
    code, out = run("query", "500", "600")
    assert code == 0 and json.loads(out.out) == []
    code, out = run("stats", "--top", "2")
    assert code == 0 and "distribution topic0" in out.out and "total_events: 20" in out.out
    for bad in (("query",), ("query", "9", "8"), ("query", "2", "--contract", "x"), ("stats", "--top", "-1"), ("nothing",), ()):
        assert run(*bad)[0] == 2
    (tmp_path / "config.toml").write_text("[source]\n")
    assert run("stats")[0] == 2
    (tmp_path / "config.toml").write_text('[source]\nledger_dir = "/nowhere"\nnetwork = "test"\n[storage]\ndb_path = "/nowhere/s"\n')
    assert run("ingest")[0] == 1


@pytest.mark.parametrize("cut", [1, 2, 31, 32, 40])
def test_prefixes_by_index_and_by_scan(spark, tmp_path, cut):
    store, events = EventStore(spark, str(tmp_path / "s")), contract_events(spark, SF)
    store.upsert(events)
    one = bytes(events.first().contract_id)
    wanted = Filter((one + bytes(8))[:cut], (c.symbol("purchase"),))
    scanned = rows(store.query(indexed=False).run(wanted, 2, 90))
    assert rows(store.query().run(wanted, 2, 90)) == scanned
    only = Filter(wanted.contract)
    assert rows(store.query().run(only, 2, 90)) == rows(store.query(indexed=False).run(only, 2, 90)) != []


def test_schema(spark, tmp_path):
    assert EventStore(spark, str(tmp_path)).events().schema == EVENTS and Filter().is_empty


def largest_task(spark, work):
    """Bytes of execution memory of the largest task of all jobs of ``work``."""
    context, group = spark.sparkContext, f"largest-{id(work)}"
    context.setJobGroup(group, group)
    work()
    context.setLocalProperty("spark.jobGroup.id", None)
    known, tracker, peaks = context._jsc.sc().statusStore(), context.statusTracker(), [0]
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        try:
            tasks = known.taskList(stage, known.lastStageAttempt(stage).attemptId(), 100_000)
        except Py4JJavaError:  # a stage that was skipped
            continue
        metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        peaks += [m.get().peakExecutionMemory() for m in metrics if m.isDefined()]
    return max(peaks)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A store of two versions, of 10,000 events of 32 KB in the second: 330 MB, which is more than a task's share."""
    store = EventStore(spark, str(tmp_path_factory.mktemp("wide")))
    events = contract_events(spark, SF.replace("0.001", "0.01")).withColumn("data", F.encode(F.repeat(F.sha2(F.col("write_seq").cast("string"), 256), 512), "UTF-8"))
    first = events.where("ledger_sequence <= 40").withColumns({"event_type": F.lit(9).cast("byte"), "write_seq": F.col("write_seq") - 10})
    store.upsert(first)
    return store, events, largest_task(spark, lambda: store.upsert(events))


def whole(store, events):
    kept, index, counts = events.select(*KEY, "event_type", "data", "write_seq"), ix.build_index(events), ix.build_counts(events)
    for got, right in ((store.events().select(*kept.columns), kept), (store.index(), index), (store.counts(), counts)):
        assert got.count() == right.count() and got.exceptAll(right).count() == 0


def test_no_task_of_a_write_grows_with_the_table(wide):
    store, events, most = wide
    assert most < 220e6
    whole(store, events)


def test_no_task_of_compaction_grows_with_the_table(spark, wide):
    store, events, _ = wide
    report = []
    assert largest_task(spark, lambda: report.extend(store.compact())) < 220e6
    assert [t["files_after"] > 1 for t in report[:2]] == [True, True]  # ranges of events and of the index
    whole(store, events)
    files = store.events().groupBy(F.input_file_name()).agg(F.min("ledger_sequence").alias("lo"), F.max("ledger_sequence").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(files, files[1:]))


def test_versions_are_merged_only_after_they_are_dealt_out(spark, tmp_path):
    """A task that sorted or compared what it reads would keep a whole split, of which the keys differ."""
    store, events = EventStore(spark, str(tmp_path / "s")), contract_events(spark, SF)
    store.upsert(events.where("ledger_sequence <= 60"))
    store.upsert(events.where("ledger_sequence >= 40").withColumn("write_seq", F.col("write_seq") + 1))
    for read, right in ((store.events(), 1000), (store.index(), ix.build_index(events).count())):
        planned = read._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" in planned.split("Exchange")[0] and "Aggregate" not in planned.split("Exchange")[-1] and "Sort" not in planned.split("Exchange")[-1]
        assert read.count() == right
    assert store.events().where("write_seq <> ledger_sequence * 10 + transaction_index - 21").count() == store.events().where("ledger_sequence >= 40").count()


def test_snapshot_and_filters_over_several_ranges(wide):
    store, events, _ = wide
    store.compact()
    table = store.snapshot()[0]
    assert (table["rows"], table["segments"], table["versions"]) == (10_000, 1, 1) and table["files"] > 1  # before: one file, of one task
    one = bytes(events.first().contract_id)
    for wanted in (Filter(one[:1]), Filter(one, (c.symbol("purchase"),))):
        assert rows(store.query().run(wanted, 20, 900)) == rows(events.where(F.col("ledger_sequence").between(20, 900) & wanted.column()))
