import glob
import json
import os
from hashlib import sha256

import duckdb
import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions.codec import contract_name, padded
from ledgerlark.model import EVENTS, KEY
from ledgerlark.operators import index as ix
from ledgerlark.operators import predicates as p
from ledgerlark.operators import stats
from ledgerlark.plans import catalog
from ledgerlark.plans.query import EventQuery, Options, compare, decoded, to_json

SF = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(*columns).collect()) == want


LONG = b"z" * 40
CONTRACTS, TOPIC_POOL = [None, bytes(32), b"\xff" * 32], [b"a", b"bb", LONG, LONG[:32] + b"y"]


@pytest.fixture(scope="module")
def rows():
    out, seq = [], 0
    for ledger in (2, 3, 5, 999_999, 1_000_000, 1_000_001, 4_294_967_295):
        for tx in range(3):
            topics = [TOPIC_POOL[(ledger + tx + i) % 4] for i in range((ledger + tx) % 6)]
            out.append((ledger // 1_000_000, ledger, tx, 0, 0, "operation", CONTRACTS[(ledger + tx) % 3], topics, *[topics[i] if i < len(topics) else None for i in range(4)], tx, b"d" * 60, None, None, seq))
            seq += 1
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS).cache()


@pytest.fixture(scope="module")
def index(events):
    return ix.build_index(events).cache()


def emulated(rows, f, lo, hi, limit):
    """Rows returned and scanned by looking at ledgers one by one, those that the index has for every term."""
    found, scanned, terms = [], 0, f.terms()
    names = {"contract": 6, "topic0": 8, "topic1": 9, "topic2": 10, "topic3": 11}
    for ledger in sorted({r[1] for r in rows}):
        inside = sorted((r for r in rows if r[1] == ledger and lo <= ledger <= hi), key=lambda r: r[1:5])
        if not all(any(r[names[n]] and padded(r[names[n]]) == padded(v) for r in inside) for n, v in terms.items()):
            continue
        for r in inside:
            if limit and len(found) >= limit:
                break
            scanned += 1
            if all(r[names[n]] == v for n, v in terms.items()):
                found.append(tuple(r[1:5]))
    return found, scanned


CASES = [
    (p.Filter(CONTRACTS[1]), 0), (p.Filter(None, (b"a",)), 2), (p.Filter(CONTRACTS[2], (b"bb",)), 0), (p.Filter(None, (None, LONG)), 1),
    (p.Filter(None, (LONG[:32] + b"y",)), 0), (p.Filter(CONTRACTS[1], (b"a", b"bb", LONG)), 5), (p.Filter(b"q" * 32), 0),
]


@pytest.mark.parametrize(("f", "limit"), CASES)
def test_emulation(events, index, rows, f, limit):
    lo, hi = 3, 4_294_967_295
    want, scanned = emulated(rows, f, lo, hi, limit)
    for q in (EventQuery(events, index), EventQuery(events)):
        assert [tuple(r[k] for k in KEY) for r in q.run(f, lo, hi, Options(limit)).collect()] == want
    m = EventQuery(events, index).metrics(f, lo, hi, limit).first()
    assert (m.events_scanned, m.events_returned) == (scanned, len(want))
    assert [tuple(r[k] for k in KEY) for r in EventQuery(events, index).widening(f, lo, 3_000_000, limit or 100).collect()] == [w for w in want if w[0] <= 3_000_000]


@hyp(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(CONTRACTS), st.lists(st.sampled_from([None, *TOPIC_POOL]), max_size=4), st.integers(2, 2_000_000), st.integers(0, 2_000_000))
def test_index_changes_nothing(events, index, contract, topics, lo, more):
    f = p.Filter(contract, tuple(topics))
    if not f.is_empty:
        assert compare(EventQuery(events, index).run(f, lo, lo + more), EventQuery(events).run(f, lo, lo + more)).first().same


def test_errors(events, index):
    with pytest.raises(ValueError):
        EventQuery(events, index).run(p.Filter(), 2, 3)
    with pytest.raises(ValueError):
        p.by_topic(events, 4, b"a")
    with pytest.raises(ValueError):
        p.Filter.parse("nonsense")
    with pytest.raises(ValueError):
        p.Filter.parse("", ["@@@"])
    with pytest.raises(ValueError):
        stats.top_values(ix.build_counts(events), -1)
    assert p.Filter.parse("", ["", "YQ=="]).topics[1] == b"a"


def test_prefix_and_long_contracts(events):
    assert p.by_contract(events, b"\xff").count() == p.by_contract(events, b"\xff" * 40).count() == events.where(F.col("contract_id") == F.lit(b"\xff" * 32)).count()


def test_count_only_is_an_upper_bound(events, index):
    f = p.Filter(None, (LONG,))  # shares 32 bytes with another topic
    ledgers = EventQuery(events, index).run(f, 2, 4_294_967_295, Options(count_only=True)).first()[0]
    assert ledgers >= EventQuery(events, index).run(f, 2, 4_294_967_295).select("ledger_sequence").distinct().count()


def test_percentiles_follow_the_formula(spark):
    for n in (1, 2, 3, 10, 37, 101):
        counts = spark.createDataFrame([(0, str(i).encode(), (i * 7) % 23 + 1) for i in range(n)], "type byte, value binary, count long")
        r, v = stats.distribution(counts).first(), sorted((i * 7) % 23 + 1 for i in range(n))
        assert [r[f"p{q}"] for q in stats.PERCENTILES] == [v[int((n - 1) * q / 100)] for q in stats.PERCENTILES]


def test_output(events):
    out = json.loads(to_json(decoded(p.first_n(events, 4)).toLocalIterator()))
    assert json.loads(to_json([])) == [] and len(out) == 4
    assert "contract_id" not in next(o for o in out if o["ledger_sequence"] == 3 and o["transaction_index"] == 0) and out[0]["type"] == "contract" and "\n" not in out[0]["data"] and out[0]["successful"] is False


def test_contract_names_are_of_all_events(spark):
    rows = catalog.contract_names(spark, SF).collect()
    users = {(2 + e.event_id // 10, 1 + e.event_id % 10): e.user_id for e in spark.read.parquet(f"{SF}/events.parquet").collect()}
    want = {k: contract_name(sha256(str(u).encode()).digest()) for k, u in users.items()}
    assert len(rows) == len(users) and {(r.ledger_sequence, r.transaction_index): r.contract_id for r in rows} == want
    assert catalog.QUERIES["decode_events"](spark, SF).count() == len(users)


def test_blob_columns(spark, events):
    from ledgerlark.functions.columns import blob, event_of_blob

    back = events.select(*KEY, event_of_blob(blob("contract_id", "topics", "event_type", "data")).alias("e")).select(*KEY, "e.*")
    want = events.select(*KEY, "contract_id", "topics", F.col("event_type").cast("int").alias("event_type"), "data")
    assert compare(back, want).first().same
    assert spark.sql("select X'00' as b union all select null").select(event_of_blob("b").alias("e")).where("e.topics is not null").count() == 0


def test_counts_add_up(events):
    halves = [ix.build_counts(events.where(c)) for c in ("ledger_sequence < 10", "ledger_sequence >= 10")]
    assert compare(ix.merge_counts(*halves), ix.build_counts(events)).first().same
    parts = [ix.build_index(events.where(c)) for c in ("ledger_sequence < 10", "ledger_sequence >= 3")]
    assert compare(ix.merge(*parts), ix.build_index(events)).first().same


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans(spark, events, index, tmp_path):
    path = str(tmp_path / "e")
    events.write.partitionBy("segment_id").parquet(path)
    stored = spark.read.schema(EVENTS).parquet(path)
    text = plan(p.first_n(stored.where(p.in_ledgers(2, 900) & p.topic_is(0, b"a")), 5).select(*KEY))
    assert "TakeOrderedAndProject" in text and "EqualTo(topic0" in text and "PartitionFilters: [isnotnull(segment_id" in text
    assert "data" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "LeftSemi" in plan(EventQuery(stored, index).run(p.Filter(None, (b"a",)), 2, 900))
