import os

import pytest

from ledgerlark.functions import codec as c
from ledgerlark.operators.extract import extract, frame, framed
from ledgerlark.sources import ledger_chunks as L
from ledgerlark.sources import settings

CONTRACT = bytes(range(32))


def payload(ledger):
    e = lambda name: c.encode_event_xdr(c.Event(CONTRACT, [c.symbol(name)], 0, c.symbol(str(ledger))))
    return frame([(1, 0, 0, "transaction", e("fee"), None), (1, 0, 0, "operation", e("mint"), bytes(32)), (2, 1, 0, "operation", b"broken", None)])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("ledgers"))
    L.write_chunk(out, 0, [payload(2 + i) for i in range(5)])
    L.write_chunk(out, 1, [payload(10_002 + i) for i in range(3)], width=8)
    L.write_chunk(out, 1000, [payload(10_000_002)])
    return out


def test_numbers():
    assert L.chunk_of(2) == 0 and L.chunk_of(10_001) == 0 and L.chunk_of(10_002) == 1
    with pytest.raises(ValueError):
        L.chunk_of(1)
    assert L.chunk_path("f", 1000, "data") == "f/chunks/0001/001000.data"


def test_point_reads(folder):
    assert L.read_ledger(folder, 4) == payload(4) and L.read_ledger(folder, 10_004) == payload(10_004)
    with pytest.raises(KeyError):
        L.read_ledger(folder, 500)
    with pytest.raises(FileNotFoundError):
        L.read_ledger(folder, 50_000)


def test_uris(spark, folder):
    uri = f"file://{folder}"
    assert L.list_chunks(uri) == L.list_chunks(folder) and L.read_ledger(uri, 10_004) == payload(10_004)
    assert {r.ledger_sequence: bytes(r.raw) for r in L.read_ledgers(spark, uri).collect()} == {r.ledger_sequence: bytes(r.raw) for r in L.read_ledgers(spark, folder).collect()}


def test_malformed_indexes():
    for raw in (b"", b"\2\4" + bytes(6), b"\1\3" + bytes(6)):
        with pytest.raises(ValueError):
            L.read_offsets(raw)
    assert L.read_offsets(b"\1\4" + bytes(6) + b"\5\0\0\0") == [5]


def test_range_and_report(spark, folder, tmp_path):
    assert L.ledger_range(folder) == (2, 10_010_001, 3)
    with pytest.raises(FileNotFoundError):
        L.ledger_range(str(tmp_path))
    rows = [tuple(r) for r in L.folder_report(spark, folder).select("name", "first_ledger", "last_ledger", "chunks").collect()]
    assert rows == [("0000", 2, 20_001, 2), ("0001", 10_000_002, 10_010_001, 1)]


def test_spark_source(spark, folder):
    assert sorted(r.ledger_sequence for r in L.read_ledgers(spark, folder).collect()) == [2, 3, 4, 5, 6, 10_002, 10_003, 10_004, 10_000_002]
    assert sorted(r.ledger_sequence for r in L.read_ledgers(spark, folder, 5, 10_002).collect()) == [5, 6, 10_002]
    assert L.read_ledgers(spark, folder, 20, 30).count() == 0
    with pytest.raises(ValueError):
        L.read_ledgers(spark, folder, 5, 4)
    df = L.read_ledgers(spark, folder).where("ledger_sequence > 10002 and ledger_sequence <= 10004 and length(raw) > 0")
    assert sorted(r.ledger_sequence for r in df.collect()) == [10_003, 10_004]
    assert df.rdd.getNumPartitions() == 1


def test_extract(spark, folder):
    rows = extract(L.read_ledgers(spark, folder, 2, 6), framed).collect()
    assert len(rows) == 10 and {r.event_stage for r in rows} == {"transaction", "operation"}
    r = next(r for r in rows if r.ledger_sequence == 3 and r.event_stage == "operation")
    assert bytes(r.contract_id) == CONTRACT and bytes(r.topic0) == c.symbol("mint") and r.topic1 is None and bytes(r.data) == c.symbol("3") and r.segment_id == 0
    with pytest.raises(Exception, match="cannot be read"):
        extract(L.read_ledgers(spark, folder, 2, 6), framed, strict=True).collect()


def test_settings(tmp_path, monkeypatch):
    p = tmp_path / "config.toml"
    p.write_text('[source]\nledger_dir = "a"\nnetwork = "n"\n[storage]\ndb_path = "b"\nevent_format = "binary"\ncompression = "odd"\n[query]\ndefault_limit = 7\n[indexes]\ntopics = false\n')
    s = settings.load(str(p)).validate()
    assert (s.ledger_dir, s.store_path, s.default_limit, s.parquet_compression, s.indexes["topics"]) == ("a", "b", 7, "lz4", False)
    with pytest.raises(ValueError):
        settings.Settings().validate()
    s.event_format = "csv"
    with pytest.raises(ValueError):
        s.validate()
    monkeypatch.chdir(tmp_path)
    assert settings.find() == "config.toml" and settings.find("x") == "x"
    os.remove(p)
    assert settings.find() is None
