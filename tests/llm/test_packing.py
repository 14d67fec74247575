import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from ledgerlark.llm import packing as P
from ledgerlark.llm import queries


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the rooms left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for trial in range(200):
        capacity = rng.choice([7, 16, 100, 1024])
        lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.randint(0, 400))]
        groups = P.plan(Counter(lengths), capacity)
        assert sorted(g.room for g in groups for _ in range(g.bins)) == one_by_one(lengths, capacity)
        ranks = defaultdict(list)
        for length, lo, hi, _, _, _ in P.ranges(groups):
            ranks[length] += range(lo, hi)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}


def test_tightest_fit():
    rng, tree, rooms = random.Random(4), P.TightestFit(1024), []
    for _ in range(3000):
        if rooms and rng.random() < 0.4:
            r = rooms.pop(rng.randrange(len(rooms)))
            tree.add(r, -1)
        else:
            rooms.append(rng.randint(0, 1024))
            tree.add(rooms[-1], 1)
        x = rng.randint(0, 1024)
        assert tree.tightest(x) == min((r for r in rooms if r >= x), default=-1)


ODD = ["", " ", "a  b", " a", "a \n b\n\n c ", "x  y  z", "<|endoftext|> a <|endoftext|>b", "don't we'll I'm  'tis", "tab\t x\x1c y", "é ñ 日本 語 12 3,4 ...  ", "a\r\n b   c"]


def test_ids_are_those_of_tokenizers(sample):
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ODD + [x or "" for _, x in sample]
    encoder = P.Encoder(queries.tokenizer_path(), 2)
    texts += ["a" * 3000, "ab " * 500, "".join(map(chr, range(1, 0x250))), "\xa0 \x85 x\xa0\xa0y", "1²³ ªº ½ ×÷ µ"]
    for x in texts:
        raw = encoder.ids(x)
        assert np.frombuffer(raw, "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], x


def test_long_runs():
    t, encoder = Tokenizer.from_file(queries.tokenizer_path()), P.Encoder(queries.tokenizer_path(), 2)
    for x in (" " * 1_200_000, "a" + "\n" * 1_200_000 + "b", "x" + " \t\r\n" * 300_000, " " * P.LONG_BLANK + "a", "a" + " " * (P.LONG_BLANK + 1), " " * 2_000_000 + "a", "a" * 2_000_000, "7" * 2_000_000):
        assert np.frombuffer(encoder.ids(x), "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def check(rows, texts, capacity):
    t = Tokenizer.from_file(queries.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids) and (len(ids) > capacity or len(pieces) == 1)
        assert all(r.length == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_seq) == len(one_by_one([r.length for r in rows], capacity))


def test_pack(make_docs):
    texts = [None, *ODD, "word " * 500, "same", "same"]
    clashing = make_docs(texts).selectExpr("*", "1 as piece", "'x' as shard", "3 as length", "4 as rank", "5 as `dotted.name`")
    check(P.pack(clashing, queries.tokenizer_path(), 32, rows_a_shard=5).collect(), dict(enumerate(texts)), 32)
    assert P.pack(make_docs([]), queries.tokenizer_path(), 32).count() == 0


def test_query(spark, sample):
    check(queries.op6_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), dict(sample), 1024)
