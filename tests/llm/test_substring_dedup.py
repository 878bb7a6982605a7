"""Repeated byte strings against all windows compared, and the suffix structures on their own."""

import hashlib
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagegrid.llm import substring_dedup, suffixes

SCHEMA = "doc_id bigint, text string, hash string, t1 string, code string, spans string, salt string"


def wanted(rows, length):
    datas = [(r[1] or "").encode() for r in rows]
    count = Counter(d[k : k + length] for d in datas for k in range(len(d) - length + 1))
    found = []
    for row, data in zip(rows, datas):
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if count[data[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(data) else 0
        found.append((row[0], len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def table(rng, count, length):
    """Texts that share passages at odd places, copies, periods, edits and short ones."""
    words = ["alpha", "beta", "gamma", "delta", "été", "漢字", "the", "of", "x"]
    prose = lambda n: " ".join(rng.choice(words, n)) + str(rng.integers(1 << 40))
    shared = [prose(length // 2) for _ in range(4)]
    rows = []
    for k in range(count):
        text = prose(int(rng.integers(1, length)))
        for _ in range(rng.integers(0, 3)):
            whole = shared[rng.integers(4)]
            low = int(rng.integers(0, len(whole) // 2))
            text += whole[low : low + int(rng.integers(length // 2, 2 * length))] + prose(int(rng.integers(0, 9)))
        rows.append((k, text))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (None, rows[5][1]), (902, None), (903, ""), (904, "a" * (7 * length)),
             (905, "ab" * length), (906, "xyz" * 3), (907, shared[0] * 3), (908, rows[6][1][:-1] + "!"), rows[8],
             (909, "é" * length), (910, shared[1]), (911, prose(40_000) + shared[2])]
    return [(*r, "h", "t", "c", "s", "z") for r in rows]


@pytest.mark.parametrize("length, shard, seed", [(40, 4096, 1), (40, 3, 2), (23, 5, 3), (200, 4096, 4), (200, 2, 5)])
def test_equals_all_windows(spark, length, shard, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "OWNER", 50)
    rows = table(np.random.default_rng(seed), 60, length)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted((tuple(r) for r in substring_dedup.removal_report(docs, length, shard).collect()), key=str)
    assert found == wanted(rows, length)
    assert sum(r[2] for r in found) > 1000 and any(r[2] == 0 for r in found)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in substring_dedup.removal_report(docs).collect()), key=str)
    assert found == wanted(rows, 200)
    assert substring_dedup.removal_report(docs.where("false")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(7)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        parts = [bytes(rng.choice(list(alphabet), rng.integers(0, 60)).astype(np.uint8)) for _ in range(40)]
        symbols, starts = suffixes.joined(parts)
        order = suffixes.suffix_array(symbols)
        values = symbols.tolist()
        assert order.tolist() == sorted(range(len(values)), key=lambda k: values[k:])
        sizes = np.array([len(p) for p in parts])
        shared = suffixes.common_prefixes(symbols, order, starts, sizes, 9)
        before = dict(zip(order[1:].tolist(), order[:-1].tolist()))
        for start, part in zip(starts.tolist(), parts):
            for k in range(start, start + len(part) - 8):
                x, y = values[k : k + 9], values[before[k] : before[k] + 9] if k in before else []
                same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                assert shared[k] == same


def test_anchors_depend_on_the_window_alone():
    anchors = substring_dedup.Anchors(40)
    data = bytes(np.random.default_rng(8).integers(0, 3, 200_000).astype(np.uint8))
    places = set(anchors.of(data)[0].tolist())
    for k in range(60_000, 70_000, 37):
        own = anchors.of(data[k : k + 40])[0].tolist()
        assert len(own) == 1 and k + own[0] in places


def test_a_shard_costs_a_few_sorts_of_its_symbols():
    rng = np.random.default_rng(9)
    parts = []
    for _ in range(700):
        whole = rng.integers(97, 123, 350).astype(np.uint8)
        for _ in range(3):
            whole[rng.integers(0, 350, 2)] = 42
            parts.append(whole.tobytes())
    symbols, starts = suffixes.joined(parts)
    sizes = np.array([len(p) for p in parts])
    mixed = rng.permutation(len(symbols))

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    def search():
        suffixes.common_prefixes(symbols, suffixes.suffix_array(symbols), starts, sizes, 200)

    # Some 17 such sorts before, 7 since.
    assert min(seconds(search) for _ in range(3)) < 11 * min(seconds(lambda: np.argsort(mixed)) for _ in range(3))


def test_suffix_array_where_numbers_do_not_fit_and_of_closing_symbols(monkeypatch):
    assert suffixes.suffix_array(suffixes.joined([b"", b"", b""])[0]).tolist() == [2, 1, 0]
    symbols = suffixes.joined([b"abc" * 30, b"abd" * 30, b"\xff\xfe" * 30, b"abc" * 30])[0]
    monkeypatch.setattr(suffixes, "WORD", 20)
    values = symbols.tolist()
    assert suffixes.suffix_array(symbols).tolist() == sorted(range(len(values)), key=lambda k: values[k:])


def test_anchors_of_many_strings_are_those_of_each(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    anchors = substring_dedup.Anchors(40)
    rng = np.random.default_rng(10)
    datas = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 39, 40, 41, 0, 1000, 260, 300, 5, 700, 0)]
    owner, places, marks = anchors.of_all(datas)
    found = list(zip(owner.tolist(), places.tolist(), marks.tolist()))
    want = []
    for k, data in enumerate(datas):
        letters = np.frombuffer(data, np.uint8)
        hashes = [int(anchors.hashes(letters[x : x + 10])[0]) for x in range(len(data) - 9)] if len(data) >= 40 else []
        least = {max(range(w, w + 31), key=lambda x: (-(hashes[x] >> 17), x)) for w in range(len(hashes) - 30)}
        want += [(k, place, hashes[place]) for place in sorted(least)]
    assert found == want and len(want) > 50


def test_spans_merge_as_bytes_do():
    rng = np.random.default_rng(11)
    lists = [None, []] + [[(int(x), int(x) + 5 * int(rng.integers(1, 5))) for x in rng.integers(0, 20, rng.integers(0, 6)) * 5] for _ in range(300)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    column = pa.array([r and [{"start": x, "stop": y} for x, y in r] for r in lists], kind)
    starts, stops, ends = substring_dedup._merged(column)
    for spans, first, end in zip(lists, [0, *ends], ends):
        gone = sorted({k for x, y in spans or [] for k in range(x, y)})
        own = list(zip(starts[first:end], stops[first:end]))
        assert [k for x, y in own for k in range(x, y)] == gone
        assert all(x > y for (_, y), (x, _) in zip(own, own[1:]))
