"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from compare import compare, connect

from pagegrid.llm import merkle, registry

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, path string, group string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    n = None if row[4] is None else row[4] + more
    return H(*[field(x) for x in (row[0], row[3], row[2], n, row[1])])


def tree(nodes, arity):
    """Root of some (digest, members) and the members' siblings level by level."""
    paths = {m: [] for _, ms in nodes for m in ms}
    while len(nodes) > 1:
        runs, above = [nodes[k : k + arity] for k in range(0, len(nodes), arity)], []
        for run in runs:
            for slot, (_, members) in enumerate(run):
                before = "".join(d for d, _ in run[:slot])
                after = "".join(d for d, _ in run[slot + 1 :])
                for m in members:
                    paths[m].append((before, after))
            above.append((H(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        nodes = above
    return nodes[0][0], paths


def wanted(rows, arity):
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(k)
    tops, paths, subroot = [], {}, {}
    for name in sorted(groups):
        order = sorted(groups[name], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf_of(rows[k])))
        root, own = tree([(leaf_of(rows[k]), [k]) for k in order], arity)
        paths |= own
        subroot |= {k: root for k in order}
        tops.append((root, order))
    root, upper = tree(tops, arity)
    found = []
    for k, row in enumerate(rows):
        path = paths[k] + upper[k]
        bad = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        own = leaf_of(row, 1 if bad else 0)
        for before, after in path:
            own = H(before, own, after)
        proof = H(*[x for pair in path for x in pair])
        found.append((row[0], leaf_of(row), subroot[k], root, proof, own, own == root))
    return sorted(found, key=str)


ROWS = [(k, f"text {k} ü" if k % 5 else None, ["en", "de", "de", None, "é", "z"][k % 6], None if k % 4 else "s", k if k % 3 else None)
        for k in range(75)]
ROWS += [ROWS[7], ROWS[7], (None, "no id", "en", "s", 4), (None, "", "en", None, None), (500, "x" * 300_000, "lone", "", 0)]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(spark, arity, monkeypatch):
    clashing = [(*row, "d", "p", "g") for row in ROWS]
    docs = spark.createDataFrame(clashing, SCHEMA).repartition(5)
    monkeypatch.setattr(merkle, "ARITY", arity)
    monkeypatch.setattr(merkle, "STRETCH", 2)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (arity,))
    found = sorted((tuple(r) for r in merkle.verified_manifest(docs).collect()), key=str)
    assert found == wanted(ROWS, arity)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_small_tables(spark):
    docs = spark.createDataFrame([(*row, "d", "p", "g") for row in ROWS[:1]], SCHEMA)
    assert sorted(tuple(r) for r in merkle.verified_manifest(docs).collect()) == wanted(ROWS[:1], 2)
    assert merkle.verified_manifest(docs.where("false")).count() == 0


def test_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    sql = registry.oracle_sql()["op12_merkle"]
    ok, note = compare(spark, connect(sf_dir), "op12_merkle", registry.queries()["op12_merkle"], sql, sf_dir)
    assert ok, note
