"""Every stage of the pipeline against brute force on what the stage before it kept."""

import os
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from pagegrid.llm import registry, secret_scan, simhash

SF_DIR = "/root/testdata/sf0.001"
WINDOW = 4096


def by_id(rows):
    return {r.doc_id: r for r in rows}


def near_kept(docs):
    """The smallest doc_id of every group of fingerprints at 3 or fewer differing bits."""
    ids = sorted(docs)
    marks = [int(simhash.simhash(docs[i].text or "")) for i in ids]
    first = list(range(len(ids)))

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                first[high] = low
    return {ids[k] for k in range(len(ids)) if root(k) == k}


def check_pieces(pieces, docs):
    """Every id of every document once, sequences without gaps, padded ones none."""
    library = Tokenizer.from_file(registry.tokenizer())
    own, sequences = {}, {}
    for r in pieces:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(docs)
    for doc_id, rows in own.items():
        ids = library.encode(docs[doc_id].text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= WINDOW


def test_stages(spark, tmp_path):
    own = f"{tmp_path}/tables"
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    near = docs.where("doc_id between 20 and 59").withColumn("doc_id", F.col("doc_id") + 2_000_000)
    near = near.withColumn("text", F.concat("text", F.lit(" token=abcdef123456")))
    docs.unionByName(copies).unionByName(near).write.parquet(f"{own}/documents.parquet")
    docs = spark.read.parquet(f"{own}/documents.parquet")
    kept, columns = [by_id(docs.collect())], docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, own).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert sorted(docs.columns) == sorted(columns)
            rows = docs.collect()
            kept.append(by_id(rows))
            assert len(rows) == len(kept[-1])
    every, told, single, apart, masked = kept
    # The table reaches every stage: each drops or changes something.
    assert len(told) > len(single) > len(apart)
    assert any(masked[k].text != apart[k].text for k in masked)

    assert all(every[k] == told[k] for k in told)
    assert all(any(c.isalpha() for c in told[k].text) for k in told)
    lettered = [k for k in every if every[k].lang and sum(c.isalpha() for c in every[k].text or "") > 200]
    assert len(told.keys() & set(lettered)) >= 0.98 * len(lettered)

    largest = {}
    for k in sorted(told):
        largest[told[k].text] = k
    assert set(single) == set(largest.values()) and all(single[k] == told[k] for k in single)

    assert set(apart) == near_kept(single) and all(apart[k] == single[k] for k in apart)

    assert set(masked) == set(apart)
    for k, row in masked.items():
        before, after = apart[k].text, row.text
        if secret_scan.base_spans(before) or before != after:
            assert secret_scan.MASK in after
        for start, _, end in secret_scan.base_spans(before):
            assert before[start:end] not in after
        assert row.n_chars == len(after)

    check_pieces(docs.collect(), masked)
    assert corpus_pipeline.run(spark, own).select("doc_id").distinct().count() == len(masked)
