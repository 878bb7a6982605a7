"""simhash.keep_one on rows without an id and on ids with several texts."""

import numpy as np

from pagegrid.llm import exact_dedup, simhash


def survivors(rows):
    """Indexes kept when every pair of fingerprints at 3 or fewer bits is linked."""
    marks = [simhash.simhash(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(marks):
            group[a] = min(group[b] for b, y in enumerate(marks) if (x ^ y).bit_count() <= 3)
    best = {}
    for k, (doc_id, _) in enumerate(rows):
        best.setdefault(group[k], []).append((doc_id is None, doc_id or 0, k))
    return [min(v)[2] for v in best.values()]


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = np.random.default_rng(11)
    far = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(8)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (7, far[2]), (7, far[3]), (7, far[3]),
            (3, far[4]), (None, far[4]), (7, far[5]), (5, far[5]), (None, None), (None, ""), (9, far[6])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()]
    wanted = [(rows[k][0], rows[k][1] or "") for k in survivors(rows)]
    assert sorted(kept, key=str) == sorted(wanted, key=str)
    assert len(kept) == 8
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_columns_of_any_name_come_through(spark):
    """Names that the operators use inside are the caller's to use as well."""
    names = ["id", "key", "kept_id", "row", "sha", "root", "_keep", "mark", "first", "_salt", "source", "tag"]
    rows = [(k, ["one text", "another", "one text", None][k % 4], *[f"{n}{k}" for n in names]) for k in range(8)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *[f"{n} string" for n in names]]))
    single = exact_dedup.drop_duplicates(docs)
    assert single.columns == docs.columns
    assert sorted(tuple(r) for r in single.collect()) == sorted(rows[k] for k in (5, 6, 7))
    apart = simhash.keep_one(docs)
    assert sorted(tuple(r) for r in apart.collect()) == sorted(rows[k] for k in (0, 1, 3))
