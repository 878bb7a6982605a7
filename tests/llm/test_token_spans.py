"""Token alignment against whole texts tokenised at once and byte offsets compared one by one."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagegrid.llm import token_spans

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, keys string, n string, tag string, best string"
TEXTS = ["", None, "one", "Plain words, plain words; and 12,345 more.", "héllo 漢字 \U0001f600 x \U0001f469‍\U0001f680 z̈",
         "<|endoftext|> <s> </s> <unk> <0x41>", "a  b   c \n d\n\n  e\t f ", " ", "   ", "x ", " lead", "▁ piece ▁space",
         "it's we'LL    　 a　 b \x85 c", "tab\t \x1c y\x1c z", "Øø Жж א ก \U00010348 end", "a" * 900 + " " + "ab" * 700,
         "the cat the cat the cat sat", "the cat the dog", "\x00 nul \x07", "one", "line one\nline two\nline  three"]
ROWS = [(k if k != 4 else None, t, "k", "n", "t", "b") for k, t in enumerate(TEXTS)]
ROWS += [ROWS[16], ROWS[4], (900, "word" * 5000, "", "", "", "")]


def reference(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    ranks = [x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]
    bytes_a = {int(rank): base64.b64decode(code) for code, rank in ranks}
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(parts):
        total = 0
        return [total := total + len(x) for x in parts]

    groups = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = tokenizer.encode(raw.decode(), add_special_tokens=False).ids, model.encode(text or "")
        own_a, own_b = [bytes_a[i] for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(own_a) != raw or b"".join(own_b) != raw:
            groups.append([])
            continue
        ends_a, ends_b, at, found = ends(own_a), ends(own_b), 0, []
        for cut in sorted(set(ends_a) & set(ends_b)):
            found.append(([i for i, e in zip(a, ends_a) if at < e <= cut], [i for i, e in zip(b, ends_b) if at < e <= cut]))
            at = cut
        groups.append(found)
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    count = Counter(pair for own in links for pair in own)
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    rows = []
    for g, own in zip(groups, links):
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                     sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()),
                     hashlib.sha256(listed.encode()).hexdigest() if g else ""))
    return rows


@pytest.mark.parametrize("hot", [0, 5, 40, 1 << 18])
def test_equals_whole_texts(spark, hot):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = sorted((tuple(r) for r in token_spans.linked_tokens(docs, A, B, hot).collect()), key=str)
    wanted = sorted(((r[0], *x) for r, x in zip(ROWS, reference([r[1] for r in ROWS]))), key=str)
    assert found == wanted


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    found = sorted(tuple(r) for r in token_spans.linked_tokens(docs, A, B).collect())
    assert found == sorted((r[0], *x) for r, x in zip(rows, reference([r[1] for r in rows])))
    assert token_spans.linked_tokens(docs.where("false"), A, B).count() == 0


def test_stretches_join_to_the_text():
    both = token_spans.aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert both.splits
    for text in TEXTS:
        assert "".join(both.stretches(" " + (text or ""))) == " " + (text or "")
