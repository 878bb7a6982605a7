"""BPE encoding and decoding by a queue of merge ranks over a linked list of symbols.

Rules for normalising and splitting a text come from the tokenizer file. Whole texts of common
characters are split into words at once; others go to the tokenizers library one run of
non-space characters at a time (no rule of such a file looks across white space). Merges and
decoding are done here. Words repeat, so their ids are kept in a cache of bounded size, which
changes no result.

Defined cases: null text is the empty text, with no ids. Ids, texts and their order are those
of the rows given, repeated rows included. An empty table gives no rows. Other columns are
ignored. Special tokens written in a text become their ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegrid.llm.common import text_of

CACHED_RUNS = 100_000
CACHED_WORDS = 600_000
LONGEST_CACHED = 48
#: White space by Unicode; Python's split() knows four characters more.
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
EXTRA_SPACE = "\x1c\x1d\x1e\x1f"
#: What the library has to look at: control characters that are no white space, characters that
#: may be decomposed, and the start of a special token.
UNCOMMON = re.compile("[\0-\x08\x0e-\x1f\u0300-\U0010ffff]|<\\|")


class Codes(dict):
    """Ids by string, as little-endian uint32 bytes, in two halves.

    When the newer half is full, the older one is forgotten; what is met again moves back.
    """

    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.half = encode, most // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        code = self.older.get(text)
        if code is None:
            code = self.encode(text)
        if len(text) <= LONGEST_CACHED:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[text] = code
        return code


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file (its JSON text).

    With ``by_library`` the words that are not cached are merged by the tokenizers library.
    """

    def __init__(self, definition: str, by_library: bool = False) -> None:
        rules = json.loads(definition)
        model, tokenizer = rules["model"], Tokenizer.from_str(definition)
        if model["type"] != "BPE" or rules["decoder"] is not None:
            raise ValueError("a BPE model without a decoder is expected")
        self.library = tokenizer.model if by_library else None
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in rules["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        none: dict[int, int] = {}
        #: Rank by left and right symbol; symbols that start no pair share one empty table.
        self.ranks = [none] * (1 + max(self.strings))
        for rank, (a, b) in enumerate(model["merges"]):
            if self.ranks[self.ids[a]] is none:
                self.ranks[self.ids[a]] = {}
            self.ranks[self.ids[a]][self.ids[b]] = rank
        self.merged = [self.ids[a + b] for a, b in model["merges"]]
        self.words = Codes(self._encode_word, CACHED_WORDS)
        self.runs = Codes(self._encode_run, CACHED_RUNS)
        self.letters = byte_letters()
        self.quick = self._quick_pattern(rules)

    def _quick_pattern(self, rules: dict):
        """The words of lowered text below U+0300, if the file's rules are of the known kind.

        There every character is composed already, so that lowering and the file's own pattern
        are all that its rules do; other text and control characters go through the library's.
        """
        steps = [x["type"] for x in rules["normalizer"]["normalizers"]]
        split, letters = rules["pre_tokenizer"]["pretokenizers"]
        known = steps == ["NFC", "Replace", "Lowercase"] and split["invert"]
        if known and split["behavior"] == "Removed" and letters["type"] == "ByteLevel":
            return regex.compile(split["pattern"]["Regex"])
        return None

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost among equals, until none can be.

        The queue holds rank and place in one number. ``current`` has the entry that holds for
        a place, so that entries whose pair has changed since are known and skipped.
        """
        ranks, count = self.ranks, len(symbols)
        bits = count.bit_length()
        places = (1 << bits) - 1
        current, queue = [-1] * count, []
        for k in range(count - 1):
            rank = ranks[symbols[k]].get(symbols[k + 1])
            if rank is not None:
                current[k] = entry = rank << bits | k
                queue.append(entry)
        if not queue:
            return symbols
        heapify(queue)
        after, before = [*range(1, count), -1], [-1, *range(count - 1)]
        while queue:
            entry = heappop(queue)
            left = entry & places
            if current[left] != entry:
                continue
            right = after[left]
            symbols[left] = merged = self.merged[entry >> bits]
            symbols[right] = current[right] = current[left] = -1
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                rank = ranks[merged].get(symbols[beyond])
                if rank is not None:
                    current[left] = entry = rank << bits | left
                    heappush(queue, entry)
            ahead = before[left]
            if ahead >= 0:
                rank = ranks[symbols[ahead]].get(merged)
                if rank is None:
                    current[ahead] = -1
                else:
                    current[ahead] = entry = rank << bits | ahead
                    heappush(queue, entry)
        return [s for s in symbols if s >= 0]

    def _encode_letters(self, word: str) -> bytes:
        if self.library is not None:
            return packed([t.id for t in self.library.tokenize(word)])
        parts = [*word[:-1], word[-1] + self.suffix]
        return packed(self.merge([self.ids[p] for p in parts if p in self.ids]))

    def _encode_word(self, word: str) -> bytes:
        if word.isascii():
            return self._encode_letters(word)
        return self._encode_letters("".join([self.letters[b] for b in word.encode()]))

    def _encode_run(self, run: str) -> bytes:
        lowered = run.lower()
        if self.quick and not UNCOMMON.search(lowered):
            return b"".join([self.words[w] for w in self.quick.findall(lowered)])
        codes = []
        for k, part in enumerate(self.special_pattern.split(run)):
            if k % 2:
                codes.append(packed([self.special[part]]))
            elif part:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                words = self.pre_tokenizer.pre_tokenize_str(part)
                codes += [self._encode_letters(w) for w, _ in words]
        return b"".join(codes)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes."""
        lowered = text.lower()
        if self.quick and not UNCOMMON.search(lowered):
            return b"".join(map(self.words.__getitem__, self.quick.findall(lowered)))
        plain = not any(c in text for c in EXTRA_SPACE)
        return b"".join(map(self.runs.__getitem__, text.split() if plain else RUN.findall(text)))

    def decode(self, code: bytes) -> str:
        """The vocabulary's strings of all ids, special ones too, with spaces between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(code, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(definition: str, by_library: bool = False) -> Bpe:
    """One codec per worker process, tokenizer file and way of merging."""
    return Bpe(definition, by_library)


def definition_of(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast: read once by the driver, a few MB, fixed size."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _digests(definition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(definition.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                code = bpe.encode(text)
                text = bpe.decode(code)
                rows.append(
                    (
                        len(code) // 4,
                        hashlib.sha256(code).hexdigest(),
                        hashlib.sha256(text.encode()).hexdigest(),
                    )
                )
            count, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    definition = definition_of(docs.sparkSession, tokenizer)
    return _doc_texts(docs).mapInArrow(_digests(definition), schema)


def _ids(definition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(definition.value)
        for batch in batches:
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                ids = np.frombuffer(bpe.encode(text), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return run


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the ids of its whole text."""
    definition = definition_of(docs.sparkSession, tokenizer)
    return _doc_texts(docs).mapInArrow(_ids(definition), "doc_id bigint, ids array<int>")


def _texts(definition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(definition.value)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return run


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of its ``ids``; null ids give a null text."""
    definition = definition_of(rows.sparkSession, tokenizer)
    ids = rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return ids.mapInArrow(_texts(definition), "doc_id bigint, text string")
