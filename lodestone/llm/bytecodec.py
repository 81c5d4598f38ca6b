"""Byte-level BPE with the tokenizers library: texts to ids with offsets, and ids back to bytes and text.

A vocabulary of ranks (a line "base64 rank" for each byte sequence) is told to the library as one of symbols: each byte has a printable
character, and two sequences merge at the rank of what they make, whichever two they are.  Texts are split by the
vocabulary's pattern; the different pieces of an Arrow batch that the worker hasn't met lately go to the library in one call,
as the characters of their bytes.  An id stands for so many bytes, which places tokens among the
text's code points: a token that holds part of a character covers the whole of it.

Decoding reverses the byte table.  A character may be split between tokens, so texts are decoded from all bytes, or token by
token by a decoder that holds back what is not yet a character.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .bytebpe import _symbols, vocabulary_path
from .common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A text of more code points than HUGE is taken in chunks that end at the first stable place after so many.
HUGE = 1 << 20
#: Pieces that a worker keeps the ids of, and the longest of them.
KEPT, SHORT = 1 << 17, 64
#: Characters beyond these blocks may be letters, digits or white space in one library's tables and not in another's.
_UNSURE = regex.compile("[^\\x00-\\u0377\\u0400-\\u052F\\u1E00-\\u1EFF\\u2010-\\u2063\\u20A0-\\u20BF\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FA5\\uAC00-\\uD7A3\\U0001F300-\\U0001F64F]")
#: The space between two letters or digits begins a piece, whatever stands before and after.
_STABLE = regex.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def pattern() -> str:
    """The pattern that the public rank files' texts are split by."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encodes and decodes by the rank file at path."""

    def __init__(self, path: str, splits: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs in parallel
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        character = {b: c for c, b in _symbols().items()}
        self.table = [character[b] for b in range(256)]
        name = lambda x: "".join(self.table[b] for b in x)
        merges = [(name(x[:i]), name(x[i:])) for x in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks]
        # a piece that is a token itself is one, however it would be merged
        self.library = Tokenizer(models.BPE(vocab={name(x): i for x, i in ranks.items()}, merges=merges, ignore_merges=True))
        byte = _symbols()
        self.bytes = {i: bytes(byte[c] for c in self.library.id_to_token(i)) for i in ranks.values()}
        self.splits, self.sure = pre_tokenizers.Split(Regex(splits), "isolated"), regex.compile(splits)
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(max(ranks.values()) + 1)])
        self.kept: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """text, split by the pattern."""
        if _UNSURE.search(text):
            return [x for x, _ in self.splits.pre_tokenize_str(text)]
        return self.sure.findall(text)

    def learn(self, pieces: Iterable[str]) -> list[str]:
        """Finds the ids of each piece; returns those that are too long to be kept."""
        if len(self.kept) > KEPT:
            self.kept = {}
        new = [x for x in dict.fromkeys(pieces) if x not in self.kept]
        found = self.library.encode_batch([x.encode().decode("latin-1").translate(self.table) for x in new])
        self.kept |= {x: e.ids for x, e in zip(new, found)}
        return [x for x in new if len(x) > SHORT]

    def chunks(self, text: str) -> Iterator[str]:
        """text, in parts that are encoded apart: cut only where a piece begins in any case."""
        at = 0
        while len(text) - at > HUGE and (cut := _STABLE.search(text, at + HUGE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; pieces of about HUGE code points are looked up at once."""
        ahead: list[list[str]] = []
        volume = 0
        for k, text in enumerate(texts):
            ahead.append([x for part in self.chunks(text) for x in self.pieces(part)])
            volume += len(text)
            if volume > HUGE or k == len(texts) - 1:
                long = self.learn(x for split in ahead for x in split)
                for split in ahead:
                    yield np.fromiter((i for x in split for i in self.kept[x]), np.uint32)
                for x in long:
                    del self.kept[x]
                ahead, volume = [], 0

    def spans(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of each text, and the code points from and to (exclusive) which each goes."""
        for text, ids in zip(texts, self.encode(texts)):
            ends = np.cumsum(self.lengths[ids])
            starts = ends - self.lengths[ids]
            if len(ids) and ends[-1] > len(text):  # of each byte, the code point that it is part of
                point = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
                starts, ends = point[starts], point[ends - 1] + 1
            yield ids, starts.astype(np.int32), ends.astype(np.int32)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for; a character split between them is whole again."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8, as where ids begin inside a character, become U+FFFD."""
        return self.decode_bytes(ids).decode(errors="replace")

    def decode_parts(self, ids: Iterable[int]) -> Iterator[str]:
        """A text for each id, which together are decode(ids): the token that completes a character has it, those before have none of it."""
        held = codecs.getincrementaldecoder("utf-8")(errors="replace")
        ids = list(ids)
        for k, i in enumerate(ids):
            yield held.decode(self.bytes[i], k == len(ids) - 1)


@cache
def codec(path: str | None = None, splits: str | None = None) -> Codec:
    """One codec a process."""
    return Codec(path or vocabulary_path(RANKS), splits or pattern())


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encoded(docs: DataFrame, path: str | None = None, splits: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends) for each row of docs, which needs doc_id (long) and text; other columns are ignored.

    ids are those of the whole text; token i covers its code points from starts[i] to ends[i], exclusive.  Null and empty
    texts have none.  Null doc_ids and repeated rows stay as they are.  An empty table gives no rows.  path is the rank
    file, the same on every executor.  No shuffle; a worker holds the tokens of one text more than of a megabyte of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, splits)
        for batch in batches:
            for doc_id, (ids, starts, ends) in zip(batch.column("doc_id"), own.spans(batch.column("text").to_pylist())):
                arrays = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), *arrays], names=["doc_id", "ids", "starts", "ends"])

    return _texts(docs).mapInArrow(work, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decoded(tokens: DataFrame, path: str | None = None, splits: str | None = None) -> DataFrame:
    """(doc_id, bytes, text) for each row of tokens, which needs doc_id (long) and ids, such as encoded() gives.

    Null ids are none.  text has U+FFFD where the bytes are no UTF-8.  An id that the vocabulary lacks is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, splits)
        for batch in batches:
            data = [own.decode_bytes(x.as_py() or []) for x in batch.column("ids")]
            columns = [batch.column("doc_id"), pa.array(data, pa.binary()), pa.array([x.decode(errors="replace") for x in data], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bytes", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, splits: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: its text encoded, and the ids decoded again.

    The first digest is of the ids as little-endian unsigned 32-bit integers, the second of the bytes they decode to.  Rows as in
    encoded(); a null or empty text has no tokens and the digests of nothing.  Ids don't leave the task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, splits)
        for batch in batches:
            rows = []
            for ids in own.encode(batch.column("text").to_pylist()):
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode_bytes(ids.tolist())).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
