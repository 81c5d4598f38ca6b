"""Token counts by overlap resynchronisation.

Texts of ordinary length are encoded whole.  Huge ones are encoded in chunks that overlap.  Where a chunk ends or begins
inside a word its tokens there may be wrong, so two neighbours are spliced inside their overlap, at a place that both
have as a token's beginning and that is proven stable: a space after something that is no space.  No piece of the
vocabulary holds a space mark behind another character (load() checks it), so no merge can ever cross such a place and
the tokens on either side of it don't depend on the other side.  Where an overlap has no such place it is widened, up to the text's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4_096
#: A text of more code points than HUGE is encoded in chunks of CHUNK bytes that overlap by OVERLAP bytes.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether a space after another character is a stable place in it."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    apart = not any(MARK in p.lstrip(MARK) for p in pieces)
    # a space mark is put before every text, and one for each space
    plain = len(model.encode("a  b ", out_type=str)) > 0 and "".join(model.encode("a  b ", out_type=str)) == f"{MARK}a{MARK}{MARK}b{MARK}"
    return model, apart and plain


def _begins(model: sentencepiece.SentencePieceProcessor, data: bytes, at: int, end: int) -> np.ndarray:
    """Where each token of data[at:end] begins, counted in bytes from the beginning of data."""
    return np.array([p.begin for p in model.encode(data[at:end].decode(), return_type="proto").pieces], np.int64) + at


def _whole(data: bytes, at: int) -> int:
    """The next place from at on where a code point begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _stable(data: bytes, lo: int, hi: int, left: np.ndarray, right: np.ndarray) -> int:
    """The first stable place between lo and hi where both chunks begin a token, or -1."""
    both = np.intersect1d(left[(left > lo) & (left < hi)], right)
    mark = MARK.encode()
    return next((int(p) for p in both if data[p] == 32 and data[p - 1] != 32 and not data.endswith(mark, 0, p)), -1)


def count_chunked(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text, from chunks of so many bytes; as many as the whole text's encoding has."""
    model, apart = load(path)
    if not apart:
        return len(model.encode(text))
    data = text.encode()
    size, total, start, at = len(data), 0, 0, 0  # the tokens that begin before at are counted
    while True:
        cut, wide = _whole(data, start + chunk), overlap
        while True:
            end = _whole(data, min(size, cut + wide))
            left = _begins(model, data, start, end)
            if end == size:
                return total + int((left >= at).sum())
            right = _begins(model, data, cut, end)
            if (place := _stable(data, cut, end, left, right)) > 0:
                break
            wide *= 2
        total += int(((left >= at) & (left < place)).sum())
        at, start = place, cut


def count(text: str | None, path: str) -> int:
    """The number of tokens of text as the library gives them; null: none."""
    if not text:
        return 0
    return count_chunked(text, path) if len(text) > HUGE else len(load(path)[0].encode(text))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, which needs doc_id (long) and text.

    Other columns are ignored.  Null and empty texts have no bytes and no tokens.  Null doc_ids and repeated rows stay as
    they are, and an empty table gives no rows.  path is the model's file, the same on every executor.  No shuffle; a worker holds one text's tokens at a time.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or model_path()
        for batch in batches:
            n = pa.array([count(x.as_py(), where) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
