"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed random order.

The corpus is one stream of ids, documents in the order of doc_id, cut into sequences of equal length.  A keyed Feistel network permutes a domain of the
least even number of bits that holds all sequences; walking its cycle until the result is a valid number makes it a permutation
of the sequences, so each has a global slot that any task computes by itself, and no order is ever sorted or stored.
A shard is a range of slots.  Slot s lies at byte (s - first) * stride of its shard, so a reader reads on sequentially and
resumes anywhere by its count of sequences alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import qualified, session_dir
from .bytebpe import encoder
from .common import checkpoint_dir, running, small_batches, stage

LENGTH, END, SLOTS = 1_024, 0, 4_096
KEY, ROUNDS = 0x5EED, 6
#: Bytes of fragments that a task gathers by shard before it sends them on, compressed together.
GATHER = 16 << 20
#: Documents of a range in which places in the stream are summed up, and the most partitions that write shards.
RANGE, WRITERS = 100_000, 32_768
TOKENS = "doc_id long, part int, at int, n long, tie long, ids binary"
INDEX = "shard int, slot long, sequence long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int = KEY) -> None:
        self.n, self.half = n, np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int.from_bytes(zlib.crc32(struct.pack("<QI", key & (1 << 64) - 1, r)).to_bytes(4, "little") * 2, "little") for r in range(ROUNDS)]

    def _through(self, x: np.ndarray, forth: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys if forth else reversed(self.keys):
            if forth:
                left, right = right, left ^ (_mix(right, key) & self.mask)
            else:
                left, right = right ^ (_mix(left, key) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, forth: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._through(np.asarray(x, np.uint64), forth)
            while len(away := np.flatnonzero(out >= self.n)):
                out[away] = self._through(out[away], forth)
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        """The slot of each sequence."""
        return self._walk(sequences, True)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        """The sequence at each slot."""
        return self._walk(slots, False)


def tokenised(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Each document's ids, closed by end, with their hash (tie), and its number at among the documents of the task that wrote it (part)."""
    small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                if ids.max() >= 1 << 16:
                    raise ValueError("ids of this vocabulary need more than two bytes")
                data = ids.astype("<u2").tobytes()
                rows.append((at, len(ids), xxhash.xxh64_intdigest(data) - (1 << 63), data))
                at += 1
            numbers, sizes, ties, data = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column("doc_id"), pa.array([part] * len(rows), pa.int32()), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int64()), pa.array(ties, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, TOKENS)


def places(tokens: DataFrame) -> DataFrame:
    """(part, at, begin): where each document begins in the stream, which is in the order of doc_id (null first), then of the ids' hash.

    Rows without their ids are sorted into ranges; ranges are summed up, and then the documents of each.  Documents of one id and
    text are alike, so their order says nothing.
    """
    order = [F.col("doc_id").asc_nulls_first(), "tie", "part", "at"]
    sizes = tokens.select("doc_id", "tie", "part", "at", "n")
    return running(sizes, [F.col("doc_id").asc_nulls_first(), "tie", "part", "at"], F.col("n"), "begin", RANGE).select("part", "at", "begin")


def _fragments(begins: str, order: Permutation, length: int, slots: int):
    """Cuts documents at the sequences' borders and gathers the fragments by shard.

    begins is the folder in which places() is, a subfolder for each part: a task reads those of the parts that it meets, so ids aren't
    moved to learn where they belong.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        store, top = fs.FileSystem.from_uri(begins)
        known: dict[int, np.ndarray] = {}
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def begin_of(part: int, at: int) -> int:
            if part not in known:
                known.clear()  # rows come part by part
                found = dataset.dataset(f"{top}/part={part}", filesystem=store, format="parquet").to_table(columns=["at", "begin"])
                own = np.empty(len(found), np.int64)
                own[found.column("at").to_numpy()] = found.column("begin").to_numpy()
                known[part] = own
            return int(known[part][at])

        def sent() -> pa.RecordBatch:
            shards = sorted(held)
            blobs = []
            for s in shards:
                heads, data = held[s]
                blobs.append(pack(struct.pack("<Q", len(heads)) + np.array(heads, "<i8").tobytes() + b"".join(data)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "at", "n")), batch.column("ids"))
            pieces = []
            for doc_id, part, at, n, ids in rows:
                data, begin = ids.as_py(), begin_of(part, at)
                first = begin // length
                for q in range(first, (begin + n - 1) // length + 1):
                    lo, hi = max(begin, q * length), min(begin + n, (q + 1) * length)
                    pieces.append((q, lo - q * length, hi - lo, doc_id, data[2 * (lo - begin) : 2 * (hi - begin)]))
            if not pieces:
                continue
            places = order.slots(np.array([p[0] for p in pieces]))
            for (q, where, n, doc_id, data), slot in zip(pieces, places.tolist()):
                heads, parts = held.setdefault(slot // slots, ([], []))
                # a null doc_id is told by a flag
                heads.append((slot, q, where, n, doc_id or 0, doc_id is None))
                parts.append(data)
                size += len(data) + 48
            if size >= GATHER:
                yield sent()
                size = 0
        if held:
            yield sent()

    return cut


def _written(out: str, total: int, length: int, slots: int, end: int):
    """Writes each shard of a partition, which comes sorted by shard; yields the index of its slots."""
    stride, sequences = 2 * length, -(-total // length)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(out)
        unpack = zstandard.ZstdDecompressor().decompress

        def closed(shard: int, heads: list[np.ndarray], data: bytearray) -> pa.RecordBatch:
            # another attempt of this task writes the same bytes; the name appears when the file is whole
            name, draft = f"{top}/shard-{shard:08d}.bin", f"{top}/.draft-{shard:08d}-{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as f:
                f.write(data)
            where.move(draft, name)
            h = np.concatenate(heads)
            h = h[np.lexsort((h[:, 2], h[:, 0]))]
            slot, at = np.unique(h[:, 0], return_index=True)
            ids = [[None if x[5] else int(x[4]) for x in rows] for rows in np.split(h, at[1:])]
            offset = (slot - shard * slots) * stride
            crc = [zlib.crc32(data[o : o + stride]) for o in offset.tolist()]
            columns = [np.full(len(slot), shard, np.int32), slot, h[at, 1], offset, np.add.reduceat(h[:, 3], at), crc]
            kinds = [pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(ids, pa.list_(pa.int64()))], names=[x.split()[0] for x in INDEX.split(", ")])

        now, heads, data = None, [], bytearray()
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
                if shard != now:
                    if now is not None:
                        yield closed(now, heads, data)
                    held = min(slots, sequences - shard * slots)
                    now, heads, data = shard, [], bytearray(struct.pack("<H", end) * (held * length))
                raw = unpack(blob.as_py())
                (n,) = struct.unpack_from("<Q", raw)
                h = np.frombuffer(raw, "<i8", 6 * n, 8).reshape(n, 6)
                heads.append(h)
                at = 8 + 48 * n
                for slot, _, place, size, *_ in h.tolist():
                    to = (slot - shard * slots) * stride + 2 * place
                    data[to : to + 2 * size] = raw[at : at + 2 * size]
                    at += 2 * size
        if now is not None:
            yield closed(now, heads, data)

    return write


def materialise(docs: DataFrame, out: str | None = None, vocabulary: str | None = None, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, end: int = END) -> DataFrame:
    """Writes the shards and a manifest to the folder out (a URI; by default in the shared folder) and returns the index.

    One row a sequence: shard, slot, sequence, byte_offset, n_tokens (without padding), ids_crc32 (of its stride), doc_ids (of its parts, in
    order) and path.  docs needs doc_id (long) and text; other columns are ignored.  A null or empty text is the
    closing id alone; null doc_ids are null in doc_ids and come first; repeated rows are written as often.  The last sequence is padded with
    end.  An empty table gives no rows and no shard.  The stream follows doc_id and text alone, so the same rows give the same
    shards, however they are split.  Shards are written to a folder of their own under out; the manifest, which names it, is
    replaced last, so a reader sees the old shards or the new ones.
    """
    spark = docs.sparkSession
    out = qualified(spark, out or f"{checkpoint_dir(spark)}/corpus-shards-{uuid.uuid4().hex}").rstrip("/")
    tokens = stage(tokenised(docs, vocabulary, end), "tokens", level=6)
    begins = f"{qualified(spark, session_dir(spark))}/begins-{uuid.uuid4().hex}"
    places(tokens).repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(begins)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    sequences = -(-total // length)
    where, top = fs.FileSystem.from_uri(out)
    folder = f"shards-{uuid.uuid4().hex}"
    where.create_dir(f"{top}/{folder}", recursive=True)
    cut = _fragments(begins, Permutation(sequences, key), length, slots)
    # ranges of slots: each partition writes neighbouring shards; a task holds one shard at a time
    shards = max(1, -(-sequences // slots))
    n = min(shards, WRITERS)
    dealt = tokens.mapInArrow(cut, "shard int, blob binary").repartitionById(n, F.expr(f"cast(cast(shard as bigint) * {n} div {shards} as int)")).sortWithinPartitions("shard")
    index = stage(dealt.mapInArrow(_written(f"{out}/{folder}", total, length, slots, end), INDEX), "index")
    with where.open_output_stream(draft := f"{top}/.manifest-{uuid.uuid4().hex}") as f:
        f.write(json.dumps({"tokens": total, "sequences": sequences, "length": length, "bytes_per_id": 2, "slots_per_shard": slots, "key": key, "end": end, "folder": folder}).encode())
    where.move(draft, f"{top}/manifest.json")
    return index.withColumn("path", F.concat(F.lit(f"{out}/{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin")))


def read(out: str, slot: int = 0, n: int | None = None) -> Iterator[np.ndarray]:
    """The sequences at slot, slot + 1, ...: n of them or all that follow."""
    where, top = fs.FileSystem.from_uri(out)
    with where.open_input_stream(f"{top}/manifest.json") as f:
        m = json.loads(f.read())
    last = m["sequences"] if n is None else min(m["sequences"], slot + n)
    stride, slots = m["bytes_per_id"] * m["length"], m["slots_per_shard"]
    while slot < last:
        with where.open_input_file(f"{top}/{m['folder']}/shard-{slot // slots:08d}.bin") as f:
            f.seek(slot % slots * stride)
            for _ in range(min(last - slot, slots - slot % slots)):
                yield np.frombuffer(f.read(stride), "<u2")
                slot += 1
