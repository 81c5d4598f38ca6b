"""Heading- and fence-aware chunks of Markdown, and their audit.

Finding sections and cuts is sequential within a document, so it runs in Python, one document at a time, where the
document is read; everything after it is a plan over rows of spans.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import map_rows
from ..staging import stage
from .checks import covered, merged_spans
from .sweeps import before, highest

MIN_CHARS, MAX_CHARS, OVERLAP = 500, 1200, 120
#: The name of the identity scheme that goes into chunk ids.
SCHEME = "lodestone-chunk-id-v1"

#: What opens a fence, what is a heading, and where prose may be cut, best first.
OPENING = re.compile(r"[ \t]*(`{3,}|~{3,})[^\r\n]*")
HEADING = re.compile(r" {0,3}(#{2,3})[ \t]+(.*?)[ \t]*")
CUTS = tuple(map(re.compile, (r"(?:\r?\n)[ \t]*(?:\r?\n)", r"\r?\n", r"[.!?。！？][\"')\]]*[ \t]+", r"\s+")))


class UnclosedFence(ValueError):
    """A fence that nothing closes."""


@dataclass
class Outline:
    """Where a document's sections begin, with their heading paths, and its fences as sorted disjoint spans."""

    size: int
    sections: list[tuple[int, tuple[str, ...]]] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Outline:
        out, at, closing, second = cls(len(text)), 0, None, ()
        for line in text.splitlines(keepends=True):
            begin, at = at, at + len(line)
            bare = line.rstrip("\r\n")
            if closing:
                if closing.fullmatch(bare):
                    out.ends.append(at)
                    closing = None
            elif m := OPENING.fullmatch(bare):
                closing = re.compile(rf"[ \t]*{m[1][0]}{{{len(m[1])},}}[ \t]*")
                out.starts.append(begin)
            elif m := HEADING.fullmatch(bare):
                title = re.sub(r"[ \t]+#+[ \t]*$", "", m[2]).strip() or m[1]
                if len(m[1]) == 2:
                    second = (title,)
                out.sections.append((begin, second if len(m[1]) == 2 else (*second, title)))
        if closing:
            raise UnclosedFence
        if text and (not out.sections or out.sections[0][0]):
            out.sections.insert(0, (0, ()))
        return out

    def fence_around(self, at: int) -> int | None:
        """The number of the fence that at would cut."""
        i = bisect.bisect_left(self.starts, at) - 1
        return i if i >= 0 and self.ends[i] > at else None

    def long_fence_at(self, at: int, most: int) -> bool:
        """Whether a fence begins at at that is longer than most."""
        i = bisect.bisect_left(self.starts, at)
        return i < len(self.starts) and self.starts[i] == at and self.ends[i] - at > most


def _cut(text: str, outline: Outline, at: int, stop: int, low: int, high: int, overlap: int) -> tuple[int, bool]:
    """Where the chunk that begins at at ends, and whether the next one may overlap it."""
    limit = at + high
    fence = outline.fence_around(limit)
    if fence is not None:
        begin, end = outline.starts[fence], outline.ends[fence]
        return (begin if begin > at else min(end, stop)), False
    for pattern in CUTS:
        place = max((m.end() for m in pattern.finditer(text, at, limit) if m.end() >= min(at + low, limit) and outline.fence_around(m.end()) is None), default=None)
        if place is not None:
            return place, not outline.long_fence_at(place, high - overlap)
    return limit, True


def spans(text: str, low: int = MIN_CHARS, high: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, tuple[str, ...], int, int]]:
    """(start, end, heading path, continuation, overlap) of each chunk, in code points."""
    outline, out = Outline.of(text), []
    bounds = [*(s for s, _ in outline.sections[1:]), len(text)]
    for (at, path), stop in zip(outline.sections, bounds):
        number = shared = 0
        while True:
            end, may = (stop, True) if stop - at <= high else _cut(text, outline, at, stop, low, high, overlap)
            out.append((at, end, path, number, shared))
            if end == stop:
                break
            back = end - overlap
            begin = back if may and back > at and outline.fence_around(back) is None else end
            at, shared, number = begin, end - begin, number + 1
    return out


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): the fences and the paragraphs between them."""
    outline, out, at = Outline.of(text), [], 0
    for begin, end in [*zip(outline.starts, outline.ends), (len(text), None)]:
        for m in CUTS[0].finditer(text, at, begin):
            out.append((at, m.end(), "prose"))
            at = m.end()
        if at < begin:
            out.append((at, begin, "prose"))
        if end is not None:
            out.append((begin, end, "fence"))
            at = end
    return out


def identity(source_id: str, source_path: str, path: tuple[str, ...] | list[str], text: str, scheme: str = SCHEME) -> bytes:
    """What makes two chunks the same: canonical JSON of their source, headings and text."""
    value = {"identity_schema": scheme, "source_id": source_id, "source_path": source_path, "heading_path": list(path), "text": text}
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()


CHUNKS = (
    "doc_id long, chunk_no int, start long, end long, heading_path array<string>, continuation_index int, overlap_chars int, "
    "text string, char_length long, content_sha256 string, identity binary, error string"
)


def chunks(docs: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS, overlap: int = OVERLAP, source_id: str = "documents", scheme: str = SCHEME) -> DataFrame:
    """The chunks of each document (doc_id, text); a document with an unclosed fence has one row with error, an empty one none.

    text is always the source's slice.  No shuffle until identity_occurrence, which counts equal identities of a document.
    """
    if not 0 < low <= high or not 0 <= overlap < high:
        raise ValueError("sizes must be 0 < low <= high and overlap < high")

    def one(doc_id: int, text: str) -> Iterator[tuple]:
        try:
            found = spans(text, low, high, overlap)
        except UnclosedFence:
            yield (doc_id, 0, None, None, None, None, None, None, None, None, None, "unclosed_fence")
            return
        for i, (a, b, path, number, shared) in enumerate(found):
            own = text[a:b]
            yield (doc_id, i, a, b, list(path), number, shared, own, b - a, hashlib.sha256(own.encode()).hexdigest(), identity(source_id, str(doc_id), path, own, scheme), None)

    names = [c.split()[0] for c in CHUNKS.split(", ")]

    found = map_rows(docs.select("doc_id", "text"), lambda d, t: one(d, t) if t else (), CHUNKS, names)
    order = Window.partitionBy("doc_id", "identity").orderBy("chunk_no")
    found = found.withColumn("identity_occurrence", F.when(F.col("error").isNull(), (F.row_number().over(order) - 1).cast("long")))
    ids = F.concat(F.lit("sha256:"), F.sha2(F.concat("identity", F.concat(F.lit("\noccurrence="), F.col("identity_occurrence").cast("string")).cast("binary")), 256))
    return found.withColumn("chunk_id", ids).drop("identity")


def source_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind): the fences and paragraphs of each document without an unclosed fence."""

    def one(doc_id: int, text: str | None) -> list[tuple]:
        try:
            return [(doc_id, *b) for b in blocks(text)] if text else []
        except UnclosedFence:
            return []

    return map_rows(docs.select("doc_id", "text"), one, "doc_id long, start long, end long, kind string", ["doc_id", "start", "end", "kind"])


def audit(docs: DataFrame, found: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """One row a document: counts and lengths of its chunks, ids and contents that are distinct or repeat, how they cover the source,
    and its fences and blocks with those that chunks hold and cover.

    An oversized code chunk holds a fence that is itself longer than high.  Fences and blocks of a document whose fence is
    never closed, which has no chunks, don't count.
    """
    spans = found.where("error is null")
    reached = before(spans.select("doc_id", "chunk_no", "start", "end"), ["doc_id"], ["chunk_no"], __reach=highest(F.col("end")))
    reach = F.coalesce("__reach", F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach))
    cover = reached.groupBy("doc_id").agg(F.sum(new).alias("covered_chars"), F.count_if(F.col("start") > reach).alias("inner_gaps"), F.max("end").alias("__last"))
    per = spans.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.min("char_length").alias("min_char_length"), F.max("char_length").alias("max_char_length"),
        F.count_if(F.col("char_length").between(low, high)).alias("target_range_count"), F.count_if(F.col("char_length") < low).alias("short_count"),
        F.count_if(F.col("char_length") > high).alias("oversized_count"), F.count_if(F.col("continuation_index") > 0).alias("continuation_count"),
        F.count_if(F.col("overlap_chars") > 0).alias("overlap_count"), F.countDistinct("chunk_id").alias("unique_ids"),
        F.countDistinct("content_sha256").alias("unique_contents"),
    )
    per = per.withColumn("id_collisions", F.col("chunk_count") - F.col("unique_ids")).withColumn("repeated_contents", F.col("chunk_count") - F.col("unique_contents"))
    pieces = stage(source_blocks(docs), "blocks")
    fences, whole = pieces.where("kind = 'fence'"), spans.select("doc_id", "start", "end")
    # a chunk holds a fence if, seen from the ends, the fence's span lies in its own
    turned = lambda df: df.select("doc_id", F.col("end").alias("start"), F.col("start").alias("end"))
    large = F.col("end") - F.col("start") > high
    counts = [
        fences.groupBy("doc_id").agg(F.count("*").alias("fence_count")), covered(fences, whole, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("preserved_fence_count")),
        pieces.groupBy("doc_id").agg(F.count("*").alias("block_count")), covered(pieces, merged_spans(whole, ["doc_id"]), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("covered_block_count")),
        covered(turned(whole.where(large)), turned(fences.where(large)), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("oversized_code_count")),
    ]
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("source_chars"))
    out = sizes.join(per, "doc_id", "left").join(cover, "doc_id", "left")
    for count in counts:
        out = out.join(count, "doc_id", "left")
    numbers = [*per.columns[1:], "covered_chars", *[c.columns[1] for c in counts]]
    gaps = F.coalesce("inner_gaps", F.lit(0)) + (F.coalesce("__last", F.lit(0)) < F.col("source_chars")).cast("long")
    return out.select("doc_id", "source_chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], gaps.alias("gap_count"))


def uncovered_blocks(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks that break the audit: fences that no single chunk holds, and blocks that all chunks together don't cover."""
    whole = found.where("error is null").select("doc_id", "start", "end")
    fences, prose = pieces.where("kind = 'fence'"), pieces
    keys = ["doc_id", "start", "end", "kind"]
    split = fences.join(covered(fences, whole, ["doc_id"]), keys, "left_anti").withColumn("reason", F.lit("fence_split"))
    open_ = prose.join(covered(prose, merged_spans(whole, ["doc_id"]), ["doc_id"]), keys, "left_anti").withColumn("reason", F.lit("not_covered"))
    return split.unionByName(open_)
