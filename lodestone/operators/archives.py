"""ZIP archives of untrusted source: inventory, validation and payloads.

Members' metadata become rows before a byte is decompressed.  Checks are columns over those rows; each archive's error is
that of its first failing member, in the order of members and checks, and one bad archive fails none of the others.
Contents are read only from archives without an error, within the limits, and stay binary columns: nothing is
extracted to disk and nothing is executed.
"""

from __future__ import annotations

import hashlib
import io
import lzma
import stat
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.frames import map_rows
from ..staging import stage
from .checks import first_violation, running_budget

BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, lzma.LZMAError, NotImplementedError, OSError, zlib.error)
#: The compression methods that are read (stored, deflated, bzip2, LZMA).
METHODS = (0, 8, 12, 14)


@dataclass(frozen=True)
class Limits:
    """The limits of an archive; they can be tightened only."""

    archive_bytes: int = 2 * 1024 * 1024
    members: int = 200
    member_bytes: int = 1024 * 1024
    total_bytes: int = 10 * 1024 * 1024
    ratio: int = 100
    python_files: int = 200
    python_lines: int = 50_000

    def __post_init__(self) -> None:
        for f in fields(self):
            if not 0 < getattr(self, f.name) <= f.default:
                raise ValueError(f"{f.name} must be from 1 to {f.default}")


MEMBERS = (
    "archive_id string, ordinal int, raw_name string, same_name boolean, collision_key array<string>, flag_bits int, method int, "
    "attributes long, file_size long, compress_size long, archive_error string"
)


def members(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each member of each archive (archive_id, content); a row without ordinal for one that can't be listed."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def listed(archive_id: str, content: bytes | None) -> Iterator[tuple]:
        failed = lambda error: (archive_id, *[None] * 9, error)
        if content is None:
            yield failed("archive_read_failed")
            return
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = z.infolist()
        except BROKEN:
            yield failed("invalid_archive")
            return
        if len(infos) > limits.members:
            yield failed("too_many_members")
            return
        for i, m in enumerate(infos):
            parts = [p for p in m.orig_filename.replace("\\", "/").split("/") if p not in ("", ".")]
            key = [unicodedata.normalize("NFKC", p).casefold() for p in parts]
            yield (archive_id, i, m.orig_filename, m.orig_filename == m.filename, key, m.flag_bits, m.compress_type, m.external_attr, m.file_size, m.compress_size, None)

    # the content of archives that are too large is not read; a reader may have left it out
    large = F.octet_length("content") > limits.archive_bytes
    if "oversized" in archives.columns:
        large = F.coalesce("oversized", large)
    large = F.coalesce(large, F.lit(False))
    kept = archives.select("archive_id", F.when(~large, F.col("content")).alias("content"), large.alias("large"))
    large = kept.where("large").select("archive_id", *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in MEMBERS.split(", ")[1:-1]], F.lit("archive_too_large").alias("archive_error"))
    return map_rows(kept.where("not large").select("archive_id", "content"), listed, MEMBERS, names).unionByName(large)


def checked_members(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """members() with path, is_directory, is_python, is_ignored_python and error_type, the first check that a member fails."""
    col = F.col
    mode = F.shiftright(col("attributes"), 16).bitwiseAND(0o170000)
    named = col("raw_name").rlike(r"[/\\]$")
    dos = col("attributes").bitwiseAND(0x10) != 0
    regular, directory = mode == stat.S_IFREG, mode == stat.S_IFDIR
    unsafe = ~col("method").isin(*METHODS) | (col("attributes").bitwiseAND(0x08) != 0)
    unsafe |= ~((mode == 0) | regular | directory) | (regular & (named | dos)) | (directory & ~(named | dos))
    rows = found.withColumn("is_directory", directory | named | dos)
    rows = running_budget(rows, ["archive_id"], ["ordinal"], "file_size", limits.total_bytes, split=False)
    same = Window.partitionBy("archive_id", "collision_key").orderBy("ordinal")
    rows = rows.withColumn("__first", F.first("is_directory").over(same)).withColumn("__nth", F.row_number().over(same))
    error = (
        F.when(col("archive_error").isNotNull(), col("archive_error"))
        .when(~col("same_name") | ~paths.path_valid(col("raw_name")), "invalid_member_path")
        .when(col("flag_bits").bitwiseAND(0x41) != 0, "encrypted_member")
        .when(unsafe, "unsafe_member_type")
        .when(col("is_directory") & ((col("file_size") != 0) | (col("compress_size") != 0)), "unsafe_member_type")
        .when(col("file_size") > limits.member_bytes, "member_too_large")
        # integers, so that the ratio is exact; an empty compressed size allows an empty member only
        .when(col("file_size") > col("compress_size") * limits.ratio, "compression_ratio_exceeded")
        .when(~col("within_budget"), "total_uncompressed_too_large")
        .when((col("__nth") > 1) & (col("__first") == col("is_directory")), "duplicate_destination")
        .when(col("__nth") > 1, "file_directory_conflict")
    )
    rows = rows.withColumn("path", paths.canonical_path(col("raw_name"))).withColumn("error_type", error)
    python = ~col("is_directory") & paths.is_python(col("path"))
    ignored = paths.in_ignored_directory(col("path"))
    rows = rows.withColumn("is_python", F.coalesce(python & ~ignored, F.lit(False))).withColumn("is_ignored_python", F.coalesce(python & ignored, F.lit(False)))
    return rows.drop("__first", "__nth", "running_total", "within_budget", "archive_error")


def path_conflicts(checked: DataFrame, group: str = "archive_id", key: str = "collision_key") -> DataFrame:
    """The groups in which a file's path leads on to another member: exploded prefixes meet files' keys, not all pairs."""
    files = checked.where("not is_directory").select(group, F.col(key).alias("__file")).distinct()
    under = checked.where(F.size(key) > 1).select(group, F.explode(paths.prefixes(F.col(key))).alias("__file"))
    return under.join(files, [group, "__file"], "left_semi").select(group).distinct()


def metadata_errors(checked: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive_id, error_type) of the archives that their metadata reject."""
    own = first_violation(checked, ["archive_id"], ["ordinal"])
    clash = path_conflicts(checked).withColumn("error_type", F.lit("file_directory_conflict"))
    many = checked.groupBy("archive_id").agg(F.count_if("is_python").alias("n")).where(F.col("n") > limits.python_files).select("archive_id", F.lit("too_many_python_files").alias("error_type"))
    every = own.withColumn("check_no", F.lit(0)).unionByName(clash.withColumn("check_no", F.lit(1))).unionByName(many.withColumn("check_no", F.lit(2)))
    return first_violation(every, ["archive_id"], ["check_no"])


CONTENTS = "archive_id string, ordinal int, actual_size long, payload binary, line_count long, sha256 string, error_type string"


def contents(archives: DataFrame, accepted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each file of the archives that accepted has, read within the limits: sizes, lines, digest; payloads of Python files.

    accepted is checked_members() without the rejected archives.  The row that breaks an archive is its last and has
    error_type.
    """
    plan = accepted.where("not is_directory").groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "file_size", "is_python"))).alias("plan"))
    names = [c.split()[0] for c in CONTENTS.split(", ")]

    def read(archive_id: str, content: bytes, plan: list) -> Iterator[tuple]:
        total = lines = at = 0
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = z.infolist()
                for at, declared, python in ((p["ordinal"], p["file_size"], p["is_python"]) for p in plan):
                    # one byte beyond a limit tells that it is broken
                    most = min(limits.member_bytes, limits.total_bytes - total)
                    with z.open(infos[at]) as f:
                        data = f.read(most + 1)
                    total += len(data)
                    error = None
                    if len(data) > most:
                        error = "member_too_large" if len(data) > limits.member_bytes else "total_uncompressed_too_large"
                    elif len(data) != declared:
                        error = "invalid_archive"
                    count = None
                    if python and not error:
                        try:
                            count = len(data.decode("utf-8-sig").splitlines())
                            lines += count
                            error = "python_loc_exceeded" if lines > limits.python_lines else None
                        except UnicodeDecodeError:
                            error = "non_utf8_python"
                    yield (archive_id, at, len(data), data if python else None, count, hashlib.sha256(data).hexdigest(), error)
                    if error:
                        return
        except BROKEN:
            yield (archive_id, at, None, None, None, None, "invalid_archive")

    return map_rows(archives.select("archive_id", "content").join(plan, "archive_id").select("archive_id", "content", "plan"), read, CONTENTS, names)


def validate(archives: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(files, summary) of the archives (archive_id, content).

    files: archive_id, relative_path, size_bytes, line_count, sha256, payload of each Python file of the valid archives.
    summary: one row an archive with its totals, or with error_type and no totals.
    """
    # several branches read each of these, so each is stored once
    checked = stage(checked_members(members(archives, limits), limits), "members")
    bad = stage(metadata_errors(checked, limits), "rejected")
    accepted = checked.join(bad, "archive_id", "left_anti")
    read = stage(contents(archives, accepted, limits), "contents")
    worse = stage(first_violation(read, ["archive_id"], ["ordinal"]), "rejected")
    errors = bad.unionByName(worse)
    good = accepted.join(worse, "archive_id", "left_anti")
    python = read.join(worse, "archive_id", "left_anti").where("payload is not null")
    files = python.join(good.select("archive_id", "ordinal", F.col("path").alias("relative_path")), ["archive_id", "ordinal"])
    files = files.select("archive_id", "relative_path", F.col("actual_size").alias("size_bytes"), "line_count", "sha256", "payload")
    totals = good.groupBy("archive_id").agg(
        F.count("*").alias("archive_member_count"), F.count_if(~F.col("is_directory")).alias("regular_file_count"), F.count_if("is_directory").alias("directory_count"),
        F.sum("file_size").alias("total_uncompressed_bytes"), F.count_if("is_python").alias("python_file_count"), F.count_if("is_ignored_python").alias("ignored_python_file_count"),
        F.count_if(~F.col("is_directory") & ~F.col("is_python") & ~F.col("is_ignored_python")).alias("ignored_non_python_file_count"),
    )
    lines = files.groupBy("archive_id").agg(F.sum("line_count").alias("python_total_lines"))
    summary = archives.select("archive_id").join(errors, "archive_id", "left").join(totals, "archive_id", "left").join(lines, "archive_id", "left")
    # an archive without any member is valid and has zeros
    zero = [F.when(F.col("error_type").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in (*totals.columns[1:], "python_total_lines")]
    return files, summary.select("archive_id", "error_type", *zero)
