import io
import struct
import zipfile

import pytest

from lodestone.operators import archives as A
from lodestone.plans.samples import zipped


def made(*members, method=zipfile.ZIP_DEFLATED):
    """A ZIP of (name, data, external attributes or None)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data, attributes in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = method if data else 0  # a deflated directory has bytes
            if attributes is not None:
                info.external_attr = attributes
            z.writestr(info, data)
    return out.getvalue()


def patched(data, offset, value, fmt="<H"):
    """data with a field of its first central directory record replaced."""
    at = data.index(b"PK\x01\x02") + offset
    return data[:at] + struct.pack(fmt, value) + data[at + struct.calcsize(fmt) :]


SMALL = A.Limits(member_bytes=100, total_bytes=150, members=5, python_files=2, python_lines=5, archive_bytes=5000)
P = "x = 1\n"
CASES = {
    "good": (zipped({"a.py": P, "d/b.txt": "t"}), None),
    "empty": (zipped({}), None),
    "text": (b"nothing", "invalid_archive"),
    "huge": (b"0" * 5001, "archive_too_large"),
    "many": (zipped({f"{i}.txt": "" for i in range(6)}), "too_many_members"),
    "at_member_limit": (zipped({"a.txt": "abcdefghij" * 10}), None),
    "over_member_limit": (zipped({"a.txt": "abcdefghij" * 10 + "k"}), "member_too_large"),
    "over_total": (zipped({"a.txt": "abcdefghij" * 8, "b.txt": "abcdefghij" * 8}), "total_uncompressed_too_large"),
    "ratio": (made(("a.txt", "a" * 99, None)), None),
    "up": (zipped({"../a.py": P}), "invalid_member_path"),
    "drive": (zipped({"C:/a.py": P}), "invalid_member_path"),
    "device": (zipped({"con.py": P}), "invalid_member_path"),
    "link": (made(("a", "b", 0o120777 << 16)), "unsafe_member_type"),
    "volume": (made(("a", "b", 0x08)), "unsafe_member_type"),
    "file_named_directory": (made(("a/", "", 0o100644 << 16)), "unsafe_member_type"),
    "directory": (made(("a/", "", 0o040755 << 16 | 0x10)), None),
    "encrypted": (patched(made(("a", "b", None)), 8, 1), "encrypted_member"),
    "method": (patched(made(("a", "b", None)), 10, 99), "unsafe_member_type"),
    "wrong_size": (patched(made(("a", "b", None), method=0), 24, 3, "<I"), "compression_ratio_exceeded"),
    "wrong_crc": (patched(made(("a", "b", None)), 16, 7, "<I"), "invalid_archive"),
    "same_twice": (made(("a.py", P, None), ("A.py", P, None)), "duplicate_destination"),
    "file_and_directory": (made(("a", "", None), ("a/", "", 0x10)), "file_directory_conflict"),
    "file_above_file": (made(("a", "", None), ("a/b", "", None)), "file_directory_conflict"),
    "three_python": (zipped({f"{i}.py": "" for i in range(3)}), "too_many_python_files"),
    "latin": (zipped({"a.py": b"x = '\xe9'\n"}), "non_utf8_python"),
    "long": (zipped({"a.py": "\n" * 6}), "python_loc_exceeded"),
    "bom": (zipped({"a.py": b"\xef\xbb\xbfx\n"}), None),
    # the first failing member counts, whatever fails later
    "order": (made(("../x", "", None), ("a", "b", 0x08)), "invalid_member_path"),
}


@pytest.fixture(scope="module")
def validated(spark):
    rows = [(name, bytearray(data)) for name, (data, _) in CASES.items()] + [("null", None)]
    files, summary = A.validate(spark.createDataFrame(rows, "archive_id string, content binary"), SMALL)
    return {r.archive_id: r for r in summary.collect()}, files.collect()


@pytest.mark.parametrize("name", CASES)
def test_error_of_each_archive(validated, name):
    # a ratio beyond the limit of 100 can't be had within 100 bytes; wrong sizes fall to it or to the checksum
    want = CASES[name][1]
    got = validated[0][name].error_type
    assert got == want or (name == "wrong_size" and got == "invalid_archive")


def test_totals_and_payloads(validated):
    row = validated[0]["good"]
    assert (row.archive_member_count, row.python_file_count, row.ignored_non_python_file_count, row.python_total_lines) == (2, 1, 1, 1)
    assert validated[0]["empty"].archive_member_count == 0 and validated[0]["null"].error_type == "archive_read_failed"
    assert validated[0]["up"].archive_member_count is None
    assert {r.archive_id for r in validated[1]} == {"good", "bom"}
    assert bytes(next(r.payload for r in validated[1] if r.archive_id == "good")) == P.encode()


def test_ratio_limit(spark):
    rows = [("at", bytearray(made(("a", "", None)))), ("over", bytearray(made(("a", "a" * 100_000, None))))]
    _, summary = A.validate(spark.createDataFrame(rows, "archive_id string, content binary"))
    assert {r.archive_id: r.error_type for r in summary.collect()} == {"at": None, "over": "compression_ratio_exceeded"}


@pytest.mark.parametrize("limits", [{"members": 201}, {"ratio": 0}, {"archive_bytes": -1}])
def test_limits_only_tighten(limits):
    with pytest.raises(ValueError):
        A.Limits(**limits)


def test_no_archives(spark):
    files, summary = A.validate(spark.createDataFrame([], "archive_id string, content binary"))
    assert files.count() == summary.count() == 0
