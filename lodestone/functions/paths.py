"""Archive member paths, by rules that hold on every platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories whose files are not scanned.
IGNORED = (".venv", "venv", "site-packages", "node_modules", ".git")
#: Device names, which no component may have, with or without an extension.
RESERVED = r"(?i)^(con|prn|aux|nul|conin\$|conout\$|com[1-9¹²³]|lpt[1-9¹²³]) *(\..*)?$"


def components(raw: Column) -> Column:
    """The components of a path; empty ones and single dots say nothing."""
    return F.filter(F.split(F.translate(raw, "\\", "/"), "/"), lambda c: (c != "") & (c != "."))


def portable(component: Column) -> Column:
    """Whether a component means the same everywhere."""
    return ~(component.rlike(r"[:\x00-\x1f]|[ .]$") | component.rlike(RESERVED))


def path_valid(raw: Column) -> Column:
    """Whether a member's name is a safe relative path: no drive, root, parent, NUL or unportable component."""
    parts = components(raw)
    return F.coalesce(~raw.rlike(r"^(?s:.):|^[/\\]|\x00") & (F.size(parts) > 0) & F.forall(parts, portable), F.lit(False))


def canonical_path(raw: Column) -> Column:
    """The path with single slashes, null if it isn't valid."""
    return F.when(path_valid(raw), F.array_join(components(raw), "/"))


def in_ignored_directory(path: Column) -> Column:
    """Whether a directory on the way to path is ignored, in any case."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda c: F.lower(c).isin(*IGNORED))


def is_python(path: Column) -> Column:
    """Whether the file's name has the suffix .py; a file that is called .py has none."""
    return F.element_at(F.split(path, "/"), -1).rlike(r"(?i)^.+\.py$")


def prefixes(parts: Column) -> Column:
    """All proper prefixes of an array."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.slice(parts, F.lit(1), n))


def stays_under(path: Column) -> Column:
    """Whether a relative path stays under the folder that it starts from: no root, drive, backslash, NUL or parent."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.rlike(r"^(?s:.):|^/|[\\\x00]") & ~F.exists(parts, lambda c: c.isin("", ".", "..")), F.lit(False))
