"""Small archives of old-style source, made here, for queries and tests of the scan."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.frames import map_rows

#: Source by archive and path.  Lines that are findings end in a comment with the rule's category.
PROJECTS: dict[str, dict[str, str]] = {
    "models": {
        "shop/__init__.py": "",
        "shop/models.py": '''\
from pydantic import BaseModel, Field, validator
import pydantic as pd


class Item(BaseModel):
    name: str = Field(..., regex="^a")  # field
    price: float = Field(0, gt=0, widget="spin")  # field

    class Config:  # config
        orm_mode = True  # config
        title = "Item"

    @validator("name")  # validator
    def check(cls, value):
        return value


class Special(Item):
    __root__: list = []  # root_model

    @pd.root_validator  # validator
    def whole(cls, values):
        return values


class Plain:
    class Config:
        orm_mode = True
''',
        "shop/use.py": '''\
from pydantic import BaseModel, BaseSettings  # settings
from pydantic.generics import GenericModel  # generic_model

from .models import Item


class Box(BaseModel):
    pass


class Page(GenericModel[int]):  # generic_model
    pass


def export(box: Box):
    return box.dict()  # base_model_method


def load(raw):
    Box.parse_raw(raw)  # data_loading
    return Box().json()  # base_model_method


def twice(flag):
    box = Box()
    box = Box()
    return box.dict()


def later():
    box = Box()
    box.copy()  # base_model_method
    box = None


def other(box):
    return box.dict()
''',
    },
    "negatives": {
        "app.py": '''\
from attrs import validator


def Field(**keywords):
    return keywords


class BaseModel:
    def dict(self):
        return {}


class Thing(BaseModel):
    size = Field(regex="x")

    @validator
    def check(self):
        return self.dict()
'''
    },
    "broken": {"bad.py": "def f(:\n"},
    "vendored": {"venv/lib.py": "from pydantic import BaseSettings\n", "main.py": "import pydantic\n\nclass S(pydantic.BaseSettings):  # settings\n    pass\n"},
}


def zipped(files: Mapping[str, str | bytes]) -> bytes:
    """A ZIP of these files; equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


#: What the archives made of pages hold, by page_id modulo their number; None is no archive at all.
KINDS: tuple[dict[str, str] | None, ...] = (
    PROJECTS["models"], PROJECTS["negatives"], PROJECTS["broken"], PROJECTS["vendored"], {"../up.py": "x = 1\n"}, None, {"a.py": "x = 1\n", "A.py": "y = 2\n"},
    {"ok.py": "x = 1\n", "dense.py": "#" * 200_000 + "\n"}, {"large.py": "#" * 1_100_000 + "\n"}, {"secret.py": "x = 1\n"}, {"pkg.py": "x = 1\n", "pkg/__init__.py": "y = 2\n"},
)
#: The kind whose members say that they are encrypted; sources of more characters are compressed.
ENCRYPTED, LARGE = 9, 100_000
#: Source files begin with so many blank lines at most, by page_id; and the name of the page's own text in the archive.
SHIFTS, NOTE = 5, "notes/page.txt"


def _locked(data: bytes) -> bytes:
    """A ZIP's bytes, its directory saying that each member is encrypted."""
    out, at = bytearray(data), data.rfind(b"PK\x05\x06")
    place = int.from_bytes(data[at + 16 : at + 20], "little")
    while out[place : place + 4] == b"PK\x01\x02":
        out[place + 8] |= 1
        place += 46 + sum(int.from_bytes(out[place + k : place + k + 2], "little") for k in (28, 30, 32))
    return bytes(out)


def archives_from(pages: DataFrame) -> DataFrame:
    """(archive_id, content): an archive for each page (page_id, html), whose kind and blank lines follow from page_id, with the page's text."""

    def made(page_id: int, html: str | None) -> Iterator[tuple]:
        files, out = KINDS[page_id % len(KINDS)], io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, source in (files or {}).items():
                packed = zipfile.ZIP_DEFLATED if len(source) > LARGE else zipfile.ZIP_STORED
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "\n" * (page_id % SHIFTS) + source, packed)
            z.writestr(zipfile.ZipInfo(NOTE, (2020, 1, 1, 0, 0, 0)), html or "", zipfile.ZIP_STORED)
        data = _locked(out.getvalue()) if page_id % len(KINDS) == ENCRYPTED else out.getvalue()
        yield f"p{page_id}", data if files is not None else b"plain text"

    return map_rows(pages.select("page_id", "html"), made, "archive_id string, content binary", ["archive_id", "content"])


def archives(spark: SparkSession) -> DataFrame:
    """(archive_id, content) of the projects, and of two archives that are rejected."""
    rows = [(name, zipped(files)) for name, files in PROJECTS.items()]
    rows += [("traversal", zipped({"../up.py": "x = 1\n"})), ("not_a_zip", b"plain text")]
    return spark.createDataFrame([(a, bytearray(c)) for a, c in rows], "archive_id string, content binary")
