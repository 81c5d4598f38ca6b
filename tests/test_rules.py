import re

import pytest

from lodestone.operators import bindings, rules, symbols
from lodestone.plans import migration, samples


def found(spark, *sources):
    rows = [("a", f"f{i}.py", bytearray(s.encode())) for i, s in enumerate(sources)]
    facts = symbols.facts(spark.createDataFrame(rows, "archive_id string, relative_path string, payload binary")).persist()
    return sorted((r.relative_path, r.start_line, r.category, r.old_api) for r in rules.findings(facts).collect())


def lines(spark, source):
    return [(line, category) for _, line, category, _ in found(spark, source)]


@pytest.fixture(scope="module")
def scanned(spark):
    findings, facts, summary = migration.scan(samples.archives(spark))
    return findings.persist(), facts.persist(), {r.archive_id: r for r in summary.collect()}


def test_sample_projects_give_their_labels_and_nothing_else(scanned):
    want = {
        (project, path, number, category)
        for project, files in samples.PROJECTS.items()
        if project != "broken"
        for path, source in files.items()
        for number, line in enumerate(source.splitlines(), 1)
        for category in re.findall(r"# (\w+)$", line)
    }
    got = {(r.archive_id, r.relative_path, r.start_line, r.category) for r in scanned[0].collect()}
    assert got == want


def test_archives_are_rejected_whole(scanned):
    errors = {k: r.error for k, r in scanned[2].items()}
    assert errors == {"models": None, "negatives": None, "vendored": None, "broken": "syntax_error", "traversal": "invalid_member_path", "not_a_zip": "invalid_archive"}
    assert scanned[2]["vendored"].ignored_python_file_count == 1


def test_findings_keep_their_contract(scanned):
    assert rules.contract_errors(scanned[0]).count() == 0
    counts = {r.rule_id: r.n for r in migration.rule_counts(scanned[0]).collect()}
    assert len(counts) == 8 and sum(counts.values()) == scanned[0].count()


def test_reverse_imports(scanned):
    assert [(r.module, r.importer) for r in rules.reverse_imports(scanned[1]).collect()] == [("shop.models", "shop.use")]


MODEL = "from pydantic import BaseModel\nclass M(BaseModel):\n    pass\n"


@pytest.mark.parametrize("source, want", [
    # one binding before the use proves it, two don't, one after it changes nothing
    (MODEL + "m = M()\nm.dict()\n", [(5, "base_model_method")]),
    (MODEL + "m = M()\nm = M()\nm.dict()\n", []),
    (MODEL + "m = M()\nm.dict()\nm = 1\n", [(5, "base_model_method")]),
    # the innermost scope with a binding decides
    (MODEL + "m = M()\ndef f():\n    m = 1\n    m.dict()\n", []),
    (MODEL + "m = M()\ndef f():\n    m.dict()\n", [(6, "base_model_method")]),
    (MODEL + "def f(m: M):\n    m.copy()\n", [(5, "base_model_method")]),
    (MODEL + "def f(m: 'M'):\n    m.copy()\n", []),
    (MODEL + "m: M = load()\nm.json()\n", [(5, "base_model_method")]),
    (MODEL + "M().json()\nM.parse_file('x')\n", [(4, "base_model_method"), (5, "data_loading")]),
    ("import pydantic\npydantic.BaseModel.parse_obj({})\n", [(2, "base_model_method")]),
    ("import pydantic as p\nclass M(p.BaseModel):\n    class Config:\n        orm_mode = True\n", [(3, "config"), (4, "config")]),
    # class scopes aren't seen from methods
    (MODEL + "class C:\n    m = M()\n    def f(self):\n        m.dict()\n", []),
    # a base that is rebound or imported twice proves nothing
    ("from pydantic import BaseModel\nBaseModel = object\nclass M(BaseModel):\n    __root__ = 1\n", []),
    ("from pydantic import BaseModel\nfrom other import BaseModel\nclass M(BaseModel):\n    __root__ = 1\n", []),
    ("class A(B):\n    __root__ = 1\nfrom pydantic import BaseModel\nclass B(BaseModel):\n    pass\n", []),
    (MODEL + "class N(M):\n    __root__: int\n", [(5, "root_model")]),
    ("from pydantic import Field\nx = Field(1, const=True, ge=1, **k)\n", [(2, "field")]),
    ("from pydantic import Field\nfor Field in y:\n    Field(const=1)\n", []),
    ("from pydantic import validator as v\nclass M:\n    @v('x')\n    def f(cls): pass\n", [(3, "validator")]),
    ("from .pydantic import validator\n@validator('x')\ndef f(): pass\n", []),
    ("from pydantic import BaseSettings\nBaseSettings = 1\n", [(1, "settings")]),
    ("def f():\n    global Field\n    Field(const=1)\nfrom pydantic import Field\n", []),
    ("from pydantic import Field\ntry:\n    pass\nexcept E as Field:\n    Field(const=1)\n", []),
    ("from pydantic import Field\nif (Field := 1):\n    Field(const=1)\n", []),
    ("from pydantic import Field\nwith a as Field:\n    Field(const=1)\n", []),
    ("from pydantic import Field\ndel Field\nField(const=1)\n", []),
    ("from pydantic import Field\ndef f(x=Field(const=1)): pass\n", [(2, "field")]),
])
def test_rule_boundaries(spark, source, want):
    assert lines(spark, source) == want


def test_files_dont_see_each_other(spark):
    assert found(spark, MODEL, "M().dict()\n") == []


@pytest.mark.parametrize("path, name", [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", "__init__"), ("a-b.py", None), ("class.py", None), ("é.py", "é")])
def test_module_names(path, name):
    assert symbols.module_name(path)[0] == name


def test_scan_errors(spark):
    rows = [("twice", "a.py", b""), ("twice", "a/__init__.py", b""), ("name", "a-b.py", b""), ("name", "b.py", b"def"), ("fine", "a.py", b"x"), ("nul", "a.py", b"\0")]
    facts = symbols.facts(spark.createDataFrame([(a, p, bytearray(c)) for a, p, c in rows], "archive_id string, relative_path string, payload binary"))
    assert {r.archive_id: r.error_type for r in symbols.scan_errors(facts).collect()} == {"twice": "module_name_conflict", "name": "invalid_module_path", "nul": "syntax_error"}


def test_detection_scores(spark):
    labels = spark.createDataFrame([("a", "f", 1, "r", True), ("a", "f", 2, "r", True), ("a", "f", 3, "r", False)], "archive_id string, relative_path string, start_line int, rule_id string, expected boolean")
    got = spark.createDataFrame([("a", "f", 1, "r"), ("a", "f", 3, "r")], "archive_id string, relative_path string, start_line int, rule_id string")
    row = rules.detection_scores(labels, got).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5)


def test_latest_unique(spark):
    uses = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, at int")
    events = spark.createDataFrame([("a", 2, 10), ("b", 1, 20), ("b", 2, 30)], "k string, when int, v int")
    assert {r.id: (r.n, r.v) for r in bindings.latest_unique(uses, events, "id", ["k"], "at", "when", "v").collect()} == {1: (1, 10), 2: (0, None), 3: (2, None)}
