import os

import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(make):
    import random

    rng = random.Random(1)
    words = {"en": "the of and to with that is on house tree".split(), "de": "der die und nicht über schön ist ein haus baum".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)) + ".\nAll rights reserved by us.\n" + " ".join(rng.choices(words[lang], k=30)), lang, f"s{i % 12}") for i in range(120) for lang in [rng.choice(["en", "de"])]]
    return make(rows + [(500 + i, rows[i][1], rows[i][2], "s1") for i in range(5)] + [(900, "!!! 123", "en", "s1"), (901, None, "en", "s2")])


def test_stages_apply(spark, docs):
    kept, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).persist()
        sizes[name] = kept
        if name != "packed":
            assert kept.columns == docs.columns
    ids = {name: [r.doc_id for r in df.collect()] for name, df in sizes.items()}
    assert not {900, 901} & set(ids["language_id"]) and len(ids["language_id"]) == 125
    texts = {r.doc_id: r for r in sizes["line_dedup"].collect()}
    assert [i for i, r in texts.items() if "All rights reserved by us." in r.text] in ([0, 500], [500, 0])  # the first and its copy
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert not set(range(500, 505)) & set(ids["near_dedup"])
    assert set(ids["mixture"]) < set(ids["near_dedup"])
    assert {r.doc_id for r in sizes["packed"].collect()} == set(ids["mixture"])


def test_an_empty_table_passes_all_stages(spark, make):
    kept = make([])
    for name, stage in corpus_pipeline.STAGES:
        columns, kept = kept.columns, stage(spark, kept, SF)
        assert kept.count() == 0 and (name == "packed" or kept.columns == columns)


def test_near_dedup_takes_copies_beyond_three_bits(spark, make):
    import random

    from lodestone.llm import simhash

    words = [f"word{i}" for i in range(300)]
    text = random.Random(4).choices(words, k=120)
    near = text[:60] + ["other"] + text[61:90] + ["others"] + text[91:]  # 106 shingles of 126 are in both
    assert (simhash.fingerprint(" ".join(text)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 3
    far = text[:40] + ["x", "y", "z"] + text[43:60] + ["another"] + text[61:90] + ["more"] + text[91:]  # 99 of 133, with either
    docs = make([(i, " ".join(t), "en", "s") for i, t in enumerate([text, near, far])])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_registered_queries_run(spark, name):
    least = {"op8_shards": 100, "pipeline": 100}  # sequences, and pieces of what is left
    assert __spark_entry__.queries()[name](spark, SF).count() >= least.get(name, 200)
