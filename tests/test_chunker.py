import random

import pytest

from lodestone.operators import chunker as C


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_headings_fences_and_preamble():
    text = "intro\n# one\n## Two ##\nx\n```\n## no\n```\n### Three\ny\n~~~~\n~~~\n## no\n~~~~\n## Four\n"
    assert [(text[a:b].splitlines()[0], path) for a, b, path, *_ in C.spans(text)] == [("intro", ()), ("## Two ##", ("Two",)), ("### Three", ("Two", "Three")), ("## Four", ("Four",))]


def test_third_level_without_second_and_empty_title():
    assert [p for _, _, p, *_ in C.spans("### A\nx\n##  ##\n")] == [("A",), ("##",)]


def test_unclosed_fence_is_an_error_row(spark):
    rows = C.chunks(frame(spark, "```\nx", "ok\n", "", None)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.error) for r in rows] == [(0, "unclosed_fence"), (1, None)]
    assert C.audit(frame(spark, ""), C.chunks(frame(spark, ""))).first().gap_count == 0


@pytest.mark.parametrize("joint, kind", [("\n\n", "paragraph"), ("\n", "line"), (". ", "sentence"), (" ", "space"), ("", "hard")])
def test_cut_priorities(joint, kind):
    text = joint.join(["a" * 97] * 30)
    found = C.spans(text, 500, 1200, 120)
    assert all(b - a <= 1200 for a, b, *_ in found) and len(found) > 1
    if joint:
        assert all(text[:b].endswith(joint) for _, b, *_ in found[:-1])


def test_fences_stay_whole_and_oversized_ones_are_kept():
    fence = "```\n" + "code\n" * 300 + "```\n"
    text = "word " * 100 + "\n" + fence + "tail " * 300
    found = C.spans(text)
    begin, end = text.index("```"), text.index(fence) + len(fence)
    assert any(a <= begin and end <= b for a, b, *_ in found)
    assert not any(begin < x < end for a, b, *_ in found for x in (a, b))


def test_random_documents_keep_every_invariant():
    rng = random.Random(5)
    parts = ["word ", "Sentence. ", "\n", "\n\n", "## H\n", "### T\n", "```\ncode\n```\n", "x" * 80, "é。 ", "\r\n", "\t"]
    for _ in range(150):
        text = "\n".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(3))
        try:
            found = C.spans(text, 50, 200, 20)
        except C.UnclosedFence:
            continue
        reach = 0
        fences = [(a, b) for a, b, k in C.blocks(text) if k == "fence"]
        assert "".join(text[a:b] for a, b, _ in C.blocks(text)) == text
        for a, b, _, number, shared in found:
            assert a <= reach and b > a and (number or not shared) and shared == (reach - a if number else 0)
            assert not any(x < a < y or x < b < y for x, y in fences)
            assert b - a <= 200 or any(a <= x and y <= b and y - x > 180 for x, y in fences)
            reach = b
        assert reach == len(text)


def test_ids_differ_between_equal_chunks(spark):
    rows = C.chunks(frame(spark, "## A\nx\n## A\nx\n")).orderBy("chunk_no").collect()
    assert [r.identity_occurrence for r in rows] == [0, 1] and rows[0].chunk_id != rows[1].chunk_id and rows[0].content_sha256 == rows[1].content_sha256


def test_audit_and_blocks(spark):
    text = "## A\n" + "Words are here. " * 200 + "\n\n```\nx\n```\n"
    docs = frame(spark, text)
    found = C.chunks(docs)
    row = C.audit(docs, found).first()
    assert (row.covered_chars, row.source_chars, row.gap_count) == (len(text), len(text), 0) and row.overlap_count > 0
    assert C.uncovered_blocks(C.source_blocks(docs), found).count() == 0
    lost = found.where("chunk_no > 0")
    assert C.audit(docs, lost).first().gap_count == 1
    assert {r.reason for r in C.uncovered_blocks(C.source_blocks(docs), lost).collect()} == {"not_covered"}


def test_all_numbers_of_the_audit(spark):
    """Against plain loops over the same chunks, with some of them lost, repeated or moved."""
    text = "intro\n\n## A\n\n" + "Words are here. " * 150 + "\n\n```py\n" + "x = 1\n" * 300 + "```\n\n### B\n\nshort\n\n~~~\ny\n~~~\n\n## C\n\n" + "more text " * 90 + "\n"
    docs = frame(spark, text)
    whole = C.chunks(docs).orderBy("chunk_no").collect()
    blocks = C.blocks(text)
    for chosen in (whole, whole[1:], whole[:2] + whole[3:], whole + whole[-1:]):
        spans = [(r.start, r.end) for r in chosen]
        rows = [r.asDict() | {"chunk_no": i} for i, r in enumerate(chosen)]
        got = C.audit(docs, spark.createDataFrame(rows, C.chunks(docs).schema)).first().asDict()
        covered, reach, gaps = set(), 0, 0
        for a, b in spans:
            gaps += a > reach
            covered |= set(range(a, b))
            reach = max(reach, b)
        holds = lambda a, b: any(x <= a and b <= y for x, y in spans)
        fences = [(a, b) for a, b, k in blocks if k == "fence"]
        n, ids, contents = len(chosen), {r.chunk_id for r in chosen}, {r.content_sha256 for r in chosen}
        lengths = [r.char_length for r in chosen]
        assert got == {
            "doc_id": got["doc_id"], "source_chars": len(text), "chunk_count": n, "min_char_length": min(lengths), "max_char_length": max(lengths),
            "target_range_count": sum(500 <= x <= 1200 for x in lengths), "short_count": sum(x < 500 for x in lengths), "oversized_count": sum(x > 1200 for x in lengths),
            "continuation_count": sum(r.continuation_index > 0 for r in chosen), "overlap_count": sum(r.overlap_chars > 0 for r in chosen),
            "unique_ids": len(ids), "unique_contents": len(contents), "id_collisions": n - len(ids), "repeated_contents": n - len(contents), "covered_chars": len(covered),
            "fence_count": len(fences), "preserved_fence_count": sum(holds(*f) for f in fences), "block_count": len(blocks),
            "covered_block_count": sum(covered >= set(range(a, b)) for a, b, _ in blocks),
            "oversized_code_count": sum(y - x > 1200 and any(b - a > 1200 and x <= a and b <= y for a, b in fences) for x, y in spans),
            "gap_count": gaps + (reach < len(text)),
        }
    assert any(b - a > 1200 for a, b in fences)


@pytest.mark.parametrize("low, high, overlap", [(0, 10, 1), (11, 10, 1), (5, 10, 10)])
def test_sizes_are_checked(spark, low, high, overlap):
    with pytest.raises(ValueError):
        C.chunks(frame(spark, "x"), low, high, overlap)
