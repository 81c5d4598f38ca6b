"""Byte-level BPE against tiktoken, and back."""

import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Regex, pre_tokenizers

from lodestone.llm import bytecodec

PATH = public_tokenizers.path(bytecodec.RANKS)


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytecodec.codec()


def strings(n):
    rng = random.Random(11)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:  # runs, whose merges overlap
            yield "".join(rng.choice(".!-ohH0aIw?~*eヒㅋ・ =#\n\x1c\x85") * rng.choice([1, 2, 3, 4, 5, 7, 9, 13, 33]) for _ in range(rng.randint(1, 8)))
        elif kind < 0.7:
            yield b"".join(rng.choice(list(bytecodec.codec().bytes.values())) for _ in range(rng.randint(1, 12))).decode(errors="ignore")
        else:
            yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x2000, 0x3100), rng.randrange(0x10900, 0x11000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 40)))


def test_ids_are_tiktokens_and_come_back(own, other):
    texts = [*strings(2_000), "", "<|endoftext|> isn't special", "we'll   go\t\n\n now  "]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == other.encode_ordinary(text), text
        assert own.decode(ids.tolist()) == text and own.decode_bytes(ids.tolist()) == text.encode()


def test_split_tables_agree_where_texts_are_split_fast():
    fast, slow = bytecodec.codec().sure, pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    some = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bytecodec._UNSURE.search(chr(c))]
    assert len(some) > 33_000
    for at in range(0, len(some), 64):
        text = "".join(f"a{c}b {c}{c}1{c}2 {c}!{c}?\n{c}a" for c in map(chr, some[at : at + 64]))
        assert fast.findall(text) == [x for x, _ in slow.pre_tokenize_str(text)]


def test_offsets_are_the_librarys(own):
    whole = own.library.__class__.from_str(own.library.to_str())
    whole.pre_tokenizer = pre_tokenizers.Sequence([own.splits, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    texts = [*strings(300), "naïve 😀😀 日本語 ok"]
    for text, (ids, starts, ends) in zip(texts, own.spans(texts)):
        found = whole.encode(text)
        assert ids.tolist() == found.ids and list(zip(starts.tolist(), ends.tolist())) == found.offsets


def test_split_characters(own):
    text = "日😀\U000e0041é"
    ids = next(own.encode([text])).tolist()
    assert len(ids) > len(text)  # some are split
    parts = list(own.decode_parts(ids))
    assert "".join(parts) == text and "" in parts
    cut = next(k for k, x in enumerate(parts) if x == "")
    assert "�" in own.decode(ids[: cut + 1]) and "".join(own.decode_parts(ids[: cut + 1])) == own.decode(ids[: cut + 1])
    assert list(own.decode_parts([])) == [] and own.decode([]) == ""
    with pytest.raises(KeyError):
        own.decode([60_000])


def test_huge_texts_are_cut_where_no_id_changes(own, other, monkeypatch):
    monkeypatch.setattr(bytecodec, "HUGE", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "word", "12", "don't", "  ", "été", "!!!", "\n\n", "日本"]) for _ in range(800)), "x" * 5_000, " " * 5_000, "no place " + "。" * 400]
    assert len(list(own.chunks(texts[0]))) > 5
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == other.encode_ordinary(text)


def test_kept_pieces_are_bounded(own, other, monkeypatch):
    monkeypatch.setattr(bytecodec, "KEPT", 20)
    monkeypatch.setattr(bytecodec, "HUGE", 30)
    texts = [f"piece{i} other{i * 7} {'long' * 40}{i}" for i in range(60)]
    assert [x.tolist() for x in own.encode(texts)] == [other.encode_ordinary(x) for x in texts]
    assert len(own.kept) < 60 and max(map(len, own.kept)) <= bytecodec.SHORT


def test_tables(spark, make, odd, other):
    docs = make(odd, clash=True)
    got = {(r.doc_id, r.ids_sha256): r for r in bytecodec.round_trip(docs).collect()}
    rows = bytecodec.round_trip(docs).collect()
    assert len(rows) == len(odd)
    for doc_id, text, *_ in odd:
        ids = other.encode_ordinary(text or "")
        r = got[doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256((text or "").encode()).hexdigest())
    spans = bytecodec.encoded(docs)
    back = bytecodec.decoded(spans)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in odd)
    for r in spans.where("doc_id = 7").collect():
        text = next(t for i, t, *_ in odd if i == 7)
        covered = "".join(text[a:b] for a, b in zip(r.starts, r.ends))
        assert len(r.ids) == len(r.starts) == len(r.ends) and set(covered) == set(text) and r.ends[-1] == len(text)
    assert bytecodec.decoded(spark.createDataFrame([(1, None), (2, [0])], "doc_id long, ids array<int>")).count() == 2


def test_empty_table(spark, make):
    none = make([])
    assert bytecodec.round_trip(none).count() == bytecodec.encoded(none).count() == bytecodec.decoded(bytecodec.encoded(none)).count() == 0
