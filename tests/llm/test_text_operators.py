"""Language ID, secrets, quality rules and token counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import bytebpe, langid, quality, secrets, tokens


# -- language ID ----------------------------------------------------------------------------------------------------------------

LANGS = {"en": "the of and to with that is on".split(), "de": "der die und nicht über schön ist ein".split(), "fr": "le la et où été dans que pour".split()}


def texts(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(LANGS[lang], k=rng.randint(5, 60))), lang, "s") for i in range(n) for lang in [rng.choice(list(LANGS))]]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, valid = langid.batch([b"abcde", b"xy", b"hello wor"])
    label = np.array([0, 1, 2])
    _, grads = net.gradients(data, valid.astype(float), label)
    for k, w in net.weights.items():
        for _ in range(6):
            i = tuple(int(rng.integers(s)) for s in w.shape)
            if k.endswith("_x"):
                i = (i[0], int(rng.choice(list(b"abcdexyhlo"))))
            old, losses = w[i], []
            for step in (1e-5, -1e-5):
                w[i] = old + step
                losses.append(net.gradients(data, valid.astype(float), label)[0])
            w[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[k][i]) < 1e-6


def test_labeller_equals_plain_network():
    net = langid.Network.new(["a", "b", "c"], 5, seed=3)
    data = [b"some text of a hundred and more bytes " * 8, b"short", b"x" * 128, b""]
    got = net.prepared().pooled(data)
    for text, p in zip(data, got):
        total = np.zeros(3)
        for at in range(0, len(text), langid.WINDOW):
            d, v = langid.batch([text[at : at + langid.WINDOW]])
            both = np.concatenate([net._states(x, d, v) for x in "fb"], 1)
            logits = net.weights["out"] @ both + net.weights["bias"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            total += (e / e.sum(1, keepdims=True)).sum((0, 2))
        assert np.allclose(p, total / max(len(text), 1), atol=1e-5)


@pytest.fixture(scope="module")
def network(make):
    return langid.fit(make(texts()))


def test_held_out_accuracy(make, network):
    rows = langid.identify(make(texts()), network).collect()
    want = {i: lang for i, _, lang, _ in texts()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_learns_only_from_rows_that_are_not_held_out(make):
    rows = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in texts()]
    assert {lang for lang, _ in langid.sample(make(rows))} == set(LANGS)


def test_the_empty_label_is_a_language_like_any_other(make):
    rows = [(i, t, "" if lang == "en" else lang, s) for i, t, lang, s in texts()]
    net = langid.fit(make(rows))
    assert net.labels == ["", "de", "fr"] and net.classes == 3
    got = langid.identify(make(rows), net).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.97 and "" in {r.lang_pred for r in got}


def test_stray_labels_do_not_make_the_sample_grow(make, monkeypatch):
    monkeypatch.setattr(langid, "LABELS", 3)
    rows = texts() + [(5_000 + i, "stray label", f"x{i}", "s") for i in range(40)]
    assert {lang for lang, _ in langid.sample(make(rows))} == set(LANGS)


def test_the_empty_label_alone(make):
    only = [(i, t, "", s) for i, t, lang, s in texts(60)]
    net = langid.Network.new([""], 4, other=True)
    assert net.classes == 2
    assert {(r.lang_pred, 0 < r.score < 1) for r in langid.identify(make(only), net).collect()} == {("", True)}
    net.least = 0.0
    assert langid.accepted(make(only), net).count() == len(only)


def test_short_texts_need_surer_networks():
    assert langid.believed(0.0, 0) == 1 and langid.believed(1.0, 50) == 1
    shares = [langid.believed(0.1, n) for n in (1, 10, 40, 100, 10_000)]
    assert shares == sorted(shares, reverse=True) and shares[0] > langid.LEAST > shares[3]


def test_sample_is_bounded(make):
    assert len(langid.sample(make(texts(600)), documents=20, cuts=2)) < 3 * 20 * 2 * 2


def test_langid_odd_rows(make, odd, network):
    rows = langid.identify(make(odd, clash=True), network).collect()
    assert len(rows) == len(odd)
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 4)) and by[7].lang_pred != "und"
    kept = langid.accepted(make(odd, clash=True), network=network)
    assert kept.columns == make(odd, clash=True).columns and {r.doc_id for r in kept.collect()} >= {1, 7, 8, 9} and not {2, 3, 4} & {r.doc_id for r in kept.collect()}


def test_other_languages_and_noise_are_rejected(make):
    own = texts()
    net = langid.fit(make(own), other=True)
    rng = random.Random(5)
    odd = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "".join(rng.choices("qxzjkvwpy  ", k=200)), "".join(rng.choices("etaoin shrdlu", k=200)),
    ]
    rows = own + [(90_000 + i, t, None, "s") for i, t in enumerate(odd)] + [(95_000, "xq", "en", "s"), (95_001, "123 !", "en", "s")]
    kept = {r.doc_id for r in langid.accepted(make(rows), net).collect()}
    assert not kept & {*range(90_000, 90_000 + len(odd)), 95_001}
    assert 95_000 in kept and sum(i not in kept for i, *_ in own) <= len(own) // 200
    assert not langid.accepted(make([(1, "some text of enough letters, but nothing to learn from it at all, really", None, "s")])).count()


@pytest.mark.parametrize("rows", [[], [(1, "text", None, "s")], [(1, None, "en", "s")]])
def test_langid_without_anything_to_learn(make, rows):
    got = langid.identify(make(rows)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


# -- secrets ------------------------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets_equal_brute_force():
    rng = random.Random(1)
    pool = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP1234", "abc123", "é", "deadbeef" * 3, "f", "\n", "tok", "akia", "AKIAAKIA", "a_", "tokentoken", "😀"]
    for _ in range(20_000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))
        assert secrets.scan(t) == brute_secrets(t), t


def test_checksum_decides():
    body = "Zk3aQ9xT1bW7cE5rV0mN2pL8sD4fGh"
    good = f"é ghp_{body}{secrets.checksum(body.encode()).decode()}"
    assert secrets.scan(good) == [("checked", 2, 42)] and secrets.scan(good[:-1] + "!") == [] and secrets.scan(good + "a") == []


def test_secrets_odd_rows(make, odd):
    rows = secrets.find_secrets(make(odd, clash=True)).collect()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd) and by[2].base_sha256 == by[3].base_sha256 == empty and by[2].spans == ""
    assert (by[7].n_assign, by[7].spans) == (1, "assign:17:35")
    assert secrets.find_secrets(make([])).count() == 0


# -- quality ---------------------------------------------------------------------------------------------------------------------------


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, inside, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_measures_equal_brute_force():
    rng = random.Random(2)
    for _ in range(3_000):
        t = "".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "\t", "#", "é", "\x85", "\x1c", "😀", "a b c ", "|"]) for _ in range(rng.randint(0, 60)))
        assert quality.measure(t)[:5] == brute_quality(t), repr(t)


def test_thresholds_follow_the_group(make):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    clean = [(i, " ".join(rng.sample(words, 80)), "en", "plain") for i in range(300)]
    tables = [(1000 + i, " | ".join(rng.sample(words, 80)), "en", "tables") for i in range(300)]
    junk = [(2000, " ".join(w + "###" for w in rng.sample(words, 80)), "en", "plain"), (2001, " | ".join(rng.sample(words, 80)), "en", "plain"), (2002, "few words", "en", "plain"), (2003, "a b c " * 40, "en", "plain")]
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.judged(make(clean + tables + junk)).collect()}
    assert all(kept[i] == (True, False) for i, *_ in clean + tables)  # bars are usual in tables, but not in plain
    assert [kept[i] for i in (2000, 2001, 2002, 2003)] == [(False, False), (False, False), (False, True), (False, True)]


def test_thresholds_and_verdicts_equal_brute_force(make):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])
        w = [x * rng.choice([1, 1, 1, 2]) for x in rng.choices(words, k=rng.randint(40, 120))]
        w = [x + rng.choice(["", "#"]) for x in w] if rng.random() < 0.1 else w
        w = w + w[:20] if rng.random() < 0.1 else w
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), lang, source))
    measured = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeated, lines = quality.measure(t)
        measured.append((i, lang, source, n < 50 or 100 * repeated > 50 * n, {"symbols_per_word": symbols / n, "chars_per_word": chars / n, "repeat_share": repeated / n, "dup_line_share": dup / lines}))

    def quantile(values, q):
        gamma = 1.005 / 0.995
        found = sorted(-math.inf if v == 0 else math.ceil(math.log(v) / math.log(gamma)) for v in values)
        b = found[max(0, math.ceil(q * len(found) - 1e-9) - 1)]
        return 0.0 if b == -math.inf else 2 * gamma**b / (1 + gamma)

    def bounds(m, lang, source):
        high, reach, slack, both = quality.MEASURES[m]
        of = lambda keep: [x[m] for _, a, b, failed, x in measured if not failed and keep(a, b)]
        levels = [of(lambda a, b: (a, b) == (lang, source)), of(lambda a, b: a == lang), of(lambda a, b: True)]
        out = []
        for q in (1 - high, 0.5, high):
            value = quantile(levels[2], q)
            for values in (levels[1], levels[0]):
                value = (len(values) * quantile(values, q) + 200 * value) / (len(values) + 200)
            out.append(value)
        low, mid, up = out
        return (low - max(reach * (mid - low), slack) if both else -math.inf), up + max(reach * (up - mid), slack)

    want = {}
    for i, lang, source, failed, x in measured:
        fits = [(lo, x[m], hi) for m in quality.MEASURES for lo, hi in [bounds(m, lang, source)]]
        assert all(min(abs(v - lo), abs(v - hi)) > 1e-6 for lo, v, hi in fits)
        want[i] = not failed and all(lo <= v <= hi for lo, v, hi in fits)
    got = quality.judged(make(rows, partitions=3)).collect()
    assert {r.doc_id: r.kept for r in got} == want and 10 < sum(not k for k in want.values()) < 200
    by = {(lang, source): bounds("repeat_share", lang, source)[1] for _, lang, source, failed, _ in measured if not failed}
    assert all(abs(r.hi_repeat_share - by[r.lang, r.source]) < 1e-9 for r in got if (r.lang, r.source) in by)
    again = quality.judged(make(rows[::-1], partitions=5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))  # bounds and all


def test_quality_odd_rows(make, odd):
    rows = quality.judged(make(odd, clash=True)).collect()
    assert len(rows) == len(odd) and all(r.kept is not None and not (r.kept and r.base_failed) for r in rows)
    assert quality.judged(make([])).count() == 0


# -- token counts ------------------------------------------------------------------------------------------------------------------------


def test_chunked_counts_equal_whole_ones():
    path = tokens.model_path()
    model, apart = tokens.load(path)
    assert apart
    rng = random.Random(6)
    pool = ["a", "b ", " ", "  ", "\n", "é", "the ", "123", "▁", "longwordwithoutspaces", "😀", "\t", " .", ". ", "</s>"]
    for _ in range(600):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 200)))
        assert all(tokens.count_chunked(t, path, c, o) == len(model.encode(t)) for c, o in ((7, 2), (20, 5), (50, 30)))
    solid = "ab" * 30_000
    assert tokens.count(solid, path) == len(model.encode(solid))


def test_token_counts_odd_rows(make, odd):
    rows = tokens.token_counts(make(odd, clash=True)).collect()
    by = {r.doc_id: r for r in rows}
    model = tokens.load(tokens.model_path())[0]
    assert len(rows) == len(odd) and (by[2].n_tokens, by[3].n_bytes) == (0, 0)
    assert by[5].over_limit and by[5].n_tokens == len(model.encode(odd[7][1])) and by[7].n_bytes == len(odd[9][1].encode())


def test_byte_ids_equal_the_librarys():
    e = bytebpe.encoder()
    rng = random.Random(3)
    pool = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0), 0x3000, 0x4E00, 0x661, 0x1F600])]
    extra = [" ", "  ", "\n", "a", "bc", "1", "<|endoftext|>", "'s", "!"]
    for c in pool:
        for t in (c, f"a{c}b", f" {c} {c}{c}1", f"{c}  a"):
            assert list(e.encode(t)) == e.slow.encode(t, add_special_tokens=False).ids
    for _ in range(2_000):
        t = "".join(rng.choice(pool if rng.random() < 0.4 else extra) for _ in range(rng.randint(1, 25)))
        assert list(e.encode(t)) == e.slow.encode(t, add_special_tokens=False).ids
