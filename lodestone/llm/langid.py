"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a window of bytes from either end; a softmax over both states labels every position, and a document's
probabilities are the mean over all its positions.  The network is trained here, in numpy, by backpropagation through time.
Texts are cut into windows as long as those it was trained on, so a text of any length is labelled whole, in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import small_batches, stage, within_bound

#: Units of each direction; bytes of a window; windows labelled at once.
HIDDEN, WINDOW, BATCH = 12, 128, 2_048
#: The sample that is learned from: so many documents of each language at most, on average, and windows of each; and the most languages,
#: of those with most documents, so that a column of stray values doesn't make the sample grow.
SAMPLE, CUTS, LABELS = 1_500, 4, 256
STEPS, STEP_WINDOWS, RATE, SEED = 450, 192, 0.02, 7
UNKNOWN = "und"
#: accepted() rejects a text if what its bytes leave to all languages, with BELIEF bytes more that are held to be in one, is a share below
#: LEAST, or below what all but a share of STRAY of the windows that were learned from have.
LEAST, STRAY, BELIEF = 0.5, 0.001, 32


@dataclass
class Network:
    """Weights by name; f_ and b_ are the two directions.  x: what each byte adds to the gates (update, reset, candidate)."""

    labels: list[str]
    weights: dict[str, np.ndarray]
    #: Whether there is a class more, the last, of what is in none of the languages; it has no label, as any string may be a language's.
    other: bool = False
    #: What accepted() asks for, of a network with that class.
    least: float = LEAST

    @property
    def classes(self) -> int:
        return len(self.labels) + self.other

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED, other: bool = False) -> Network:
        rng, w = np.random.default_rng(seed), {}
        classes = len(labels) + other
        for d in "fb":
            w[f"{d}_x"] = rng.normal(0, 0.3, (3 * hidden, 256))
            w[f"{d}_u"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
            w[f"{d}_c"] = np.zeros((hidden, 1))
        w["out"] = rng.normal(0, 0.3, (classes, 2 * hidden))
        w["bias"] = np.zeros((classes, 1))
        return cls(labels, {k: v.astype(np.float32) for k, v in w.items()}, other)

    def _states(self, d: str, data: np.ndarray, valid: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states (time, unit, window) of direction d over data (time, window); keep gets what a step back needs."""
        x, u, c = (self.weights[f"{d}_{k}"] for k in "xuc")
        hidden = u.shape[1]
        out = np.empty((len(data), hidden, data.shape[1]), u.dtype)
        h = np.zeros((hidden, data.shape[1]), u.dtype)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            gates, own = x[:, data[t]], u @ h
            zr = 1 / (1 + np.exp(-(gates[: 2 * hidden] + own[: 2 * hidden])))
            z, r, q = zr[:hidden], zr[hidden:], own[2 * hidden :] + c
            n = np.tanh(gates[2 * hidden :] + r * q)
            if keep is not None:
                keep.append((t, h, z, r, q, n))
            h = (n + z * (h - n)) * valid[t]
            out[t] = h
        return out

    def gradients(self, data: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over valid positions, and its gradients by backpropagation through time."""
        kept = {"f": [], "b": []}
        states = {d: self._states(d, data, valid, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], 1)
        logits = self.weights["out"] @ both + self.weights["bias"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        count, at = valid.sum(), np.arange(data.shape[1])
        loss = -float((np.log(p[:, label, at] + 1e-12) * valid).sum() / count)
        p[:, label, at] -= 1
        dy = p * (valid / count)[:, None, :]
        grads = {"out": np.einsum("tlb,thb->lh", dy, both, optimize=True), "bias": dy.sum((0, 2))[:, None]}
        dboth = self.weights["out"].T @ dy
        for i, d in enumerate("fb"):
            u = self.weights[f"{d}_u"]
            hidden = u.shape[1]
            gx = np.empty((len(data), 3 * hidden, data.shape[1]), u.dtype)
            gu, gc, back = np.zeros_like(u), np.zeros((hidden, 1), u.dtype), 0
            for t, before, z, r, q, n in reversed(kept[d]):
                dh = (dboth[t, i * hidden : (i + 1) * hidden] + back) * valid[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz, dr, dq = dh * (before - n) * z * (1 - z), dn * q * r * (1 - r), dn * r
                gx[t] = np.concatenate([dz, dr, dn])
                g = np.concatenate([dz, dr, dq])
                gu += g @ before.T
                gc += dq.sum(1, keepdims=True)
                back = dh * z + u.T @ g
            flat, rows = data.ravel(), gx.transpose(1, 0, 2).reshape(3 * hidden, -1)
            grads[f"{d}_x"] = np.stack([np.bincount(flat, row, 256) for row in rows])
            grads[f"{d}_u"], grads[f"{d}_c"] = gu, gc
        return loss, grads

    def train(self, windows: list[tuple[bytes, int]], steps: int = STEPS, size: int = STEP_WINDOWS, rate: float = RATE, seed: int = SEED) -> Network:
        """Fits the weights to windows with their labels' numbers, each label drawn as often, by Adam."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero([label == k for _, label in windows]) for k in range(self.classes)]
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            label = rng.integers(self.classes, size=size)
            data, valid = batch([windows[rng.choice(of[k])][0] for k in label])
            _, grads = self.gradients(data, valid, label)
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g / norm
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def prepared(self) -> Labeller:
        return Labeller(self)


def batch(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) bytes, and which of them are there."""
    size = np.array([len(w) for w in windows])
    data = np.frombuffer(b"".join(w.ljust(int(size.max()), b"\0") for w in windows), np.uint8).reshape(len(windows), -1)
    return np.ascontiguousarray(data.T), (np.arange(data.shape[1])[:, None] < size).astype(np.float32)


class Labeller:
    """A trained network for many windows: both directions at once, in place, with the sigmoids' halves folded into the weights."""

    def __init__(self, net: Network) -> None:
        w, self.labels, self.other, self.classes = net.weights, net.labels, net.other, net.classes
        self.hidden = h = w["f_u"].shape[1]
        scale = np.repeat(np.float32([0.5, 0.5, 1.0]), h)[:, None]
        self.x = [np.ascontiguousarray(w[f"{d}_x"] * scale) for d in "fb"]
        # the candidate's own part is taken half, as the reset gate comes as tanh + 1
        self.u = [np.ascontiguousarray(w[f"{d}_u"] * np.float32(0.5)) for d in "fb"]
        self.c = [w[f"{d}_c"] * np.float32(0.5) for d in "fb"]
        self.out, self.bias = w["out"], w["bias"]

    def _run(self, i: int, data: np.ndarray, valid: np.ndarray | None, out: np.ndarray) -> None:
        h, x, u, c = self.hidden, self.x[i], self.u[i], self.c[i]
        n_windows = data.shape[1]
        state = np.zeros((h, n_windows), np.float32)
        gates, own, left = (np.empty((k * h, n_windows), np.float32) for k in (3, 3, 1))
        for t in range(len(data)) if i == 0 else range(len(data) - 1, -1, -1):
            np.take(x, data[t], axis=1, out=gates, mode="clip")
            np.matmul(u, state, out=own)
            zr, n, q = gates[: 2 * h], gates[2 * h :], own[2 * h :]
            zr += own[: 2 * h]
            np.tanh(zr, out=zr)
            zr += np.float32(1)
            q += c
            q *= zr[h:]
            n += q
            np.tanh(n, out=n)
            np.subtract(state, n, out=left)
            left *= zr[:h]
            left *= np.float32(0.5)
            n += left
            if valid is not None:
                n *= valid[t]
            state = out[t]
            state[:] = n

    def sums(self, data: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """(label, window): the sum over each window's positions of their probabilities."""
        h = self.hidden
        states = np.empty((len(data), 2 * h, data.shape[1]), np.float32)
        for i in range(2):
            self._run(i, data, valid, states[:, i * h : (i + 1) * h])
        p = self.out @ states
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        if valid is not None:
            p *= valid[:, None, :]
        return p.sum(0)

    def pooled(self, texts: list[bytes], window: int = WINDOW, size: int = BATCH) -> np.ndarray:
        """(text, label): each text's probabilities, the mean over its bytes; no byte: zeros."""
        total, n = np.zeros((len(texts), self.classes)), np.array([max(len(t), 1) for t in texts])
        owner, full, tails, tail_owner = [], [], [], []
        for k, t in enumerate(texts):
            if whole := len(t) // window:
                full.append(np.frombuffer(t, np.uint8, whole * window).reshape(whole, window))
                owner.append(np.full(whole, k))
            if len(t) % window:
                tails.append(t[whole * window :])
                tail_owner.append(k)
        if full:
            data, owners = np.concatenate(full), np.concatenate(owner)
            for at in range(0, len(data), size):
                np.add.at(total, owners[at : at + size], self.sums(np.ascontiguousarray(data[at : at + size].T), None).T)
        # tails of like lengths together
        order = np.argsort([len(t) for t in tails], kind="stable")
        for at in range(0, len(tails), size // 4):
            some = order[at : at + size // 4]
            np.add.at(total, np.array(tail_owner)[some], self.sums(*batch([tails[j] for j in some])).T)
        return total / n[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, documents: int = SAMPLE, cuts: int = CUTS, window: int = WINDOW) -> list[tuple[str, bytes]]:
    """(lang, window) of a bounded sample of the labelled rows that aren't held out: documents * cuts windows of each of LABELS languages.

    A document is in the sample if the hash of its id is below its language's threshold; its windows begin anywhere in it.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS)
    share = F.least(F.lit(1.0), F.lit(float(documents)) / F.col("n"))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) / F.lit(2.0**53)
    # languages are few, so their shares go to the rows; texts aren't shuffled
    shares = within_bound(stage(counts.select("lang", share.alias("share")), "shares"))
    rows = rows.join(shares, "lang").where(chance < F.col("share"))
    rows = rows.where(F.length("text") > 0).select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut"))
    start = F.pmod(F.xxhash64("doc_id", "cut"), F.greatest(F.length("text") - window, F.lit(1))).cast("int") + 1
    found = rows.select("doc_id", "lang", "cut", F.substring(F.col("text"), start, F.lit(window)).alias("text")).collect()
    return [(r.lang, _read(r.text)[:window]) for r in sorted(found, key=lambda r: (r.doc_id, r.cut, r.lang, r.text))]


def strangers(windows: list[bytes], seed: int = SEED) -> list[bytes]:
    """Windows in no language, made from those in one: other letters for its letters (one substitution a window), its characters
    in another order, or letters of other scripts in words as long."""
    rng, out = np.random.default_rng(seed), []
    scripts = [(0x0391, 0x03C9), (0x0410, 0x044F), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    for i, window in enumerate(windows):
        text = window.decode(errors="ignore")
        if i % 4 < 2:
            letters = sorted(set(filter(str.isalpha, text)) | set("abcdefghijklmnopqrstuvwxyz"))
            text = text.translate(dict(zip(map(ord, letters), rng.permutation(letters))))
        elif i % 4 == 2:
            text = "".join(rng.permutation(list(text))) if text else text
        else:
            low, high = scripts[rng.integers(len(scripts))]
            text = "".join(chr(rng.integers(low, high + 1)) if c.isalpha() else c for c in text)
        out.append(text.lower().encode()[: len(window)])
    return [w for w in out if w]


def fit(docs: DataFrame, hidden: int = HIDDEN, other: bool = False, **size: int) -> Network | None:
    """A network that is trained on a sample of docs; None without any labelled text.

    With other it also has the class of no language, learned from strangers() of the same sample, and the least share for accepted().
    """
    found = sample(docs, **size)
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return None
    number = {lang: i for i, lang in enumerate(labels)}
    windows = [(w, number[lang]) for lang, w in found]
    if not other:
        return Network.new(labels, hidden).train(windows)
    strange = [(w, len(labels)) for w in strangers([w for _, w in found])]
    net = Network.new(labels, hidden, other=True).train(windows + strange)
    own = 1 - net.prepared().pooled([w for w, _ in windows])[:, -1]
    net.least = min(LEAST, float(np.quantile(own, STRAY)))
    return net


def _read(text: str) -> bytes:
    """What the network reads of a text: its lower case."""
    return text.lower().encode()


def _labelled(labeller: Labeller | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """The label and score of each text, and the share of its probabilities that languages have; the class of none is no label."""
    names, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    there = [i for i, t in enumerate(texts) if labeller and t and any(map(str.isalpha, t))]
    for i, p in zip(there, labeller.pooled([_read(texts[i]) for i in there]) if there else ()):
        other = float(p[-1]) if labeller.other else 0.0
        p = p[:-1] if labeller.other else p
        k = int(p.argmax())
        names[i], scores[i], shares[i] = labeller.labels[k], min(1.0, float(p[k])), 1.0 - other
    return names, scores, shares


def believed(share: float, n: int) -> float:
    """The languages' share of n bytes, taken with BELIEF bytes that are held to be in one."""
    return (share * n + BELIEF) / (n + BELIEF)


def accepted(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """The rows of docs whose text is in a language that was learned.  Columns as in docs.

    Null texts and texts without a letter go; where nothing could be learned, all go.  So do texts that the network holds to be in
    another language or in none: the class of none leaves less to the languages than network.least.  The share is taken as if BELIEF
    bytes more were in a language, so the shorter a text is, the surer the network has to be.
    For the other cases see identify().
    """
    network = network or fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), other=True)
    small_batches(docs.sparkSession)

    @F.pandas_udf(BooleanType())
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = network and network.prepared()
        for texts in batches:
            found = [None if t is None else str(t) for t in texts]
            names, _, shares = _labelled(labeller, found)
            yield pd.Series([n != UNKNOWN and believed(x, len(_read(t))) >= network.least for t, n, x in zip(found, names, shares)], dtype="bool")

    return docs.where(known(F.col("text")))


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    docs needs doc_id (long), text and lang, which only fit() uses; other columns are ignored.  lang_pred is `und` and score 0
    if text is null, has no letter, or nothing could be learned.  Ties go to the label that sorts first.  Rows with a null doc_id aren't
    learned from.  Repeated rows each give a row.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    network = network or fit(docs)
    small_batches(docs.sparkSession)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = network and network.prepared()
        for some in batches:
            names, scores, _ = _labelled(labeller, some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(labelled, "doc_id long, held_out boolean, lang_pred string, score double")
