"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares two strings by the four-letter subsequences they share, in order but not necessarily adjacent: one
that spans s letters counts DECAY^(s - 4), up to SPAN letters, and the kernel is the cosine of these counts. Accents are
folded, digits and signs read as the letters they stand for, and any other character is no letter. So any number of
separators inside a word change nothing, and foreign letters take away a few subsequences. A string of three letters
has one feature, itself; a shorter one has none.

A sentence is a bag of strings: its words, and runs of single letters. Training is multiple-instance: a toxic text is
represented by the telling strings of its sentences, the witnesses, and a clean text by all strings of all its
sentences. Landmarks are the strings that set sentences of toxic texts apart and some common ones; the Nystroem map
projects on them; a linear squared-hinge machine is fitted, and clean strings that come too near are shown again. A
sentence's margin is that of its worst string; a text's score is the sigmoid, fitted on training texts, of its worst
sentence's margin.

A linear machine on Nystroem features of this kernel is one weight for each subsequence, so scoring is a table lookup.
Words are the kernel's bounds: an insult that white space breaks into pieces of several letters is not put together.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, DECAY, BITS = 7, 0.6, 20
#: The offsets of a subsequence's second to fourth letters, and its weight.
STEPS = [((a, b, c), DECAY ** (c - 3)) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)]
SIZE = 1 << BITS
#: The end of a string of three letters counts as its fourth letter, so that it has a feature.
END = 27
#: The letters that digits and signs stand for.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}
#: A string's windows are LONG letters from every LONG / 2-th on; its margin is the worst window's.
LONG = 24
CACHE = 500_000
#: Strings whose dense features are held at once.
BLOCK = 128
PAD = "\0" * SPAN
EDGES = ".,;:!?\"'()[]{}<>#*%&|-_"
SPELT = re.compile(r"(?<!\S)\S(?:\s{1,3}\S){2,}(?!\S)")


def letters() -> np.ndarray:
    """Code point -> 1..26 for letters a to z after folding, 28..31 by hash for other letters, 0 for what is none."""
    out = np.zeros(0x10000, dtype=np.int64)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = LOOKALIKES.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[:1]
        if "a" <= x <= "z":
            out[c] = ord(x) - 96
        elif chr(c).isalpha():
            out[c] = 28 + c % 4
    return out


class Kernel:
    """Features of strings: their subsequences of four letters."""

    def __init__(self):
        self.letters = letters()

    def codes(self, text: str) -> np.ndarray:
        """The letters of a text and 0 for its other characters; -1 for the padding."""
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        return np.where(c == 0, -1, np.where(c < 0x10000, self.letters[np.minimum(c, 0xFFFF)], 0))

    def windows(self, string: str) -> list[str]:
        """The string, or the windows of its letters if it has more than LONG characters."""
        if len(string) <= LONG:
            return [string]
        kept = "".join(ch for ch, k in zip(string, self.codes(string)) if k > 0)
        return [kept[a : a + LONG] for a in range(0, max(1, len(kept) - LONG // 2), LONG // 2)]

    def symbols(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of all strings with zeros between them, the string each belongs to)."""
        s = self.codes("".join(x + PAD for x in strings))
        owner = np.repeat(np.arange(len(strings)), [len(x) + SPAN for x in strings])
        kept = s != 0
        s, owner = np.maximum(s[kept], 0), owner[kept]
        short = np.flatnonzero(np.bincount(owner, s > 0, len(strings)) == 3)
        s[np.searchsorted(owner, short) + 3] = END
        return s, owner

    def subsequences(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, subsequence, weight) of each occurrence."""
        s, owner = self.symbols(strings)
        n = len(owner)
        s = np.concatenate([s, np.zeros(SPAN, dtype=s.dtype)])
        first = np.flatnonzero(s[:n])
        shifted = [s[first + k] for k in range(SPAN)]
        own, keys, weights = [], [], []
        for (a, b, c), w in STEPS:
            x, y, z = shifted[a], shifted[b], shifted[c]
            here = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
            own.append(owner[first[here]])
            keys.append(shifted[0][here] << 15 | x[here] << 10 | y[here] << 5 | z[here])
            weights.append(np.full(len(here), w))
        return np.concatenate(own), np.concatenate(keys), np.concatenate(weights)

    def norms(self, n: int, own: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        both, back = np.unique(own << BITS | keys, return_inverse=True)
        total = np.bincount(back, weights=weights)
        return np.maximum(np.sqrt(np.bincount(both >> BITS, weights=total**2, minlength=n)), 1e-12)

    def dense(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features, used): normalised vectors over the subsequences that occur; zero for strings without any."""
        own, keys, weights = self.subsequences(strings)
        used, place = np.unique(keys, return_inverse=True)
        norm = self.norms(len(strings), own, keys, weights)
        out = np.zeros((len(strings), len(used)), dtype=np.float32)
        for a in range(0, len(strings), BLOCK):
            at = (own >= a) & (own < a + BLOCK)
            n = min(BLOCK, len(strings) - a)
            flat = np.bincount((own[at] - a) * len(used) + place[at], weights=weights[at], minlength=n * len(used))
            out[a : a + n] = flat.reshape(n, len(used)) / norm[a : a + n, None]
        return out, used

    def against(self, strings: list[str], land: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Kernel values, strings x landmarks. land: the landmarks' features at the subsequences `used`."""
        own, keys, weights = self.subsequences(strings)
        norm = self.norms(len(strings), own, keys, weights)
        place = np.full(SIZE, -1)
        place[used] = np.arange(len(used))
        at = place[keys] >= 0
        flat = np.bincount(own[at] * len(used) + place[keys[at]], weights=weights[at], minlength=len(strings) * len(used))
        return flat.reshape(len(strings), len(used)) @ land.T / norm[:, None]

    def margins(self, strings: list[str], table: np.ndarray) -> np.ndarray:
        """max(0, <features, table>) of each string's worst window."""
        parts, who = [], []
        for k, s in enumerate(strings):
            cuts = self.windows(s)
            parts += cuts
            who += [k] * len(cuts)
        out = np.zeros(len(strings))
        if not parts:
            return out
        own, keys, weights = self.subsequences(parts)
        raw = np.bincount(own, weights=weights * table[keys], minlength=len(parts))
        up = raw > 0  # the others count 0: no norm needed
        at = up[own]
        norm = self.norms(len(parts), own[at], keys[at], weights[at])
        np.maximum.at(out, np.array(who), np.where(up, raw / norm, 0.0))
        return out


def strings_of(text: str) -> set[str]:
    """The strings of a text: its words, lower-cased and without signs around them, and runs of three or more single
    characters."""
    low = text.lower()
    return {s.strip(EDGES) for s in {*low.split(), *SPELT.findall(low)}}


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+(?=\s|$)", text) if s.strip()]


@dataclass
class Model:
    """table: a weight for each subsequence; bias, slope, offset: score = sigmoid(slope * (margin + bias) + offset)."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.offset, -50, 50)))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias, self.slope, self.offset], self.table]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        x = np.frombuffer(raw, "<f8")
        return cls(x[3:], *map(float, x[:3]))


@dataclass(frozen=True)
class Training:
    """Bounds of what the machine is shown, and its settings, which were chosen by a split of training rows (README).

    landmarks: landmarks of the first round; half a third more may join each round. witnesses, plain: telling strings,
    and clean strings, that are shown at most, the most frequent first. tried: strings looked through for landmarks.
    c: the machine's cost of an error. spoilt: forms of each witness with a foreign letter inside; share: what
    they weigh for the sigmoid against the text itself. errors: by how many
    standard errors a telling string's log odds must be above even.
    """

    landmarks: int = 160
    rounds: int = 7
    witnesses: int = 2000
    plain: int = 8000
    tried: int = 400
    c: float = 0.01
    spoilt: int = 4
    share: float = 0.1
    errors: float = 2.0


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        new = np.linalg.solve(ridge + 2 * c * xa.T @ x[on], 2 * c * xa.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit_sigmoid(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, with his smoothed targets; Newton with a small ridge."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([f, np.ones_like(f)])
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * v
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        v = v - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(v[0], 1e-6)), float(v[1])


def apart(k: Kernel, marks: list[str], more: list[str], most: int, like: float = 0.8) -> list[str]:
    """marks and those of more that have features and are not much like an earlier one, up to most."""
    if not more:
        return marks
    both = [*marks, *more]
    f, _ = k.dense(both)
    near = f @ f.T
    del f
    chosen = list(range(len(marks)))
    for j in range(len(marks), len(both)):
        if len(chosen) < most and near[j, j] > 0 and (not chosen or near[j, chosen].max() < like):
            chosen.append(j)
    return [both[j] for j in chosen]


def insert_letters(string: str, times: int) -> list[str]:
    """The string with a letter put inside, at `times` places: which ones depends on the string alone."""
    rng = random.Random(string)
    places = range(1, len(string)) if len(string) > 1 else [1]
    return [string[:a] + rng.choice("abcdefghijklmnopqrstuvwxyz") + string[a:] for a in rng.choices(places, k=times)]


def train(texts: list[str], toxic: np.ndarray, p: Training = Training(), odds: float | None = None) -> Model:
    """Fit on labelled texts. Fewer than one text of either class: a constant score, the smoothed share of toxic ones.
    odds: clean texts to a toxic one among all labels, which the sigmoid is fitted to; None: those of the texts."""
    pos, n = int(toxic.sum()), len(texts)
    if not 0 < pos < n:
        share = (pos + 0.5) / (n + 1.0) if n else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), 0.0, 1e-6, float(np.log(share / (1 - share))))
    k = Kernel()
    index: dict[str, int] = {}
    owned, text_of = [], []  # each sentence's strings, by number, and its text
    for j, t in enumerate(texts):
        for sentence in sentences_of(t) if t else []:
            bag = sorted(strings_of(sentence))
            owned.append(np.fromiter((index.setdefault(s, len(index)) for s in bag), dtype=np.int64, count=len(bag)))
            text_of.append(j)
    names, text_of = list(index), np.array(text_of, dtype=np.int64)
    del index
    flat = np.concatenate([*owned, np.zeros(0, dtype=np.int64)])
    of_text = np.repeat(text_of, [len(o) for o in owned]) if owned else flat
    bad = toxic[of_text] == 1 if len(flat) else flat == 1
    counts = np.stack([np.bincount(flat[~bad], minlength=len(names)), np.bincount(flat[bad], minlength=len(names))], axis=1).astype(float)
    sentences = np.bincount(toxic[text_of], minlength=2).astype(float) if len(text_of) else np.zeros(2)
    # log odds ratio of being in sentences of toxic texts, less standard errors
    cells = [counts[:, 1] + 0.5, np.maximum(sentences[1] - counts[:, 1], 0) + 0.5, counts[:, 0] + 0.5, np.maximum(sentences[0] - counts[:, 0], 0) + 0.5]
    lift = np.log(cells[0] / cells[1] * cells[3] / cells[2]) - p.errors * np.sqrt(sum(1 / c for c in cells))
    telling = np.flatnonzero(lift > 0)
    telling = telling[np.argsort(-counts[telling, 1], kind="stable")][: p.witnesses]
    plain = [names[j] for j in telling]
    spoilt = [x for s in plain for x in insert_letters(s, p.spoilt)]
    clean = np.flatnonzero(counts[:, 0] > 0)
    margin, table, bias = np.zeros(len(names)), np.zeros(SIZE), 0.0
    negatives = clean[np.argsort(-counts[clean, 0], kind="stable")][: p.plain]
    marks = apart(k, [], [names[j] for j in telling[np.argsort(-lift[telling], kind="stable")][: p.tried]], p.landmarks)
    marks = apart(k, marks, [names[j] for j in negatives[: p.tried // 2]], p.landmarks + p.landmarks // 4)
    for _ in range(p.rounds if plain and marks else 0):
        land, used = k.dense(marks)
        value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
        ok = value > 0.05
        project = vector[:, ok] / np.sqrt(value[ok])  # the Nystroem map is k(x, landmarks) @ project
        parts = [*plain, *spoilt, *(names[j] for j in negatives)]
        x = np.concatenate([k.against(parts[a : a + BLOCK], land, used) @ project for a in range(0, len(parts), BLOCK)])
        x = np.column_stack([x, np.ones(len(x))])
        y = np.concatenate([np.ones(len(plain) + len(spoilt)), -np.ones(len(negatives))])
        each = counts[telling, 1] * (n - pos) / pos
        w = fit_svm(x, y, np.concatenate([each, np.repeat(each / max(1, p.spoilt), p.spoilt), 5 * counts[negatives, 0]]), p.c)
        table[:], bias = 0.0, float(w[-1])
        table[used] = land.T @ (project @ w[:-1])
        margin = np.concatenate([k.margins(names[a : a + 5_000], table) for a in range(0, len(names), 5_000)])
        # clean strings that come too near are shown again, and the nearest become landmarks too
        hard = clean[np.argsort(-margin[clean], kind="stable")][: p.plain // 2]
        negatives = np.array(list(dict.fromkeys([*negatives[: p.plain // 2], *hard])))
        marks = apart(k, marks, [names[j] for j in hard[: p.tried] if margin[j] + bias > -0.5], len(marks) + p.landmarks // 3)
    worst, which = np.zeros(n), np.full(n, -1)
    for o, j in zip(owned, text_of):
        if len(o) and margin[o].max() > worst[j]:
            worst[j], which[j] = margin[o].max(), o[margin[o].argmax()]
    # the sigmoid sees each toxic text's witness in its forms with a foreign letter too
    f, y, weight = [worst], [toxic.astype(float)], [np.where(toxic == 1, 1.0, 1.0 if odds is None else odds * pos / (n - pos))]
    if plain:
        forms = dict(zip(telling.tolist(), k.margins(spoilt, table).reshape(len(plain), -1)))
        for j in np.flatnonzero(toxic == 1):
            if which[j] in forms:
                f.append(forms[which[j]])
                y.append(np.ones(p.spoilt))
                weight.append(np.full(p.spoilt, p.share / p.spoilt))
    slope, offset = fit_sigmoid(np.concatenate(f) + bias, np.concatenate(y), np.concatenate(weight))
    return Model(table, bias, slope, offset)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> DataFrame:
    """(text, y, odds) of labelled rows that are not held out: at most per_class of either label, of at most `longest` code
    points each. Where there are more, those whose id's hash is under the share that gives nine tenths of it. odds: clean labels to a toxic one, of all."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = F.lit(0)
    for y, n in counts.items():
        cut = F.when(F.col("y") == y, 1_000_000 if n <= per_class else int(900_000 * per_class / n)).otherwise(cut)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(some, "doc_id").select("text", "y", F.lit(counts.get(0, 0) / max(1, counts.get(1, 0))).alias("odds"))
    return rows.filter("y = 0").limit(per_class).unionByName(rows.filter("y = 1").limit(per_class))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 20_000) -> Model:
    """Train on a bounded sample (see sample) of labelled rows that are not held out.

    One executor task holds the sample and trains; only the model, eight megabytes, goes to the driver. labels: doc_id,
    toxic (0, 1 or null: skipped); repeated and contradicting labels each count. Null ids have no label.
    """

    def fit(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "text"])  # the order rows arrive in plays no part
        return pd.DataFrame({"model": [train(list(g["text"]), g["y"].to_numpy(dtype=np.int64), odds=float(g["odds"].iloc[0])).to_bytes()]})

    one = sample(docs, labels, per_class, longest).withColumn("all", F.lit(0))
    got = one.groupBy("all").applyInPandas(fit, "model binary").first()
    return Model.from_bytes(bytes(got["model"])) if got else train([], np.zeros(0, dtype=np.int64))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs and a double column `out` (replaced if there), 0 to 1, from the whole text alone. Null text counts as
    empty, and empty text gets the lowest score. Rows, their order of columns and repeats are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB at any input size

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, k, known = shared.value, Kernel(), {}
        for b in batches:
            bags = [strings_of(t) if t else () for t in b]
            fresh = sorted({s for bag in bags for s in bag if s not in known})
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = sorted({s for bag in bags for s in bag})
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                known.update(zip(part, k.margins(part, m.table).tolist()))
            yield pd.Series(m.score(np.array([max((known[s] for s in bag), default=0.0) for bag in bags])))

    return docs.withColumn(out, worst("text"))
