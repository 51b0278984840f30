"""LM scoring by masked pseudo-likelihood.

A window network predicts every token from WIDTH tokens on both sides: h = tanh(b + sum over offsets of E_offset[token]).
A document's score is the sum of the log-probabilities of all its tokens, each masked in turn.

The network's outputs are classes: the corpus's most frequent words, counted over all documents, and hash buckets for
the rest. Its softmax has two levels, so thousands of classes cost little: classes are dealt to groups by frequency, and
P(class) = P(group | h) P(class | group, h). A token in a bucket has the bucket's probability times its own share of the
bucket's count. Shares are exact for the `listed` most frequent tokens; the others are counted in hash slots, whose
tokens share the slot's count evenly with an unseen one.

The corpus is tokenised once: the pass that counts tokens also writes each text as 32-bit token hashes, and all later
passes read those. (Two tokens of one hash are one token to the model.)

The network is trained in numpy, data-parallel. Documents are dealt by a hash of doc_id and text to as many parts as
the corpus has `part` tokens; in each round every part starts from the shared parameters and trains on each STRIDE-th
token of all its documents (the next offset each round, so STRIDE rounds train on every token once), and the parts'
parameters are averaged, weighted by tokens, in two steps of bounded groups. Parts, their order and the sums' order come
from hashes alone, so scores do not depend on how the table is partitioned. What training reads and gathers grows with
the corpus; the parameters do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64

TOKEN = re.compile(r"\w+|[^\w\s]")
WIDTH, HIDDEN = 3, 24
OFFSETS = [k for k in range(-WIDTH, WIDTH + 1) if k]
#: Positions that are scored at once, and the first and the largest batch that is trained at once: it doubles every
#: WARM steps.
STEP, FIRST, BATCH, WARM = 16_384, 128, 8192, 40
#: Logits of which a softmax needs no maximum: exp and sums of thousands of them stay in range.
LOGIT = 60.0
#: Positions whose logits are held at once.
CACHED = 2048
#: Blocks in which the slots come to the driver.
BLOCKS = 64
#: Floats of a parameter row on its way to the average, and groups of its first step.
BLOCK, SALTS = 16_384, 64
#: Distinct tokens a task counts before it writes the counts down.
FLUSH = 1_000_000
#: Rows of counts that are sent at once.
ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    words: int = 1792
    buckets: int = 256
    listed: int = 65_536
    slots: int = 1 << 22
    part: int = 4_000_000
    stride: int = 2
    rate: float = 0.15
    seed: int = 17

    @property
    def size(self) -> int:
        return self.words + self.buckets


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Hasher:
    """Tokens as 32-bit hashes, for many texts at once: a token's hash is a polynomial of its code points, taken from
    running sums over all of them."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.kinds = np.array([self.kind(chr(c)) for c in range(0x10000)], dtype=np.uint8)
        self.up, self.down = self.powers(1 << 16)

    @staticmethod
    def kind(ch: str) -> int:
        """1 for characters of words, 0 for white space, 2 for others: tokens of their own."""
        return 1 if ch.isalnum() or ch == "_" else 0 if ch.isspace() else 2

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The base's powers and its inverse's, modulo 2^64."""
        out = []
        for x in (self.BASE, pow(self.BASE, -1, 2**64)):
            all_x = np.full(n, x, dtype=np.uint64)
            all_x[0] = 1
            out.append(np.cumprod(all_x, dtype=np.uint64))
        return out[0], out[1]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all texts' tokens, how many each text has)."""
        low = [(t or "").lower() for t in texts]
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(code) >= len(self.up):
            self.up, self.down = self.powers(2 * len(code))
        kind = self.kinds.take(code, mode="clip")
        if len(code) and code.max() >= 0x10000:
            for c in np.unique(code[code >= 0x10000]):
                kind[code == c] = self.kind(chr(c))
        word, other = kind == 1, kind == 2
        first, last = other | word, other | word
        first[1:] &= ~(word[1:] & word[:-1])
        last[:-1] &= ~(word[:-1] & word[1:])
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.up[: len(code)], out=sums[1:])
        hashes = mix64((sums[last + 1] - sums[first]) * self.down[first]) >> np.uint64(32)
        ends = np.cumsum([len(t) + 1 for t in low])
        return hashes.astype("<u4"), np.diff(np.searchsorted(first, ends), prepend=0)


def read_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, counts) by one pass over whole texts: texts has doc_id, part_key (a hash of doc_id and text) and ids
    (little-endian 32-bit token hashes); counts has h (a token's hash) and n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, size = Hasher(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        def counted() -> Iterator[pd.DataFrame]:
            h, n = merged()
            for a in range(0, len(h), ROWS):
                yield pd.DataFrame({"doc_id": None, "part_key": None, "ids": None, "h": h[a : a + ROWS].astype(np.int64), "n": n[a : a + ROWS]})

        for b in batches:
            hashes, sizes = hasher(list(b["text"]))
            ids = [x.tobytes() for x in np.split(hashes, np.cumsum(sizes)[:-1])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "part_key": b["part_key"], "ids": ids, "h": None, "n": None})
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    key = F.xxhash64("doc_id", "text").alias("part_key")
    told = docs.select(F.col("doc_id").cast("string"), "text", key)  # as text: pandas makes floats of numbers with nulls
    both = durable(told.mapInPandas(run, "doc_id string, part_key bigint, ids binary, h bigint, n bigint"), "token-hashes")
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return both.filter("ids is not null").select(doc_id, "part_key", "ids"), both.filter("h is not null").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """listed: hashes of the frequent words and the listed tokens; classes and inside: their classes and the logs of
    their shares. Hashes fall into slots: at has a slot's listed token, or -1, slot_inside the log of the share of each
    other token of the slot."""

    listed: np.ndarray
    classes: np.ndarray
    inside: np.ndarray
    at: np.ndarray
    slot_inside: np.ndarray
    words: int
    buckets: int

    def encode(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, slot, listed token or -1) of token hashes."""
        slot = (h & np.uint32(len(self.at) - 1)).astype(np.int64)
        at = self.at.take(slot).astype(np.int64)
        at[self.listed.take(at, mode="clip") != h] = -1
        classes, other = self.classes.take(at, mode="clip"), np.flatnonzero(at < 0)
        classes[other] = self.words + slot[other] % self.buckets
        return classes, slot, at

    def encode_texts(self, ids: pd.Series) -> pd.Series:
        """Each text's classes as little-endian 16-bit integers, of its token hashes; all texts are looked up at once."""
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64) // 2  # bytes of classes up to each text's end
        told = self.encode(np.frombuffer(b"".join(ids), "<u4"))[0].astype("<u2").tobytes()
        return pd.Series([told[a:b] for a, b in zip([0, *ends[:-1]], ends)], ids.index, dtype=object)

    def shares(self, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log of the token's share in its class."""
        out, other = self.inside.take(at, mode="clip"), np.flatnonzero(at < 0)
        out[other] = self.slot_inside.take(slot[other])
        return out


def learn_vocabulary(counts: DataFrame, s: Settings) -> tuple[Vocabulary, np.ndarray, int]:
    """(vocabulary, the classes' shares of all tokens, number of tokens) from (h, n).

    Of listed tokens that fall into one slot the most frequent is listed; of those as frequent as the first that finds
    no place, none is. What comes to the driver is bounded: the listed tokens, and six bytes a slot.
    """
    some = counts.orderBy(F.desc("n"), "h").limit(s.words + s.listed).toPandas()
    h, n = some["h"].to_numpy(dtype=np.int64), some["n"].to_numpy(dtype=np.float64)
    if len(some) == s.words + s.listed:
        full = n > n[-1]
        full[: s.words] = True
        h, n = h[full], n[full]
    slot = h & (s.slots - 1)
    first = np.sort(np.unique(slot, return_index=True)[1])
    h, n, slot = h[first], n[first], slot[first]
    at = np.full(s.slots, -1, dtype=np.int32)
    at[slot] = np.arange(len(h))
    words = min(s.words, len(h))

    def by_block(key, g: pd.DataFrame) -> pd.DataFrame:
        mass, kinds = np.zeros(s.slots // BLOCKS, np.float32), np.zeros(s.slots // BLOCKS, np.uint16)
        place = g["slot"].to_numpy(dtype=np.int64) // BLOCKS
        mass[place], kinds[place] = g["n"], np.minimum(g["kinds"], 65535)
        return pd.DataFrame({"block": [key[0]], "mass": [mass.tobytes()], "kinds": [kinds.tobytes()]})

    told = F.broadcast(counts.sparkSession.createDataFrame(pd.DataFrame({"h": h}), "h bigint"))
    rest = counts.join(told, "h", "left_anti").groupBy((F.col("h").bitwiseAND(s.slots - 1)).alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    mass, kinds = np.zeros(s.slots, np.float32), np.zeros(s.slots, np.uint16)
    for r in rest.groupBy((F.col("slot") % BLOCKS).alias("block")).applyInPandas(by_block, "block bigint, mass binary, kinds binary").collect():
        mass[r.block :: BLOCKS], kinds[r.block :: BLOCKS] = np.frombuffer(r.mass, np.float32), np.frombuffer(r.kinds, np.uint16)
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    mass = mass.reshape(-1, s.buckets)  # a slot's bucket is its number's remainder
    in_bucket = mass.sum(axis=0, dtype=np.float64) + np.bincount(slot[words:] % s.buckets, n[words:], s.buckets)
    share = np.ones(s.size)
    share[:words] += n[:words]
    share[s.words :] += in_bucket
    mass += np.float32(s.buckets / s.slots)  # each bucket has one token's worth of unseen ones, dealt to its slots
    mass /= kinds.reshape(mass.shape) + np.float32(1)
    mass /= (in_bucket + 1).astype(np.float32)
    slot_inside = np.log(mass, out=mass).ravel()
    classes = np.concatenate([np.arange(words), s.words + slot[words:] % s.buckets])
    inside = np.concatenate([np.zeros(words), np.log(n[words:] / (in_bucket[slot[words:] % s.buckets] + 1))])
    none = [np.zeros(1, x) for x in (np.uint32, np.int64, np.float64)] if not len(h) else [h.astype(np.uint32), classes, inside]
    return Vocabulary(*none, at, slot_inside.astype(np.float16), s.words, s.buckets), share / share.sum(), total


def group_of(share: np.ndarray) -> np.ndarray:
    """class -> group: classes by falling share, two in the first group, four in the next, and so on: frequent classes
    are in small groups, and some sqrt(classes) groups do."""
    out, rank = np.empty(len(share), dtype=np.int64), np.arange(len(share))
    out[np.argsort(-share, kind="stable")] = ((np.sqrt(4 * rank + 1) - 1) / 2).astype(np.int64)
    return out


class Network:
    """Parameters as one flat float32 vector: E (offset, class or padding, hidden), b, G and g (groups), O and c
    (classes, group by group)."""

    def __init__(self, flat: np.ndarray, group: np.ndarray):
        self.flat, self.group, self.size = flat, group, len(group)
        self.groups = int(group.max()) + 1
        order = np.argsort(group, kind="stable")
        self.first = np.searchsorted(group[order], np.arange(self.groups + 1))
        self.place = np.empty(self.size, dtype=np.int64)
        self.place[order] = np.arange(self.size)  # class -> row of O
        self.sizes = np.diff(self.first)
        self.rows = [slice(i, j) for i, j in zip(self.first[:-1].tolist(), self.first[1:].tolist())]  # group -> rows of O
        self.ones = np.ones(max(self.groups, int(self.sizes.max())), dtype=np.float32)
        n, m, at = len(OFFSETS), self.size + 1, 0
        self.parts = []
        for shape in ((n, m, HIDDEN), (HIDDEN,), (self.groups, HIDDEN), (self.groups,), (self.size, HIDDEN), (self.size,)):
            k = int(np.prod(shape))
            self.parts.append(flat[at : at + k].reshape(shape))
            at += k
        self.e, self.b, self.g, self.gc, self.o, self.c = self.parts
        self.rows_of_e = self.e.reshape(-1, HIDDEN)
        self.rest = flat[self.e.size : at]  # all but E

    @classmethod
    def fresh(cls, share: np.ndarray, seed: int) -> Network:
        group = group_of(share)
        k = int(group.max()) + 1
        n = (len(OFFSETS) * (len(share) + 1) + 1 + k + len(share)) * HIDDEN + k + len(share)
        out = cls(np.random.default_rng(seed).normal(0, 0.1, n).astype(np.float32), group)
        out.b[:] = 0
        mass = np.bincount(group, share, k)
        out.gc[:] = np.log(mass)
        out.c[out.place] = np.log(share / mass[group])
        return out

    def joined(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(classes of all texts with WIDTH paddings around each, the places of the tokens)."""
        edge = np.full(WIDTH, self.size)
        line = np.concatenate([x for t in texts for x in (edge, t)] + [edge]).astype(np.int64)
        return line, np.flatnonzero(line < self.size)

    def contexts(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(offset, place) -> row of E, all offsets' rows counted through."""
        return np.stack([line.take(at + k) + j * (self.size + 1) for j, k in enumerate(OFFSETS)])

    def hidden(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._hidden(self.contexts(line, at))

    def _hidden(self, contexts: np.ndarray) -> np.ndarray:
        """Hidden values; tanh x is 1 - 2 / (exp 2x + 1), whose exp is the faster one."""
        h = self.rows_of_e.take(contexts[0], axis=0)
        for c in contexts[1:]:
            h += self.rows_of_e.take(c, axis=0)
        h += self.b
        h += h
        with np.errstate(over="ignore"):  # infinite: tanh is 1
            np.exp(h, out=h)
        h += np.float32(1)
        np.divide(np.float32(-2), h, out=h)
        h += np.float32(1)
        return h

    def by_group(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
        """(at in the order of its classes' groups, those groups, (stretch of at, the group's rows of O) of each)."""
        own = self.group[line[at]].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        own = own[order]
        ends = np.searchsorted(own, np.arange(self.groups + 1)).tolist()
        return order, own.astype(np.int64), [(slice(ends[k], ends[k + 1]), self.rows[k]) for k in range(self.groups) if ends[k] < ends[k + 1]]

    def log_probs(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-probability of the class at each place, from its neighbours alone."""
        out, safe = np.empty(len(at)), self.safe()
        top, low = np.column_stack([self.g, self.gc]), np.column_stack([self.o, self.c])
        for a in range(0, len(at), STEP):
            here = at[a : a + STEP]
            order, own, stretches = self.by_group(line, here)
            here = here[order]
            one, place = self._with_one(self.hidden(line, here)), self.place[line[here]]
            total = np.concatenate([self._own(*self._top(one[rows], top, own[rows], safe)) for rows in self._parts(len(here))])
            out[a + order] = total + self._own(*self._low(one, low, own, place, stretches, safe))
        return out

    def safe(self) -> bool:
        """Whether no logit can leave +-LOGIT, as the hidden values are within +-1: then exp needs no maximum taken off."""
        most = lambda w, c: (np.abs(w).sum(axis=1) + np.abs(c)).max()
        return bool(max(most(self.g, self.gc), most(self.o, self.c)) < LOGIT)

    @staticmethod
    def _parts(n: int) -> list[slice]:
        """Positions whose logits of all groups stay in a processor's cache."""
        return [slice(a, min(n, a + CACHED)) for a in range(0, n, CACHED)]

    @staticmethod
    def _with_one(h: np.ndarray) -> np.ndarray:
        """Hidden values with a column of ones, which meets the biases."""
        one = np.ones((len(h), h.shape[1] + 1), dtype=np.float32)
        one[:, :-1] = h
        return one

    @staticmethod
    def _logits(one: np.ndarray, weights: np.ndarray, safe: bool, out: np.ndarray) -> np.ndarray:
        """A row of logits for each position, less its largest one unless they are safe."""
        np.dot(one, weights.T, out=out)
        if not safe:
            out -= out.max(axis=1, keepdims=True)
        return out

    def _top(self, one: np.ndarray, top: np.ndarray, own: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(own logits, sums, exp of all logits, where the own ones are in these) of the groups."""
        z = self._logits(one, top, safe, np.empty((len(one), self.groups), dtype=np.float32))
        flat = z.reshape(-1)
        mine = np.arange(0, len(flat), self.groups)
        mine += own
        logits = flat.take(mine)
        np.exp(z, out=z)
        return logits, z @ self.ones[: self.groups], mine, z

    def _low(self, one: np.ndarray, low: np.ndarray, own: np.ndarray, place: np.ndarray, stretches: list[tuple[slice, slice]], safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The same of the classes in the own groups: each position has a row as long as its group, all in one array; its
        pieces, one for each stretch, are the last value."""
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        flat, pieces, sums = np.empty(ends[-1] if len(ends) else 0, dtype=np.float32), [], np.empty(len(one), dtype=np.float32)
        mine, a = ends - sizes, 0
        mine += place - self.first[own]
        for rows, inner in stretches:
            shape = rows.stop - rows.start, inner.stop - inner.start
            pieces.append(self._logits(one[rows], low[inner], safe, flat[a : a + shape[0] * shape[1]].reshape(shape)))
            a += shape[0] * shape[1]
        logits = flat.take(mine)
        np.exp(flat, out=flat)
        for (rows, _), z in zip(stretches, pieces):
            np.dot(z, self.ones[: z.shape[1]], out=sums[rows])
        return logits, sums, mine, flat, pieces

    @staticmethod
    def _own(logits: np.ndarray, sums: np.ndarray, *_) -> np.ndarray:
        """log softmax at the own logits."""
        return logits.astype(np.float64) - np.log(sums)

    def learn(self, line: np.ndarray, at: np.ndarray, rate: float, seen: Network) -> None:
        """One Adagrad step on a batch; seen: the squared gradients so far. Rows that the batch lacks stay as they are."""

        def step(value: np.ndarray, past: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
            root = grad * grad
            root += past if rows is None else past.take(rows, axis=0)
            past[slice(None) if rows is None else rows] = root
            np.sqrt(root, out=root)
            root += 1e-6
            grad *= rate
            grad /= root
            if rows is None:
                value -= grad
            else:
                value[rows] = value.take(rows, axis=0) - grad

        order, own, stretches = self.by_group(line, at)
        at, n = at[order], len(at)
        contexts = self.contexts(line, at)
        h, place = self._hidden(contexts), self.place[line[at]]
        safe, one = self.safe(), self._with_one(h)
        top, low = np.column_stack([self.g, self.gc]), np.column_stack([self.o, self.c])
        dh, dg, do = np.zeros((n + 1, HIDDEN), dtype=np.float32), np.zeros_like(top), np.zeros_like(low)  # the last row of dh stays 0
        # the gradient by the logits is (exp / sum - own) / n: exp less the sum at the own place, and 1 / (n sum) later
        for rows in self._parts(n):
            _, sums, mine, z = self._top(one[rows], top, own[rows], safe)
            z.reshape(-1)[mine] -= sums
            part = (1 / (n * sums))[:, None]
            np.multiply(z @ self.g, part, out=dh[rows])
            dg += z.T @ (one[rows] * part)
        _, sums, mine, flat, pieces = self._low(one, low, own, place, stretches, safe)
        flat[mine] -= sums
        part = (1 / (n * sums))[:, None]
        one *= part
        inner = np.empty_like(h)
        for (rows, k), z in zip(stretches, pieces):
            np.dot(z, self.o[k], out=inner[rows])
            np.dot(z.T, one[rows], out=do[k])
        inner *= part
        dh[:-1] += inner
        h *= h
        np.subtract(np.float32(1), h, out=h)
        dh[:-1] *= h
        rest = np.concatenate([dh.sum(axis=0), dg[:, :-1].ravel(), dg[:, -1], do[:, :-1].ravel(), do[:, -1]])
        step(self.rest, seen.rest, rest)
        step(self.rows_of_e, seen.rows_of_e, *sums_of(dh, contexts))


def sums_of(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the rows of x that have a key, the keys, each once). keys has several rows, of a key for each row of x
    but the last one, which is zeros.

    Rows of a key are added four by four, as whole rows; what is left for reduceat, which goes column by column, are the
    fours of keys that have more than one."""
    n = keys.shape[1]
    bits = n.bit_length()
    both = ((keys << bits) | np.arange(n)).ravel().astype(np.uint32 if int(keys.max()) + 1 << bits < 1 << 32 else np.uint64)
    both.sort()
    key, order = (both >> bits).astype(np.int64), (both & ((1 << bits) - 1)).astype(np.int64)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    count = np.diff(ends, prepend=0)
    more = count > 4
    which = np.concatenate([np.flatnonzero(more), np.flatnonzero(~more)])
    ends, count, some = ends[which], count[which], int(more.sum())
    fours = (count + 3) >> 2
    begin = np.cumsum(fours) - fours
    split = begin[some] if some < len(begin) else fours.sum()
    row = np.arange(0, 4 * int(fours.sum()), 4) + np.repeat(ends - count - 4 * begin, fours)
    last = np.repeat(ends, fours)
    total = x.take(order.take(row), axis=0)
    for _ in range(3):
        row += 1
        total += x.take(np.where(row < last, order.take(row, mode="clip"), n), axis=0)
    if some:
        # as pairs: a sum of complex numbers is two sums
        longer = np.add.reduceat(total[:split].view(np.complex64), begin[:some], axis=0).view(np.float32)
        total = np.concatenate([longer, total[split:]])
    return total, key[ends - 1]


def train_part(flat: np.ndarray, group: np.ndarray, texts: list[np.ndarray], s: Settings, turn: int) -> tuple[np.ndarray, int]:
    """(parameters, tokens trained on) after each stride-th token of texts, from the turn-th on."""
    net, seen = Network(flat.copy(), group), Network(np.zeros_like(flat), group)
    line, at = net.joined(texts)
    at = at[turn % s.stride :: s.stride]
    a = steps = 0
    while a < len(at):
        size = min(BATCH, FIRST << (steps // WARM))
        net.learn(line, at[a : a + size], s.rate, seen)
        a, steps = a + size, steps + 1
    return net.flat, len(at)


def _round(dealt: DataFrame, flat: np.ndarray, group: np.ndarray, s: Settings, turn: int) -> np.ndarray:
    """The average of what all parts have learnt from `flat`."""
    start = dealt.sparkSession.sparkContext.broadcast((flat, group))  # a megabyte or two at any input size

    def train(key, g: pd.DataFrame) -> pd.DataFrame:
        flat, group = start.value
        g = g.sort_values(["part_key", "classes"], kind="stable")
        texts = [np.frombuffer(x, "<u2") for x in g["classes"]]
        new, n = train_part(flat, group, texts, s, turn)
        blocks = [new[a : a + BLOCK].tobytes() for a in range(0, len(new), BLOCK)] if n else []
        return pd.DataFrame({"block": range(len(blocks)), "part": key[0], "n": float(n), "mean": blocks})

    def add(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        n, total = g["n"].sum(), 0.0
        for x, w in zip(g["mean"], g["n"]):
            total = total + np.frombuffer(x, np.float32).astype(np.float64) * (w / n)
        return pd.DataFrame({"block": [key[0]], "part": [g["part"].iloc[0]], "n": [n], "mean": [total.astype(np.float32).tobytes()]})

    schema = "block int, part bigint, n double, mean binary"
    learnt = dealt.groupBy("part").applyInPandas(train, schema)
    some = learnt.groupBy("block", (F.col("part") % SALTS).alias("salt")).applyInPandas(add, schema)
    blocks = some.groupBy("block").applyInPandas(add, schema).select("block", "mean").toPandas()
    if blocks.empty:
        return flat
    return np.concatenate([np.frombuffer(x, np.float32) for x in blocks.sort_values("block")["mean"]])


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all tokens), mean_log_prob (null without tokens): a row for each row of docs
    (doc_id, text), repeated rows included. Null text counts as empty: no tokens, log_prob 0. Null doc_ids stay. Empty
    docs give an empty result; other columns are ignored. The table's partitions, and the order of its rows, do not
    change a score."""
    texts, counts = read_corpus(docs)
    vocabulary, share, total = learn_vocabulary(durable(counts, "token-counts"), s)
    parts = max(1, -(-total // s.part))
    net = Network.fresh(share, s.seed)
    flat = net.flat
    words = texts.sparkSession.sparkContext.broadcast(vocabulary)  # some 25 MB at any input size

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield words.value.encode_texts(b)

    dealt = texts.select(F.pmod("part_key", F.lit(parts)).alias("part"), "part_key", encoded("ids").alias("classes"))
    for turn in range(s.stride if total else 0):
        flat = _round(dealt, flat, net.group, s, turn)
    shared = texts.sparkSession.sparkContext.broadcast((flat, net.group))

    @F.pandas_udf("n_tokens bigint, log_prob double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (flat, group), v = shared.value, words.value
        net = Network(flat.copy(), group)
        for b in batches:
            hashes = [np.frombuffer(x, "<u4") for x in b]
            sizes = np.array([len(x) for x in hashes])
            classes, *where = v.encode(np.concatenate(hashes))
            line, at = net.joined(np.split(classes, np.cumsum(sizes)[:-1]))
            own = np.repeat(np.arange(len(sizes)), sizes)
            yield pd.DataFrame({"n_tokens": sizes, "log_prob": np.bincount(own, net.log_probs(line, at) + v.shares(*where), len(sizes))})

    out = texts.select("doc_id", judge("ids").alias("s")).select("doc_id", "s.n_tokens", "s.log_prob")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
