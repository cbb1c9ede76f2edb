"""Operator 11: log probabilities of whole texts under a causal self-attention model on subword ids.

A text's words (ASCII letters lower-cased) are spelled in the ids of a given vocabulary, followed by
one end. Each id has a class: frequent ids one of their own, the others share classes of about equal
mass. The model's probability of an id is that of its class, given the ids before, times the id's
share of its class after the class before, over all training texts; so the probabilities of all
texts of ids sum to one. Class probabilities are those of the class before (pairs counted over all training texts), scaled by what
one head of masked attention over the last ``CONTEXT`` to ``CONTEXT + STRIDE`` ids adds, and
normalised. Windows overlap by ``CONTEXT`` ids, of which a window scores none: each id is scored
once, whatever the length of its text. A text of any length runs through in slices, with the same
windows as in one piece.

All of it is learned from all training texts, which are spelled once and stored as ids: counts of words,
ids and pairs, the classes, and the attention's weights. These are trained by numpy (cross entropy, Adam)
on every window: shards dealt by hash move the same weights side by side, and the mean of theirs counts.
The baseline needs the count of every word: those of the at most ``head`` most frequent words go to all
tasks, the rest are joined by a 64-bit digest, by which all words are told apart.

A null or empty text has the end token only. Repeated rows give a row each; a null id counts as
empty text for the folds. Without training texts all ids of a class, and all classes, are equally
likely, and every word is unknown. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmeter.llm.chargrams import ROWS, in_fold
from dialogmeter.llm.store import ship, stored
from dialogmeter.llm.textbuf import WHITESPACE, hash_words, mix64, slices, text_bytes

CONTEXT, STRIDE = 8, 24
WINDOW = CONTEXT + STRIDE
#: Classes, those of one id, classes of a group, and the width of the states.
CLASSES, SINGLE, GROUP, WIDTH = 512, 448, 16, 16
#: Windows worked on at a time, and those whose probabilities are taken at a time.
BATCH, STATES = 64, 1024
#: Windows of a step of training, and passes over a table that makes fewer than ``LEAST`` steps.
STEP, LEAST, PASSES = 128, 256, 4
#: Windows of a shard, windows shuffled in memory at a time, and those of a stored row at most.
SHARD, BLOCK, ROW = 1 << 16, 1 << 15, 64
#: Spelled words a worker holds, and their ids together; it starts anew when either is full.
MEMO, POOL = 4_000_000, 1 << 24
#: Distinct words counted by a task before they are sent on.
HELD = 1_000_000
#: Logits beyond the pair counts are kept within these bounds.
BOUND = 30.0
WORDS, IDS, PAIRS, SHARED, TEXTS = 0, 1, 2, 3, 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ words and ids


class Speller:
    """The ids of words, in one growing pool."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.pool = np.zeros(1 << 16, np.uint16)
        self.forget()

    def forget(self) -> None:
        self.used = 0
        #: Digests in order, and the place in the pool and number of ids of each: of most words, and of the latest.
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]

    def spell(self, hashes: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of distinct words, by digest; ``words(which)`` is their texts."""
        if sum(len(known) for known, _ in self.levels) > MEMO or self.used > POOL:
            self.forget()
        packed = np.zeros(len(hashes), np.int64)  # a word has at least one id
        for known, places in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                packed += np.where(known[at] == hashes, places[at], 0)
        fresh = np.flatnonzero(packed == 0)
        if len(fresh):
            made = [ids or [0] for ids in self.library.encode(words(fresh), num_threads=1)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            total = int(sizes.sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint16)])
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.uint16, total)
            packed[fresh] = (self.used + np.cumsum(sizes) - sizes) << 24 | sizes
            self.used += total
            most, latest = self.levels
            latest = _inserted(*latest, hashes[fresh], packed[fresh])
            if len(latest[0]) > max(1 << 16, len(most[0]) >> 3):
                most, latest = _inserted(*most, *latest), (latest[0][:0], latest[1][:0])
            self.levels = [most, latest]
        return packed >> 24, packed & 0xFFFFFF


def _inserted(known: np.ndarray, values: np.ndarray, keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(known, keys)
    return np.insert(known, at, keys), np.insert(values, at, more)


def _texts_at(data: bytes, start: np.ndarray, stop: np.ndarray) -> list[str]:
    """The words from ``start`` to ``stop``; none has a blank."""
    size = stop - start + 1
    ends = np.cumsum(size)
    letters = np.frombuffer(data + b" ", np.uint8)[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
    letters[ends - 1] = 32
    return letters[:-1].tobytes().decode("utf-8", "replace").split(" ")


_spellers: dict[str, Speller] = {}


def speller(path: str) -> Speller:
    if path not in _spellers:
        _spellers[path] = Speller(path)
    return _spellers[path]


@dataclass
class Spelled:
    """Some consecutive texts, or a piece of one: its distinct words, and its ids."""

    first: int  # text
    last: bool  # whether the last text ends here
    hashes: np.ndarray  # of distinct words
    which: np.ndarray  # distinct word of each word
    words: np.ndarray  # number of words of each text
    ids: np.ndarray  # of all words
    lengths: np.ndarray  # number of ids of each text


def spelled(column: pa.Array, path: str) -> Iterator[Spelled]:
    """The texts of a column slice by slice; a text longer than a slice comes in several pieces."""
    data, offsets = text_bytes(column)
    library = speller(path)
    for first, after, at, end, last in slices(offsets, data, WHITESPACE):
        part = data[at:end]
        bounds = offsets[first : after + 1] - at
        bounds = np.clip(bounds, 0, len(part))
        # A break between two texts keeps the last word of one from joining the first of the next.
        part = np.insert(part, bounds[1:-1], 32)
        bounds = bounds + np.arange(len(bounds))
        bounds[-1] = len(part)
        hashes, start, stop = hash_words(part, WHITESPACE)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        low = part.tobytes().lower()  # of bytes: A-Z only
        start_of, stop_of = start[example], stop[example]
        places, sizes = library.spell(distinct, lambda which, low=low, s=start_of, e=stop_of: _texts_at(low, s[which], e[which]))
        size = sizes[which]
        ends = np.cumsum(size)
        ids = library.pool[np.repeat(places[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.searchsorted(start, bounds)
        id_cuts = np.append(0, ends)[cuts]
        yield Spelled(first, bool(last), distinct, which, np.diff(cuts), ids, np.diff(id_cuts))


# ------------------------------------------------------------------ the model


@dataclass(frozen=True)
class Weights:
    """Attention weights; E also has a row for the start, U and G are for classes and their groups."""

    E: np.ndarray
    P: np.ndarray
    Q: np.ndarray
    K: np.ndarray
    V: np.ndarray
    O: np.ndarray  # noqa: E741
    U: np.ndarray
    G: np.ndarray

    @classmethod
    def fresh(cls, classes: int, seed: int) -> "Weights":
        random = np.random.default_rng(seed)

        def some(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        d = WIDTH
        return cls(some(classes + 1, d, scale=0.5), some(WINDOW, d, scale=0.1), *(some(d, d, scale=d**-0.5) for _ in range(4)),
                   some(d, classes, scale=0.02), some(d, classes // GROUP, scale=0.02))


#: Which of the window's inputs each scored place may see: itself and those before it.
HIDDEN = np.where(np.arange(WINDOW)[None] <= np.arange(STRIDE)[:, None] + CONTEXT, 0, -1e9).astype(np.float32)
VISIBLE = (HIDDEN == 0).astype(np.float32)


def attend(w: Weights, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(state of each scored place, what the gradient needs) of windows of ``WINDOW`` classes."""
    x = np.take(w.E, inputs, axis=0)
    x += w.P
    own = np.ascontiguousarray(x[:, CONTEXT:])
    asked, told = _rows(own, w.Q @ w.K.T * WIDTH**-0.5), _rows(x, w.V @ w.O)
    a = asked @ x.transpose(0, 2, 1)
    if too_large(asked, x, 2 * BOUND):  # too large for exp
        a += HIDDEN
        a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a *= VISIBLE
    mass = np.einsum("ijk->ij", a)[:, :, None]
    seen = a @ told
    seen /= mass
    return own + seen, (x, own, asked, told, a, mass, seen)


def _rows(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``x @ matrix`` as one product."""
    return (x.reshape(-1, x.shape[-1]) @ matrix).reshape(*x.shape[:-1], -1)


@dataclass(frozen=True)
class Model:
    """Class of each id and its log share of it; pair probabilities (last row: after the start), of classes and of
    groups, and counts; how often ids of shared classes (``key``: class before * ids + id, in order) occur; weights."""

    path: str
    classes: np.ndarray
    share: np.ndarray
    pairs: np.ndarray
    groups: np.ndarray
    pair_counts: np.ndarray
    keys: np.ndarray
    often: np.ndarray
    weights: Weights
    prior: float = 2.0

    @property
    def end(self) -> int:
        return self.pairs.shape[1] - 1

    @property
    def start(self) -> int:
        return self.pairs.shape[1]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last ``STRIDE`` classes of windows of ``WINDOW + 1`` classes."""
        out = np.empty((len(windows), STRIDE))
        w, state = self.weights, attention(self.weights)
        far = max(_largest(w.G.T), _largest(w.U.T))
        places = np.arange(BATCH * STRIDE)
        for at in range(0, len(windows), STATES):
            part = windows[at : at + STATES].astype(np.intp)
            before, wanted = part[:, CONTEXT:-1].ravel(), part[:, CONTEXT + 1 :].ravel()
            group = wanted // GROUP
            states, got = np.empty((len(wanted), WIDTH), np.float32), np.empty(len(wanted), np.float32)
            clips = False
            for k in range(0, len(part), BATCH):
                here = slice(k * STRIDE, min(k + BATCH, len(part)) * STRIDE)
                some = states[here]
                state(part[k : k + BATCH, :-1], some.reshape(-1, STRIDE, WIDTH))
                clip = _at_most(some) * far > BOUND
                clips |= clip
                z = scaled(some, w.G, clip)
                z *= np.take(self.groups, before[here], axis=0)
                got[here] = z[places[: len(z)], group[here]]
                got[here] /= np.einsum("ij->i", z)
            got *= self._chances_inside(states, before, wanted, group, clips)
            out[at : at + STATES] = np.log(got).reshape(-1, STRIDE)
        return out

    def _chances_inside(self, states: np.ndarray, before: np.ndarray, wanted: np.ndarray, group: np.ndarray, clip: bool) -> np.ndarray:
        """Probabilities of the wanted classes within their groups; the places of one group are taken at a time."""
        w, groups = self.weights, self.groups.shape[1]
        order = np.argsort(group.astype(np.uint8 if groups <= 256 else np.int16), kind="stable")
        sorted_group = group[order]
        ends = np.searchsorted(sorted_group, np.arange(groups + 1))
        states, rows, inside = np.take(states, order, axis=0), before[order] * groups + sorted_group, np.empty(len(order), np.float32)
        chosen = np.arange(len(order)) * GROUP + wanted[order] - sorted_group * GROUP
        table = self.pairs.reshape(-1, GROUP)
        for g in np.flatnonzero(np.diff(ends)):
            own = slice(ends[g], ends[g + 1])
            z = scaled(states[own], w.U[:, g * GROUP : (g + 1) * GROUP], clip)
            z *= np.take(table, rows[own], axis=0)
            inside[own] = np.take(z, chosen[own] - ends[g] * GROUP)
            inside[own] /= np.einsum("ij->i", z)
        out = np.empty_like(inside)
        out[order] = inside
        return out

    def log_shares(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of each id's share of its class, after the class before it; 0 for an id with a class of its own."""
        own = self.classes[ids]
        out = np.zeros(len(ids))
        shared = np.flatnonzero(self.share[ids] < 0)
        if len(shared):
            key = before[shared] * np.int64(len(self.classes)) + ids[shared]
            n = np.zeros(len(shared))
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                n = np.where(self.keys[at] == key, self.often[at], 0)
            all_ = self.pair_counts[before[shared], own[shared]]
            out[shared] = np.log((n + self.prior * np.exp(self.share[ids[shared]])) / (all_ + self.prior))
        return out


def _largest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("...i,...i->...", rows, rows).max(initial=0)))


def _at_most(rows: np.ndarray) -> float:
    """``_largest`` or more, sooner known."""
    return float(max(rows.max(initial=0), -rows.min(initial=0))) * WIDTH**0.5


def too_large(left: np.ndarray, right: np.ndarray, most: float) -> bool:
    """Whether products of rows could be beyond ``most``."""
    return _at_most(left) * _at_most(right) > most and _largest(left) * _largest(right) > most


def scaled(states: np.ndarray, columns: np.ndarray, clip: bool) -> np.ndarray:
    """What the states multiply the pairs' probabilities by; ``clip`` unless no logit can be beyond the bounds."""
    z = states @ columns
    if clip:
        np.clip(z, -BOUND, BOUND, out=z)
    return np.exp(z, out=z)


def attention(w: Weights):
    """``attend`` without what the gradient needs, from tables of what each class and each place add."""
    d = WIDTH
    asks, tells = w.Q @ w.K.T * WIDTH**-0.5, w.V @ w.O

    def table(x: np.ndarray, one: int) -> np.ndarray:
        return np.concatenate([x, x @ tells, np.full((len(x), 1), one, np.float32)], 1)

    # The last column sums up the attention.
    seen_by_class, seen_by_place = table(w.E, 1), table(w.P, 0)
    own_by_class, own_by_place = w.E @ asks, w.P[CONTEXT:] @ asks
    far = (_largest(own_by_class) + _largest(own_by_place)) * (_largest(w.E) + _largest(w.P))

    def state(inputs: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        seen = np.take(seen_by_class, inputs, axis=0)
        seen += seen_by_place
        asked = np.take(own_by_class, inputs[:, CONTEXT:], axis=0)
        asked += own_by_place
        x = seen[:, :, :d]
        a = asked @ x.transpose(0, 2, 1)
        if far > 2 * BOUND and too_large(asked, x, 2 * BOUND):  # too large for exp
            a += HIDDEN
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= VISIBLE
        mean = a @ seen[:, :, d:]
        out = np.divide(mean[:, :, :d], mean[:, :, d:], out=out)
        out += x[:, CONTEXT:]
        return out

    return state


def grouped(pairs: np.ndarray) -> np.ndarray:
    """The pairs' probabilities summed over each group of classes."""
    return pairs.reshape(len(pairs), -1, GROUP).sum(2)


def class_windows(z: np.ndarray, fill: int) -> np.ndarray:
    """Windows of ``WINDOW + 1`` of the classes ``z``, each ``STRIDE`` after the one before; the last one is filled up."""
    n = max(0, -(-(len(z) - CONTEXT - 1) // STRIDE))
    padded = np.full(n * STRIDE + CONTEXT + 1, fill, z.dtype)
    padded[: min(len(z), len(padded))] = z[: len(padded)]
    if not n:
        return np.zeros((0, WINDOW + 1), z.dtype)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::STRIDE]


def texts_windows(z: np.ndarray, places: np.ndarray, fill: int) -> np.ndarray:
    """``class_windows`` of consecutive texts that begin at ``places``; the last place is the end of ``z``."""
    sizes = np.diff(places)
    n = np.maximum(0, -(-(sizes - CONTEXT - 1) // STRIDE))
    room = np.maximum(n * STRIDE + CONTEXT + 1, sizes)
    at = np.cumsum(room) - room
    padded = np.full(room.sum(), fill, z.dtype)
    padded[np.repeat(at - places[:-1], sizes) + np.arange(len(z))] = z
    if not n.any():
        return np.zeros((0, WINDOW + 1), z.dtype)
    first = np.repeat(at - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum())
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[first]


def train(blocks: Iterable[np.ndarray], pairs: np.ndarray, start: Weights | None = None, windows: int = SHARD, passes: int = 1,
          rate: float = 0.015, seed: int = 11) -> tuple[Weights, int]:
    """(weights moved by blocks of windows of classes, number of windows); -1 marks places behind a text's end, which don't count.

    Each window is in one step of each pass over its block. ``windows`` is about how many there will be.
    """
    w = start or Weights.fresh(pairs.shape[1], seed)
    groups, names = grouped(pairs), list(Weights.__dataclass_fields__)
    # All weights are one array, and those of ``w`` parts of it.
    flat = np.concatenate([getattr(w, n).ravel() for n in names])
    cuts = np.cumsum([0, *(getattr(w, n).size for n in names)])
    w = Weights(**{n: flat[a:b].reshape(getattr(w, n).shape) for n, a, b in zip(names, cuts, cuts[1:], strict=False)})
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    random, step, seen = np.random.default_rng(seed), 0, 0
    total = 1 + passes * -(-windows // STEP)
    for block in blocks:
        seen += len(block)
        for order in (random.permutation(len(block)) for _ in range(passes)):
            for at in range(0, len(order), STEP):
                step += 1
                grad = _gradient(w, block[order[at : at + STEP]], pairs, groups)
                grad = np.concatenate([grad[n].ravel() for n in names])
                now = rate * max(0.05, 1 - step / total)
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad**2 - square)
                flat -= now * (mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8))
    return w, seen


def _gradient(w: Weights, part: np.ndarray, pairs: np.ndarray, groups: np.ndarray | None = None) -> dict[str, np.ndarray]:
    whole = np.maximum(part, 0).astype(np.intp)
    inputs, wanted = whole[:, :-1], whole[:, CONTEXT + 1 :].ravel()
    held = [attend(w, inputs[at : at + BATCH]) for at in range(0, len(inputs), BATCH)]
    states = np.concatenate([state for state, _ in held])
    d_states, out = _class_gradient(w, states.reshape(-1, WIDTH), inputs[:, CONTEXT:].ravel(), wanted, part[:, CONTEXT + 1 :].ravel() >= 0,
                                    pairs, grouped(pairs) if groups is None else groups)
    d_states = d_states.reshape(states.shape)
    # Queries and keys meet in one matrix, values and outputs in another.
    root = WIDTH**-0.5
    asks, tells = w.Q @ w.K.T * root, w.V @ w.O
    d_asks, d_tells = np.zeros_like(asks), np.zeros_like(tells)
    d_x = np.empty((*inputs.shape, WIDTH), states.dtype)
    for at, (_, (x, own, asked, told, a, mass, seen)) in zip(range(0, len(inputs), BATCH), held, strict=True):
        d_state, d_here = d_states[at : at + BATCH], d_x[at : at + BATCH]
        part_of = d_state / mass
        d_told = a.transpose(0, 2, 1) @ part_of
        d_s = part_of @ told.transpose(0, 2, 1)
        d_s -= np.einsum("ijk,ijk->ij", part_of, seen)[:, :, None]
        d_s *= a
        d_asked = d_s @ x
        d_asks += _product(own, d_asked)
        d_tells += _product(x, d_told)
        np.matmul(d_s.transpose(0, 2, 1), asked, out=d_here)
        d_here += _rows(d_told, tells.T)
        d_own = _rows(d_asked, asks.T)
        d_own += d_state
        d_here[:, CONTEXT:] += d_own
    out |= {"Q": d_asks @ w.K * root, "K": d_asks.T @ w.Q * root, "V": d_tells @ w.O.T, "O": w.V.T @ d_tells, "P": np.einsum("ijk->jk", d_x)}
    here = inputs.ravel()
    order = np.argsort(here.astype(np.int16), kind="stable")
    here = here[order]
    starts = np.flatnonzero(np.diff(here, prepend=-1))
    out["E"] = np.zeros_like(w.E)
    out["E"][here[starts]] = np.add.reduceat(np.take(d_x.reshape(-1, WIDTH), order, axis=0), starts)
    return out


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over all places of the products of two states' numbers."""
    return left.reshape(-1, WIDTH).T @ right.reshape(-1, WIDTH)


def _class_gradient(w: Weights, states: np.ndarray, before: np.ndarray, wanted: np.ndarray, counts: np.ndarray, pairs: np.ndarray,
                    groups: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients by the states, and by ``G`` and ``U``."""
    # The places of one group stand together.
    each = w.U.shape[1] // GROUP
    group = wanted // GROUP
    order = np.argsort(group.astype(np.uint8 if each <= 256 else np.int16), kind="stable")
    states, before, wanted, group = np.take(states, order, axis=0), before[order], wanted[order], group[order]
    place, far = np.arange(len(wanted)), _at_most(states)
    weight = (counts[order] / max(1, counts.sum())).astype(np.float32)
    p = scaled(states, w.G, far * _largest(w.G.T) > BOUND)
    p *= np.take(groups, before, axis=0)
    p *= (weight / np.einsum("ij->i", p))[:, None]
    p[place, group] -= weight
    out = {"G": states.T @ p}
    d_states = p @ w.G.T
    # Within the wanted class's group only.
    ends = np.searchsorted(group, np.arange(each + 1)).tolist()
    found = [(slice(a, b), slice(g * GROUP, (g + 1) * GROUP)) for g, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
    p = np.empty((len(states), GROUP), w.U.dtype)
    for here, columns in found:
        np.matmul(states[here], w.U[:, columns], out=p[here])
    if far * _largest(w.U.T) > BOUND:
        np.clip(p, -BOUND, BOUND, out=p)
    np.exp(p, out=p)
    p *= np.take(pairs.reshape(-1, GROUP), before * each + group, axis=0)
    p *= (weight / np.einsum("ij->i", p))[:, None]
    p[place, wanted - group * GROUP] -= weight
    out["U"] = np.zeros_like(w.U)
    back = np.empty_like(d_states)
    for here, columns in found:
        out["U"][:, columns] = states[here].T @ p[here]
        np.matmul(p[here], w.U[:, columns].T, out=back[here])
    d_states += back
    back[order] = d_states
    return back, out


# ------------------------------------------------------------------ over tables


def classes_of(often: np.ndarray, classes: int = CLASSES, single: int = SINGLE) -> np.ndarray:
    """The class of each id, by how often it occurs: the frequent ones alone, the rest in classes of about equal mass; the end has the last one."""
    size = len(often)
    seen = often + 0.01
    order = np.argsort(-seen, kind="stable")
    out = np.empty(size, np.int32)
    out[order[:single]] = np.arange(min(single, size))
    rest = order[single:]
    if len(rest):
        shared = classes - 1 - single
        mass = np.cumsum(seen[rest])
        out[rest] = single + np.minimum((mass - seen[rest]) / mass[-1] * shared, shared - 1).astype(np.int32)
    return out


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)


def _sent(kind: int, keys: np.ndarray, n: np.ndarray, ids: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        part = keys[at : at + (1 << 16)]
        z = pa.nulls(len(part), pa.binary()) if ids is None else pa.array(ids[at : at + (1 << 16)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[at : at + (1 << 16)]), z], ["kind", "key", "n", "ids"])


def spelled_rows(docs: DataFrame, path: str) -> DataFrame:
    """kind, key, n, ids: counts of words (by digest) and ids, to be summed, and the texts' ids for windows.

    A row of the latter has the 16-bit ids of ``n`` windows at most ``ROW``, and of those before their first scored one.
    Its ``key`` is a hash. The end is one more id than the vocabulary has and the start two more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = speller(path).size
        ids = np.zeros(size, np.int64)
        lead = np.full(CONTEXT + 1, size + 1, np.uint16)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            rest, piece = lead, 0  # of a text in pieces
            hashes = batch.column(1).to_numpy().view(np.uint64)
            for part in spelled(batch.column(0), path):
                held.append((part.hashes, np.bincount(part.which, minlength=len(part.hashes))))
                waiting += len(part.hashes)
                if waiting > 2 * HELD:
                    held = [_merged(held)]
                    waiting = len(held[0][0])
                    if waiting > HELD:
                        yield from _sent(WORDS, *held[0])
                        held, waiting = [], 0
                ids += np.bincount(part.ids, minlength=size)
                at, owners, pieces, counts, texts = 0, [], [], [], []
                for i, n in enumerate(part.lengths):
                    # Of a piece, whole strides go on; the rest waits for the next piece.
                    z = np.concatenate([rest, part.ids[at : at + n], [size] * part.last]).astype(np.uint16)
                    at += n
                    scored = len(z) - CONTEXT - 1
                    if not part.last:
                        scored -= scored % STRIDE
                    for a in range(0, scored, ROW * STRIDE):
                        b = min(a + ROW * STRIDE, scored)
                        owners.append(part.first + i)
                        pieces.append(piece)
                        counts.append(-(-(b - a) // STRIDE))
                        texts.append(z[a : b + CONTEXT + 1].tobytes())
                        piece += 1
                    rest, piece = (lead, 0) if part.last else (z[scored:], piece)
                if texts:
                    yield from _sent(TEXTS, mix64(hashes[owners] + np.array(pieces, np.uint64)), np.array(counts), texts)
        if held:
            yield from _sent(WORDS, *_merged(held))
        at = np.flatnonzero(ids)
        yield from _sent(IDS, at, ids[at])

    return docs.select("text", F.xxhash64("doc_id", "text")).mapInArrow(run, "kind int, key bigint, n bigint, ids binary")


def _texts_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first place of each row) of a column of 16-bit ids."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
    return ids, (offsets - offsets[0]) // 2


def _numbers(classes: np.ndarray) -> np.ndarray:
    """The class of each id, of the end and of the start."""
    return np.concatenate([classes, [CLASSES - 1, CLASSES]]).astype(np.int32)


def pairs_of(texts: DataFrame, classes: np.ndarray) -> DataFrame:
    """kind, key, n: how often each pair of classes occurs, and each id of a shared class after a class. The start is a class too."""
    k, size = CLASSES, len(classes)
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(shared.value)
        several = np.append(np.bincount(shared.value, minlength=k)[shared.value] > 1, [False, False])
        pairs = np.zeros((k + 1) * k, np.int64)
        after: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                ids, places = _texts_ids(batch.column(0).slice(first, ROWS))
                counts = np.ones(len(ids), bool)
                counts[places[:-1, None] + np.arange(CONTEXT + 1)] = False
                at = np.flatnonzero(counts)
                came, here = number[ids[at - 1]], ids[at]
                pairs += np.bincount(came * k + number[here], minlength=len(pairs))
                some = several[here]
                after.append(np.unique(came[some] * np.int64(size) + here[some], return_counts=True))
                if len(after) == 16:
                    after = [_merged(after)]
        at = np.flatnonzero(pairs)
        yield from _sent(PAIRS, at, pairs[at])
        if after:
            yield from _sent(SHARED, *_merged(after))

    made = texts.select("ids").mapInArrow(run, "kind int, key bigint, n bigint, ids binary")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def trained(texts: DataFrame, classes: np.ndarray, pairs: np.ndarray, shard: int, block: int) -> Weights:
    """Weights fitted on all windows.

    Shards of about ``shard`` windows, dealt by hash, move the same weights, each by all of its windows in ``block``s; their
    mean counts each shard by its windows. They start from the weights that windows enough for one shard gave.
    """
    spark = texts.sparkSession
    windows = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not windows:
        return Weights.fresh(CLASSES, 11)
    shards = -(-windows // shard)
    if shards == 1:
        return _moved(texts.repartition(1), classes, pairs, None, windows, block, min(PASSES, -(-LEAST * STEP // windows)))
    first = _moved(texts.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == 0).repartition(1), classes, pairs, None, shard, block, 1)
    return _moved(texts.repartition(shards, "key"), classes, pairs, first, windows // shards, block, 1)


def _moved(texts: DataFrame, classes: np.ndarray, pairs: np.ndarray, start: Weights | None, windows: int, block: int, passes: int) -> Weights:
    """The mean of the weights that each partition of ``texts`` gives."""
    shared = texts.sparkSession.sparkContext.broadcast((classes, pairs, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs, start = shared.value
        number = _numbers(classes)

        def blocks() -> Iterator[np.ndarray]:
            held, n = [], 0
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS):
                    ids, places = _texts_ids(batch.column(0).slice(first, ROWS))
                    held.append(texts_windows(np.take(number, ids), places, -1))
                    n += len(held[-1])
                    if n >= block:
                        yield np.concatenate(held)
                        held, n = [], 0
            if n:
                yield np.concatenate(held)

        w, n = train(blocks(), pairs, start, windows, passes)
        if n:
            names = list(Weights.__dataclass_fields__)
            values = [pa.array(getattr(w, name).ravel()) for name in names]
            cuts = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([n] * len(names)), pa.ListArray.from_arrays(cuts, pa.concat_arrays(values))], ["name", "n", "value"])

    made = texts.select("key", "ids").sortWithinPartitions("key").select("ids").mapInArrow(run, "name string, n bigint, value array<float>")
    each = made.select("name", "n", F.posexplode("value").alias("at", "value"))
    # A number for each weight: a model's size.
    got = each.groupBy("name", "at").agg((F.sum(F.col("value").cast("double") * F.col("n")) / F.sum("n")).alias("value")).orderBy("name", "at").toArrow()
    fresh, names, values = Weights.fresh(CLASSES, 11), got.column("name").to_numpy(), got.column("value").to_numpy()
    return Weights(**{n: values[names == n].reshape(getattr(fresh, n).shape).astype(np.float32) for n in Weights.__dataclass_fields__})


def _dense(counts: DataFrame, kind: int, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in counts.where(F.col("kind") == kind).select("key", "n").collect():  # at most ``size`` rows
        out[r.key] = r.n
    return out


def smoothed(ids: np.ndarray, pairs: np.ndarray, classes: np.ndarray, prior: float = 16.0) -> tuple[np.ndarray, np.ndarray]:
    """(log share of each id in its class, probabilities of the class after each class and after the start)."""
    k = pairs.shape[1]
    mass = np.bincount(classes, ids + 0.5, k)
    share = np.log((ids + 0.5) / mass[classes])
    alone = pairs.sum(0) + 0.5
    alone /= alone.sum()
    table = (pairs + prior * alone) / (pairs.sum(1, keepdims=True) + prior)
    return share, table.astype(np.float32)


def fit(spark: SparkSession, docs: DataFrame, learns: Column, path: str, shard: int = SHARD, block: int = BLOCK) -> tuple[Model, DataFrame]:
    """(model, counts of words and ids) over all training texts; ``shard`` and ``block`` are of windows."""
    ship(spark)
    rows = stored(spelled_rows(docs.where(learns), path), "lm-texts")
    counts = stored(rows.where(F.col("kind") != TEXTS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    often = _dense(counts, IDS, speller(path).size)
    classes = classes_of(often)
    texts = rows.where(F.col("kind") == TEXTS).select("key", "n", "ids")
    found = stored(pairs_of(texts, classes), "lm-pairs", narrow=True)
    pair_counts = _dense(found, PAIRS, (CLASSES + 1) * CLASSES).reshape(-1, CLASSES)
    share, pairs = smoothed(often, pair_counts, classes)
    # At most a number for each id after each class: bounded by the vocabulary.
    after = found.where(F.col("kind") == SHARED).select("key", "n").orderBy("key").toArrow()
    keys, n = after.column(0).to_numpy(), after.column(1).to_numpy()
    return Model(path, classes, share, pairs, grouped(pairs), pair_counts, keys, n, trained(texts, classes, pairs, shard, block)), counts


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(digests in order, counts, least count) of the words so frequent that there are at most ``most`` of them."""
    words = counts.where(F.col("kind") == WORDS)
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.s, r.w) for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("w")).collect()), reverse=True)  # under 1024 rows
    total, least = 0, 1 << 62
    for s, w in sizes:
        total += w
        if total > most:
            break
        least = s
    chosen = words.where(step >= least).select("key", "n")
    got = chosen.toArrow()  # at most ``most`` rows of two numbers
    keys, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], least


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, head: tuple[np.ndarray, np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``scored_rows`` of batches of (row, id, text)."""
    keys, n = head
    term = np.log10(n + 0.5)
    lead = np.full(CONTEXT + 1, model.start, np.int32)
    for batch in batches:
        rest, total = lead, np.zeros(4)  # of a text in pieces: classes not scored yet, sums so far
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        for part in spelled(batch.column(2), model.path):
            texts = len(part.words)
            owner = np.repeat(np.arange(texts), part.words)
            digest = part.hashes.view(np.int64)
            at = np.minimum(np.searchsorted(keys, digest), max(0, len(keys) - 1))
            hit = (keys[at] == digest) if len(keys) else np.zeros(len(digest), bool)
            plain = np.where(hit, term[at], 0.0) if len(keys) else np.zeros(len(digest))
            known = np.bincount(owner, hit[part.which], texts)
            base = np.bincount(owner, plain[part.which], texts)
            tail = ~hit[part.which]
            pair, times = np.unique(owner[tail] * len(digest) + part.which[tail], return_counts=True)
            tail_cuts = np.searchsorted(pair, np.arange(texts + 1) * len(digest))
            tail_words = digest[pair % max(1, len(digest))]
            classes = model.classes[part.ids].astype(np.int32)
            ends = np.cumsum(part.lengths)
            came = np.append(rest[-1], classes[:-1])[: len(classes)]
            if texts > 1:
                came[(ends - part.lengths)[part.lengths > 0]] = model.start
            shares = np.diff(np.append(0, np.append(0, np.cumsum(model.log_shares(came, part.ids)))[ends]))
            if texts == 1:
                # A piece of a text: whole strides are scored, the rest waits for the next piece.
                z = np.concatenate([rest, classes, [model.end] * part.last]).astype(np.int32)
                whole = len(z) if part.last else (len(z) - CONTEXT - 1) // STRIDE * STRIDE + CONTEXT + 1
                windows = class_windows(z[:whole], -1)
                logs = model.log_probabilities(np.maximum(windows, 0))
                rest = z[whole - CONTEXT - 1 :]
                total += [part.words[0], known[0], base[0], logs[windows[:, CONTEXT + 1 :] >= 0].sum() + shares[0]]
                rare.append((tail_words, times))
                if part.last:
                    yield _row_batch(batch, part.first, total[None], [np.concatenate([r for r, _ in rare])], [np.concatenate([t for _, t in rare])], names)
                    rest, total, rare = lead, np.zeros(4), []
                continue
            places = np.append(0, np.cumsum(part.lengths + CONTEXT + 2))
            z = np.full(places[-1], model.start, np.int32)
            z[places[1:] - 1] = model.end
            z[np.repeat(places[:-1] + CONTEXT + 1 - (ends - part.lengths), part.lengths) + np.arange(len(classes))] = classes
            windows = texts_windows(z, places, -1)
            of = -(-(part.lengths + 1) // STRIDE)
            logs = model.log_probabilities(np.maximum(windows, 0))
            logs[windows[:, CONTEXT + 1 :] < 0] = 0
            sums = np.bincount(np.repeat(np.arange(texts), of), logs.sum(1), texts) + shares
            cuts = list(zip(tail_cuts, tail_cuts[1:], strict=False))
            yield _row_batch(batch, part.first, np.stack([part.words, known, base, sums], 1),
                             [tail_words[a:b] for a, b in cuts], [times[a:b] for a, b in cuts], names)


def scored_rows(docs: DataFrame, model: Model, head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id, words, known, plain, rare (digests), times, score of every row.

    ``known`` words are frequent ones, ``plain`` the sum of log10(count + 0.5) over them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, head))
    schema = T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("words", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("plain", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_batches(batches, *shared.value, schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def _row_batch(batch: pa.RecordBatch, first: int, sums: np.ndarray, rare: list, times: list, names: list[str]) -> pa.RecordBatch:
    cuts = pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(np.int64))) for x in (rare, times)]
    numbers = [pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2]), pa.array(sums[:, 3] / np.log(10))]
    return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sums)), batch.column(1).slice(first, len(sums)), *numbers, *lists], names)


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 5, fold: int = 1, path: str | None = None,
                shard: int = SHARD, block: int = BLOCK, head: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    path = path or default_tokenizer()
    held_out = in_fold(F.col("doc_id"), folds, fold)
    model, counts = fit(spark, docs, ~held_out, path, shard, block)
    words = counts.where(F.col("kind") == WORDS)
    ends = docs.where(~held_out).count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    keys, often, least = frequent(counts, head)
    rows = stored(scored_rows(docs, model, (keys, often)), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    fewer = words.where(F.floor(F.log2("n") * 16) < least).select(F.col("key").alias("w_key"), "n")
    joined = rare.join(fewer, rare["key"] == fewer["w_key"])
    found = joined.groupBy(F.col("row").alias("r_row")).agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("term"))
    found = stored(found, "lm-rare")
    both = rows.join(found, rows["row"] == found["r_row"], "left")
    n_tokens = F.col("words") + 1
    known_words = F.col("known") + F.coalesce("more", F.lit(0))
    base = (
        F.col("plain") + F.coalesce("term", F.lit(0.0)) + (F.col("words") - known_words) * float(np.log10(0.5))
        + float(np.log10(ends + 0.5)) - n_tokens * float(np.log10(n + 0.5 * (v + 1)))
    )
    return both.select(
        "doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), n_tokens.alias("n_tokens"),
        (known_words + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score")
