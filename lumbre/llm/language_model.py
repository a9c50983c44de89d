"""A gated recurrent language model over words, trained and applied in the tasks that hold the texts.

Words are symbols: the most frequent are symbols of their own, all others fall into classes by their shape.  The output is
factored: a softmax over classes, then over the words of a class; inside a shape class words have their smoothed share of the
class's training counts, so every word has a probability.  Training walks documents in lanes, backpropagates through
windows of fixed length and carries the state from window to window; tasks start from common parameters and their results
are averaged.  Scoring carries the state through whole documents in the same way.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lumbre.llm import scan, tally

SHAPES = 24
HIDDEN, WINDOW, LANES = 32, 32, 128
#: documents scored side by side; unlike the lanes of training, they change no result
SCORED = 256
#: a vocabulary of side * side frequent words: at least 32 * 32; four times as many whenever the training text has sixteen times the
#: words (distinct words grow about as the root of all), up to 256 * 256, which bounds what is sent to tasks
LEAST_SIDE, MOST_SIDE, WORDS_AT_LEAST = 32, 256, 1 << 27


@dataclass(frozen=True)
class Layout:
    """Symbols 0 to ``head`` - 1 are frequent words, then come the shapes and the end.

    The ``side`` most frequent words are classes of their own, the others fall into ``side`` - 1 classes of ``side`` words.
    """

    side: int

    @property
    def head(self) -> int:
        return self.side * self.side

    @property
    def end(self) -> int:
        return self.head + SHAPES

    @property
    def symbols(self) -> int:
        return self.end + 1

    @property
    def classes(self) -> int:
        return 2 * self.side + SHAPES

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.head, np.where(symbols < self.side, symbols, self.side - 1 + symbols // self.side), symbols - self.head + 2 * self.side - 1)


def layout_for(words: int) -> Layout:
    side = LEAST_SIDE
    while side < MOST_SIDE and words >= WORDS_AT_LEAST * (side // LEAST_SIDE) ** 4 * 16:
        side *= 2
    return Layout(side)


def layout_of(p: dict) -> Layout:
    return Layout(p["w"].shape[1])


#: the smallest layout
SMALLEST = Layout(LEAST_SIDE)
HEAD, END, SYMBOLS = SMALLEST.head, SMALLEST.end, SMALLEST.symbols
END_KEY = np.uint64(0x5EED0E0D5EED0E0D & ~31 | 24)
ROWS_PER_BUCKET = 4000


def keyed(words: scan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words, whose last five bits are the shape, and the shapes: last character, length, characters beyond ASCII."""
    size = words.ends - words.starts
    last = words.data[words.ends - 1] if len(size) else words.data[:0]
    tail = 2 - (last == 44).view(np.int8) - 2 * (last == 46).view(np.int8)
    length = (size >= 5).view(np.int8) + (size >= 8).view(np.int8) + (size >= 11).view(np.int8)
    shapes = ((tail * 4 + length) * 2).astype(np.int64)
    wide = words.data >= 128
    places = np.flatnonzero(wide)
    if len(places) < len(size):
        shapes[np.searchsorted(words.starts, places, "right") - 1] |= 1
    elif len(size):
        wide = np.append(0, np.cumsum(wide, dtype=np.int32))
        shapes += wide[words.ends] > wide[words.starts]
    return words.hashes & ~np.uint64(31) | shapes.view(np.uint64), shapes


def _tokens(column):
    """For each chunk: (first row, rows, keys, shapes, row of each word)."""
    for words in scan.words(column, scan.NOT_SPACE, lower=True, size=TEXT):
        keys, shapes = keyed(words)
        yield words.first, words.rows, keys, shapes, words.doc


@dataclass
class Vocabulary:
    """Sorted keys of the frequent words and the symbol of each (0 is the most frequent)."""

    keys: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    layout: Layout = SMALLEST

    @functools.cached_property
    def _index(self) -> tuple[np.ndarray, int]:
        """Where the keys with each value of the first 16 bits begin, and the most that share one."""
        first = np.searchsorted(self.keys >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64))
        return first.astype(np.int32), int(np.diff(np.append(first, len(self.keys))).max())

    def symbol(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = self.layout.head + shapes
        if len(self.keys):
            first, most = self._index
            at = first[keys >> np.uint64(48)]
            for _ in range(most):
                np.minimum(at, len(self.keys) - 1, out=at)
                np.copyto(out, self.symbols[at], where=self.keys[at] == keys)
                at += 1
        return out


def start(layout: Layout = SMALLEST, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    groups, n = layout.side - 1, layout.classes
    return {"x": normal(layout.symbols, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "c": normal(HIDDEN, n), "cb": np.zeros(n, np.float32),
            "w": normal(groups, layout.side, HIDDEN), "wb": np.zeros((groups, layout.side), np.float32)}


#: words of documents that a training task holds before it learns, and the length from which a document does not wait for the others
HELD, LONG = 1 << 21, 32 * WINDOW
#: bytes of text that are cut into words at once
TEXT = 1 << 16
#: numbers of a block that is gone through several times, so that it stays near the core
BLOCK = 1 << 17


class Space:
    """Arrays that are used again from window to window, by name: a new one of some MB for each step costs more than the step."""

    def __init__(self, dtype=np.float32):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size, flat = math.prod(shape), self.held.get(name)
        if flat is None or len(flat) < size:
            flat = self.held[name] = np.empty(size, self.dtype)
        return flat[:size].reshape(shape)


def inputs(p: dict, symbols: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """What ``forward`` reads, by part (update, reset, new): the input rows of ``symbols`` and the weights of the state, both with halved gates."""
    rows, weights = _parts(p["x"][symbols]), _parts(p["u"])
    rows[:2] *= 0.5
    weights[:2] *= 0.5
    return rows, weights


def _parts(x: np.ndarray) -> np.ndarray:
    return np.array(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2), order="C")


def forward(rows: np.ndarray, weights: np.ndarray, fed: np.ndarray, fresh: np.ndarray, h: np.ndarray, space: Space, keep: bool = False):
    """States (step, lane, HIDDEN) of a window that feeds ``rows`` numbered by ``fed`` (step, lane) and goes on from ``h`` (lane, HIDDEN).

    Every part of a step is one block of lanes.  With ``keep``, also the states before each step (of lanes that start there, what they
    had before) and what the gradient is multiplied by on its way back: (step, 5, lane, HIDDEN).
    """
    steps, m = fed.shape
    states, per = space("states", steps + 1, m, HIDDEN), max(1, BLOCK // (4 * HIDDEN * m))
    factors, a, new = space("factors", steps if keep else 1, 5, m, HIDDEN), space("said", 3, m, HIDDEN), space("new", m, HIDDEN)
    left, begun, starts = space("left", m, HIDDEN), space("begun", m, HIDDEN), fresh.any(axis=1)
    states[0] = h
    for t in range(steps):
        if t % per == 0:
            part = fed[t:t + per]
            given = np.take(rows, part.ravel(), axis=1, out=space("given", 3, part.size, HIDDEN), mode="clip").reshape(3, len(part), m, HIDDEN)
        x, h, after, factor = given[:, t % per], states[t], states[t + 1], factors[t if keep else 0]
        if starts[t]:
            np.copyto(begun, h)
            begun[fresh[t]] = 0
            h = begun
        gates, (update, reset, at_reset, at_new, at_update) = factor[:2], factor
        np.matmul(h, weights, out=a)
        np.add(a[:2], x[:2], out=gates)
        np.tanh(gates, out=gates)  # 1 / (1 + exp(-v)) is (1 + tanh(v / 2)) / 2
        gates *= 0.5
        gates += 0.5
        np.multiply(reset, a[2], out=new)
        new += x[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= update
        if keep:
            np.subtract(1, update, out=left)
            np.multiply(after, left, out=at_update)
            np.multiply(new, new, out=at_new)
            np.subtract(1, at_new, out=at_new)
            at_new *= left
            np.subtract(1, reset, out=at_reset)
            at_reset *= reset
            at_reset *= a[2]
        after += new
    return (states[1:], (states[:-1], factors)) if keep else states[1:]


def step(p: dict, symbol: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of each row of ``h`` (lane, HIDDEN)."""
    states, kept = forward(*inputs(p), symbol[None], np.zeros((1, len(symbol)), bool), h, Space(p["u"].dtype), keep=True)
    return states[0], kept


def said(p: dict, states: np.ndarray, target: np.ndarray, space: Space, alive: np.ndarray | None = None, grad: dict | None = None):
    """Natural log probability of each target symbol (step, lane); a shape class is one symbol here.

    With ``grad``, also the gradient by the states, of targets that are ``alive``; of the words' weights, ``grad`` has the ``groups`` met.
    """
    lay, c, cb, dtype = layout_of(p), p["c"], p["cb"], states.dtype
    n, side, places = lay.classes, lay.side, target.size
    h, goal, alive = states.reshape(places, HIDDEN), target.ravel(), None if alive is None else alive.ravel()
    logs, kind, per = np.empty(places), lay.class_of(goal), max(1, BLOCK // n)
    # a bias multiplies what exp returns
    bounded = _bounded(np.vstack([c, cb]).T)
    bias = np.exp(cb) if bounded else np.ones_like(cb)
    if grad is not None:
        gc, gcb, back, turned = np.zeros_like(c.T), np.zeros_like(cb), space("back", places, HIDDEN), np.array((c * bias).T, order="C")
    for a in range(0, places, per):
        b = min(a + per, places)
        e, of = np.matmul(h[a:b], c, out=space("classes", b - a, n)), kind[a:b]
        if not bounded:
            e += cb
            e -= e.max(axis=1, keepdims=True)
        place, flat = np.arange(0, e.size, n) + of, e.reshape(-1)
        logs[a:b] = flat[place]
        if bounded:
            logs[a:b] += cb[of]
        total = np.exp(e, out=e) @ bias
        logs[a:b] -= np.log(total)
        if grad is not None:
            # shares are never made: what they are multiplied with has fewer columns to be divided by the total
            flat[place] -= total / bias[of]
            share = np.reciprocal(total, out=total)
            if alive is not None:
                share *= alive[a:b]
            gc += e.T @ np.multiply(h[a:b], share[:, None], out=space("scaled", b - a, HIDDEN))
            gcb += share @ e
            np.matmul(e, turned, out=back[a:b])
            back[a:b] *= share[:, None]
    inner = (goal >= side) & (goal < lay.head)
    inner = np.flatnonzero(inner if alive is None else inner & alive)
    group = goal[inner] // side - 1
    order, first = _runs(group, len(p["w"]))
    inner, group = inner[order], group[order]
    groups, word, rows = group[first], goal[inner] % side, np.arange(len(inner))
    # the last column of a state is one, of the words' weights their biases
    own, d = space("own", len(inner), HIDDEN + 1), space("inner", len(inner), side)
    own[:, :HIDDEN], own[:, HIDDEN] = h[inner], 1
    w = np.concatenate([p["w"][groups], p["wb"][groups][..., None]], axis=2)
    parts = list(zip(first.tolist(), np.append(first[1:], len(group)).tolist()))
    for k, (a, b) in enumerate(parts):
        np.matmul(own[a:b], w[k].T, out=d[a:b])
    if not _bounded(w):
        d -= d.max(axis=1, keepdims=True)
    more = d[rows, word].astype(np.float64)
    total = np.exp(d, out=d) @ np.ones(side, dtype)
    logs[inner] += more - np.log(total)
    if grad is None:
        return logs.reshape(target.shape)
    d *= np.reciprocal(total)[:, None]
    d[rows, word] -= 1
    gw, moved = np.empty((len(parts), side, HIDDEN + 1), dtype), space("moved", len(inner), HIDDEN)
    for k, (a, b) in enumerate(parts):
        np.matmul(d[a:b].T, own[a:b], out=gw[k])
        np.matmul(d[a:b], w[k, :, :HIDDEN], out=moved[a:b])
    back[inner] += moved
    grad["c"], grad["cb"], grad["groups"], grad["w"], grad["wb"] = gc.T * bias, gcb * bias, groups, gw[..., :HIDDEN], gw[..., HIDDEN]
    return logs.reshape(target.shape), back.reshape(states.shape)


def _bounded(weights: np.ndarray) -> bool:
    """Whether exp stays well in range: states lie in -1 to 1, so the sum of a word's weights bounds what it gets."""
    return float(np.abs(weights).sum(axis=-1).max(initial=0)) < 60


def _runs(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts whole numbers and where each different one begins in it."""
    order = np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")
    values = values[order]
    return order, np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def outputs(p: dict, h: np.ndarray, target: np.ndarray, grad: dict | None = None):
    """``said`` of one step, for the rows of ``h`` (lane, HIDDEN)."""
    got = said(p, np.ascontiguousarray(h)[None], target[None], Space(np.result_type(h, p["c"])), grad=grad)
    return got[0] if grad is None else (got[0][0], got[1][0])


class Walk:
    """Documents side by side: a lane takes the next document when its own has ended, and its state begins anew there.

    Memory is that of the documents and of one window of all lanes, however long a document is.
    """

    def __init__(self, lanes: int, end: int):
        self.lanes, self.end = lanes, end
        self.h = np.zeros((lanes, HIDDEN), np.float32)
        self.waiting: deque = deque()
        #: the documents one after the other, from place 2 on; each lane's next input and its document's last word; documents not begun
        self.text, self.at, self.last, self.next = np.full(2, end, np.int32), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), deque()

    def add(self, symbols: np.ndarray) -> None:
        """One document; the input of its first word is an end."""
        self.waiting.append(np.append(np.int32(self.end), symbols.astype(np.int32)))

    def add_all(self, docs: list[np.ndarray]) -> None:
        """Long documents begin first, so that none of them is left alone when the others have ended; the rest keep their order."""
        for doc in sorted(docs, key=lambda d: -len(d) if len(d) > LONG else -LONG):
            self.add(doc)

    def running(self) -> bool:
        return bool((self.last > self.at).any())

    def _lay(self) -> None:
        """Documents that were added come behind what is left of the others."""
        left = [(int(a), int(b)) for a, b in zip(self.at, self.last)] + list(self.next)
        pieces = [self.text[a:b + 1] if b > a else self.text[:0] for a, b in left] + list(self.waiting)
        sizes = np.array([len(piece) for piece in pieces])
        starts = 2 + np.cumsum(sizes) - sizes
        self.text = np.concatenate([self.text[:2], *pieces])
        self.at = np.where(sizes > 0, starts, 0)[:self.lanes]
        self.last = np.where(sizes > 0, starts + sizes - 1, 0)[:self.lanes]
        self.next = deque((a, a + n - 1) for a, n in zip(starts[self.lanes:].tolist(), sizes[self.lanes:].tolist()))
        self.waiting.clear()

    def dealt(self, width: int):
        """For the lanes with words, (step, lane): input, target, whether there is a word, whether a document starts."""
        if self.waiting:
            self._lay()
        places, fresh = self.at[:, None] + np.arange(width), np.zeros((self.lanes, width), bool)
        filled = np.minimum(self.last - self.at, width)
        self.at += filled
        for k in np.flatnonzero(filled < width):
            done = int(filled[k])
            while done < width and self.next:
                at, last = self.next.popleft()
                n = min(width - done, last - at)
                places[k, done:done + n] = np.arange(at, at + n)
                fresh[k, done] = True
                self.at[k], self.last[k], done = at + n, last, done + n
            places[k, done:], filled[k] = 0, done
        used, steps, alive = np.flatnonzero(filled), int(filled.max()), np.arange(width) < filled[:, None]
        places = places[used, :steps].T
        return used, self.text[places], self.text[places + 1], *(np.ascontiguousarray(x[used, :steps].T) for x in (alive, fresh))


def log_probabilities(p: dict, symbols: np.ndarray, sizes: np.ndarray, lanes: int = SCORED, window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each symbol of whole documents given all before it."""
    out, space, (rows, weights) = np.empty(len(symbols), np.float32), Space(), inputs(p)
    first, loads, docs = np.cumsum(sizes) - sizes, [(0, k) for k in range(min(lanes, max(1, len(sizes))))], [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable"):  # long ones first, so that lanes end together
        load, k = heapq.heappop(loads)
        docs[k].append(d)
        heapq.heappush(loads, (load + int(sizes[d]), k))
    # lanes with much left come first, so those with a word at a step are the first ones; each is a run of places of words
    loads = sorted((-load, k) for load, k in loads if load)
    ends = np.array([-load for load, _ in loads], np.int64)
    starts, dealt = np.cumsum(ends) - ends, np.array([d for _, k in loads for d in docs[k]], np.int64)
    place = np.repeat(first[dealt] - np.cumsum(sizes[dealt]) + sizes[dealt], sizes[dealt]) + np.arange(len(symbols))
    fed, fresh = np.append(np.int32(layout_of(p).end), symbols[:-1].astype(np.int32)), np.zeros(len(symbols), bool)
    fresh[first[sizes > 0]] = True
    fed[fresh] = layout_of(p).end
    h = np.zeros((len(ends), HIDDEN), np.float32)
    for t in range(0, int(ends.max(initial=0)), window):
        m, steps = int(np.searchsorted(-ends, -t)), t + np.arange(min(window, int(ends[0]) - t))[:, None]
        alive = steps < ends[:m]
        at = place[np.where(alive, starts[:m] + steps, starts[:m])]
        states = forward(rows, weights, fed[at], fresh[at] & alive, h[:m], space)
        h = states[-1].copy()
        logs = said(p, states, symbols[at], space)
        out[at[alive]] = logs[alive]
    return out


class Trainer(Walk):
    """Truncated backpropagation over whole documents in lanes; ``p`` and the optimiser's ``memory`` change in place.

    Lanes carry their state from window to window, also from one call of ``learn`` to the next.  A step counts by its words, so the
    few lanes that are left at the end weigh no more than others.
    """

    def __init__(self, p: dict, memory: dict, lanes: int = LANES):
        super().__init__(lanes, layout_of(p).end)
        self.p, self.memory, self.words, self.space = p, memory, 0, Space()

    def learn(self, rate, finish: bool = False) -> None:
        """Steps at ``rate(words before)`` while documents wait; with ``finish``, until all have ended."""
        while self.waiting or self.next or (finish and self.running()):
            self._window(rate(self.words))

    def _window(self, rate: float) -> None:
        p, space, (used, fed, target, alive, fresh) = self.p, self.space, self.dealt(WINDOW)
        steps, m = fed.shape
        # the window's different symbols, and the places of each one after the other; those that are met equally often stand side by side
        fed = fed.ravel()
        order, first = _runs(fed, len(p["x"]))
        times = np.diff(np.append(first, len(fed)))
        by = np.argsort(times, kind="stable")
        symbols, number, at = fed[order[first[by]]], np.empty(len(first), np.int64), np.empty(len(fed), np.int64)
        number[by] = np.arange(len(by))
        at[order], times = np.repeat(number, times), times[by]
        order = _runs(at, len(by))[0]
        states, (before, factors) = forward(*inputs(p, symbols), at.reshape(steps, m), fresh, self.h[used], space, keep=True)
        self.h[used] = states[-1]
        words, starts, grad = int(alive.sum()), fresh.any(axis=1), {}
        _, back = said(p, states, target, space, None if words == alive.size else alive, grad)
        before[fresh] = 0
        dh, through, per = np.zeros((m, HIDDEN), np.float32), space("through", 3, m, HIDDEN), max(1, BLOCK // (8 * HIDDEN * m))
        turned, gu = np.array(_parts(p["u"])[[0, 2, 1]].transpose(0, 2, 1), order="C"), np.zeros((3, HIDDEN, HIDDEN), np.float32)
        dx, gx = space("dx", steps, m, 3, HIDDEN), np.empty((len(symbols), 3 * HIDDEN), np.float32)
        for b in range(steps, 0, -per):
            a = max(0, b - per)
            # gradients by what enters some steps: the new part, then the parts of the state's product, update, new and reset
            entered = space("entered", 4, b - a, m, HIDDEN)
            for t in range(b - 1, a - 1, -1):
                dh += back[t]
                d, factor = entered[:, t - a], factors[t]
                np.multiply(dh, factor[3:], out=d[:2])
                np.multiply(d[0], factor[1:3], out=d[2:])
                np.matmul(d[1:], turned, out=through)
                dh *= factor[0]
                for part in through:
                    dh += part
                if starts[t]:
                    dh[fresh[t]] = 0
            gu += np.matmul(before[a:b].reshape(-1, HIDDEN).T, entered[1:].reshape(3, -1, HIDDEN))
            for part, k in enumerate((1, 3, 0)):
                dx[a:b, :, part] = entered[k]
        dx, done = np.take(dx.reshape(-1, 3 * HIDDEN), order, axis=0, out=space("ordered", steps * m, 3 * HIDDEN), mode="clip"), 0
        cuts = np.append(np.flatnonzero(np.append(True, times[1:] != times[:-1])), len(times)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            often = int(times[a])
            np.add.reduce(dx[done:done + (b - a) * often].reshape(b - a, often, -1), axis=1, out=gx[a:b])
            done += (b - a) * often
        grad["x"], grad["u"] = gx, np.concatenate([gu[0], gu[2], gu[1]], axis=1)
        rate *= words / (self.lanes * WINDOW)
        groups = grad.pop("groups")
        groups = None if len(groups) == len(p["w"]) else groups
        at = {"x": symbols, "w": groups, "wb": groups}
        self.memory["windows"] = self.memory.get("windows", 0) + 1
        for k, g in grad.items():
            self._move(k, g * np.float32(100 / words), rate, at.get(k))
        self.words += words

    def _move(self, k: str, g: np.ndarray, rate: float, rows: np.ndarray | None) -> None:
        """The root mean square of a parameter's gradients scales its steps.

        With ``rows``, the gradient of all other rows is zero: they do not move, and what is remembered of them fades when they are met again.
        """
        p, now = self.p[k], self.memory["windows"]
        np.clip(g, -5, 5, out=g)
        if k not in self.memory:
            self.memory[k], self.memory[k + " last"] = np.zeros_like(p), np.zeros(len(p), np.int64)
        seen, last, at = self.memory[k], self.memory[k + " last"], slice(None) if rows is None else rows
        old = seen[at]
        old *= (0.95 ** (now - last[at])).astype(np.float32).reshape(-1, *[1] * (p.ndim - 1))
        last[at] = now
        step = np.multiply(g, g, out=self.space("step", *g.shape))
        step *= 0.05
        old += step
        if rows is not None:
            seen[at] = old
        np.sqrt(old, out=step)
        step += 1e-2
        np.divide(g, step, out=step)
        step *= rate
        p[at] -= step


def train(p: dict, symbols: np.ndarray, sizes: np.ndarray, memory: dict, rate: float, lanes: int = LANES) -> None:
    """One pass over documents, each with its own end as last symbol."""
    trainer = Trainer(p, memory, min(lanes, max(1, len(sizes))))
    for part in np.split(symbols, np.cumsum(sizes)[:-1]):
        trainer.add(part)
    trainer.learn(lambda _: rate, finish=True)


def _order(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit keys: their first bits are sorted with their places behind them, which is faster than to sort places."""
    place = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~place | np.arange(len(keys), dtype=np.uint64)) & place).astype(np.int64)
    ordered = keys[order]
    return np.argsort(keys) if (ordered[1:] < ordered[:-1]).any() else order  # different keys with the same first bits


def _packed(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def _unpacked(blob: bytes, layout: Layout) -> dict:
    p, at, values = start(layout), 0, np.frombuffer(blob, np.float32)
    for k in sorted(p):
        p[k] = values[at:at + p[k].size].reshape(p[k].shape).copy()
        at += p[k].size
    return p


def vocabulary(docs: DataFrame, text: str, flush: int = 1 << 21) -> Vocabulary:
    """The most frequent words of the documents by exact counts; how many grows with the number of words.

    A task adds up its words and sends each different one once, or once for every ``flush`` different ones.
    """
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys)
            keys, counts = keys[order], np.concatenate([n for _, n in parts])[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def sent(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        words: list[np.ndarray] = []
        for batch in batches:
            for _, rows, found, _, _ in _tokens(batch.column(0)):
                words += [found, np.full(rows, END_KEY)]
                if sum(map(len, words)) < min(flush, 1 << 20):  # to sort many words once is cheaper than to merge counts
                    continue
                held.append(tally.unique(np.concatenate(words)))
                words = []
                while len(held) > 1 and len(held[-2][0]) < 2 * len(held[-1][0]):  # parts of like size, so each count is merged few times
                    held[-2:] = [merged(held[-2:])]
                if len(held[0][0]) > flush:
                    yield sent(*held.pop(0))
        if words:
            held.append(tally.unique(np.concatenate(words)))
        if held:
            yield sent(*merged(held))

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "key long, n long")
    totals = rows.groupBy("key").agg(F.sum("n").alias("n"))
    from lumbre.session import cut_lineage
    totals = cut_lineage(totals, "words")
    layout = layout_for(totals.agg(F.sum("n")).first()[0] or 0)
    top = totals.where(F.col("key") != int(END_KEY.astype(np.int64))).orderBy(F.desc("n"), "key").limit(layout.head).toPandas()
    keys, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], order.astype(np.int64), counts[order], layout)


def fit(docs: DataFrame, key: str, text: str, rounds: int = 2) -> tuple[Vocabulary, dict]:
    """Vocabulary and parameters learnt from all words of all rows of ``docs``, in one pass.

    Each row belongs to one of ``rounds`` by its key; a round starts from the parameters of the one before, averaged over the tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(key, text).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    known = vocabulary(rows, "t")
    p = start(known.layout)
    for n in range(rounds):
        shared = spark.sparkContext.broadcast((known, _packed(p)))

        def run(batches, n=n, shared=shared):
            from pyspark import TaskContext
            words, blob = shared.value
            own = _unpacked(blob, words.layout)
            trainer = Trainer(own, {})
            rate = lambda seen: 0.02 / (1 + n) / (1 + seen / 2e6)
            held, size = [], 0
            for batch in batches:
                for _, count, keys, shapes, doc in _tokens(batch.column(0)):
                    symbols = words.symbol(keys, shapes).astype(np.int32)
                    edges = np.searchsorted(doc, np.arange(count + 1))
                    held += [np.append(symbols[a:b], np.int32(words.layout.end)) for a, b in zip(edges[:-1], edges[1:])]
                    size += len(symbols) + count
                    if size >= HELD:
                        trainer.add_all(held)
                        trainer.learn(rate)
                        held, size = [], 0
            trainer.add_all(held)
            trainer.learn(rate, finish=True)
            scan.release()
            if trainer.words:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(trainer.words)]), pa.array([_packed(own)], pa.binary())], names=["id", "weight", "p"])

        parts = rows.where(F.pmod("k", F.lit(rounds)) == n).select("t").mapInArrow(run, "id long, weight double, p binary")
        p = _averaged(parts, known.layout) or p
    return known, p


def _averaged(parts: DataFrame, layout: Layout, fan_in: int = 16) -> dict | None:
    """Weighted mean of parameters, in a tree so that no task or driver holds many."""
    from lumbre.session import cut_lineage
    schema = pa.schema([("id", pa.int64()), ("weight", pa.float64()), ("p", pa.binary())])

    def mean(table: pa.Table) -> pa.Table:
        weights = np.array(table.column("weight").to_pylist())
        total = sum(w * np.frombuffer(b, np.float32).astype(np.float64) for w, b in zip(weights, table.column("p").to_pylist()))
        return pa.table([[table.column("id")[0].as_py() // fan_in], [float(weights.sum())], [(total / weights.sum()).astype(np.float32).tobytes()]], schema=schema)

    parts = cut_lineage(parts, "parameters")
    while parts.select("id").limit(2).count() > 1:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("id") / fan_in)).applyInArrow(mean, "id long, weight double, p binary"), "parameters")
    row = parts.first()
    return _unpacked(bytes(row["p"]), layout) if row else None


def score(docs: DataFrame, train_on, key: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET, **options) -> DataFrame:
    """For each row ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``train_on`` is a condition on ``docs``: rows where it is true are learnt from, the others (null too) are held out.  Texts are
    lower-cased (A-Z); tokens are runs of characters other than space and tab to carriage return, then one end.  ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)) with c the token's training count, N all and V the distinct training tokens; ``score`` is the log10
    probability of the text under the recurrent model.  A null or empty text is the end alone; equal texts have equal base scores.
    Tasks learn from the rows they read and are averaged, so the same rows dealt out otherwise give other (not better or worse) scores.
    """
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    known, p = fit(d.where("train"), "key", "text", **options)
    d, n = tally.bucketed(d, "key", "text", rows_per_bucket)
    d = d.select("bucket", "key", "text", "train")
    shared = docs.sparkSession.sparkContext.broadcast((known, _packed(p)))
    ranges = max(64, n // 2)

    def counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The different keys and the training count of each: those of all rows and those learnt from are sorted apart, which needs no order of rows."""
        learn = np.array(table.column("train").to_pylist(), bool)
        parts, used = [np.full(len(learn), END_KEY)], [np.full(learn.sum(), END_KEY)]
        for first, _, keys, _, doc in _tokens(table.column("text")):
            parts.append(keys)
            used.append(keys[learn[first + doc]])
        unique, (learnt, n) = tally.unique(np.concatenate(parts))[0], tally.unique(np.concatenate(used))
        counts = np.zeros(len(unique), np.int64)
        counts[np.searchsorted(unique, learnt)] = n
        return unique, counts

    notes = tally.add_up(tally.send(d, counted, ranges), shapes=32)
    stats = notes.where(F.length("keys") > 0).select(F.explode(tally.statistics("keys")).alias("s")).groupBy(F.col("s.shape").alias("shape")).agg(F.sum("s.n").alias("n"), F.sum("s.v").alias("v"))
    stats = stats.agg(F.collect_list(F.struct("shape", "n", "v")).alias("stats"))
    notes = notes.select("bucket", "range", "counts").crossJoin(F.broadcast(stats))  # one row of at most 32 shapes
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("held_out", BooleanType()), *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                         StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        words, blob = shared.value
        net, lay = _unpacked(blob, words.layout), words.layout
        totals, _ = tally.received(right)
        seen = {s["shape"]: (s["n"], s["v"]) for s in right.column("stats")[0].as_py()}
        all_n, all_v = sum(n for n, _ in seen.values()), sum(v for _, v in seen.values())
        head = words.keys & np.uint64(31)
        # what a shape class holds beside the frequent words: counts, different words and one for the unseen
        mass = np.array([max(1.0, seen.get(s, (0, 0))[0] - int(words.counts[head == s].sum()) + seen.get(s, (0, 0))[1] - int((head == s).sum()) + 1) for s in range(SHAPES)])
        all_sizes, all_keys, all_symbols = [], [], []
        for _, rows, keys, shapes, doc in _tokens(left.column("text")):
            # each text's words, then its end
            sizes = np.bincount(doc, minlength=rows) + 1
            inside = np.ones(sizes.sum(), bool)
            inside[np.cumsum(sizes) - 1] = False
            said_keys, symbols = np.full(len(inside), END_KEY), np.full(len(inside), lay.end, np.int32)
            said_keys[inside], symbols[inside] = keys, words.symbol(keys, shapes)
            all_sizes.append(sizes)
            all_keys.append(said_keys)
            all_symbols.append(symbols)
        # all documents of the bucket side by side, so that a long one does not run alone
        sizes, keys, symbols = np.concatenate(all_sizes), np.concatenate(all_keys), np.concatenate(all_symbols)
        # the totals are in the order of the different keys
        order, c = _order(keys), np.empty(len(keys), np.int64)
        keys = keys[order]
        c[order] = totals.astype(np.int64)[np.cumsum(np.append(False, keys[1:] != keys[:-1]))]
        logs = log_probabilities(net, symbols, sizes) / np.log(10)
        rare = (symbols >= lay.head) & (symbols < lay.end)
        logs[rare] += np.log10((c[rare] + 1) / mass[symbols[rare] - lay.head])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda weights: np.bincount(owner, weights=weights, minlength=len(sizes))
        held = [not t for t in left.column("train").to_pylist()]
        return pa.Table.from_arrays([left.column("key"), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sums(c > 0).astype(np.int64), pa.int64()),
                                     pa.array(np.full(len(held), all_n), pa.int64()), pa.array(sums(np.log10((c + 1) / (all_n + all_v + 1)))), pa.array(sums(logs))], schema=arrow)

    out = d.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(finish, schema)
    return out.withColumnRenamed("key", key)
