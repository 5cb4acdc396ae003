"""Gated recurrent network with a class-factored softmax, in numpy.

Words are slots: ``inner`` words have a slot and an output row each, all others
share the slot of their class. The network gives the class of the next word,
and of an inner class the word. Texts run side by side, a window of steps at a
time; the state is carried from window to window, and gradients are cut at the
window. In training the texts of a lane follow each other.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """``bounds``: first slot of each inner class, and the end; ``outer`` classes follow."""

    bounds: tuple[int, ...]
    outer: int
    hidden: int

    @property
    def inner(self) -> int:
        return self.bounds[-1]

    @property
    def slots(self) -> int:
        return self.inner + self.outer

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.outer

    def class_of(self) -> np.ndarray:
        return np.concatenate([np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)), np.arange(len(self.bounds) - 1, self.classes)])

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"enter": (self.slots, 3 * h), "turn": (h, 3 * h), "to_class": (h, self.classes), "class_bias": (self.classes,), "to_word": (self.inner, h), "word_bias": (self.inner,)}


Weights = dict[str, np.ndarray]


def initial(shape: Shape, counts: np.ndarray, seed: int = 11) -> Weights:
    """Small random weights; biases from the counts of the slots, so that training starts at the unigram model."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(n) * 0.1).astype(np.float32) for k, n in shape.sizes().items()}
    total = np.bincount(shape.class_of(), counts + 0.5, shape.classes)
    w["class_bias"] = np.log(total / total.sum()).astype(np.float32)
    w["word_bias"] = np.log((counts[: shape.inner] + 0.5) / total[shape.class_of()[: shape.inner]]).astype(np.float32)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(v: np.ndarray, shape: Shape) -> Weights:
    out, at = {}, 0
    for k, size in sorted(shape.sizes().items()):
        n = int(np.prod(size))
        out[k] = v[at : at + n].reshape(size).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _window(w: Weights, h: np.ndarray, ids: np.ndarray, at: np.ndarray, left: np.ndarray, steps: int):
    """Run ``steps`` steps. ``at``: place of the next word of each text, ``left``: words left, descending."""
    n = h.shape[1]
    states, targets, owners = [], [], []
    for t in range(steps):
        live = int(np.searchsorted(-left, -t, "left"))
        if not live:
            break
        a = h[:live].copy()
        states.append(a)
        y = ids[at[:live] + t]
        targets.append(y)
        owners.append(np.arange(live))
        g, back = w["enter"][y], a @ w["turn"]
        gates = _sigmoid(g[:, : 2 * n] + back[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(g[:, 2 * n :] + r * back[:, 2 * n :])
        h[:live] = c + z * (a - c)
    return states, targets, owners


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row and their sums; logits are held within 60 of zero, so that no sum overflows."""
    p = np.exp(np.clip(logits, -60, 60, out=logits))
    return p, p @ np.ones(p.shape[1], p.dtype)


def _outputs(w: Weights, shape: Shape, state: np.ndarray, y: np.ndarray, learn: bool):
    """Natural log probability of each target, and the gradients if asked for."""
    class_of = shape.class_of()[y]
    order = np.argsort(class_of, kind="stable")  # words of a class are neighbours from here on
    state, y, class_of = state[order], y[order], class_of[order]
    logits = state @ w["to_class"] + w["class_bias"]
    p, total = _softmax(logits)
    rows = np.arange(len(y))
    sorted_score = logits[rows, class_of] - np.log(total)
    grads, d_sorted = None, None
    if learn:
        p *= (-1 / total)[:, None]
        p[rows, class_of] += 1
        grads = {"to_class": state.T @ p, "class_bias": p.sum(0), "to_word": np.zeros_like(w["to_word"]), "word_bias": np.zeros_like(w["word_bias"])}
        d_sorted = p @ w["to_class"].T
    cuts = np.searchsorted(class_of, np.arange(len(shape.bounds))).tolist()
    for k, (lo, hi) in enumerate(zip(shape.bounds[:-1], shape.bounds[1:])):
        here = slice(cuts[k], cuts[k + 1])
        if cuts[k + 1] > cuts[k] and hi - lo > 1:
            s = state[here]
            inner = s @ w["to_word"][lo:hi].T + w["word_bias"][lo:hi]
            p, total = _softmax(inner)
            each, target = rows[: len(s)], y[here] - lo
            sorted_score[here] += inner[each, target] - np.log(total)
            if learn:
                p *= (-1 / total)[:, None]
                p[each, target] += 1
                grads["to_word"][lo:hi] = p.T @ s
                grads["word_bias"][lo:hi] = p.sum(0)
                d_sorted[here] += p @ w["to_word"][lo:hi]
    score = np.empty_like(sorted_score)
    score[order] = sorted_score
    d_state = None
    if learn:
        d_state = np.empty_like(d_sorted)
        d_state[order] = d_sorted
    return score, grads, d_state


def score(w: Weights, shape: Shape, ids: np.ndarray, first: np.ndarray, steps: int = 32, rows: int = 32_768) -> np.ndarray:
    """Natural log probability of each text; ``first`` are the starts of the texts in ``ids``."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    at, left = first[:-1][order].copy(), size[order].copy()
    h = np.zeros((len(order), shape.hidden), np.float32)
    out = np.zeros(len(order))
    while len(left) and left[0] > 0:
        live = int(np.searchsorted(-left, 0, "left"))
        states, targets, owners = _window(w, h, ids, at, left[:live], steps)
        state, y, owner = np.concatenate(states), np.concatenate(targets), np.concatenate(owners)
        for i in range(0, len(y), rows):
            part, _, _ = _outputs(w, shape, state[i : i + rows], y[i : i + rows], False)
            out[:live] += np.bincount(owner[i : i + rows], part, live)
        at[:live] += steps
        left[:live] = np.maximum(left[:live] - steps, 0)
    result = np.zeros(len(order))
    result[order] = out
    return result


def deal(size: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts of each lane, in order: every text goes to the lane with the fewest words, texts longer than a lane's share first."""
    lanes = max(min(lanes, len(size)), 1)
    long = size > size.sum() / lanes
    heap, out = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in [*np.flatnonzero(long).tolist(), *np.flatnonzero(~long).tolist()]:
        load, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (load + int(size[i]), k))
    return out


class Trainer:
    """Adam over truncated windows.

    Texts run one after another in ``lanes`` side by side, so that every window
    but the last ones is full. The state is carried from window to window and
    starts at zero with each text. The rate falls to zero over a pass.
    """

    def __init__(self, w: Weights, shape: Shape, rate: float, lanes: int = 64):
        self.w = {k: v.copy() for k, v in w.items()}
        self.shape, self.rate, self.lanes, self.steps_done = shape, rate, lanes, 0
        self.moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}

    def learn(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray, steps: int = 32) -> int:
        """One pass over texts; returns the number of words."""
        dealt = deal(size, self.lanes)
        load = np.array([int(size[x].sum()) for x in dealt])
        order = np.argsort(-load, kind="stable")
        load = load[order]
        words, fresh = np.zeros((load[0], len(load)), ids.dtype), np.zeros((load[0], len(load)), bool)
        for k, lane in enumerate(order.tolist()):
            at = 0
            for i in dealt[lane]:
                n = int(size[i])
                words[at : at + n, k] = ids[start[i] : start[i] + n]
                fresh[at : at + n][:1, k] = True
                at += n
        h = np.zeros((self.shape.hidden, len(load)), self.w["turn"].dtype)
        for t in range(0, load[0], steps):
            live = np.searchsorted(-load, -np.arange(t, min(t + steps, load[0])), "left")
            self._step(self.rate * (1 - t / load[0]), *_unrolled(self.w, h, words[t : t + steps], fresh[t : t + steps], live))
        return int(size.sum())

    def _step(self, rate, states, targets, fresh, trace) -> None:
        w, n = self.w, self.shape.hidden
        sizes = [len(x) for x in targets]
        ends = np.cumsum(sizes)
        y, state = np.concatenate(targets), np.concatenate([a.T for a in states])
        _, grads, d_out = _outputs(w, self.shape, state, y, True)
        through_all = np.empty((3 * n, len(y)), state.dtype)
        gates = np.empty_like(through_all)
        d = np.zeros((n, sizes[0]), state.dtype)  # gradient of the state after a step
        g, through = np.empty((3 * n, sizes[0]), state.dtype), np.empty((3 * n, sizes[0]), state.dtype)
        for t in range(len(sizes) - 1, -1, -1):
            m, here = sizes[t], slice(ends[t] - sizes[t], ends[t])
            zr, c, back = trace[t]
            a, dh, slope = states[t], d[:, :m], zr * (1 - zr)
            z = zr[:n]
            dc = g[2 * n :, :m]
            np.multiply(dh * (1 - z), 1 - c * c, out=dc)
            np.multiply(dh * (a - c), slope[:n], out=g[:n, :m])
            np.multiply(dc * back, slope[n:], out=g[n : 2 * n, :m])
            through[: 2 * n, :m] = g[: 2 * n, :m]
            np.multiply(dc, zr[n:], out=through[2 * n :, :m])
            gates[:, here], through_all[:, here] = g[:, :m], through[:, :m]
            before = dh * z + w["turn"] @ through[:, :m] + d_out[here].T
            before[:, fresh[t]] = 0
            d[:, :m] = before
        order = np.argsort(y, kind="stable")
        at = np.flatnonzero(np.diff(y[order], prepend=-1))
        enter = np.zeros_like(w["enter"])
        enter[y[order[at]]] = np.add.reduceat(gates.take(order, 1), at, axis=1).T
        grads |= {"turn": (through_all @ state).T, "enter": enter}
        self.steps_done += 1
        up, down = 1 - 0.9**self.steps_done, 1 - 0.99**self.steps_done
        for k, grad in grads.items():
            grad = np.clip(grad / len(y), -1, 1)
            m, v = self.moment[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            w[k] -= (-rate / up) * m / (np.sqrt(v / down) + 1e-6)


def _unrolled(w: Weights, h: np.ndarray, words: np.ndarray, fresh: np.ndarray, live: np.ndarray):
    """One window of all lanes, units by lanes: states before each step, the words, the lanes that start a text, and what the gradients need."""
    n = len(h)
    turned = w["turn"].T.copy()
    states, targets, starts, trace = [], [], [], []
    for t, m in enumerate(live.tolist()):
        y, start = words[t, :m], np.flatnonzero(fresh[t, :m])
        a = h[:, :m].copy()
        a[:, start] = 0
        g, back = w["enter"][y].T, turned @ a
        zr = _sigmoid(g[: 2 * n] + back[: 2 * n])
        back = back[2 * n :]
        c = np.tanh(g[2 * n :] + zr[n:] * back)
        h[:, :m] = c + zr[:n] * (a - c)
        states.append(a)
        targets.append(y)
        starts.append(start)
        trace.append((zr, c, back))
    return states, targets, starts, trace
