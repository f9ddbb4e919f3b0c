"""Log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents. The most frequent ones are the
model's vocabulary, the others share one unknown word, inside which they have
their smoothed relative frequency; so the model gives every text a probability.

The network has one gated recurrent layer. The output softmax is factored into
classes: the class first, then the word among those of its class. Training is
truncated backpropagation in numpy: each task trains a replica on its rows, in
windows between which the state is carried and the gradient is cut, and
replicas are averaged by Spark. There are a few rounds over disjoint parts
of the training documents, so each document is learnt from once. What comes to
the driver are the averaged parameters and the vocabulary, both of fixed size.

Scoring carries the state through all windows of a document. Words outside the
broadcast part of the counts (``HEAD`` words, a fixed bound) get their counts by a
join, so every count is used, however many words there are.

Defined results: a null text counts as empty, that is, as its end alone. A null id
is trained on and not held out. Repeated rows are counted and scored each. With
nothing to learn from all words are unknown. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm import lexical
from tidings.llm.store import written

END, UNKNOWN = 0, 1
#: Words whose counts every task holds.
HEAD = 262_144
#: Shares, of 16, of the training documents in each round: a common start, then longer rounds.
ROUNDS = (1, 3, 4, 8)
#: Documents learnt from together in a task, and documents scored together.
LEARNT, GROUP = 1_024, 4_096
#: Bytes of text beyond which a group takes no further document.
GROUP_BYTES = 16 << 20
#: Rows of states worked on at once, and documents whose states go on together: what a core's cache holds.
ROWS, TOGETHER = 1_024, 512
#: Rows of states whose gradients are worked out together.
BACK = 384
#: Parameters in one row when replicas are averaged.
CHUNK = 8_192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sigmoids_of_negated(x: np.ndarray) -> None:
    """In place: one over one more than the exponential; beyond the largest exponential it is 0."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _too_large(x: np.ndarray) -> np.ndarray | float:
    """What is to be taken off each row so that its exponentials fit; mostly nothing."""
    return x.max(axis=-1, keepdims=True) if x.size and not (x.max() < 50 and x.min() > -50) else 0.0


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row in the place of ``x``, up to a factor, and their sums by row."""
    shift = _too_large(x)
    if np.ndim(shift):
        x -= shift
    np.exp(x, out=x)
    return x, x.dot(np.ones(x.shape[-1], x.dtype))


def _log_share(x: np.ndarray, column: int | np.ndarray) -> np.ndarray:
    """Logarithm of one column's share of each row's exponentials."""
    shift = _too_large(x)
    if np.ndim(shift):
        x = x - shift
    return x[np.arange(len(x)), column] - np.log(np.exp(x).dot(np.ones(x.shape[-1], x.dtype)))


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on; those of two bytes are sorted by their digits."""
    return np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")


def _with_ones(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The rows asked for, a one behind each: products with weights and bias together then need no sum."""
    out = np.ones((len(which), rows.shape[1] + 1), rows.dtype)
    out[:, :-1] = rows.take(which, axis=0)
    return out


def _sums_by(keys: np.ndarray, rows: np.ndarray, many: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, the most frequent first, and the sum of each one's rows, which the last but one axis counts."""
    order = _order(keys)
    keys, rows = keys.take(order), rows.take(order, axis=-2)
    begin = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1]))[:len(keys)])
    counts = np.append(begin[1:], len(keys)) - begin
    order = np.argsort(-counts, kind="stable")
    begin, counts = begin[order], counts[order]
    # Frequent keys one by one; of all others the first rows, the second rows and so on.
    often = int(np.searchsorted(-counts, -many))
    sums = rows.take(begin, axis=-2)
    for i in range(often):
        sums[..., i, :] = np.ones(counts[i], rows.dtype) @ rows[..., begin[i]:begin[i] + counts[i], :]
    most = int(counts[often:].max(initial=0))
    for k, more in enumerate(np.searchsorted(-counts, -np.arange(1, most)), 1):
        sums[..., often:more, :] += rows.take(begin[often:more] + k, axis=-2)
    return keys[begin], sums


class Network:
    """Parameters, likelihood and gradients; words are numbers below ``classes ** 2``."""

    NAMES = ("table", "gates", "state", "candidate", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, frequency: np.ndarray, classes: int = 48, width: int = 32):
        """Starts at the relative frequencies of words, without regard to context."""
        rng, words = np.random.default_rng(7), classes * classes
        frequency = np.concatenate((frequency, np.zeros(words - len(frequency)))) + 0.5
        by_class = frequency.reshape(classes, classes)
        small = lambda *shape: rng.normal(0, width**-0.5, shape).astype(np.float32)
        self.classes, self.width = classes, width
        self.table = small(words, 3 * width) * 0.5
        self.gates = np.zeros(3 * width, np.float32)
        self.state, self.candidate = small(width, 2 * width), small(width, width)
        self.to_class = small(width, classes) * 0.1
        self.class_bias = np.log(by_class.sum(1) / by_class.sum()).astype(np.float32)
        self.to_word = np.zeros((words, width), np.float32)
        self.word_bias = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32).ravel()

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def filled(self, flat: np.ndarray) -> Network:
        """A network of this shape with other parameters."""
        out, at = object.__new__(Network), 0
        out.classes, out.width = self.classes, self.width
        for n in self.NAMES:
            shape = getattr(self, n).shape
            size = int(np.prod(shape))
            setattr(out, n, flat[at:at + size].reshape(shape).astype(np.float32))
            at += size
        return out

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step in plain form; scoring and training do the same in place."""
        w = self.width
        g = self.table[x] + self.gates
        zr = _sigmoid(g[:, :2 * w] + h @ self.state)
        z, r = zr[:, :w], zr[:, w:]
        c = np.tanh(g[:, 2 * w:] + (r * h) @ self.candidate)
        return z, r, c, h + z * (c - h)

    def _by_gate(self) -> np.ndarray:
        """What states are multiplied by for the update gate and for the reset gate, one matrix each."""
        return np.ascontiguousarray(self.state.reshape(self.width, 2, self.width).transpose(1, 0, 2))

    def _output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights with their bias, for the class and for the words of each class."""
        return (np.concatenate((self.to_class, self.class_bias[None])),
                np.concatenate((self.to_word, self.word_bias[:, None]), axis=1).reshape(self.classes, self.classes, -1))

    def log_probability(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability after the states ``h``."""
        order = _order(words // self.classes)
        to_class, to_word = self._output()
        out = np.empty(len(words))
        for low in range(0, len(words), ROWS):
            some = order[low:low + ROWS]
            states, own = _with_ones(h, some), words.take(some)
            of = own // self.classes
            logs = _log_share(states @ to_class, of)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for begin, end in zip(cuts, cuts[1:]):
                c = of[begin]
                logs[begin:end] += _log_share(states[begin:end] @ to_word[c].T, own[begin:end] - c * self.classes)
            out[some] = logs
        return out

    def likelihood(self, words: np.ndarray, first: np.ndarray, window: int = 32) -> np.ndarray:
        """Logarithm to base 10 of the probability of each sequence; sequence ``i`` is ``words[first[i]:first[i + 1]]``."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        out = np.empty(len(order))
        for low in range(0, len(order), TOGETHER):
            own = order[low:low + TOGETHER]
            with np.errstate(over="ignore"):
                out[own] = self._likelihood(words, first[:-1][own], length[own], window * TOGETHER)
        return out / np.log(10)

    def _likelihood(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
        """Natural logarithm for sequences of falling length; ``most`` states, and those of one step more, are held."""
        w, total = self.width, np.zeros(len(length))
        inputs = self.table + self.gates
        # Update and reset gate behind one another, each without gaps.
        gates, inputs, state = -np.ascontiguousarray(inputs[:, :2 * w].reshape(-1, 2, w).transpose(1, 0, 2)), inputs[:, 2 * w:].copy(), -self._by_gate()
        h, before, going = np.zeros((len(length), w), np.float32), np.full(len(length), END), len(length)
        # How many sequences are longer than ``t``, for every ``t``.
        longer = len(length) - np.cumsum(np.bincount(length, minlength=1))
        states, targets, rows, held, every = [], [], [], 0, np.arange(len(length))
        for t in range(int(length.max(initial=0))):
            if longer[t] < going:
                going = int(longer[t])
                h, before, start = h[:going], before[:going], start[:going]
            zr = gates.take(before, axis=1)
            zr += h @ state
            _sigmoids_of_negated(zr)
            z, r = zr
            r *= h
            c = inputs.take(before, axis=0)
            c += r @ self.candidate
            np.tanh(c, out=c)
            c -= h
            c *= z
            c += h
            h, before = c, words[start + t]
            states.append(h)
            targets.append(before)
            rows.append(every[:going])
            held += going
            if held >= most or t + 1 == len(longer) - 1:
                logs = self.log_probability(np.concatenate(states), np.concatenate(targets))
                total += np.bincount(np.concatenate(rows), logs, len(total))
                states, targets, rows, held = [], [], [], 0
        return total

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss over one window, the state after it, and the loss.

        ``x, y`` are steps by lanes; ``keep`` is 0 where a lane begins a document
        and its state starts anew, ``live`` is false beyond a lane's end.
        """
        w, (steps, lanes) = self.width, x.shape
        kind, whole = self.state.dtype, keep.all(axis=1)
        # By step the update gate and behind it the reset gate, each without gaps.
        table, bias, index = self.table.reshape(-1, w), np.tile(self.gates.reshape(3, w), lanes), 3 * x
        gates = table.take(np.stack((index, index + 1), axis=1), axis=0).reshape(steps, 2, -1)
        np.subtract(-bias[:2], gates, out=gates)
        c = table.take(index + 2, axis=0).reshape(steps, -1)
        c += bias[2]
        gates, c = gates.reshape(steps, 2, lanes, w), c.reshape(steps, lanes, w)
        by_gate = self._by_gate()
        state, before, outs = -by_gate, *(np.empty((steps, lanes, w), kind) for _ in range(2))
        for t in range(steps):
            hp, gate, candidate, out = before[t], gates[t], c[t], outs[t]
            if whole[t]:
                hp[:] = h
            else:
                np.multiply(h, keep[t][:, None], out=hp)
            gate += hp @ state
            _sigmoids_of_negated(gate)
            candidate += np.dot(gate[1] * hp, self.candidate)
            np.tanh(candidate, out=candidate)
            np.subtract(candidate, hp, out=out)
            out *= gate[0]
            out += hp
            h = out
        back, loss, grad = self._output_gradients(outs.reshape(-1, w), y.ravel(), np.flatnonzero(live))
        douts = back.reshape(outs.shape)
        dh, d_state, d_candidate = np.zeros((lanes, w), kind), np.zeros((2, w, w), kind), np.zeros((w, w), kind)
        to_candidate, (to_z, to_r) = np.ascontiguousarray(self.candidate.T), np.ascontiguousarray(by_gate.transpose(0, 2, 1))
        # Some steps at once, so that a cache holds them.
        parts, most = np.empty((3, steps, lanes, w), kind), max(1, BACK // max(1, lanes))
        for low in reversed(range(0, steps, most)):
            own = slice(low, low + most)
            hs, cs, zs, rs = before[own], c[own], gates[own, 0], gates[own, 1]
            reset, rest = rs * hs, 1 - zs
            # What a gradient of the state is multiplied by for each part of a step.
            by_z = cs - hs
            by_z *= zs
            by_z *= rest
            by_c = cs * cs
            np.subtract(1, by_c, out=by_c)
            by_c *= zs
            by_r = 1 - rs
            by_r *= reset
            found = parts[:, own]
            for k in reversed(range(len(hs))):
                dz, dr, dc = found[:, k]
                dh += douts[low + k]
                np.multiply(dh, by_z[k], out=dz)
                np.multiply(dh, by_c[k], out=dc)
                drh = np.dot(dc, to_candidate)
                np.multiply(drh, by_r[k], out=dr)
                dh *= rest[k]
                drh *= rs[k]
                dh += drh
                dh += np.dot(dz, to_z)
                dh += np.dot(dr, to_r)
                if not whole[low + k]:
                    dh *= keep[low + k][:, None]
            d_state += hs.reshape(-1, w).T @ found[:2].reshape(2, -1, w)
            d_candidate += np.dot(reset.reshape(-1, w).T, found[2].reshape(-1, w))
        parts = parts.reshape(3, -1, w)
        used, sums = _sums_by(x.ravel(), parts)
        grad |= {"state": d_state.transpose(1, 0, 2).reshape(w, 2 * w), "candidate": d_candidate, "gates": (np.ones(x.size, kind) @ parts).ravel(),
                 "table": (used, sums.transpose(1, 0, 2).reshape(-1, 3 * w))}
        return grad, outs[-1].copy(), loss

    def _output_gradients(self, outs: np.ndarray, words: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, float, dict]:
        """Gradients of the mean loss of the rows ``live`` by the states, the loss, and gradients of the output's parameters."""
        n, kind, size, w = max(1, len(live)), outs.dtype, self.classes, self.width
        order = live[_order(words[live] // size)]
        states, words = _with_ones(outs, order), words[order]
        of, every = words // size, np.arange(len(words))
        to_class, by_class = self._output()
        d, total = _exponentials(states @ to_class)
        total *= n
        d /= total[:, None]
        share = d[every, of]
        d[every, of] = share - kind.type(1 / n)
        loss = -np.log(share * n).sum()
        sorted_back, class_sums = d @ self.to_class.T, states.T @ d
        sums = np.zeros((size, size, w + 1), kind)
        counts = np.bincount(of, minlength=size)
        starts = np.cumsum(counts) - counts
        # Classes of about as many rows are worked on together, filled up to the largest.
        magnitude = np.frexp(counts)[1]
        for m in np.unique(magnitude[counts > 0]):
            own = np.flatnonzero(magnitude == m)
            if len(own) == 1:
                own, at = int(own[0]), slice(starts[own[0]], starts[own[0]] + counts[own[0]])
                some, slot, there = states[at], every[:counts[own]], True
            else:
                column = np.arange(counts[own].max())
                there = column < counts[own][:, None]
                place = np.where(there, starts[own][:, None] + column, 0)
                slot = np.flatnonzero(there)
                at = place.ravel()[slot]
                some, there = states.take(place, axis=0), there.ravel()
            matrix = by_class[own]
            d = some @ matrix.swapaxes(-1, -2)
            each, total = _exponentials(d.reshape(-1, size))
            total *= n
            each *= np.divide(there, total, dtype=kind)[:, None]
            word = words[at] % size
            share = each[slot, word]
            each[slot, word] = share - kind.type(1 / n)
            loss -= np.log(share * n).sum()
            sums[own] = d.swapaxes(-1, -2) @ some
            more = (d @ matrix[..., :w]).reshape(-1, w)
            sorted_back[at] += more if len(more) == len(slot) else more.take(slot, axis=0)
        back = np.zeros_like(outs)
        back[order] = sorted_back
        sums = sums.reshape(-1, w + 1)
        return back, float(loss) / n, {"to_class": class_sums[:w], "class_bias": class_sums[w], "to_word": np.ascontiguousarray(sums[:, :w]), "word_bias": sums[:, w].copy()}


class Trainer:
    """One task's replica, trained with steps scaled by past gradients (AdaGrad)."""

    def __init__(self, network: Network, rate: float = 0.08, lanes: int = 96, window: int = 24):
        self.network, self.rate, self.lanes, self.window = network, rate, lanes, window
        self.past = {n: np.full_like(getattr(network, n), 1e-6) for n in Network.NAMES}
        self.words = 0

    def _apply(self, grad: dict) -> None:
        for name, d in grad.items():
            rows = slice(None)
            if name == "table":
                rows, d = d
            size = float(np.sqrt(np.vdot(d, d)))
            if size > 1:
                d = d / size
            past, value = self.past[name], getattr(self.network, name)
            so_far, step = past[rows], d * d
            so_far += step
            if name == "table":
                past[rows] = so_far
            np.sqrt(so_far, out=step)
            np.divide(d, step, out=step)
            step *= self.rate
            value[rows] -= step

    def learn(self, words: np.ndarray, first: np.ndarray) -> None:
        """One pass over sequences, dealt to lanes of about equal length."""
        length = np.diff(first)
        ends = np.zeros(self.lanes, int)
        lanes: list[list[int]] = [[] for _ in range(self.lanes)]
        for i in np.argsort(-length, kind="stable"):
            lane = int(ends.argmin())
            lanes[lane].append(int(i))
            ends[lane] += length[i]
        # All lanes behind one another; only one window at a time is laid out.
        order = np.array([i for own in lanes for i in own], int)
        begin = np.cumsum(ends) - ends
        places = np.repeat(first[:-1][order] - (np.cumsum(length[order]) - length[order]), length[order])
        stream = words[places + np.arange(len(places))]
        fresh = np.zeros(len(stream), bool)
        fresh[np.cumsum(length[order]) - length[order]] = True
        h = np.zeros((self.lanes, self.network.width), np.float32)
        steps = int(ends.max(initial=0))
        for low in range(0, steps, self.window):
            # Lanes that have ended take no part in what is left.
            on = np.flatnonzero(ends > low)
            at = np.arange(low, min(low + self.window, steps))[:, None]
            live = at < ends[on]
            place = np.where(live, begin[on] + at, 0)
            starts = fresh[place] & live
            y = np.where(live, stream[place], END)
            x = np.where(live & ~starts, stream[place - 1], END)
            grad, h[on], _ = self.network.gradients(x, (~starts).astype(np.float32), y, live, h[on])
            self._apply(grad)
        self.words += int(length.sum())


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words with their counts, and totals over all."""

    words: list[bytes]
    counts: np.ndarray
    classes: int
    total: int       # training tokens, ends included
    distinct: int    # different training tokens, the end included
    documents: int   # training documents: the count of the end

    @property
    def known(self) -> int:
        """Words the network knows; two numbers stand for the end and the unknown."""
        return min(len(self.counts), self.classes**2 - 2)

    @property
    def rare(self) -> tuple[int, int]:
        """Count and number of the words it does not know."""
        return (self.total - self.documents - int(self.counts[:self.known].sum()),
                max(0, self.distinct - min(1, self.documents) - self.known))

    def base(self, count: np.ndarray | Column) -> np.ndarray | Column:
        """Smoothed probability of a token with this count."""
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def inside(self, count: np.ndarray | Column) -> np.ndarray | Column:
        """Smoothed probability of a word with this count, given that the network does not know it."""
        total, distinct = self.rare
        return (count + 0.5) / (total + 0.5 * (distinct + 1))

    def network(self, width: int) -> Network:
        frequency = np.concatenate(([self.documents, self.rare[0]], self.counts[:self.known]))
        return Network(frequency.astype(float), self.classes, width)


def count_words(training: DataFrame) -> DataFrame:
    """``word, n`` over all texts, counted in groups of texts before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, GROUP):
            dictionary, code = lexical.coded(*_words(group.column("text").chunk(0))[:3])
            counts = np.bincount(code, minlength=len(dictionary))
            yield pa.RecordBatch.from_arrays([_strings(dictionary), pa.array(counts, pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, documents: int, classes: int) -> Vocabulary:
    """The most frequent words, ``HEAD`` at most.

    Words are first counted by the logarithm of their frequency, a few thousand
    rows however large the corpus is, and from that follows how frequent a word
    has to be; only those words come to the driver.
    """
    rank = F.floor(F.log2("n") * 64).alias("rank")
    by_rank = sorted(((r["rank"], r["words"], r["n"]) for r in counts.groupBy(rank).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    reached = np.cumsum([words for _, words, _ in by_rank])
    enough = int(np.searchsorted(reached, HEAD, side="right"))
    top = counts.where(rank >= by_rank[enough - 1][0] if enough else F.lit(False)).select("word", "n").toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    words = top.column("word").cast(pa.large_string()).cast(pa.large_binary())
    return Vocabulary(words.to_pylist(), top.column("n").to_numpy().astype(np.int64), classes,
                      sum(n for *_, n in by_rank) + documents, sum(words for _, words, _ in by_rank) + min(1, documents), documents)


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to ``most`` rows, so that long documents delay fewer groups, and cut at ``GROUP_BYTES`` of text."""
    held, rows, size = [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            before = int(ends[at] - sizes[at])
            fits = int(np.searchsorted(ends, before + GROUP_BYTES - size, side="right")) - at
            if fits <= 0 and rows == 0:
                # A text beyond the bound is a group of its own.
                fits = 1
            if fits > 0:
                part = batch.slice(at, fits)
                held.append(part)
                rows, size, at = rows + len(part), size + int(ends[at + len(part) - 1]) - before, at + len(part)
            if at < len(batch) or rows >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(pa.binary()).cast(pa.string())


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, where words begin and end in them, and which word is each text's first."""
    data, bounds = lexical.joined(texts)
    data = lexical.LOWER[data]
    return data, *lexical.words(data, bounds)


def _numbered(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable]:
    """For all words of all texts the place among the known words or -1, where texts begin, and a function giving words themselves."""
    data, starts, ends, first = _words(texts)
    places = pc.fill_null(pc.index_in(lexical.slices(data, starts, ends), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return places, first, lambda which: lexical.slices(data, starts[which], ends[which])


def _sequences(places: np.ndarray, first: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the network with an end after each text, and where texts begin."""
    words = np.where((places >= 0) & (places < known), places + 2, UNKNOWN)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def train(training: DataFrame, vocab: Vocabulary, width: int = 32) -> Network:
    """A network trained once on every row of ``training``."""
    spark = training.sparkSession
    network = vocab.network(width)
    known = pa.array(vocab.words[:vocab.known], pa.large_binary())
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(sum(ROUNDS)))
    begin = 0
    for share in ROUNDS:
        rows = training.where((turn >= begin) & (turn < begin + share)).select("text")
        begin += share
        shared = spark.sparkContext.broadcast((network, known))

        def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, known = shared.value
            trainer = Trainer(start.filled(start.flat()))
            for group in _grouped(batches, LEARNT):
                found, first, _ = _numbered(group.column("text").chunk(0), known)
                trainer.learn(*_sequences(found, first, len(known)))
            if trainer.words:
                flat = trainer.network.flat().astype(np.float64) * trainer.words
                parts = [flat[at:at + CHUNK].tobytes() for at in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([trainer.words] * len(parts)), pa.array(parts, pa.binary())], ["chunk", "words", "sums"])

        def averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for chunk, words, part in zip(*(c.to_pylist() for c in batch.columns)):
                    held = sums.setdefault(chunk, [0, 0.0])
                    held[0] += words
                    held[1] = held[1] + np.frombuffer(part)
            for chunk, (words, values) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([words]), pa.array([(values / words).astype(np.float32).tobytes()], pa.binary())], ["chunk", "words", "sums"])

        schema = "chunk int, words long, sums binary"
        # In order of chunk and content, so that sums come out the same in every run.
        parts = rows.mapInArrow(replicas, schema).repartition("chunk").sortWithinPartitions("chunk", "words", "sums").mapInArrow(averages, schema).collect()
        if parts:
            network = network.filled(np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(parts, key=lambda r: r["chunk"])]))
        shared.unpersist()
    return network


def score(documents: DataFrame, held_out: Column, classes: int = 48, width: int = 32) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``documents``."""
    rows = documents.select("doc_id", "text", held_out.alias("held_out"))
    training = rows.where("not held_out")
    counts = written(count_words(training), "counts")
    vocab = vocabulary(counts, training.count(), classes)
    network = train(training, vocab, width)
    shared = documents.sparkSession.sparkContext.broadcast((network, replace(vocab, words=[]), pa.array(vocab.words, pa.large_binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, vocab, head = shared.value
        base = np.log10(vocab.base(vocab.counts.astype(float)))
        inside = np.log10(vocab.inside(vocab.counts.astype(float)))
        inside[:vocab.known] = 0
        end = np.log10(vocab.base(float(vocab.documents)))
        row = TaskContext.get().partitionId() << 33
        for group in _grouped(batches, GROUP):
            places, first, word = _numbered(group.column("text").chunk(0), head)
            texts, of = len(group), lexical.owners(first)
            there = places >= 0
            sums = lambda values: np.bincount(of[there], values[places[there]], texts)
            likely = network.likelihood(*_sequences(places, first, vocab.known))
            rest = np.flatnonzero(~there)
            tail = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(rest, first), pa.int32()), _strings(word(rest)))
            yield from pa.Table.from_arrays([
                pa.array(np.arange(row, row + texts)), group.column("doc_id"), group.column("held_out"),
                pa.array(np.diff(first) + 1), pa.array(np.bincount(of[there], minlength=texts) + min(1, vocab.documents)),
                pa.array(sums(base) + end), pa.array(likely + sums(inside)), tail,
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"]).to_batches()
            row += texts

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<string>"), "scored")
    n = F.coalesce("n", F.lit(0))
    # Words beyond the head have small counts, so none of them is a hot key.
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("known"), F.sum(F.log10(vocab.base(n))).alias("base"), F.sum(F.log10(vocab.inside(n))).alias("inside"))
    zero = F.lit(0)
    return scored.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("inside", zero)).alias("score"))
