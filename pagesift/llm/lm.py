"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried across
windows, so a text's log-likelihood covers the whole document.

The vocabulary of the softmax is the ``CLASSES`` x ``CLASS_SIZE`` most frequent tokens, in classes of equal size by
frequency; one more class stands for all rarer tokens, which it shares out by add-one counts over the whole training
corpus.  So the model gives every text a proper probability: P(class | state) * P(token | class, state), or
P(rare | state) * (c + 1) / (n + v + 1).
"""

from __future__ import annotations

import heapq
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, stage, text_of
from .toxicity import id_remainder

CLASSES, CLASS_SIZE = 48, 48
EMBED, HIDDEN = 12, 16
WINDOW = 32
#: Training rounds; each takes the training documents of one slice of the id hashes, in parallel, and averages.  As many
#: rounds as slices: every training document is learnt from once.
ROUNDS = SLICES = 2
#: Most frequent tokens whose counts go to every worker (a bound on the broadcast); rarer ones are joined.
HEAD = 100_000
#: Documents advance side by side in so many lanes.
LANES, TRAIN_LANES = 512, 192
#: Tokens that a task holds before it scores them.
_GROUP = 3_000_000
END = b"\n"  # cannot be a word
_WHITE = b" \t\n\r\x0b\x0c"
_LOWER = bytes(32 if c in _WHITE else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that are cut into words together (a longer text stays whole).
_CUT = 1 << 22
#: Bytes of counted tokens that a task merges; what fills half of it after that is passed on.
_HELD = 1 << 24


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end of each text: (the distinct tokens, END last; their
    numbers, text after text; where each text ends)."""
    joined = b" ".join(texts).translate(_LOWER)
    edge = np.zeros(len(joined) + 2, bool)
    np.not_equal(np.frombuffer(joined, np.uint8), 32, out=edge[1:-1])
    turn = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = turn[0::2], turn[1::2]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    solid = joined.translate(None, b" ")
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
    text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    ends = np.searchsorted(start, text_end) + np.arange(1, len(texts) + 1)
    numbers = np.empty(len(start) + len(texts), np.int32)
    inner = np.ones(len(numbers), bool)
    inner[ends - 1] = False
    numbers[inner] = coded.indices.to_numpy()
    numbers[ends - 1] = len(words) - 1
    return words, numbers, ends


def _cuts(texts: list[bytes]):
    """Runs of texts of about ``_CUT`` bytes."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > _CUT:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


# ---- counts --------------------------------------------------------------------------------------------------

def _count(batches):
    seen, counts, held = [], [], 0

    def merge():
        """Counts of the distinct tokens so far; returns their bytes."""
        coded = pa.chunked_array(seen, pa.binary()).combine_chunks().dictionary_encode()
        seen[:] = [coded.dictionary]
        counts[:] = [np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)]
        return coded.dictionary.nbytes

    def rows():
        return pa.RecordBatch.from_arrays([seen[0], pa.array(counts[0])], names=["token", "c"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            for run in _cuts(batch.column(0).slice(lo, 2048).cast(pa.binary()).to_pylist()):
                words, numbers, _ = tokens(run)
                seen.append(words)
                counts.append(np.bincount(numbers, minlength=len(words)))
                held += words.nbytes
                if held > _HELD:
                    held = merge()
                    if held > _HELD // 2:
                        yield rows()
                        seen, counts, held = [], [], 0
    if seen:
        merge()
        yield rows()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (token, c) over all documents; counted within tasks first."""
    part = docs.select(text_of(text_col).alias("t")).mapInArrow(_count, "token binary, c long")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


# ---- the network ---------------------------------------------------------------------------------------------

def _softmax(logits: np.ndarray, k: np.ndarray, cols: np.ndarray, bound: float):
    """(log probability of row k of each column, exponentials in place of the logits, their sums); logits of at most 60
    in size, which ``bound`` tells, need no shift."""
    if not bound < 60:
        logits -= logits.max(0)
    own = logits[k, cols]
    e = np.exp(logits, out=logits)
    total = e.sum(0)
    return own - np.log(total), e, total


class Network:
    """GRU over token embeddings with a class softmax (CLASSES + 1) and a softmax within each class."""

    def __init__(self, counts: list[int], rare: int, seed: int = 3):
        """``counts``: of the vocabulary, by falling frequency; ``rare``: tokens outside it.  The softmax starts as the
        corpus's unigram model."""
        rng = np.random.default_rng(seed)
        self.size = len(counts)
        self.classes = -(-self.size // CLASS_SIZE)
        n = np.zeros(self.classes * CLASS_SIZE)
        n[: self.size] = counts
        n = n.reshape(-1, CLASS_SIZE)
        by_class = np.append(n.sum(1), rare) + 1.0
        inner = np.where(n > 0, np.log((n + 1e-9) / np.maximum(n.sum(1, keepdims=True), 1)), -30.0)
        f = np.float32
        self.p = {
            "emb": rng.normal(0, 0.3, (self.size + 2, EMBED)).astype(f),  # tokens, rare, start
            "wx": rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 3 * HIDDEN)).astype(f), "wh": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(f),
            "b": np.zeros(3 * HIDDEN, f), "cw": np.zeros((HIDDEN, self.classes + 1), f), "cb": np.log(by_class / by_class.sum()).astype(f),
            "ow": np.zeros((self.classes, HIDDEN, CLASS_SIZE), f), "ob": inner.astype(f),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        """Takes the parameters from ``flat``, as views of it if it is of single precision."""
        self.p = self._cut(flat.astype(np.float32, copy=False))

    def _cut(self, flat: np.ndarray) -> dict:
        out, at = {}, 0
        for k, x in self.p.items():
            out[k] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        return out

    # A window's arrays hold a block a step, in it a row a unit and a column a lane, so that a step runs along one block of
    # memory; callers see states as (steps, lanes, units).

    def forward(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step (T, B, HIDDEN) for inputs (T, B); ``fresh`` marks the first token of a document,
        where the carried state is cleared."""
        p, H, E = self.p, HIDDEN, EMBED
        T, B = inputs.shape
        # a step's inputs are its embeddings, a row of ones for the bias and the state; a gate is 0.5 + 0.5 * tanh(x / 2)
        w = np.concatenate([p["wx"], p["b"][None], p["wh"]]).T.copy()
        w[:2 * H] *= 0.5
        un = w[2 * H:, E + 1:].copy()
        w[2 * H:, E + 1:] = 0
        x = np.empty((T, E + 1 + H, B), w.dtype)
        x[:, :E] = p["emb"][inputs].transpose(0, 2, 1)
        x[:, E] = 1
        gates = np.empty((T if keep else 1, 3 * H, B), w.dtype)
        out = np.empty((T, H, B), w.dtype)
        any_fresh = fresh.any(1)
        h = np.ascontiguousarray(h.T)
        for t in range(T):
            if any_fresh[t]:
                h = h * ~fresh[t]
            x[t, E + 1:] = h
            g = np.matmul(w, x[t], out=gates[t if keep else 0])
            zr, n = g[:2 * H], g[2 * H:]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n += un @ (zr[H:] * h)
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=out[t])
            h *= zr[:H]
            h += n
        return out.transpose(0, 2, 1), h.T, (x, gates)

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target (rare ones: of the rare class) given its state; with ``grads`` also
        adds up the gradients of the mean loss and returns that of the states."""
        p, H, n = self.p, HIDDEN, len(targets)
        cls = np.where(targets < self.size, targets // CLASS_SIZE, self.classes).astype(np.int16)
        # tokens class by class, the rare ones last: a row a unit, and a row of ones for the biases
        order = np.argsort(cls, kind="stable")
        cls, targets, cols = cls[order], targets[order], np.arange(n)
        s = np.ones((H + 1, n), states.dtype)
        np.take(np.ascontiguousarray(states.T), order, axis=1, out=s[:H], mode="clip")
        high = max(float(s.max()), -float(s.min()))
        outer = np.concatenate([p["cw"], p["cb"][None]])
        lp, e, total = _softmax(outer.T @ s, cls, cols, high * np.abs(outer).sum(0).max())
        if grads is not None:
            weight = 1 / (total * n)
            e[cls, cols] -= total
            g = (s * weight) @ e.T
            grads["cw"] += g[:H]
            grads["cb"] += g[H]
            back = p["cw"] @ e
            back *= weight
        bounds = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        m = bounds[-1]
        if m:
            spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
            own = np.concatenate([p["ow"], p["ob"][:, None]], 1)
            inner = np.empty((CLASS_SIZE, m), np.result_type(own, s))
            for c, at in spans:
                np.matmul(own[c].T, s[:, at], out=inner[:, at])
            k, cols = targets[:m] % CLASS_SIZE, cols[:m]
            more, e, total = _softmax(inner, k, cols, high * np.abs(own).sum(1).max())
            lp[:m] += more
            if grads is not None:
                weight = 1 / (total * n)
                e[k, cols] -= total
                sw = s[:, :m] * weight
                d = np.empty((H, m), e.dtype)
                for c, at in spans:
                    g = sw[:, at] @ e[:, at].T
                    grads["ow"][c] += g[:H]
                    grads["ob"][c] += g[H]
                    np.matmul(p["ow"][c], e[:, at], out=d[:, at])
                d *= weight
                back[:, :m] += d
        out = np.empty_like(lp)
        out[order] = lp
        if grads is None:
            return out, None
        d_out = np.empty_like(back)
        d_out[:, order] = back
        return out, d_out.T

    def backward(self, inputs, fresh, saved, d_out, grads) -> None:
        """Truncated backpropagation through one window."""
        p, H, E = self.p, HIDDEN, EMBED
        T, B = inputs.shape
        x, gates = saved
        h, z, r, n = x[:, E + 1:], gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:]
        uh, un = p["wh"][:, :2 * H].copy(), p["wh"][:, 2 * H:].copy()
        d_out = np.ascontiguousarray(d_out.transpose(0, 2, 1))
        by_n = (1 - z) * (1 - n * n)
        by_z = (h - n) * z * (1 - z)
        rh = r * h
        by_r = rh * (1 - r)
        d_x = np.empty((T, 3 * H, B), np.result_type(gates, d_out))
        d_h = np.zeros((H, B), d_x.dtype)
        any_fresh = fresh.any(1)
        for t in range(T - 1, -1, -1):
            d_h += d_out[t]
            d_zr, d_n = d_x[t, :2 * H], d_x[t, 2 * H:]
            np.multiply(d_h, by_n[t], out=d_n)
            d_rh = un @ d_n
            np.multiply(d_h, by_z[t], out=d_zr[:H])
            np.multiply(d_rh, by_r[t], out=d_zr[H:])
            d_h *= z[t]
            d_rh *= r[t]
            d_h += d_rh
            d_h += uh @ d_zr
            if any_fresh[t]:
                d_h *= ~fresh[t]
        g = np.matmul(x, d_x.transpose(0, 2, 1)).sum(0)
        grads["wx"] += g[:E]
        grads["b"] += g[E]
        grads["wh"][:, :2 * H] += g[E + 1:, :2 * H]
        grads["wh"][:, 2 * H:] += np.matmul(rh, d_x[:, 2 * H:].transpose(0, 2, 1)).sum(0)
        at = inputs.ravel().astype(np.int16 if self.size < 2**15 else np.int32)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        d_e = np.matmul(p["wx"], d_x).transpose(0, 2, 1).reshape(-1, E)
        grads["emb"][at[first]] += np.add.reduceat(d_e[order], first, axis=0)

    def train(self, docs: list[np.ndarray], rate: float, seed: int = 5) -> int:
        """One pass of Adagrad over the documents (token numbers); returns the number of tokens."""
        lanes = Lanes(docs, TRAIN_LANES)
        flat = self.flat()
        self.p = self._cut(flat)
        g, state = np.empty_like(flat), np.full_like(flat, 1e-5)
        grads = self._cut(g)
        rates = np.concatenate([np.full(x.size, rate * (0.1 if k in ("cb", "ob") else 1.0), flat.dtype) for k, x in self.p.items()])
        h = np.zeros((lanes.width, HIDDEN), np.float32)
        for lo in range(0, lanes.steps, WINDOW):
            ids, inputs, fresh, on = lanes.window(lo, WINDOW)
            g[:] = 0
            out, h, saved = self.forward(inputs, fresh, h[:ids.shape[1]], True)
            _, back = self.log_probs(_where_on(out, on), ids[on], grads)
            if on.all():
                d_out = back.T.reshape(HIDDEN, *on.shape)
            else:
                d_out = np.zeros((HIDDEN, *on.shape), np.float32)
                d_out[:, on] = back.T
            self.backward(inputs, fresh, saved, d_out.transpose(1, 2, 0), grads)
            np.minimum(np.maximum(g, -0.5, out=g), 0.5, out=g)
            state += g * g
            g *= rates
            g /= np.sqrt(state)
            flat -= g
        return sum(map(len, docs))

    def score(self, docs: list[np.ndarray]) -> list[float]:
        """Natural log probability of every document, the state carried from window to window."""
        if not docs:
            return []
        lanes = Lanes(docs, LANES)
        h = np.zeros((lanes.width, HIDDEN), np.float32)
        got = np.zeros(lanes.end[-1], np.float32)
        for lo in range(0, lanes.steps, WINDOW // 2):
            ids, inputs, fresh, on = lanes.window(lo, WINDOW // 2)
            out, h, _ = self.forward(inputs, fresh, h[:ids.shape[1]])
            got[lanes.places(lo, on)] = self.log_probs(_where_on(out, on), ids[on])[0]
        return [float(got[a:a + len(d)].sum(dtype=np.float64)) for d, a in zip(docs, lanes.at)]


def _where_on(out: np.ndarray, on: np.ndarray) -> np.ndarray:
    """States (tokens, HIDDEN) of a window's real tokens."""
    cols = out.transpose(2, 0, 1).reshape(out.shape[2], -1)
    return (cols if on.all() else cols[:, on.ravel()]).T


class Lanes:
    """Documents end to end in lanes of near equal length, the longest lane first.  Only the tokens themselves are
    held, lane after lane; the (steps, lanes) matrices of a window are cut from them when it is its turn."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        lanes = max(1, min(lanes, len(docs)))
        heap, members = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            used, lane = heap[0]
            members[lane].append(i)
            heapq.heapreplace(heap, (used + len(docs[i]), lane))
        order = [lane for _, lane in sorted(heap, reverse=True)]  # the longest first, so that lanes end from the right
        self.width = lanes
        self.length = np.array([sum(len(docs[i]) for i in members[lane]) for lane in order], np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.steps = int(self.length[0])
        self.at = [0] * len(docs)  # a document's place among all tokens
        self.tokens = np.empty(int(self.end[-1]), np.int32)
        self.head = np.zeros(int(self.end[-1]), bool)
        place = 0
        for lane in order:
            for i in members[lane]:
                self.at[i] = place
                self.tokens[place:place + len(docs[i])] = docs[i]
                self.head[place:place + 1] = len(docs[i]) > 0
                place += len(docs[i])

    def _where(self, lo: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a window's tokens (steps, live lanes), and which of them are real."""
        live = int(np.searchsorted(-self.length, -lo))  # lanes longer than lo
        steps = int(min(steps, self.steps - lo))
        t = np.arange(lo, lo + steps)[:, None]
        on = t < self.length[None, :live]
        return np.where(on, self.start[None, :live] + t, 0), on

    def window(self, lo: int, steps: int):
        """Targets, inputs (the token before; the start mark at a document's head), heads and a mask of real tokens."""
        place, on = self._where(lo, steps)
        fresh = self.head[place] & on
        inputs = np.where(on & ~fresh, self.tokens[place - 1], -1)
        return np.where(on, self.tokens[place], 0), inputs, fresh, on

    def places(self, lo: int, on: np.ndarray) -> np.ndarray:
        return self._where(lo, len(on))[0][on]


# ---- distributed training and scoring ------------------------------------------------------------------------

def _numbers(texts: list[bytes], vocabulary: pa.Array) -> list[np.ndarray]:
    """Each text's tokens by their places in the vocabulary, its size for others."""
    words, at, ends = tokens(texts)
    at = _look_up(words, vocabulary, len(vocabulary))[at]
    return [at[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _look_up(words: pa.Array, table: pa.Array, other: int) -> np.ndarray:
    return pc.index_in(words, value_set=table).fill_null(other).to_numpy()


def _train_part(net: Network, vocabulary, rate: float):
    def run(batches):
        known = pa.array(vocabulary, pa.binary())
        total, start, first = 0, net.flat(), True
        weighted = np.zeros(len(start))
        docs, size = [], 0

        def learn():
            own = Network.__new__(Network)
            own.__dict__.update(net.__dict__, p=dict(net.p))
            own.load(start)
            n = own.train(docs, rate)
            return n, own.flat()

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for texts in _cuts(batch.column(0).slice(lo, 512).cast(pa.binary()).to_pylist()):
                    docs += _numbers(texts, known)
                    size += sum(map(len, docs[-len(texts):]))
                if size > _GROUP:
                    n, flat = learn()
                    weighted, total, docs, size = weighted + n * flat, total + n, [], 0
        if docs:
            n, flat = learn()
            weighted, total = weighted + n * flat, total + n
        if total:
            i = np.arange(len(weighted) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.append(weighted, total))], names=["i", "v"])
    return run


def train(docs: DataFrame, counts: list, rare: int, rounds: int = ROUNDS, slices: int = SLICES, rate: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> tuple[Network, list]:
    """The network and its vocabulary.  In each round every task runs truncated backpropagation over its documents of
    one slice (of ``slices``) of the id hashes, from the same start; Spark sums the parameters, weighted by tokens, and
    the driver takes their mean (one model's size).  By default the rounds take every document once; with fewer rounds
    than slices the network learns from ``rounds / slices`` of the corpus only.  Vocabulary and counts come from all of
    it."""
    top = counts[: CLASSES * CLASS_SIZE]
    net = Network([c for _, c in top], rare + sum(c for _, c in counts[len(top):]))
    vocabulary = [w for w, _ in top]
    if not top:
        return net, vocabulary
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(slices)).alias("slice"), text_of(text_col).alias("t"))
    for r in range(rounds):
        part = rows.where(F.col("slice") == r % slices).select("t").mapInArrow(_train_part(net, vocabulary, rate / (r + 1)), "i int, v double")
        got = part.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        if got.num_rows:
            flat = np.empty(got.num_rows)
            flat[got["i"].to_numpy()] = got["v"].to_numpy()
            net.load(flat[:-1] / flat[-1])
    return net, vocabulary


_SCORED = "k long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, rare array<struct<w:binary,n:int>>"


def _score_part(shared, net: Network, size: int, total: int, distinct: int, rare_total: int, rare_distinct: int):
    base0, rare0 = log10(total + distinct + 1), log10(rare_total + rare_distinct + 1)

    def run(batches):
        head = shared.value  # (token, count), by number
        known = pa.array([w for w, _ in head], pa.binary())
        # by number, and at last for a token outside the head
        base = np.array([log10(c + 1) - base0 for _, c in head] + [0.0])
        share = np.array([(log10(c + 1) - rare0) if i >= size else 0.0 for i, (_, c) in enumerate(head)] + [0.0])
        docs, rows, held = [], [], 0

        def part(keys, outs, texts):
            """The rows of some documents but for the network's scores."""
            words, at, ends = tokens(texts)
            lengths = np.diff(ends, prepend=0)
            starts = ends - lengths
            place = _look_up(words, known, -1)[at]
            seen = np.where(place < 0, size, np.minimum(place, size)).astype(np.int32)
            docs.extend(seen[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
            # tokens outside the head, each once a document
            other = np.flatnonzero(place < 0)
            key, n = np.unique(np.repeat(np.arange(len(texts)), lengths)[other] * len(words) + at[other], return_counts=True)
            doc, word = np.divmod(key, len(words))
            rare = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(n, pa.int32())], ["w", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), rare)
            rows.append(pa.RecordBatch.from_arrays([
                keys, outs, pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((place >= 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(base[place], starts)), pa.array(np.add.reduceat(share[place], starts)), rare],
                names=["k", "held_out", "n_tokens", "head_known", "head_base", "head_score", "rare"]))
            return len(at)

        def done():
            log_p, at = np.array(net.score(docs)) / 2.302585092994046, 0
            for r in rows:
                yield r.set_column(5, "head_score", pa.array(log_p[at:at + r.num_rows] + r.column(5).to_numpy()))
                at += r.num_rows

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some, at = batch.slice(lo, 1024), 0
                for texts in _cuts(some.column(2).cast(pa.binary()).to_pylist()):
                    held += part(some.column(0).slice(at, len(texts)), some.column(1).slice(at, len(texts)), texts)
                    at += len(texts)
                if held > _GROUP:
                    yield from done()
                    docs, rows, held = [], [], 0
        if rows:
            yield from done()
    return run


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every whole
    text under the add-one unigram base and under the network; learning uses the documents whose id remainder is not
    ``held_out``.

    Counts are over all training tokens.  The ``head`` most frequent tokens (a bounded table) go to every worker with
    their counts; a document's other tokens, no one of which is frequent, are joined with the full count table by
    token and summed by document.

    Null and empty texts are one end token.  A null id is neither held out nor learnt from.  Repeated rows are scored
    alike and each counted in training.  An empty table gives no rows; without training documents every count is 0 and
    the model gives each token the add-one probability.  Other columns are not read.
    """
    spark = docs.sparkSession
    rem = id_remainder(id_col, modulus)
    counts = stage(token_counts(docs.where(rem != held_out), text_col), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(head).toArrow()
    top = list(zip(top["token"].to_pylist(), top["c"].to_pylist()))
    net, vocabulary = train(docs.where(rem != held_out), top, total - sum(c for _, c in top), id_col=id_col, text_col=text_col)
    size = len(vocabulary)
    in_vocabulary = sum(c for _, c in top[:size])
    rare_total, rare_distinct = total - in_vocabulary, distinct - size
    shared = spark.sparkContext.broadcast(top)
    rows = docs.select(key_of(id_col).alias("k"), F.coalesce(rem == held_out, F.lit(False)).alias("o"), text_of(text_col).alias("t"))
    scored = rows.mapInArrow(_score_part(shared, net, size, total, distinct, rare_total, rare_distinct), _SCORED)
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("token"), F.col("x.n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    lg = F.log10(c + 1) * F.col("n")
    rare = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(lg).alias("lg"), F.sum("n").alias("n"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    base0, rare0 = log10(total + distinct + 1), log10(rare_total + rare_distinct + 1)
    lg, n = F.coalesce("lg", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return scored.drop("rare").join(rare, "row", "left").select(
        id_of(F.col("k")).alias(id_col), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("head_base") + lg - n * F.lit(base0)).alias("base_score"),
        (F.col("head_score") + lg - n * F.lit(rare0)).alias("score"))
