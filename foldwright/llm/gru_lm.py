"""Document log-likelihood under a gated recurrent word model.

Tokens are lower-cased words and an end.  Counts of all training tokens are exact.  The
most frequent (the end always among them) are the network's words: ``VOCAB`` up to
``VOCAB_TOKENS`` training tokens, then growing with their square root.  All others
share one symbol, whose inner distribution is their add-one smoothed share of the tail,
with room for an unseen word.  The network is a gated recurrent unit with
class-factored softmax: words are cut into classes of about equal sums of the roots of their
frequencies (``CLASSES``, or two fifths of the root of the number of words where that is more), the state predicts the class, then the word inside it.  So probabilities of
all words and one unseen word sum to 1.

Training is truncated backpropagation through time in numpy with Adam; the state is
carried from window to window of a document but gradients are not.  The ``SAMPLE``
first documents in hash order of their ids only give the starting weights, by ``EPOCHS``
passes.  Then come ``ROUNDS`` rounds over all training documents: every partition learns from all of its
own, from the round's common weights, and the partitions' weights are averaged by their
tokens, chunk by chunk in tasks, so the driver gets one set of weights a round.
Learning starts anew every ``PIECE`` tokens of a long document, so that no stream is much
longer than the others; scoring carries the state through the whole of every document.

Words travel as 64-bit hashes.  The ``HEAD`` most frequent training words, and those with
more than a ``HEAD``-th of all tokens, have their counts broadcast (2 MB at most; never
fewer than the network's), so no task gets a frequent word's rows; the others are joined
to their counts by word.  Null and empty texts are the end alone; very long texts are
scored whole, a window at a time; repeated rows get equal
scores; an empty training set leaves every token unknown.
"""

from __future__ import annotations

from copy import copy
from heapq import heapreplace
from math import isqrt, log10

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize, release, text_buffer, words_of

VOCAB, HEAD, CLASSES, HIDDEN = 1024, 65_536, 32, 16
SAMPLE, EPOCHS, ROUNDS, BATCH, WINDOW, RATE = 320, 3, 1, 32, 16, 0.01
#: Training tokens beyond which the network's words grow with the root of their number.
VOCAB_TOKENS = 1 << 20
#: Streams that are learnt from side by side, tokens that the state is carried over there, tokens held at once, weights
#: a shuffled row.
LANES, PIECE, HELD_TOKENS, CHUNK = 512, 2048, 2_000_000, 4096
#: A partition of so few windows that it gives fewer steps is gone over again, up to ``EPOCHS`` times.
LEAST_STEPS = 100
#: Rows that a softmax over classes takes at once.
BLOCK = 1024
#: The hash that stands for the end of a text.
END = np.uint64(1)
_LN10 = np.float64(np.log(10))


def tokens_of(column):
    """(hashes, bounds): every text's words and its end."""
    words, first = words_of(*text_buffer(column))
    n = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(bounds[-1]), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return out, bounds


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, n, m): how often a word is in the texts that aren't held out, and in all."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hashes, bounds = tokens_of(part.column(0))
                held = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
                for own, learnt in ((hashes[~held], 1), (hashes[held], 0)):
                    words, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n * learnt), pa.array(n)], names=["word", "n", "m"])
        release()

    found = docs.select(F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, "word long, n long, m long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Uses ``x`` up."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # far below zero it is 1 / inf
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class GatedModel:
    """GRU over word ids 0..size-1 and ``size`` for all other words; id 0 is the end.

    The last row of ``c`` and the last column of ``w`` are the biases of classes and words.
    """

    def __init__(self, counts: np.ndarray, tail: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size, h = len(counts), hidden
        # words in order of frequency, cut where another share of the roots of their counts is
        # reached: of all cuts into so many classes, the one with the fewest logits a token
        order = np.argsort(-counts, kind="stable")
        root = np.sqrt(counts[order])
        mass = (np.cumsum(root) - root) / max(1, root.sum())
        cls = np.zeros(self.size, np.int16)
        cls[order] = np.unique((mass * classes).astype(np.int64), return_inverse=True)[1] if self.size else 0
        self.cls = np.append(cls, np.int16(cls.max(initial=-1) + 1))  # the other words are the last class
        self.n_classes = int(self.cls[-1]) + 1
        #: Class ``c`` holds the places ``cuts[c]:cuts[c+1]`` of the words in order of frequency.
        self.cuts = np.searchsorted(cls[order], np.arange(self.n_classes)).tolist()
        self.place = np.zeros(self.size + 1, np.int64)
        self.place[order] = np.arange(self.size)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        counts = counts[order]
        prior = np.array([counts[a:b].sum() for a, b in zip(self.cuts[:-1], self.cuts[1:])] + [max(1, tail)], np.float64)
        of_class = np.log((prior + 1) / (prior.sum() + len(prior))).astype(np.float32)
        of_word = np.log(np.maximum(counts, 1) / max(1, counts.sum())).astype(np.float32)
        self.p = {"x": small(self.size + 1, 3 * h), "u": small(h, 3 * h), "c": np.vstack([small(h, self.n_classes), of_class]), "w": np.hstack([small(self.size, h), of_word[:, None]])}

    def step(self, x: np.ndarray, h: np.ndarray):
        n = h.shape[1]
        u = self.p["u"]
        g = h @ u[:, : 2 * n]
        g += x[:, : 2 * n]
        g = _sigmoid(g)
        z, r = g[:, :n], g[:, n:]
        c = (r * h) @ u[:, 2 * n :]
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c

    def _bounded(self) -> bool:
        """Whether no logit of a state, which is within -1 to 1, is too large for a sum of exponentials."""
        return all(np.abs(self.p[k]).sum(axis).max(initial=0) < 60 for k, axis in (("c", 0), ("w", 1)))

    @staticmethod
    def _softmax(logits: np.ndarray, pick: np.ndarray, slope: bool, bounded: bool) -> np.ndarray:
        """Log of each row's probability of ``pick``; ``logits`` become the loss's slope by them, or are used up."""
        rows = np.arange(len(pick))
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        own = logits[rows, pick]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        if slope:
            logits *= (1 / total)[:, None]
            logits[rows, pick] -= 1
        return own - np.log(total)

    def log_probs(self, h: np.ndarray, to: np.ndarray, grads: dict | None = None, back: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each target's probability in its state; adds gradients of the loss if asked."""
        p, cls, slope, bounded = self.p, self.cls[to], grads is not None, self._bounded()
        order = np.argsort(cls, kind="stable")  # class by class from here
        own = np.empty(len(to), h.dtype)
        n, width = h.shape
        h, h[:, :width] = np.ones((n, width + 1), h.dtype), h.take(order, 0)
        cls, place = cls[order], self.place[to[order]]
        up = np.empty((n, width), h.dtype) if slope else None
        ends = np.searchsorted(cls, np.arange(self.n_classes + 1)).tolist()
        inside = [(a, b, i, j) for a, b, i, j in zip(self.cuts[:-1], self.cuts[1:], ends[:-1], ends[1:]) if b - a > 1 and i < j]
        room = np.empty(max([min(n, BLOCK) * self.n_classes, *[min(j - i, BLOCK) * (b - a) for a, b, i, j in inside]]), h.dtype)
        back_c = p["c"][:width].T.copy()
        for i in range(0, n, BLOCK):  # so many rows of logits stay in a core's own cache
            some = h[i : i + BLOCK]
            logits = np.matmul(some, p["c"], out=room[: len(some) * self.n_classes].reshape(len(some), -1))
            own[i : i + BLOCK] = self._softmax(logits, cls[i : i + BLOCK], slope, bounded)
            if slope:
                grads["c"] += some.T @ logits
                np.matmul(logits, back_c, out=up[i : i + BLOCK])
        for a, b, first, j in inside:
            w = p["w"][a:b]
            for i in range(first, j, BLOCK):
                some = h[i : min(i + BLOCK, j)]
                logits = np.matmul(some, w.T, out=room[: len(some) * (b - a)].reshape(len(some), -1))
                own[i : i + len(some)] += self._softmax(logits, place[i : i + len(some)] - a, slope, bounded)
                if slope:
                    grads["w"][a:b] += logits.T @ some
                    up[i : i + len(some)] += logits @ w[:, :width]
        out = np.empty_like(own)
        out[order] = own
        if slope:
            back[order] += up
        return out

    def train_packed(self, texts: list[np.ndarray], moments: dict, seed: int = 6) -> None:
        """One pass over id arrays that end with 0, laid end to end in lanes.  ``moments`` is kept between calls."""
        if not moments:
            moments |= {"mean": {k: np.zeros_like(v) for k, v in self.p.items()}, "square": {k: np.zeros_like(v) for k, v in self.p.items()}, "turn": 0}
        rng = np.random.default_rng(seed + moments["turn"])
        # what comes before each token; 0 starts a text, or a piece of a long one, without a state
        pieces = [(text[i : i + PIECE], np.append(0, text[i : i + PIECE - 1][: len(text) - i - 1])) for text in texts for i in range(0, len(text), PIECE)]
        lanes = min(LANES, max(BATCH, len(pieces) // 8), len(pieces))
        fill, held = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for piece in sorted(pieces, key=lambda x: -len(x[0])):  # the longest first, each to the emptiest lane
            n, i = fill[0]
            heapreplace(fill, (n + len(piece[0]), i))
            held[i].append(piece)
        for lane in held:
            rng.shuffle(lane)
        held.sort(key=lambda lane: -sum(len(x[0]) for x in lane))
        sizes = np.array([sum(len(x[0]) for x in lane) for lane in held])
        ids, prior = (np.concatenate([x[k] for lane in held for x in lane]) for k in (0, 1))
        start = np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        h = np.zeros((lanes, self.p["u"].shape[0]), np.float32)
        for t0 in range(0, len(live), WINDOW):
            tape = []
            for t in range(t0, min(t0 + WINDOW, len(live))):
                n = int(live[t])
                last = prior[start[:n] + t]
                before = h[:n] * (last != 0)[:, None]
                h, z, r, c = self.step(self.p["x"].take(last, 0), before)
                tape.append((n, last, before, z, r, c, h, ids[start[:n] + t]))
            moments["turn"] += 1
            self._learn(tape, moments["mean"], moments["square"], moments["turn"], packed=True, share=sum(len(x[7]) for x in tape) / (lanes * WINDOW))

    def _learn(self, tape, mean: dict, square: dict, turn: int, packed: bool = False, share: float = 1.0) -> None:
        """One step of Adam for a window; of ``x`` in packed lanes, only for the words in it.

        ``share`` of a full window shortens the step, or the last long text would outweigh all others.
        """
        grads = {k: np.zeros_like(v) for k, v in self.p.items() if not (packed and k == "x")}
        states = np.concatenate([s[6] for s in tape])
        back = np.zeros_like(states)
        self.log_probs(states, np.concatenate([s[7] for s in tape]), grads, back)
        if packed:
            seen, grads["x"] = self._slopes(tape, back, grads, packed)
        else:
            self._through_time(tape, back, grads)
        for k, g in grads.items():
            some = packed and k == "x"
            m, q = (mean[k][seen], square[k][seen]) if some else (mean[k], square[k])
            g *= np.float32(1 / len(states))
            np.clip(g, -1, 1, out=g)
            m *= 0.9
            m += 0.1 * g
            np.square(g, out=g)
            g *= 0.001
            q *= 0.999
            q += g
            np.multiply(q, 1 / (1 - 0.999**turn), out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= share * RATE / (1 - 0.9**turn)
            if some:
                mean[k][seen], square[k][seen] = m, q
                self.p[k][seen] -= g
            else:
                self.p[k] -= g

    def _through_time(self, tape, back, grads, packed: bool = False) -> None:
        """Gradients of one window; they stop at its start and, in packed lanes, at a text's."""
        words, slopes = self._slopes(tape, back, grads, packed)
        grads["x"][words] += slopes

    def _slopes(self, tape, back, grads, packed: bool):
        """(words, the slopes of their rows of ``x``); adds those of ``u``."""
        u, hidden, at = self.p["u"], self.p["u"].shape[0], len(back)
        later = np.zeros((tape[0][0], hidden), np.float32)
        turned, turned_c = u[:, : 2 * hidden].T.copy(), u[:, 2 * hidden :].T.copy()
        slopes = np.empty((at, 3 * hidden), back.dtype)
        reset = np.empty((at, hidden), back.dtype)
        for n, ids, before, z, r, c, _new, _to in reversed(tape):
            at -= n
            dh = back[at : at + n]
            dh += later[:n]
            slope = slopes[at : at + n]
            keep = 1 - z
            dz, dr, dc = slope[:, :hidden], slope[:, hidden : 2 * hidden], slope[:, 2 * hidden :]
            np.subtract(c, before, out=dz)
            dz *= keep
            scaled = dh * z
            dz *= scaled
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= scaled
            drh = dc @ turned_c
            drh *= r
            held = np.multiply(r, before, out=reset[at : at + n])
            np.subtract(before, held, out=dr)
            dr *= drh
            np.multiply(dh, keep, out=keep)
            keep += drh
            keep += slope[:, : 2 * hidden] @ turned
            if packed:
                keep *= (ids != 0)[:, None]
            later[:n] = keep
        states = np.concatenate([s[2] for s in tape])
        grads["u"][:, : 2 * hidden] += states.T @ slopes[:, : 2 * hidden]
        grads["u"][:, 2 * hidden :] += reset.T @ slopes[:, 2 * hidden :]
        words = np.concatenate([s[1] for s in tape])
        order = np.argsort(words.astype(np.uint16) if self.size < 1 << 16 else words, kind="stable")  # by radix if it can
        words, first = np.unique(words[order], return_index=True)
        return words, np.add.reduceat(slopes.take(order, 0), first)

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each text ``ids[bounds[i]:bounds[i+1]]``, other words as one symbol."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        sizes, start = sizes[order], bounds[:-1][order]
        out = np.zeros(len(order), np.float64)
        h = np.zeros((len(order), self.p["u"].shape[0]), np.float32)
        last = np.zeros(len(order), np.int64)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        for t0 in range(0, len(live), WINDOW):
            states, targets, owners = [], [], []
            for t in range(t0, min(t0 + WINDOW, len(live))):
                n = int(live[t])
                h = self.step(self.p["x"].take(last[:n], 0), h[:n])[0]
                last = ids[start[:n] + t]
                states.append(h), targets.append(last), owners.append(np.arange(n))
            got = self.log_probs(np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate(owners), got, len(out))
        back = np.empty_like(out)
        back[order] = out
        return back


def _places(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted words, or their number for one that isn't there."""
    # hashes are even, so about two words share their leading bits
    shift = np.uint64(64 - max(1, len(words).bit_length() - 1))
    first = np.searchsorted(words, np.arange(1 << 64 - int(shift), dtype=np.uint64) << shift)
    most = int(np.diff(first, append=len(words)).max())
    at = first[(hashes >> shift).astype(np.int64)]
    padded = np.append(words, np.uint64(2**64 - 1))
    for _ in range(min(most, 12)):
        at += padded[at] < hashes
    late = np.flatnonzero(padded[at] < hashes) if most > 12 else np.zeros(0, np.int64)
    at[late] = np.searchsorted(words, hashes[late])
    at[padded[at] != hashes] = len(words)
    return at


def _learn_from_all(model: GatedModel, train: DataFrame, words: np.ndarray, rank: np.ndarray, epochs: int) -> None:
    """Rounds over all texts: the partitions' weights, averaged by their tokens."""
    import pyarrow as pa

    names = list(model.p)
    shapes = [model.p[k].shape for k in names]
    cuts = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])

    for turn in range(epochs):
        shared = train.sparkSession.sparkContext.broadcast((model, words, rank))

        def learn(batches):
            model, words, rank = shared.value
            model = copy(model)
            model.p = {k: v.copy() for k, v in model.p.items()}  # workers are used again
            texts, moments, held, total = [], {}, 0, 0
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    hashes, bounds = tokens_of(batch.column(0).slice(i, 512))
                    ids = np.minimum(np.append(rank, model.size)[_places(words, hashes)], model.size).astype(np.int32)
                    texts += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                    held, total = held + len(ids), total + len(ids)
                    if held >= HELD_TOKENS:
                        model.train_packed(texts, moments, turn)
                        texts, held = [], 0
            for _ in range(EPOCHS if texts else 0):
                model.train_packed(texts, moments, turn)
                if moments["turn"] >= LEAST_STEPS:
                    break
            del texts
            release()
            if total:
                flat = np.concatenate([model.p[k].ravel() for k in names])
                for i in range(0, len(flat), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([total]), pa.array([flat[i : i + CHUNK].tobytes()])], names=["chunk", "n", "w"])

        def average(batches):
            sums = {}
            for batch in batches:
                for chunk, n, w in zip(*[c.to_pylist() for c in batch.columns]):
                    w = np.frombuffer(w, np.float32) * np.float64(n)
                    all_n, all_w = sums.get(chunk, (0, 0.0))
                    sums[chunk] = all_n + n, all_w + w
            for chunk, (n, w) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n]), pa.array([(w / n).astype(np.float32).tobytes()])], names=["chunk", "n", "w"])

        schema = "chunk int, n long, w binary"
        rows = train.select("text").mapInArrow(learn, schema).repartition("chunk").mapInArrow(average, schema).collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])
            model.p = {k: flat[a:b].reshape(x).copy() for k, x, a, b in zip(names, shapes, cuts, cuts[1:])}
        shared.destroy()


def score_documents(docs: DataFrame, modulus: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    held = F.coalesce(bucket_of(F.col("doc_id"), modulus) == fold, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = docs.where(~F.col("held_out"))
    counts = materialize(count_tokens(docs), "lm-counts")
    is_end = F.col("word") == int(END)
    none = F.lit(0).cast("long")
    n_all, v_all, ends, m_all = counts.agg(*[F.coalesce(x, none) for x in (F.sum("n"), F.count_if(F.col("n") > 0), F.sum(F.when(is_end, F.col("n"))), F.sum("m"))]).first()
    words_only = counts.where(~is_end)
    grown = int(VOCAB * max(1.0, n_all / VOCAB_TOKENS) ** 0.5)
    head = words_only.where("n > 0").orderBy(F.desc("n"), "word").limit(max(HEAD, grown) - 1).select("word", "n").toArrow()
    # words that only the other texts are full of; fewer than HEAD can have so many tokens
    other = words_only.where(F.col("m") * HEAD > m_all).select("word", "n").toArrow()
    words, n = (np.concatenate([x.column(c).to_numpy() for x in (head, other)]) for c in ("word", "n"))
    _, first = np.unique(words, return_index=True)
    first.sort()
    words, n = np.append(END, words[first].view(np.uint64)), np.append(ends, n[first])  # the end is word 0
    vocab = min(grown, head.num_rows + 1) if n_all else 0
    n_tail, v_tail = n_all - int(n[:vocab].sum()), v_all - vocab
    model = GatedModel(n[:vocab].astype(np.float64), n_tail, classes=max(CLASSES, 2 * isqrt(vocab) // 5))
    order = np.argsort(words)
    words, n, rank = words[order], n[order], order
    log_base, log_tail = log10(n_all + v_all + 1), log10(n_tail + v_tail + 1)

    if vocab:
        ids = [r["doc_id"] for r in train.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
        sample = train.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE).select("text").toArrow().column("text")
        hashes, bounds = tokens_of(sample)
        own = np.minimum(np.append(rank, vocab)[_places(words, hashes)], vocab)
        texts, moments = [own[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])], {}
        for _ in range(EPOCHS):
            model.train_packed(texts, moments)
        _learn_from_all(model, train, words[rank < vocab], rank[rank < vocab], ROUNDS)
    shared = spark.sparkContext.broadcast((model, words, n, rank))
    names = ["at", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word"]

    def run(batches):
        """A row for each document, and one for each of its words beyond the head."""
        model, words, n, rank = shared.value
        gain, ranks = np.log10(np.append(n, 0) + 1.0), np.append(rank, model.size)
        at_row = TaskContext.get().partitionId() << 33

        def scored(held):
            """The rows of some slices, whose texts go through the network together."""
            counts = np.concatenate([h[1] for h in held])
            score = model.score(np.concatenate([h[0] for h in held]), np.concatenate([[0], np.cumsum(counts)])) / _LN10
            i = 0
            for _, n, columns, tail in held:
                columns += [pa.array(score[i : i + len(n)] + tail), pa.nulls(len(n), pa.int64())]
                i += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        held, n_held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                hashes, bounds = tokens_of(part.column(2))
                at = _places(words, hashes)
                inside = at < len(words)
                ids = np.minimum(ranks[at], model.size)
                sums = lambda x: np.add.reduceat(x, bounds[:-1])
                base = sums(np.where(inside, gain[at] - log_base, 0.0))
                tail = sums(np.where(inside & (ids == model.size), gain[at] - log_tail, 0.0))
                known = sums((inside & (gain[at] > 0)).astype(np.int64))
                rows = at_row + np.arange(part.num_rows)
                at_row += part.num_rows
                far = np.flatnonzero(~inside)
                owner = np.searchsorted(bounds, far, side="right") - 1
                columns = [pa.array(rows), part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(known), pa.array(base)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[owner]), *[pa.nulls(len(far), c.type) for c in columns[1:]], pa.nulls(len(far), pa.float64()), pa.array(hashes[far].view(np.int64))], names=names)
                held.append((ids.astype(np.int32), np.diff(bounds), columns, tail))
                n_held += len(ids)
                if n_held >= HELD_TOKENS:
                    yield from scored(held)
                    held, n_held = [], 0
        if held:
            yield from scored(held)
        release()

    found = docs.select("doc_id", "held_out", "text").mapInArrow(run, "at long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word long")
    found = materialize(found, "lm-scores")
    c = F.coalesce(F.col("n"), none)
    joined = found.where("word IS NOT NULL").select("at", "word").join(words_only.where("n > 0").select("word", "n"), "word", "left")
    gain = F.log10(c + F.lit(1.0))
    sums = joined.groupBy("at").agg(F.sum(F.when(c > 0, 1).otherwise(0)).alias("known"), F.sum(gain - log_base).alias("base"), F.sum(gain - log_tail).alias("tail"))
    zero = F.lit(0.0)
    return found.where("word IS NULL").join(sums, "at", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", none)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"), (F.col("score") + F.coalesce("tail", zero)).alias("score"),
    )
