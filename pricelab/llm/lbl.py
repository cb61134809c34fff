"""Operator 9: language-model scores by a log-bilinear model trained with
noise-contrastive estimation.

Counts.  Spark counts every word of every training document.  The most
frequent words are outputs of their own.  In alphabetical order they are cut
into classes of equal size, and every other word belongs to the class it
would stand in: it shares that class's one output for the rest.  A word's
probability given the ``CONTEXT`` outputs before it is that of its class, times
that of its output within the class, each normalised (two short products in
place of one over all outputs), times for a rest its smoothed share of the rest; unseen
words of a class share one more type of it.  So a text's probability is normalised.

Word counts needed for a document come from two places: a broadcast table of
at most ``table_words`` most frequent words, and for all other words a join
by the word's hash, summed per document.
"""
from __future__ import annotations

import copy
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_docs, portions, small_batches, words

CONTEXT = 4
SMOOTH = 0.1
SEED = 42
#: Places scored at a time, and scores held at a time (they stay in the processor's cache).
BLOCK, CACHED = 1 << 18, 1 << 17
#: Training: outputs of a piece, tokens of a task, tokens mixed in a task, parameters in a row of what a task sends.
PIECE, TASK_TOKENS, SHUFFLED, WIDTH = 2048, 2_500_000, 400_000, 16
#: 64ths of the pieces that the rounds end with.
ROUNDS = (1, 16, 32, 48, 64)
#: Changes of parameters are summed as whole multiples of this, so that their mean does not depend on the order.
UNIT = 2.0 ** -10
#: Words with an output of their own up to so many training tokens; their number grows with the eighth root.
BASE_TOKENS, BASE_WORDS, GROWTH = 400_000, 5000, 0.125


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased (the end of the text is not among them)."""
    return words(text.lower()) if text else []


def tokens_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all ``texts``, as ``tokens_of`` gives them, one after another, and each text's number of them.

    Arrow's kernel cuts at runs of the same six bytes, but also gives what is empty before the first and
    behind the last run; that is left out.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    tokens, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    real = pc.not_equal(pc.binary_length(tokens), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return tokens.filter(real), np.diff(before[ends], prepend=0)


class Network:
    """Log-bilinear model of output sequences.  The output k of class c has the number c * width + k,
    the end of a text is a class and an output of its own and the last number.  After the outputs
    c1.. the hidden vector is the sum of r[c_i] * c[i]; class and output score bias + q . hidden.
    Both levels are trained by NCE with Adagrad (one step size for each row); the noise is the
    unigram of classes and of outputs.
    """
    #: Noise drawn for a batch of places, which share it: outputs and classes.
    NOISE, CLASS_NOISE, RATE, SIZE = 16, 8, 0.2, 16
    #: Places of a batch: a share of those seen before, within bounds; places that follow each other in a batch.
    SHARE, BATCH, RUN = 0.0005, (16, 4096), 16

    def __init__(self, counts: np.ndarray, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, size = len(counts), self.SIZE
        self.width, self.end, self.seen = width, n - 1, 0
        self.small = np.uint16 if n <= 1 << 16 else np.int64       # short numbers sort by radix
        self.unigram = (counts + 0.5) / (counts + 0.5).sum()
        self.groups = np.add.reduceat(self.unigram, np.arange(0, n, width))
        self.params = [(rng.standard_normal((n, size)) * 0.1).astype(np.float32),     # r: context outputs
                       np.full((CONTEXT, size), 1 / CONTEXT, np.float32),
                       (rng.standard_normal((n, size)) * 0.1).astype(np.float32),     # q: outputs
                       np.log(self.unigram).astype(np.float32)[:, None],
                       (rng.standard_normal((len(self.groups), size)) * 0.1).astype(np.float32),     # q: classes
                       np.log(self.groups).astype(np.float32)[:, None]]
        self.past = [np.full((len(x), 1), 1e-2, np.float32) for x in self.params]

    def sweep(self, parts: list[np.ndarray], rng: np.random.Generator) -> int:
        """One pass over the places of ``parts``, pieces with CONTEXT outputs before them; returns their number.

        The places go in runs of RUN that follow each other, in random order, so an output that stands
        in several contexts of a run is looked up once.
        """
        r, c, *_ = self.params
        levels = [(2, np.log(self.NOISE * self.unigram).astype(np.float32), np.cumsum(self.unigram), self.NOISE),
                  (4, np.log(self.CLASS_NOISE * self.groups).astype(np.float32), np.cumsum(self.groups), self.CLASS_NOISE)]
        stream, starts, real = _runs(parts, self.RUN, self.end)
        stream = stream.astype(self.small)
        group_of = (stream // self.width).astype(self.small)
        starts = starts[rng.permutation(len(starts))]
        ahead = np.arange(self.RUN + CONTEXT)
        # a run stands in one row; where the outputs k before its places stand in the row of its context
        before = [slice((CONTEXT - k) * self.SIZE, (CONTEXT - k + self.RUN) * self.SIZE) for k in range(1, CONTEXT + 1)]
        i = 0
        while i < len(starts):
            n = max(1, int(np.clip(self.seen * self.SHARE, *self.BATCH)) // self.RUN)
            at = starts[i:i + n, None] + ahead
            i += n
            weight = real[at[:, CONTEXT:]].ravel()
            self.seen += int(weight.sum())
            rows, places = stream.take(at), at[:, CONTEXT:]
            context = rows[:, :-1].ravel()
            rc, factors = r.take(context, axis=0).reshape(len(at), -1), np.tile(c, self.RUN)
            hidden = rc[:, before[0]] * factors[0]
            for own, factor in zip(before[1:], factors[1:]):
                hidden += rc[:, own] * factor
            hidden = hidden.reshape(-1, self.SIZE)
            gh = np.zeros_like(hidden)
            for (k, log_noise, bound, n_noise), goal in zip(levels, (rows[:, CONTEXT:].ravel(), group_of.take(places).ravel())):
                noise = np.searchsorted(bound, rng.random(n_noise) * bound[-1]).clip(0, len(bound) - 1)
                gh += self._contrast(k, log_noise, goal, noise, hidden, weight)
            gh = gh.reshape(len(at), -1)
            gr, gc = np.zeros_like(rc), np.empty_like(c)
            for k, (own, factor) in enumerate(zip(before, factors)):
                gc[k] = np.einsum("ij->j", (rc[:, own] * gh).reshape(-1, self.SIZE))
                gr[:, own] += gh * factor
            self._step(0, *_summed(context, gr.reshape(-1, self.SIZE)))
            self._step(1, np.arange(CONTEXT), gc)
        return int(real.sum())

    def _contrast(self, k: int, log_noise: np.ndarray, target: np.ndarray, noise: np.ndarray, hidden: np.ndarray,
                  weight: np.ndarray) -> np.ndarray:
        """One update of outputs ``k`` and their bias; returns the gradient of ``hidden``."""
        q, bias = self.params[k:k + 2]
        scale = weight / np.float32(np.sqrt(len(target)))
        qt, qn, base = q.take(target, axis=0), q[noise], bias[:, 0] - log_noise
        s = np.einsum("be,be->b", hidden, qt) + base.take(target)
        gt = (scale / (1 + np.exp(np.clip(s, -30, 30))))[:, None]
        gn = np.ascontiguousarray((hidden @ -qn.T).T)          # a row for each noise output
        gn -= base[noise][:, None]
        np.clip(gn, -30, 30, out=gn)
        np.exp(gn, out=gn)
        gn += 1
        np.divide(-scale, gn, out=gn)
        gh = gt * qt
        gh += gn.T @ qn
        rows, gq, gb = _summed(target, gt * hidden, gt)
        self._step(k, rows, gq)
        self._step(k + 1, rows, gb)
        rows, gq, gb = _summed(noise, gn @ hidden, np.add.accumulate(gn, axis=1)[:, -1:])
        self._step(k, rows, gq)
        self._step(k + 1, rows, gb)
        return gh

    def _step(self, k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        past, x = self.past[k], self.params[k]
        new = past.take(rows) + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
        past[rows, 0] = new
        x[rows] = x.take(rows, axis=0) + np.float32(self.RATE) * grad / np.sqrt(new)[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.params, *self.past)])

    def take(self, values: np.ndarray) -> None:
        at = 0
        for x in (*self.params, *self.past):
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size


def _summed(rows: np.ndarray, *grads: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, and of each gradient the sum for each of them."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return (rows[first], *(np.add.reduceat(g.take(order, axis=0), first, axis=0) for g in grads))


def pieces(out: np.ndarray, end: int, most: int = PIECE) -> list[np.ndarray]:
    """A sequence in pieces of at most ``most`` outputs, each after the CONTEXT outputs before it."""
    padded = np.concatenate([np.full(CONTEXT, end, out.dtype), out])
    return [padded[i:i + CONTEXT + most] for i in range(0, len(out), most)]


def _runs(parts: list[np.ndarray], run: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces one after another, each filled up with ``end`` to whole runs of ``run`` places;
    starts (of the context) of the runs; which numbers of the stream are places to predict."""
    sizes = np.array([len(p) for p in parts])
    whole = -(-(sizes - CONTEXT) // run)
    begin = np.cumsum(CONTEXT + whole * run) - CONTEXT - whole * run
    stream = np.full(int((CONTEXT + whole * run).sum()), end, np.int64)
    real = np.zeros(len(stream), np.float32)
    for at, p in zip(begin.tolist(), parts):
        stream[at:at + len(p)] = p
        real[at + CONTEXT:at + len(p)] = 1
    starts = np.repeat(begin, whole) + run * (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole))
    return stream, starts, real


def fit(sequences: DataFrame, net: Network, n_tokens: int) -> None:
    """Train ``net`` on all pieces ``out`` of ``sequences`` (doc_id, out), each in one round of Spark tasks.

    In a round every task trains a copy of the network on its share of the
    pieces, and the copies' weighted mean is the next round's network.  The first
    round takes a small share of the pieces, in small batches.  Pieces are dealt by
    hash and sorted, tasks send what they changed, and the mean is taken of whole
    numbers, so the network does not depend on how the rows came.
    """
    spark = sequences.sparkSession
    names = ["i", *(f"v{k}" for k in range(WIDTH))]
    schema = "i int, " + ", ".join(f"{x} long" for x in names[1:])
    keyed = sequences.select("out", F.xxhash64("doc_id", "out").alias("key"))
    share = F.pmod(F.shiftright("key", 32), F.lit(ROUNDS[-1]))
    for j, (low, high) in enumerate(zip((0, *ROUNDS), ROUNDS)):
        shared = spark.sparkContext.broadcast(net)
        tasks = max(1, round(n_tokens * (high - low) / ROUNDS[-1] / TASK_TOKENS))

        def run(batches: Iterator[pa.RecordBatch], j: int = j, shared=shared) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(shared.value)
            rng, done, held, size = np.random.default_rng([SEED, j]), 0, [], 0
            for b in batches:
                column = b.column(0)
                values, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
                for p in np.split(values, ends[:-1]) if len(ends) else ():
                    held.append(p)
                    size += len(p)
                    if size >= SHUFFLED:
                        done += own.sweep(held, rng)
                        held, size = [], 0
            if held:
                done += own.sweep(held, rng)
            if done:                                            # what changed, and a row -1 of the weight and 1 copy
                change = np.rint((own.flat().astype(float) - shared.value.flat()) * (done / UNIT)).astype(np.int64)
                change = np.concatenate([change, np.zeros(-len(change) % WIDTH, np.int64)]).reshape(-1, WIDTH)
                at = np.flatnonzero(change.any(axis=1))
                change = np.concatenate([np.array([[done, 1] + [0] * (WIDTH - 2)]), change[at]])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), *(pa.array(x) for x in change.T.copy())], names=names)

        dealt = (keyed.where((share >= low) & (share < high))
                 .repartition(tasks, "key").sortWithinPartitions("key", "out").select("out"))
        sums = dealt.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(x).alias(x) for x in names[1:]]).toArrow().sort_by("i")
        shared.unpersist()
        if sums.num_rows:
            weight, copies = sums.column("v0")[0].as_py(), sums.column("v1")[0].as_py()
            flat = net.flat().astype(float)
            flat = np.concatenate([flat, np.zeros(-len(flat) % WIDTH)]).reshape(-1, WIDTH)
            at = sums.column("i").to_numpy()[1:]
            flat[at] += np.stack([sums.column(x).to_numpy()[1:] for x in names[1:]], axis=1) * (UNIT / weight)
            net.take(flat.ravel().astype(np.float32))
            net.seen += weight // copies


@dataclass
class Model:
    total: int                      # N: training tokens
    types: int                      # V: distinct training tokens
    end_count: int
    index: dict[bytes, int]         # frequent words: place in the two arrays
    counts: np.ndarray
    outputs: np.ndarray             # output of each frequent word
    first: list[bytes]              # first word of each class in alphabetical order
    width: int                      # outputs of a class; its first one is the rest
    rest_total: np.ndarray          # smoothed count of the words that share each class's rest
    params: list[np.ndarray] | None = None                 # of the trained network

    @property
    def end(self) -> int:
        return len(self.rest_total) * self.width

    def is_rest(self, outputs: np.ndarray) -> np.ndarray:
        return (outputs % self.width == 0) & (outputs < self.end)

    def log_probs(self, parts: list[np.ndarray]) -> np.ndarray:
        """Sum of the normalised log10 probabilities of each piece's outputs, given the CONTEXT before them."""
        r, c, q, bias, class_q, class_bias = self.params
        left = r[None] * c[:, None]
        unused = np.setdiff1d(np.arange(self.end), np.concatenate([self.outputs, np.arange(0, self.end, self.width)]))
        bias = bias.copy()
        bias[unused] = -1e9
        sizes = np.array([len(p) for p in parts])
        stream = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), sizes)
        at = np.flatnonzero(np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= CONTEXT)
        own = np.empty(len(at))
        for i in range(0, len(at), BLOCK):
            places = at[i:i + BLOCK]
            target = stream[places]
            hidden = left[0].take(stream[places - 1], axis=0)
            for k in range(1, CONTEXT):
                hidden += left[k].take(stream[places - 1 - k], axis=0)
            group = target // self.width
            logs = own[i:i + BLOCK]
            logs[:] = _log_softmax(hidden, class_q, class_bias[:, 0], group)
            order = np.argsort(group.astype(np.uint16) if len(class_bias) < 1 << 16 else group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(len(class_bias)))
            for k in range(len(class_bias) - 1):               # the end is alone in its class
                rows = order[cuts[k]:cuts[k + 1]]
                if len(rows):
                    low, high = k * self.width, (k + 1) * self.width
                    logs[rows] += _log_softmax(hidden.take(rows, axis=0), q[low:high], bias[low:high, 0], target[rows] - low)
        return np.bincount(owner[at], weights=own, minlength=len(parts)) / np.log(10)


def _log_softmax(hidden: np.ndarray, q: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of each row's normalised probability of its target, some rows at a time."""
    out = np.empty(len(target))
    step = max(16, CACHED // len(bias))
    q, bias, ones = np.ascontiguousarray(q.T), bias[None], np.ones(len(bias), np.float32)
    for i in range(0, len(target), step):
        scores = hidden[i:i + step] @ q
        scores += bias
        own = scores[np.arange(len(scores)), target[i:i + step]].astype(float)
        with np.errstate(over="ignore"):
            total = (np.exp(scores) @ ones).astype(float)
        odd = ~((total > 1e-30) & (total < 1e37))              # scores far from 0: once more, from the largest on
        if odd.any():
            top = scores[odd].max(axis=1).astype(float)
            total[odd] = np.exp(scores[odd] - top[:, None]).sum(axis=1)
            own[odd] -= top
        out[i:i + step] = own - np.log(total)
    return out


def class_of(first: list[bytes], word: bytes) -> int:
    """The class whose words stand around ``word`` in alphabetical order."""
    return max(0, bisect_right(first, word) - 1)


def classes_of(first: list[bytes], words: list[bytes]) -> np.ndarray:
    return np.maximum(np.fromiter(map(bisect_right, repeat(first), words), np.int64, len(words)) - 1, 0)


def _cut(column: pa.Array) -> list[bytes]:
    """As ``as_bytes`` of a column without nulls, for many short words: cut from one string, as the offsets say."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset).tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in ``docs`` (text), combined before the shuffle."""
    def run(b: pa.RecordBatch) -> dict:
        counts = pc.value_counts(tokens_in(b.column(0))[0])
        return {"word": counts.field(0), "c": counts.field(1)}

    return map_docs(docs.select(_text().alias("text")), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list:
    """Rows (word, c) of the words from some count on, at most ``most``, the most frequent first.

    The count is found from a histogram of some hundred classes, so no more
    than the words themselves come to the driver.
    """
    size = F.floor(F.log2("c") * 8).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()
    least, n = None, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        n += r.n
        if n > most:
            break
        least = r["size"]
    rows = counts.where(size >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r.c, r.word))


def outputs_of(counts: DataFrame, n_docs: int, n_words: int = BASE_WORDS,
               table_words: int = 100_000) -> tuple[Model, Network]:
    """Model without parameters, and an untrained network, from the word ``counts`` of ``n_docs`` documents.

    Up to BASE_TOKENS training tokens ``n_words``
    words have an output of their own, above that with their eighth root.
    """
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    grown = max(1.0, ((sums.n or 0) + n_docs) / BASE_TOKENS) ** GROWTH
    n_words = int(n_words * grown)
    top = frequent_words(counts, max(table_words, n_words))
    single = sorted((r.word.encode(), r.c) for r in top[:n_words])
    n_classes = max(1, math.isqrt(len(single)))
    size = -(-len(single) // n_classes)
    n_classes = -(-len(single) // size) if size else 1
    width, first = size + 1, [w for w, _ in single[::max(size, 1)]] or [b""]
    output = {w: i // size * width + 1 + i % size for i, (w, _) in enumerate(single)}
    rest_c, rest_v = rest_counts(counts, set(output), first)
    outputs = np.array([output.get(w) if w in output else class_of(first, w) * width for w in (r.word.encode() for r in top)], np.int64)
    model = Model(total=int(sums.n or 0) + n_docs, types=int(sums.v) + (n_docs > 0), end_count=n_docs,
                  index={r.word.encode(): i for i, r in enumerate(top)}, counts=np.array([r.c for r in top], float),
                  outputs=outputs, first=first, width=width, rest_total=rest_c + SMOOTH * (rest_v + 1))
    count = np.zeros(model.end + 1)
    count[np.arange(n_classes) * width] = rest_c
    for w, c in single:
        count[output[w]] = c
    count[model.end] = n_docs
    return model, Network(count, width)


class Table:
    """The words of a model's table, to look up the tokens of many texts at once."""

    def __init__(self, model: Model):
        self.model, self.words = model, pa.array([w.decode() for w in model.index], pa.string())
        # of each word of the table, and at last of none: output, log of the count, log of the count's share of a rest
        self.outputs = np.append(model.outputs, 0).astype(np.int32)
        self.logs = np.append(np.log10(model.counts + SMOOTH), 0.0)
        self.log_rest = np.log10(model.rest_total)
        rest = model.is_rest(self.outputs)
        rest[-1] = False
        self.shares = np.zeros(len(rest))
        self.shares[rest] = self.logs[rest] - self.log_rest[self.outputs[rest] // model.width]

    def described(self, texts: pa.Array) -> tuple[list[np.ndarray], list[pa.Array]]:
        """Each text's outputs with the end, and the columns n_tokens, known, logs, part, rare, times of ``looked_up``."""
        m, n = self.model, len(texts)
        tokens, sizes = tokens_in(texts)
        at = pc.fill_null(pc.index_in(tokens, value_set=self.words.cast(tokens.type)), -1).to_numpy()
        doc, missing = np.repeat(np.arange(n), sizes), np.flatnonzero(at < 0)
        outputs, shares = self.outputs.take(at, mode="wrap"), self.shares.take(at, mode="wrap")
        distinct = pc.dictionary_encode(tokens.take(pa.array(missing)))
        number, distinct = distinct.indices.to_numpy(), _cut(distinct.dictionary)
        group = classes_of(m.first, distinct)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(SEED)), np.uint64, len(distinct)).view(np.int64)
        outputs[missing] = (group * m.width)[number]
        shares[missing] = -self.log_rest[group][number]
        rare = doc[missing]
        known = sizes - np.bincount(rare, minlength=n) + (m.end_count > 0)
        logs = np.bincount(doc, weights=self.logs.take(at, mode="wrap"), minlength=n) + np.log10(m.end_count + SMOOTH)
        part = np.bincount(doc, weights=shares, minlength=n)
        keys, times = np.unique(rare * max(1, len(distinct)) + number, return_counts=True)
        rare, number = np.divmod(keys, max(1, len(distinct)))
        cuts = pa.array(np.searchsorted(rare, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (hashes[number], times.astype(np.int32))]
        ends = np.cumsum(sizes + 1)
        stream = np.full(len(tokens) + n, m.end, np.int32)
        stream[np.arange(len(tokens)) + doc] = outputs
        return np.split(stream, ends[:-1]), [*map(pa.array, (sizes + 1, known, logs, part)), *lists]


def looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """Pieces (row, learn, doc_id, out) of the output sequences of all ``rows`` (row, learn, doc_id, text), written;
    a row's first piece also has what its tokens' counts give (n_tokens, known, logs, part, rare, times)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = {"row": pa.int64(), "learn": pa.bool_(), "doc_id": pa.int64(), "out": pa.list_(pa.int32()), "n_tokens": pa.int64(),
             "known": pa.int64(), "logs": pa.float64(), "part": pa.float64(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for b in batches:
            for some in portions(b, 3):
                outputs, first = table.described(some.column(3))
                parts = [pieces(x, table.model.end) for x in outputs]
                of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                later, parts = np.diff(of, prepend=-1) == 0, [p for x in parts for p in x]
                ends = np.cumsum([0, *map(len, parts)])
                columns = [some.column(i).take(pa.array(of)) for i in range(3)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts))))
                columns += [x.take(pa.array(of, mask=later)) for x in first]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(columns, kinds.values())], names=list(kinds))

    small_batches(rows.sparkSession)
    return materialize(rows.select("row", "learn", "doc_id", "text").mapInArrow(
        run, "row long, learn boolean, doc_id long, out array<int>, n_tokens long, known long, logs double, part double, "
             "rare array<long>, times array<int>"), "lm-pieces")


def train(docs: DataFrame, counts: DataFrame, n_docs: int, **options) -> Model:
    """Model from the training documents ``docs`` (doc_id, text), their word ``counts`` and number.

    The counts and the network cover every token of all training documents; long texts are cut into pieces.
    """
    model, net = outputs_of(counts, n_docs, **options)
    fit(looked_up(_rows(docs, F.lit(True)), model), net, model.total)
    model.params = net.params
    return model


def _rows(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))


def rest_counts(counts: DataFrame, single: set[bytes], first: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of the words that are not in ``single``: sum of the counts and number of words by class."""
    def run(b: pa.RecordBatch) -> dict:
        others = b.filter(pc.invert(pc.is_in(b.column(0), value_set=own.cast(b.column(0).type))))
        k, n = classes_of(first, _cut(others.column(0))), others.column(1).to_numpy()
        c = np.zeros(len(first), np.int64)
        np.add.at(c, k, n)
        return {"k": np.arange(len(first), dtype=np.int32), "c": c, "v": np.bincount(k, minlength=len(first))}

    own = pa.array([w.decode() for w in single], pa.string())
    sums = map_docs(counts.select("word", "c"), run, "k int, c long, v long").groupBy("k").agg(F.sum("c"), F.sum("v"))
    c, v = np.zeros(len(first)), np.zeros(len(first))
    for k, n, m in sums.collect():
        c[k], v[k] = n, m
    return c, v


def score(docs: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Learned from the rows where ``learn`` (a condition on doc_id) holds.  A
    null text counts as empty: its only token is the end.  base_score is the
    smoothed unigram's log10 probability, score the model's.  Repeated rows
    and null doc_ids are returned as given; other columns are not looked at.
    An empty table gives no rows; without training rows every word is unknown.
    """
    rows = _rows(docs, learn)
    learned = rows.where("learn")
    n_docs = learned.count()
    counts = materialize(count_words(learned), "word-counts")
    model, net = outputs_of(counts, n_docs, **options)
    found = looked_up(rows, model)
    fit(found.where("learn"), net, model.total)
    model.params = net.params
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = model.total + SMOOTH * (model.types + 1)

    def run(b: pa.RecordBatch) -> dict:
        column = b.column(1)
        values, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
        return {"row": b.column(0), "log": _by_size(shared.value, np.split(values, ends[:-1]))}

    logs_of = map_docs(found.select("row", "out"), run, "row long, log double").groupBy("row").agg(F.sum("log").alias("log"))
    rare = (found.where("n_tokens is not null").select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")))
    by_hash = counts.select(F.xxhash64("word").alias("word"), "c")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (rare.join(by_hash, "word", "left")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("rest"),
                                F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more")))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("rest", F.lit(0.0))
    scored = found.where("n_tokens is not null").select("row", "doc_id", "n_tokens", "known", "logs", "part")
    return (scored.join(logs_of, "row").join(rest, "row", "left")
            .select("doc_id", "n_tokens", (F.col("known") + more).alias("n_known"),
                    F.lit(model.total).cast("long").alias("train_tokens"),
                    (F.col("logs") + logs - F.col("n_tokens") * float(np.log10(types))).alias("base_score"),
                    (F.col("part") + F.col("log") + logs).alias("score")))


def _by_size(model: Model, parts: list[np.ndarray], most: int = 500_000) -> list[float]:
    """Log10 probabilities of the pieces, some hundred thousand outputs at a time."""
    out: list[float] = []
    i = 0
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and (j == i or n + len(parts[j]) <= most):
            n += len(parts[j])
            j += 1
        out += model.log_probs(parts[i:j]).tolist()
        i = j
    return out
