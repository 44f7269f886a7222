r"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word enters as a pair: a hashed word vector and the sum of hashed vectors of its character 3- to 5-grams, over the root
of their number. Vectors start from the log-odds of the labels, and only inputs that several training texts share are learnt.
Attention pools the states of both directions, and nothing else: what the vectors say reaches the verdict through the gates
of the recurrent layer. The parameters of the last steps are averaged.
Windows of WINDOW words that overlap by half cover every text whole; a text's score is that of its worst window.
The network learns in one task, from at most about SAMPLE labelled texts of at most SAMPLE_BYTES each, so what it holds is
bounded; its parameters (about 1 MB) go to the tasks that read the texts and score them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, held_out, pieces, release
from .words import Words, chunks, mix

WINDOW, STRIDE = 32, 16
UNITS, VECTOR, BUCKETS = 8, 8, 1 << 14
THRESHOLD = 0.3
#: Bounds of the training sample: texts of each label, bytes of a text, windows of a text in one epoch.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 10
BATCH, RATE = 128, 0.005
#: Rounds over the sample; share of word vectors left out in a step.
EPOCHS, DROP = 9, 0.5
#: What the first unit of each direction begins with: weight of the log-odds in its state, and of its state in attention and verdict.
CARRY, POOL = 0.8, 3.0
#: Share of each step in the average of the parameters.
MEAN = 0.02
#: The first coordinate of a vector starts at so many times the log-odds of the labels of the texts that hold the input.
START = {"word": 0.3, "gram": 0.1}
#: Share by which each step shrinks the vectors, over the rate.
DECAY = 0.1
#: Words and n-grams of fewer training texts keep the zero vector of unknown ones, so that no text is learnt by heart.
LEAST_TEXTS = 4


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Inputs:
    """The distinct words of a chunk: number of each word in order, buckets of words, and of their character n-grams."""

    def __init__(self, w: Words):
        _, first, self.number = np.unique(w.hash, return_index=True, return_inverse=True)
        self.number = self.number.astype(np.int32)
        self.word = (w.hash[first] >> np.uint64(50)).astype(np.int64)
        size = (w.end - w.start)[first] + 2
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(first)), size)
        at = np.arange(int(size.sum())) - begin[owner]
        buf = np.full(len(owner), 1, np.uint64)  # the mark at both ends of a word
        inner = (at > 0) & (at < size[owner] - 1)
        buf[inner] = _lower(w.data[w.start[first][owner[inner]] + at[inner] - 1])
        grams, owners, code = [], [], buf.copy()
        for n in range(2, 6):
            if len(buf) < n:
                break
            code = code[: len(buf) - n + 1] << np.uint64(8) | buf[n - 1 :]
            if n >= 3:
                ok = owner[: len(code)] == owner[n - 1 :]
                grams.append((mix(code[ok] + np.uint64(n << 56)) >> np.uint64(50)).astype(np.int64))
                owners.append(owner[: len(code)][ok])
        gram, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners))
        o = np.argsort(own, kind="stable")
        self.gram, self.owner = gram[o].astype(np.int16), own[o].astype(np.int32)
        self.many = np.sqrt(np.maximum(np.bincount(self.owner, minlength=len(first)), 1)).astype(np.float32)


def windows(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of the windows over the words of a chunk, whose rows are given in order; each text is covered whole."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    n = np.diff(np.r_[begin, len(row)])
    many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    which = np.repeat(np.arange(len(begin)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return begin[which] + k * STRIDE, row[begin][which]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters as a dictionary of float32 arrays; directions are the first axis of the recurrent ones."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        h, e = UNITS, 2 * VECTOR
        self.p = {"word": np.zeros((BUCKETS, VECTOR), np.float32), "gram": np.zeros((BUCKETS, VECTOR), np.float32), "x": f(0.4, 2, e, 3 * h), "bx": f(0.01, 2, 3 * h), "u": f(0.3, 2, h, 3 * h), "v": f(0.3, 2 * h), "w": f(0.5, 2 * h), "b": np.full(1, -1.0, np.float32)}
        # the first unit of each direction begins as one that carries the log-odds of the word it stands on, and attention and
        # the verdict begin with it
        self.p["x"][:, :, [0, h, 2 * h]] *= 0.1
        self.p["x"][:, 0, 2 * h] = self.p["x"][:, VECTOR, 2 * h] = CARRY
        self.p["bx"][:, 0] = -2
        self.p["u"][:, :, [0, h, 2 * h]] *= 0.1
        self.p["v"][[0, h]] = self.p["w"][[0, h]] = POOL

    def vectors(self, i: Inputs) -> np.ndarray:
        out = np.zeros((len(i.word), 2 * VECTOR), np.float32)
        out[:, :VECTOR] = self.p["word"][i.word]
        if len(i.gram):
            begin = np.flatnonzero(np.r_[True, i.owner[1:] != i.owner[:-1]])
            out[i.owner[begin], VECTOR:] = np.add.reduceat(self.p["gram"][i.gram], begin, axis=0)
        out[:, VECTOR:] /= i.many[:, None]
        return out

    def forward(self, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; inputs: word vectors; ids, mask: WINDOW x windows."""
        t, b = ids.shape
        h = UNITS
        states = np.zeros((t, b, 2 * h), np.float32)
        saved = []
        for d in (0, 1):
            g = inputs @ self.p["x"][d] + self.p["bx"][d]
            state = np.zeros((b, h), np.float32)
            steps = range(t) if d == 0 else range(t - 1, -1, -1)
            for s in steps:
                a, q = g[ids[s]], state @ self.p["u"][d]
                zr = _sigmoid(a[:, : 2 * h] + q[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(a[:, 2 * h :] + r * q[:, 2 * h :])
                new = n + z * (state - n)
                new = np.where(mask[s][:, None], new, state)
                if keep:
                    saved.append((d, s, state, z, r, n, q[:, 2 * h :]))
                state = new
                states[s, :, d * h : (d + 1) * h] = state
        score = states @ self.p["v"]
        score = np.where(mask, score, -1e9)
        att = np.exp(score - score.max(axis=0))
        att /= att.sum(axis=0)
        value = states @ self.p["w"]
        logit = (att * value).sum(axis=0) + self.p["b"][0]
        return (logit, (states, att, value, saved)) if keep else logit

    def gradients(self, i: Inputs, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray, stay: np.ndarray) -> dict[str, np.ndarray]:
        """stay: 0 for the words whose word vector is left out, so that characters have to do."""
        x = self.vectors(i)
        x[:, :VECTOR] *= stay[:, None]
        logit, (states, att, value, saved) = self.forward(x, ids, mask, keep=True)
        p, h = self.p, UNITS
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        dvalue = att * dl
        dscore = att * (value * dl - (att * value).sum(axis=0) * dl)
        ds, dx = np.zeros_like(states), np.zeros_like(x)
        g["b"][0] = dl.sum()
        for k, d in (("w", dvalue), ("v", dscore)):
            ds += d[:, :, None] * p[k]
            g[k] = np.einsum("tb,tbh->h", d, states)
        carry = np.zeros((ids.shape[1], h), np.float32)
        dg = np.zeros((len(x), 3 * h), np.float32)
        last = 1
        for d, s, prev, z, r, n, qn in reversed(saved):
            if d != last:  # the forward direction comes after all of the backward one
                g["x"][1], g["bx"][1], dx = x.T @ dg, dg.sum(axis=0), dx + dg @ p["x"][1].T
                carry, dg, last = np.zeros_like(carry), np.zeros_like(dg), d
            total = carry + ds[s, :, d * h : (d + 1) * h]
            m = mask[s][:, None]
            own = np.where(m, total, 0)
            dn = own * (1 - z) * (1 - n * n)
            dz = own * (prev - n) * z * (1 - z)
            dr = dn * qn * r * (1 - r)
            gate = np.concatenate([dz, dr, dn], axis=1)
            q = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(dg, ids[s], gate)
            g["u"][d] += prev.T @ q
            carry = np.where(m, own * z + q @ p["u"][d].T, total)
        g["x"][0], g["bx"][0], dx = x.T @ dg, dg.sum(axis=0), dx + dg @ p["x"][0].T
        np.add.at(g["word"], i.word, dx[:, :VECTOR] * stay[:, None])
        np.add.at(g["gram"], i.gram, (dx[:, VECTOR:] / i.many[:, None])[i.owner])
        return g


def _laid(rows: np.ndarray, i: Inputs, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask), WINDOW x windows; rows: the row of each word."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    inside = np.minimum(at, len(rows) - 1)
    mask = (at < len(rows)) & (rows[inside] == row[None, :])
    return i.number[inside], mask


def window_scores(net: Network, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, logit) of every window of a chunk."""
    start, row = windows(w.row)
    if not len(start):
        return row, np.zeros(0, np.float32)
    i = Inputs(w)
    x = net.vectors(i)
    out = []
    for a in range(0, len(start), 2048):
        ids, mask = _laid(w.row, i, start[a : a + 2048], row[a : a + 2048])
        out.append(net.forward(x, ids, mask))
    return row, np.concatenate(out)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """A network from labelled texts; with one label or none it keeps its first parameters and a low score."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["b"][0] = -9
        return net
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.string())
    # chunks of the sample, each with its inputs, windows and the rows they belong to
    parts = []
    for w in chunks(column):
        start, row = windows(w.row)
        if len(start):
            parts.append((w.row, Inputs(w), start, row))
    learnt = {}
    for name, held in (("word", lambda rows, i: (i.word[i.number], rows)), ("gram", _grams_by_text)):
        many = np.zeros((2, BUCKETS))
        for rows, i, _, _ in parts:
            bucket, row = held(rows, i)
            bucket, row = np.divmod(np.unique(bucket * len(y) + row), len(y))
            many += np.stack([np.bincount(bucket[y[row] == k], minlength=BUCKETS) for k in (0, 1)])
        learnt[name] = many.sum(axis=0) >= LEAST_TEXTS
        share = np.array([1 - y.mean(), y.mean()])[:, None]
        odds = np.log((many[1] + share[1]) / share[1]) - np.log((many[0] + share[0]) / share[0])
        net.p[name][:, 0] = np.where(learnt[name], START[name] * odds, 0)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step, mean = 0, {k: v.copy() for k, v in net.p.items()}
    weight_of = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(parts)):
            rows, i, start, row = parts[k]
            # the worst window stands for its text, by the odds of its words and then by the network; for clean texts others too
            x = net.vectors(i)
            if epoch < 2:
                odds = np.r_[0, np.cumsum(np.maximum(x[:, 0] + x[:, VECTOR] - 1, 0)[i.number])]
                logit = odds[np.minimum(start + WINDOW, len(rows))] - odds[start]
            else:
                logit = np.concatenate([net.forward(x, *_laid(rows, i, start[a : a + 2048], row[a : a + 2048])) for a in range(0, len(start), 2048)])
            _, first = np.unique(row, return_index=True)
            many = np.diff(np.r_[first, len(row)])
            o = np.lexsort((-logit, row))
            more = np.concatenate([first + rng.integers(0, many) for _ in range(2)])
            chosen = np.r_[o[first], more[y[row[more]] == 0]]
            for a in range(0, len(chosen), BATCH):
                c = chosen[a : a + BATCH]
                ids, mask = _laid(rows, i, start[c], row[c])
                used, number = np.unique(ids, return_inverse=True)
                g = net.gradients(_subset(i, used), number.reshape(ids.shape), mask, y[row[c]], weight_of[row[c]], (rng.random(len(used)) >= DROP).astype(np.float32))
                step += 1
                rate = RATE * min(1.0, 2.0 * (1 - epoch / EPOCHS))
                for name, grad in g.items():
                    if name in learnt:
                        grad *= learnt[name][:, None]
                    m1[name] += 0.1 * (grad - m1[name])
                    m2[name] += 0.001 * (grad * grad - m2[name])
                    if name in learnt:
                        net.p[name] *= 1 - rate * DECAY
                    net.p[name] -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
                    mean[name] += max(1 / step, MEAN) * (net.p[name] - mean[name])
    net.p = mean
    return net


def _grams_by_text(rows: np.ndarray, i: Inputs) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the n-grams of the distinct words of each text."""
    pair = np.unique(rows.astype(np.int64) * len(i.word) + i.number)
    word, row = pair % len(i.word), pair // len(i.word)
    size = np.bincount(i.owner, minlength=len(i.word))
    begin, many = (np.cumsum(size) - size)[word], size[word]
    at = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return i.gram[at].astype(np.int64), np.repeat(row, many)


def _subset(i: Inputs, used: np.ndarray) -> Inputs:
    out = object.__new__(Inputs)
    new = np.full(len(i.word), -1)
    new[used] = np.arange(len(used))
    own = new[i.owner] >= 0
    out.word, out.gram, out.owner, out.many = i.word[used], i.gram[own], new[i.owner[own]], i.many[used]
    return out


def sample(df: DataFrame, labels: DataFrame, learn, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y): about SAMPLE texts of each label at most, by hash of the id, from the rows that learn admits."""
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).filter("lid is not null and y in (0, 1)")
    own = own.groupBy("lid").agg(F.max("y").alias("y")).withColumnRenamed("lid", id_col).filter(learn).withColumnRenamed(id_col, "lid")
    many = dict(own.groupBy("y").count().collect())
    share = {k: min(1.0, SAMPLE / n) for k, n in many.items()}
    part = F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    chosen = own.filter(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < part * 1_000_000)  # about SAMPLE rows of each label
    text = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # of rows equal in id and text one is learnt from, and one text of an id that has several
    once = text.join(F.broadcast(chosen), F.col("id") == F.col("lid")).groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return once.select("id", "text", "y")


def fitted(rows: DataFrame) -> Network:
    """The network that one task trains on rows(id, text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        x = pa.Table.from_batches(t).sort_by([("id", "ascending"), ("text", "ascending")]) if t else None
        net = train(x.column("text").to_pylist(), x.column("y").to_pylist()) if x else Network()
        names = list(net.p)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([net.p[k].tobytes() for k in names], pa.binary())], ["name", "data"])

    net = Network()
    for name, data in rows.repartition(1).mapInArrow(run, "name string, data binary").collect():  # the parameters
        net.p[name] = np.frombuffer(bytes(data), np.float32).reshape(net.p[name].shape)
    return net


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from THRESHOLD on); with keep, those columns of df instead of the id.

    Rows whose crc32 of the id mod 4 is 2 are not learnt from. Null and empty texts score 0; texts are read whole; repeated
    rows and null ids are scored as they come; labels with null or other values, or for absent ids, count for nothing; an id
    with both labels is toxic.
    """
    spark = df.sparkSession
    net = fitted(sample(df, labels, ~held_out(id_col, 4, 2), id_col, text_col, label_col))
    release(spark)
    sent = spark.sparkContext.broadcast(net)
    cols = list(keep) if keep is not None else [id_col]
    n = len(cols)
    once = text_col in cols and field_type(df, text_col) == "string"  # a text that is kept isn't sent twice
    at = cols.index(text_col) if once else n + 1
    text = [] if once else [F.col(text_col).cast("string").alias("__cataloom_text")]
    src = df.select(*[F.col(f"`{c}`") for c in cols], held_out(id_col, 4, 2).alias("__cataloom_held"), *text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.zeros(b.num_rows)
            for w in chunks(b.column(at)):
                row, logit = window_scores(sent.value, w)
                np.maximum.at(score, row, 1 / (1 + np.exp(-logit.astype(np.float64))))
            made = [b.column(n), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            out = pa.RecordBatch.from_arrays([*b.columns[:n], *made], [*cols, "held_out", "score", "predicted"])
            yield from pieces(out, at) if once else (out,)

    fields = ", ".join(f"`{c}` {field_type(df, c)}" for c in cols)
    return src.mapInArrow(run, f"{fields}, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are not predicted toxic, with the columns of df; see toxicity for the cases."""
    names = {c: f"__cataloom_{i}" for i, c in enumerate(df.columns)}
    d = df.withColumnsRenamed(names)
    lab = labels.withColumnRenamed(id_col, names[id_col])
    scored = toxicity(d, lab, names[id_col], names[text_col], keep=tuple(names.values()))
    return scored.filter("predicted = 0").select(*[F.col(v).alias(k) for k, v in names.items()])
