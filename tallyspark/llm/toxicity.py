"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (3 to 8, with word edges); n-grams are
hashed to rows of one embedding table. The mean of a window's word vectors goes
into a two-class softmax. Table and softmax are trained jointly in numpy, by Adam's steps from a random start: nothing but this
training says which n-grams are toxic. A
text's logit in training is the soft maximum over its windows of `WINDOW` words, which sharpens from their mean to nearly the
largest, and its score comes from its most toxic windows, so a few words
in a long text count. Unseen misspellings share n-grams with known words.

Only labelled rows outside the held-out fold are learned from, at most `SAMPLE` of each class, and of these whole texts of
`SAMPLE_BYTES` a class. A fifth of them is kept apart to calibrate the scores.

Cases: a null or empty text has a score from the intercept alone; texts of any
length are read whole; ties and repeated rows score alike; without labelled
rows of both classes every score is 0.5; labels of unknown documents and null labels are ignored; of a document's several labels
the toxic one counts; a null id has no fold (held_out is null) and a score like others; an empty table gives an empty table;
extra columns, whatever their names, are not read, and pass through `drop_toxic`.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm import textkernel as tk
from tallyspark.llm.shared import give_back

WINDOW, STRIDE, TOP = 12, 6, 4
GRAMS = (3, 4, 5, 6, 8)
TABLE_BITS = 19
DIMENSION = 6
#: Bounds of the training sample: labelled documents of each class, and bytes of their texts, which are whole.
SAMPLE, SAMPLE_BYTES = 2500, 16 << 20
#: Training: words of a step (fewer, where a pass would have under STEPS), passes, step size, share of the texts that must use an n-gram, weight decay, and the soft
#: maximum's sharpness in the first and the last pass.
STEP_WORDS, STEPS, EPOCHS, RATE, RARE, DECAY, SHARPNESS = 1 << 14, 64, 5, 0.02, 0.0015, 1e-5, (0.5, 3.0)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


#: A plain tuple, so that a broadcast needs no class on the workers: each n-gram row's logit (its
#: embedding times the softmax's difference), the bias, and the calibration (weights of the
#: strongest window, of the strongest few, of the logarithm of the number of windows, and of 1).
Model = tuple[np.ndarray, float, np.ndarray]


def word_grams(data: np.ndarray, offsets: np.ndarray):
    """Per n: table rows of the n-grams at every byte; and the words' starts, ends, firsts.

    Word edges are the bytes around a word, read as spaces.
    """
    low = tk.LOWER[data]
    starts, ends, firsts = tk.words(data, offsets)
    padded = np.full(len(low) + 2 * max(GRAMS), 0x20, dtype=np.uint32)
    padded[1 : len(low) + 1] = np.where(tk.SPACE[low], 0x20, low)
    return padded, starts, ends, firsts


def rows_of(padded: np.ndarray, n: int) -> np.ndarray:
    """Table rows of the n-grams that start at each byte."""
    size = len(padded) - max(GRAMS)
    h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ padded[j : j + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - TABLE_BITS)


def windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index at which each window starts and ends, and each text's first window."""
    counts = np.diff(firsts)
    made = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    first = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(made)), made)
    start = firsts[text] + (np.arange(first[-1]) - first[text]) * STRIDE
    return start, np.minimum(start + WINDOW, firsts[text + 1]), first


def strongest(model_logit: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the largest window logit, the mean of the TOP largest, and the number of windows."""
    padded, starts, ends, firsts = word_grams(data, offsets)
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for n in GRAMS:
        sums = np.concatenate([[0.0], np.cumsum(model_logit[rows_of(padded, n)], dtype=np.float64)])
        own = np.maximum(0, ends - starts + 3 - n)  # in padded, the word with its edges is [start, end + 2)
        total += sums[starts + own] - sums[starts]
        count += own
    word = np.concatenate([[0.0], np.cumsum(total / np.maximum(count, 1))])
    a, b, first = windows(firsts)
    value = bias + (word[b] - word[a]) / np.maximum(b - a, 1)
    made = np.diff(first)
    text = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((-value, text))
    rank = np.arange(len(value)) - first[text]
    best = order[rank < TOP]
    count = np.minimum(made, TOP)
    # windows that a short text lacks count as plain ones
    few = (np.bincount(text[best], value[best], minlength=len(made)) + (TOP - count) * bias) / TOP
    top = np.full(len(made), bias)
    top[made > 0] = value[order[first[:-1][made > 0]]]
    return top, few, made


def strongest_of(logit: np.ndarray, bias: float, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a list of texts, a chunk at a time."""
    found = [strongest(logit, bias, data, offsets) for _, _, data, offsets in tk.chunks(pa.array(texts, pa.string()))]
    return tuple(np.concatenate(x) for x in zip(*found))


#: Distinct words, one after another with a space between: the bytes, and where each word starts and ends.
Spelled = tuple[np.ndarray, np.ndarray, np.ndarray]


def spelled(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Spelled:
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    for at in range(0, len(ends), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[expanded(ends[part] - sizes[part], sizes[part])[1]] = data[expanded(begin[part], sizes[part])[1]]
    return out, ends - sizes, ends


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Spelled, np.ndarray]:
    """Every text's words by number, the texts' first words, the distinct words, and in how many texts each is."""
    column = pa.array(texts, pa.string())
    data, offsets = tk.raw(column)
    seen, begin, sizes, places, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], [np.zeros(0, np.int64)]
    for row, _, part, edges in tk.chunks(column):
        starts, ends, firsts = tk.words(part, edges)
        counts.append(np.diff(firsts))
        if len(starts):
            # a chunk's distinct words first, so that all words are never sorted at once
            values, index, place = np.unique(tk.span_hashes(part, starts, ends), return_index=True, return_inverse=True)
            seen.append(values)
            begin.append((starts[index] + offsets[row]).astype(np.int32))
            sizes.append((ends - starts)[index].astype(np.int32))
            places.append(place.astype(np.int32))
    values, index, number = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
    n, cuts = len(values), np.cumsum([len(s) for s in seen])
    word = np.concatenate([np.zeros(0, np.int32), *(number[cut : cut + len(s)][p].astype(np.int32) for cut, s, p in zip(cuts, seen[1:], places))])
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    holders = np.zeros(n, np.int64)
    for at in range(0, len(texts), 256):
        cuts = first[at : at + 257]
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        holders += np.bincount(np.unique(text * n + word[cuts[0] : cuts[-1]]) % n, minlength=n) if n else 0
    return word, first, spelled(data, np.concatenate(begin)[index].astype(np.int64), np.concatenate(sizes)[index].astype(np.int64)), holders


def grams_of(words: Spelled, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in chosen, table row) of all n-grams of the chosen words."""
    data, starts, ends = words
    padded, starts, ends, _ = word_grams(*(lambda d: (d, np.array([0, len(d)])))(spelled(data, starts[chosen], ends[chosen] - starts[chosen])[0]))
    owner, rows = [], []
    for n in GRAMS:
        who, at = expanded(starts, np.maximum(0, ends - starts + 3 - n))
        owner.append(who)
        rows.append(rows_of(padded, n)[at])
    return np.concatenate(owner), np.concatenate(rows)


def kept_rows(words: Spelled, holders: np.ndarray, least: float) -> np.ndarray:
    """The table rows of the n-grams that enough texts use. Rarer ones would only memorise single texts."""
    uses = np.zeros(1 << TABLE_BITS)
    # in blocks of words, as the n-grams of all words would be many times the texts
    for at in range(0, len(holders), 1 << 14):
        own = np.arange(at, min(at + (1 << 14), len(holders)))
        owner, rows = grams_of(words, own)
        uses += np.bincount(rows, holders[own][owner], minlength=len(uses))
    return np.flatnonzero(uses >= least)


def expanded(begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers begin[i], begin[i] + 1, ... (counts[i] of them), with their i."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) + np.repeat(begin - np.cumsum(counts) + counts, counts)


class Adam:
    """Adaptive steps of an array, or of some of its rows."""

    def __init__(self, value: np.ndarray, rate: float) -> None:
        self.value, self.rate = value, rate
        self.mean, self.square, self.steps = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.steps += 1
        self.mean[rows] = 0.9 * self.mean[rows] + 0.1 * grad
        self.square[rows] = 0.99 * self.square[rows] + 0.01 * grad * grad
        fix = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.value[rows] -= self.rate * fix * self.mean[rows] / (np.sqrt(self.square[rows]) + 1e-6)


def learn(texts: list[str], toxic: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Each table row's logit and the bias, after joint training of table and softmax from a random start.

    A text's logit is the soft maximum of its windows' logits: their mean at first, when nothing is known
    yet, and close to the largest in the end, as few words of a toxic text are toxic.
    """
    word, first, words, holders = vocabulary(texts)
    kept = kept_rows(words, holders, max(3, RARE * len(texts)))
    number = np.full(1 << TABLE_BITS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    del texts, holders
    table = Adam(rng.normal(0, 0.1, (len(kept), DIMENSION)).astype(np.float32), RATE)
    softmax = Adam(rng.normal(0, 1, (2, DIMENSION)).astype(np.float32), RATE)
    bias = Adam(np.zeros(2, np.float32), RATE)
    weight = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9))
    some = np.flatnonzero(np.diff(first) > 0)
    step = max(1, min(STEP_WORDS, len(word) // STEPS))
    for epoch in range(epochs):
        sharp = SHARPNESS[0] + (SHARPNESS[1] - SHARPNESS[0]) * epoch / max(1, epochs - 1)
        order = rng.permutation(some)
        sizes = np.cumsum(np.diff(first)[order])
        for own in np.split(order, np.flatnonzero(np.diff(sizes // step)) + 1):
            counts = first[own + 1] - first[own]
            _, at = expanded(first[own], counts)
            here, local = np.unique(word[at], return_inverse=True)
            # word vectors: the mean of their n-grams' rows
            entry_word, gram = grams_of(words, here)
            scale = 1 / np.bincount(entry_word, minlength=len(here))
            on = number[gram] >= 0
            entry_word, gram = entry_word[on], number[gram[on]]
            scale = scale[entry_word]
            vectors = np.stack([np.bincount(entry_word, table.value[gram, d] * scale, minlength=len(here)) for d in range(DIMENSION)], axis=1)
            a, b, window = windows(np.concatenate([[0], np.cumsum(counts)]))
            total = np.concatenate([np.zeros((1, DIMENSION)), np.cumsum(vectors[local], axis=0)])
            width = (b - a)[:, None]
            mean = (total[b] - total[a]) / width
            both = mean @ softmax.value.T + bias.value
            logit = both[:, 1] - both[:, 0]
            made = np.diff(window)
            of = np.repeat(np.arange(len(own)), made)
            top = np.maximum.reduceat(logit, window[:-1])
            pull = np.exp(sharp * (logit - top[of]))
            sums = np.add.reduceat(pull, window[:-1])
            value = top + np.log(sums / made) / sharp
            error = weight[own] * (1 / (1 + np.exp(-np.clip(value, -30, 30))) - toxic[own]) / len(own)
            back = error[of] * pull / sums[of]
            back = np.stack([-back, back], axis=1)
            # to each word of a window its share, then to the word's n-grams
            change = np.zeros((len(at) + 1, DIMENSION))
            slope = back @ softmax.value / width
            for d in range(DIMENSION):
                change[:, d] = np.bincount(a, slope[:, d], minlength=len(at) + 1) - np.bincount(b, slope[:, d], minlength=len(at) + 1)
            flow = np.cumsum(change[:-1], axis=0)
            by_word = np.stack([np.bincount(local, flow[:, d], minlength=len(here)) for d in range(DIMENSION)], axis=1)
            touched = np.flatnonzero(np.bincount(gram, minlength=len(kept)))
            grad = np.stack([np.bincount(gram, by_word[entry_word, d] * scale, minlength=len(kept))[touched] for d in range(DIMENSION)], axis=1)
            table.step((grad + DECAY * table.value[touched]).astype(np.float32), touched)
            softmax.step((back.T @ mean).astype(np.float32))
            bias.step(back.sum(axis=0).astype(np.float32))
    out = np.zeros(1 << TABLE_BITS, np.float32)
    out[kept] = table.value @ (softmax.value[1] - softmax.value[0])
    return out, float(bias.value[1] - bias.value[0])


def train(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Learn table and softmax; a fifth of each class is kept apart to calibrate scores. prior is the share of toxic texts
    among all labelled ones."""
    rng = np.random.default_rng(seed)
    apart = np.zeros(len(texts), dtype=bool)
    for label in (0, 1):
        apart[rng.permutation(np.flatnonzero(toxic == label))[::5]] = True
    kept, kept_toxic = [t for t, x in zip(texts, apart) if x], toxic[apart]
    texts, toxic = [t for t, x in zip(texts, apart) if not x], toxic[~apart]
    gc.collect()
    logit, bias = learn(texts, toxic, rng, epochs)
    if min(np.bincount(kept_toxic, minlength=2)) < 20 and len(set(toxic.tolist())) == 2:
        kept, kept_toxic = texts + kept, np.concatenate([toxic, kept_toxic])
    return logit, bias, calibrate(*strongest_of(logit, bias, kept), kept_toxic, prior)


def features(top: np.ndarray, few: np.ndarray, made: np.ndarray) -> np.ndarray:
    return np.stack([np.clip(top, -50, 50), np.clip(few, -50, 50), np.log1p(made), np.ones(len(top))], axis=1)


def calibrate(top: np.ndarray, few: np.ndarray, made: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """A logistic regression by Newton's steps, lightly ridged, with the classes at their prior shares."""
    x, y = features(top, few, made), toxic.astype(np.float64)
    v = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        z, w = x[:, used], np.zeros(used.sum())
        ridge = 0.1 * np.eye(len(w))
        ridge[-1, -1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (v * p * (1 - p))[:, None]).T @ z + ridge
            w -= np.linalg.solve(h, z.T @ (v * (p - y)) + ridge @ w)
        out = np.zeros(x.shape[1])
        out[used] = w
        # more toxic windows never make a text less toxic
        wrong = np.flatnonzero(out[:2] < 0)
        if not len(wrong):
            return out
        used[wrong[np.argmin(out[wrong])]] = False


def score(model: Model | None, texts: pa.Array) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model is not None:
        logit, bias, scale = model
        for first, end, data, offsets in tk.chunks(texts):
            x = features(*strongest(logit, bias, data, offsets)) @ scale
            out[first:end] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1) -> Model | None:
    """Train on at most SAMPLE documents of each class, chosen by hash among the
    labelled rows outside the held-out fold, and of these on as many as SAMPLE_BYTES hold for a
    class: whole texts, in the order of the hash. That also bounds the broadcast. Rows that
    repeat an id count as one sample each, within the same bounds."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(fold)) != held)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).unionAll(known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    sofar = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("bytes", sofar).where(F.col("bytes") <= SAMPLE_BYTES).select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(2 * SAMPLE).collect()
    toxic, texts = np.array([r.toxic for r in rows]), [r.text for r in rows]
    del rows
    if len(set(toxic.tolist())) < 2:
        return None
    prior = known.agg(F.avg("toxic")).first()[0]
    model = train(texts, toxic, float(prior))
    # the driver goes on with other work: without this it keeps what the training took at most
    del texts
    gc.collect()
    give_back()
    return model


def apply(docs: DataFrame, model: Model | None, threshold: float = 0.7, fold: int = 3, held: int = 1) -> DataFrame:
    """Scores for all documents: one pass, no shuffle. The broadcast model has a fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            held_out = [None if i is None else zlib.crc32(str(i).encode()) % fold == held for i in ids.to_pylist()]
            s = score(shipped.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(held_out, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return apply(docs, fit(docs, labels), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier does not reject, in one pass over them."""
    model = fit(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(shipped.value, batch.column(names.index("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)
