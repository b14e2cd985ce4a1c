"""Language of words and texts by a linear-chain conditional random field.

Every word with a letter is a node; its features are hashed affixes and letter
n-grams, and whether it is in a language's lexicon of frequent training words.
Transitions between neighbouring words' languages are learned with the features,
by gradient ascent on the likelihood, gradients coming from forward-backward
passes. Documents have one language each, so training sequences are spliced from
pieces of documents of several languages: that is what teaches the transitions.

Texts of a batch are one long chain with resets. Forward and backward messages
are computed in two levels, blocks of the chain side by side and then from block
to block, which is exact and needs no padding to the longest text.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import arrow_batches, crc_mod

BITS = 16
UNKNOWN = "und"
#: Rows that the training documents are drawn from, by hash; the most of one language; longer texts are not used.
MOST_ROWS, MOST_A_LANGUAGE, MOST_CHARS = 4000, 150, 20_000
LEXICON, SEQUENCES, LENGTH, STEPS, RATE, DECAY = 200, 1200, 48, 60, 0.4, 1e-4
MOST_WORDS = 400_000
#: Code points that features are taken of at once.
MOST_POINTS = 1 << 17
#: Words up to this length are hashed point after point, longer ones as a sum.
CHAINED = 32
SEED = 11
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|*#$%&-_~`/\\+=0123456789"


def place_sums(points, start: int):
    """For each row the sum of its code points, each mixed with its place in the word."""
    import numpy as np

    h = (points ^ (np.arange(start + 1, start + 1 + points.shape[1], dtype=np.uint64) << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).sum(axis=1, dtype=np.uint64)


def feature_ids(words: list[str]):
    """By length: (indices of words, ids of their hashed features). A long word comes in several parts, a window each."""
    import numpy as np

    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, every in by.items():
        step = max(1, MOST_POINTS // n)
        for at, a in ((every[i : i + step], a) for i in range(0, len(every), step) for a in range(0, n, MOST_POINTS)):
            b = min(a + MOST_POINTS, n)
            # the window's points with one before it and one after it; n-grams that begin in it are its own
            text = "".join([words[i][max(0, a - 1) : b + 1] for i in at])
            x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), -1).astype(np.uint64)
            edge = np.ones((len(at), 1), np.uint64)
            x = np.concatenate(([edge] if a == 0 else []) + [x] + ([edge] if b == n else []), axis=1)
            columns = []

            def add(kind, *parts):
                h = np.full(parts[0].shape, kind, np.uint64)
                for p in parts:
                    h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                columns.append((h >> np.uint64(64 - BITS)).astype(np.int32))

            if a == 0:
                tail = np.frombuffer("".join([words[i][-3:] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), -1).astype(np.uint64)
                for k in range(1, min(n, 3) + 1):
                    add(2 * k, *(x[:, i + 1 : i + 2] for i in range(k)))
                    add(2 * k + 1, *(tail[:, tail.shape[1] - 1 - i : tail.shape[1] - i] for i in range(k)))
            pairs = b - a + (b == n)  # the last window has the pair of the last point and the edge
            add(8, x[:, :pairs], x[:, 1 : pairs + 1])
            add(9, x[:, : b - a], x[:, 1 : b - a + 1], x[:, 2 : b - a + 2])
            own = x[:, 1 : b - a + 1]
            if n <= CHAINED:
                add(10, *(own[:, i : i + 1] for i in range(n)))
            else:  # the word itself, point by place, so that windows add up
                total = place_sums(own, a) + (total if a else np.uint64(0))
                if b == n:
                    add(10, total[:, None])
            yield np.array(at), np.concatenate(columns, axis=1)


class Model:
    """Feature weights, lexicons and transitions over the languages met."""

    def __init__(self, labels: list[str]):
        import numpy as np

        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.lexicon: dict[str, int] = {}  # word to a set of languages, as bits
        self.in_lexicon = np.zeros((k, k), np.float32)  # weight for each language of a word in a language's lexicon
        self.transitions = np.zeros((k, k))
        self.start = np.zeros(k)

    def emissions(self, words: list[str]):
        import numpy as np

        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at, ids in feature_ids(words):
            out[at] += self.weights[ids].sum(axis=1)
        for i, w in enumerate(words):
            if bits := self.lexicon.get(w):
                out[i] += self.in_lexicon[[j for j in range(len(self.labels)) if bits >> j & 1]].sum(axis=0)
        return out


def marginals(emissions, starts, transitions, start):
    """Posterior of each label at each word of chains laid end to end; ``starts`` marks their first words.

    Two levels: products of the transfer matrices within blocks of about the
    root of the length, all blocks at once; messages from block to block; then
    messages within blocks.
    """
    import numpy as np

    n, k = emissions.shape
    if not n:
        return emissions.astype(np.float64)
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a, pi = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    length = max(1, int(n**0.5))
    blocks = -(-n // length)
    pad = blocks * length - n
    e = np.concatenate((e, np.ones((pad, k)))).reshape(blocks, length, k)
    s = np.concatenate((starts, np.ones(pad, bool))).reshape(blocks, length)
    fresh = [np.flatnonzero(s[:, t]) for t in range(length)]
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(length):
        after = (product.reshape(-1, k) @ a).reshape(blocks, k, k)
        if len(r := fresh[t]):
            after[r] = product[r].sum(axis=2, keepdims=True) * pi
        product = after * e[:, t, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    into, back = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1.0 / k)
    for b in range(blocks):
        into[b] = v
        v = v @ product[b]
        v = v / v.sum()
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        back[b] = v
        v = product[b] @ v
        v = v / v.max()
    forward = np.empty((blocks, length, k))
    v = into
    for t in range(length):
        after = v @ a
        if len(r := fresh[t]):
            after[r] = v[r].sum(axis=1, keepdims=True) * pi
        v = after * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        forward[:, t] = v
    v = back
    for t in range(length - 1, -1, -1):
        forward[:, t] *= v
        w = e[:, t] * v
        v = w @ a.T
        if len(r := fresh[t]):
            v[r] = (w[r] @ pi)[:, None]
        v = v / v.max(axis=1, keepdims=True)
    out = forward.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def words_of(text: str) -> list[str]:
    """Words with a letter, lower-cased, without signs and digits at their ends."""
    return [w for w in (x.lower().strip(_EDGES) for x in text.split()) if _LETTER.search(w)]


def train(texts: list[str], langs: list[str]) -> Model:
    """A model of the languages given. Rows are taken in a fixed order, so a rerun learns the same."""
    import numpy as np

    docs: dict[str, list[list[str]]] = {}
    for text, lang in sorted(set(zip(texts, langs, strict=True))):
        if words := words_of(text):
            docs.setdefault(lang, []).append(words)
    labels = sorted(docs)
    model = Model(labels)
    k = len(labels)
    if k < 2:
        return model
    seen = [Counter(w for d in docs[x] for w in d) for x in labels]
    for i, own in enumerate(seen):
        for w, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            model.lexicon[w] = model.lexicon.get(w, 0) | 1 << i
    rng = np.random.default_rng(SEED)
    sequences, gold = [], []
    for _ in range(SEQUENCES):
        words, marks = [], []
        while len(words) < LENGTH:
            i = int(rng.integers(k))
            d = docs[labels[i]][int(rng.integers(len(docs[labels[i]])))]
            m = min(int(rng.integers(4, 40)), LENGTH - len(words), len(d))
            at = int(rng.integers(len(d) - m + 1))
            words += d[at : at + m]
            marks += [i] * m
        sequences.append(words)
        gold.append(marks)
    vocabulary = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    tokens, y = np.array([[number[w] for w in s] for s in sequences]), np.array(gold)
    rows, columns = [], []
    for at, ids in feature_ids(vocabulary):
        rows.append(np.repeat(at, ids.shape[1]))
        columns.append(ids.ravel())
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    cuts = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))
    known = columns[cuts]
    lexical = np.array([[model.lexicon.get(w, 0) >> j & 1 for j in range(k)] for w in vocabulary], np.float32)
    n_words, t_len = len(vocabulary), tokens.shape[1]
    speed = [np.zeros_like(x, dtype=np.float64) + 1e-8 for x in (model.weights, model.in_lexicon, model.transitions, model.start)]
    for _ in range(STEPS):
        e_word = model.emissions(vocabulary).astype(np.float64)
        e = np.exp(e_word - e_word.max(axis=1, keepdims=True))[tokens]
        a, pi = np.exp(model.transitions), np.exp(model.start)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(t_len):
            v = (pi if t == 0 else alpha[:, t - 1] @ a) * e[:, t]
            alpha[:, t] = v / v.sum(axis=1, keepdims=True)
        for t in range(t_len - 2, -1, -1):
            v = (e[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = v / v.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        error = np.eye(k)[y] - gamma
        scale = 1.0 / tokens.size
        by_word = np.stack([np.bincount(tokens.ravel(), error[:, :, j].ravel(), n_words) for j in range(k)], axis=1) * scale
        g_weights = np.zeros_like(model.weights, dtype=np.float64)
        g_weights[known] = np.add.reduceat(by_word[rows], cuts, axis=0)
        xi = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        xi /= xi.sum(axis=(2, 3), keepdims=True)
        pairs = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        g_transitions = (pairs - xi.sum(axis=(0, 1))) * scale
        g_start = (np.bincount(y[:, 0], minlength=k) - gamma[:, 0].sum(axis=0)) * scale
        for x, g, h in zip((model.weights, model.in_lexicon, model.transitions, model.start), (g_weights, lexical.T @ by_word, g_transitions, g_start), speed, strict=True):
            g = g - DECAY * scale * x
            h += g * g
            x += (RATE * g / np.sqrt(h)).astype(x.dtype)
    return model


class Tagger:
    """Texts to their language. Remembers words' emissions."""

    def __init__(self, model: Model):
        import numpy as np

        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.labels)), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        import numpy as np

        words = [t.lower().strip(_EDGES) for t in fresh]
        with_letter = [i for i, w in enumerate(words) if _LETTER.search(w)]
        n = len(self.table)
        self.table = np.concatenate((self.table, self.model.emissions([words[i] for i in with_letter])))
        at = dict.fromkeys(range(len(fresh)), -1) | {i: n + j for j, i in enumerate(with_letter)}
        self.known.update((fresh[i], j) for i, j in at.items())

    def posteriors(self, texts: list[bytes]):
        """(bounds, posteriors): those of text i's words with a letter are rows bounds[i] to bounds[i + 1]."""
        import numpy as np

        if len(self.known) > MOST_WORDS:
            self.known, self.table = {}, self.table[:0]
        split = [t.decode("utf-8", "replace").split() for t in texts]
        self._learn(list(set().union(*split) - self.known.keys()))
        get = self.known.__getitem__
        rows = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
        rows = [r[r >= 0] for r in rows]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        starts = np.zeros(bounds[-1], bool)
        starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        every = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return bounds, marginals(self.table[every], starts, self.model.transitions, self.model.start)

    def languages(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """The language most of a text's words are expected to be in, and that share of them."""
        if not self.model.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        bounds, found = self.posteriors(texts)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                out.append((UNKNOWN, 0.0))
            else:
                mean = found[a:b].mean(axis=0)
                i = int(mean.argmax())
                out.append((self.model.labels[i], float(min(1.0, mean[i]))))
        return out


def training_rows(docs: DataFrame, most_rows: int = MOST_ROWS, most_a_language: int = MOST_A_LANGUAGE):
    """Texts and languages of a bounded sample by hash, of documents whose crc32(doc_id) mod 5 is not 0."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where((crc_mod("doc_id", 5) != 0) & (F.length("text") <= MOST_CHARS))
    drawn = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most_rows).collect()
    chosen: dict[str, list[int]] = {}
    for r in drawn:
        own = chosen.setdefault(r.lang, [])
        if len(own) < most_a_language:
            own.append(r.doc_id)
    ids = [i for own in chosen.values() for i in own]
    if not ids:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}").distinct()
    rows = known.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()  # of at most most_rows ids one text each
    rows = sorted(rows, key=lambda r: (r.lang, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


_TAGGERS: dict[bytes, Tagger] = {}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """Language of every whole text.

    Returns one row for each row of ``docs``: id_col, lang_pred (a learned value
    of lang, or ``und`` for a null text or one without a letter), score (share of
    the words expected in it, 0 for ``und``). Learns from a bounded sample (see
    :func:`training_rows`); languages outside it are unknown. With one learned
    language that one is given to all, with none all are ``und``. Repeated rows
    are rows of their own; an empty table gives an empty table; other columns
    are ignored.
    """
    import pickle

    spark = docs.sparkSession
    arrow_batches(spark)
    model = train(*training_rows(docs, most_rows))
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # 2 ** BITS rows of floats

    def run(batches):
        import hashlib

        import pyarrow as pa

        key = hashlib.sha256(shared.value).digest()
        if key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[key] = Tagger(pickle.loads(shared.value))
        for batch in batches:
            found = _TAGGERS[key].languages(batch.column(1).to_pylist())
            names_, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names_, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op1_crf_language(spark, sf_dir: str) -> DataFrame:
    """Contract columns of :func:`identify`."""
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
