"""Toxicity: a subsequence string kernel, Nyström landmarks and a support vector machine.

Words are folded to letters (case, digits that stand for letters, and marks put between letters fall away), get a start
mark, and are read in windows of `WINDOW` symbols; runs of single letters are read joined as well. The kernel of two
windows counts their common subsequences of `ORDER` symbols within a span of `SPAN`, each weighted by `DECAY` for every
gap in either, and is normalised; so characters that are inserted or left apart lower it only a little.

Training takes a bounded sample of labelled documents, whole and cut into sentences: rows in the order of a seeded hash,
whatever their length, up to a number of rows and of bytes for each class. It is chosen from slim rows, and one executor
task trains on its texts; the driver sees the machine only. A toxic document is a bag of which some
sentences are toxic: its strongest windows stand for them. Landmarks are strong windows of toxic sentences, unlike one
another, and some of clean ones; toxic ones with a letter put in somewhere train as well. Windows become kernel values at the landmarks times the inverse
root of the landmarks' kernel matrix, and a linear machine with squared hinge loss is trained on them in rounds, each
choosing the bags' windows and the hardest clean ones anew. As kernel, map and machine are linear in a window's
subsequences, the trained machine is a table of weights over subsequences: scoring a window looks up its own.

A document's score is a logistic function of the decision values of its `STRONGEST` strongest words and of the log of its
number of words, as one strong word in a long text may be chance. It is fitted on the sample, weighted to the classes'
shares of all labelled rows. Every word of every text is scored, by itself, so a text's length bounds nothing but time.
Words' values are kept in a cache of bounded size.

Defined results: a null or empty text, and one without letters, has no word and gets the score of the least values. A
word of any length is scored window by window. Rows of one key and text train once, however often they are repeated, but
all count for the classes' shares. Without toxic or without clean training rows the score is the share of toxic ones, or
zero without any; so it is where no window tells them apart. Rows with a null key or label train nothing. An empty table
gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, cut, release_memory, whole_text

ORDER, SPAN, DECAY, WINDOW, STRIDE = 4, 7, 0.85, 12, 6
ALPHABET = 40
#: The sample that trains: rows of each class, by seeded hash, and bytes of each; the row that passes these is its last.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 500, 700, 2_000_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS, ALIKE = 160, 40, 0.8
ROUNDS, PENALTY, SEED, CACHE_WORDS, BATCH_BYTES = 5, 3e-4, 20, 200_000, 1_000_000
#: Windows that are turned into subsequences at a time, and letters of words that are cut into windows at a time.
AT_ONCE, LETTERS = 4_000, 40_000
#: Words of a document that its score reads, windows of a bag that stand for it or may be landmarks, and the values that count.
STRONGEST, WITNESSES, CANDIDATES, LEAST, MOST = 5, 5, 12, -1.1, 1.3
#: How much more often toxic documents must hold a window than clean ones for it to stand for them.
LIFT = 3
#: Altered copies of a landmark that train as toxic, and the cost of all of them beside the bags' windows.
VARIANTS, VARIANT_COST = 3, 0.5
# Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_singles = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_sentences = re.compile(r"[^.!?\n]+")
_GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]


class _Folding(dict):
    """Code point to symbol: 0 starts a word, 1 to 26 are a to z, above are other letters; the rest is left out."""

    def __missing__(self, point: int):
        c = chr(point)
        c = DIGITS.get(c, c)
        if c == "\n":
            value = "\0"
        elif "a" <= c <= "z":
            value = chr(ord(c) - 96)
        elif c.isalpha():
            value = chr(27 + point % (ALPHABET - 27))
        else:
            value = None
        self[point] = value
        return value


_folding = _Folding()


def words_of(text: str) -> list[str]:
    """Lowered words, and runs of three or more single letters as a word each."""
    text = text.lower()
    words = text.split()
    words += ["".join(m.group().split()) for m in _singles.finditer(text)] if _singles.search(text) else []
    return words


class Windows:
    """The windows of some words, cut out as they are asked for: a long word has many."""

    def __init__(self, words: list[str]):
        joined = "\n" + "\n".join(w.replace("\n", "") for w in words) if words else ""
        self.flat = np.frombuffer(joined.translate(_folding).encode("latin-1"), dtype=np.uint8)
        self.start = np.flatnonzero(self.flat == 0)
        self.size = np.diff(np.append(self.start, len(self.flat)))
        self.ends = np.cumsum(np.maximum(1, -(-(self.size - WINDOW) // STRIDE) + 1))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def cut(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of symbols, their lengths, and which word each row is of."""
        at = np.arange(first, min(last, len(self)))
        word = np.searchsorted(self.ends, at, "right")
        within = (at - np.concatenate([[0], self.ends])[word]) * STRIDE
        places = self.start[word][:, None] + within[:, None] + np.arange(WINDOW)
        return self.flat[np.minimum(places, max(0, len(self.flat) - 1))], np.minimum(WINDOW, self.size[word] - within), word


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of symbols, their lengths, and which word each row is of, for all windows."""
    every = Windows(words)
    parts = [every.cut(i, i + AT_ONCE) for i in range(0, max(1, len(every)), AT_ONCE)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def subsequences(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and value of every distinct subsequence of every row, each row's values of norm one."""
    of, codes, values = [], [], []
    rows = rows.astype(np.int64)
    for gap in _GAPS:
        n = WINDOW - gap[-1]
        code = np.zeros((len(rows), n), dtype=np.int64)
        for g in gap:
            code = code * ALPHABET + rows[:, g : g + n]
        i, j = np.nonzero(np.arange(n) + gap[-1] < lengths[:, None])
        of.append(i)
        codes.append(code[i, j])
        values.append(np.full(len(i), DECAY ** (gap[-1] + 1 - ORDER)))
    key = np.concatenate(of) * ALPHABET**ORDER + np.concatenate(codes)
    order = np.argsort(key)
    key, value = key[order], np.concatenate(values)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, first) if len(first) else value
    row, code = np.divmod(key[first], ALPHABET**ORDER)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(rows)))
    return row, code, value / norm[row]


def pooled(values: list[np.ndarray]) -> np.ndarray:
    """For each document's word values: the strongest, falling, and the log of how many there are."""
    out = np.full((len(values), STRONGEST + 2), LEAST)
    for row, v in zip(out, values):
        top = np.sort(v if len(v) <= STRONGEST else np.partition(v, len(v) - STRONGEST)[-STRONGEST:])[::-1]
        row[: len(top)] = top.clip(LEAST, MOST)
        row[STRONGEST] = np.log1p(len(v))
    out[:, -1] = 1.0
    return out


def subsequences_of_many(rows: np.ndarray, lengths: np.ndarray, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in narrow types, computed some rows at a time."""
    parts = []
    for i in range(0, len(rows), at_once):
        row, code, value = subsequences(rows[i : i + at_once], lengths[i : i + at_once])
        parts.append(((row + i).astype(np.int32), code.astype(np.int32), value.astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))


def decisions(rows: np.ndarray, lengths: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
    """For each row the sum of its subsequences' values times their weights: what `subsequences` gives, without listing them.

    Rows of one length have their subsequences at the same places. Each row's codes are sorted with the kind of gap they
    came by, which is what their values depend on, so equal codes stand together for the norm.
    """
    out, step = np.zeros(len(rows)), SPAN - ORDER + 1
    value_of = DECAY ** np.arange(step, dtype=np.float64)
    for n in np.unique(lengths[lengths >= ORDER]):
        of = np.flatnonzero(lengths == n)
        some, parts = rows[of, :n].astype(np.int64), []
        for gap in _GAPS:
            if (many := n - gap[-1]) > 0:
                code = some[:, :many]
                for g in gap[1:]:
                    code = code * ALPHABET + some[:, g : g + many]
                parts.append(code * step + (gap[-1] + 1 - ORDER))
        key = np.sort(np.hstack(parts), axis=1)
        code, kind = np.divmod(key, step)
        value = value_of[kind]
        first = np.ones(key.shape, dtype=bool)
        first[:, 1:] = code[:, 1:] != code[:, :-1]
        at = np.flatnonzero(first)
        square = np.add.reduceat(value.ravel(), at) ** 2
        norm = np.add.reduceat(square, np.searchsorted(at, np.arange(len(of)) * key.shape[1]))
        out[of] = (value * weight_of[code]).sum(axis=1) / np.sqrt(norm)
    return out


@dataclass(frozen=True)
class Machine:
    #: Subsequences that have a weight, their weights, the bias, and what the logistic function gives to each of the pooled values.
    codes: np.ndarray
    weights: np.ndarray
    bias: float
    pooling: np.ndarray

    @cached_property
    def weight_of(self) -> np.ndarray:
        out = np.zeros(ALPHABET**ORDER, dtype=np.float32)
        out[self.codes] = self.weights
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """Decision value of each word."""
        out = np.full(len(words), -np.inf)
        first = letters = 0
        for i, w in enumerate(words):
            letters += len(w) + 1
            if letters >= LETTERS or i + 1 == len(words):
                every = Windows(words[first : i + 1])
                for j in range(0, len(every), AT_ONCE):
                    rows, lengths, word = every.cut(j, j + AT_ONCE)
                    np.maximum.at(out, first + word, decisions(rows, lengths, self.weight_of) + self.bias)
                first, letters = i + 1, 0
        return out

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(pooled @ self.pooling).clip(-700, 700)))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-8
    for _ in range(30):
        short = np.maximum(0, 1 - y * (x @ w))
        gradient = ridge @ w - x.T @ (cost * y * short)
        active = x[short > 0]
        step = np.linalg.solve(ridge + (active * cost[short > 0][:, None]).T @ active, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly penalised so that a clean split stays finite."""
    w, ridge = np.zeros(x.shape[1]), 1e-1 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (cost * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (cost * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _with_a_letter(symbols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A letter put in after the first two symbols or later, within a window."""
    return np.insert(symbols, rng.integers(2, max(3, len(symbols))), rng.integers(1, 27))[:WINDOW]


def train(texts: list[str], toxic: np.ndarray, toxic_share: float | None = None, seed: int = SEED) -> Machine | float:
    """toxic_share: of all labelled rows; without it, that of the texts."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return float(toxic.mean()) if len(toxic) else 0.0
    rng, vocabulary, bags = np.random.default_rng(seed), {}, []
    for text in texts:
        sentences = [words_of(s) for s in _sentences.findall(text)]
        bags.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for s in sentences for w in s], dtype=np.int64))
    rows, lengths, word = windows(list(vocabulary))
    row, code, value = subsequences_of_many(rows, lengths)
    n_codes = ALPHABET**ORDER
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    first_window = np.searchsorted(word, np.arange(len(vocabulary) + 1))

    def windows_in(bag: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(first_window[w], first_window[w + 1]) for w in bag]) if len(bag) else np.zeros(0, np.int64)

    spoken, bags = bags, [windows_in(np.unique(b)) for b in bags]
    seen = np.zeros((2, n_codes), dtype=np.int32)
    for bag, bad in zip(bags, toxic):
        spans = [code[ends[w] : ends[w + 1]] for w in bag]
        if spans:
            seen[int(bad), np.unique(np.concatenate(spans))] += 1
    n_clean, n_toxic = int((~toxic).sum()), int(toxic.sum())
    odds = np.log((seen[1] + 0.5) / (n_toxic + 1)) - np.log((seen[0] + 0.5) / (n_clean + 1))
    odds = np.where(seen[1] >= min(3, n_toxic), odds, 0.0)

    def decided(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for i in range(0, len(row), 500_000):
            some = slice(i, i + 500_000)
            np.add.at(out, row[some], value[some] * weights[code[some]])
        return out

    def strongest(values: np.ndarray, of: list[np.ndarray], k: int) -> np.ndarray:
        return np.concatenate([b[np.argsort(-values[b])[:k]] for b in of] or [np.zeros(0, np.int64)])

    def kernel(a: np.ndarray, b: np.ndarray, of: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Of windows a, the vocabulary's or those of other subsequences, and the vocabulary's windows b."""
        codes, values, bounds = of or (code, value, ends)
        out, dense = np.zeros((len(a), len(b))), np.zeros(n_codes, dtype=np.float32)
        inside = np.concatenate([np.arange(bounds[w], bounds[w + 1]) for w in a]) if len(a) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(a)), bounds[a + 1] - bounds[a])
        inner_codes, inner_values = codes[inside], values[inside]
        for j, w in enumerate(b):
            own = slice(ends[w], ends[w + 1])
            dense[code[own]] = value[own]
            out[:, j] = np.bincount(owner, weights=inner_values * dense[inner_codes], minlength=len(a))
            dense[code[own]] = 0
        return out

    # What is about as common in clean documents as in toxic ones stands for no bag.
    in_toxic, in_clean = (np.bincount(np.concatenate([b for b, t in zip(bags, toxic) if t == want]), minlength=len(rows)) for want in (True, False))
    lifted = in_toxic * n_clean >= LIFT * (in_clean + 0.5) * n_toxic
    bad, good = [b[lifted[b]] for b, t in zip(bags, toxic) if t], [b for b, t in zip(bags, toxic) if not t]
    values = decided(np.maximum(odds, 0) ** 2)
    candidates, votes = np.unique(strongest(values, bad, CANDIDATES), return_counts=True)
    candidates = candidates[np.argsort(-(votes * values[candidates]), kind="stable")][: TOXIC_LANDMARKS * 8]
    alike, chosen = kernel(candidates, candidates), []
    for i in range(len(candidates)):
        if len(chosen) < TOXIC_LANDMARKS and (not chosen or alike[i, chosen].max() < ALIKE) and alike[i, i] > 0:
            chosen.append(i)
    filled = np.flatnonzero(np.diff(ends) > 0)
    clean = np.intersect1d(np.concatenate(good), filled)
    landmarks = np.concatenate([candidates[chosen], rng.permutation(clean)[:CLEAN_LANDMARKS]]).astype(np.int64)
    if not len(landmarks):
        return float(toxic.mean())
    # Landmarks of toxic sentences with a letter put in somewhere, as positive windows of their own.
    altered = [_with_a_letter(rows[w][: lengths[w]], rng) for w in candidates[chosen] for _ in range(VARIANTS)]
    extra_rows, extra_lengths = np.array([np.pad(x, (0, WINDOW - len(x))) for x in altered]).reshape(-1, WINDOW), np.array([len(x) for x in altered], dtype=np.int64)
    extra_row, extra_code, extra_value = subsequences_of_many(extra_rows, extra_lengths)
    extra = kernel(np.arange(len(altered)), landmarks, (extra_code, extra_value, np.searchsorted(extra_row, np.arange(len(altered) + 1))))
    root_values, root = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = root_values > 1e-6
    whiten = root[:, keep] / np.sqrt(root_values[keep])
    negatives = rng.permutation(clean)[: 2 * n_clean]
    weights, bias = np.maximum(odds, 0) ** 2, 0.0
    for _ in range(ROUNDS):
        values = decided(weights)
        positives = strongest(values, bad, WITNESSES)
        negatives = np.concatenate([negatives, strongest(values, good, 2)])
        if not len(positives):
            return float(toxic.mean())
        x = np.concatenate([kernel(positives, landmarks), extra, kernel(negatives, landmarks)])
        y = np.repeat([1.0, -1.0], [len(positives) + len(extra), len(negatives)])
        cost = np.repeat([1.0 / len(positives), VARIANT_COST / max(1, len(extra)), 1.0 / len(negatives)], [len(positives), len(extra), len(negatives)])
        w = _machine(x @ whiten, y, cost)
        pull, bias = whiten @ w[:-1], float(w[-1])
        weights = np.zeros(n_codes)
        for z, a in zip(landmarks, pull):
            weights[code[ends[z] : ends[z + 1]]] += a * value[ends[z] : ends[z + 1]]
    per_word = np.full(len(vocabulary), -np.inf)
    np.maximum.at(per_word, word, decided(weights) + bias)
    share = toxic.mean() if toxic_share is None else toxic_share
    cost = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    pooling = _logistic(pooled([per_word[b] for b in spoken]), toxic.astype(float), cost)
    used = np.flatnonzero(weights)
    return Machine(used.astype(np.int32), weights[used].astype(np.float32), bias, pooling)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> tuple[DataFrame, float | None]:
    """docs: key, text; labels: key, label. The sample as a table of place, toxic and text, and the share of toxic rows among all.

    Rows are chosen by their hashes and sizes, without their texts; copies of a row are folded before the join.
    """
    has_text = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"), F.col(text).alias("text"))
    slim = has_text.groupBy("key", "h", "size").agg(F.count("*").alias("n"))
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.count("*").alias("m"))
    labelled = cut(slim.join(known, "key").withColumn("order", F.xxhash64(F.lit(SEED), "key", "h")))
    found = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.sum(F.col("n") * F.col("m")).alias("n")).collect()}
    chosen = []
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        rows, held = labelled.where(F.col("label") == value).orderBy("order", "key", "h").limit(most).collect(), 0
        for r in rows:
            if held >= SAMPLE_BYTES:
                break
            chosen.append((len(chosen), value, r["key"], r["h"]))
            held += r["size"]
    kind = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("toxic", T.IntegerType()), labelled.schema["key"], labelled.schema["h"]])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, kind))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    texts = has_text.join(wanted, ["key", "h"]).groupBy("place", "toxic").agg(F.first("text").alias("text"))
    total = sum(found.values())
    return texts, found.get(1, 0) / total if total else None


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Machine | float:
    """Train on the sample, in one executor task, which returns the machine: some ten thousand weights."""
    texts, share = sample(docs, labels, text, label, key)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["place"], r["toxic"], r["text"]) for batch in batches for r in batch.to_pylist())
        machine = train([r[2] for r in rows], np.array([r[1] for r in rows]), share)
        del rows
        yield pa.RecordBatch.from_pydict({"machine": pa.array([pickle.dumps(machine)], pa.binary())})
        release_memory()

    found = texts.repartition(1).mapInArrow(trained, "machine binary").collect()
    return pickle.loads(found[0]["machine"]) if found else 0.0


def score(docs: DataFrame, machine: Machine | float, text: str | Column = "text") -> DataFrame:
    """Add the struct column __ef_toxic: score, and worst, the word with the greatest value."""
    if isinstance(machine, float):
        return docs.withColumn("__ef_toxic", F.struct(F.lit(machine).alias("score"), F.lit(None).cast("string").alias("worst")))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # the weights of some landmarks' subsequences, whatever the corpus

    @F.arrow_udf("score double, worst string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, known = shared.value, {}
        for texts in batches:
            strongest, worst = [], []
            for _, these in by_bytes(texts, BATCH_BYTES):
                some = [words_of(t) for t in these]
                new = list({w for words in some for w in words if w not in known})
                if len(known) + len(new) > CACHE_WORDS:
                    known, new = {}, list({w for words in some for w in words})
                known.update(zip(new, machine.values(new).tolist()))
                for words in some:
                    v = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
                    worst.append(words[int(v.argmax())] if len(v) else None)
                    strongest.append(pooled([v])[0])
            x = np.array(strongest).reshape(-1, STRONGEST + 2)
            yield pa.StructArray.from_arrays([pa.array(machine.scores(x)), pa.array(worst, pa.string())], ["score", "worst"])
        known.clear()
        release_memory()

    return docs.withColumn("__ef_toxic", of(whole_text(text)))
