"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two strings sums over their common subsequences of three bytes, each weighted by
DECAY for every byte that it skips, so `idxiot` and `i-d-i-o-t` stay close to `idiot`. A word
stands for itself and for its beginnings, so that endings don't hide a stem. Landmarks are strings
mined from labelled texts; a text's value at a landmark is the largest kernel value of any of its
words; K ** -1/2 over the landmarks turns these values into features of a linear machine.
"""

from __future__ import annotations

import dataclasses
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECAY, SPAN, CODES = 0.7, 5, 1 << 16
#: Longest string that the kernel sees at once; longer words go in overlapping parts.
WIDTH = 24
#: A landmark's least floor; its own lies above the values of all but 2 % of clean texts.
FLOOR = 0.5
#: Bound of the sample that the classifier is fitted on, toxic and clean rows each.
SAMPLE = 2_000
LANDMARKS = 48
#: Least evidence for a toxic landmark: about the logarithm of the number of strings compared.
EVIDENCE = 12.0
#: Words remembered by a Python worker before it starts anew.
SEEN = 500_000
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]
_DROP = bytes(x for x in range(128) if not (chr(x).isalpha() or chr(x).isspace()))
_SPELLED = re.compile(rb"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def word_set(text: str | None) -> set[bytes]:
    """Distinct words in lower case without ASCII signs and digits; letters set apart one by one also as one word."""
    if not text:
        return set()
    data = text.lower().encode("utf-8", "surrogatepass").translate(None, _DROP)
    found = set(data.split())
    for run in _SPELLED.findall(data):
        found.add(b"".join(run.split()))
    return found


def parts(word: bytes) -> list[bytes]:
    return [word] if len(word) <= WIDTH else [word[at : at + WIDTH] for at in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in words), np.uint8).reshape(-1, WIDTH)


def subsequences(a: np.ndarray):
    """For each pattern of gaps: place of the last byte, weight, codes (0 past a string's end)."""
    x = a.astype(np.uint32)
    for p, q in _GAPS:
        m = WIDTH - p - q
        code = (x[:, :m] * np.uint32(65599) + x[:, p : p + m]) * np.uint32(65599) + x[:, p + q :]
        code = (code * np.uint32(0x9E3779B1) >> np.uint32(16)) | np.uint32(1)
        yield p + q, DECAY ** (p + q - 2), np.where(a[:, p + q :] > 0, code, 0)


class Kernel:
    """Kernel values of words against fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.table = np.zeros((CODES, len(landmarks)), np.float32)
        for _, weight, codes in subsequences(matrix(landmarks)):
            for j, row in enumerate(codes):
                np.add.at(self.table, (row[row > 0], j), np.float32(weight))
        self.table /= np.maximum(np.sqrt((self.table**2).sum(axis=0)), 1e-9)
        self.most = self.table.max(axis=1, initial=0)

    def near(self, words: list[bytes]) -> np.ndarray:
        """Places of words whose value can reach FLOOR at all: no string of four bytes has a smaller norm than this."""
        a = matrix(words)
        bound = sum(weight * self.most[codes].sum(axis=1) for _, weight, codes in subsequences(a))
        return np.flatnonzero(bound >= FLOOR * (2 + 2 * DECAY**2) ** 0.5)

    def values(self, words: list[bytes]) -> np.ndarray:
        """The largest normalised value of a word's beginnings of four bytes or more, at each landmark; 1 at most."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), 512):
            a = matrix(words[at : at + 512])
            dot = np.zeros((len(a), WIDTH, len(self.landmarks)), np.float32)
            norm = np.zeros((len(a), WIDTH), np.float32)
            for end, weight, codes in subsequences(a):
                dot[:, end:] += weight * self.table[codes]
                norm[:, end:] += weight**2 * (codes > 0)
            dot, norm = dot.cumsum(axis=1)[:, 3:], np.sqrt(norm.cumsum(axis=1))[:, 3:, None]
            out[at : at + 512] = (dot / np.maximum(norm, 1e-6)).max(axis=1)
        return np.minimum(out, 1)


@dataclasses.dataclass
class Model:
    kernel: Kernel
    floors: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float

    def __post_init__(self):
        self.seen: set[bytes] = set()
        self.hits: dict[bytes, np.ndarray] = {}

    def pooled(self, sets: list[set[bytes]]) -> np.ndarray:
        """A row for each set of words: the largest value at each landmark, as its share of the way from the landmark's floor to 1."""
        if len(self.seen) > SEEN:
            self.seen, self.hits = set(), {}
        new = list(set().union(*sets) - self.seen)
        self.seen.update(new)
        cut = [(w, p) for w in new for p in parts(w) if len(p) > 3]
        if cut and self.kernel.landmarks:
            near = [cut[i] for i in self.kernel.near([p for _, p in cut])]
            for (w, _), v in zip(near, self.kernel.values([p for _, p in near])):
                if v.max() >= FLOOR:
                    self.hits[w] = np.maximum(self.hits[w], v) if w in self.hits else v
        out = np.zeros((len(sets), len(self.kernel.landmarks)), np.float32)
        for k, s in enumerate(sets):
            for w in s & self.hits.keys():
                np.maximum(out[k], self.hits[w], out=out[k])
        return np.maximum(0, (out - self.floors) / (1 - self.floors))

    def score(self, sets: list[set[bytes]]) -> np.ndarray:
        margin = self.pooled(sets) @ self.root @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(-self.scale * margin, -50, 50)))


def mine(rows: list[tuple[set[bytes], int]]) -> tuple[list[bytes], list[bytes]]:
    """Landmarks, beginnings of words and words that tell toxic texts, and the clean words nearest to them.

    Greedy cover: each takes the string that finds most toxic texts not yet found, less four times
    the clean texts that it is in.
    """
    with_, owners, clean = {}, Counter(), Counter()
    for k, (words, toxic) in enumerate(rows):
        cut = {w[:n] for w in words for n in {*range(4, 11), min(len(w), WIDTH)} if 4 <= n <= len(w)}
        if toxic:
            for x in cut:
                with_.setdefault(x, set()).add(k)
        else:
            clean.update(cut)
    n, least = sum(t for _, t in rows), 3
    m = len(rows) - n

    def evidence(x: bytes) -> float:
        """Log-likelihood ratio of one rate of texts with x for each label against one for both."""
        a, b = len(with_[x]), clean[x]
        if a * m <= 10 * b * n:
            return 0.0
        part = lambda k, of, rate: k * np.log(max(rate, 1e-12)) + (of - k) * np.log(max(1 - rate, 1e-12))
        return part(a, n, a / n) + part(b, m, b / max(m, 1)) - part(a, n, (a + b) / (n + m)) - part(b, m, (a + b) / (n + m))

    with_ = {x: s for x, s in with_.items() if len(s) >= least and evidence(x) > EVIDENCE}
    found: list[bytes] = []
    left = dict(with_)
    while left and len(found) < LANDMARKS:
        best = max(left, key=lambda x: (len(left[x]) - 4 * clean[x], len(x), x))
        own = left[best]
        if len(own) - 4 * clean[best] < least:
            break
        found.append(best)
        own = set(own)
        # a text may hold several insults: those it has besides stay worth half a landmark
        left = {x: s - own for x, s in left.items() if x != best}
        left = {x: s for x, s in left.items() if len(s) >= least}
    spare = sorted((x for x in with_ if x not in found), key=lambda x: (-len(with_[x]), -len(x), x))
    for x in spare:
        if len(found) >= LANDMARKS:
            break
        if not any(x.startswith(y) or y.startswith(x) for y in found):
            found.append(x)
    near: list[bytes] = []
    if found:
        common = [w for w, k in clean.most_common(50_000) if 4 <= len(w) <= WIDTH and k > 1 and w not in with_]
        if common:
            value = Kernel(found).values(common)
            near = [common[i] for i in sorted({i for column in value.T for i in np.argsort(-column, kind="stable")[:12].tolist()})]
    return found, near


def single(kernel: Kernel, floors: np.ndarray, near: list[bytes], rng: np.random.Generator, times: int = 12) -> list[tuple[set[bytes], int]]:
    """Sentences of one word: clean words as they are, landmarks as they are and with a letter put in.

    A landmark with a letter put in is taken where its value is well above the landmark's floor.
    """
    rows = [({w}, 0) for w in near]
    for k, word in enumerate(kernel.landmarks):
        noisy = [word[:at] + bytes([int(rng.integers(97, 123))]) + word[at:] for at in rng.integers(1, max(2, len(word)), 4 * times)]
        value = kernel.values(noisy)[:, k]
        rows += [({word}, 1)] * times + [({w}, 1) for w, v in zip(noisy, value) if v > floors[k] + 0.05][: 2 * times]
    return rows


def fit(rows: list[tuple[set[bytes], int]], calibration: list[tuple[set[bytes], int]], epochs: int = 60, c: float = 1e-4, seed: int = 5) -> Model:
    """Mine landmarks, fit the machine, on sentences of a single landmark too, by the hinge loss' subgradients and its scale by logistic loss on calibration.

    The score is 0.5 at the machine's boundary, moved towards the margin of single insults as far as
    all but 0.2 % of clean calibration texts ask for; a freely fitted shift would give those up.
    """
    landmarks, near = mine(rows)
    kernel = Kernel(landmarks)
    m = len(landmarks)
    bare = Model(kernel, np.zeros(m), np.eye(m), np.zeros(m), 0.0, 1.0)
    clean = bare.pooled([s for s, t in rows if not t])
    floors = np.clip(np.quantile(clean, 0.98, axis=0), FLOOR, 0.95) if len(clean) and m else np.full(m, FLOOR)
    own = kernel.values(landmarks) if m else np.zeros((0, 0))
    own = np.maximum(0, (own - floors) / (1 - floors))
    value, vector = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(own)))
    root = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    model = Model(kernel, floors, root, np.zeros(m), -1.0, 2.0)
    if not m or len({t for _, t in rows}) < 2:
        return model
    rng = np.random.default_rng(seed)
    rows = rows + single(kernel, floors, near, rng)
    x, y = model.pooled([s for s, _ in rows]) @ root, np.array([2 * t - 1 for _, t in rows])
    w, b, t = np.zeros(m), 0.0, 0
    for _ in range(epochs):
        for k in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            t += 1
            step = 1 / (c * (t + 1 / (c * 0.5)))
            wrong = k[y[k] * (x[k] @ w + b) < 1]
            w = w * (1 - step * c) + step * (y[wrong] @ x[wrong]) / len(k)
            b += step * 0.5 * y[wrong].sum() / len(k)
    model.weights, model.bias = w, b
    margin = model.pooled([s for s, _ in calibration]) @ root @ w + b
    z = np.array([t for _, t in calibration], float)
    if len(set(z.tolist())) == 2:
        shift = float(np.clip(np.quantile(margin[z == 0], 0.998), 0, 0.75))
        model.bias, margin = b - shift, margin - shift
        loss = lambda p: np.logaddexp(0, np.where(z > 0, -p, p) * margin).mean()
        model.scale = min((2.0**k for k in np.arange(0, 3.25, 0.25)), key=loss)
    return model


def unlike(rows: list[tuple[set[bytes], int]]) -> list[tuple[set[bytes], int]]:
    """Rows without copies and near copies of earlier ones, whose words would all seem to tell their label.

    Rows are alike if, of three orders of all words of eight bytes or more, which are seldom
    shared by chance, one starts with the same two words in both; or if all words are the same.
    """
    seen, out = set(), []
    for words, toxic in rows:
        long = [w for w in words if len(w) >= 8]
        keys = {(salt, *heapq.nsmallest(2, (xxhash.xxh64_intdigest(w, salt) for w in long))) for salt in range(3)} if len(long) > 3 else {tuple(sorted(words))}
        if not keys & seen:
            out.append((words, toxic))
        seen |= keys
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose crc32 of doc_id isn't 0 modulo 5, at most sample of either label.

    The rows are those with the smallest hash of doc_id; one in four is kept for the scale. What the
    driver takes of a row is its set of words.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("doc_id", F.lit(13)))
    few = marks.where("toxic = 1").orderBy("h").limit(sample).union(marks.where("toxic <> 1").withColumn("toxic", F.lit(0)).orderBy("h").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id").select("h", "toxic", "text")

    def run(batches):
        for b in batches:
            words = [b" ".join(sorted(word_set(t.as_py()))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary())], names=["h", "toxic", "words"])

    rows = texts.mapInArrow(run, "h long, toxic int, words binary").orderBy("h", "words").limit(2 * sample).collect()
    parsed = [(r["h"], (set(bytes(r["words"]).split()), r["toxic"])) for r in rows]
    return fit(unlike([x for h, x in parsed if h % 4]), unlike([x for h, x in parsed if h % 4 == 0]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted; only the text is read for the last two.

    A null or empty text has the score of a text without any landmark. A null doc_id isn't held out;
    repeated rows are scored each.
    """
    held = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score = shared.value.score([word_set(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, train(docs, labels))
