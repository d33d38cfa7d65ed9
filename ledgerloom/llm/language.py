"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 2- to 4-byte grams of words with their boundaries. Training is stochastic gradient
descent in numpy on a bounded sample; a temperature and a rejection threshold are set on the part
of the sample that training leaves out.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, DIM = 1 << 15, 16
#: Bound of the sample that the classifier is fitted on.
SAMPLE = 2_000
CHUNK = 1 << 18
UNKNOWN = "und"

_TABLE = np.full(256, 32, np.uint8)
_TABLE[128:] = np.arange(128, 256)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the grams of each order in bytes: letters with a blank at either end at most."""
    b = _TABLE[data]
    blank, h = b == 32, b.astype(np.uint32)
    inner, out = np.zeros(len(b), bool), []
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + b[n - 1 :]
        inner = inner[:m] | (blank[n - 2 : n - 2 + m] if n > 2 else False)
        at = np.flatnonzero(~inner & ~(blank[:m] & blank[n - 1 :]))
        out.append((at, (((h[at] ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)))
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = [i for _, i in subwords(np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8))]
    buckets, n = np.unique(np.concatenate(found or [np.zeros(0, np.int32)]), return_counts=True)
    return buckets, (n / max(1, n.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclasses.dataclass
class Model:
    """Languages, the logits that each bucket adds (times the temperature's inverse), bias and threshold."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejected; und, 0 and rejected for texts without a letter."""
        known = [has_letter(t) and bool(self.langs) for t in texts]
        total, n = np.zeros((len(texts), len(self.langs)), np.float64), np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush():
            nonlocal size
            data = np.frombuffer(b"".join(held) + b" ", np.uint8)
            starts = np.cumsum([0] + [len(x) for x in held])[:-1]
            for at, i in subwords(data):
                own = np.searchsorted(at, starts)
                used = np.diff(np.append(own, len(at)))
                got = np.flatnonzero(used)
                if len(got):
                    to = np.array(owners)[got]
                    np.add.at(total, to, np.add.reduceat(self.logits[i], own[got], axis=0))
                    np.add.at(n, to, used[got])
            held.clear()
            owners.clear()
            size = 0

        for k, text in enumerate(texts):
            if known[k]:
                data = b" " + text.encode("utf-8", "surrogatepass")
                at = 0
                while at < len(data):  # long texts in parts that end before a blank
                    to = len(data) if len(data) - at <= CHUNK else data.find(b" ", at + CHUNK)
                    to = len(data) if to < 0 else to
                    held.append(data[at:to])
                    owners.append(k)
                    size += to - at
                    at = to
                    if size > CHUNK:
                        flush()
        if held:
            flush()
        p = softmax(total / np.maximum(n, 1)[:, None] + self.bias) if self.langs else total
        best = p.argmax(axis=1) if self.langs else np.zeros(len(texts), int)
        score = np.array([p[k, b] if known[k] else 0.0 for k, b in enumerate(best)], np.float64)
        lang = [self.langs[b] if known[k] else UNKNOWN for k, b in enumerate(best)]
        return lang, score, score < self.threshold


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], calibration: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.6, seed: int = 3, keep: float = 0.999) -> Model:
    """Fit on bags of training texts; scale scores and set the threshold on those of calibration.

    The threshold lies below all but 1 - keep of the rightly named calibration texts, and no higher
    than an even chance.
    """
    langs = sorted({r[0] for r in rows})
    rng, c = np.random.default_rng(seed), len(langs)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, c)).astype(np.float32), np.zeros(c, np.float32)
    weight = {x: len(rows) / c / sum(r[0] == x for r in rows) for x in langs}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            lang, i, share = rows[k]
            y = langs.index(lang)
            x = share @ e[i]
            g = softmax(x @ w + bias)
            g[y] -= 1
            g *= step * min(2.0, weight[lang])
            back = w @ g
            w -= np.outer(x, g)
            bias -= 0.1 * g
            e[i] -= (share / max(share.max(), 1e-9) * 0.5)[:, None] * back
    table = e @ w
    z = np.array([share @ table[i] + bias for _, i, share in calibration]).reshape(-1, c)
    y = np.array([langs.index(r[0]) if r[0] in langs else -1 for r in calibration], int)
    z, y = z[y >= 0], y[y >= 0]
    scale, threshold = 1.0, 0.0
    if len(y):
        scale = min((2.0**k for k in np.arange(-4, 4.25, 0.25)), key=lambda s: -np.log(np.maximum(softmax(z * s)[np.arange(len(y)), y], 1e-12)).mean())
        p = softmax(z * scale)
        right = p[p.argmax(axis=1) == y].max(axis=1, initial=0)
        threshold = min(0.5, float(np.quantile(right, 1 - keep)) * 0.9) if len(right) else 0.0
    return Model(langs, (table * scale).astype(np.float32), (bias * scale).astype(np.float32), threshold)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample rows with a language and a doc_id whose crc32 isn't 0 modulo 5.

    The rows are those with the smallest hash of doc_id; each gives its whole text and two short
    runs of its words. One in five is kept for calibration.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
    order = F.xxhash64("doc_id", F.lit(11))
    last = [r["h"] for r in rows.select(order.alias("h")).orderBy("h").limit(sample).collect()]
    if not last:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    few = rows.where(order <= last[-1]).select("lang", "text", order.alias("h"))

    def run(batches):
        for b in batches:
            out = []
            for lang, text, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                if has_letter(text):
                    words = text.split()
                    rng = np.random.default_rng(h & 0xFFFFFFFF)
                    cuts = [text]
                    for most in (4, 12):
                        n = int(rng.integers(1, most + 1))
                        at = int(rng.integers(0, max(1, len(words) - n + 1)))
                        cuts.append(" ".join(words[at : at + n]))
                    out += [(h, lang, *bag(x)) for x in cuts if has_letter(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.string()),
                    pa.array([x[2].tobytes() for x in out], pa.binary()),
                    pa.array([x[3].tobytes() for x in out], pa.binary()),
                ],
                names=["h", "lang", "buckets", "shares"],
            )

    bags = few.mapInArrow(run, "h long, lang string, buckets binary, shares binary").orderBy("h", "buckets").limit(3 * sample).collect()
    parsed = [(r["h"], (r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32))) for r in bags]
    return fit([x for h, x in parsed if h % 5], [x for h, x in parsed if h % 5 == 0])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected; only the text is read for the last three.

    A null text or one without a letter is und with score 0 and is rejected. A null doc_id isn't
    held out; repeated rows are named each.
    """
    held = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lang, score, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, train(docs))
