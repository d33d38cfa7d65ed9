"""Names in sentences: a gazetteer by an automaton, and a tagger that learns from what the gazetteer marks.

The tagger is an averaged perceptron over labelled sequences: a word's own form and its neighbours'
give scores of labels, the best sequence is found by Viterbi's recursion. It is fitted on a bounded
sample of sentences and knows names by their shape and place, also those that the gazetteer lacks.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a name at most, and names of a gazetteer that go to all tasks as one automaton; larger ones are joined.
LONGEST, AUTOMATON_NAMES = 5, 200_000
#: Sentences that a tagger is fitted on at most, rounds over them, and places of hashed features.
SAMPLE, ROUNDS, PLACES = 4_000, 5, 1 << 16
#: Words whose scores a Python worker remembers, and words of sentences that are tagged together.
SEEN, TOGETHER = 100_000, 50_000
#: Sentences that are tagged one by one if no more are of about one length.
FEW = 16
#: Bytes of sentences that a task holds as words at once.
HELD = 1 << 20
OUTSIDE = "O"
_SIGNS = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$")
_CAPITAL = regex.compile(r"^\p{Lu}")


def words_of(text: str | None) -> list[str]:
    # bytes part at the six ASCII blanks alone
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def cleaned(words: list[str]) -> str:
    """A run of words without the signs at its ends."""
    return _SIGNS.sub("", " ".join(words))


class Gazetteer:
    """Names by their lower-case form in one automaton over the text."""

    def __init__(self, names: dict[str, str]):
        import ahocorasick

        self.names = names
        self.automaton = ahocorasick.Automaton()
        for key in names:
            self.automaton.add_word(key, key)
        if names:
            self.automaton.make_automaton()

    def find(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        """First word (from 0), number of words, name and label of each name, in order: runs of words that are a name but for signs round them."""
        if not self.names or not words:
            return []
        low = " ".join(words).lower()
        hits, found = list(self.automaton.iter(low)), set()
        ends = np.cumsum([len(w) + 1 for w in low.split(" ")]) if hits else None
        for last, key in hits:
            i, j = (int(np.searchsorted(ends, at, "right")) for at in (last - len(key) + 1, last))
            if j - i < LONGEST:
                name = cleaned(words[i : j + 1])
                if name.lower() == key and _CAPITAL.match(name):
                    found.add((i, j - i + 1, name, self.names[key]))
        return sorted(found)


def gazetteer_of(gazetteer: DataFrame) -> Gazetteer:
    """The names of gazetteer(name, label); of several labels of one name the least counts."""
    rows = gazetteer.where("name IS NOT NULL AND name <> ''").groupBy(F.lower("name").alias("key")).agg(F.min("label").alias("label")).collect()
    return Gazetteer({r["key"]: r["label"] for r in rows})


def parts(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """A batch in slices whose last column has about HELD bytes, and a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.flatnonzero(np.diff(sizes // HELD, prepend=-1)).tolist()
    return [batch.slice(a, b - a) for a, b in zip(starts, [*starts[1:], batch.num_rows])]


def _over_sentences(sentences: DataFrame, marker) -> DataFrame:
    """Sentence columns but text, with at (from 1), name and label of what a task's marker() gives for the words of a batch's sentences."""
    keep = [f for f in sentences.schema.fields if f.name not in ("text", "at", "name", "label")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", at int, name string, label string"

    def run(batches):
        marks = marker()
        for whole in batches:
            for b in parts(whole):
                words = [words_of(t.as_py()) for t in b.column(b.num_columns - 1)]
                rows = [(k, i + 1, name, label) for k, found in enumerate(marks(words)) for i, _, name, label in found]
                of, at, name, label = ([r[k] for r in rows] for k in range(4))
                columns = [b.column(k).take(pa.array(of, pa.int64())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int32()), pa.array(name, pa.string()), pa.array(label, pa.string())], names=[*(f.name for f in keep), "at", "name", "label"])

    return sentences.select(*(f.name for f in keep), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def by_gazetteer(sentences: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    """Sentence columns but text, at, name and label of all names of the gazetteer in sentences, whatever their case but with a capital first.

    Null and empty texts have no names; names within names are found too. Columns named at, name or
    label of the sentences aren't kept.
    """
    shared = sentences.sparkSession.sparkContext.broadcast(gazetteer.names)

    def marker():
        known = Gazetteer(shared.value)
        return lambda sentences_words: [known.find(w) for w in sentences_words]

    return _over_sentences(sentences, marker)


# the tagger


def shape(word: str) -> str:
    """Classes of the word's characters, runs of one class once."""
    if word.isascii() and word.isalpha() and word[1:] == word[1:].lower():
        return "x" if word[0].islower() else "Xx" if word[1:] else "X"
    kinds = ["X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else c for c in word[:40]]
    return "".join(k for k, before in zip(kinds, ["", *kinds]) if k != before)


def features(words: list[str]) -> np.ndarray:
    """Places of each word's features as the word before, the word itself and the word after: its form, shape and last letters."""
    out = []
    for word in words:
        low = word.lower()
        out.append((_places(f"w{low[:60]}"), _common_places(f"s{shape(word)}"), _common_places(f"e{low[-3:]}")))
    return np.array(out, dtype=np.int64).reshape(-1, 3, 3).transpose(0, 2, 1)


def _places(value: str) -> tuple[int, int, int]:
    a, b, c = xxhash.xxh32_intdigest(f"0{value}"), xxhash.xxh32_intdigest(f"1{value}"), xxhash.xxh32_intdigest(f"2{value}")
    return a & (PLACES - 1), b & (PLACES - 1), c & (PLACES - 1)


_common_places = functools.lru_cache(1 << 16)(_places)


def extend(found: list[tuple[int, int, str, str]], n: int) -> list[str]:
    """Labels of n words: B- at a name's first word, I- at the others; the longer and earlier of names that overlap counts."""
    tags = [OUTSIDE] * n
    for i, size, _, label in sorted(found, key=lambda x: (-x[1], x[0])):
        if all(t == OUTSIDE for t in tags[i : i + size]):
            tags[i : i + size] = [f"B-{label}"] + [f"I-{label}"] * (size - 1)
    return tags


def names_of(words: list[str], tags: list[str]) -> list[tuple[int, int, str, str]]:
    """The names that labels mark; those without a letter or digit are left out."""
    out, k = [], 0
    while k < len(tags):
        size = 1
        if tags[k][:2] == "B-":
            while k + size < len(tags) and tags[k + size] == f"I-{tags[k][2:]}":
                size += 1
            if name := cleaned(words[k : k + size]):
                out.append((k, size, name, tags[k][2:]))
        k += size
    return out


@dataclasses.dataclass
class Tagger:
    """Label scores of features, and of one label after another; `steps` is minus infinity where a name would go on that hasn't begun."""

    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, 3, len(self.labels)))

    def scores(self, places: np.ndarray) -> np.ndarray:
        """Words' parts in the scores of the word after them, their own, and that before them."""
        return self.weights[places].sum(axis=2)

    def numbered(self, words: list[str]) -> np.ndarray:
        """Rows of the table that words have, new ones at its end; a full table is begun anew."""
        new = set(words) - self.number.keys()
        if len(self.number) + len(new) > SEEN:
            self.forget()
            new = set(words)
        if new:
            at = len(self.number)
            self.number.update((w, at + k) for k, w in enumerate(new))
            self.table = np.concatenate([self.table[:at], self.scores(features(list(new)))])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word's labels."""
        own = self.table[self.numbered(["", *words, ""])]
        return own[1:-1, 1] + own[:-2, 0] + own[2:, 2]

    def best(self, sentences: list[list[str]]) -> list[list[int]]:
        """The best labels of each sentence; of equal ones those with the smaller numbers from the end on."""
        out: list[list[int]] = [[] for _ in sentences]
        order = sorted((k for k, w in enumerate(sentences) if w), key=lambda k: len(sentences[k]))
        at = 0
        while at < len(order):
            # sentences of about one length together
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(sentences[order[to]]) <= TOGETHER:
                to += 1
            group = order[at:to]
            rows = self.numbered([w for k in group for w in ("", *sentences[k], "")])
            sizes = np.array([len(sentences[k]) for k in group])
            tags = self.decoded(self.table[rows], sizes)
            for row, k in enumerate(group):
                out[k] = tags[row, : sizes[row]].tolist()
            at = to
        return out

    def path(self, e: list[list[float]]) -> list[int]:
        """The best labels of one sentence by its words' scores, in plain numbers: arrays of a few rows cost more."""
        last, start = self.steps[:-1].T.tolist(), self.steps[-1].tolist()
        may = [[(a, s) for a, s in enumerate(by) if s != -np.inf] for by in last]
        score, back = [x + s for x, s in zip(e[0], start)], []
        for x in e[1:]:
            new, of = [], []
            for b, before in enumerate(may):
                top, best = -np.inf, 0
                for a, s in before:
                    if (by := score[a] + s) > top:
                        top, best = by, a
                new.append(top + x[b])
                of.append(best)
            score = new
            back.append(of)
        tags = [score.index(max(score))]
        for of in reversed(back):
            tags.append(of[tags[-1]])
        return tags[::-1]

    def decoded(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels of sentences in order of their sizes, a row each; own has the scores of their words and of an empty one at either end."""
        n, most, kinds = len(sizes), int(sizes[-1]), range(len(self.labels))
        if n < FEW:
            ends, tags = np.cumsum(sizes + 2).tolist(), np.zeros((n, most), np.int64)
            for k, (end, size) in enumerate(zip(ends, sizes.tolist())):
                o = own[end - size - 2 : end]
                tags[k, :size] = self.path((o[1:-1, 1] + o[:-2, 0] + o[2:, 2]).tolist())
            return tags
        row = np.repeat(np.arange(n), sizes)
        word = np.arange(len(row)) + 2 * row + 1
        e = np.zeros((most, len(self.labels), n))
        e[word - 1 - (np.cumsum(sizes + 2) - sizes - 2)[row], :, row] = own[word, 1] + own[word - 1, 0] + own[word + 1, 2]
        back, final = np.zeros(e.shape, np.int16), np.zeros(e.shape[1:])
        score, first = e[0] + self.steps[-1][:, None], 0
        for t in range(1, most + 1):
            # shorter sentences have ended
            past = int(np.searchsorted(sizes, t, "right"))
            final[:, first:past] = score[:, : past - first]
            if past == n:
                break
            score, first = score[:, past - first :], past
            top, of = score[0] + self.steps[0][:, None], back[t, :, first:]
            for a in kinds[1:]:
                by = score[a] + self.steps[a][:, None]
                more = by > top
                of[more] = a
                top = np.where(more, by, top)
            score = top + e[t, :, first:]
        tag, tags = final.argmax(axis=0), np.zeros((n, most), np.int64)
        for t in range(most - 1, -1, -1):
            first = int(np.searchsorted(sizes, t, "right"))
            tags[first:, t] = tag[first:]
            tag[first:] = back[t, tag[first:], np.arange(first, n)]
        return tags

    def find(self, sentences: list[list[str]]) -> list[list[tuple[int, int, str, str]]]:
        return [names_of(w, [self.labels[k] for k in tags]) if any(tags) else [] for w, tags in zip(sentences, self.best(sentences))]


def steps_of(labels: list[str]) -> np.ndarray:
    """0 where a label may follow another, the last row being a sentence's start; minus infinity elsewhere."""
    steps = np.zeros((len(labels) + 1, len(labels)))
    for j, b in enumerate(labels):
        if b[:2] == "I-":
            for i, a in enumerate([*labels, OUTSIDE]):
                if a not in (b, f"B-{b[2:]}"):
                    steps[i, j] = -np.inf
    return steps


def fit(sentences: list[list[str]], tags: list[list[str]], seed: int = 7) -> Tagger:
    """An averaged perceptron: after each sentence that it labels wrongly, features of the right labels gain and those of its own lose."""
    kinds = sorted({t[2:] for x in tags for t in x if t != OUTSIDE})
    labels = [OUTSIDE, *(f"{p}-{k}" for k in kinds for p in "BI")]
    number = {t: k for k, t in enumerate(labels)}
    model = Tagger(labels, np.zeros((PLACES, len(labels))), steps_of(labels))
    spent, spent_steps, now = np.zeros_like(model.weights), np.zeros_like(model.steps), 1.0
    held = [features(["", *words, ""]) if words else None for words in sentences]
    rng = np.random.default_rng(seed)
    allowed = np.isfinite(model.steps)
    for _ in range(ROUNDS):
        for k in rng.permutation(len(sentences)):
            if held[k] is None:
                continue
            f = held[k]
            want, got = [number[t] for t in tags[k]], model.decoded(model.scores(f), np.array([len(f) - 2]))[0].tolist()
            if want != got:
                for sign, said in ((1.0, want), (-1.0, got)):
                    for t, (a, b) in enumerate(zip([len(labels), *said], said)):
                        place = np.concatenate([f[t + 1, 1], f[t, 0], f[t + 2, 2]])
                        np.add.at(model.weights, (place, b), sign)
                        np.add.at(spent, (place, b), sign * now)
                        model.steps[a, b] += sign
                        spent_steps[a, b] += sign * now
            now += 1
    steps = np.where(allowed, model.steps - np.where(allowed, spent_steps, 0) / now, -np.inf)
    return Tagger(labels, model.weights - spent / now, steps)


def learn(sentences: DataFrame, gazetteer: DataFrame, most: int = SAMPLE) -> Tagger:
    """A tagger fitted on the labels that the gazetteer gives to a sample: of the sentences(text) the most with the smallest hashes that are not null."""
    rows = sentences.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).orderBy(F.xxhash64("text"), "text").limit(most).collect()
    known, words = gazetteer_of(gazetteer), [words_of(r["text"]) for r in rows]
    return fit(words, [extend(known.find(w), len(w)) for w in words])


def by_tagger(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """Sentence columns but text, at, name and label of the names that a tagger finds; null and empty texts have none."""
    shared = sentences.sparkSession.sparkContext.broadcast((tagger.labels, tagger.weights, tagger.steps))
    return _over_sentences(sentences, lambda: Tagger(*shared.value).find)
