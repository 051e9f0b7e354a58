"""Operator 3: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text's
likelihood is the product over its words, and a word's is the sum over all its segmentations
into pieces, which a forward algorithm adds up. The probabilities are fitted by expectation
maximisation (forward and backward sums) over the words of a bounded sample of labelled
documents: about `sample_docs` of each language, chosen by a hash of the id, whole texts.

Words are runs of letters in lower case, of any length: those over `LONGEST` letters are summed
with logarithms, in a window of the longest piece, the others in bulk. A letter that is no piece
has a small probability of its own. Words' likelihoods are kept in each worker in bounded
generations. Null text, or one without letters, is `und` with score 0; so is every
text where no label was seen. The score is the probability of the language among those
learned, of likelihoods taken to the power that a text of `SURE_LETTERS` would give, so that
it tells short or mixed texts from sure ones. Ties go to the first language in order. A null
id counts as empty text in the hashes. Repeated rows are predicted alike; extra columns are
kept, those named like the new ones are replaced.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, bounded_batches, col, texts, tokenizer_file

#: Labelled documents of each language from which the model learns, on average.
SAMPLE_DOCS = 500
#: Letters of a word up to which words are summed in bulk; the probabilities of longer ones
#: would vanish without logarithms.
LONGEST = 32
#: Places in the lattices that are held at once.
LATTICE = 1 << 17
ROUNDS, SMOOTHING, UNKNOWN = 3, 0.1, 1e-6
SURE_LETTERS = 40
#: Words that a worker keeps scored, in each of two generations.
CACHE = 200_000
START = "▁"
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that words are made of, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(path))
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == START or _WORD.fullmatch(p.removeprefix(START))})


class Lattice:
    """Words and the pieces at each place, for words of one length."""

    def __init__(self, index: dict[str, int], found: list[str], longest: int):
        marked = [START + w for w in found]
        self.n, self.size = len(marked), len(marked[0])
        #: (start, end, piece's number): 0 is no piece, 1 an unknown letter.
        self.arcs = []
        for end in range(1, self.size + 1):
            for start in range(max(0, end - longest), end):
                other = 1 if end - start == 1 else 0
                at = np.fromiter((index.get(w[start:end], other) for w in marked), np.int32, self.n)
                if at.any():
                    self.arcs.append((start, end, at))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(place, word, language): the sum over all segmentations up to the place."""
        out = np.zeros((self.size + 1, self.n, p.shape[1]))
        out[0] = 1
        for start, end, at in self.arcs:
            out[end] += out[start] * p[at]
        return out

    def backward(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size + 1, self.n, p.shape[1]))
        out[self.size] = 1
        for start, end, at in reversed(self.arcs):
            out[start] += out[end] * p[at]
        return out


class LongWord:
    """One word of any length, with logarithms of the sums."""

    def __init__(self, index: dict[str, int], word: str, longest: int):
        marked = START + word
        self.size = len(marked)
        #: By end: the starts and numbers of its pieces.
        self.arcs = []
        for end in range(1, self.size + 1):
            known = [(start, index.get(marked[start:end], 1 if end - start == 1 else 0)) for start in range(max(0, end - longest), end)]
            self.arcs.append([(start, i) for start, i in known if i])

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(place, language): the logarithm of the sum over all segmentations up to the place."""
        logs, out = _logs(p), np.full((self.size + 1, p.shape[1]), -np.inf)
        out[0] = 0
        for end, arcs in enumerate(self.arcs, 1):
            out[end] = _log_sum(np.stack([out[start] + logs[i] for start, i in arcs]))
        return out

    def seen(self, p: np.ndarray) -> np.ndarray:
        """The expected number of each piece, for one language."""
        logs, f, n = _logs(p)[:, 0], self.forward(p)[:, 0], np.zeros(len(p))
        back = np.full(self.size + 1, -np.inf)
        back[self.size] = 0
        for end in range(self.size, 0, -1):
            for start, i in self.arcs[end - 1]:
                back[start] = np.logaddexp(back[start], back[end] + logs[i])
                n[i] += np.exp(f[start] + logs[i] + back[end] - f[-1])
        return n


def _logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=0)
    return most + np.log(np.exp(x - most).sum(axis=0))


def _by_length(found: list[str]) -> dict[int, list[str]]:
    """Words up to LONGEST letters, of one length and in parts that a lattice holds."""
    out = defaultdict(list)
    for w in found:
        if len(w) <= LONGEST:
            out[len(w)].append(w)
    return {(n, a): group[a : a + step] for n, group in out.items() for step in [max(1, LATTICE // (n + 2))] for a in range(0, len(group), step)}


@dataclass
class Model:
    """Languages, pieces, and the probability of each piece (after two reserved rows) by language."""

    name: str
    langs: list[str]
    pieces: list[str]
    p: np.ndarray

    @property
    def index(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.pieces, 2)}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def log_likelihoods(self, index: dict[str, int], found: list[str]) -> np.ndarray:
        """(word, language) of the words, as float32."""
        out, at = np.empty((len(found), len(self.langs)), np.float32), {w: i for i, w in enumerate(found)}
        for part in _by_length(found).values():
            out[[at[w] for w in part]] = np.log(Lattice(index, part, self.longest).forward(self.p)[-1])
        for w, i in at.items():
            if len(w) > LONGEST:
                out[i] = LongWord(index, w, self.longest).forward(self.p)[-1]
        return out


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """The model of each language's word counts."""
    langs = sorted(counts)
    model = Model(uuid.uuid4().hex, langs, pieces, np.zeros((len(pieces) + 2, len(langs))))
    index = model.index
    for k, lang in enumerate(langs):
        p = np.full((len(pieces) + 2, 1), 1 / (len(pieces) + 2))
        p[0], p[1] = 0, UNKNOWN
        lattices = [(Lattice(index, part, model.longest), np.array([counts[lang][w] for w in part], float)) for part in _by_length(sorted(counts[lang])).values()]
        long = [(LongWord(index, w, model.longest), n) for w, n in sorted(counts[lang].items()) if len(w) > LONGEST]
        for _ in range(rounds):
            seen = np.zeros(len(p))
            for lattice, n in lattices:
                f, b = lattice.forward(p)[:, :, 0], lattice.backward(p)[:, :, 0]
                for start, end, at in lattice.arcs:
                    seen += np.bincount(at, n * f[start] * p[at, 0] * b[end] / f[-1], len(p))
            for word, n in long:
                seen += n * word.seen(p)
            seen[2:] += SMOOTHING
            seen[0] = seen[1] = 0
            p = (seen / seen.sum() * (1 - UNKNOWN))[:, None]
            p[1] = UNKNOWN
        model.p[:, k] = p[:, 0]
    return model


class Scorer:
    """Words' likelihoods, computed in bulk and kept in two bounded generations."""

    def __init__(self, model: Model):
        self.model, self.index = model, model.index
        self.rows = np.empty((2 * CACHE, len(model.langs)), np.float32)
        self.newer: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.half = 0

    def scores(self, counters: list[Counter]) -> np.ndarray:
        """(text, language) log-likelihoods; a word of several texts is scored once."""
        found = list(set().union(*counters))
        rows, place = self.of_words(found), {w: i for i, w in enumerate(found)}
        out = np.zeros((len(counters), len(self.model.langs)))
        for i, c in enumerate(counters):
            out[i] = np.fromiter(c.values(), np.float64, len(c)) @ rows[list(map(place.__getitem__, c))]
        return out

    def of_words(self, found: list[str]) -> np.ndarray:
        out = np.empty((len(found), len(self.model.langs)), np.float32)
        at = np.fromiter((self.newer.get(w, -1) for w in found), np.int64, len(found))
        out[at >= 0] = self.rows[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        before = np.fromiter((self.older.get(found[i], -1) for i in new), np.int64, len(new))
        out[new[before >= 0]] = self.rows[before[before >= 0]]
        fresh = new[before < 0]
        out[fresh] = self.model.log_likelihoods(self.index, [found[i] for i in fresh])
        for a in range(0, len(new), CACHE):
            self._keep(new[a : a + CACHE], found, out)
        return out

    def _keep(self, new: np.ndarray, found: list[str], values: np.ndarray) -> None:
        if len(self.newer) + len(new) > CACHE:
            self.older, self.newer, self.half = self.newer, {}, 1 - self.half
        start = self.half * CACHE + len(self.newer)
        self.rows[start : start + len(new)] = values[new]
        self.newer.update(zip((found[i] for i in new), range(start, start + len(new)), strict=True))


_KEPT: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """Of this model; a worker keeps one for its later tasks."""
    if model.name not in _KEPT:
        _KEPT.clear()
        _KEPT[model.name] = Scorer(model)
    return _KEPT[model.name]


def _predictor(sent):
    model: Model = sent.value
    if not model.langs:
        return lambda text: [[UND] * len(text), [0.0] * len(text)]
    scorer = _scorer(model)

    def work(text: pa.Array) -> list[list]:
        counters = [Counter(words(x)) for x in texts(text)]
        found = scorer.scores(counters)
        letters = np.array([sum(len(w) * n for w, n in c.items()) for c in counters], float)
        found *= np.minimum(1, SURE_LETTERS / np.maximum(letters, 1))[:, None]
        p = np.exp(found - found.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [[model.langs[b] if n else UND for b, n in zip(best.tolist(), letters.tolist(), strict=True)], [float(p[i, b]) if letters[i] else 0.0 for i, b in enumerate(best.tolist())]]

    return work


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % 4


def train(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int | None = 2, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits a model to a sample of the labelled rows whose remainder isn't `held_out`."""
    bounded_batches(df.sparkSession)
    learned = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    if held_out is not None:
        learned = learned.where(remainder(id_col) != held_out)
    sizes = {r[0]: r[1] for r in learned.groupBy(col(lang_col)).count().collect()}
    if not sizes:
        return Model(uuid.uuid4().hex, [], pieces, np.zeros((len(pieces) + 2, 0)))
    steps = 1 << 30
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(steps, -(-steps * sample_docs // n)))))
    chosen = learned.where(F.pmod(F.xxhash64(F.coalesce(col(id_col).cast("string"), F.lit(""))), F.lit(steps)) < F.element_at(share, col(lang_col)))

    def count(batches):
        for batch in batches:
            by = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                by[lang].update(words(text))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted = chosen.select(col(lang_col).cast("string"), col(text_col)).mapInArrow(count, "lang string, word string, n long")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in counted.groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts[r[0]][r[1]] = r[2]
    return fit(counts, pieces)


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of its texts and the score."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return append_columns(df, [text_col], [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())], _predictor, sent)
