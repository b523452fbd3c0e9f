"""Language identification in two steps: the family first, then the language within it.

Texts are bags of hashed letter 2- to 4-grams (word boundaries count as a letter), with square
roots of the counts, scaled to length one.  Both steps are one-versus-one linear support
vector machines: a pair of families is told apart by one hyperplane, and so is each pair
of closely related languages, which sees texts of those two only.  The machines are fitted
by dual coordinate descent on a bounded sample: about ``SAMPLE_PER_LANGUAGE`` training rows of
each language, ``SAMPLE_ROWS`` in all, each once as a whole and once as a passage of a few words, of the
``MAX_LANGUAGES`` languages with most training rows.  Counts of languages cover all rows; every
text is read whole, in blocks.

A prediction sees the text alone.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import land, small_batches

#: Expected training rows of each language that the machines are fitted on.
SAMPLE_PER_LANGUAGE = 500
#: Expected training rows in all: with more than SAMPLE_ROWS / SAMPLE_PER_LANGUAGE languages each has fewer.
SAMPLE_ROWS = 8_000
#: Languages that are learned, those with most training rows (ties: the first name).
MAX_LANGUAGES = 64
BITS, GRAMS = 13, (2, 3, 4)
#: Letters of a text that are turned into features at a time.
BLOCK = 1 << 20
#: Words of a training row's passage.
PASSAGE = 8
UNKNOWN = "und"

#: ISO 639 codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "malayic": "id ms jv su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_letters: list[np.ndarray] = []


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return FAMILY_OF.get(code, "=" + lang)


def letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, values) of a whole text, or None where it holds no letter."""
    table, counts, tail, found = letters(), np.zeros(1 << BITS, np.int64), np.zeros(1, np.uint32), False
    text = text.lower()
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(table[c], c, np.uint32(0))
        found = found or bool(c.any())
        c = np.concatenate([tail, c, np.zeros(1 if at + BLOCK >= len(text) else 0, np.uint32)])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]      # runs of other characters are one
        # The grams of a block end in it: those that begin in the block before need its tail.
        old = min(len(tail), max(GRAMS) - 1) if at else 0
        for n in GRAMS:
            skip = max(0, old - n + 1)
            if len(c) - skip >= n:
                w = np.lib.stride_tricks.sliding_window_view(c[skip:], n)
                h = (w * _MIX[:n]).sum(1, dtype=np.uint32) + np.uint32(n * 0x165667B1 & 0xFFFFFFFF)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
        tail = c[-(max(GRAMS) - 1):]
    if not found:
        return None
    idx = np.nonzero(counts)[0]
    v = np.sqrt(counts[idx])
    return idx, v / np.sqrt((v * v).sum())


def passage(text: str, key: int) -> str:
    """A few consecutive words, at a place that the key decides."""
    words = text.split()
    start = key % max(1, len(words) - PASSAGE + 1)
    return " ".join(words[start:start + PASSAGE])


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge machine, by dual
    coordinate descent; ``y`` is 1 or -1.  Both classes weigh the same in total."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    share = np.array([(y == s).sum() for s in (-1, 1)])
    cost = c * len(y) / (2 * np.where(y > 0, share[1], share[0]))
    rnd = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rnd.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + w[-1]) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / (2 + 1 / (2 * cost[i])))         # |x|^2 is 2: one, and the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def fit_slope(z: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve through margins ``z`` of rows left out of the fit."""
    if not len(z):
        return 2.0
    slopes, right = np.geomspace(0.25, 16, 25), (len(z) + 1) / (len(z) + 2)     # Platt's softened targets
    loss = [(right * np.logaddexp(0, -s * z * y) + (1 - right) * np.logaddexp(0, s * z * y)).mean() for s in slopes]
    return float(slopes[int(np.argmin(loss))])


@dataclass
class Pairwise:
    """One-versus-one machines over ``names``; ``weights`` has a row per pair i < j, positive
    for i."""
    names: list[str]
    weights: np.ndarray
    slopes: np.ndarray

    @classmethod
    def fit(cls, rows: list, names_of: list[str]) -> "Pairwise":
        names = sorted(set(names_of))
        at = np.array([names.index(n) for n in names_of])
        weights, slopes = [], []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                of = np.nonzero((at == i) | (at == j))[0]
                y = np.where(at[of] == i, 1.0, -1.0)
                test = np.arange(len(of)) % 5 == 4
                if len(set(y[~test])) < 2:
                    test[:] = False
                part = [rows[k] for k in of]
                w = fit_svm([r for r, t in zip(part, test) if not t], y[~test])
                z = np.array([w[r[0]] @ r[1] + w[-1] for r, t in zip(part, test) if t])
                weights.append(w.astype(np.float32))
                slopes.append(fit_slope(z, y[test]))
        return cls(names, np.array(weights, np.float32).reshape(-1, (1 << BITS) + 1), np.array(slopes))

    def predict(self, idx: np.ndarray, v: np.ndarray) -> tuple[str, float]:
        """(name, probability): most pairs won, then the larger probability, then the first name."""
        k = len(self.names)
        if k == 1:
            return self.names[0], 1.0
        z = self.weights[:, idx] @ v + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(z * self.slopes, -30, 30)))
        r = np.full((k, k), 0.5)
        r[np.triu_indices(k, 1)] = p
        r.T[np.triu_indices(k, 1)] = 1 - p
        wins = (r > 0.5).sum(1)
        # Probability of i from its pairs (Price et al.): 1 / (sum of 1/r_ij - (k - 2)).
        np.fill_diagonal(r, 1.0)
        prob = 1 / np.maximum((1 / r).sum(1) - 1 - (k - 2), 1.0)
        best = max(range(k), key=lambda i: (wins[i], prob[i]))
        return self.names[best], float(prob[best] / max(prob.sum(), 1.0))


@dataclass
class Model:
    families: Pairwise | None
    within: dict[str, Pairwise]

    @classmethod
    def fit(cls, rows: list, langs: list[str]) -> "Model":
        if not rows:
            return cls(None, {})
        of = [family(x) for x in langs]
        within = {f: Pairwise.fit([r for r, g in zip(rows, of) if g == f], [x for x, g in zip(langs, of) if g == f])
                  for f in sorted(set(of))}
        return cls(Pairwise.fit(rows, of), within)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text else None
        if x is None or self.families is None:
            return UNKNOWN, 0.0
        group, p = self.families.predict(*x)
        lang, q = self.within[group].predict(*x)
        return lang, p * q


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal id modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_of(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(doc_id, text, lang): about ``per_language`` training rows of each learned language, by a
    hash of the id.  Rows with a null id, text or language are not learned from."""
    train = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~held_out(F.col("doc_id")))
    sizes = land(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES),
                 "languages")
    rows = min(per_language, SAMPLE_ROWS // max(1, sizes.count()))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("n") < 1_000_000 * rows
    # At most MAX_LANGUAGES rows.
    return train.join(F.broadcast(sizes), "lang").where(share).select("doc_id", "text", "lang")


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of ``docs`` (doc_id, text, lang)."""
    schema = "doc_id bigint, whole boolean, lang string, idx array<int>, val array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, text, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                for whole, t in ((True, text), (False, passage(text, d))):
                    x = features(t)
                    if x is not None:
                        out.append((d, whole, lang, x[0].astype(np.int32), x[1].astype(np.float32)))
            cols = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "whole", "lang", "idx", "val"])

    rows = sample_of(docs, per_language).mapInArrow(run, schema).toArrow().sort_by(
        [("doc_id", "ascending"), ("whole", "ascending"), ("lang", "ascending")])
    x = [(np.asarray(i.values, np.int64), np.asarray(v.values, float)) for i, v in zip(rows["idx"], rows["val"])]
    return Model.fit(x, rows["lang"].to_pylist())


def predict(docs: DataFrame, model: Model | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``model`` is fitted on the rows that may be learned from unless given.  A null text, and one
    without a letter, is ``und`` with score 0, and so is every text when nothing could be
    learned.  With one language learned, that one is predicted.  Repeated rows and null ids are
    predicted each; an empty table gives no rows.  Further columns are not read."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    model = model or fit(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in out], pa.string()),
                                              pa.array([p for _, p in out], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
