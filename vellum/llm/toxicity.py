"""Toxicity by weak supervision.

1. Terms (words and word beginnings) whose presence goes with the label are mined from a
   bounded sample of labelled training rows, in which near copies of a text count once: else
   every word of a toxic text that is copied often would pass for a toxic word.  Of a word
   and its beginnings with the same support only the longest is kept.
2. Every text of the corpus is read once and reduced to the terms and patterns it holds.
   Lexicon voters (terms by kind and half) and pattern voters vote on each text.
3. A generative label model is fitted to the votes of all texts: EM over a hidden label with
   a prior, an accuracy per voter and, by a tree over the voters (Chow-Liu on the
   conditional mutual information), their correlations.  It sees the texts only as counts
   of vote patterns, a partial/final aggregate of at most 2**voters rows.  The human label of
   a training row is one more voter; it abstains elsewhere.
4. A linear classifier over the terms and patterns is trained on the model's posterior
   labels of the sample and scores every text.

No score uses a label, a language, a source or an id.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import documents, land
from .token_count import byte_groups

#: Expected number of labelled training rows that terms and classifier are fitted on.
SAMPLE_ROWS = 20_000
#: Most terms kept, by training support.
MAX_TERMS = 4_000
MIN_SUPPORT = 6
#: Least lower bound (95 %) of a term's share of toxic training texts.
MIN_PRECISION = 0.4
PREFIXES = (3, 4, 5, 6)
#: Words whose terms a Python worker remembers.
KNOWN_WORDS = 50_000
KINDS = ("w", *(str(n) for n in PREFIXES))
HALVES = 2
PATTERNS = [
    ("shouting", re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", re.S)),
    ("exclaims", re.compile(r"!{2,}|[!?]{3,}")),
    ("masked", re.compile(r"[A-Za-z][*#@$]{1,4}[A-Za-z]|[A-Za-z]{2,}\*{2,}")),
]
VOTERS = [f"{k}/{h}" for k in KINDS for h in range(HALVES)] + [n for n, _ in PATTERNS]
WORD = re.compile(r"[^\W\d_]+")


def text_terms(text: str) -> set[str]:
    """Distinct terms: ``w:word`` and ``n:beginning`` of longer words, lower-cased."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add("w:" + w)
        for n in PREFIXES:
            if len(w) > n:
                out.add(f"{n}:{w[:n]}")
    return out


def training(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from: crc32(doc_id as text) mod 5 is
    not 0.  Null ids and labels are left out; of repeated rows the larger label counts."""
    t = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    t = t.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return t.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(train: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id."""
    n = train.count()
    if n <= rows:
        return train
    return train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def family(text: str) -> str:
    """The longest word (of equal ones the last in order): near copies share it, other
    texts hardly ever do."""
    return max(WORD.findall(text.lower()), key=lambda w: (len(w), w), default="")


def one_per_family(sample: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) with one row of each family and label, the one of the smallest
    doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([family(t) for t in b.column("text").to_pylist()], pa.string())],
                names=[*b.schema.names, "family"])

    named = sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, text string, toxic int, family string")
    return named.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", "toxic")


def _most_specific(support: dict[str, int], share: float = 0.9) -> set[str]:
    """Terms without those beginnings whose support is nearly that of a longer term."""
    drop = set()
    for term, n in support.items():
        kind, _, text = term.partition(":")
        for k in PREFIXES:
            if k < len(text) and n >= share * support.get(f"{k}:{text[:k]}", 10**12):
                drop.add(f"{k}:{text[:k]}")
    return set(support) - drop


def _count_terms(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(term, n): in how many texts each term stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                terms = text_terms(t)
                yield pa.RecordBatch.from_pydict({"term": sorted(terms if only is None else terms & only)},
                                                 schema=pa.schema([("term", pa.string())]))

    return texts.select("text").mapInArrow(run, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def mine_terms(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """Terms of toxic sample texts, by support and precision; ``sample`` has text, toxic.
    The sample and ``max_terms`` bound what comes to the driver."""
    cap = 10 * max_terms
    toxic = _count_terms(sample.where("toxic = 1"), None).where(F.col("n") >= MIN_SUPPORT)
    pos = {r["term"]: r["n"] for r in toxic.orderBy(F.desc("n"), "term").limit(cap).collect()}
    pos = {t: pos[t] for t in sorted(_most_specific(pos))}
    if not pos:
        return []
    neg = {r["term"]: r["n"] for r in _count_terms(sample.where("toxic = 0"), frozenset(pos)).collect()}
    good = []
    for term, a in pos.items():
        n = a + neg.get(term, 0)
        p, z = a / n, 1.96
        low = (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
        if low >= MIN_PRECISION:
            good.append((-a, term))
    return [t for _, t in sorted(good)[:max_terms]]


class Features:
    """Terms and patterns of a text, with a bounded memory of the words seen."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.voter = [KINDS.index(t.partition(":")[0]) * HALVES + zlib.crc32(t.encode()) % HALVES for t in terms]
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], int]:
        own: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            f = self.known.get(w)
            if f is None:
                if len(self.known) > KNOWN_WORDS:
                    self.known.clear()
                keys = ["w:" + w, *(f"{n}:{w[:n]}" for n in PREFIXES if len(w) > n)]
                f = self.known[w] = tuple(self.ids[k] for k in keys if k in self.ids)
            own.update(f)
        bits = 0
        for i in own:
            bits |= 1 << self.voter[i]
        for k, (_, pattern) in enumerate(PATTERNS):
            if pattern.search(text):
                own.add(len(self.ids) + k)
                bits |= 1 << (len(KINDS) * HALVES + k)
        return sorted(own), bits

    def of_texts(self, texts: pa.Array) -> Iterator[tuple[list[int], int]]:
        """The texts of an Arrow column, a bounded number of bytes as Python strings at a time."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for i, j in byte_groups(sizes):
            for t in texts.slice(i, j - i).to_pylist():
                yield self(t)


def featurise(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, features (ids of the terms and patterns present),
    votes (one bit per voter).  One pass over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(terms)
        for b in batches:
            found = list(of.of_texts(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f for f, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.int32())], names=["doc_id", "features", "votes"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, features array<int>, votes int")


@dataclass
class LabelModel:
    """P(label), and P(vote | label, vote of the parent voter) in a tree over the voters."""
    prior: float = 0.5
    parent: list[int] = field(default_factory=list)
    tables: np.ndarray | None = None        # [voter, label, parent's vote, vote]

    def posterior(self, votes: np.ndarray, label: np.ndarray, label_table: np.ndarray) -> np.ndarray:
        """P(label 1 | votes); ``label`` is 0, 1 or -1 (the human abstains)."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :] + np.zeros((len(votes), 1))
        for y in (0, 1):
            for j, p in enumerate(self.parent):
                above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
                log[:, y] += np.log(self.tables[j, y, above, votes[:, j]])
            log[:, y] += np.where(label < 0, 0.0, np.log(label_table[y, np.maximum(label, 0)]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def _tree(votes: np.ndarray, weight: np.ndarray, q: np.ndarray) -> list[int]:
    """Parents in the tree of largest conditional mutual information given the label."""
    v = votes.shape[1]
    gain = np.zeros((v, v))
    total = weight.sum()
    for y, w in ((0, weight * (1 - q)), (1, weight * q)):
        for i in range(v):
            for j in range(i):
                t = np.zeros((2, 2))
                np.add.at(t, (votes[:, i], votes[:, j]), w)
                t = (t + 0.01) / (t + 0.01).sum()
                m = t * np.log(t / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))
                gain[i, j] = gain[j, i] = gain[i, j] + m.sum() * w.sum() / total
    parent, inside = [-1] * v, [0]
    while len(inside) < v:
        i, j = max(((i, j) for i in inside for j in range(v) if j not in inside), key=lambda x: gain[x])
        parent[j] = i
        inside.append(j)
    return parent


def fit_label_model(patterns: list[tuple[int, int, int]], rounds: int = 40) -> tuple[LabelModel, np.ndarray]:
    """EM on (votes, label or -1, count).  Starts from the share of voters that fire."""
    bits = np.array([[p >> j & 1 for j in range(len(VOTERS))] for p, _, _ in patterns])
    label = np.array([x for _, x, _ in patterns])
    weight = np.array([n for _, _, n in patterns], float)
    model = LabelModel(parent=[-1] * len(VOTERS))
    q = np.where(label >= 0, np.where(label == 1, 0.95, 0.05), np.where(bits.any(1), 0.5 + bits.mean(1) / 2, 0.05))
    table = np.array([[0.95, 0.05], [0.05, 0.95]])
    for step in range(rounds):
        if step == rounds // 4:
            model.parent = _tree(bits, weight, q)
        model.prior = float(np.clip((weight * q).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        model.tables = np.full((len(VOTERS), 2, 2, 2), 0.5)
        for y, w in ((0, weight * (1 - q)), (1, weight * q)):
            for j, p in enumerate(model.parent):
                np.add.at(model.tables[j, y], (bits[:, p] if p >= 0 else np.zeros(len(bits), int), bits[:, j]), w)
            seen = label >= 0
            # The human is held to be right at least nine times in ten.
            right = ((w * (label == y))[seen].sum() + 9) / (w[seen].sum() + 10)
            right = min(max(right, 0.9), 0.995)
            table[y] = (right, 1 - right) if y == 0 else (1 - right, right)
        model.tables /= model.tables.sum(-1, keepdims=True)
        q = model.posterior(bits, label, table)
    return model, table


def fit_linear(rows: list[list[int]], q: np.ndarray, n_features: int, l2: float = 0.1,
               rounds: int = 600) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((c for r in rows for c in r), int, len(at))
    w = np.zeros(n_features + 1)
    w[-1] = np.log((q.mean() + 1e-4) / (1 - q.mean() + 1e-4))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(at, w[cols], len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - q
        g = np.concatenate([np.bincount(cols, err[at], n_features) + l2 * w[:-1], [err.sum()]]) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


def fit(features: DataFrame, train: DataFrame, sample: DataFrame, n_terms: int) -> np.ndarray:
    """Classifier weights from ``featurise``'s rows of the whole corpus, the training labels
    and the bounded sample."""
    j = features.join(train, "doc_id", "left").select("votes", F.coalesce("toxic", F.lit(-1)).alias("label"))
    patterns = [tuple(r) for r in j.groupBy("votes", "label").count().collect()]
    if not patterns:
        return np.zeros(n_terms + len(PATTERNS) + 1)
    model, table = fit_label_model(patterns)
    rows = features.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("features", "votes", "toxic").collect()
    if not rows:
        w = np.zeros(n_terms + len(PATTERNS) + 1)
        w[-1] = np.log(model.prior / (1 - model.prior))
        return w
    bits = np.array([[r["votes"] >> k & 1 for k in range(len(VOTERS))] for r in rows])
    q = model.posterior(bits, np.array([r["toxic"] for r in rows]), table)
    return fit_linear([r["features"] for r in rows], q, n_terms + len(PATTERNS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def classify(features: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score for rows of ``featurise``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [weights[-1] + weights[np.asarray(x or [], int)].sum() for x in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_sigmoid(np.array(z, float)))],
                                             names=["doc_id", "score"])

    return features.select("doc_id", "features").mapInArrow(run, "doc_id bigint, score double")


def train_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS,
             label_col: str = "toxic") -> tuple[list[str], np.ndarray, DataFrame]:
    """(terms, weights, features) fitted on ``docs`` (doc_id, text) and the training labels."""
    train = training(labels, label_col=label_col)
    sample = land(sample_of(train, sample_rows), "sample")
    # The sample's ids are bounded by sample_rows, which is why they may be broadcast.
    texts = land(one_per_family(docs.join(F.broadcast(sample), "doc_id")), "sample_texts")
    terms = mine_terms(texts, max_terms)
    features = land(featurise(docs, terms), "features")
    return terms, fit(features, train, texts.select("doc_id", "toxic"), len(terms)), features


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts hold no term and get the classifier's bias.  Without any label
    the score is the label model's prior; an empty table gives no rows.  Repeated rows
    and null ids are scored each; a null id is not held out.  Other columns of ``docs`` and
    ``labels`` are not read."""
    _, weights, features = train_on(documents(docs, id_col, text_col), labels, **options)
    return classify(features, weights).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.  A score
    depends on the text alone, so each row is judged where it lies: no text is shuffled."""
    terms, weights, _ = train_on(documents(docs, id_col, text_col), labels, **options)

    @F.arrow_udf("boolean")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Features(terms)
        for t in texts:
            z = np.array([weights[-1] + weights[np.asarray(f, int)].sum() for f, _ in of.of_texts(t)], float)
            yield pa.array(_sigmoid(z) >= 0.5)

    return docs.where(~toxic(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
