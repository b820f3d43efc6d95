"""Toxicity by weak supervision.

1. Voters. Lexicon voters are words and word beginnings: a short general list, and those that tell
   toxic from other labelled texts best. Pattern voters look at form (second-person insults, shouting,
   exclamation marks, masked words). One more voter is the annotator of the labelled rows. A voter
   fires or abstains; no voter is trusted.
2. Label model. A generative model of a hidden label and the votes: each voter fires with its own rate
   in either class (its accuracy), and within a class pairs of voters are correlated. Expectation
   maximisation estimates class prior, rates and correlations together; in the posterior, a
   fired voter's evidence is divided by one plus its correlations with the other fired voters, so
   voters that always fire together count about once.
3. Classifier. L1-penalised logistic regression on hashed words and word beginnings, trained on the
   posterior labels, scores every whole text. Labels, language, source and id are no inputs.

The training sample is bounded: ``MAX_LABELLED`` labelled rows (smallest XXH64 of the id first), near
copies among them thinned to one. Everything else covers all rows.

Defined cases: a null text is empty, an empty text gets the score of no evidence; labels that are null
are ignored, several labels of one document vote by majority (a tie is toxic); without labels
of both classes only the general list, the patterns and the prior ``PRIOR`` are left; repeated
rows get a row each and null ids are kept (they are never training rows); columns beside id and text are never inputs,
whatever their names; a text of any length is read whole, and its words count once.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import cut, id_and_text, slices

MAX_LABELLED = 12_000  # labelled rows that voters, label model and classifier are fitted on
MAX_VOTERS = 160  # mined lexicon voters
BUCKETS = 1 << 18
PRIOR = 0.1
ANNOTATOR = ((0.001, 0.05), (0.6, 0.95))  # how often the annotator marks clean and toxic texts
LEAST_GAIN = 8.0  # log-likelihood that a mined voter must explain
STARTS = (4, 5, 6)  # lengths of word beginnings
GENERAL = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
PATTERNS = (r"(?i)\byou(?:'re| are)? (?:an? |such an? )?(?:idiot|moron|loser|clown|pig|fool)", r"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}",
            r"!{3,}", r"\w[*@#$]{2,}\w", r"(?i)\bshut up\b", r"(?i)\bhate (?:you|them|him|her)\b")
WORD = re.compile(r"\w+")


def terms(word: str) -> list[str]:
    """The features of one word: itself and its beginnings."""
    return ["=" + word, *["^" + word[:n] for n in STARTS if len(word) >= n]]


def _words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learned from (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                  label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, text): the bounded training sample; near copies of the same label count once."""
    votes = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = id_and_text(docs).join(F.broadcast(some), "doc_id")  # max_labelled rows at most

    def mark(batches):
        for b in slices(batches):
            marks = []
            for text in b.column(2).to_pylist():
                w = WORD.findall(text.lower())
                grams = zip(w, w[1:], w[2:], strict=False)
                marks.append(min((xxhash.xxh64_intdigest(" ".join(g)) >> 1 for g in grams),
                                 default=xxhash.xxh64_intdigest(text) >> 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(marks, pa.int64())],
                                             names=["doc_id", "toxic", "text", "mark"])

    marked = rows.select("doc_id", "toxic", "text").mapInArrow(mark, "doc_id long, toxic int, text string, mark long")
    return (marked.groupBy("mark", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("kept"))
            .select("kept.doc_id", "toxic", "kept.text"))


def mine(sample: DataFrame, max_voters: int = MAX_VOTERS) -> list[str]:
    """Words and beginnings that speak for the toxic class, best first (by their likelihood ratio)."""
    def spread(batches):
        for b in slices(batches):
            found, toxic = [], []
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = {f for w in _words(text) for f in terms(w)}
                found += new
                toxic += [t] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())],
                                             names=["term", "toxic"])

    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # 2 rows
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    counts = (sample.select("toxic", "text").mapInArrow(spread, "term string, toxic int").groupBy("term")
              .agg(F.sum("toxic").cast("double").alias("k1"), F.sum(1 - F.col("toxic")).cast("double").alias("k0"))
              .where("k1 >= 3").where(F.col("k1") / n1 > 4 * (F.col("k0") + 0.5) / n0))
    rate = (F.col("k1") + F.col("k0")) / (n1 + n0)
    gain = F.col("k1") * F.log(F.col("k1") / n1 / rate) + F.col("k0") * F.log((F.col("k0") + 1e-9) / n0 / rate)
    best = counts.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).orderBy(
        F.desc("gain"), "term").limit(max_voters)
    return [r.term for r in best.select("term").collect()]  # max_voters rows


class LabelModel:
    """Rates and within-class correlations of voters that fire (1) or abstain (0), by expectation maximisation.

    The annotator is a voter of its own. Nothing else says which class is which, so the posterior starts
    from it and its rates stay within ``ANNOTATOR``; in those bounds it may be wrong like the others.
    The silence of all voters that tell the classes apart (rates that differ by a factor of two or
    more) has its own rate in either class; where some of them fire, the others' silence counts
    for their share of that evidence.
    """

    def __init__(self, steps: int = 12, prior: float = PRIOR):
        self.steps, self.prior = steps, prior

    def fit(self, votes: np.ndarray, annotator: np.ndarray) -> np.ndarray:
        """The posterior of the toxic class for each row of ``votes``."""
        v, marked = votes.astype(np.float64), annotator.astype(np.float64)
        self.telling = np.ones(v.shape[1], bool)
        post = np.where(marked > 0, 0.9, 0.02)
        for _ in range(self.steps):
            self.prior = float(np.clip(post.mean(), 0.005, 0.5))
            silent = self._silent(v).astype(np.float64)
            rates, spread, self.silence, self.marks = [], [], [], []
            for p, bounds in zip((1 - post, post), ANNOTATOR, strict=True):
                n = p.sum()
                rate = np.clip((p @ v + v.mean(axis=0) + 1e-3) / (n + 1 + 1e-3), 1e-5, 1 - 1e-5)
                centred = (v - rate) * np.sqrt(p)[:, None]
                rates.append(rate)
                spread.append(centred.T @ centred / (n + 1e-9))
                self.silence.append(float(np.clip((p @ silent + 0.5) / (n + 1), 1e-3, 1 - 1e-3)))
                self.marks.append(float(np.clip((p @ marked + 0.5) / (n + 1), *bounds)))
            self.rates = np.array(rates)
            cov = (1 - self.prior) * spread[0] + self.prior * spread[1]
            sd = np.sqrt(np.diag(cov)) + 1e-6
            self.correlations = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
            np.fill_diagonal(self.correlations, 0)
            post = self.posterior(v, marked)
            self.telling = np.abs(np.log(self.rates[1] / self.rates[0])) > np.log(2)
        return post

    def _silent(self, v: np.ndarray) -> np.ndarray:
        return v[:, self.telling].sum(axis=1) == 0

    def posterior(self, votes: np.ndarray, annotator: np.ndarray) -> np.ndarray:
        v, marked = votes.astype(np.float64), annotator.astype(np.float64)
        fired = (v / (1 + v @ self.correlations)) @ np.log(self.rates[1] / self.rates[0])
        share = np.where(self.telling, -np.log((1 - self.rates[1]) / (1 - self.rates[0])), 0).clip(0)
        share = share / (1 + self.correlations.sum(axis=0))
        quiet = np.log(self.silence[1] / self.silence[0]) * ((1 - v) @ share) / max(share.sum(), 1e-9)
        (m0, m1) = self.marks
        note = np.where(marked > 0, np.log(m1 / m0), np.log((1 - m1) / (1 - m0)))
        logit = np.log(self.prior / (1 - self.prior)) + note + fired + quiet
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _logistic(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, steps: int = 200,
              penalty: float = 1.5) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; an entry (row, col) adds 1 to that feature.

    Features are scaled to unit length. An uninformative one then correlates with the residuals by
    about 0.3 (the deviation of a label), so ``penalty`` keeps out what noise explains.
    """
    n, width = len(target), (int(cols.max()) + 1 if len(cols) else 0)
    scale = np.append(1 / np.sqrt(np.maximum(np.bincount(cols, minlength=width), 1)), 1 / np.sqrt(n))

    def ahead(w):
        return np.bincount(rows, (scale * w)[cols], n) + scale[-1] * w[-1]

    def back(r):
        return scale * np.append(np.bincount(cols, r[rows], width), r.sum())

    x = np.ones(width + 1)
    for _ in range(20):
        x = back(ahead(x / np.linalg.norm(x)))
    step = 4 / (1.1 * np.linalg.norm(x))
    w = np.zeros(width + 1)
    w[-1] = np.log(target.mean() / (1 - target.mean())) * np.sqrt(n)
    seen, t = w, 1.0
    for _ in range(steps):
        new = seen - step * back(1 / (1 + np.exp(-np.clip(ahead(seen), -30, 30))) - target)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        seen, w = new + (old - 1) / t * (new - w), new
    return float(w[-1] * scale[-1]), w[:-1] * scale[:-1]


def fit(sample: DataFrame) -> tuple[float, dict[int, float]]:
    """Intercept and the non-zero weights by bucket, learned from ``sample(doc_id, toxic, text)`` (bounded)."""
    sample = cut(sample)
    voters = list(dict.fromkeys(["=" + w for w in GENERAL] + mine(sample)))
    place = {v: i for i, v in enumerate(voters)}
    patterns = [re.compile(p) for p in PATTERNS]

    def votes_and_buckets(batches):
        for b in slices(batches):
            marked, fired, buckets = [], [], []
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [f for w in sorted(_words(text)) for f in terms(w)]
                hit = {place[f] for f in found if f in place}
                hit |= {len(voters) + i for i, p in enumerate(patterns) if p.search(text)}
                marked.append(bool(toxic))
                fired.append(sorted(hit))
                buckets.append([_bucket(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(marked, pa.bool_()), pa.array(fired, pa.list_(pa.int32())),
                 pa.array(buckets, pa.list_(pa.int32()))], names=["marked", "fired", "buckets"])

    got = (sample.orderBy("doc_id").select("toxic", "text")
           .mapInArrow(votes_and_buckets, "marked boolean, fired array<int>, buckets array<int>").toArrow())  # MAX_LABELLED rows
    n = got.num_rows
    if not n:
        return float(np.log(PRIOR / (1 - PRIOR))), {_bucket("=" + w): 4.0 for w in GENERAL}
    votes = np.zeros((n, len(voters) + len(patterns)), np.float32)
    for i, hit in enumerate(got.column("fired").to_pylist()):
        votes[i, hit] = 1
    post = LabelModel().fit(votes, got.column("marked").to_numpy())
    lists = got.column("buckets").combine_chunks()
    del got
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    cols = lists.values.to_numpy()
    often = np.bincount(cols, minlength=BUCKETS) >= 3
    keep = often[cols]
    names = np.flatnonzero(often)
    place_of = np.zeros(BUCKETS, np.int32)
    place_of[names] = np.arange(len(names))
    target = np.clip(post, 0.001, 0.999)
    rows, cols = rows[keep], place_of[cols[keep]]
    del lists, keep
    chosen = np.flatnonzero(_logistic(rows, cols, target)[1])
    keep = np.isin(cols, chosen)  # the chosen features once more, hardly shrunk
    b, w = _logistic(rows[keep], np.searchsorted(chosen, cols[keep]), target, penalty=0.1)
    return b, {int(k): float(x) for k, x in zip(names[chosen], w, strict=False) if x}


class _Scorer:
    """The classifier on one text; remembers the weight of a bounded number of words."""

    def __init__(self, model: tuple[float, dict[int, float]]):
        self.bias, self.weights = model
        self.known: dict[str, float] = {}

    def __call__(self, text: str) -> float:
        z, known = self.bias, self.known
        for w in _words(text):
            g = known.get(w)
            if g is None:
                if len(known) >= 200_000:
                    known.clear()
                g = known[w] = sum(self.weights.get(_bucket(f), 0.0) for f in terms(w))
            z += g
        return round(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))), 9)


def score(docs: DataFrame, model: tuple[float, dict[int, float]], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score): each row's whole text under the linear classifier, 0 to 1."""
    def run(batches):
        scorer = _Scorer(model)
        for b in slices(batches):
            out = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, whose score stays below one half."""
    model, at = fit(training_rows(docs, labels, max_labelled)), docs.columns.index("text")

    def run(batches):
        scorer = _Scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array([scorer(t or "") < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each document."""
    scored = score(docs, fit(training_rows(docs, labels, max_labelled)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
