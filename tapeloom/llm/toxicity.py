"""Toxicity by weak supervision: lexicon and pattern voters, a label model, and a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, map_arrow, only

#: At most so many labelled rows of each class are fitted on (those with the smallest hashes of their doc_id); lexicon voters.
FIT_ROWS, VOTERS = 6000, 12
#: A token is a word, or the beginning of one with so many letters and a star.
STEMS = (4, 5, 6, 7, 8)
MIN_ROWS = 3
#: Share of toxic texts among the texts that hold a token of the lexicon, at least.
PRECISION = 0.75
#: The same of the tokens that voters vote by; the rest of the lexicon is for the classifier alone.
SURE = 0.95
#: Words that hit the lexicon which one Python worker remembers the features of; texts that are Python strings at a time.
REMEMBERED, SLICE = 500_000, 512
#: Lexicon, number of its sure tokens, weights, intercept.
Model = tuple[list[str], int, list[float], float]
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "exclaiming", "symbols", "repeating", "two hits", "three hits", "sparse", "dense", "very dense")


def tokens_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def patterns_of(text: str, words: list[str], hits: int) -> tuple[bool, ...]:
    """Votes of the pattern voters: capitals, exclamation marks, symbols in words, one word again and again, and how
    many different words hit the lexicon."""
    n = max(len(words), 1)
    return (
        sum(w.isupper() and len(w) > 1 for w in words) * 3 > n,
        text.count("!") * 10 > n,
        sum(map(text.count, "#*$%&@")) * 10 > n,
        len(words) >= 20 and len(set(words)) * 4 < n,
        hits >= 2,
        hits >= 3,
        hits * 400 < n and hits >= 1,
        hits * 120 >= n,
        hits * 40 >= n,
    )


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null doc_id counts as an empty text, so as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Features:
    """Numbers of the lexicon's tokens that a text holds, and of the patterns that it shows (after the tokens).

    The first ``sure`` tokens of the lexicon are those that count as hits in the patterns.
    """

    def __init__(self, lexicon: list[str], sure: int) -> None:
        self.sure = sure
        self.number = {t: k for k, t in enumerate(lexicon)}
        self.known: dict[str, tuple[int, ...]] = {}
        # a word that hits begins as a token does; words that don't needn't be remembered
        self.heads = {t.rstrip("*")[: STEMS[0]] for t in lexicon}

    def __call__(self, text: str) -> list[int]:
        words = WORD.findall(text)
        found: set[int] = set()
        hits = 0
        heads, head = self.heads, STEMS[0]
        for w in [w for w in set(map(str.lower, words)) if w[:head] in heads]:
            hit = self.known.get(w)
            if hit is None:
                hit = tuple(self.number[t] for t in tokens_of(w) if t in self.number)
                if hit:
                    self.known[w] = hit
            found.update(hit)
            hits += any(k < self.sure for k in hit)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        n = len(self.number)
        return [*sorted(found), *[n + k for k, on in enumerate(patterns_of(text, words, hits)) if on]]


def slices(batches: Iterable[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most ``rows``, so that few texts are Python strings at once."""
    rows = rows or SLICE
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of all labelled documents that may be learned from.

    A document with several labels is toxic if one says so; null labels and null doc_ids count as none.
    """
    known = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return known.join(only(docs, "doc_id").distinct(), "doc_id", "left_semi")


def fit_rows(docs: DataFrame, known: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` documents of each class of ``known``."""
    known = known.withColumn("h", F.xxhash64("doc_id"))
    some = [known.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(most) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]).drop("h"))  # at most 2 * most rows
    return cut(only(docs, "doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))


def _count_tokens(tokens: set[str] | None):
    """Texts of each task that hold each token, of the given tokens only if there are some."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                words = {w.lower() for w in WORD.findall(text or "")}
                found = {t for w in words for t in tokens_of(w)}
                counts.update(found if tokens is None else found & tokens)
        every = list(counts.items())
        for at in range(0, len(every), 20_000):
            names, n = zip(*every[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], ["token", "n"])

    return task


def surprise(a: int, b: int, n1: int, n0: int) -> float:
    """Log likelihood ratio statistic of a of n1 against b of n0; 0 if a is no larger a share than b.

    It compares shares within the classes, so a and b are counts of rows that were seen, whatever the classes' ratio is.
    """
    if a * n0 <= b * n1:
        return 0.0
    p = (a + b) / (n1 + n0)
    parts = ((a, n1 * p), (n1 - a, n1 * (1 - p)), (b, n0 * p), (n0 - b, n0 * (1 - p)))
    return 2 * sum(x * float(np.log(x / e)) for x, e in parts if x > 0)


def learn_lexicon(rows: DataFrame, sizes: dict[int, int], least_surprise: float = 27.0) -> tuple[list[str], int]:
    """Tokens that toxic texts hold more often than chance among a million tokens explains,
    and other texts hardly ever, and how many of them are sure: these come first, most surprising ones ahead. ``sizes`` are the rows of each class that ``rows`` were taken from."""
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(1):
        return [], 0
    w1, w0 = (sizes.get(k, 0) / max(n.get(k, 0), 1) for k in (1, 0))
    found = map_arrow(rows.where("toxic = 1").select("text"), _count_tokens(None), "token string, n long")
    found = found.groupBy("token").agg(F.sum("n").alias("toxic"))
    least = min(MIN_ROWS, max(2, n[1] // 4))
    best = {r["token"]: r["toxic"] for r in found.where(F.col("toxic") >= least).collect()}  # tokens of the bounded sample
    counted = map_arrow(rows.where("toxic = 0").select("text"), _count_tokens(set(best)), "token string, n long")
    other = Counter({r[0]: r[1] for r in counted.groupBy("token").agg(F.sum("n")).collect()})
    scored = []
    for t, a in best.items():
        g = surprise(a, other[t], n[1], n.get(0, 0))
        precision = a * w1 / (a * w1 + other[t] * w0)
        if g > least_surprise and precision >= PRECISION:
            scored.append((precision < SURE, -g, t))
    scored.sort()
    return [t for _, _, t in scored], sum(not x[0] for x in scored)


def label_model(votes: np.ndarray, first: np.ndarray, mass: np.ndarray, steps: int = 10) -> np.ndarray:
    """Posterior of the toxic class from votes (rows x voters; 1 toxic, -1 not, 0 abstains); a row counts ``mass`` times.

    EM over two classes: each voter has, per class, a probability of each of its three votes (its accuracy). ``first`` are
    the first posteriors. Correlations: given the posteriors, the voters' residuals are correlated, and a voter's
    log odds are divided by the sum of its absolute correlations, so that voters that repeat each other count once.
    """
    kinds = np.stack([(votes == v).astype(float) for v in (-1, 0, 1)], axis=2)
    post = first.astype(float)
    for _ in range(steps):
        toxic, other = mass * post, mass * (1 - post)
        prior = np.clip(toxic.sum() / mass.sum(), 1e-3, 1 - 1e-3)
        p1 = (np.tensordot(toxic, kinds, 1) + 0.5) / (toxic.sum() + 1.5)
        p0 = (np.tensordot(other, kinds, 1) + 0.5) / (other.sum() + 1.5)
        expected = post[:, None] * (p1 @ np.array([-1, 0, 1.0])) + (1 - post)[:, None] * (p0 @ np.array([-1, 0, 1.0]))
        rest = votes - expected
        spread = np.sqrt(mass @ rest**2 / mass.sum()) + 1e-6
        corr = np.abs((rest.T @ (mass[:, None] * rest)) / mass.sum() / np.outer(spread, spread))
        np.fill_diagonal(corr, 1.0)
        corr[corr < 0.05] = 0
        told = corr.sum(axis=1)
        odds = (kinds * np.log(p1 / p0)).sum(axis=2) / told
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + odds.sum(axis=1), -30, 30)))
    return post


def linear(rows: list[list[int]], width: int, target: np.ndarray, mass: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with soft targets, the rarer class of more weight, by Adam; a row counts ``mass`` times."""
    x = np.zeros((len(rows), width), np.float32)
    for k, on in enumerate(rows):
        x[k, on] = 1
    share = float(np.clip(mass @ target / mass.sum(), 1e-3, 1 - 1e-3))
    weight = target / (2 * share**0.5) + (1 - target) / (2 * (1 - share) ** 0.5)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        r = mass * weight * (p - target) / mass.sum()
        g = np.append(x.T @ r + penalty * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _features_task(lexicon: list[str], sure: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon, sure)
        for batch in slices(batches):
            on = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(on, pa.list_(pa.int32()))], ["toxic", "features"])

    return task


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """(lexicon, its sure tokens, weights of its tokens and of the patterns, intercept). Everything is learned from fit_rows().

    Of a class with more than ``most`` rows each fitted row stands for several, so that the classes keep the ratio they have
    over all labelled rows: in the precision asked of a token, the label model's prior and the classifier's intercept.

    Sure tokens are dealt in turn to VOTERS lexicon voters: each votes toxic for a text that holds one of its tokens and not
    toxic for one that holds no sure token at all, else it abstains. Pattern voters vote toxic or abstain. The given label
    is the last voter, whose accuracy is estimated and whose correlations are discounted like those of the rest. The label
    model starts from the other voters (toxic are texts with two votes for it or more) and turns all votes into posterior
    labels, on which the linear classifier is trained; its inputs are all tokens of the lexicon and the patterns.
    """
    known = learnable(docs, labels)
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rows = fit_rows(docs, known, most)
    lexicon, sure = learn_lexicon(rows, sizes)
    if not lexicon:
        return [], 0, [], -30.0
    got = map_arrow(rows.select("toxic", "text"), _features_task(lexicon, sure), "toxic int, features array<int>").collect()  # 2 * most rows
    on, gold = [r["features"] for r in got], np.array([r["toxic"] for r in got], float)
    n, width = len(lexicon), len(lexicon) + len(PATTERNS)
    mass = np.where(gold == 1, sizes.get(1, 0) / max(gold.sum(), 1), sizes.get(0, 0) / max((1 - gold).sum(), 1))
    mass /= mass.mean()
    voters = min(VOTERS, max(3, sure // 8))
    votes = np.zeros((len(on), voters + len(PATTERNS) + 1))
    votes[:, -1] = 2 * gold - 1
    for k, features in enumerate(on):
        held = np.bincount([f % voters for f in features if f < sure], minlength=voters)
        votes[k, :voters] = np.where(held > 0, 1, 0 if held.any() else -1)
        for f in features:
            if f >= n:
                votes[k, voters + f - n] = 1
    target = label_model(votes, np.where((votes[:, :-1] > 0).sum(axis=1) >= 2, 0.9, 0.1), mass)
    w, b = linear(on, width, target, mass)
    return lexicon, sure, [float(x) for x in w], float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; only the text is an input of the score. Null texts are empty."""
    lexicon, sure, weights, intercept = model

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon, sure)
        for batch in slices(batches):
            z = np.array([intercept + sum(weights[f] for f in features(t or "")) if weights else intercept for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"]
            )

    out = map_arrow(only(docs, "doc_id", "text"), task, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Without toxic rows to learn from every score is near 0. Rows with equal texts get equal scores. Other columns, and
    labels of the held-out rows, are never read for the model.
    """
    return score(docs, fit(docs, labels, most))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    lexicon, sure, weights, intercept = fit(docs, labels, most)
    fields = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon, sure)
        for batch in slices(batches):
            keep = [intercept + (sum(weights[f] for f in features(t or "")) if weights else 0.0) < 0 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, task, fields)
