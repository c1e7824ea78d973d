"""Toxicity by weak supervision.

Voters - words and word beginnings, how dense they are, and patterns of tone in
several languages - vote toxic or clean or abstain. A generative label model is
fitted to the votes alone by expectation-maximisation: each voter's accuracy, and
the correlations of voters given the label as a tree of dependent pairs. A linear
classifier is trained on its posterior labels, and scores whole texts. Marks of
labelled rows choose the voters and give the share of toxic rows; they are no votes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, prepare_workers, sliced, trimmed

#: The bounded sample that voters and classifier are fitted on: rows of each label, and characters of a text.
ROWS_EACH, CHARS_EACH = 4000, 20_000
#: Word beginnings, in letters; lexicon voters; features of the classifier; words a worker keeps the features of.
BEGINNINGS, VOTERS, FEATURES, KEPT_WORDS = (4, 5, 6), 120, 1000, 150_000
#: One word in so many is dense.
DENSE = 200
#: Lexicon words in a thousand words: steps that are features of the classifier; the step from which a voter calls a row toxic, and that below which one calls it clean.
LEVELS, TOXIC_LEVEL, CLEAN_LEVEL = (2, 4, 6, 8, 10, 13, 16, 20, 30, 50), 13, 6

_words = re.compile(r"[^\W\d_]+").findall

#: Patterns of tone, each a voter. The second words address somebody in English, German, French and Spanish.
PATTERNS = {
    "shouted words": re.compile(r"(?:\b[A-ZÀ-Þ]{4,}\b\W+){3}"),
    "exclamations": re.compile(r"!{2,}"),
    "masked words": re.compile(r"\b\w\*{2,}\w*|\b\w+\*{2,}"),
    "addressed": re.compile(r"\b(?:you(?:'re| are) (?:a|an|such|so)|du bist (?:ein|eine|so)|tu es (?:un|une|si)|eres (?:un|una|tan))\b", re.IGNORECASE),
    "told off": re.compile(r"\b(?:shut up|halt die|ferme-la|tais-toi|cállate)\b", re.IGNORECASE),
    "drawn-out words": re.compile(r"\b\w*([a-z])\1{3,}\w*\b"),
}


def features_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings behind a mark."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def present(text: str | None) -> tuple[Counter, int]:
    """How often each feature's words are in a text, and the number of words."""
    counts = Counter(_words((text or "").lower()))
    found: Counter = Counter()
    for w, c in counts.items():
        for f in features_of(w):
            found[f] += c
    return found, sum(counts.values())


@dataclass
class Scored:
    """Weights of the features, the lexicon, and the bias; ``score`` is for whole texts. A feature with a plus is one that is dense, ``=L`` is a level of the lexicon's words."""

    weights: dict[str, float]
    lexicon: frozenset[str]
    bias: float
    words: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        counts = Counter(_words((text or "").lower()))
        known, weights = self.words, self.weights
        if len(known) > KEPT_WORDS:
            known.clear()
        found: Counter = Counter()
        n = hits = 0
        for w, c in counts.items():
            got = known.get(w)
            if got is None:
                fs = features_of(w)
                got = tuple(f for f in fs if f in weights or f + "+" in weights), any(f in self.lexicon for f in fs)
                if len(w) <= 64:
                    known[w] = got
            n += c
            hits += c if got[1] else 0
            for f in got[0]:
                found[f] += c
        z = self.bias
        for f in sorted(found):
            z += weights.get(f, 0.0)
            if found[f] * DENSE >= n:
                z += weights.get(f + "+", 0.0)
        for level in LEVELS:
            if hits and hits * 1000 >= level * n:
                z += weights.get(f"={level}", 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode(), seed=3) >> 1


def bags_of(texts: list[str]) -> list[np.ndarray]:
    """The features of each text, and with a plus those that are dense, as sorted 63-bit hashes, which take a tenth of the strings' memory."""
    hashes: dict[str, tuple[int, int]] = {}

    def bag(text: str) -> np.ndarray:
        found, n = present(text)
        if len(hashes) > 1_000_000:
            hashes.clear()
        out = []
        for f, c in found.items():
            if (h := hashes.get(f)) is None:
                h = hashes[f] = (_hash(f), _hash(f + "+"))
            out.append(h[0])
            if c * DENSE >= n:
                out.append(h[1])
        return np.unique(np.array(out, np.int64))

    return [bag(t) for t in texts]


def _names(texts: list[str], wanted: set[int]) -> dict[int, str]:
    """The feature of each wanted hash."""
    found: dict[int, str] = {}
    seen: set[str] = set()
    for t in texts:
        for w in set(_words(t.lower())) - seen:
            seen.add(w)
            for f in features_of(w):
                for g in (f, f + "+"):
                    if (h := _hash(g)) in wanted:
                        found[h] = g
    return found


def _counts(bags: list[np.ndarray], step: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and in how many bags each is, added up over a few bags at a time."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for s in range(0, len(bags), step):
        k, c = np.unique(np.concatenate(bags[s : s + step]), return_counts=True)
        keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, c]), len(keys)).astype(np.int64)
    return keys, n


def rated_features(bags: list[np.ndarray], toxic: np.ndarray, least_odds: float = 1.5) -> dict[int, float]:
    """Features commoner among toxic rows than among clean ones by more than chance, with their rating.

    The test is the likelihood ratio of a feature's rows against the share of
    toxic rows; it must exceed what the best of as many random features reach.
    """
    on, n_on = _counts([b for b, y in zip(bags, toxic) if y])
    off, n_off = _counts([b for b, y in zip(bags, toxic) if not y])
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    share = n1 / (n1 + n0)
    at = np.minimum(np.searchsorted(off, on), max(0, len(off) - 1))
    c = np.where(off[at] == on, n_off[at], 0) if len(off) else np.zeros(len(on), np.int64)
    odds = np.log(((n_on + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1)))
    part = n_on / (n_on + c)
    ratio = n_on * np.log(part / share) + np.where(c > 0, c * np.log(np.maximum(1 - part, 1e-300) / (1 - share)), 0)
    good = (odds > least_odds) & (ratio > math.log(len(on) + len(off) + 1) + 3)
    return dict(zip(on[good].tolist(), ratio[good].tolist()))


def mine_lexicon(texts: list[str], bags: list[np.ndarray], toxic: np.ndarray, most: int = VOTERS) -> list[str]:
    """The best features, the shorter one first if even, without those that only repeat a better one of the same words: at least nine tenths of their toxic rows have it."""
    rating = rated_features(bags, toxic)
    names = _names(texts, set(rating))
    order = sorted(names, key=lambda h: (-rating[h], len(names[h]), names[h]))
    wanted = np.array(sorted(order), np.int64)
    rows: dict[int, set[int]] = {h: set() for h in order}
    for r in np.flatnonzero(toxic).tolist():
        for h in bags[r][np.isin(bags[r], wanted)].tolist():
            rows[h].add(r)
    bare = {h: names[h].strip("^+") for h in order}
    taken: list[int] = []
    for h in order:
        own = rows[h]
        if not any((bare[h].startswith(bare[t]) or bare[t].startswith(bare[h])) and len(own & rows[t]) >= 0.9 * len(own) for t in taken):
            taken.append(h)
            if len(taken) == most:
                break
    return [names[h] for h in taken]


def levels_of(texts: list[str], lexicon: list[str]) -> np.ndarray:
    """Lexicon words in a thousand words of each text."""
    stems = {f.rstrip("+") for f in lexicon}
    known: dict[str, bool] = {}
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        n = hits = 0
        for w in _words(t.lower()):
            if (hit := known.get(w)) is None:
                hit = known[w] = any(f in stems for f in features_of(w))
            n += 1
            hits += hit
        out[i] = 1000 * hits / max(1, n)
    return out


def votes_of(texts: list[str], bags: list[np.ndarray], lexicon: list[str]) -> np.ndarray:
    """rows x voters: 1 toxic, -1 clean, 0 abstains. Lexicon, patterns, dense use of the lexicon; the last two vote clean: hardly any lexicon word, and none."""
    k = len(lexicon) + len(PATTERNS)
    out = np.zeros((len(texts), k + 3), np.int8)
    hashes = np.array([_hash(f) for f in lexicon], np.int64)
    for r, (t, bag) in enumerate(zip(texts, bags)):
        out[r, : len(lexicon)] = np.isin(hashes, bag)
        for j, p in enumerate(PATTERNS.values()):
            out[r, len(lexicon) + j] = 1 if p.search(t) else 0
    level = levels_of(texts, lexicon)
    out[:, k] = level >= TOXIC_LEVEL
    out[:, k + 1] = -(level < CLEAN_LEVEL).astype(np.int8)
    out[:, k + 2] = -(level == 0).astype(np.int8)
    return out


@dataclass
class LabelModel:
    """The share of toxic rows; each voter's parent (-1: none) in the tree of correlations; P(speaks | label, parent speaks): 2 x 2 x voters; and the posterior of the rows it was fitted on."""

    prior: float
    parent: np.ndarray
    speak: np.ndarray
    final: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        spoke = votes != 0
        up = np.where(self.parent >= 0, spoke[:, self.parent], False).astype(np.int64)
        at = np.arange(votes.shape[1])
        z = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        for label, sign in ((1, 1.0), (0, -1.0)):
            p = self.speak[label][up, at]
            z += sign * np.log(np.where(spoke, p, 1 - p)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def accuracies(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """How often each voter is right when it speaks, by the posterior labels."""
    right = np.where(votes > 0, posterior[:, None], np.where(votes < 0, 1 - posterior[:, None], 0)).sum(axis=0)
    return (right + 0.5) / ((votes != 0).sum(axis=0) + 1)


def _tree(joint: np.ndarray, single: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the maximum spanning forest of mutual information given the label. joint: 2 x voters x voters, P(both speak); single: 2 x voters."""
    m = single.shape[1]
    info = np.zeros((m, m))
    for y in (0, 1):
        a, b = single[y][:, None], single[y][None, :]
        for p, q in ((joint[y], a * b), (a - joint[y], a * (1 - b)), (b - joint[y], (1 - a) * b), (1 - a - b + joint[y], (1 - a) * (1 - b))):
            p = np.maximum(p, 1e-12)
            info += weight[y] * p * np.log(p / np.maximum(q, 1e-12))
    np.fill_diagonal(info, 0)
    parent, best, via = np.full(m, -1), np.full(m, -1.0), np.full(m, -1)
    left = np.ones(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(left, best, -2)))
        left[j] = False
        if best[j] > least:
            parent[j] = via[j]
        closer = left & (info[j] > best)
        best[closer], via[closer] = info[j][closer], j
    return parent


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over the votes alone, from an even vote of those that speak. A voter that turns out to speak against its vote is taken to say nothing."""
    spoke, n = (votes != 0).astype(float), max(1, len(votes))
    against = (votes < 0).any(axis=0)
    # an even vote of those that speak
    ballot = votes.astype(float).sum(axis=1) / np.maximum(1, spoke.sum(axis=1))
    p = 1 / (1 + np.exp(-4 * ballot))
    model = None
    for _ in range(rounds):
        weight = np.stack([1 - p, p])
        sums = weight.sum(axis=1)
        single = np.clip((weight @ spoke + 0.5) / (sums[:, None] + 1), 1e-4, 1 - 1e-4)
        both = np.stack([(spoke * w[:, None]).T @ spoke for w in weight])
        joint = (both + 0.25) / (sums[:, None, None] + 1)
        parent = _tree(np.minimum(joint, np.minimum(single[:, :, None], single[:, None, :])), single, sums / n, math.log(n + 1) / n)
        speak = np.repeat(single[:, None, :], 2, axis=1)
        for j in np.flatnonzero(parent >= 0):
            i = parent[j]
            for y in (0, 1):
                on, all_on = both[y, i, j], both[y, i, i]
                # drawn towards the voter's own rate, as few rows may have a parent that speaks
                speak[y, 1, j] = (on + 2 * single[y, j]) / (all_on + 2)
                speak[y, 0, j] = (both[y, j, j] - on + 2 * single[y, j]) / (sums[y] - all_on + 2)
        speak = np.clip(speak, 1e-4, 1 - 1e-4)
        wrong = np.where(against, single[1] > single[0], single[0] > single[1])
        speak[:, :, wrong] = speak.mean(axis=0, keepdims=True)[:, :, wrong]
        model = LabelModel(prior, parent, speak)
        new = model.posterior(votes)
        if np.abs(new - p).max(initial=0) < 1e-4:
            p = new
            break
        p = new
    model.final = p
    return model


def fit_linear(bags: list[np.ndarray], levels: np.ndarray, posterior: np.ndarray, lexicon: list[str], names: list[str], weight: np.ndarray, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> Scored:
    """Logistic regression on posterior labels by Adam; rows x features is sparse."""
    hashes = np.array([_hash(f) for f in names], np.int64)
    pairs = [(r, i) for r, bag in enumerate(bags) for i in np.flatnonzero(np.isin(hashes, bag)).tolist()]
    pairs += [(r, len(names) + i) for r, x in enumerate(levels) for i, level in enumerate(LEVELS) if x > 0 and x >= level]
    names = [*names, *(f"={level}" for level in LEVELS)]
    rows, cols = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    w, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(bags)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - posterior) * weight
        grad = np.concatenate([np.bincount(cols, g[rows], len(names)) + decay * w[:-1], [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return Scored({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, frozenset(f.rstrip("+") for f in lexicon), float(w[-1]))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows_each: int = ROWS_EACH) -> tuple[list[str], np.ndarray, float]:
    """Texts, labels and the share of toxic rows, of about ``rows_each`` ids of each label outside the held-out fold, drawn by a hash of the id. Of rows with one id the one with the least text is taken, of labels with one id the toxic one; texts of more than CHARS_EACH characters are not learned from."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc("doc_id") % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], np.zeros(0, np.int64), 0.0
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(21)), 12).cast("double") / F.lit(float(1 << 52))
    drawn = marked.filter(F.when(F.col("toxic") == 1, u < rows_each / counts[1]).otherwise(u < rows_each / counts[0]))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= CHARS_EACH))
    # about 2 x rows_each ids are drawn at any input size, so they are broadcast and texts stay where they are
    rows = picked.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([int(r["toxic"]) for r in rows], np.int64), counts[1] / (counts[0] + counts[1])


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Scored | None:
    """The classifier trained on the label model's posterior; None without rows of both labels. share: of toxic rows before drawing."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    bags = bags_of(texts)
    lexicon = mine_lexicon(texts, bags, toxic)
    model = fit_label_model(votes_of(texts, bags, lexicon), float(toxic.mean()))
    # features: the lexicon, and what else the posterior labels set apart
    guess = (model.final > 0.5).astype(np.int64)
    more = mine_lexicon(texts, bags, guess, FEATURES) if 0 < guess.sum() < len(guess) else []
    names = list(dict.fromkeys([*lexicon, *more]))
    # drawn rows weigh as all rows of their label do
    weight = np.where(guess == 1, max(share, 0.2) / max(1, guess.sum()), (1 - max(share, 0.2)) / max(1, (1 - guess).sum()))
    return fit_linear(bags, levels_of(texts, lexicon), model.final, lexicon, names, weight)


def train(docs: DataFrame, labels: DataFrame, **columns) -> Scored | None:
    return fit(*training_sample(docs, labels, **columns))


def score_toxicity(docs: DataFrame, model: Scored | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``, with the columns in ``keep``.

    Null text: as empty, whose score is that of the bias. Without a model (no
    rows of both labels) all scores are 0. Only the text is an input. Repeated
    rows each get their result; no rows: none. Very long texts count whole; a
    worker holds the distinct words of one. Columns in ``keep`` must not have the
    names of the result.
    """
    prepare_workers(docs.sparkSession)
    kept = [c for c in keep if c != id_col]
    held = F.coalesce(id_crc(id_col) % 5 == 0, F.lit(False)).alias("held_out")
    picked = docs.select(F.col(id_col).alias("doc_id"), held, F.col(text).alias("_text"), *kept)
    types = dict(picked.dtypes)
    schema = f"doc_id {types['doc_id']}, held_out boolean, score double, predicted int" + "".join(f", `{c}` {types[c]}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [model.score(t) if model else 0.0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), *(batch.column(c) for c in kept)], ["doc_id", "held_out", "score", "predicted", *kept])

    return picked.mapInArrow(trimmed(work), schema)


def keep_clean(docs: DataFrame, model: Scored | None, most_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``most_score``; without a model all of them. Null text: as empty."""
    prepare_workers(docs.sparkSession)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([model is None or model.score(t) < most_score for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(work), docs.schema)
