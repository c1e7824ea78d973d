"""Language identification by a byte convolutional network in numpy.

Filters of several widths slide over the UTF-8 bytes; a window keeps each
filter's maximum, and a softmax over these gives its language. A whole text is
cut into windows of one length, which are scored in batches; their log-odds are
averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_crc, prepare_workers, release, sliced, trimmed

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 12, 256
#: The bounded sample that the network is fitted on: documents a language, characters of each, documents of all languages.
DOCS_EACH, CHARS_EACH, SAMPLE_DOCS = 1500, 3000, 60_000


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # bytes x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width, what each byte adds at each place: width x 256 x FILTERS."""
        return [np.einsum("be,jef->jbf", self.embed, f).astype(np.float32) for f in self.filters]


def window_starts(n: int, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows of a text of n bytes, each of ``window`` bytes: one after the other, and the last one so that it ends with the text. A shorter text has one window."""
    starts = np.arange(0, max(1, n), window)
    starts[-1] = max(0, min(starts[-1], n - window))
    return starts


class Scorer:
    """The network over whole texts, BATCH windows of fixed length at a time, however long a text is. Filters of width 2 and 4 look up pairs of bytes."""

    BATCH = 256

    def __init__(self, net: Network):
        self.net = net
        t2, t3, t4 = net.tables()
        pair = lambda t, j: np.ascontiguousarray((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1))
        self.p2, self.p3, self.p4a, self.p4b, self.t3 = pair(t2, 0), pair(t3, 0), pair(t4, 0), pair(t4, 2), t3[2]
        self.x = np.zeros((self.BATCH, WINDOW), np.uint8)
        self.sizes, self.owner, self.weight = (np.zeros(self.BATCH, np.int64) for _ in range(3))

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-odds of each text's windows, weighted by the bytes that no window before has: texts x languages. Texts must not be empty."""
        out, held = np.zeros((len(texts), len(self.net.langs))), 0
        for doc, text in enumerate(texts):
            raw, done = np.frombuffer(text, np.uint8), 0
            for start in window_starts(len(raw)).tolist():
                part = raw[start : start + WINDOW]
                self.x[held, : len(part)], self.x[held, len(part) :] = part, 0
                self.sizes[held], self.owner[held], self.weight[held] = len(part), doc, start + len(part) - done
                done, held = start + len(part), held + 1
                if held == self.BATCH:
                    self._add(held, out)
                    held = 0
        if held:
            self._add(held, out)
        return out / np.array([len(t) for t in texts])[:, None]

    def _add(self, n: int, out: np.ndarray) -> None:
        x, sizes = self.x[:n], self.sizes[:n]
        code = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        short = np.flatnonzero(sizes < WINDOW)
        found = []
        for w in WIDTHS:
            if w == 2:
                a = self.p2.take(code, axis=0)
            elif w == 3:
                a = self.p3.take(code[:, :-1], axis=0)
                a += self.t3.take(x[:, 2:], axis=0)
            else:
                a = self.p4a.take(code[:, :-2], axis=0)
                a += self.p4b.take(code[:, 2:], axis=0)
            # places that begin and end within the text; one at least
            for i in short.tolist():
                a[i, max(1, sizes[i] - w + 1) :] = -np.inf
            found.append(a.max(axis=1))
        net = self.net
        odds = np.maximum(np.concatenate(found, axis=1) + net.bias, 0) @ net.out + net.out_bias
        np.add.at(out, self.owner[:n], odds * self.weight[:n, None])


def fit(texts: list[str], langs: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on windows of labelled texts: Adam on cross-entropy, with windows of 16 to WINDOW bytes, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    label = {x: i for i, x in enumerate(names)}
    windows, ys = [], []
    for t, y in zip(texts, langs):
        raw = t.encode()
        for n in (WINDOW, WINDOW, int(rng.integers(16, WINDOW))):
            if raw:
                s = int(rng.integers(0, max(1, len(raw) - n + 1)))
                windows.append(raw[s : s + n])
                ys.append(label[y])
    x = np.zeros((len(windows), WINDOW + max(WIDTHS)), np.uint8)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    sizes, ys = np.array([len(w) for w in windows]), np.array(ys)
    k, feats = len(names), FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(feats), "o": rng.normal(0, 0.1, (feats, k)), "c": np.zeros(k)}
    p |= {f"f{w}": rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
    mean, square = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    weight = len(ys) / (k * np.bincount(ys, minlength=k))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(ys))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            xb, nb, yb = x[pick], sizes[pick], ys[pick]
            rows = np.arange(len(pick))
            tables = {w: np.einsum("be,jef->jbf", p["e"], p[f"f{w}"]).astype(np.float32) for w in WIDTHS}
            pooled, where = [], {}
            for w in WIDTHS:
                a = tables[w][0][xb[:, :WINDOW]]
                for j in range(1, w):
                    a += tables[w][j][xb[:, j : WINDOW + j]]
                a[np.arange(WINDOW)[None, :] > np.maximum(nb - w, 0)[:, None]] = -1e9
                where[w] = a.argmax(axis=1)
                pooled.append(np.take_along_axis(a, where[w][:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + p["b"]
            act = np.maximum(h, 0)
            z = act @ p["o"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(axis=1, keepdims=True)
            q[rows, yb] -= 1
            q *= (weight[yb] / len(pick))[:, None]
            g = {"o": act.T @ q, "c": q.sum(axis=0)}
            dh = (q @ p["o"].T) * (h > 0)
            g["b"], g["e"] = dh.sum(axis=0), np.zeros_like(p["e"])
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(p[f"f{w}"])
                for j in range(w):
                    t = np.zeros((256, FILTERS))
                    np.add.at(t, (xb[rows[:, None], where[w] + j], np.arange(FILTERS)[None, :]), d)
                    g["e"] += t @ p[f"f{w}"][j].T
                    gf[j] = p["e"].T @ t
                g[f"f{w}"] = gf
            step += 1
            slow = rate * (1 - epoch / epochs)
            for n, v in g.items():
                mean[n] = 0.9 * mean[n] + 0.1 * v
                square[n] = 0.999 * square[n] + 0.001 * v * v
                p[n] -= slow * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
    return Network(names, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])


def training_sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = DOCS_EACH) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``docs_each`` ids of each language (fewer if all languages come to more than SAMPLE_DOCS), at most CHARS_EACH characters of each; drawn by a hash of the id. Of rows with one id and language the least part is taken. Documents of the held-out fold and those without a language never take part."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & (id_crc("doc_id") % 3 != 1))
    counts = durable(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs = counts.count()
    if not langs:
        return [], []
    each = max(1, min(docs_each, SAMPLE_DOCS // langs))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 12).cast("double") / F.lit(float(1 << 52))
    at = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.lit(1), F.length("text") - CHARS_EACH)).cast("int") + 1
    drawn = labelled.join(counts, "lang").filter(u * F.col("n") < each).select("doc_id", "lang", F.substring(F.col("text"), at, F.lit(CHARS_EACH)).alias("text"))
    rows = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    release(counts)
    rows.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def train(docs: DataFrame, **columns) -> Network | None:
    """A network fitted on ``training_sample``, or None if nothing is labelled."""
    texts, langs = training_sample(docs, **columns)
    return fit(texts, langs) if texts else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``, with the columns in ``keep``.

    Null texts and those without a letter: ``und`` with score 0, and so is all
    if nothing was labelled. score: the softmax of the mean log-odds. Only the
    text is an input. A null id is in no fold that is held out. Repeated rows
    each get their result; no rows: none. Very long texts count whole, some of
    their windows at a time. Columns in ``keep`` must not have the result's names.
    """
    prepare_workers(docs.sparkSession)
    held = F.coalesce(id_crc(id_col) % 3 == 1, F.lit(False)).alias("held_out")
    kept = [c for c in keep if c != id_col]
    picked = docs.select(F.col(id_col).alias("doc_id"), held, F.col(text).alias("_text"), *kept)
    types = dict(picked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", "held_out")) + ", lang_pred string, score double" + "".join(f", `{c}` {types[c]}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in sliced(batches):
            texts = batch.column("_text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if scorer and t and next(filter(str.isalpha, t), None)]
            if some:
                odds = scorer.log_odds([texts[i].encode() for i in some])
                best = odds.argmax(axis=1)
                share = 1 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip(some, best.tolist(), share.tolist()):
                    langs[i], scores[i] = net.langs[b], s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), *(batch.column(c) for c in kept)], ["doc_id", "held_out", "lang_pred", "score", *kept])

    return picked.mapInArrow(trimmed(work), schema)


def keep_identified(docs: DataFrame, net: Network | None, least_score: float = 0.35, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is identified: not ``und`` (null texts, texts without a letter), with ``least_score`` at least. Without a network, as nothing was labelled, all rows stay."""
    if net is None:
        return docs
    prepare_workers(docs.sparkSession)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            some = [i for i, t in enumerate(texts) if t and next(filter(str.isalpha, t), None)]
            keep = np.zeros(len(texts), bool)
            if some:
                odds = scorer.log_odds([texts[i].encode() for i in some])
                keep[some] = 1 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1) >= least_score
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(work), docs.schema)
