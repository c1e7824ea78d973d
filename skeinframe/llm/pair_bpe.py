"""BPE encoding by a pair occurrence index, and decoding.

All new pieces of a batch are laid out in one linked list of symbols. An index
maps each pair that has a rank to all its positions; active ranks are applied in
ascending order from a heap, each to all its positions, and the lists of the
pairs left and right of a merge are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers, sliced, text_or_empty, tokenizer_path
from .encoding import ALPHABET, ChunkEncoder

#: Characters of text whose new pieces are indexed together.
BATCH_CHARS = 8_000_000


class PairIndexEncoder(ChunkEncoder):
    def __init__(self, path: str, **options):
        super().__init__(path, **options)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 2
        #: by rank: left, right, merged
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a * self.size + b: r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.first = np.array([vocab[c] for c in ALPHABET], np.int64)
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self._keys_sorted, self._ranks_sorted = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        back = {c: b for b, c in enumerate(ALPHABET)}
        self.bytes_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self._byte = {c: b for b, c in enumerate(ALPHABET)}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        byte, size = self._byte, self.size
        raw = b"".join([bytes([byte[c] for c in p]) for p in pieces])
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)  # a separator stands before each piece, and one at the end
        symbols = np.full(len(raw) + len(pieces) + 1, -1, np.int64)
        slots = np.ones(len(symbols), bool)
        slots[0] = False
        slots[ends] = False
        symbols[slots] = self.first[np.frombuffer(raw, np.uint8)]
        key = symbols[:-1] * size + symbols[1:]
        key[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self._keys_sorted, key), len(self._keys_sorted) - 1)
        places = np.flatnonzero(self._keys_sorted[at] == key)
        ranks = self._ranks_sorted[at[places]]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, np.int64)
        index = {int(ranks[s]): p.tolist() for s, p in zip(starts, np.split(places, starts[1:]))}
        active = list(index)
        heapq.heapify(active)
        sym, after, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank_of, merges = self.rank.get, self.merges
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            for p in sorted(index.pop(r)):
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue  # an earlier merge took one of the two
                n = after[q]
                sym[p], sym[q], after[p], before[n] = new, -2, n, p
                l = before[p]  # noqa: E741
                if (x := sym[l]) >= 0 and (k := rank_of(x * size + new)) is not None:
                    if k in index:
                        index[k].append(l)
                    else:
                        index[k] = [l]
                        heapq.heappush(active, k)
                if (x := sym[n]) >= 0 and (k := rank_of(new * size + x)) is not None:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(active, k)
        out = np.array(sym, np.int64)
        counts = np.add.reduceat((out >= 0).astype(np.int64), np.r_[0, ends[:-1]]) if len(pieces) else []
        flat, stop = out[out >= 0].astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [flat[s:e] for s, e in zip(np.r_[0, stop[:-1]].tolist(), stop.tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pair_encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def _gathered(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``chars`` characters."""
    ids, texts, n = [], [], 0
    for batch in sliced(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            n += len(t)
            if n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (binary: little-endian unsigned 32-bit) with the decoded text, or with ``digests`` their SHA-256 in hex.

    Null text: as empty, so no ids. A special token's string in a text is that
    token. Each row gets its result, repeated rows too; no rows: none. Memory:
    the pieces new to about 8 MB of text, and a bounded table of known ones.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    prepare_workers(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    id_type = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, kind = pair_encoder(path), None
        for ids, texts in _gathered(batches, BATCH_CHARS):
            blobs = codec.encode_many(texts)
            for s in range(0, len(ids), 256):
                some = blobs[s : s + 256]
                plain = map(codec.decode, some)
                if digests:
                    last = [[hashlib.sha256(b).hexdigest() for b in some], [hashlib.sha256(t.encode()).hexdigest() for t in plain]]
                else:
                    last = [some, list(plain)]
                arrays = [pa.array(ids[s : s + 256], kind), pa.array([len(b) // 4 for b in some], pa.int64()), *(pa.array(x, pa.string() if isinstance(x[0], str) else pa.binary()) for x in last)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in schema.split(", ")])

    return picked.mapInArrow(work, schema)
