"""What no built-in expresses: ring assembly (survey P-28)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _stitch(group: pd.DataFrame) -> Iterator[list[tuple[float, float]]]:
    """Closed rings of segments that share end points; what does not close is left out."""
    lines = [[(p["x"], p["y"]) for p in s] for s in group.sort_values("ord")["segment"] if len(s) > 1]
    ends: dict[tuple[float, float], list[int]] = {}
    for i, s in enumerate(lines):
        for p in {s[0], s[-1]}:
            ends.setdefault(p, []).append(i)
    used = [False] * len(lines)
    for i, s in enumerate(lines):
        if used[i]:
            continue
        used[i], ring = True, list(s)
        while ring[0] != ring[-1]:
            k = next((j for j in ends[ring[-1]] if not used[j]), None)
            if k is None:
                break
            used[k] = True
            more = lines[k] if lines[k][0] == ring[-1] else lines[k][::-1]
            ring += more[1:]
        if ring[0] == ring[-1] and len(ring) > 3:
            yield ring[:-1]


def assemble_rings(segments: DataFrame, key: str) -> DataFrame:
    """(key, ring_no, ring) of the closed rings of each key. segments: key, ord, segment (array of x, y); a key's segments are one outline."""
    kind = dict(segments.dtypes)[key]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rings = list(_stitch(group))
        return pd.DataFrame({key: [group[key].iloc[0]] * len(rings), "ring_no": range(len(rings)), "ring": [[{"x": x, "y": y} for x, y in r] for r in rings]})

    return segments.groupBy(key).applyInPandas(work, f"{key} {kind}, ring_no int, ring array<struct<x:double,y:double>>")
