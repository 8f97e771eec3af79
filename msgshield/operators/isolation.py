"""A scorer that raises for some texts of a batch: the others still get their scores.

Importable on its own, like ``worker_models``: functions shipped to the workers refer to it.
"""

from __future__ import annotations

import pandas as pd

MAX_FAILURES_IN_A_ROW = 64


def score_apart(fn, texts: pd.Series, labels, patience: int = MAX_FAILURES_IN_A_ROW) -> tuple[list, list]:
    """``(probabilities, errors)`` per text; exactly one of the two is null for each.

    A batch that raises is halved until the texts that raise stand alone, so one bad text among n
    costs about 2 log2(n) calls. A scorer that fails ``patience`` times without one success in
    between is taken to be down: the texts not yet tried get the last error and are offered again later,
    as every failed text is.
    """
    out: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    parts, failures = [(0, len(texts))] if len(texts) else [], 0
    while parts:
        start, stop = parts.pop()
        try:
            if failures >= patience:
                raise RuntimeError(f"scorer unavailable: {last}")
            scores = fn(texts.iloc[start:stop].reset_index(drop=True))[labels]
            rows = [list(map(float, r)) for r in scores.itertuples(index=False)]
            if len(rows) != stop - start:
                raise ValueError(f"{len(rows)} results for {stop - start} texts")
        except Exception as e:  # noqa: BLE001 - whatever a user's model raises
            if failures < patience:
                failures, last = failures + 1, f"{type(e).__name__}: {e}"
            if stop - start > 1 and failures < patience:
                half = (start + stop) // 2
                parts += [(half, stop), (start, half)]
            else:
                errors[start:stop] = [last if failures < patience else f"scorer unavailable: {last}"] * (stop - start)
            continue
        failures = 0
        out[start:stop] = rows
    return out, errors
