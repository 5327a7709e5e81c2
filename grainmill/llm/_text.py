"""Batches of texts as arrays of code points, for operators that scan characters with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from grainmill.llm._common import WORKER_STATE


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in WORKER_STATE:
        WORKER_STATE["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return WORKER_STATE["letters"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text starts (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), at


def by_size(column, limit: int = 400_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of the Arrow column's texts of about `limit` bytes (or one text), with the place of the first."""
    first, run, size = 0, [], 0
    for k, x in enumerate(column):
        text = x.as_py()
        run.append(text)
        size += len(text or "")
        if size >= limit:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run
