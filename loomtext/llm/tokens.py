"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Where the vocabulary lies on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file, loaded once a Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


#: What a text is judged by, in this order.
SIGNALS = ("tokens a character", "letters", "capitals", "digits", "marks", "mark-up", "line breaks")
_KIND = np.full(256, 4, np.uint8)  # marks
_KIND[[*range(97, 123), *range(128, 256)]] = 0  # small letters and bytes beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 32]] = 3
_KIND[[60, 62, 123, 125, 124, 92]] = 5  # < > { } | \
_KIND[[10, 13]] = 6


def signals_of(text: str | None, tokens: int) -> list[float]:
    """Tokens a character, and shares of the kinds of characters, small differences of small shares spread out; zeros for no text."""
    if not text:
        return [0.0] * len(SIGNALS)
    n = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=7)
    whole = float(n.sum())
    small = np.log1p(100 * np.array([n[1], n[2], n[4], n[5], n[6]]) / whole)
    return [tokens / len(text), float(n[0] + n[1]) / whole, *small.tolist()]


def sizer(text_col: str, path: str, carry: tuple[str, ...], signals: bool = False) -> Callable:
    """mapInArrow function to the carried columns, tokens (0 for null and empty texts) and, if asked for, signals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            texts = b.column(text_col).to_pylist()
            sizes = [len(encode(t)) if t else 0 for t in texts]
            out = [*(b.column(c) for c in carry), pa.array(sizes, pa.int64())]
            if signals:
                out.append(pa.array([signals_of(t, n) for t, n in zip(texts, sizes)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, [*carry, "tokens", *["signals"] * signals])

    return run
