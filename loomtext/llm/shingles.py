"""Word shingles and minwise signatures of texts, as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile("[a-z0-9]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_S32, _S48 = np.uint64(32), np.uint64(48)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; empty for null."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; one run of all words where there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= _MIX
        acc ^= acc >> _S32
        acc += words[j : n + j]
    acc ^= acc >> _S32
    acc *= _FOLD
    acc ^= acc >> _S32
    return np.unique(acc)


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, (count, 1), np.uint64), rng.integers(0, 2**63, (count, 1), np.uint64) | np.uint64(1)


def minwise(sh: np.ndarray, xors: np.ndarray, odds: np.ndarray, bits: int = 16) -> np.ndarray:
    """b-bit minwise signature: for each permutation the low bits of the least hash."""
    v = sh[None, :] ^ xors
    v *= odds
    v ^= v >> _S32
    v *= _MIX
    least = v.min(axis=1)
    least *= _FOLD
    return (least >> np.uint64(64 - bits)).astype(np.uint64)


def keyed(parts: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One 64-bit join key per row of `parts` (symbols of 16 bits), apart for different block numbers."""
    acc = number.astype(np.uint64) + np.uint64(1)
    for j in range(parts.shape[1]):
        acc *= _MIX
        acc ^= acc >> _S32
        acc += parts[:, j]
    acc *= _FOLD
    acc ^= acc >> _S32
    return acc


def neighbour_blocks(symbols: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a signature with one allowed error each: (rows of symbol positions, block numbers).

    A chunk of `chunk` symbols gives `chunk` blocks, each without one symbol.
    Two signatures that differ in at most 2 * (symbols / chunk) - 1 symbols
    have, by pigeonhole, a chunk with at most one error, so they share a block.
    """
    rows, numbers = [], []
    for c in range(symbols // chunk):
        for out in range(chunk):
            rows.append([c * chunk + i for i in range(chunk) if i != out])
            numbers.append(c * chunk + out)
    return np.array(rows), np.array(numbers)


def permuted_blocks(symbols: int, size: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of `size` symbols of the signature under `rounds` fixed permutations."""
    rng = np.random.default_rng(seed)
    rows = [p[i : i + size] for p in (rng.permutation(symbols) for _ in range(rounds)) for i in range(0, symbols - size + 1, size)]
    return np.sort(np.array(rows), axis=1), np.arange(len(rows))


def _binary(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


def signer(id_col: str, text_col: str, k: int, min_words: int, symbols: int, blocks: tuple[np.ndarray, np.ndarray], seed: int, carry: tuple[str, ...] = (), code: bool = False) -> Callable:
    """mapInArrow function to (id, carried columns, digest, keys[, code]): a digest of the word sequence, the join keys, and the bit fingerprint as 64-bit words.

    Texts with fewer than min_words words are dropped; null counts as none.
    """
    rows, numbers = blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xors, odds = _permutations(symbols, seed)
        for b in batches:
            at, digests, keys, codes = [], [], [], []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                w = word_hashes(text)
                if len(w) < min_words:
                    continue
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(w.tobytes()))
                signature = minwise(shingles(w, k), xors, odds)
                keys.append(keyed(signature[rows], numbers))
                if code:
                    codes.append(signature.astype(np.uint16).view(np.int64))
            take = pa.array(at, pa.int64())
            lists = [_lists(keys, len(numbers), np.uint64), *[_lists(codes, symbols // 4, np.int64)] * code]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(take), *(b.column(c).take(take) for c in carry), _binary(digests), *lists], ["id", *carry, "digest", "keys", *["code"] * code])

    return run


def _lists(parts: list[np.ndarray], each: int, kind: type) -> pa.ListArray:
    """One list of `each` numbers a row."""
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) * each + 1, each, dtype=np.int32)), pa.array(flat.view(np.int64)))


def shingler(id_col: str, text_col: str, k: int) -> Callable:
    """mapInArrow function to (id, sh): the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sh = [shingles(word_hashes(t), k) for t in b.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, sh)]).astype(np.int32)
            flat = np.concatenate(sh) if sh else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["id", "sh"])

    return run
