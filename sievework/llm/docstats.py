"""Structure statistics of documents, computed for a whole Arrow slice at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Buffer, Words, buffer_of, span_hash, words_of

NAMES = ["log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "stop", "wide", "space", "log_lines", "words_per_line", "same_line", "distinct_words", "top_word", "word_repeats", "long_words"]


def _share(flag: np.ndarray, buf: Buffer, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return (total[buf.at[1:]] - total[buf.at[:-1]]) / size


def _per_doc(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(distinct keys, occurrences of the most frequent key) of each document."""
    if not len(key):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times, owner = np.diff(np.append(first, len(key))), doc[first]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, times)
    return np.bincount(owner, minlength=n), top


def statistics(text: pa.Array) -> tuple[np.ndarray, Buffer, Words]:
    """float64 (documents, len(NAMES)); shares of nothing are 0, so null and empty texts give a row of zeros. Also the buffer and the words,
    whose hashes are of ASCII-lower-cased bytes."""
    buf = buffer_of(text, lower=False)
    raw, size = buf.data, np.maximum(np.diff(buf.at), 1).astype(float)
    upper = (raw >= 65) & (raw <= 90)
    low = Buffer(np.where(upper, raw + 32, raw).astype(np.uint8), buf.at)
    w = words_of(low, hashes=False)
    sums = low.sums()
    w.hash = span_hash(sums, w.start, w.end)
    n, doc = len(size), w.doc()
    words = np.maximum(w.count, 1).astype(float)
    length = (w.end - w.start).astype(float)
    digit = (raw >= 48) & (raw <= 57)
    wide = raw >= 128
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    letter = upper | ((raw >= 97) & (raw <= 122)) | wide
    stop = (raw == 46) | (raw == 44)
    end = np.zeros(len(raw), bool)
    end[raw == 10] = True
    begin = buf.at[:-1][np.diff(buf.at) > 0]
    first = np.zeros(len(raw), bool)
    first[1:] = end[:-1]
    first[begin] = True
    start = np.flatnonzero(first)
    owner = np.searchsorted(buf.at, start, "right") - 1
    lines = np.bincount(owner, minlength=n)
    stop_at = np.append(start[1:], len(raw))
    stop_at = np.minimum(stop_at, buf.at[owner + 1]) if len(owner) else stop_at
    trimmed = stop_at - (raw[np.maximum(stop_at - 1, 0)] == 10) if len(raw) else stop_at
    full = trimmed > start
    distinct_lines, _ = _per_doc(owner[full], span_hash(sums, start[full], trimmed[full]), n)
    full_lines = np.bincount(owner[full], minlength=n)
    distinct, top = _per_doc(doc, w.hash, n)
    again = np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    mean = np.bincount(doc, length, n) / words
    share = lambda flag: _share(flag, buf, size)
    out = np.stack(
        [np.log1p(w.count), mean, share(upper), share(digit), share(~(letter | digit | space)), share(raw == 33), share(raw == 124), share(stop), share(wide), share(space),
         np.log1p(lines), w.count / np.maximum(lines, 1), 1 - distinct_lines / np.maximum(full_lines, 1), distinct / words, top / words, np.bincount(doc, again, n) / words, np.bincount(doc, length > 12, n) / words], axis=1
    )
    out[w.count == 0] = np.where(np.isfinite(out[w.count == 0]), out[w.count == 0], 0)
    out[w.count == 0, NAMES.index("same_line")] = 0
    return out, buf, w
