"""Language identification by rank-order profiles (out-of-place distance).

A profile is the ranking of a language's most frequent letter n-grams (one to three
letters, with a blank at word edges) over all its training documents.  A document is
ranked the same way over its whole text; each of its n-grams costs the difference of
the two ranks, and an n-gram that the profile lacks costs the profile's length.  The
language with the least cost wins, ties going to the smaller name.

``score`` is 1 - cost / greatest possible cost, so 1 is a perfect match and values
near 0 are texts that look like none of the languages.  A text that is null or has no
letter is ``und`` with score 0, and so is every text if there is nothing to learn from.

Counts are exact sums over all training texts.  Frequencies that tie are ranked by the
n-gram's code points.  Only the profiles (``profile_size`` rows a language) are sent to
the driver and to the tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of

PROFILE_SIZE = 400
UNKNOWN = "und"
#: Marks the place of a letter that a shorter n-gram doesn't have.
_NONE = (1 << 21) - 1

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point to its lower-case letter, 0 for what isn't a letter."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def count_ngrams(texts: list[str], merged: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, bounds): the distinct n-grams of text ``i`` are ``bounds[i]:bounds[i+1]``.

    A code holds three 21-bit places and codes ascend within a text; ``merged``
    counts over all texts together.  One sort of small keys (text, places as
    indices of the letters that occur) does the counting.
    """
    table = _letter_table()
    n = 1 if merged else len(texts)
    parts = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in parts], np.int64)
    c = np.zeros(int(sizes.sum()), np.uint32)  # a blank before and after each text
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for s, p in zip(starts[:-1], parts):
        c[s + 1 : s + 1 + len(p)] = table[p]
    owner = np.repeat(np.arange(len(parts), dtype=np.uint32), sizes)
    blank = c == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # runs of blanks count as one
    if len(c):
        keep[0] = True
    keep[starts[:-1]] = True
    c, owner = c[keep], owner[keep]
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    width = int(len(letters)).bit_length()
    kind = np.uint32 if 3 * width + (n - 1).bit_length() <= 32 else np.uint64  # small keys sort faster
    index = np.zeros(0x110000, kind)
    index[letters] = np.arange(len(letters), dtype=kind)
    bits, none, x = kind(width), kind(len(letters)), index[c]
    same2, same3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    if merged:
        owner = np.zeros_like(owner)
    key = owner.astype(kind) << bits | x
    one = ((key << bits | none) << bits | none)[x != 0]
    pair = key[:-1] << bits | x[1:]
    two = (pair << bits | none)[same2 & ((x[:-1] != 0) | (x[1:] != 0))]
    three = (pair[:-1] << bits | x[2:])[same3 & (x[1:-1] != 0)]
    keys = np.sort(np.concatenate([one, two, three]))
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    keys = keys[at]
    mask, places = kind((1 << width) - 1), np.append(letters, _NONE).astype(np.uint64)
    codes = places[(keys >> bits >> bits) & mask] << np.uint64(42) | places[(keys >> bits) & mask] << np.uint64(21) | places[keys & mask]
    return codes, counts, np.searchsorted(keys >> bits >> bits >> bits, np.arange(n + 1, dtype=np.uint64))


def _slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` characters, so that temporaries stay small."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= most):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def learn_profiles(train: DataFrame, profile_size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Language -> n-gram codes by rank, from ``text`` and non-null ``lang`` of ``train``."""
    import pyarrow as pa

    def counted(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray, counts: np.ndarray):
            if lang in sums:
                old = sums[lang]
                codes, at = np.unique(np.concatenate([old[0], codes]), return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, at, np.concatenate([old[1], counts]))
                counts = total
            sums[lang] = codes, counts

        def flush():
            for lang, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for i, j in _slices(own):
                    add(lang, *count_ngrams(own[i:j], merged=True)[:2])
            if sum(len(c) for c, _ in sums.values()) > 2_000_000:
                yield from flush()
        yield from flush()

    counts = train.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "lang string, code long, n long")
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= profile_size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Matcher:
    """The profiles as one sorted array of codes and a matrix of ranks."""

    def __init__(self, profiles: dict[str, list[int]], profile_size: int):
        self.names = sorted(profiles)
        self.size = profile_size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            own = np.array(profiles[name], np.uint64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def ranked(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The most frequent of some ascending codes, by count and then code."""
        if len(found) > self.size:  # all above the cut, and the smallest codes on it
            cut = np.partition(n, len(n) - self.size)[len(n) - self.size]
            above = np.flatnonzero(n > cut)
            level = np.flatnonzero(n == cut)[: self.size - len(above)]
            pick = np.sort(np.concatenate([above, level]))
            found, n = found[pick], n[pick]
        return found[np.argsort(-n, kind="stable")]

    def predict(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = self.ranked(codes, counts)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[at]
        cost = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(cost))  # the first of equals, and names are sorted
        return self.names[best], float(1 - cost[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep=("doc_id",), profile_size: int = PROFILE_SIZE) -> DataFrame:
    """The ``keep`` columns, lang_pred and score for every row, from the text alone."""
    import pyarrow as pa
    from pyspark.sql import types as T

    keep = list(keep)
    at = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # profile_size codes a language

    def predicted(batches):
        matcher = Matcher(shared.value, profile_size)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names, scores = [], []
            for i, j in _slices(texts):
                codes, counts, bounds = count_ngrams([t or "" for t in texts[i:j]])
                for a, b in zip(bounds[:-1], bounds[1:]):
                    name, score = matcher.predict(codes[a:b], counts[a:b])
                    names.append(name), scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    extra = [] if at < len(keep) else [F.col("text").cast("string").alias("__text")]
    return docs.select(*keep, *extra).mapInArrow(predicted, schema)


def held_out(docs: DataFrame, modulus: int = 4, fold: int = 2) -> F.Column:
    """True for the fold that nothing is learned from; a row without an id is in none."""
    return F.coalesce(bucket_of(F.col("doc_id"), modulus) == fold, F.lit(False))


def learn_and_identify(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Learn from all but the held-out fold and predict every row."""
    profiles = learn_profiles(docs.where(~held_out(docs)))
    return identify(docs, profiles, keep)
