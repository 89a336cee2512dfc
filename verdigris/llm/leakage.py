"""Passages of evaluation items in training text, by suffix arrays of the training text.

Every task is a shard: it turns its documents into numbers of words (or letters), sorts their suffixes, and binary-searches every suffix of every
test passage in them. Words that no passage has cut the text; pieces too short to hold a match are left out, which loses nothing.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import cut_lineage

#: Consecutive words, or letters and digits for languages without spaces, that make a match.
MATCH_WORDS = 12
MATCH_LETTERS = 24
UNSPACED = ("ja", "zh")
#: Numbers in one shard's suffix array.
SHARD_SYMBOLS = 4_000_000
#: Matches held at a time.
GROUP_MATCHES = 4_000_000
#: Bytes of test passages that are sent to every task at once. A Python worker needs some twenty times as much for their index and the search.
MOST_TEST_BYTES = 8_000_000
_RUN = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Unbroken runs of letters or digits after NFKC and lower-casing."""
    return _RUN.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class TestSuffixes:
    """The passages as numbers, one after another, each followed by a 0, for words or for letters."""

    def __init__(self, passages: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        symbols, items, places = [], [], []
        for item, units in passages:
            numbers = [self.number.setdefault(u, len(self.number) + 1) for u in units]
            symbols += numbers + [0]
            items += [item] * (len(numbers) + 1)
            places += list(range(len(numbers) + 1))
        self.symbols, self.items, self.places = np.array(symbols, dtype=np.int32), np.array(items, dtype=np.int64), np.array(places, dtype=np.int32)
        padded = np.concatenate([self.symbols, np.zeros(least, dtype=np.int32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, least)[: len(self.symbols)] if len(self.symbols) else np.zeros((0, least), dtype=np.int32)
        #: Suffixes of at least `least` symbols.
        self.starts = np.flatnonzero((windows != 0).all(axis=1))
        self.windows = windows[self.starts]

    def pieces(self, units: list[str]) -> list[tuple[int, np.ndarray]]:
        """(place, numbers) of the longest pieces of known symbols that are long enough."""
        get = self.number.get
        numbers = np.fromiter((get(u, 0) for u in units), dtype=np.int32, count=len(units))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers != 0, [0]]).astype(np.int8)))
        return [(a, numbers[a:b]) for a, b in zip(edges[::2], edges[1::2]) if b - a >= self.least]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first `depth` symbols at least, by doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        following = np.zeros(n, dtype=np.int64)
        following[: n - length] = rank[length:] + 1 if length < n else 0
        both = rank * (n + 2) + following
        order = np.argsort(both, kind="stable")
        changed = np.concatenate([[0], (np.diff(both[order]) != 0).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = changed
        length *= 2
        if changed[-1] == n - 1:
            break
    return order


def _search(symbols: np.ndarray, order: np.ndarray, windows: np.ndarray, after: bool) -> np.ndarray:
    """For each window its place among the sorted suffixes, before or after those that begin with it."""
    depth = windows.shape[1]
    padded = np.concatenate([symbols, np.zeros(depth, dtype=symbols.dtype)])
    low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        text = padded[at[:, None] + np.arange(depth)]
        differs = text != windows
        first = differs.argmax(axis=1)
        rows = np.arange(len(windows))
        less = differs.any(axis=1) & (text[rows, first] < windows[rows, first]) | (after & ~differs.any(axis=1))
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def shard_matches(tests: TestSuffixes, pieces: list[tuple[int, int, np.ndarray]]):
    """(doc, item, doc place, item place, length) of the longest match of every document and item; pieces are (doc, place, numbers)."""
    if not pieces or not len(tests.starts):
        return
    sizes = np.array([len(p[2]) + 1 for p in pieces])
    offsets = np.cumsum(sizes) - sizes
    symbols = np.zeros(sizes.sum(), dtype=np.int32)
    for at, (_, _, numbers) in zip(offsets, pieces):
        symbols[at : at + len(numbers)] = numbers
    order = suffix_array(symbols, tests.least)
    first, last = _search(symbols, order, tests.windows, False), _search(symbols, order, tests.windows, True)
    found = last - first
    hits = np.flatnonzero(found)
    # Items are taken in groups whose matches fit in memory together; all suffixes of an item are in one group.
    items, firsts = np.unique(tests.items[tests.starts[hits]], return_index=True)
    totals = np.add.reduceat(found[hits], firsts) if len(hits) else np.empty(0, dtype=np.int64)
    group = np.cumsum(totals) // GROUP_MATCHES
    for number in np.unique(group):
        chosen = hits[np.isin(tests.items[tests.starts[hits]], items[group == number])]
        yield _longest(tests, pieces, offsets, symbols, order, chosen, first[chosen], found[chosen])


def _longest(tests: TestSuffixes, pieces, offsets, symbols, order, hits, first, found):
    which = np.repeat(np.arange(len(hits)), found)
    rank = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    place = order[first[which] + rank]
    start = tests.starts[hits[which]]
    piece = np.searchsorted(offsets, place, side="right") - 1
    # A match that could begin one symbol earlier is part of that one.
    earlier = (place > 0) & (start > 0)
    inner = earlier & (symbols[place - 1] != 0) & (symbols[place - 1] == tests.symbols[start - 1])
    place, start, piece = place[~inner], start[~inner], piece[~inner]
    length = np.full(len(place), tests.least)
    text, passage = np.concatenate([symbols, [0]]), np.concatenate([tests.symbols, [0]])
    growing = np.arange(len(place))
    while len(growing):
        a, b = text[place[growing] + length[growing]], passage[start[growing] + length[growing]]
        growing = growing[(a == b) & (a != 0)]
        length[growing] += 1
    docs, at = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece] + place - offsets[piece]
    items, item_at = tests.items[start], tests.places[start]
    best = np.lexsort((item_at, at, -length, items, docs))
    docs, items, at, item_at, length = docs[best], items[best], at[best], item_at[best], length[best]
    keep = np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(items) != 0)])
    return docs[keep], items[keep], at[keep], item_at[keep], length[keep]


_MATCH = "doc_id long, item_id long, doc_place long, item_place long, length long"


def leaked_passages(documents: DataFrame, tests: DataFrame, match_words: int = MATCH_WORDS, match_letters: int = MATCH_LETTERS, unspaced: tuple[str, ...] = UNSPACED, most_test_bytes: int = MOST_TEST_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_place, item_place, length): for each document and test item that share enough consecutive units, the longest shared run.

    documents(doc_id, text), tests(item_id, lang, passage). Units are words; for items of an unspaced language single letters and digits, places and
    lengths then count these. Null, empty and short texts and passages match nothing. Rows of a shard are matched whole, however long a text is. The
    test passages go to every task, beyond `most_test_bytes` in parts of whole items, one after another, whose results add up. One item's passages are
    never divided, so that the longest run of a document and item comes from one part.
    """
    rows = tests.select("item_id", "lang", "passage").filter("item_id is not null and passage is not null")
    parts = _parts(rows, most_test_bytes)
    if len(parts) == 1:
        return _matches(documents, rows, match_words, match_letters, unspaced)[0]
    found = None
    for low, high in parts:
        matches, shared = _matches(documents, rows.filter(F.col("item_id").between(low, high)), match_words, match_letters, unspaced)
        matches = cut_lineage(matches)
        shared.destroy()
        found = matches if found is None else found.unionByName(matches)
    return found


def _parts(rows: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last item_id of parts of at most `most` bytes of passages, or of one item that has more; one part at least."""
    sizes = rows.distinct().groupBy("item_id").agg(F.sum(F.octet_length("passage")).alias("n")).orderBy("item_id").toPandas()
    parts, size = [], 0
    for item, n in zip(sizes.item_id.tolist(), sizes.n.tolist()):
        if not parts or size + n > most:
            parts.append((item, item))
            size = 0
        parts[-1] = (parts[-1][0], item)
        size += n
    return parts or [(0, 0)]


def _matches(documents: DataFrame, rows: DataFrame, match_words: int, match_letters: int, unspaced: tuple[str, ...]):
    """The matches of one part of the test items, and its broadcast."""
    passages = sorted((r.item_id, r.lang, r.passage) for r in rows.distinct().collect())
    by_word = TestSuffixes([(i, words_of(p)) for i, lang, p in passages if lang not in unspaced], match_words)
    by_letter = TestSuffixes([(i, list("".join(words_of(p)))) for i, lang, p in passages if lang in unspaced], match_letters)
    shared = documents.sparkSession.sparkContext.broadcast((by_word, by_letter))

    def search(batches):
        by_word, by_letter = shared.value
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def flush():
            for tests_, pieces in ((by_word, held[0]), (by_letter, held[1])):
                for columns in shard_matches(tests_, pieces):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_place", "item_place", "length"])
                pieces.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                words = words_of(text)
                for kind, (tests_, units) in enumerate(((by_word, words), (by_letter, "".join(words)))):
                    if len(tests_.starts):
                        for place, numbers in tests_.pieces(units):
                            held[kind].append((doc, place, numbers))
                            size += len(numbers) + 1
            if size > SHARD_SYMBOLS:
                yield from flush()
                size = 0
        yield from flush()

    return documents.select("doc_id", "text").mapInArrow(search, _MATCH), shared


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that share no passage with any test item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
