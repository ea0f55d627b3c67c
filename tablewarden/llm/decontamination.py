"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window (``window`` consecutive item words) is a set of shingles that a document must hold
completely, so one necessary prefix token is enough: its shingle that is rarest over all documents. Pass
one counts the items' shingles in the whole corpus; pass two looks the prefix tokens up in every document,
bounds the place a window could start at by its length and the token's offset, and verifies all words,
letter by letter.

The benchmark is a stated query set: it is written as blocks of bounded size in the shared folder, with their
lookup tables ready. A task holds a buffer of documents as words and lets the blocks pass by, one at a time, so
memory is bounded, texts are cut into words once, and the cost is linear in the benchmark.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .pretokens import same_spans, span_places
from .shared import fresh_path, open_input, open_output, stored
from .words import ALPHANUMERIC, Words, shingles, text_chunks, words_of

SHINGLE = 5
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of document text that a task holds as words while the blocks pass by.
BUFFER_BYTES = 8 << 20
_FILTER_BITS = 20


def _block(items: list[tuple[str, str]], window: int) -> dict[str, np.ndarray]:
    """Distinct windows of the items, as places in a list of distinct words, with the items that hold them."""
    texts = pa.array([t for _, t in items], pa.string())
    spelled: dict[bytes, int] = {}
    hashes: list[int] = []
    rows: dict[bytes, tuple[np.ndarray, set[int]]] = {}
    at = 0
    for first, last, raw, ends in text_chunks(texts):
        words = words_of(raw, ends, ALPHANUMERIC)
        low = words.bytes.tobytes()
        named = np.empty(len(words.hashes), np.int64)
        for k, (s, e, h) in enumerate(zip(words.starts.tolist(), words.ends.tolist(), words.hashes.tolist(), strict=True)):
            named[k] = n = spelled.setdefault(low[s:e], len(spelled))
            if n == len(hashes):
                hashes.append(h)
        for i in range(last - first):
            a, b = words.bounds[i], words.bounds[i + 1]
            length = min(window, b - a)
            for s in range(a, b - length + 1 if length else a):
                w = named[s : s + length]
                rows.setdefault(w.tobytes(), (w, set()))[1].add(at + i)
        at += last - first
    lengths = np.array([len(w) for w, _ in rows.values()], dtype=np.int64)
    padded = np.zeros((len(rows), window), dtype=np.int64)
    for i, (w, _) in enumerate(rows.values()):
        padded[i, : len(w)] = w
    owners = [sorted(o) for _, o in rows.values()]
    names = [x.encode() for x, _ in items]
    return {
        "ids": np.frombuffer(b"".join(names), np.uint8),
        "id_bounds": np.cumsum([0, *map(len, names)]),
        "windows": padded,
        "lengths": lengths,
        "hashes": np.array(hashes, np.uint64),
        "letters": np.frombuffer(b"".join(spelled), np.uint8),
        "letter_bounds": np.cumsum([0, *map(len, spelled)]),
        "owners": np.array([o for x in owners for o in x], dtype=np.int64),
        "owner_bounds": np.cumsum([0, *map(len, owners)]),
    }


def _tokens(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of all windows: fingerprint, width, window, offset."""
    found = []
    for n in np.unique(block["lengths"]).tolist():
        which, width = np.flatnonzero(block["lengths"] == n), min(SHINGLE, n)
        per = n - width + 1
        # windows of one length lie end to end; runs across two of them are left out
        flat = shingles(block["hashes"][block["windows"][which, :n]].ravel(), width)
        pick = (np.arange(len(which))[:, None] * n + np.arange(per)).ravel()
        found.append((flat[pick], np.full(len(pick), width), np.repeat(which, per), np.tile(np.arange(per), len(which))))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    with open_output(path) as f:
        f.write(out.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    with open_input(path) as f, np.load(io.BytesIO(f.read())) as x:
        return dict(x)


class Lookup:
    """Sorted fingerprints behind a small direct table that turns most others away."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.there = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.there[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are keys, and which (first) key each is."""
        maybe = np.flatnonzero(self.there[(values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == values[maybe]
        return maybe[hit], at[hit]


def _shingle_keys(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A block's distinct shingles by width, as they are counted in documents."""
    tokens, widths, _, _ = _tokens(block)
    return {f"w{w}": np.unique(tokens[widths == w]) for w in np.unique(widths).tolist()}


def _prefixes(block: dict[str, np.ndarray], counted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rarest shingle of every window that can occur, by width: sorted keys, and the windows of each."""
    tokens, widths, window, offset = _tokens(block)
    count = np.zeros(len(tokens), dtype=np.int64)
    for w in np.unique(widths).tolist():
        keys = np.unique(tokens[widths == w])
        count[widths == w] = counted[f"w{w}"][np.searchsorted(keys, tokens[widths == w])]
    order = np.lexsort((tokens, count, window))
    prefix = order[np.append(True, window[order][1:] != window[order][:-1])] if len(order) else order
    # a prefix token that no document holds cannot lead to a window
    prefix = prefix[count[prefix] > 0]
    out = {}
    for w in np.unique(widths[prefix]).tolist():
        p = prefix[widths[prefix] == w]
        p = p[np.argsort(tokens[p], kind="stable")]
        out[f"keys{w}"], out[f"first{w}"], out[f"many{w}"] = np.unique(tokens[p], return_index=True, return_counts=True)
        out[f"window{w}"], out[f"offset{w}"] = window[p], offset[p]
    return out


class Matching:
    """Block of which the windows are found in documents by their rarest shingle."""

    def __init__(self, path: str) -> None:
        self.block = x = _load(path)
        self.by_width = {int(k[4:]): (Lookup(x[k]), *(x[part + k[4:]] for part in ("first", "many", "window", "offset"))) for k in x if k.startswith("keys")}
        raw, bounds = self.block["ids"].tobytes(), self.block["id_bounds"].tolist()
        self.names = [raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def spelled_alike(self, words: Words, windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether every word of each occurrence has the letters of the window's word, letter by letter."""
        if not len(windows):
            return np.empty(0, bool)
        owner = np.repeat(np.arange(len(windows)), lengths)
        place = span_places(np.zeros(len(lengths), np.int64), lengths)
        pair, back = np.unique(np.stack([starts[owner] + place, self.block["windows"][windows[owner], place]]), axis=1, return_inverse=True)
        bounds = self.block["letter_bounds"]
        same = same_spans(words.bytes, words.starts[pair[0]], self.block["letters"], bounds[pair[1]], (words.ends - words.starts)[pair[0]], (bounds[1:] - bounds[:-1])[pair[1]])
        out = np.ones(len(windows), bool)
        out[owner[~same[back.ravel()]]] = False
        return out

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and window of every occurrence."""
        owner = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
        texts, starts, windows = [], [], []
        for width, (lookup, first, many, window, offset) in self.by_width.items():
            at, key = lookup.find(shingles(words.hashes, width))
            each = many[key]
            pick = np.repeat(first[key] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            w, start = window[pick], np.repeat(at, each) - offset[pick]
            text, length = owner[np.repeat(at, each)], self.block["lengths"][window[pick]]
            fits = (start >= words.bounds[text]) & (start + length <= words.bounds[text + 1])
            w, start, text, length = w[fits], start[fits], text[fits], length[fits]
            same = np.ones(len(w), dtype=bool)
            for j in range(self.block["windows"].shape[1]):
                mine = words.hashes[np.minimum(start + j, len(words.hashes) - 1)]
                same &= (j >= length) | (mine == self.block["hashes"][self.block["windows"][w, j]])
            w, start, text, length = w[same], start[same], text[same], length[same]
            same = self.spelled_alike(words, w, start, length)
            texts.append(text[same]), starts.append(start[same]), windows.append(w[same])
        if not texts:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        return np.concatenate(texts), np.concatenate(starts), np.concatenate(windows)


@functools.lru_cache(maxsize=1)
def _counting(path: str) -> dict[int, Lookup]:
    return {int(k[1:]): Lookup(v) for k, v in _load(path).items()}


@functools.lru_cache(maxsize=1)
def _matching(path: str) -> Matching:
    return Matching(path)


def _blocks(benchmark: DataFrame, folder: str, window: int) -> Iterator[dict[str, np.ndarray]]:
    items, held, n = [], 0, 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))).where("item_id is not null").toLocalIterator():
        items.append((row[0], row[1]))
        held += len(row[1]) + 16
        if held >= BLOCK_BYTES:
            yield _block(items, window)
            items, held, n = [], 0, n + 1
    if items or not n:
        yield _block(items, window)


def _buffered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple[pa.RecordBatch, list[tuple[int, int, Words]]]]]:
    """Batches with their texts cut into words, a bounded number of bytes at a time: a task meets every block
    once per buffer, and cuts every text once."""
    held, n = [], 0
    for batch in batches:
        parts = []
        for first, last, raw, ends in text_chunks(pc.fill_null(batch.column(text), "")):
            parts.append((first, last, words_of(raw, ends, ALPHANUMERIC)))
            n += len(raw)
        held.append((batch, parts))
        if n >= BUFFER_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _counts(texts: DataFrame, paths: list[str]) -> DataFrame:
    """``block, width, token, n``: how often the blocks' shingles occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buffered(batches, 0):
            for k, path in enumerate(paths):
                for width, lookup in _counting(path).items():
                    found = [lookup.find(shingles(words.hashes, width))[1] for _, parts in held for _, _, words in parts]
                    token, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), k)), pa.array(np.full(len(token), width)), pa.array(token), pa.array(n)], names=["block", "width", "token", "n"])

    return stored(texts.mapInArrow(count, "block long, width long, token long, n long").groupBy("block", "width", "token").agg(F.sum("n").alias("n")), "decontamination-counts")


def _prepared(texts: DataFrame, benchmark: DataFrame, folder: str, window: int) -> list[str]:
    """Blocks of the benchmark in the shared folder, each with its prefix tokens looked up ready."""
    raw, keys = [], []
    for k, block in enumerate(_blocks(benchmark, folder, window)):
        raw.append(f"{folder}/raw-{k:06d}.npz"), keys.append(f"{folder}/keys-{k:06d}.npz")
        _save(raw[-1], block), _save(keys[-1], _shingle_keys(block))
    found, out = _counts(texts, keys), []
    for k in range(len(raw)):
        block, sums = _load(raw[k]), {w: np.zeros(len(x), np.int64) for w, x in _load(keys[k]).items()}
        for row in found.where(F.col("block") == k).toLocalIterator():  # at most the shingles of one block
            sums[f"w{row.width}"][row.token] = row.n
        out.append(f"{folder}/block-{k:06d}.npz")
        _save(out[-1], block | _prefixes(block, sums))
    return out


def _covered(stretches: list[int]) -> int:
    """Words in the union of stretches given by their ends."""
    total, reach = 0, 0
    for a, b in sorted(zip(stretches[::2], stretches[1::2], strict=True)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _found(block: Matching, words: Words, hit: dict[int, list[int]], items: dict[int, set[str]], first: int) -> None:
    """Add the stretches of hit words and the items that a block has in some texts."""
    docs, starts, windows = block.hits(words)
    if not len(docs):
        return
    ends = starts + block.block["lengths"][windows]
    order = np.argsort(starts, kind="stable")
    starts, ends, owner = starts[order], np.maximum.accumulate(ends[order]), docs[order]
    # occurrences in order of place: a stretch ends where the next one begins later, or in another text
    new = np.append(True, (starts[1:] > ends[:-1]) | (owner[1:] != owner[:-1]))
    last = np.append(new[1:], True)
    base = words.bounds[owner]
    for d, a, b in zip(owner[new].tolist(), (starts - base)[new].tolist(), (ends - base)[last].tolist(), strict=True):
        hit.setdefault(first + d, []).extend((a, b))
    for d, w in np.unique(np.stack([docs, windows]), axis=1).T.tolist():
        a, b = block.block["owner_bounds"][w : w + 2]
        items.setdefault(first + d, set()).update(block.names[o] for o in block.block["owners"][a:b].tolist())


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Find benchmark windows in whole documents.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is ``window``
    consecutive item words; an item of fewer words, but not none, is one window. Returns one row per
    document: the columns of ``keep`` (``doc_id`` if not given) with ``n_words, n_hit`` (words inside
    any occurrence), ``n_items, items_sha256`` (the items found, sorted as strings) and ``contaminated``.

    Null and empty texts have no words, null item ids and items without words are passed over, an empty
    benchmark or table finds nothing, repeated rows get a row each. Columns of the documents that are not
    kept play no part, whatever their names.
    """
    folder = fresh_path(documents.sparkSession, "decontamination")
    paths = _prepared(documents.select(F.col("text").cast("string")), benchmark, folder, window)
    keep = ["doc_id"] if keep is None else keep
    nothing = hashlib.sha256(b"").hexdigest()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buffered(batches, 0):
            hits: list[dict[int, list[int]]] = [{} for _ in held]
            items: list[dict[int, set[str]]] = [{} for _ in held]
            for path in paths:
                block = _matching(path)
                for i, (_, parts) in enumerate(held):
                    for first, _, words in parts:
                        _found(block, words, hits[i], items[i], first)
            for i, (batch, parts) in enumerate(held):
                rows = range(batch.num_rows)
                n_words = np.concatenate([np.empty(0, np.int64), *(words.counts for _, _, words in parts)])
                n_hit = np.array([_covered(hits[i][d]) if d in hits[i] else 0 for d in rows], np.int64)
                n_items = np.array([len(items[i].get(d, ())) for d in rows], np.int64)
                digest = [hashlib.sha256(",".join(sorted(items[i][d])).encode()).hexdigest() if d in items[i] else nothing for d in rows]
                arrays = [*batch.columns[1:], pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{k}" for k in range(len(keep))), *RESULTS])

    rows = documents.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    kinds = [LongType(), LongType(), LongType(), StringType(), BooleanType()]
    schema = StructType([*rows.schema.fields[1:], *(StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True))])
    out = rows.mapInArrow(match, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *RESULTS)
