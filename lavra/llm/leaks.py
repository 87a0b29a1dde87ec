"""Passages of held-out test items inside corpus documents.

Method: windows get a 64-bit SimHash of their words. For partial leaks (`find_leaks`) these are all runs of `window`
words of items and documents; the bits are cut into `radius` + 1 blocks, and two fingerprints within `radius` bits
agree in at least one, so looking each block up finds every such pair (multi-index Hamming search). For nearly whole
copies (`near_copies`) they are the whole items and the documents' windows of their size, with a wider radius in each
block. Each candidate is then verified exactly on its weighted word shingles. The items' index is broadcast up to a
checked size; more items take further turns over the documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

WINDOW, RADIUS, SHINGLE = 13, 3, 5
#: Item windows broadcast at once (about 200 bytes each), and whole items (about 14 kB each); more take further turns.
BROADCAST_WINDOWS, BROADCAST_ITEMS = 1_000_000, 5_000
#: Bits by which a block of 16 may differ, steps of the windows' lengths, and windows begun in one length.
BLOCK_RADIUS, CLASS_STEP, STRIDE = 3, 1.04, 32
_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case, accents and Unicode form."""
    if not text:
        return []
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _WORD.findall(text)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound and begun anew beyond it."""

    most = 500_000

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def simhashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The SimHash of each run of `window` word hashes (an empty array for fewer words)."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 16  # bounds the memory of a very long text; consecutive steps share window - 1 words
    for at in range(0, n, step):
        part = hashes[at : at + step + window - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        votes = total[window:] - total[:-window]
        out[at : at + step] = np.packbits(votes * 2 > window, axis=1).view(np.uint64).ravel()
    return out


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """Shift and width of each of the radius + 1 blocks of 64 bits."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]


class ItemIndex:
    """Windows of all items: by each block of their fingerprint, with the word hashes for verification. `items` are
    (id, word hashes, weight of the shingle at each place)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], window: int, radius: int, shingle: int, rare: float = 1.0) -> None:
        self.window, self.radius, self.shingle, self.rare = window, radius, shingle, rare
        items = [x for x in items if len(x[1]) >= window]
        self.item = np.concatenate([np.full(len(h) - window + 1, i, np.int64) for i, h, _ in items] or [np.empty(0, np.int64)])
        self.fp = np.concatenate([simhashes(h, window) for _, h, _ in items] or [np.empty(0, np.uint64)])
        self.runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(h, window) for _, h, _ in items] or [np.empty((0, window), np.uint64)])
        inner = max(0, window - shingle + 1)
        self.weights = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, inner) for _, _, w in items] if inner and items else [np.empty((len(self.runs), inner))])
        self.blocks = []
        for shift, width in block_bounds(radius):
            value = (self.fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.uint64(shift), np.uint64((1 << width) - 1), value[order], order))

    def candidates(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `fp` and item windows whose fingerprints are within the radius: all such pairs."""
        at, of = [], []
        for shift, mask, value, order in self.blocks:
            mine = (fp >> shift) & mask
            lo, hi = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
            hit = np.flatnonzero(hi > lo)
            for part in np.array_split(hit, max(1, int((hi - lo)[hit].sum()) // 4_000_000)):
                n = (hi - lo)[part]
                p = np.repeat(part, n)
                w = order[np.repeat(lo[part] - np.cumsum(n) + n, n) + np.arange(len(p))]
                near = np.bitwise_count(fp[p] ^ self.fp[w]) <= self.radius
                at.append(p[near])
                of.append(w[near])
        at, of = np.concatenate(at), np.concatenate(of)
        keep = np.unique(at * max(1, len(self.fp)) + of)
        return keep // max(1, len(self.fp)), keep % max(1, len(self.fp))

    def similarity(self, run: np.ndarray, of: int) -> float:
        """Weighted Jaccard similarity of the word shingles of two runs of `window` words."""
        known = dict(zip(_shingles(self.runs[of], self.shingle).tolist(), self.weights[of].tolist()))
        return weighted_jaccard(set(_shingles(run, self.shingle).tolist()), known, self.rare)


def weighted_jaccard(mine: set[int], known: dict[int, float], rare: float) -> float:
    """Similarity of a document's shingles to an item's, which weigh the more the fewer items hold them; those that the
    item lacks weigh as much as the rarest."""
    both = sum(known[x] for x in mine & known.keys())
    return both / (sum(known.values()) + rare * len(mine - known.keys()) or 1.0)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit value for each run of `size` word hashes."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : len(hashes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _scan(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            docs, items, places, scores = [], [], [], []
            hashes = [hashed(words(t)) for t in batch.column(1).to_pylist()]
            sizes = [max(0, len(h) - index.window + 1) for h in hashes]
            if sum(sizes):
                fp = np.concatenate([simhashes(h, index.window) for h in hashes])
                begin = np.concatenate([[0], np.cumsum(sizes)])
                at, of = index.candidates(fp)
                if similarity >= 1:  # only equal runs count, and those begin with the same word
                    firsts = np.concatenate([h[: len(h) - index.window + 1] if len(h) >= index.window else h[:0] for h in hashes])
                    same = firsts[at] == index.runs[of, 0]
                    at, of = at[same], of[same]
                doc = np.searchsorted(begin, at, "right") - 1
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for p, w, d in zip(at.tolist(), of.tolist(), doc.tolist()):
                    pos, key = p - int(begin[d]), (d, int(index.item[w]))
                    if key in best and best[key][0] == 1.0:
                        continue
                    own = hashes[d][pos : pos + index.window]
                    equal = (own == index.runs[w]).all()
                    if similarity >= 1 and not equal:
                        continue
                    s = 1.0 if equal else min(index.similarity(own, w), 1 - 1e-9)
                    if s >= similarity and (key not in best or s > best[key][0]):
                        best[key] = (s, pos)
                ids = batch.column(0).to_pylist()
                for (d, i), (s, pos) in best.items():
                    docs.append(ids[d]), items.append(i), places.append(pos), scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(places, pa.int32()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "palavra", "similaridade"])

    return run


def _counted(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    hashed = WordHashes()
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = _shingles(hashed(words(t)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["item_id", "lugar", "trecho"])


def _item_turns(items: DataFrame, shingle: int, most: int, size) -> Iterator[tuple[list[tuple[int, np.ndarray, np.ndarray]], float]]:
    """The items (id, word hashes, weights of their shingles) in turns of about `most` in the measure `size` of their
    words, and the weight of the rarest shingle. A shingle's weight falls with the number of all items that hold it,
    so no turn changes it."""
    held = items.where("item_id is not null and texto <> ''").select(F.col("item_id").cast("long").alias("item_id"), "texto").dropDuplicates(["item_id"])
    places = held.mapInArrow(lambda batches: _counted(batches, shingle), "item_id long, lugar int, trecho long")
    often = places.groupBy("trecho").agg(F.countDistinct("item_id").alias("n"))
    counts = places.join(often, "trecho").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lugar", "n"))), lambda x: x["n"]).alias("vezes"))
    held = materialize(held.join(counts, "item_id", "left"), "itens")
    first = held.agg(F.count("*").alias("n"), F.sum(size(F.size(F.split("texto", r"[^\p{L}\p{N}]+")))).alias("s")).first()
    turns = max(1, min(first["n"], -(-int(first["s"] or 0) // max(1, most))))
    rare = float(np.log1p(max(1, first["n"])))
    for turn in range(turns):
        hashed = WordHashes()
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).collect()
        yield [(i, hashed(words(t)), np.log1p(first["n"] / np.asarray(n or [], np.float64))) for i, t, n in rows], rare


def find_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, similarity: float = 1.0, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents (doc_id, text) that hold passages of items (item_id, texto): doc_id, item_id, palavra (the
    place, in words, of the best matching run) and similaridade (weighted Jaccard of the runs' shingles of
    `shingle` words; 1.0 only where all `window` words agree in order).

    Runs are compared within `radius` bits of their SimHash, all such pairs are verified and those of at
    least `similarity` count. Null or short texts and null ids have no runs; a repeated item or document
    gives one row. Other columns are ignored. Items of more than `broadcast_windows` windows are held against the
    documents in several turns, each of which reads the documents once."""
    docs = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    parts = []
    for held, rare in _item_turns(items, shingle, broadcast_windows, lambda n: n):
        parts.append(docs.mapInArrow(_scan(ItemIndex(held, window, radius, shingle, rare), similarity), "doc_id long, item_id long, palavra int, similaridade double"))
    return _best(reduce(DataFrame.unionByName, parts))


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "item_id").agg(F.min_by("palavra", F.struct(-F.col("similaridade"), "palavra")).alias("palavra"), F.max("similaridade").alias("similaridade"))


class WholeItems:
    """Whole items by the length of the windows they are compared with, and by the blocks of their fingerprint: four
    blocks of 16 bits, each entered with all values within `BLOCK_RADIUS` bits, so that every fingerprint within
    4 * (BLOCK_RADIUS + 1) - 1 bits is found."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], shingle: int, rare: float) -> None:
        self.items, self.shingle, self.rare = [x for x in items if len(x[1]) >= shingle], shingle, rare
        self.known = [dict(zip(_shingles(h, shingle).tolist(), w.tolist())) for _, h, w in self.items]
        self.total = [sum(x.values()) for x in self.known]
        near = np.asarray([sum(1 << k for k in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(16), n)], np.int64)
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, h, _) in enumerate(self.items):
            by_size[round(CLASS_STEP ** round(math.log(len(h), CLASS_STEP)))].append(k)
        self.classes = []
        for size, members in sorted(by_size.items()):
            fp = np.concatenate([simhashes(self.items[k][1], len(self.items[k][1])) for k in members])
            tables = []
            for shift in (0, 16, 32, 48):
                value = (((fp >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ near).ravel()
                order = np.argsort(value, kind="stable")
                tables.append((np.uint64(shift), np.searchsorted(value[order], np.arange(65_537)), (order // len(near)).astype(np.int32)))
            self.classes.append((size, np.asarray(members), fp, tables))

    def candidates(self, hashes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Places in `hashes` (one array for each document) and items one of whose windows is within the radius."""
        sizes = np.asarray([len(h) for h in hashes])
        begin = np.cumsum(sizes) - sizes
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        found = [np.empty(0, np.int64)]
        for size, members, fps, tables in self.classes:
            step = max(1, size // STRIDE)
            last = np.maximum(sizes - size, 0)  # a shorter document is one window
            n = last // step + 2
            doc = np.repeat(np.arange(len(sizes)), n)
            at = np.minimum((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step, last[doc])
            lo = begin[doc] + at
            width = np.minimum(size, sizes)[doc]
            votes = total[lo + width] - total[lo]
            fp = np.packbits(votes * 2 > width[:, None], axis=1).view(np.uint64).ravel()
            for shift, start, order in tables:
                mine = ((fp >> shift) & np.uint64(0xFFFF)).astype(np.int64)
                first, k = start[mine], start[mine + 1] - start[mine]
                p = np.repeat(np.arange(len(fp)), k)
                w = order[np.repeat(first - np.cumsum(k) + k, k) + np.arange(len(p))]
                near = np.bitwise_count(fp[p] ^ fps[w]) <= 4 * (BLOCK_RADIUS + 1) - 1
                found.append(np.unique(doc[p[near]] * len(self.items) + members[w[near]]))
        for pair in np.unique(np.concatenate(found)).tolist():
            yield divmod(pair, len(self.items))

    def best(self, mine: list[int], known_here: set[int], k: int, similarity: float) -> tuple[float, int]:
        """The similarity of item k to the window of its length that is most like it, and the window's place. `mine`
        are the document's shingles, `known_here` the different ones."""
        known, total = self.known[k], self.total[k]
        if sum(map(known.__getitem__, known_here & known.keys())) < similarity * total - 1e-9:
            return 0.0, 0
        weight = np.asarray([known.get(x, 0.0) for x in mine])
        strange = np.asarray([x not in known for x in mine])
        seen: dict[int, int] = {}
        before = np.empty(len(mine), np.int64)  # where the same shingle stood last
        for i, x in enumerate(mine):
            before[i] = seen.get(x, -1)
            seen[x] = i
        width = min(len(self.items[k][1]) - self.shingle + 1, len(mine))
        view = np.lib.stride_tricks.sliding_window_view
        score, place = 0.0, 0
        for at in range(0, len(mine) - width + 1, 4096):
            until = min(at + 4096, len(mine) - width + 1)
            new = view(before[at : until + width - 1], width) < np.arange(at, until)[:, None]
            both = (view(weight[at : until + width - 1], width) * new).sum(axis=1)
            other = (view(strange[at : until + width - 1], width) & new).sum(axis=1)
            s = both / (total + self.rare * other)
            i = int(np.argmax(s))
            if s[i] > score:
                score, place = float(s[i]), at + i
        return score, place


def _scan_whole(index: WholeItems, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            rows = [(doc, h) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(h := hashed(words(text))) >= index.shingle]
            parts, size = [[]], 0
            for row in rows:  # bounds the memory of a batch of long texts
                if size > 100_000:
                    parts.append([])
                    size = 0
                parts[-1].append(row)
                size += len(row[1])
            for part in parts:
                last, mine = -1, []
                for d, k in index.candidates([h for _, h in part]) if part and index.items else ():
                    if d != last:
                        last, mine = d, _shingles(part[d][1], index.shingle).tolist()
                        different = set(mine)
                    s, place = index.best(mine, different, k, similarity)
                    if s >= similarity - 1e-9:
                        for column, value in zip(out, (part[d][0], index.items[k][0], place, s)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "palavra", "similaridade"])

    return run


def near_copies(documents: DataFrame, items: DataFrame, similarity: float = 0.8, shingle: int = SHINGLE, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """Documents that hold nearly a whole item: doc_id, item_id, palavra and similaridade of the window of the item's
    length that is most like it, by weighted shingles; at least `similarity`. A document shorter than the item is one
    window. Items of fewer than `shingle` words have none; nulls and repeats as in `find_leaks`. More items than
    `broadcast_items` take further turns."""
    docs = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    parts = [
        docs.mapInArrow(_scan_whole(WholeItems(held, shingle, rare), similarity), "doc_id long, item_id long, palavra int, similaridade double")
        for held, rare in _item_turns(items, shingle, broadcast_items, lambda n: F.lit(1))
    ]
    return _best(reduce(DataFrame.unionByName, parts))
