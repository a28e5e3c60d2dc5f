"""Packing: cutting-stock column generation over a histogram of piece lengths.

1. Each document is tokenised once, where it lies, and cut by a rule of its own
   length: full sequences first, then the rest as a multiple of ``UNIT`` and,
   last, under ``UNIT`` ids. So at most two pieces of a document aren't whole
   sequences and every piece has one of a fixed number of lengths.
2. The histogram of lengths (under a hundred numbers, whatever the input) goes
   to the driver. A linear program chooses how often to use which pattern of
   lengths; its columns are priced by a knapsack dynamic program and added while
   one has a positive reduced cost. Pattern counts are rounded down; the demand
   that is left (bounded by the number of patterns) is filled pattern by pattern
   with a bounded knapsack.
3. Pieces are ranked within their length, first inside hash buckets, then by the
   buckets' running counts, and the rank decides sequence and offset by a search
   in the broadcast plan, which is as small as the histogram.

Texts are read once; only piece rows (six numbers) are shuffled.

Defined results: a null or empty text is the end id alone. Repeated rows are
packed each. A null doc_id is kept. An empty table gives no rows. Documents of
any length are cut, never truncated. Other columns of the input are dropped.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm.common import cut_lineage, load, trimmed
from inkmill.llm.shingles import mix, powers

SEQUENCE = 2048
UNIT = 64
END_ID = 1
#: Ranks are counted within about this many pieces of one length at a time.
BUCKET_PIECES = 100_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- tokenising -------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: Characters below this are tokenised in numpy; none of them has a decomposition left after NFC.
_PLAIN = 0x180
_MISSING = np.int32(np.iinfo(np.int32).max)


def _kind(c: str) -> int:
    category = unicodedata.category(c)
    return _SPACE if c.isspace() else _LETTER if category[0] == "L" else _DIGIT if category[0] == "N" else _OTHER


class PairTable:
    """Merge ranks of pairs of ids: each pair lies in one of two places, so a lookup is two gathers."""

    def __init__(self, pairs: np.ndarray, size: int) -> None:
        self.size = np.uint32(size)
        keys = pairs[:, 0].astype(np.uint32) * self.size + pairs[:, 1].astype(np.uint32)
        bits = max(4, int(len(keys)).bit_length() + 1)
        while not self._fill(keys, bits):
            bits += 1

    def _fill(self, keys: np.ndarray, bits: int) -> bool:
        """Cuckoo hashing, all homeless keys a step; False if it doesn't settle."""
        self.shift = np.uint32(32 - bits)
        places = [self._place(keys, k) for k in (0, 1)]
        owner = [np.full(1 << bits, -1), np.full(1 << bits, -1)]
        homeless, side = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        for _ in range(200):
            if not len(homeless):
                break
            out = []
            for k in (0, 1):
                mine = homeless[side[homeless] == k]
                at = places[k][mine]
                before = owner[k][at]
                owner[k][at] = mine  # of several the last one stays
                lost = np.concatenate([mine[owner[k][at] != mine], before[before >= 0]])
                out.append(np.unique(lost))
            homeless = np.unique(np.concatenate(out))
            homeless = homeless[(owner[0][places[0][homeless]] != homeless) & (owner[1][places[1][homeless]] != homeless)]
            side[homeless] ^= 1
        self.entries = []
        for k in (0, 1):
            # a key that no pair of ids has stands for an empty place
            e = np.full(1 << bits, np.uint64(0xFFFFFFFF) << np.uint64(32) | np.uint64(_MISSING))
            full = np.flatnonzero(owner[k] >= 0)
            e[full] = keys[owner[k][full]].astype(np.uint64) << np.uint64(32) | owner[k][full].astype(np.uint64)
            self.entries.append(e)
        return not len(homeless)

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (keys * np.uint32((2654435761, 2246822519)[k])) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; ``_MISSING`` where the pair doesn't merge or an id is negative."""
        key = left.astype(np.uint32) * self.size + right.astype(np.uint32)
        one, two = (self.entries[k].take(self._place(key, k)) for k in (0, 1))
        wide = key.astype(np.uint64)
        found = np.where(one >> np.uint64(32) == wide, one, two)
        hit = (found >> np.uint64(32) == wide) & (left >= 0) & (right >= 0)
        return np.where(hit, found.astype(np.uint32).view(np.int32), _MISSING)


class WordTokenizer:
    """Ids of a word-level BPE tokenizer, a block of texts at a time.

    The pre-tokenizer's words never hold white space and merges never cross
    words. A block's words are found by the classes of its characters and
    hashed by prefix sums; its distinct words are merged together, each by its
    lowest-ranked pair (the leftmost of equals) per step, as the model merges
    them one by one. Ids of up to ``KNOWN_WORDS`` words (some 10 MB) are kept for
    the next blocks, by 64-bit hash, until the task ends.
    Texts with characters from ``_PLAIN`` on, or with something
    that could be a special token, go to the library's tokenizer as they are, and
    so do words of more than ``LONG_WORD`` bytes.
    """

    BLOCK_CHARS = 1 << 20
    LONG_WORD = 64
    KNOWN_WORDS = 300_000

    #: other scripts, separators on which engines differ, I with dot, special tokens
    _odd = re.compile("[^\x00-ſ]|[\x00-\x08\x0e-\x1f\x7f-\xa0\xadİŉ]|<\\|")
    _plain_bytes = bytes(c for c in range(256) if not re.match("[\x00-\x08\x0e-\x1f\x7f-\xa0\xad]", chr(c)))

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.inside, self.last = np.full(256, -1, np.int32), np.full(256, -1, np.int32)
        for c in range(1, _PLAIN):
            shown = split.pre_tokenize_str(chr(c))[0][0]
            for b, letter in zip(chr(c).encode(), shown):
                self.inside[b], self.last[b] = vocab[letter], vocab[letter + suffix]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(np.array([(vocab[a], vocab[b]) for a, b in merges]), len(vocab))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.kind = np.array([_kind(chr(c)) for c in range(_PLAIN)], np.uint8)
        self.lower = np.array([ord(chr(c).lower()[0]) for c in range(_PLAIN)], np.uint16)
        self.forget()
        self.mark = np.random.default_rng(71).integers(0, 1 << 63, _PLAIN, np.uint64) * np.uint64(2) + np.uint64(1)

    @cached_property
    def inner(self):
        """The library's tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bool:
        if "<|" in text:
            return False
        try:
            rest = text.encode("latin-1").translate(None, self._plain_bytes)
        except UnicodeEncodeError:
            rest = b"?" if self._odd.search(text) else b""
        return not rest and unicodedata.is_normalized("NFC", text)

    def _words(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of lower-cased characters that begin and end with white space."""
        kind = self.kind[chars]
        start = np.zeros(len(chars), bool)
        start[1:] = (kind[1:] != _SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        # 's 't 'm 'd 're 've 'll are words, if their mark follows no other mark
        at = np.flatnonzero(chars == ord("'"))
        at = at[(kind[at - 1] != _OTHER) & (kind[at + 1] == _LETTER)]
        one, two = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        at, n = at[short | long], np.where(short, 1, 2)[short | long]
        start[at + 1] = False
        start[at + 1 + n] |= kind[at + 1 + n] == _LETTER
        edge = start.copy()
        edge[1:] |= (kind[1:] == _SPACE) & (kind[:-1] != _SPACE)
        edges = np.flatnonzero(edge)
        first = np.flatnonzero(start[edges])
        return edges[first], edges[first + 1]

    def _symbols(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ids of some words, one a UTF-8 byte, and how many each word has."""
        c = chars[_ragged(starts, sizes)].astype(np.int32)
        wide = c >= 0x80
        many = np.add.reduceat(wide, np.cumsum(sizes) - sizes) + sizes
        where = np.cumsum(wide) + np.arange(len(c))  # of each character's last byte
        raw = np.empty(len(c) + int(wide.sum()), np.uint8)
        raw[where] = np.where(wide, 0x80 | c & 0x3F, c)
        raw[where[wide] - 1] = 0xC0 | c[wide] >> 6
        ids = self.inside[raw]
        ends = np.cumsum(many) - 1
        ids[ends] = self.last[raw[ends]]
        return ids, many

    def _merge(self, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) as words are done; rows of ``table`` end with -1 where they are short."""
        rows = np.arange(len(table))
        ranks = self.pairs(table[:, :-1], table[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            rank = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), _MISSING)
            live = rank != _MISSING
            if not live.all():
                yield rows[~live], table[~live]
                rows, table, ranks, best, rank = rows[live], table[live], ranks[live], best[live], rank[live]
                if not len(rows):
                    return
            k, width = np.arange(len(rows)), table.shape[1]
            table = np.where(np.arange(width - 1) <= best[:, None], table[:, :-1], table[:, 1:])
            table[k, best] = self.merged[rank]
            ranks = np.where(np.arange(width - 2) < best[:, None], ranks[:, :-1], ranks[:, 1:])
            i = np.flatnonzero(best > 0)
            ranks[i, best[i] - 1] = self.pairs(table[i, best[i] - 1], table[i, best[i]])
            i = np.flatnonzero(best < width - 2)
            ranks[i, best[i]] = self.pairs(table[i, best[i]], table[i, best[i] + 1])

    def _ids(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words one after the other, and where each word's begin."""
        symbols, many = self._symbols(chars, starts, sizes)
        at = np.cumsum(many) - many
        found, counts, low = [], np.zeros(len(starts), np.int64), 0
        for high in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, self.LONG_WORD):
            words = np.flatnonzero((many > low) & (many <= high))
            low = high
            for lo in range(0, len(words), 1 << 15):
                part = words[lo : lo + (1 << 15)]
                column = np.arange(high)
                inside = column < many[part, None]
                table = np.where(inside, symbols[np.minimum(at[part, None] + column, len(symbols) - 1)], np.int32(-1))
                for rows, ids in self._merge(table):
                    found.append((part[rows], ids))
                    counts[part[rows]] = (ids >= 0).sum(axis=1)
        for w in np.flatnonzero(many > self.LONG_WORD):
            word = chars[starts[w] : starts[w] + sizes[w]].astype("<u2").tobytes().decode("utf-16-le")
            ids = np.array([self.inner.encode(word, add_special_tokens=False).ids], np.int32)
            found.append((np.array([w]), ids))
            counts[w] = ids.shape[1]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        for words, ids in found:
            out[_ragged(first[words], counts[words])] = ids[ids >= 0]
        return out, np.append(first, len(out))

    def forget(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _look_up(self, words: np.ndarray) -> np.ndarray:
        """Where the ids of each word stand, -1 for new words."""
        if not len(self.known):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.slots[at], -1)

    def _learn(self, words: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        place = np.searchsorted(self.known, words)
        self.slots = np.insert(self.slots, place, len(self.known) + np.arange(len(words)))
        self.known = np.insert(self.known, place, words)
        self.first = np.append(self.first, len(self.ids) + at[:-1])
        self.counts = np.append(self.counts, np.diff(at))
        self.ids = np.append(self.ids, ids)

    def _block(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer(f"\n{'\n'.join(texts)}\n".encode("utf-16-le"), "<u2")
        chars = self.lower[data]
        starts, ends = self._words(chars)
        if not len(starts):
            return [b""] * len(texts)
        sizes = ends - starts
        up, down = powers(len(chars) + 1)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(self.mark[chars] * up[: len(chars)], out=sums[1:])
        found, first, word = np.unique(mix((sums[ends] - sums[starts]) * down[starts] + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
        del sums, up, down
        slot = self._look_up(found)
        new = np.flatnonzero(slot < 0)
        if len(self.known) + len(new) > self.KNOWN_WORDS and len(self.known):
            self.forget()
            slot, new = np.full(len(found), -1), np.arange(len(found))
        if len(new):
            slot[new] = len(self.known) + np.arange(len(new))
            self._learn(found[new], *self._ids(chars, starts[first[new]], sizes[first[new]]))
        counts = self.counts[slot][word]
        all_ids = self.ids[_ragged(self.first[slot][word], counts)]
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        cuts_at = np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)].tolist()
        return [all_ids[lo:hi].tobytes() for lo, hi in zip(cuts_at, cuts_at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        block: list[int] = []
        size = 0

        def close() -> None:
            for k, ids in zip(block, self._block([texts[k] for k in block])):
                out[k] = ids
            block.clear()

        for k, t in enumerate(texts):
            if not self._plain(t):
                out[k] = np.asarray(self.inner.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            if block and size + len(t) > self.BLOCK_CHARS:
                close()
                size = 0
            block.append(k)
            size += len(t) + 1
        if block:
            close()
        return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: The models themselves, some MB each; what a task remembers of its words isn't kept.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cuts(n: int, size: int = SEQUENCE, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    out = [(s, size) for s in range(0, n - size + 1, size)]
    at = len(out) * size
    whole = (n - at) // unit * unit
    if whole:
        out.append((at, whole))
    if n - at - whole:
        out.append((at + whole, n - at - whole))
    return out


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Tokenise and cut: ``PIECE_SCHEMA``. A crc is of the piece's ids, 4 bytes each, little-endian."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                src, rows = [], []
                for k, ids in enumerate(tok.encode([x if isinstance(x, str) else "" for x in part["text"]])):
                    ids += end
                    n = len(ids) // 4
                    for s, m in cuts(n, size, unit):
                        src.append(k)
                        rows.append((s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n))
                out = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens"])
                out.insert(0, "doc_id", part["doc_id"].take(src).array)
                yield out
        tok.forget()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInPandas(trimmed(run), PIECE_SCHEMA)


# --- the linear program -----------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The pattern of greatest price within the capacity; ``most`` bounds each count.

    One pass over capacities, for all items at once where counts aren't bounded;
    item by item, in binary lots, where they are.
    """
    n = len(lengths)
    if most is None:
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.argsort(lengths, kind="stable")
        ls, ps = lengths[order], prices[order]
        for c in range(1, capacity + 1):
            k = np.searchsorted(ls, c, side="right")
            best[c] = best[c - 1]
            if k:
                v = best[c - ls[:k]] + ps[:k]
                j = int(v.argmax())
                if v[j] > best[c] + 1e-12:
                    best[c], choice[c] = v[j], order[j]
        pattern, c = np.zeros(n, np.int64), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                pattern[choice[c]] += 1
                c -= lengths[choice[c]]
        return float(best[capacity]), pattern
    best, lots = np.zeros(capacity + 1), []
    for i in range(n):
        left, lot = min(int(most[i]), capacity // int(lengths[i])), 1
        while left > 0:
            lot = min(lot, left)
            left -= lot
            w = lot * int(lengths[i])
            with_lot = np.full(capacity + 1, -np.inf)
            with_lot[w:] = best[: capacity + 1 - w] + lot * prices[i]
            take = with_lot > best + 1e-12
            best = np.where(take, with_lot, best)
            lots.append((i, lot, w, take))
            lot *= 2
    pattern, c = np.zeros(n, np.int64), capacity
    for i, lot, w, take in reversed(lots):
        if take[c]:
            pattern[i] += lot
            c -= w
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """min sum(x), A x = demand, x >= 0 over all patterns: basic patterns (columns) and x.

    Revised simplex; the entering column is the knapsack's pattern under the
    current duals. Stops where no pattern's price exceeds 1.
    """
    n = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    x = demand / np.diag(basis)
    for _ in range(max_rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, pattern = knapsack(lengths, duals, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratios = np.where(direction > 1e-10, x / np.where(direction > 1e-10, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = pattern
    return basis.astype(np.int64), x


def plan_patterns(histogram: Mapping[int, int], size: int = SEQUENCE, unit: int = UNIT) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) pairs that use up the histogram exactly; a pattern maps length to count."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v})
    out: list[tuple[dict[int, int], int]] = []
    if left[size]:
        out.append(({size: 1}, left.pop(size)))
    for scale, group in ((unit, [k for k in left if k % unit == 0]), (1, [k for k in left if k % unit])):
        group = sorted(group)
        if not group:
            continue
        lengths = np.array(group) // scale
        columns, x = column_generation(lengths, np.array([left[k] for k in group], float), size // scale)
        for j, times in enumerate(np.floor(x + 1e-9).astype(np.int64)):
            pattern = {k: int(c) for k, c in zip(group, columns[:, j]) if c}
            times = min([int(times), *(left[k] // c for k, c in pattern.items())])
            if times > 0 and pattern:
                out.append((pattern, times))
                for k, c in pattern.items():
                    left[k] -= c * times
    while left := +left:
        lengths = np.array(sorted(left, reverse=True))
        counts = np.array([left[k] for k in lengths])
        # fullest first; among equally full ones, those of longer pieces
        _, used = knapsack(lengths, lengths * (1 + lengths / (1e3 * size)), size, counts)
        pattern = {int(k): int(c) for k, c in zip(lengths, used) if c}
        times = min(left[k] // c for k, c in pattern.items())
        out.append((pattern, times))
        for k, c in pattern.items():
            left[k] -= c * times
    return out


def placement(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces a sequence and first offset of each pattern."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for k in sorted(pattern, reverse=True):
            rows.setdefault(k, []).append((ranks[k], sequence, pattern[k], offset))
            ranks[k] += pattern[k] * times
            offset += k * pattern[k]
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


# --- the operator -----------------------------------------------------------


def assign(cut: DataFrame, size: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Sequence and offset of each piece; ``cut`` must read the same each time it is read."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer lengths than size / unit + unit
    buckets = max(8, -(-sum(counts.values()) // BUCKET_PIECES))
    places = cut.sparkSession.sparkContext.broadcast(placement(plan_patterns(counts, size, unit)))
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("k", F.row_number().over(order) - 1).join(offsets, ["length", "bucket"]).selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "first + k as rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = places.value
        for batch in batches:
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for k in np.unique(lengths):
                at = lengths == k
                first, sequence, per, offset = table[int(k)]
                j = np.searchsorted(first, ranks[at], side="right") - 1
                nth = ranks[at] - first[j]
                seq[at], off[at] = sequence[j] + nth // per[j], offset[j] + nth % per[j] * k
            yield batch.drop(columns="rank").assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """One row per piece: where it starts in its document, its crc, its sequence and offset."""
    return assign(cut_lineage(pieces(docs, tokenizer_path, size, unit)), size, unit)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"), default_tokenizer())
