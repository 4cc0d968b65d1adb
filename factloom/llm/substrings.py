"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

A run of SEED words is a seed if the least of its words' hashes is the first or the
last: half of all runs are, whatever stands around them, and in unchanged text one
begins at every third word at the latest. Of 50 words of which a fifth are edited seven runs
at least are whole (the q-gram lemma), so several seeds are shared with the source.
Seeds meet in buckets of their hashes; each
is matched with documents before it that hold it (see PARTNERS). Matches of
two documents are chained in order with gap costs through a Fenwick tree, and
the words between and around a chain's anchors are aligned.

Seeds with more holders before them than PARTNERS that lie in no passage found so are
then held, with the words around them, against all holders before them. Of 50 to 99
words of which a fifth are edited LEAST_RUNS runs of three words are whole, which rules
out most holders without a look at them: runs that many hold only count at their most
(see sharing), so a common line alone makes no pairs. What is left is chained and aligned as before.

The first document (by doc_id) that holds a passage keeps it; it repeats in the others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import in_slices, small
from factloom.session import cut, prepare, shuffle_partitions

#: Words of a seed, least buckets of seeds and of documents, rows that a worker packs at once.
SEED, BUCKETS, PACK = 4, 512, 1_000_000
#: Documents that an occurrence of a seed is matched with at first: the first that holds it, and the nearest before its own.
PARTNERS = 4
#: Pairs of one seed's occurrences in two documents that are all matched at first.
OCCURRENCES = 16
#: Runs of RUN words that AROUND words share at least with their source where a passage lies in them; most edits among these.
#: Any passage has a part of 50 to 99 words of which a fifth at most are edited: of m words, m - 2 - 3 * 0.2 * m runs of three are whole.
RUN, LEAST_RUNS, PART_EDITS = 3, 18, 19
#: Words around a seed on either side: the rest of such a part, with its edits.
AROUND = 99 - SEED + PART_EDITS + 2
#: Holders above which a run isn't looked up but counted; holders and seeds compared at once; bits of the map of open seeds for each, and at most (16 MB).
MANY, HOLDERS, OPEN = 64, 4000, 500
#: Entries of the tables that one step of a comparison fills at most (some 8 bytes each).
STEP = 1_000_000
#: Words of which one occurrence is held of a seed that repeats back to back.
THIN = 32
MAP_BITS, MOST_BITS = 64, 1 << 27
#: Words that the anchors of a chain cover at least.
LEAST_COVERED = SEED + 3
#: Least words of a passage, least part of its words that agree.
LEAST_WORDS, LEAST_IDENTITY = 50, 0.8
#: Cost of a word between two anchors of a chain, on either side; most such words on a side.
GAP_COST, MOST_GAP = 0.2, 64
#: Edits in a row that end an alignment; words fetched beyond the last matches near a chain.
MOST_EDITS, REACH = 12, 64
#: Edits after which an alignment goes on by itself; chains and words that are aligned together.
MOST_WAVES, CHAINS, CHAIN_WORDS = 128, 4000, 4_000_000
#: Least words of a piece that may lengthen a passage.
LEAST_PIECE = 10
#: Places whose powers a worker keeps.
POWERS = 1 << 21
#: Words in a stored block of word codes.
BLOCK = 64

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else (32 if b == 32 or 9 <= b <= 13 else b) for b in range(256)], np.uint8)
#: A byte of a word as a number above zero, 0 for white space; UTF-8 has no byte 255.
_VALUE = bytes(0 if b == 32 else min(255, b + 1) for b in _FOLD.tolist())


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row (runs without ASCII white space, A-Z lowered), and the first word of each text and the end."""
    raw = [t.encode(errors="replace") for t in texts]
    buf = np.frombuffer((b" " + b" ".join(raw) + b" ").translate(_VALUE), np.uint8)
    inside = buf > 0
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    at = np.cumsum([1] + [len(r) + 1 for r in raw])
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    powers, inverse = _kept_powers() if len(buf) <= POWERS else _made_powers(len(buf))
    # each byte times a power of its place, the sum over a word divided by that of the word's place
    return _mix(np.add.reduceat(buf * powers[: len(buf)], starts) * inverse[starts]), first


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(POWERS)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        powers, inverse = np.cumprod(np.full(n, _P, np.uint64), dtype=np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64), dtype=np.uint64)
        return powers, np.r_[np.uint64(1), inverse[:-1]]


def seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, first word) of the runs of SEED words that are seeds."""
    return seeds_among(*word_hashes(texts))


def seeds_among(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of texts from their words' hashes and first words."""
    n = len(h) - SEED + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    k = np.zeros(n, np.uint64)
    for j in range(SEED):
        k = k * _Q + h[j : j + n]
    inner = reduce(np.minimum, [h[j : j + n] for j in range(1, SEED - 1)])
    at = np.flatnonzero((text[:n] == text[SEED - 1 :]) & (np.minimum(h[:n], h[SEED - 1 :]) <= inner))
    return _mix(k[at]), text[at], at - first[text[at]]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One binary row for each bucket: the columns' numbers, one column after the other."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = [b"".join(_planes(c[s:e]) for c in columns) for s, e in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], types: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket and its columns; rows come sorted by bucket."""
    sizes = [np.dtype(t).itemsize for t in types]

    def each() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column("bucket").to_pylist(), b.column("packed"), strict=True)

    for bucket, rows in groupby(each(), key=lambda r: r[0]):
        parts: list[list[np.ndarray]] = []
        for _, raw in rows:
            raw = np.frombuffer(raw.as_buffer(), np.uint8)
            n, at, own = len(raw) // sum(sizes), 0, []
            for dtype, size in zip(types, sizes, strict=True):
                own.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(dtype)[:, 0])
                at += n * size
            parts.append(own)
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        parts.clear()
        yield bucket, whole
        del whole


_SEED_TYPES, _MATCH_TYPES = ("<u4", "<i8", "<i4"), ("<i8", "<i8", "<i4", "<i4")
#: Seeds with the words around them.
_WINDOW_TYPES = (*_SEED_TYPES, f"V{SEED + 2 * AROUND}")


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _pack_seeds(buckets: int):
    """Seeds packed by bucket: 32 bits of each hash beside the bucket's, document and first word."""

    def pack_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for b in small(batches):
            ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for lo, hi in in_slices(texts, 1_500_000):
                h, text, pos = seeds(texts[lo:hi])
                held.append((_bucket_of(h, buckets), h.astype("<u4"), ids[lo:hi][text].astype("<i8"), pos.astype("<i4")))
                count += len(h)
                if count > PACK:
                    bucket, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield _packed(bucket, columns)
                    held, count = [], 0
        if count:
            bucket, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _packed(bucket, columns)

    return pack_seeds


def matches_of(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (document, source, first word, first word in the source) of the seeds of a bucket, and rows (document, hash, first word, -1) of those not matched with all occurrences before:
    more than PARTNERS documents before hold them, or one document so often that there are more than OCCURRENCES pairs.

    Of those the r-th occurrence in a document is matched with the r-th in the source, from the first again where that has fewer; of others all are.
    """
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]  # rows may repeat a doc_id
    h, doc, pos = h[once], doc[once], pos[once]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new = new_h | np.r_[True, doc[1:] != doc[:-1]]
    start = np.flatnonzero(new)  # of each group of one seed and document
    count = np.diff(np.r_[start, len(h)])
    group = np.cumsum(new) - 1
    first = np.maximum.accumulate(np.where(new_h[start], np.arange(len(start)), 0))
    out = []
    is_late = group - first[group] > PARTNERS
    for back in range(PARTNERS):
        other = first[group] if not back else group - back
        at = np.flatnonzero(other < group if not back else other > first[group])
        o = other[at]
        few = count[group[at]] * count[o] <= OCCURRENCES
        is_late[at[~few]] = True
        n = np.where(few, count[o], 1)
        at, o, few, nth = (np.repeat(x, n) for x in (at, o, few, np.cumsum(n) - n))
        to = start[o] + np.where(few, np.arange(len(at)) - nth, (at - start[group[at]]) % count[o])
        out.append(np.column_stack([doc[at], doc[start[o]], pos[at], pos[to]]))
    late = np.flatnonzero(is_late)
    return np.concatenate(out), np.column_stack([doc[late], h[late].astype(np.int64), pos[late], np.full(len(late), -1)])


def _packed_matches(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    rows = np.concatenate(held)
    bucket = (_mix(rows[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return _packed(bucket, [rows[:, i].astype(t) for i, t in enumerate(_MATCH_TYPES)])


def _pack_matches(buckets: int):
    """Matches of the packed seeds, and seeds with more holders (their bucket and hash in place of the source), packed by the document's bucket."""

    def pack_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for bucket, columns in _unpacked(batches, _SEED_TYPES):
            found, late = matches_of(*columns)
            late[:, 1] |= bucket << 32
            held += [found, late]
            count += len(found) + len(late)
            if count > PACK:
                yield _packed_matches(held, buckets)
                held, count = [], 0
        if count:
            yield _packed_matches(held, buckets)

    return pack_matches


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of 16-bit word codes, for alignments."""
    for b in small(batches):
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for lo, hi in in_slices(texts, 1_500_000):
            h, first = word_hashes(texts[lo:hi])
            codes = (h >> np.uint64(48)).astype("<u2")
            docs, blocks, words = [], [], []
            for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                raw = codes[s:e].tobytes()
                for j in range(0, len(raw), 2 * BLOCK):
                    docs.append(ids[lo + i])
                    blocks.append(j // (2 * BLOCK))
                    words.append(raw[j : j + 2 * BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blocks, pa.int32()), pa.array(words, pa.binary())], names=["doc", "block", "codes"])


def anchors(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, source_pos: np.ndarray) -> np.ndarray:
    """Join matches on one diagonal that touch or overlap into anchors: rows (document, source, first word, first word in the source, words), sorted."""
    order = np.lexsort((pos, source_pos - pos, source, doc))
    doc, source, pos, source_pos = doc[order], source[order], pos[order], source_pos[order]
    diagonal = source_pos - pos
    new = np.r_[True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > SEED)]
    s = np.flatnonzero(new)
    e = np.r_[s[1:], len(pos)] - 1
    out = np.column_stack([doc[s], source[s], pos[s], source_pos[s], pos[e] - pos[s] + SEED]).astype(np.int64)
    return out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Split anchors into best chains: each goes on in both documents, a gap costs its words on either side.

    A Fenwick tree over the anchors' ends in the source gives the best chain that
    ends before an anchor; anchors enter it once the sweep has passed their end.
    """
    if len(parts) == 1:
        return [parts]
    ends = sorted({a + n for _, a, n in parts})
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends) + 1)
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    ended = [parts[i][0] + parts[i][2] for i in by_end]
    near = lambda x, y: y[0] - x[0] - x[2] <= MOST_GAP and y[1] - x[1] - x[2] <= MOST_GAP
    score, back, entered = [0.0] * len(parts), [-1] * len(parts), 0
    for i, (p, a, n) in enumerate(parts):
        while entered < len(by_end) and parts[by_end[entered]][0] + parts[by_end[entered]][2] <= p:
            j = by_end[entered]
            q, b, m = parts[j]
            value = (score[j] + GAP_COST * (q + m + b + m), j)
            k = bisect_right(ends, b + m)
            while k <= len(ends):
                tree[k] = max(tree[k], value)
                k += k & -k
            entered += 1
        best, k = (float("-inf"), -1), bisect_right(ends, a)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        score[i] = float(n)
        if best[1] >= 0 and not near(parts[best[1]], parts[i]):
            best, k = (float("-inf"), -1), entered
            while k and p - ended[k - 1] <= MOST_GAP:  # the best one is too far: the best of those within reach
                k -= 1
                j = by_end[k]
                q, b, m = parts[j]
                if b + m <= a and a - b - m <= MOST_GAP:
                    best = max(best, (score[j] + GAP_COST * (q + m + b + m), j))
        gain = best[0] - GAP_COST * (p + a)
        if gain > 0:
            score[i] += gain
            back[i] = best[1]
    out, used = [], set()
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(parts[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the packed matches of each bucket of documents; seeds with more holders as rows of chain -1."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
    names = ["doc", "chain", "of", "parts", "first", "end", "late"]
    for _, columns in _unpacked(batches, _MATCH_TYPES):
        is_late = columns[3] < 0
        if is_late.any():
            doc, key, pos, _ = (c[is_late] for c in columns)
            order = np.lexsort((key, pos, doc))
            doc, key, pos = doc[order], key[order], pos[order]
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]).tolist()
            rows = [(int(doc[s]), -1, None, None, None, None, pos[s:e].tobytes() + key[s:e].tobytes()) for s, e in zip(start, start[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        doc, source, pos, source_pos = (c[~is_late] for c in columns)
        if not len(doc):
            continue
        every = anchors(doc, source, pos, source_pos)
        # words that a document shares with a source, at most
        pair = np.flatnonzero(np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)])
        covers = np.add.reduceat(every[:, 4], pair)
        size = np.diff(np.r_[pair, len(every)])
        kept = every[np.repeat(covers >= LEAST_COVERED, size)]
        if not len(kept):
            continue
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        out: list[tuple] = []
        start = np.flatnonzero(np.r_[True, kept[1:, 0] != kept[:-1, 0], True])
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            i = int(kept[lo, 0])
            own = pos[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")]
            out += [(*row, None) for row in _chains_of(i, kept[lo:hi], own)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _chains_of(doc: int, rows: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """The chains of one document from its anchors, each with the words of its source to be fetched; before them the document's own words.

    The words asked for follow the document's matches with any source (``pos``, sorted) until MOST_GAP words have none, as a passage
    may go on where its seeds are matched with others.
    """
    gap = np.flatnonzero(np.diff(pos) > MOST_GAP)
    lows, highs = pos[np.r_[0, gap + 1]].tolist(), (pos[np.r_[gap, len(pos) - 1]] + SEED).tolist()
    out: list[tuple] = []
    low, high = 1 << 31, 0
    for source, parts in groupby(rows[:, 1:].tolist(), key=lambda r: r[0]):
        for chain in chains([(p, a, n) for _, p, a, n in parts]):
            if sum(part[2] for part in chain) < LEAST_COVERED:
                continue
            first, end = chain[0][0], chain[-1][0] + chain[-1][2]
            before = first - lows[bisect_right(lows, first) - 1] + REACH
            after = highs[bisect_left(highs, end)] - end + REACH
            low, high = min(low, first - before), max(high, end + after)
            out.append((doc, len(out) + 1, source, [x for part in chain for x in part], max(0, chain[0][1] - before), chain[-1][1] + chain[-1][2] + after))
    return [(doc, 0, doc, [], max(0, low), high), *out] if out else []


def edit_distance(a: list | np.ndarray, b: list | np.ndarray, most: int | None = None) -> int:
    """Word edit distance by waves of furthest cells, one wave an edit (Ukkonen 1985); beyond ``most`` edits any greater number."""
    a, b = (x.tolist() if isinstance(x, np.ndarray) else x for x in (a, b))
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m)
    wave, edits = {0: 0}, 0
    while True:
        for k, i in wave.items():
            j = i + k
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            wave[k] = i
        if wave.get(m - n) == n:
            return edits
        edits += 1
        if most is not None and edits > most:
            return edits
        wave = _next_wave(wave, n, m)


def _next_wave(wave: dict[int, int], n: int, m: int) -> dict[int, int]:
    """Furthest words of the first text on each diagonal (second minus first) after one more edit, cells within n x m."""
    new: dict[int, int] = {}
    for k, i in wave.items():
        j = i + k
        if i < n and j < m and new.get(k, -1) <= i:
            new[k] = i + 1
        if j < m and new.get(k + 1, -1) < i:
            new[k + 1] = i
        if i < n and new.get(k - 1, -1) <= i:
            new[k - 1] = i + 1
    return new


def extend(a: list[int], i: int, b: list[int], j: int) -> tuple[list[tuple[int, int, int]], int]:
    """Align two texts from words ``i`` and ``j`` on until about MOST_EDITS edits come in a row.

    Returns places (words of a, words of b, edits) of the alignment, at both ends of runs of equal words, and
    how many of them lead to the best one, where an edit costs three words. Waves of
    furthest cells, one an edit, go on where they may still do better.
    """
    a, b = a[i:], b[j:]
    n, m = len(a), len(b)
    out: list[tuple[int, int, int]] = []
    wave, edits, top, best, far = {0: 0}, 0, 0, 0, 0
    while wave:
        reached = None
        for k, i in wave.items():
            s, j = i, i + k
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            if i > s:
                wave[k] = i
                if i > far:
                    far, reached = i, (s, k)
        if reached:
            s, k = reached
            if out and s > out[-1][0]:
                out.append((s, s + k, edits))
            out.append((far, far + k, edits))
            if far - 3 * edits > top:
                top, best = far - 3 * edits, len(out)
        edits += 1
        least = top - 2 * MOST_EDITS - 1 + 3 * edits
        wave = {k: i for k, i in _next_wave(wave, n, m).items() if i >= least}
    return out, best


def _agreeing(points: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The longest stretches between places of an alignment that are long enough and agree enough, apart from each other."""
    if len(points) < 2:
        return []
    at = np.array(points, np.int64)
    agree = at[:, 0] - (at[:, 2] / (1 - LEAST_IDENTITY)).round().astype(np.int64)  # doesn't fall over a stretch that agrees
    start = np.searchsorted(-np.minimum.accumulate(agree), -agree)
    size = at[:, 0] - at[start, 0]
    e = int(np.argmax(size))
    s = int(start[e])
    if size[e] < LEAST_WORDS:
        return []
    x, y = points[s], points[e]
    return [*_agreeing(points[: s + 1]), (x[0], y[0], x[1], y[1], y[2] - x[2]), *_agreeing(points[e:])]


def whole(parts: list[tuple[int, int, int]], own: list[int], own_from: int, other: list[int], other_from: int) -> list[tuple[int, int, int]]:
    """Anchors lengthened by the equal words beside them, up to each other: seeds don't begin at every word."""
    out = []
    low, source_low = own_from, other_from
    for i, (p, a, n) in enumerate(parts):
        high, source_high = parts[i + 1][:2] if i + 1 < len(parts) else (own_from + len(own), other_from + len(other))
        q, b = p + n, a + n
        while p > low and a > source_low and own[p - 1 - own_from] == other[a - 1 - other_from]:
            p, a = p - 1, a - 1
        while q < high and b < source_high and own[q - own_from] == other[b - other_from]:
            q, b = q + 1, b + 1
        out.append((p, a, q - p))
        low, source_low = q, b
    return out


def joined(parts: list[tuple[int, int, int]], own: list[int], own_from: int, other: list[int], other_from: int) -> list[list[tuple[int, int, int]]]:
    """A chain's places (word, word in the source, differing words before), at both ends of its anchors, split where a gap hardly agrees."""
    runs: list[list[tuple[int, int, int]]] = []
    for p, a, n in whole(parts, own, own_from, other, other_from):
        if runs:
            q, b, before = runs[-1][-1]
            most = max(MOST_EDITS, min(MOST_GAP // 2, (1 - LEAST_IDENTITY) * (p + n - runs[-1][0][0]) + 1e-9))
            wrong = edit_distance(own[q - own_from : p - own_from], other[b - other_from : a - other_from], int(most))
            if wrong <= most:
                runs[-1] += [(p, a, before + wrong), (p + n, a + n, before + wrong)]
                continue
        runs.append([(p, a, 0), (p + n, a + n, 0)])
    return runs


def lengthened(run: list[tuple[int, int, int]], left: list[tuple[int, int, int]], left_best: int, right: list[tuple[int, int, int]], right_best: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, end, first word in the source, end, differing words) of a run of a chain and its alignments to the left and right."""
    (p, a, _), (q, b, wrong) = run[0], run[-1]
    before = [(p - i, a - j, -w) for i, j, w in reversed(left)]
    after = [(q + i, b + j, wrong + w) for i, j, w in right]
    x = before[len(left) - left_best] if left_best else run[0]
    y = after[right_best - 1] if right_best else run[-1]
    words, wrong = y[0] - x[0], y[2] - x[2]
    fits = wrong <= (1 - LEAST_IDENTITY) * words + 1e-9
    if fits and words >= LEAST_WORDS:
        return [(x[0], y[0], x[1], y[1], wrong)]
    if found := _agreeing(before + run + after):
        return found
    return [(x[0], y[0], x[1], y[1], wrong)] if fits and words >= LEAST_PIECE else []


def extend_all(codes: np.ndarray, at: np.ndarray, step: np.ndarray, left: np.ndarray) -> list[tuple[list[tuple[int, int, int]], int]]:
    """extend for many pairs of texts at once: ``codes`` holds the words of all, and the rows of the other arguments are of pairs.

    ``at`` has the first word of either text in ``codes``, ``step`` 1 or -1 (backwards), ``left`` the words of either
    text. Of furthest cells of one wave that reach as far the one on the least diagonal counts. Pairs that go on beyond MOST_WAVES edits are left to extend.
    """
    out: list[tuple[list[tuple[int, int, int]], int]] = [([], 0) for _ in range(len(at))]
    row = np.flatnonzero((left > 0).all(axis=1))
    a, b, step, n, m = at[row, 0], at[row, 1], step[row], left[row, 0].astype(np.int32), left[row, 1].astype(np.int32)
    top, far = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
    wave = np.zeros((len(row), 1), np.int32)  # below zero where there is no cell
    for edits in range(MOST_WAVES + 1):
        if not len(row):
            return out
        span = 2 * edits + 1
        shift = np.arange(-edits, edits + 1, dtype=np.int32)
        before, flat = wave.copy(), wave.ravel()
        cell = np.flatnonzero(flat >= 0)
        r, k = np.divmod(cell, span)
        k = shift[k]
        i = flat[cell]
        x, y, by, rest = a[r] + step[r] * i, b[r] + step[r] * (i + k), step[r], np.minimum(n[r] - i, m[r] - i - k)
        run = np.zeros(len(cell), np.int32)
        on = np.flatnonzero(rest > 0)
        while len(on):
            on = on[codes[x[on]] == codes[y[on]]]
            run[on] += 1
            x[on] += by[on]
            y[on] += by[on]
            on = on[run[on] < rest[on]]
        flat[cell] = i + run
        order = np.argsort(np.abs(shift), kind="stable")
        reach = np.where(wave > before, wave, -1)[:, order]
        best = reach.argmax(axis=1)
        reached = reach[np.arange(len(row)), best]
        better = np.flatnonzero(reached > far)
        far[better] = reached[better]
        column = order[best[better]]
        gains = reached[better] - 3 * edits > top[better]
        top[better[gains]] = reached[better[gains]] - 3 * edits
        for o, s, e, k, gain in zip(row[better].tolist(), before[better, column].tolist(), reached[better].tolist(), shift[column].tolist(), gains.tolist(), strict=True):
            points, most = out[o]
            if points and s > points[-1][0]:
                points.append((s, s + k, edits))
            points.append((e, e + k, edits))
            if gain:
                out[o] = points, len(points)
        j = wave + shift
        there = wave >= 0
        after = np.full((len(row), span + 2), -1, np.int32)
        after[:, 1:-1] = np.where(there & (wave < n[:, None]) & (j < m[:, None]), wave + 1, -1)
        np.maximum(after[:, 2:], np.where(there & (j < m[:, None]), wave, -1), out=after[:, 2:])
        np.maximum(after[:, :-2], np.where(there & (wave < n[:, None]), wave + 1, -1), out=after[:, :-2])
        after[after < (top - 2 * MOST_EDITS - 1 + 3 * (edits + 1))[:, None]] = -1
        alive = (after >= 0).any(axis=1)
        wave = after
        if not alive.all():
            row, a, b, step, n, m, top, far, wave = (v[alive] for v in (row, a, b, step, n, m, top, far, wave))
    for o, x, y, by, p, q in zip(row.tolist(), a.tolist(), b.tolist(), step.tolist(), n.tolist(), m.tolist(), strict=True):
        own, other = (codes[v : v + w] if by > 0 else codes[v - w + 1 : v + 1][::-1] for v, w in ((x, p), (y, q)))
        out[o] = extend(own.tolist(), 0, other.tolist(), 0)
    return out


def align_all(chained: list[tuple[list[tuple[int, int, int]], np.ndarray, int, np.ndarray, int]]) -> list[list[tuple[int, int, int, int, int]]]:
    """Align chains (anchors, word codes and the first one's place in the document, and in the source): (first word, end, first word in the source, end, differing words), split where a gap hardly agrees."""
    held: list[np.ndarray] = []
    start: dict[int, int] = {}
    size = 0

    def place(codes: np.ndarray) -> int:
        nonlocal size
        if id(codes) not in start:  # a document's own words are the same in all its chains
            start[id(codes)] = size
            held.append(codes)
            size += len(codes)
        return start[id(codes)]

    ends: list[tuple] = []
    runs: list[tuple[int, list]] = []
    lists: dict[int, list] = {}
    for number, (parts, own, own_from, other, other_from) in enumerate(chained):
        if id(own) not in lists:
            lists = {id(own): own.tolist()}
        x, y = place(own) - own_from, place(other) - other_from
        for run in joined(parts, lists[id(own)], own_from, other.tolist(), other_from):
            (p, a, _), (q, b, _) = run[0], run[-1]
            runs.append((number, run))
            ends.append((x + p - 1, y + a - 1, -1, p - own_from, a - other_from))
            ends.append((x + q, y + b, 1, own_from + len(own) - q, other_from + len(other) - b))
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in chained]
    if runs:
        end = np.array(ends, np.int64)
        ways = extend_all(np.concatenate(held), end[:, :2], end[:, 2], end[:, 3:])
        for (number, run), left, right in zip(runs, ways[::2], ways[1::2], strict=True):
            out[number] += lengthened(run, *left, *right)
    return out


def passages(pieces: list[tuple[int, int, int, int, int, int]]) -> list[tuple]:
    """Join aligned pieces (first, end, source, source first, source end, differing) of one document, of any source, that touch or overlap; keep the long ones.

    A passage carries the source of its longest piece.
    """
    out: list[dict] = []
    for first, end, source, s_first, s_end, wrong in sorted(pieces, key=lambda x: (x[0], -x[1], x[5], x[2:5])):
        piece = (end - first, -source, s_first, s_end, first, end)
        if out and first <= out[-1]["end"]:
            last = out[-1]
            last["wrong"] += wrong if end > last["end"] else 0
            last["end"], last["best"] = max(last["end"], end), max(last["best"], piece)
        else:
            out.append({"first": first, "end": end, "wrong": wrong, "best": piece})
    return [(x["first"], x["end"], -x["best"][1], x["best"][2], x["best"][3], min(1.0, 1 - x["wrong"] / (x["end"] - x["first"]))) for x in out if x["end"] - x["first"] >= LEAST_WORDS]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each chain's document, number, source, anchors, first block and word codes; rows come sorted by document, chain and block, heads (block -1) first."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        doc, number, block = (b.column(c).to_numpy() for c in ("doc", "chain", "block"))
        heads = pa.array(np.flatnonzero(block < 0))
        named = zip(b.column("source").take(heads).to_pylist(), b.column("parts").take(heads).to_pylist(), strict=True)
        codes = b.column("codes").cast(pa.large_binary())
        offsets = np.frombuffer(codes.buffers()[1], "<i8")[codes.offset : codes.offset + len(codes) + 1].tolist()
        words = np.frombuffer(codes.buffers()[2] or b"", np.uint8)
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])
        for s, e, own, chain_number, first in zip(start.tolist(), [*start[1:].tolist(), len(doc)], doc[start].tolist(), number[start].tolist(), block[start].tolist(), strict=True):
            if held is None or first < 0 or (own, chain_number) != (held[0], held[1]):
                if held is not None and held[5]:
                    yield (*held[:5], np.concatenate(held[5]).view("<u2"))
                held = [own, chain_number, *(next(named) if first < 0 else (None, None)), None, []]
            s += first < 0
            if s < e:
                if held[4] is None:
                    held[4] = int(block[s])
                held[5].append(words[offsets[s] : offsets[e]])
    if held is not None and held[5]:
        yield (*held[:5], np.concatenate(held[5]).view("<u2"))


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the chains of each document; its rows come sorted by chain and block, its own words first."""
    out: list[tuple] = []
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = ["doc_id", "source_doc_id", "first_word", "end_word", "source_first_word", "source_end_word", "identity"]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    waiting: list[tuple] = []  # chains of whole documents
    of: list[tuple[int, int]] = []

    def aligned() -> list[tuple]:
        found: list[tuple] = []
        for doc, own in groupby(zip(of, align_all(waiting), strict=True), key=lambda r: r[0][0]):
            pieces = [(first, end, source, s_first, s_end, wrong) for (_, source), some in own for first, end, s_first, s_end, wrong in some]
            found += [(doc, source, first, end, s_first, s_end, identity) for first, end, source, s_first, s_end, identity in passages(pieces)]
        waiting.clear()
        of.clear()
        return found

    words = 0
    for doc, rows in groupby(_fetched(batches), key=lambda r: r[0]):
        own = None
        for _, number, source, parts, block, codes in rows:
            words += len(codes)
            if not number:
                own, own_from = codes, block * BLOCK
            elif own is not None:
                waiting.append(([tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)], own, own_from, codes, block * BLOCK))
                of.append((doc, source))
        if len(waiting) > CHAINS or words > CHAIN_WORDS:
            out += aligned()
            words = 0
        if len(out) > 5000:
            yield batch()
            out = []
    out += aligned()
    if out:
        yield batch()


def _open_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds with more holders that lie in no passage of their document, packed by bucket with the places below zero and no words around."""
    held: list[tuple] = []
    count = 0

    def pack() -> pa.RecordBatch:
        key, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        return _packed((key >> 32).astype(np.int32), [key.astype("<u4"), doc, -1 - pos, np.zeros(len(key), _WINDOW_TYPES[3])])

    for b in batches:
        for doc, raw, spans in zip(b.column("doc").to_pylist(), b.column("late").to_pylist(), b.column("spans").to_pylist(), strict=True):
            n = len(raw) // 12
            pos, key = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n)
            is_open = np.ones(n, bool)
            for s in spans or []:
                is_open &= (pos < s["first_word"]) | (pos + SEED > s["end_word"])
            held.append((key[is_open], np.full(int(is_open.sum()), doc, "<i8"), pos[is_open]))
            count += len(held[-1][0])
            if count > PACK // 10:
                yield pack()
                held, count = [], 0
    if count:
        yield pack()


def _places(bucket: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """The place of each seed in a map of 32-bit places."""
    return _mix(np.asarray(bucket).astype(np.uint64) << np.uint64(32) | h.astype(np.uint64)).astype(np.uint32)


def _open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the distinct seeds of each bucket, 4 bytes each."""
    for bucket, columns in _unpacked(batches, _WINDOW_TYPES):
        yield pa.RecordBatch.from_arrays([pa.array([_places(bucket, np.unique(columns[0])).tobytes()], pa.binary())], names=["places"])


def _apart(h: np.ndarray, text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an occurrence is held: of a seed that repeats back to back the first, the last and one in THIN words.

    Between them the words go round, so that what repeats there does so beside one of those held, which a source of 50 such words holds too.
    """
    before, after, same_part = np.zeros((3, len(h)), bool)
    for j in range(1, SEED + 1):
        near = (h[j:] == h[:-j]) & (text[j:] == text[:-j]) & (pos[j:] - pos[:-j] <= SEED)
        before[j:] |= near
        after[: len(h) - j] |= near
        same_part[j:] |= near & (pos[j:] // THIN == pos[:-j] // THIN)
    return ~(before & after & same_part)


def _pack_windows(buckets: int, shared):
    """Occurrences (see _apart) of the seeds on the map (and of a few others), with one byte for each word around, 0 beyond the text; packed by bucket."""

    def pack_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        mask = np.uint32(8 * len(bits) - 1)
        around = np.arange(-AROUND, SEED + AROUND)
        held: list[tuple] = []
        count = 0

        def pack() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            bucket, *columns = (c[order] for c in columns)
            return _packed(bucket, columns)

        for b in small(batches):
            ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for lo, hi in in_slices(texts, 1_500_000):
                words, first = word_hashes(texts[lo:hi])
                h, text, pos = seeds_among(words, first)
                bucket, low = _bucket_of(h, buckets), h.astype("<u4")
                place = _places(bucket, low) & mask
                at = np.flatnonzero((bits[place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8) & 1).astype(bool) & _apart(h, text, pos))
                if not len(at):
                    continue
                codes = ((words >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
                for k in range(0, len(at), PACK // 20):
                    i = at[k : k + PACK // 20]
                    start, end = first[text[i]], first[text[i] + 1]
                    place = (start + pos[i])[:, None] + around
                    window = np.where((place >= start[:, None]) & (place < end[:, None]), codes[np.clip(place, 0, len(codes) - 1)], np.uint8(0))
                    held.append((bucket[i], low[i], ids[lo:hi][text[i]].astype("<i8"), pos[i].astype("<i4"), np.ascontiguousarray(window).view(_WINDOW_TYPES[3])[:, 0]))
                    count += len(i)
                    if count > PACK // 20:
                        yield pack()
                        held, count = [], 0
        if count:
            yield pack()

    return pack_windows


def _runs(windows: np.ndarray, n: int) -> np.ndarray:
    """The codes of each run of ``n`` words as one number; 0 where the text ends within."""
    size = windows.shape[1] - n + 1
    out, whole = np.zeros((len(windows), size), np.uint32), np.ones((len(windows), size), bool)
    for j in range(n):
        out = out << np.uint32(8) | windows[:, j : j + size]
        whole &= windows[:, j : j + size] > 0
    return np.where(whole, out, np.uint32(0))


def _surplus(agree: np.ndarray) -> np.ndarray:
    """By how many runs at most the agreeing ones (a row for each window) exceed those that a part around the seed shares at least; below zero none can be one.

    A part of m words in 50 to 99 has m - 2 - 3 * (m // 5) whole runs; one of 5q + r words has one of 5q within that lacks r runs at most, so multiples of five do.
    """
    total = np.zeros((len(agree), agree.shape[1] + 1), np.int16)
    np.cumsum(agree, axis=1, out=total[:, 1:], dtype=np.int16)
    best = np.full(len(agree), -1000, np.int16)
    for m in range(LEAST_WORDS, 2 * LEAST_WORDS, 5):
        s = AROUND + SEED - m
        inside = total[:, s + m - RUN + 1 : AROUND + m - RUN + 2] - total[:, s : AROUND + 1]
        best = np.maximum(best, inside.max(axis=1) - (m - RUN + 1 - RUN * (m // 5)))
    return best


def sharing(own: np.ndarray, own_group: np.ndarray, other: np.ndarray, other_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of _sharing."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *_sharing(own, own_group, other, other_group)])
    return both[:, 0], both[:, 1]


def _sharing(own: np.ndarray, own_group: np.ndarray, other: np.ndarray, other_group: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (number in ``own``, number in ``other``) of one group whose windows may share as many runs of RUN words in a part around the seed as a passage does; all of them, and hardly others.

    Runs that up to MANY windows of ``other`` hold are looked up. Those of more
    count in full at first; only where they alone would do in a part are they counted pair by pair.
    """
    key = lambda group, windows: (group.astype(np.int64)[:, None] << 24 | _runs(windows, RUN)).ravel()
    size = other.shape[1] - RUN + 1

    def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each run with the times that its window held it before, sorted, the numbers of the windows and the places in them: a run counts as often as both hold it."""
        at = np.flatnonzero(keys & 0xFFFFFF)
        bits = len(keys).bit_length()
        keys = np.sort(keys[at] << bits | at)  # sorts faster than an order of the keys
        at, keys = (keys & ((1 << bits) - 1)).astype(np.int32), keys >> bits
        window = at // size
        place = np.arange(len(keys), dtype=np.int32)
        times = place - np.maximum.accumulate(np.where(np.r_[True, (keys[1:] != keys[:-1]) | (window[1:] != window[:-1])][: len(keys)], place, 0))
        keys = keys << 8 | times
        again = np.flatnonzero(times)  # few; the others are sorted already
        again = again[np.argsort(keys[again], kind="stable")]
        once = np.flatnonzero(times == 0)
        order = np.insert(once, np.searchsorted(keys[once], keys[again]), again)
        return keys[order], window[order], at[order] % size

    keys, holder, _ = numbered(key(other_group, other))
    for lo in range(0, len(own), OPEN):
        mine = own[lo : lo + OPEN]
        wanted, asks, place = numbered(key(own_group[lo : lo + OPEN], mine))
        s, e = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        many = e - s > MANY
        hot = np.zeros((len(mine), size), bool)
        hot[asks[many], place[many]] = True
        lack = -_surplus(hot).astype(np.int64)
        n_hot = hot.sum(axis=1)
        n = np.where(many, 0, e - s)
        part = np.cumsum(np.bincount(asks, n, len(mine))).astype(np.int64) // STEP
        for k in np.unique(part).tolist():
            rare = np.flatnonzero((part[asks] == k) & (n > 0))
            upto = np.cumsum(n[rare])
            to = np.repeat(s[rare] - upto + n[rare], n[rare]) + np.arange(upto[-1] if len(upto) else 0)
            pairs, times = np.unique(np.repeat(asks[rare].astype(np.int64), n[rare]) * len(other) + holder[to], return_counts=True)
            i, to = pairs // len(other), pairs % len(other)
            enough = (times >= lack[i]) & (times + n_hot[i] >= LEAST_RUNS) & (lack[i] > 0)
            yield np.column_stack([lo + i[enough], to[enough]])
            full = np.flatnonzero((lack <= 0) & (part == k))
            for group in np.unique(own_group[lo + full]):
                of = np.flatnonzero(other_group == group)
                every = full[own_group[lo + full] == group]
                for r in range(0, len(every), max(1, STEP // len(of))):
                    rows = every[r : r + max(1, STEP // len(of))]
                    mark = np.full(len(mine), -1)
                    mark[rows] = np.arange(len(rows))
                    here = np.flatnonzero(many & (mark[asks] >= 0))
                    runs, column = np.unique(wanted[here], return_inverse=True)
                    x, y = np.searchsorted(keys, runs), np.searchsorted(keys, runs, "right")
                    counts = np.zeros((len(rows), len(of)), np.float32)
                    for c in range(0, len(runs), 256):  # some runs at a time
                        left, right = np.zeros((len(rows), 256), np.float32), np.zeros((256, len(of)), np.float32)
                        now = (column >= c) & (column < c + 256)
                        left[mark[asks[here[now]]], column[now] - c] = 1
                        for d, (u, v) in enumerate(zip(x[c : c + 256].tolist(), y[c : c + 256].tolist(), strict=True)):
                            right[d, np.searchsorted(of, holder[u:v])] = 1
                        counts += left @ right
                    add = np.flatnonzero(mark[i] >= 0)
                    counts[mark[i[add]], np.searchsorted(of, to[add])] += times[add]
                    a, b = np.nonzero(counts > LEAST_RUNS - 0.5)
                    yield np.column_stack([lo + rows[a], of[b]])


def rest_of(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, window: np.ndarray) -> Iterator[np.ndarray]:
    """Matches of the open seeds of a bucket (places below zero) with all documents before theirs whose words around may hold a passage.

    Occurrences with the same words around are one class: those after its first
    document repeat it in all these words, and those of its first document meet the first occurrence of each
    other class. All occurrences in a document count, whatever their number.
    """
    is_open = pos < 0
    pos = np.where(is_open, -1 - pos, pos)
    words = np.zeros(len(h), np.uint64)
    for k in range(0, len(h), 10 * OPEN):
        for column in np.ascontiguousarray(window[k : k + 10 * OPEN]).view(np.uint8).reshape(-1, SEED + 2 * AROUND).T:
            words[k : k + 10 * OPEN] = words[k : k + 10 * OPEN] * _P + column
    at = np.lexsort((is_open, pos, doc, h))
    new = np.r_[True, (h[at[1:]] != h[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])]
    start = np.flatnonzero(new)  # of each seed and document
    opened = np.maximum.reduceat(is_open[at], start)[np.cumsum(new) - 1]
    once = np.flatnonzero(np.r_[True, new[1:] | (pos[at[1:]] != pos[at[:-1]])])
    at, opened = at[once], opened[once]
    here = ~is_open[at]  # others repeat back to back, and have no words of their own
    at, opened = at[here], opened[here]
    if not len(at):
        return
    new_h = np.r_[True, h[at[1:]] != h[at[:-1]]]
    kept = np.maximum.reduceat(opened, np.flatnonzero(new_h))[np.cumsum(new_h) - 1]  # others are on the map by chance
    at, opened = at[kept], opened[kept]
    if not len(at):
        return
    order = np.lexsort((pos[at], doc[at], words[at], h[at]))
    at, is_open = at[order], opened[order]
    h, doc, pos, words = h[at], doc[at], pos[at], words[at]
    new = np.r_[True, (h[1:] != h[:-1]) | (words[1:] != words[:-1])]
    start = np.flatnonzero(new)
    by_doc = np.lexsort((doc[start], h[start]))  # classes of a seed in the order of their first documents
    rank = np.empty(len(start), np.int64)
    rank[by_doc] = np.arange(len(start))
    start, alike = start[by_doc], rank[np.cumsum(new) - 1]
    window = np.ascontiguousarray(window[at[start]]).view(np.uint8).reshape(len(start), -1)  # one of each class
    group = np.cumsum(np.r_[True, h[start[1:]] != h[start[:-1]]]) - 1
    is_first = doc == doc[start][alike]
    later = np.flatnonzero(is_open & ~is_first & ((window > 0).sum(axis=1) >= LEAST_WORDS)[alike])
    for m in range(0, len(later), OPEN):
        i = later[m : m + OPEN]
        yield _equal_runs(doc, pos, window, alike, i, start[alike[i]])
    items = np.flatnonzero(is_open & is_first)
    asks, first_item, n_items = np.unique(alike[items], return_index=True, return_counts=True)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    lo = 0
    while lo < len(start):
        k = int(np.searchsorted(ends, lo + HOLDERS, "right"))
        hi = int(ends[k - 1]) if k and ends[k - 1] > lo else lo + HOLDERS  # whole seeds, or a part of one
        hi = min(hi, len(start))
        q = np.arange(np.searchsorted(group[asks], group[lo]), np.searchsorted(group[asks], group[hi - 1], "right"))
        if group[lo] == group[hi - 1]:
            q = q[doc[start[asks[q]]] > doc[start[lo]]]
        pairs = (np.column_stack([q[both[:, 0]], lo + both[:, 1]]) for both in _sharing(window[asks[q]], group[asks[q]] - group[lo], window[lo:hi], group[lo:hi] - group[lo]))
        before = (both[doc[start[both[:, 1]]] < doc[start[asks[both[:, 0]]]]] for both in pairs)
        for both in _holding(before, window, asks):
            a, b = both[:, 0], both[:, 1]
            n = n_items[a]
            i, to = items[np.repeat(first_item[a] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(start[b], n)
            for m in range(0, len(i), OPEN):
                yield _equal_runs(doc, pos, window, alike, i[m : m + OPEN], to[m : m + OPEN])
        lo = hi


def _holding(pairs: Iterator[np.ndarray], window: np.ndarray, asks: np.ndarray) -> Iterator[np.ndarray]:
    """Those of the pairs (number in ``asks``, number of a window) whose windows may hold a passage, aligned OPEN at a time."""
    waiting: list[np.ndarray] = []
    for both in chain(pairs, [None]):
        for m in range(0, 0 if both is None else len(both), OPEN):
            some = both[m : m + OPEN]
            for run in (1, 2):
                some = some[_may_agree(window[asks[some[:, 0]]], window[some[:, 1]], run)]
            waiting.append(some)
        while waiting and ((n := sum(map(len, waiting))) >= OPEN or both is None and n):
            whole = np.concatenate(waiting)
            some, waiting = whole[:OPEN], [whole[OPEN:]]
            yield some[_may_hold(window[asks[some[:, 0]]], window[some[:, 1]])]


def _furthest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the first on of each row of ``a`` align with the row of ``b`` with 0 to PART_EDITS edits, at least those: waves of furthest cells, as in edit_distance, of all rows at once."""
    n, size = a.shape
    a, b = (np.pad(x, ((0, 0), (0, PART_EDITS + 2))).ravel() for x in (a, b))
    width, span = size + PART_EDITS + 2, 2 * PART_EDITS + 1
    words = (a.reshape(n, width) > 0).sum(axis=1).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32) * width, span)
    shift = np.tile(np.arange(-PART_EDITS, PART_EDITS + 1, dtype=np.int32), n)
    wave = np.full((n, span), -1000, np.int32)
    wave[:, PART_EDITS] = 0
    out = np.zeros((n, PART_EDITS + 1), np.int32)
    for e in range(PART_EDITS + 1):
        if e:
            last = wave
            wave = last + 1
            wave[:, 1:] = np.maximum(wave[:, 1:], last[:, :-1])
            wave[:, :-1] = np.maximum(wave[:, :-1], last[:, 1:] + 1)
            np.minimum(wave, words[:, None], out=wave)
        flat = wave.ravel()
        at = np.flatnonzero((flat >= 0) & (flat + shift >= 0) & (flat + shift < size))
        while len(at):
            i = flat[at]
            j = i + shift[at]
            own = a[row[at] + i]
            at = at[(own > 0) & (j < size) & (own == b[row[at] + np.minimum(j, size)])]
            flat[at] += 1
        out[:, e] = wave.max(axis=1)
    return out


def _may_agree(a: np.ndarray, b: np.ndarray, run: int) -> np.ndarray:
    """Whether a part of LEAST_WORDS words or more around the seed has as many runs of ``run`` words on the diagonals within PART_EDITS as one of which a fifth at most is edited; where not, _may_hold doesn't either.

    Of m words with m / 5 edits m - run + 1 - run * m / 5 runs are whole at least.
    """
    size = a.shape[1] - run + 1
    a, near = np.ascontiguousarray(a.T), np.zeros((a.shape[1] + 2 * PART_EDITS, len(a)), np.uint8)
    near[PART_EDITS:-PART_EDITS] = b.T
    met, same = np.zeros((size, a.shape[1]), bool), np.empty(a.shape, bool)
    for shift in range(2 * PART_EDITS + 1):
        np.equal(a, near[shift : shift + len(a)], out=same)
        met |= reduce(np.logical_and, [same[j : j + size] for j in range(run)])
    for j in range(run):
        met &= a[j : j + size] > 0
    total = np.zeros((size + 1, a.shape[1]), np.int16)  # five for a run that is met, less the fifths that must be
    np.cumsum(met.view(np.uint8) * np.int16(5) - np.int16(5 - run), axis=0, dtype=np.int16, out=total[1:])
    best = np.maximum.accumulate(total[::-1], axis=0)[::-1]  # of the ends from each place on
    start = np.arange(AROUND + 1)
    end = np.maximum(start + LEAST_WORDS, AROUND + SEED) - run + 1
    return (best[end] - total[: AROUND + 1]).max(axis=0) >= (1 - run) * run


def _may_hold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a part of LEAST_WORDS words or more around the seed agrees enough with the other window, aligned from the seed on either side."""
    left, right = _furthest(a[:, AROUND - 1 :: -1], b[:, AROUND - 1 :: -1]), _furthest(a[:, AROUND + SEED :], b[:, AROUND + SEED :])
    out = np.zeros(len(a), bool)
    for e in range(PART_EDITS + 1):
        size = SEED + left[:, e, None] + right
        out |= ((size >= LEAST_WORDS) & (size >= 5 * (e + np.arange(PART_EDITS + 1)))).any(axis=1)
    return out


def _equal_runs(doc: np.ndarray, pos: np.ndarray, window: np.ndarray, alike: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Matches of the pairs of occurrences, by their windows (one of each class), on the diagonals that a passage's edits allow: ends of equal words and
    every SEED-th run of SEED words in them, each with the run nearest to the seed's own diagonal."""

    def by_diagonal() -> Iterator[tuple[int, int, np.ndarray]]:
        a, b = _runs(window[alike[i]], SEED), _runs(window[alike[j]], SEED)
        size = a.shape[1]
        for shift in sorted(range(-PART_EDITS, PART_EDITS + 1), key=abs):
            s, e = max(0, -shift), min(size, size - shift)
            yield s, shift, (a[:, s:e] == b[:, s + shift : e + shift]) & (a[:, s:e] > 0)

    met = np.zeros((len(i), window.shape[1]), bool)
    out = [np.zeros((0, 4), np.int64)]
    for s, shift, same in by_diagonal():
        pair, at = np.divmod(np.flatnonzero(same), max(1, same.shape[1]))
        is_new = ~met[pair, at + s]
        pair, at = pair[is_new], at[is_new]
        met[pair, at + s] = True
        place = pos[i[pair]] + at + s - AROUND
        if len(pair):  # of runs side by side the first, the last and every SEED-th
            end = np.r_[True, (pair[1:] != pair[:-1]) | (at[1:] != at[:-1] + 1)]
            kept = end | np.r_[end[1:], True] | (place % SEED == 0)
            pair, place = pair[kept], place[kept]
        out.append(np.column_stack([doc[i[pair]], doc[j[pair]], place, place - pos[i[pair]] + pos[j[pair]] + shift]))
    return np.concatenate(out)


def _distinct(rows: np.ndarray) -> np.ndarray:
    place = rows[:, 2] << 32 | rows[:, 3]
    order = np.lexsort((place, rows[:, 1], rows[:, 0]))
    rows, place = rows[order], place[order]
    return rows[np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (place[1:] != place[:-1])]]


def _pack_rest(buckets: int):
    """Matches of the open seeds, packed by the document's bucket."""

    def pack_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for _, columns in _unpacked(batches, _WINDOW_TYPES):
            matches = rest_of(*columns)
            columns.clear()
            for found in matches:
                held.append(found)
                count += len(found)
                if count > PACK // 4:
                    yield _packed_matches([_distinct(np.concatenate(held))], buckets)
                    held, count = [], 0
        if count:
            yield _packed_matches([_distinct(np.concatenate(held))], buckets)

    return pack_rest


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each document that touch or overlap as one; rows come sorted by document."""
    for b in _by_document(batches):
        out: list[tuple] = []
        for doc, own in groupby(b.to_pylist(), key=lambda r: r["doc_id"]):
            pieces = [(r["first_word"], r["end_word"], r["source_doc_id"], r["source_first_word"], r["source_end_word"], round((1 - r["identity"]) * (r["end_word"] - r["first_word"]))) for r in own]
            out += [(doc, source, first, end, s_first, s_end, identity) for first, end, source, s_first, s_end, identity in passages(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), b.schema, strict=True)], schema=b.schema)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a document ends."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        ids = b.column("doc_id").to_numpy()
        end = int(np.searchsorted(ids, ids[-1]))
        if end:
            yield b.slice(0, end)
        rest = b.slice(end)
    if rest is not None:
        yield rest


_LINKED = "doc long, chain int, of long, parts array<int>, first int, end int, late binary"
_FOUND = "doc_id long, source_doc_id long, first_word int, end_word int, source_first_word int, source_end_word int, identity double"


def _aligned(base: DataFrame, linked: DataFrame, n: int) -> DataFrame:
    """Passages of the chains."""
    asked = linked.select("doc", "chain", "of", F.explode(F.sequence(F.expr(f"first div {BLOCK}").cast("int"), F.expr(f"end div {BLOCK}").cast("int"))).alias("block"))
    codes = base.mapInArrow(_code_rows, "doc long, block int, codes binary").withColumnRenamed("doc", "of")
    got = asked.join(codes, ["of", "block"]).select("doc", "chain", "block", F.lit(None).cast("long").alias("source"), F.lit(None).cast("array<int>").alias("parts"), "codes")
    heads = linked.select("doc", "chain", F.lit(-1).alias("block"), F.col("of").alias("source"), "parts", F.lit(None).cast("binary").alias("codes"))
    rows = heads.union(got).repartition(n, "doc").sortWithinPartitions("doc", "chain", "block")
    return rows.mapInArrow(_passage_rows, _FOUND)


def _map_of(places: list[bytes]) -> bytes:
    """A bit for each place (the map's size is a power of two); more places than bits answer in vain only."""
    place = np.frombuffer(b"".join(places), np.uint32)
    size = min(MOST_BITS, 1 << max(10, (MAP_BITS * len(place)).bit_length()))
    bits = np.zeros(size // 8, np.uint8)
    place = place & np.uint32(size - 1)
    np.bitwise_or.at(bits, place >> np.uint32(3), (np.uint32(1) << (place & np.uint32(7))).astype(np.uint8))
    return bits.tobytes()


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of LEAST_WORDS words or more that repeat, LEAST_IDENTITY of their words or more agreeing, from a document of smaller doc_id.

    Returns doc_id, source_doc_id, first_word, end_word (words are runs without
    ASCII white space, from 0, the end excluded), source_first_word,
    source_end_word, identity. Passages within one document alone don't count, nor
    do rows that repeat a doc_id among themselves; null or empty texts and rows of
    null doc_id have no passages; without repeats, or of an empty table, there are
    no rows; other columns aren't read.
    """
    spark = prepare(docs.sparkSession)
    n = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    buckets = max(BUCKETS, 4 * n)
    dealt = lambda packed: packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    seeded = dealt(base.mapInArrow(_pack_seeds(buckets), "bucket int, packed binary"))
    matches = dealt(seeded.mapInArrow(_pack_matches(buckets), "bucket int, packed binary"))
    linked = cut(matches.mapInArrow(_chain_rows, _LINKED))
    found = cut(_aligned(base, linked.filter("chain >= 0"), n))
    spans = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    late = linked.filter("chain < 0").select("doc", "late").join(spans, "doc", "left")
    left = cut(dealt(late.mapInArrow(_open_seeds, "bucket int, packed binary")))
    places = [bytes(r["places"]) for r in left.sortWithinPartitions("bucket").mapInArrow(_open_places, "places binary").collect()]
    if not places:
        return found
    shared = spark.sparkContext.broadcast(_map_of(places))
    windows = base.mapInArrow(_pack_windows(buckets, shared), "bucket int, packed binary")
    rest = dealt(dealt(windows.union(left)).mapInArrow(_pack_rest(buckets), "bucket int, packed binary"))
    more = _aligned(base, cut(rest.mapInArrow(_chain_rows, _LINKED)), n)
    return found.union(more).repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_joined_rows, _FOUND)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (sorted, apart), each with the white space after it."""
    raw = text.encode(errors="replace")
    buf = _FOLD[np.frombuffer(b" " + raw, np.uint8)]
    inside = buf != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    out, at = [], 0
    for first, end in spans:
        s = int(starts[first])
        out.append(raw[at:s])
        at = int(starts[end]) if end < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """Delete repeated passages from the texts; documents of which no word is left go. All columns stay; n_chars follows the text.

    Rows that repeat a doc_id are cut alike where their texts reach as far.
    """
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("__spans")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans["__id"], "left").drop("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("__spans").to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            b = b.drop_columns(["__spans"])
            if hit:
                texts, keep = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
                sizes = b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
                for i in hit:
                    words = len(texts[i].encode(errors="replace").split())
                    texts[i] = cut_words(texts[i], [(s["first_word"], s["end_word"]) for s in spans[i] if s["first_word"] < words])
                    keep[i] = bool(texts[i].encode(errors="replace").split())
                    if sizes:
                        sizes[i] = len(texts[i])
                b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
                if sizes:
                    b = b.set_column(b.schema.get_field_index("n_chars"), b.schema.field("n_chars"), pa.array(sizes, b.schema.field("n_chars").type))
                b = b.filter(pa.array(keep))
            yield b

    return joined.mapInArrow(run, docs.schema)
