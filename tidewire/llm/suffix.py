"""Removal of byte strings that an earlier document has, by column-wise construction of a collection's Burrows-Wheeler transform.

1. Every 50-byte window is filed under an anchor, the least hash among its ``gram``-byte grams: equal windows have equal anchors
   with equal places in them. Anchors that occur once in the corpus are dropped (``repeats``); so are, but for the
   one with the smallest id, documents whose whole text is the same.
2. What is left are fragments of up to 80 bytes around anchors that occur again, dealt by anchor. Within a chunk a fragment is
   sent once, for the smallest id that has it. Windows of an anchor that occurs very often go one by one, dealt by their own hash, so
   that no anchor makes a bucket large.
3. Fragments with the same bytes are one document of the bucket's collection; one whose anchor has no other document needs no
   comparison. Of the others the transform is built column by column (``suffix_classes``): each round inserts one symbol of every
   document, in two sequential reads of the files of the round before and one sequential write, and updates the common
   prefixes of neighbours. Neighbours with 50 symbols or more in common are equal windows; the smallest id of their
   documents settles which of them are copies.

The files are in the shared folder and each is deleted after the next is written; a lost executor's last one stays in the folder
``suffix-...`` there. In memory a collection holds a few numbers a document and, at the end, one number a symbol; collections
are cut between anchors at ``PORTION`` symbols.

Defined results: null text is empty; rows with a null id take part as if their id were larger than all; rows with equal ids are
not earlier than one another; repeated rows each come back; empty tables give empty results; other columns are left alone. Text is
UTF-8, so no symbol is 0xFF, which stands for the end of a document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import repeats
from tidewire.llm.chunks import chunked, each, joined, ranges
from tidewire.llm.common import BYTE_BASE, CHUNK_BYTES, U, byte_sums, filesystem, mix, powers, slices, string_buffers, string_hash
from tidewire.session import checkpoint_dir

LENGTH, GRAM, TOKEN_BYTES = 50, 20, 5
PORTION, BLOCK = 1 << 22, 1 << 18
LAST = (1 << 63) - 1
END = 0xFF
ALONE_FLAG = 0x80
FRAGMENTS = "bucket int, chunk long, bytes binary, ids binary, windows binary, anchors binary, info binary"
SETTLED = "chunk long, bucket int, owner binary, first binary, count binary, info binary"
OUT = "doc_id long, text string, spans binary"


class Anchors:
    """Anchors of a run of texts and, for each, the windows filed under it: text, first byte in the text, number, place of the anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        n = len(data)
        if n < length:
            self.token = np.empty(0, U)
            self.text = self.first = self.windows = self.place = np.empty(0, np.int64)
            return
        sums = byte_sums(data)
        grams = mix((sums[gram:] - sums[:-gram]) * powers(BYTE_BASE, n + 1, True)[: n - gram + 1])
        place = repeats.window_minima(grams, length - gram + 1)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.arange(n - length + 1)
        at = at[at + length <= offsets[1:][text[at]]]
        begin, last = repeats.anchored(place[at], at, text[at])
        first = at[begin]
        self.token = grams[place[first]]
        self.text, self.windows, self.place = text[first], at[last] - first + 1, place[first] - first
        self.first = first - offsets[:-1][self.text]


def _tokens(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows in each(b):
                token = Anchors(*string_buffers(rows.column(1)), length, gram).token
                yield repeats.Dealt(token, None, buckets).rows(chunk, TOKEN_BYTES)

    return run


def _order_ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole texts of a chunk, each once with its smallest id."""
        for b in batches:
            for chunk, rows in each(b):
                data, offsets = string_buffers(rows.column(1))
                least: dict[bytes, int] = {}
                for i, x, y in zip(_order_ids(rows).tolist(), offsets[:-1], offsets[1:], strict=True):
                    if y - x >= length:
                        sig = hashlib.blake2b(data[x:y], digest_size=16).digest()
                        least[sig] = min(i, least.get(sig, LAST))
                yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array([chunk] * len(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["sig", "chunk", "least"])

    return run


def _whole(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int, told: pa.Table) -> np.ndarray:
    """Which documents of a chunk have a whole text that an earlier document has as well."""
    ids, sig = _order_ids(rows), [hashlib.blake2b(data[x:y], digest_size=16).digest() if y - x >= length else b"" for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
    least = dict(zip(told.column("sig").to_pylist(), told.column("least").to_pylist(), strict=True))
    for i, s in zip(ids.tolist(), sig, strict=True):
        if s:
            least[s] = min(i, least.get(s, LAST))
    return np.array([s != b"" and least[s] < i for i, s in zip(ids.tolist(), sig, strict=True)], bool)


def _fragments(length: int, gram: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "bytes", "ids", "windows", "anchors", "info")}
        for chunk, rows in each(left):
            data, offsets = string_buffers(rows.column(1))
            a = Anchors(data, offsets, length, gram)
            told = right.filter(pa.compute.is_valid(right.column("sig")))
            whole = _whole(rows, data, offsets, length, told)
            state = repeats.Dealt(a.token, None, buckets).states(right.filter(pa.compute.is_valid(right.column("states"))))
            pick = np.flatnonzero((state > repeats.ALONE) & ~whole[a.text]) if len(a.token) else np.empty(0, np.int64)
            times = np.where(state[pick] == repeats.OFTEN, a.windows[pick], 1)
            owner = np.repeat(pick, times)
            shift = ranges(np.zeros(len(pick), np.int64), times)
            often = np.repeat(state[pick] == repeats.OFTEN, times)
            text, first = a.text[owner], a.first[owner] + shift
            windows = np.where(often, 1, a.windows[owner])
            place = np.where(often, ALONE_FLAG, a.place[owner]).astype(np.uint8)
            start, size = offsets[:-1][text] + first, windows + length - 1
            content = string_hash(byte_sums(data), start, start + size)
            key = np.where(often, content, a.token[owner])
            ident = _order_ids(rows)[text]
            order = np.lexsort((ident, content, key))
            head = np.concatenate(([True], (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])))[: len(order)]
            leader = order[head]
            lead = np.empty(len(order), np.int64)
            lead[order] = leader[np.cumsum(head) - 1] if len(order) else leader
            late = np.flatnonzero(ident > ident[lead])  # copies of what this chunk has for a smaller id
            bucket = (key[leader] % U(buckets)).astype(np.int64)
            sent = leader[np.lexsort((leader, bucket))]
            bounds = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            number = np.zeros(len(order), np.int64)
            number[sent] = np.arange(len(sent))
            same = np.flatnonzero((ident == ident[lead]) & (lead != np.arange(len(lead))))  # what is told about the leader holds for these
            for k in np.flatnonzero(np.diff(bounds)):
                own = sent[bounds[k] : bounds[k + 1]]
                for c, v in zip(out, (k, chunk, repeats.press(data[ranges(start[own], size[own])].tobytes(), 3), repeats.press_numbers(ident[own]), repeats.press(windows[own].astype(np.uint8).tobytes()), repeats.press(place[own].tobytes()), None), strict=True):
                    out[c].append(v)
            info = [text[sent], first[sent], bounds, text[late], first[late], windows[late], text[same], first[same], number[lead[same]], np.flatnonzero(whole)]
            packed = [repeats.press_numbers(x) for x in info]
            blob = b"".join(len(x).to_bytes(8, "little") + x for x in packed)
            for c, v in zip(out, (chunk % buckets, chunk, None, None, None, None, blob), strict=True):
                out[c].append(v)
        kinds = {"bucket": pa.int32(), "chunk": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return run


# --------------------------------------------------------------------------- the transform


class Columns:
    """The transform and the common prefixes of a round, block after block in one file that is written and read front to back."""

    def __init__(self, base: str):
        self.fs, root = filesystem(base)
        self.path, self.sizes, self.held = f"{root}/{uuid.uuid4().hex}", [], (np.empty(0, np.uint8),) * 2
        self.out = self.fs.open_output_stream(self.path, compression=None)

    def write(self, symbols: np.ndarray, common: np.ndarray) -> None:
        symbols, common = np.concatenate((self.held[0], symbols)), np.concatenate((self.held[1], common))
        full = len(symbols) // BLOCK * BLOCK
        for lo in range(0, full, BLOCK):
            self._put(symbols[lo : lo + BLOCK], common[lo : lo + BLOCK])
        self.held = symbols[full:], common[full:]

    def _put(self, symbols: np.ndarray, common: np.ndarray) -> None:
        self.sizes.append(len(symbols))
        self.out.write(symbols.tobytes() + common.tobytes())

    def finish(self) -> "Columns":
        if len(self.held[0]):
            self._put(*self.held)
        self.out.close()
        return self

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first entry, symbols, common prefixes) of each block."""
        at = 0
        with self.fs.open_input_stream(self.path, compression=None) as f:
            for n in self.sizes:
                raw = np.frombuffer(f.read(2 * n), np.uint8)
                yield at, raw[:n], raw[n:]
                at += n

    def delete(self) -> None:
        self.out.close()
        self.fs.delete_file(self.path)


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a + 1 .. b]) of each pair a < b, from minima over runs of 1, 2, 4, ... values."""
    if not len(a):
        return values[b]
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    n, most = len(values), int(level.max())
    runs = np.empty((most + 1, n), np.uint8)
    runs[0] = values
    for k in range(most):
        np.minimum(runs[k, : n - (1 << k)], runs[k, 1 << k :], out=runs[k + 1, : n - (1 << k)])
    flat, row = runs.ravel(), level * n
    return np.minimum(flat[row + a + 1], flat[row + b + 1 - (1 << level)])


def _scan(columns: Columns, place: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One read of a round's columns: where the suffixes with one symbol more go, and the prefixes that they have in common with their
    neighbours. ``place`` are the ascending places of the symbols to insert, ``base`` is where each symbol's suffixes begin.

    Returns new place and common prefix of each, then places and common prefixes of the suffixes after them that were there before.
    """
    seen = np.zeros(256, np.int64)
    run = np.zeros(256, np.uint8)  # least common prefix since the last place with the symbol
    waiting = np.zeros(256, bool)  # the last place with the symbol is inserted, what follows it is not yet known
    new_at, new_common, old_at, old_common = [], [], [], []
    for lo, symbols, common in columns.blocks():
        n = len(symbols)
        mine = place[slice(*np.searchsorted(place, (lo, lo + n)))] - lo
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=256)
        starts = np.cumsum(counts) - counts
        flag = np.zeros(n, bool)
        flag[mine] = True
        flag = flag[order]
        here = np.flatnonzero(counts)
        edge = starts[here]
        follows = np.zeros(n, bool)
        follows[1:] = flag[:-1]
        follows[edge] = waiting[here]
        follows &= ~flag
        wanted = np.flatnonzero(flag | follows)
        symbol = symbols[order[wanted]]
        at = order[wanted]
        is_first = wanted == starts[symbol]
        before = np.where(is_first, -1, order[wanted - 1])
        least = least_between(common, before, at)
        least = np.where(is_first, np.minimum(least, run[symbol]), least)
        rank = seen[symbol] + wanted - starts[symbol]
        value = np.where(rank == 0, 0, least.astype(np.int64) + 1)
        is_new = flag[wanted]
        goes = base[symbol] + rank
        new_at.append((at[is_new] + lo, goes[is_new], value[is_new]))
        old_at.append(goes[~is_new])
        old_common.append(value[~is_new])
        last = order[starts[here] + counts[here] - 1]
        tail = np.full(len(here), 0xFF, np.uint8)
        inside = last < n - 1
        tail[inside] = least_between(common, last[inside], np.full(inside.sum(), n - 1))
        run = np.minimum(run, common.min()) if n else run
        run[here] = tail
        waiting[here] = flag[starts[here] + counts[here] - 1]
        seen += counts
    source, goes, value = (np.concatenate(x) for x in zip(*new_at, strict=True))
    back = np.argsort(source)
    new_common = value[back]
    return goes[back], new_common, np.concatenate(old_at), np.concatenate(old_common)


def _insert(columns: Columns, base: str, at: np.ndarray, symbol: np.ndarray, common: np.ndarray, old_at: np.ndarray, old_common: np.ndarray) -> Columns:
    """The columns of the next round: what is inserted at the ascending places ``at``, and the prefixes changed by it."""
    out = Columns(base)
    cut = at - np.arange(len(at))  # entries of the round before that come first
    total = sum(columns.sizes)
    order = np.argsort(old_at)
    old_at, old_common = old_at[order], old_common[order]
    for lo, symbols, prefixes in columns.blocks():
        hi = lo + len(symbols)
        a, b = np.searchsorted(cut, (lo, hi if hi < total else hi + 1))
        full = np.ones(hi - lo + b - a, bool)
        full[at[a:b] - (lo + a)] = False
        s, c = np.empty(len(full), np.uint8), np.empty(len(full), np.uint8)
        s[full], c[full] = symbols, prefixes
        s[~full], c[~full] = symbol[a:b], common[a:b]
        x, y = np.searchsorted(old_at, (lo + a, hi + b))
        c[old_at[x:y] - (lo + a)] = old_common[x:y]
        out.write(s, c)
    return out.finish()


def suffix_classes(text: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, base: str) -> np.ndarray:
    """A class for each window text[start + i : start + i + length] of each document text[start : start + size], document after document;
    equal windows have equal classes.

    Round j puts the suffixes of j symbols among the shorter ones: the symbol before a suffix and its rank in the transform so far
    tell where the longer suffix goes, and the least common prefix since the last place with that symbol, plus one, is the
    prefix in common with the suffix before it.
    """
    m = len(start)
    place, active = np.arange(m), np.arange(m)
    symbol = text[start + size - 1]
    counts = np.bincount(symbol, minlength=256)
    columns = Columns(base)
    try:
        columns.write(symbol, np.zeros(m, np.uint8))
        columns.finish()
        for j in range(1, int(size.max()) + 1):
            first_of = m + np.cumsum(counts) - counts
            goes, common, old_at, old_common = _scan(columns, place, first_of)
            order = np.argsort(goes)
            active, place = active[order], goes[order]
            more = size[active] > j
            symbol = np.full(len(active), END, np.uint8)
            symbol[more] = text[start[active[more]] + size[active[more]] - j - 1]
            following = _insert(columns, base, place, symbol, common[order], old_at, old_common)
            columns.delete()
            columns = following
            counts += np.bincount(symbol[more], minlength=256)
            active, place = active[more], place[more]
        parts = [(s.copy(), c < length) for _, s, c in columns.blocks()]
    finally:
        columns.delete()
    transform = np.concatenate([s for s, _ in parts])
    group = np.cumsum(np.concatenate([x for _, x in parts]), dtype=np.int32)
    order = np.argsort(transform, kind="stable")
    order = order[: len(order) - m]  # without the ends
    longer = np.zeros(len(transform), np.int32)  # place of the suffix with the symbol before it
    longer[order] = m + np.arange(len(order))
    windows = size - length + 1
    base_of = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    at, doc = np.arange(m), np.arange(m)
    for j in range(1, int(size.max()) + 1):
        at = longer[at]
        if j >= length:
            out[base_of[doc] + size[doc] - j] = group[at]
        go = size[doc] > j
        at, doc = at[go], doc[go]
    return out


def _portions(size: np.ndarray, joint: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of places whose sizes sum up to about ``most``; a place where ``joint`` is true stays with the one before it."""
    n = len(size)
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // most)) + 1
    free = np.append(np.flatnonzero(~joint), n)
    edges = np.unique(np.concatenate(([0], free[np.searchsorted(free, cuts)], [n])))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _sent(text: bytes, ids: bytes, windows: bytes, places: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the fragments that a chunk sent: their bytes, ids, numbers of windows, hashes, and hashes of their anchors."""
    data = np.frombuffer(repeats.unpress(text), np.uint8)
    count = np.frombuffer(repeats.unpress(windows), np.uint8).astype(np.int64)
    place = np.frombuffer(repeats.unpress(places), np.uint8)
    size = count + length - 1
    start = np.cumsum(size) - size
    sums = byte_sums(data)
    content = string_hash(sums, start, start + size)
    at = start + np.where(place == ALONE_FLAG, 0, place)
    return data, repeats.unpress_numbers(ids), count, content, np.where(place == ALONE_FLAG, content, string_hash(sums, at, at + gram))


def _settler(length: int, gram: int, base: str, portion: int):
    def settle(rows: pa.Table) -> pa.Table:
        """Runs of windows of each chunk's fragments that an earlier document has."""
        info = rows.filter(pa.compute.is_valid(rows.column("info")))
        out = {"chunk": info.column("chunk").to_pylist(), "bucket": [None] * len(info), "owner": [None] * len(info), "first": [None] * len(info), "count": [None] * len(info), "info": info.column("info").to_pylist()}
        rows = rows.filter(pa.compute.is_valid(rows.column("bytes")))
        if len(rows):
            parts = [_sent(*row, length, gram) for row in zip(*(rows.column(c).to_pylist() for c in ("bytes", "ids", "windows", "anchors")), strict=True)]
            row = np.repeat(np.arange(len(rows)), [len(p[1]) for p in parts])
            text, ident, windows, content, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            size = windows + length - 1
            start = np.cumsum(size) - size
            order = np.lexsort((ident, content, key))
            new = np.concatenate(([True], (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])))
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(new) - 1
            head = order[new]  # one fragment a content, with the smallest id
            anchor = key[head]
            several = np.zeros(len(head), bool)  # contents whose anchor has others
            same = anchor[1:] == anchor[:-1]
            several[1:] |= same
            several[:-1] |= same
            count = windows[head]
            begin = np.cumsum(count) - count  # windows of all contents, one after the other
            first_id = np.repeat(ident[head], count)
            pick = np.flatnonzero(several)
            joint = np.zeros(len(pick), bool)
            joint[1:] = anchor[pick][1:] == anchor[pick][:-1]
            for lo, hi in _portions(size[head[pick]], joint, portion) if len(pick) else []:
                some = pick[lo:hi]
                own = ranges(begin[some], count[some])
                group = suffix_classes(text, start[head[some]], size[head[some]], length, base)
                least = np.full(group.max() + 1, LAST, np.int64)
                np.minimum.at(least, group, first_id[own])
                first_id[own] = least[group]
            # each fragment against the smallest ids of its content's windows
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            for k, (chunk, bucket) in enumerate(zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), strict=True)):
                mine = slice(bounds[k], bounds[k + 1])
                w = windows[mine]
                inside = ranges(np.zeros(len(w), np.int64), w)
                copied = first_id[ranges(begin[kind[mine]], w)] < np.repeat(ident[mine], w)
                enter = np.flatnonzero(copied & ~(np.concatenate(([False], copied[:-1])) & (inside > 0)))
                stop = np.flatnonzero(copied & ~np.concatenate((copied[1:] & (inside[1:] > 0), [False])))
                if len(enter):
                    owner = np.repeat(np.arange(len(w)), w)[enter]
                    for c, v in zip(out, (chunk, bucket, repeats.press_numbers(owner), repeats.press(inside[enter].astype(np.uint8).tobytes()), repeats.press((stop - enter + 1).astype(np.uint8).tobytes()), None), strict=True):
                        out[c].append(v)
        kinds = {"bucket": pa.int32(), "chunk": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return settle


def _gatherer(length: int):
    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for _, rows in each(left):
            blob, info = joined(right.column("info")), []
            while blob:
                n = int.from_bytes(blob[:8], "little")
                info.append(repeats.unpress_numbers(blob[8 : 8 + n]))
                blob = blob[8 + n :]
            sent_text, sent_first, bounds, late_text, late_first, late_windows, same_text, same_first, same_lead, whole = info
            told = right.filter(pa.compute.is_valid(right.column("owner")))
            runs = [(np.empty(0, np.int64),) * 3]
            for bucket, owner, first, count in zip(*(told.column(c).to_pylist() for c in ("bucket", "owner", "first", "count")), strict=True):
                runs.append((bounds[bucket] + repeats.unpress_numbers(owner), np.frombuffer(repeats.unpress(first), np.uint8).astype(np.int64), np.frombuffer(repeats.unpress(count), np.uint8).astype(np.int64)))
            owner, first, count = (np.concatenate(x) for x in zip(*runs, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, first, count = owner[order], first[order], count[order]
            a, b = np.searchsorted(owner, same_lead), np.searchsorted(owner, same_lead, "right")
            again = ranges(a, b - a)
            text = np.concatenate((sent_text[owner], late_text, np.repeat(same_text, b - a)))
            begin = np.concatenate((sent_first[owner] + first, late_first, np.repeat(same_first, b - a) + first[again]))
            windows = np.concatenate((count, late_windows, count[again]))
            size = np.diff(string_buffers(rows.column(1))[1])
            text, begin, end = np.append(text, whole), np.append(begin, np.zeros(len(whole), np.int64)), np.append(begin + windows + length - 1, size[whole])
            base = np.cumsum(size + 1) - size - 1  # a place between texts, so that ranges of two don't touch
            x, y = repeats.merged(base[text] + begin, base[text] + end)
            doc = np.searchsorted(base, x, "right") - 1
            pairs = np.stack((x - base[doc], y - base[doc]), 1).astype("<i8")
            spans = [s or None for s in slices(pairs, np.searchsorted(doc, np.arange(len(size) + 1)))]
            parts.append(pa.table({"doc_id": rows.column(0), "text": rows.column(1).fill_null(""), "spans": pa.array(spans, pa.binary())}))
        return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "spans": pa.array([], pa.binary())})

    return gather


def copied_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, portion: int = PORTION, often: int = repeats.HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text and spans (pairs of byte offsets, null: none) of what an earlier document has."""
    spark = documents.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/suffix-{uuid.uuid4().hex}"
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)
    buckets = repeats.buckets_of(documents)
    texts = chunked(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), most=chunk_bytes)
    states = repeats.answered(texts.mapInArrow(_tokens(length, gram, buckets), repeats.PACKED), TOKEN_BYTES, often)
    whole = texts.mapInArrow(_digests(length), "sig binary, chunk long, least long")
    least = whole.groupBy("sig").agg(F.min("least").alias("least"), F.count("*").alias("n")).filter("n > 1").select("sig", "least")
    told = whole.select("sig", "chunk").join(least, "sig").select("chunk", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("states"), "sig", "least")
    told = told.unionByName(states.select("chunk", "bucket", "states", F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("long").alias("least")))
    dealt = texts.groupBy("chunk")  # the shuffle of the texts serves both joins
    fragments = dealt.cogroup(told.groupBy("chunk")).applyInArrow(_fragments(length, gram, buckets), FRAGMENTS)
    settled = fragments.groupBy("bucket").applyInArrow(_settler(length, gram, base, portion), SETTLED)
    return dealt.cogroup(settled.groupBy("chunk")).applyInArrow(_gatherer(length), OUT)


def without(raw: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    if not spans:
        return raw, 0
    out, at, pairs = [], 0, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    for a, b in pairs:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), len(pairs)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                kept, n = without(raw, spans)
                out.append((i, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return copied_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
w AS (SELECT doc_id, k, raw[k + 1:k + 50] AS s FROM (SELECT doc_id, raw, unnest(range(0, octet_length(raw) - 49)) AS k FROM d)),
c AS (SELECT doc_id, k FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
g AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g),
s AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM r GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM s GROUP BY doc_id),
x AS (SELECT d.doc_id, raw, list_prepend(0, coalesce(tos, [])) AS starts, list_append(coalesce(froms, []), octet_length(raw)) AS ends FROM d LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(octet_length(raw) - list_sum([ends[i] - starts[i] FOR i IN range(1, len(starts) + 1)]) AS BIGINT) AS n_removed,
  CAST(len(starts) - 1 AS BIGINT) AS n_spans, sha256(unhex(array_to_string([hex(raw[starts[i] + 1:ends[i]]) FOR i IN range(1, len(starts) + 1)], ''))) AS kept_sha256 FROM x
"""
