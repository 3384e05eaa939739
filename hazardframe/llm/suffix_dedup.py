"""Operator 2, removal of long repeated byte strings by bucket-pointer refinement.

A byte goes if a LENGTH-byte string that covers it also starts earlier: in a document of smaller id, or in the same
document. The suffixes that matter are sorted to a depth of LENGTH bytes, in buckets:

``refine`` is the core. Positions are first bucketed by the GRAM bytes at them. Then, with buckets of depth d known for all positions,
those of depth 2d are ranks of the pairs (bucket at i, bucket at i + d): the pointer to a later offset stands for the d bytes there.
Each round reuses the ranks that the last one wrote, and only positions in buckets of more than one member are sorted again.
After the last round positions of one bucket start equal strings; all but the earliest are repeats. Inside ``refine`` buckets are ranks of
bytes, not hashes.

Spark deals the positions so that equal strings meet:
0. Whole stretches of copies are settled before the refinement, by a 128-bit digest: texts are cut into stretches of about CUT anchors at
   places that the content sets; a stretch (with the LENGTH - 1 bytes behind it) that also starts earlier has none but repeated windows. So of
   exact and near copies only the first, and the stretches around edits, are refined. This step stands in for the refinement of these windows
   (README: their share). The earliest window of a content is never settled that way, and others that aren't meet it in 2 or 3.
1. Each LENGTH-byte window belongs to the bucket of its anchor, the SEED bytes in it with the least hash (a function of the window
   alone); neighbouring windows mostly share it, so a document has one anchor per ~40 bytes. A window holds the SIDE bytes on the left of its anchor
   or, if not, those on its right: its key is the hash of the anchor with that side. Tasks ship the distinct keys of each block of
   BLOCK documents by hash range, each with a tag of its stretch; a range keeps those found in two blocks and in two different stretches
   (equal ones are copies, of which all but one are settled) and sends them back.
2. Blocks meet their texts and those answers. Windows whose key was not kept have no equal in other blocks. Those whose key the block itself has twice are
   refined inside it; repeats found there are settled, and only the first window of each content goes on.
3. What goes on travels by key, as bytes with the windows that share it, and is refined there against other blocks. Keys found in more than
   HOT blocks travel window by window, dealt by the window's own hash, as their windows differ around the common part.
4. Documents with windows that went on get the answers, in blocks, and are cut. Tables that no later step reads are removed.

``docs`` must be a stored table (it is read three times and must give its rows in the same order). Defined results: null text is empty; texts
shorter than LENGTH bytes lose nothing; null ids come first; of rows with one id the earlier stored comes first; an empty table gives an
empty result; other columns are ignored; texts of any length are anchored in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import bounded_batches, documents, drop_spool, spool

LENGTH = 100
GRAM = 4
SEED = 24
SIDE = 38  # half of what a window holds beside its anchor
BLOCK = 8  # bits: documents of a block
HOT = 64
CUT = 8
RANGE_HASHES = 1 << 21
PART_BYTES = 1 << 17  # the tables of one refinement stay in a core's cache
SEGMENT = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- refinement ---------------------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number (the last 7 positions have none)."""
    n = len(data) - 7
    out = np.empty(max(0, n), np.uint64)
    raw = data.tobytes()
    for s in range(min(8, max(0, n))):
        part = np.frombuffer(raw, "<u8", (len(data) - s) // 8, s)
        out[s::8] = part[:len(out[s::8])]
    return out


def _rank(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys below 2^bits, those that are not alone: their places, by key and then by place, and where in that order a new key begins.
    Where key and place fit into one 64-bit number these are sorted as plain numbers, else an order of places is sorted."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low = int(n - 1).bit_length()
    if bits + low <= 64:
        packed = np.sort((keys << np.uint64(low)) | np.arange(n, dtype=np.uint64))
        order, ranked = packed & np.uint64((1 << low) - 1), packed >> np.uint64(low)
    else:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:n])
    some = np.flatnonzero(~(new[:-1] & new[1:]))
    return order[some].astype(np.int64), new[some]


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which of the ascending starts have an equal ``length``-byte string at a smaller one of them. A depth is worked out only
    at the offsets behind a start that deeper buckets point to, and a pointer to a lone bucket makes a lone one."""
    again = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return again
    if length < gram:
        raise ValueError("length below the first bucket's depth")
    steps, depth = [], gram
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    asked = np.zeros(len(data) - gram + 1, bool)
    asked[starts] = True
    needed = [asked]  # the positions of each depth, the deepest last
    for step in reversed(steps):
        asked = asked.copy()
        asked[step:] |= needed[0][:-step]
        needed.insert(0, asked)
    live = np.flatnonzero(asked)
    words = _words(np.concatenate([data, np.zeros(8 - gram, np.uint8)]))
    order, new = _rank(words[live] & np.uint64((1 << 8 * gram) - 1), 8 * gram)
    bucket, shared = np.zeros(len(asked), np.uint64), np.zeros(len(asked), bool)
    for step, asked in zip(steps, needed[1:]):
        members = live[order]
        bucket[members] = np.cumsum(new)
        shared[:] = False
        shared[members] = True
        width = int(new.sum()).bit_length()
        live = np.flatnonzero(asked[:-step] & shared[:-step] & shared[step:])
        order, new = _rank((bucket[live] << np.uint64(width)) | bucket[live + step], 2 * width)
    shared[:] = False
    shared[live[order[~new]]] = True  # all but the earliest of a bucket
    return shared[starts]


# --- anchors ------------------------------------------------------------------------------------------------

def _anchors_of(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of windows with one anchor: the first window (a last entry: the number of windows), the anchor's hash and place."""
    x = _words(data)
    n = len(data) - seed + 1
    with np.errstate(over="ignore"):
        h = x[:n] * _A + x[8:8 + n] * _B + x[16:16 + n] * _C
        h = (h ^ (h >> np.uint64(29))) * _B
        h ^= h >> np.uint64(32)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    width, have = length - seed + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(place) + 1, bool)  # with the end
    np.not_equal(place[1:], place[:-1], out=new[1:-1])
    bounds = np.flatnonzero(new)
    at = place[bounds[:-1]]
    return bounds, h[at], at, x


def _side_hash(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place, from the 8-byte words of all positions."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, size - 8, 8), size - 8]:
            out = (out ^ x[at + k]) * _A
            out ^= out >> np.uint64(29)
        out *= _B
    return out ^ (out >> np.uint64(32))


def anchor_halves(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """``anchor_runs``, and its runs in halves: the windows that hold the bytes on the left of the anchor, and the others, which hold
    those on its right. First window, window count, key and run of each half."""
    side = (length - seed) // 2
    firsts, counts, hashes, half = [], [], [], [[], [], [], []]
    runs = 0
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        bounds, h, place, x = _anchors_of(data[s:s + SEGMENT + length - 1], length, seed)
        first, end = bounds[:-1], bounds[1:]
        middle = np.clip(place - side + 1, first, end)
        left, right = np.flatnonzero(middle > first), np.flatnonzero(end > middle)
        of = np.concatenate([left, right])
        order = np.argsort(of, kind="stable")  # left before right
        sides = _side_hash(x, np.concatenate([place[left] - side, place[right]]), seed + side)
        np.invert(sides[len(left):], out=sides[len(left):])
        parts = np.concatenate([first[left], middle[right]]) + s, np.concatenate([(middle - first)[left], (end - middle)[right]]), sides, of + runs
        for held, part in zip(half, parts):
            held.append(part[order])
        firsts.append(first + s)
        counts.append(np.diff(bounds))
        hashes.append(h)
        runs += len(first)
    if not firsts:
        none, empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, empty, none, none, empty, none
    return tuple(np.concatenate(c) for c in (firsts, counts, hashes, *half))


def anchor_runs(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window count and anchor hash of all runs of a text, segment by segment."""
    firsts, counts, hashes = [], [], []
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        bounds, h, _, _ = _anchors_of(data[s:s + SEGMENT + length - 1], length, seed)
        firsts.append(bounds[:-1] + s)
        counts.append(np.diff(bounds))
        hashes.append(h)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def _borders(first: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """First windows of a text's stretches, and the number of its windows; the runs' anchors set them."""
    cuts = first[np.flatnonzero((hashes[1:] >> np.uint64(40)) % np.uint64(CUT) == 0) + 1]
    return np.concatenate([[0], cuts, [first[-1] + count[-1]]])


def _stretches(length: int):
    """Rows (row, id, start, n, digest): stretches of n windows from start on, with the digest of their bytes."""
    def run(batches):
        for b in batches:
            rows, starts, counts, digests = [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                raw = text.encode()
                first, count, hashes = anchor_runs(np.frombuffer(raw, np.uint8), length)
                if not len(first):
                    continue
                bounds = _borders(first, count, hashes).tolist()
                for s, e in zip(bounds[:-1], bounds[1:]):
                    rows.append(k)
                    starts.append(s)
                    counts.append(e - s)
                    digests.append(hashlib.blake2b(raw[s:e + length - 1], digest_size=16).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())],
                                             ["row", "id", "start", "n", "digest"])
    return run


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


# --- step 1: keys that two blocks have ----------------------------------------------------------------------

def _ship(ranges: int, length: int):
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)

    def rows(block, found):
        keys, tags = (np.concatenate([f[k] for f in found]) for k in range(2))
        order = np.lexsort((tags, keys))
        keys, tags = keys[order], tags[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])
        keys, tags = keys[new], tags[new]
        at = np.searchsorted(keys, edges)
        parts = [(k, x, y) for k, (x, y) in enumerate(zip(np.split(keys, at), np.split(tags, at))) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([x.tobytes() for _, x, _ in parts], pa.binary()),
                                           pa.array([y.tobytes() for _, _, y in parts], pa.binary())], ["range", "block", "keys", "tags"])

    def run(batches):
        block, found = None, []
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                if row >> BLOCK != block:
                    if found:
                        yield rows(block, found)
                    block, found = row >> BLOCK, []
                raw = text.encode()
                first, count, hashes, starts, _, keys, _ = anchor_halves(np.frombuffer(raw, np.uint8), length)
                if len(first):
                    bounds = _borders(first, count, hashes)
                    tags = np.array([xxhash.xxh3_64_intdigest(raw[s:e + length - 1]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.uint64)
                    found.append((keys, tags[np.searchsorted(bounds, starts, "right") - 1]))
        if found:
            yield rows(block, found)
    return run


def _met(hot_blocks: int):
    """Of one range: the keys that two blocks have in different stretches, and those of them that more than ``hot_blocks`` have, per block."""
    def run(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        own = [np.unique(a) for a in arrays]
        every, blocks = np.unique(np.concatenate(own), return_counts=True)
        keys, tags = np.concatenate(arrays), np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("tags")])
        order = np.lexsort((tags, keys))
        keys, tags = keys[order], tags[order]
        apart = np.zeros(len(every), bool)
        apart[np.searchsorted(every, keys[1:][(keys[1:] == keys[:-1]) & (tags[1:] != tags[:-1])])] = True
        kept, often = every[(blocks > 1) & apart], every[(blocks > hot_blocks) & apart]
        met, hot = [], []
        for a in own:
            met.append(a[np.isin(a, kept, assume_unique=True)].tobytes())
            hot.append(a[np.isin(a, often, assume_unique=True)].tobytes())
        return pa.table({"block": table.column("block"), "met": pa.array(met, pa.binary()), "hot": pa.array(hot, pa.binary())})
    return run


# --- step 2: blocks -----------------------------------------------------------------------------------------

def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(covered) + 2, bool)
    edge[1:-1] = covered
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    return edges[::2], edges[1::2]


def cut(data: np.ndarray, windows: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 of a text whose repeats are these runs of windows."""
    mark = np.zeros(len(data) + 1, np.int64)
    np.add.at(mark, windows, 1)
    np.add.at(mark, windows + counts + length - 1, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return len(data), int(covered.sum()), len(_spans(covered)[0]), hashlib.sha256(data[~covered].tobytes()).hexdigest()


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs: first, count."""
    if not len(numbers):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(numbers) + 1, bool)  # with the end
    np.not_equal(numbers[1:], numbers[:-1] + 1, out=new[1:-1])
    at = np.flatnonzero(new)
    return numbers[at[:-1]], np.diff(at)


def _expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(firsts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(firsts) else np.zeros(0, np.int64)


OUT = "kind int, block long, row long, id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, firsts binary, counts binary, dealt long, start long, bytes binary"


def _settle_block(length: int):
    """One block: answers (kind 0), texts that wait (1) and windows that go on (2)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([(name, kinds.get(kind) or table.schema.field("id").type) for name, kind in (x.split(" ") for x in OUT.split(", "))])
        texts, marks = table.filter(pc.is_valid(table.column("text"))), table.filter(pc.is_valid(table.column("n")))
        met, hot = (np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(c).drop_null()] or [np.zeros(0, np.uint64)])) for c in ("met", "hot"))
        texts = texts.take(pc.sort_indices(texts, [("id", "ascending"), ("row", "ascending")], null_placement="at_start"))
        block = table.column("block")[0].as_py()
        early: dict[int, list] = {}
        for row, f, n in zip(*(marks.column(c).to_pylist() for c in ("row", "start", "n"))):
            early.setdefault(row, []).append((f, n))
        data, runs, base, at, copies = [], [], [], 0, []
        for text, row in zip(texts.column("text").to_pylist(), texts.column("row").to_pylist()):
            d = _bytes(text)
            copies.append(sum(n for _, n in early.get(row, ())) >= max(1, len(d) - length + 1))
            data.append(d)
            base.append(at)
            runs.append(anchor_halves(d if not copies[-1] else d[:0], length)[3:6])
            at += len(d) if not copies[-1] else 0
        owner = np.repeat(np.arange(len(data)), [len(r[0]) for r in runs])
        firsts, counts, hashes = (np.concatenate([r[k] for r in runs]) for k in range(3)) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        afar = np.isin(hashes, met)
        _, back, often = np.unique(hashes, return_inverse=True, return_counts=True)
        near = often[back] > 1 if len(hashes) else afar
        base = np.array(base, np.int64)
        whole = np.concatenate([d for d, c in zip(data, copies) if not c] or [np.zeros(0, np.uint8)])
        # windows with an equal one earlier in the block
        start = firsts + base[owner] if len(owner) else firsts
        settled = np.zeros(len(whole) + 1, bool)
        for row, b, copy in zip(texts.column("row").to_pylist(), base.tolist(), copies):
            for f, n in () if copy else early.get(row, ()):
                settled[b + f:b + f + n] = True
        some = np.flatnonzero(near)
        windows = _expand(start[some], counts[some])
        windows = windows[~settled[windows]]
        settled[windows[_refine_few(whole, windows, length)]] = True
        # the others whose anchor other blocks have go on, in runs of one anchor
        far = np.flatnonzero(afar)
        windows = _expand(start[far], counts[far])
        of = np.repeat(far, counts[far])
        free = ~settled[windows]
        windows, of = windows[free], of[free]
        alone = np.isin(hashes, hot)[of]
        new = np.ones(len(windows), bool)
        new[1:] = (np.diff(windows) != 1) | (np.diff(of) != 0) | alone[1:]
        at = np.flatnonzero(new)
        sizes, first, of = np.diff(np.r_[at, len(windows)]), windows[at], of[at]
        raw = whole.tobytes()
        parts = [raw[s:e] for s, e in zip(first.tolist(), (first + sizes + length - 1).tolist())]
        dealt = (hashes[of] >> np.uint64(1)).astype(np.int64)
        for k in np.flatnonzero(alone[at]).tolist():
            dealt[k] = xxhash.xxh3_64_intdigest(parts[k]) >> 1
        ids, numbers = texts.column("id").combine_chunks(), texts.column("row").to_numpy()
        whose = owner[of] if len(of) else of
        onward = {"row": numbers[whose], "id": ids.take(pa.array(whose)), "dealt": dealt, "start": first - base[whose] if len(whose) else first, "bytes": pa.array(parts, pa.binary())}
        waits = np.zeros(len(data), bool)
        waits[whose] = True
        answers, waiting = [], []
        for o, d in enumerate(data):
            if copies[o]:
                f, n = (np.zeros(1, np.int64), np.array([len(d) - length + 1])) if len(d) >= length else _runs(np.zeros(0, np.int64))
            else:
                f, n = _runs(np.flatnonzero(settled[base[o]:base[o] + len(d)]))
            if waits[o]:
                waiting.append((d.tobytes().decode(), f.astype(np.int64).tobytes(), n.astype(np.int64).tobytes()))
            else:
                answers.append(cut(d, f, n, length))
        done, later = np.flatnonzero(~waits), np.flatnonzero(waits)
        ready = dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*answers))) if answers else {}
        held = dict(zip(("text", "firsts", "counts"), zip(*waiting))) if waiting else {}
        return pa.concat_tables([
            _rows(schema, 0, block, {"row": numbers[done], "id": ids.take(pa.array(done))} | ready),
            _rows(schema, 1, block, {"row": numbers[later], "id": ids.take(pa.array(later))} | held),
            _rows(schema, 2, block, onward)])
    return run


def _rows(schema: pa.Schema, kind: int, block: int, columns: dict) -> pa.Table:
    n = len(columns["row"])
    columns = columns | {"kind": [kind] * n, "block": [block] * n}
    return pa.table([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                     for f in schema], schema=schema)


def _refine_few(whole: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """``refine`` over the stretches that hold the windows, not over all bytes of the block."""
    f, n = _runs(windows)
    if not len(f):
        return np.zeros(0, bool)
    f, n = f.copy(), n.copy()
    size = n + length - 1
    offset = np.r_[0, np.cumsum(size)[:-1]]
    data = whole[_expand(f, size)]
    return refine(data, _expand(offset, n), length)


# --- steps 3 and 4 ------------------------------------------------------------------------------------------

def _settle_part(length: int):
    """Of one part: runs of windows that have an equal one earlier in the part."""
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_start"))
        parts = table.column("bytes").to_pylist()
        size = np.array([len(p) for p in parts], np.int64)
        n = size - length + 1
        offset = np.r_[0, np.cumsum(size)[:-1]]
        again = refine(np.frombuffer(b"".join(parts), np.uint8), _expand(offset, n), length)
        owner = np.repeat(np.arange(len(parts)), n)[again]
        place = (_expand(table.column("start").to_numpy(), n))[again]
        new = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(owner) != 0)]) if len(place) else np.zeros(0, np.int64)
        picked = owner[new]
        return pa.table({"block": table.column("block").take(pa.array(picked)), "row": table.column("row").take(pa.array(picked)), "first": pa.array(place[new], pa.int64()),
                         "count": pa.array(np.diff(np.r_[new, len(place)]), pa.int64())})
    return run


def _finish(id_type, length: int):
    """One block: its waiting texts and the repeats found elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        late: dict[int, list] = {}
        hits = table.filter(pc.is_valid(table.column("first")))
        for row, f, n in zip(*(hits.column(c).to_pylist() for c in ("row", "first", "count"))):
            late.setdefault(row, []).append((f, n))
        texts = table.filter(pc.is_valid(table.column("text")))
        out = []
        for row, text, f, n in zip(*(texts.column(c).to_pylist() for c in ("row", "text", "firsts", "counts"))):
            more = np.array(late.get(row, []), np.int64).reshape(-1, 2)
            out.append(cut(_bytes(text), np.r_[np.frombuffer(f, np.int64), more[:, 0]], np.r_[np.frombuffer(n, np.int64), more[:, 1]], length))
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.table([texts.column("id").combine_chunks(), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_blocks: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    stretches = spool(rows.select("row", "id", "text").mapInArrow(_stretches(length), f"row long, id {kind}, start long, n long, digest binary"), "stretches")
    firsts = (stretches.groupBy("digest").agg(F.min(F.struct("id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
              .select("digest", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")))
    early = stretches.join(firsts, "digest").filter("row <> first_row or start <> first_start").select("row", "start", "n")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, int(size // 39 // RANGE_HASHES) + 1)
    shipped = rows.select("row", "text").mapInArrow(_ship(ranges, length), "range long, block long, keys binary, tags binary")
    met = spool(shipped.groupBy("range").applyInArrow(_met(hot_blocks), "block long, met binary, hot binary"), "anchors")
    # texts, the stretches of theirs that are settled, and the anchors that other blocks have too
    both = rows.unionByName(early, allowMissingColumns=True).withColumn("block", F.shiftright("row", BLOCK)).unionByName(met, allowMissingColumns=True)
    settled = spool(both.groupBy("block").applyInArrow(_settle_block(length), OUT.replace("{id}", kind)), "blocks")
    for done in (stretches, met):
        drop_spool(done)
    onward = settled.filter("kind = 2")
    amount = onward.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(amount // PART_BYTES) + 1)
    late = (onward.select(F.pmod(F.xxhash64("dealt"), F.lit(parts)).alias("part"), "block", "row", "id", "start", "bytes")
            .groupBy("part").applyInArrow(_settle_part(length), "block long, row long, first long, count long"))
    waiting = settled.filter("kind = 1").select("block", "row", "id", "text", "firsts", "counts").unionByName(late, allowMissingColumns=True)
    answer = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return settled.filter("kind = 0").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(waiting.groupBy("block").applyInArrow(_finish(kind, length), answer))


def op2_suffix_dedup(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of documents."""
    return remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
