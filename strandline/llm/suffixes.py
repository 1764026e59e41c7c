"""Removal of repeated passages by suffix arrays.

A byte goes if some string of WINDOW bytes that covers it also starts in a document with a smaller doc_id.

1. Each window's anchor is the least hash of the GRAM-byte strings in it, so that equal windows have equal anchors,
   wherever they stand; neighbouring windows mostly share theirs. Each shard of documents tells its distinct anchors,
   and how many documents hold each, to the part that the anchor's hash names; those that two documents have are
   reported back. This drops no window with a copy elsewhere.
2. The runs of windows under such an anchor go, with the bytes they span, to the part that the anchor's hash names.
   Within a shard of documents, equal runs travel once, with the least doc_id; later ones are decided at once.
3. Each part sorts the suffixes of its distinct runs in two stages: suffixes smaller than their successor are
   sorted directly, eight bytes at a time, to a depth beyond WINDOW; the others are induced by scanning the
   first-byte buckets in order. Neighbours in the array with a common prefix of WINDOW bytes form an interval,
   whose least doc_id decides.
4. The decided intervals return to the shard, where they are joined and cut out. Shards and parts are dealt by
   shuffles, so that lost executors' work is done again from the input.

An anchor that more than HOT documents have is hot: its windows travel one by one, each to the part that its own
bytes name, so that a passage in a third of all documents, with other text around it everywhere, spreads over all
parts. Equal texts are dealt to one shard, which holds them as one document of their least doc_id: the others go whole,
and what they repeat is told by that one, so that copies cost no more than their way to the shard. Those that a task
meets beside a smaller doc_id are decided there, and do not gather in that shard. A part larger than PART_BYTES is worked on in pieces, by further bits of the anchors' hashes. Long documents are
worked on in blocks of windows. Null texts are empty; a null doc_id counts as the largest number; repeated rows
of one doc_id never delete from each other; texts shorter than WINDOW stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import from_bytes, mix, prefix_hash, slices, span_hash, squeezed, text_column, to_bytes, unsqueezed, words_at

WINDOW = 50
GRAM = 16
SHARD_BYTES = 6 << 20
PART_BYTES = 2 << 20
ROOT_BYTES = 100_000_000
GROWN = 4
BLOCK = 1 << 20
HOT = 5000
LAST = np.iinfo(np.int64).max


def window_anchors(buf: np.ndarray) -> np.ndarray:
    """For each window of buf (there are len - WINDOW + 1) the least hash of its GRAM-byte strings."""
    w = words_at(buf)
    n = len(buf) - GRAM + 1
    h = mix(w[:n] * np.uint64(0x9E3779B97F4A7C15) + (w[8 : 8 + n] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F))
    width, have = WINDOW - GRAM + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def document_runs(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, number of windows, anchor) of the runs of windows with one anchor, block by block."""
    for at in range(0, max(len(buf) - WINDOW + 1, 0), BLOCK):
        a = window_anchors(buf[at : at + BLOCK + WINDOW - 1])
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        # a run under one anchor is never longer than the windows that can hold one string, unless the text repeats
        yield first + at, np.diff(np.append(first, len(a))), a[first]


def suffix_order(text: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller than the successor: the next different byte is larger; the last suffix and those that run into it are not
    change = np.flatnonzero(np.diff(text))
    up = np.zeros(n, bool)
    if len(change):
        owner = np.searchsorted(change, np.arange(n), "left")
        known = owner < len(change)
        at = change[np.minimum(owner, len(change) - 1)]
        up = known & (text[at + 1] > text[at])
    direct = np.flatnonzero(up)
    direct = direct[np.argsort(word[direct], kind="stable")]
    key = word[direct]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(direct) else np.zeros(0, np.int64)
    done = 8
    while done < depth and len(direct):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        at = direct[tied] + done
        key = np.where(at < n, word[np.minimum(at, n - 1)], np.uint64(0))
        by = np.lexsort((key, group[tied]))
        direct[tied] = direct[tied][by]
        key, old = key[by], group[tied]
        split = np.zeros(len(group), bool)
        split[tied[1:]] = (key[1:] != key[:-1]) & (old[1:] == old[:-1])
        split[1:] |= group[1:] != group[:-1]
        group = np.cumsum(split)
        done += 8
    order = np.empty(n, np.int64)
    total = np.bincount(text, minlength=256)
    start = np.concatenate([[0], np.cumsum(total)])
    by_byte = np.searchsorted(text[direct], np.arange(257))
    head = start[:-1].copy()

    def place(found: np.ndarray) -> None:
        """Put induced suffixes, in the order of their successors, at the heads of their buckets."""
        c = text[found]
        by = np.argsort(c, kind="stable")
        found, c = found[by], c[by]
        lows = np.searchsorted(c, np.arange(257))
        for b in np.unique(c).tolist():
            part = found[lows[b] : lows[b + 1]]
            order[head[b] : head[b] + len(part)] = part
            head[b] += len(part)

    place(np.array([n - 1]))  # the last suffix: its successor is the empty one
    for b in np.flatnonzero(total).tolist():
        at = start[b]
        while at < head[b]:  # suffixes that begin with a run of this byte are induced within the bucket
            now = head[b]
            before = order[at:now] - 1
            before = before[before >= 0]
            place(before[~up[before] & (text[before] == b)])
            at = now
        order[start[b + 1] - (by_byte[b + 1] - by_byte[b]) : start[b + 1]] = direct[by_byte[b] : by_byte[b + 1]]
        before = order[start[b] : start[b + 1]] - 1
        before = before[before >= 0]
        place(before[~up[before] & (text[before] > b)])
    return order


def first_holders(blob: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each run (length in windows, bytes end to end in blob) the least doc_id that has it here."""
    span = length + WINDOW - 1
    begin = np.cumsum(span) - span
    word = words_at(blob)
    order = suffix_order(blob, word, WINDOW)
    owner = np.repeat(np.arange(len(span)), span)
    order = order[order - begin[owner[order]] < length[owner[order]]]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for o in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        same[same] = word[a[same] + o] == word[b[same] + o]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc[owner[order]], starts)
    out = np.empty(len(blob), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    keep = np.arange(len(blob)) - begin[owner] < length[owner]
    return out[keep]


def _short(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that an anchor goes to, and five bytes of it; least hashes crowd near zero, so they are mixed anew."""
    h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), h & np.uint64((1 << 40) - 1)


def _five(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.concatenate([raw, np.zeros((len(raw), 3), np.uint8)], 1).reshape(-1).view("<u8").astype(np.uint64)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema)


def _runs_of(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay within one group."""
    edge = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    before = np.concatenate([[False], flags[:-1]]) & ~edge
    start = np.flatnonzero(flags & ~before)
    after = np.concatenate([flags[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    return start, np.flatnonzero(flags & ~after) + 1


def grown(size: int, total: int) -> int:
    """Bytes of a shard or part of an input of `total` bytes: as its square root beyond ROOT_BYTES, so that what a shard sends each part doesn't wear down to single runs; GROWN times at most, as a task holds one."""
    return int(size * min(GROWN, max(1, (total / ROOT_BYTES) ** 0.5)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, parts = (-(-total // grown(size, total)) + 1 for size in (SHARD_BYTES, PART_BYTES))
    plain = plain.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    many = grown(HOT, total)  # a part may be larger by as much

    def anchors(group: pa.Table) -> pa.Table:
        """Distinct anchors of one shard by part, five bytes each, and how many documents hold each."""
        each = [np.unique(np.concatenate([a for _, _, a in document_runs(np.frombuffer(t, np.uint8))])) for t in unpacked(group)[1] if len(t) >= WINDOW]
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
        part, low = _short(h, parts)
        by = np.argsort(part, kind="stable")
        part, low, n = part[by], low[by], n[by].astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        shard = group.column("shard")[0].as_py()
        return _table([{"part": int(part[lo]), "shard": shard, "h": _five(low[lo:hi]), "n": to_bytes(n[lo:hi])} for lo, hi in zip(cuts, [*cuts[1:], len(part)])], told)

    def shared(group: pa.Table) -> pa.Table:
        """Of one part, the anchors of two documents or more, for each shard that has them, and which of them are hot."""
        part = np.uint64(group.column("part")[0].as_py()) << np.uint64(40)
        each = [_unfive(x) for x in group.column("h").to_pylist()]
        h, n = np.concatenate(each), np.concatenate([from_bytes(x, np.int32) for x in group.column("n").to_pylist()])
        s = np.repeat(np.array(group.column("shard").to_pylist(), np.int32), [len(x) for x in each])
        known, which = np.unique(h, return_inverse=True)
        count = np.bincount(which, n)
        hot = known[count > many] | part
        both = count[which] > 1
        h, s = h[both] | part, s[both]
        by = np.lexsort((h, s))
        who, first = np.unique(s[by], return_index=True)
        each = np.split(h[by], first[1:]) if len(who) else []
        return pa.table({"shard": pa.array(who, pa.int32()), "h": pa.array([x.tobytes() for x in each], pa.binary()), "hot": pa.array([np.intersect1d(x, hot).tobytes() for x in each], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by shard, compressed: each text once, with the ids that have it, and ids and lengths of copies that are decided here."""
        held: dict[tuple[int, bytes], list[tuple[int, bool]]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            docs: dict[int, list[tuple[bytes, list[tuple[int, bool]]]]] = {}
            gone: dict[int, list[tuple[int, bool, int]]] = {}
            for (s, t), who in held.items():
                least = min(who)[0]
                docs.setdefault(s, []).append((t, who if len(t) < WINDOW else [w for w in who if w[0] == least]))
                for d, x in who if len(t) >= WINDOW else []:
                    if d > least:
                        gone.setdefault(d % shards, []).append((d, x, len(t)))
            for s in sorted(docs.keys() | gone.keys()):
                texts, copies = docs.get(s, []), gone.get(s, [])
                rows = [w for _, who in texts for w in who]
                cells = {"ids": np.array([d for d, _ in rows], np.int64), "named": np.array([x for _, x in rows], bool), "many": np.array([len(who) for _, who in texts], np.int64), "lengths": np.array([len(t) for t, _ in texts], np.int64)}
                cells |= {"gone": np.array([d for d, _, _ in copies], np.int64), "gone_named": np.array([x for _, x, _ in copies], bool), "gone_lengths": np.array([n for _, _, n in copies], np.int64)}
                yield pa.RecordBatch.from_pydict({"shard": [s], **{c: [to_bytes(x)] for c, x in cells.items()}, "texts": [squeezed(b"".join(t for t, _ in texts))]}, boxed)
            held.clear()
            count = 0

        for piece in slices(batches):
            ids = [(LAST, False) if d is None else (d, True) for d in piece.column("doc_id").to_pylist()]
            for w, s, t in zip(ids, piece.column("shard").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                who = held.setdefault((s if len(t) >= WINDOW else w[0] % shards, t), [])
                count += 0 if who else len(t)
                count += 16
                who.append(w)
            if count >= 16 << 20:
                yield from flush()
        yield from flush()

    def unpacked(group: pa.Table) -> tuple[np.ndarray, list[bytes], list[list[tuple[int, bool]]]]:
        """The shard's texts by their least ids, and the rows (id, whether it has one) of each."""
        rows: dict[bytes, list[tuple[int, bool]]] = {}
        for ids, named, many, lengths, texts in zip(*(group.column(c).to_pylist() for c in ("ids", "named", "many", "lengths", "texts"))):
            blob, at, i = unsqueezed(texts), 0, 0
            who = list(zip(from_bytes(ids, np.int64).tolist(), from_bytes(named, bool).tolist()))
            for k, n in zip(from_bytes(many, np.int64).tolist(), from_bytes(lengths, np.int64).tolist()):
                rows.setdefault(blob[at : at + n], []).extend(who[i : i + k])
                at, i = at + n, i + k
        by = sorted((min(who)[0], t) for t, who in rows.items())
        return np.array([d for d, _ in by], np.int64), [t for _, t in by], [rows[t] for _, t in by]

    told = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])
    boxed = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("ids", "named", "many", "lengths", "gone", "gone_named", "gone_lengths", "texts")]])
    sent = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in ("runs", "length", "anchor", "doc", "at", "row", "start")]])
    back = pa.schema([("shard", pa.int32()), ("cut", pa.binary())])

    def send(group: pa.Table, known: pa.Table) -> pa.Table:
        """Runs under shared anchors: per part, the distinct ones' bytes and where the least doc_id has them.

        To the shard itself (a part below zero) go the runs that are decided here. Rows count the shard's documents in
        the order of unpacked().
        """
        if not group.num_rows:
            return _table([], sent)
        shard = group.column("shard")[0].as_py()
        doc, text, _ = unpacked(group)
        lookup = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in known.column("h").to_pylist()] or [np.zeros(0, np.uint64)]))
        hot = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in known.column("hot").to_pylist()] or [np.zeros(0, np.uint64)]))
        rows, starts, lengths, anchor, kind = [], [], [], [], []
        number_of: dict[bytes, int] = {}
        for i, t in enumerate(text if len(lookup) else []):
            for start, length, a in document_runs(np.frombuffer(t, np.uint8)):
                part, low = _short(a, parts)
                short = low | (part.astype(np.uint64) << np.uint64(40))
                hit = lookup[np.minimum(np.searchsorted(lookup, short), len(lookup) - 1)] == short
                if hit.any():
                    start, length, a, short = start[hit], length[hit], a[hit], short[hit]
                    if len(hot) and (many := np.isin(short, hot)).any():
                        single = np.repeat(start[many], length[many]) + np.arange(length[many].sum()) - np.repeat(np.cumsum(length[many]) - length[many], length[many])
                        low, high = int(single.min()), int(single.max()) + WINDOW
                        own = span_hash(prefix_hash(np.frombuffer(t, np.uint8)[low:high]), single - low, single - low + WINDOW)
                        start, length, a = np.concatenate([start[~many], single]), np.concatenate([length[~many], np.ones(len(single), length.dtype)]), np.concatenate([a[~many], own])
                    rows.append(np.full(len(start), i, np.int32)), starts.append(start), lengths.append(length), anchor.append(a)
                    kind += [number_of.setdefault(t[s : s + n + WINDOW - 1], len(number_of)) for s, n in zip(start.tolist(), length.tolist())]
        if not rows:
            return _table([], sent)
        out = []
        rows, starts, lengths, anchor = map(np.concatenate, (rows, starts, lengths, anchor))
        del number_of
        kind = np.array(kind, np.int64)
        first = np.unique(kind, return_index=True)[1]  # rows are by doc_id
        late = doc[rows] > doc[rows[first]][kind]
        number = rows.astype(np.int32)
        if late.any():
            out.append({"part": -1 - shard, "shard": shard, "row": to_bytes(number[late]), "start": to_bytes(starts[late].astype(np.int32)), "length": to_bytes(lengths[late].astype(np.int32))})
        to, _ = _short(anchor[first], parts)
        by = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(to[by]) != 0]))
        early = np.flatnonzero(~late)
        early = early[np.argsort(kind[early], kind="stable")]
        lo_of = np.searchsorted(kind[early], np.arange(len(first) + 1))
        for lo, hi in zip(edges, [*edges[1:], len(by)]):
            mine = by[lo:hi]
            where = [early[lo_of[k] : lo_of[k + 1]] for k in mine.tolist()]
            at = np.concatenate(where)
            f = first[mine]
            runs = b"".join(text[r][s : s + n + WINDOW - 1] for r, s, n in zip(rows[f].tolist(), starts[f].tolist(), lengths[f].tolist()))
            out.append(
                {"part": int(to[mine[0]]), "shard": shard, "runs": squeezed(runs), "length": to_bytes(lengths[f].astype(np.int32)), "anchor": (anchor[f] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()}
                | {"doc": to_bytes(doc[rows[f]]), "at": to_bytes(np.array([len(w) for w in where], np.int32)), "row": to_bytes(number[at]), "start": to_bytes(starts[at].astype(np.int32))}
            )
        return _table(out, sent)

    def decide(group: pa.Table) -> pa.Table:
        """Suffix arrays of one part; intervals of removed windows, by shard. What is for a shard itself passes."""
        if group.column("part")[0].as_py() < 0:
            out = []
            for r in group.to_pylist():
                row, start, n = (from_bytes(r[c], np.int32) for c in ("row", "start", "length"))
                out.append({"shard": r["shard"], "cut": to_bytes(np.stack([row, start, n + WINDOW - 1]))})
            return _table(out, back)
        get = lambda c, t: [from_bytes(x, t) for x in group.column(c).to_pylist()]
        length, doc, at = get("length", np.int32), get("doc", np.int64), get("at", np.int32)
        anchor = [np.frombuffer(x, np.uint32) for x in group.column("anchor").to_pylist()]
        source = np.repeat(np.arange(group.num_rows), [len(x) for x in length])
        length, anchor, doc, at = (np.concatenate(x) for x in (length, anchor, doc, at))
        blob = b"".join(map(unsqueezed, group.column("runs").to_pylist()))
        span = length.astype(np.int64) + WINDOW - 1
        begin = np.cumsum(span) - span
        occ_from = np.cumsum(at) - at
        row, start = np.concatenate(get("row", np.int32)), np.concatenate(get("start", np.int32))
        shard = np.array(group.column("shard").to_pylist(), np.int32)[source]
        pieces = -(-len(blob) // PART_BYTES)
        piece = anchor.astype(np.uint64) * np.uint64(pieces) >> np.uint64(32)
        found: dict[int, list[np.ndarray]] = {}
        for p in range(pieces):
            mine = np.flatnonzero(piece == p)
            if not len(mine):
                continue
            text = [blob[b : b + s] for b, s in zip(begin[mine].tolist(), span[mine].tolist())]
            number_of: dict[bytes, int] = {}
            kind = np.array([number_of.setdefault(t, len(number_of)) for t in text], np.int64)
            first = np.unique(kind, return_index=True)[1]
            least = np.full(len(first), LAST)
            np.minimum.at(least, kind, doc[mine])
            holder = first_holders(np.frombuffer(b"".join(text[i] for i in first.tolist()), np.uint8), length[mine][first].astype(np.int64), least)
            size = length[mine][first].astype(np.int64)
            base = np.cumsum(size) - size
            n = size[kind]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(np.arange(len(mine)), n)
            flags = holder[base[kind[owner]] + inner] < doc[mine][owner]
            lo, hi = _runs_of(flags, owner)
            if not len(lo):
                continue
            who = mine[owner[lo]]
            a, b = inner[lo], inner[hi - 1] + WINDOW
            copies = at[who]
            which = np.repeat(np.arange(len(who)), copies)
            occ = occ_from[who][which] + np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
            made = np.stack([row[occ], start[occ] + a[which], b[which] - a[which]], 1).astype(np.int32)
            to = shard[who][which]
            by = np.argsort(to, kind="stable")
            ids, cuts = np.unique(to[by], return_index=True)
            for s, block in zip(ids.tolist(), np.split(made[by], cuts[1:])):
                found.setdefault(s, []).append(block)
        return _table([{"shard": k, "cut": to_bytes(np.concatenate(x).T)} for k, x in found.items()], back)

    def finish(group: pa.Table, cuts: pa.Table) -> pa.Table:
        nothing = hashlib.sha256(b"").hexdigest()
        cut = np.concatenate([from_bytes(x, np.int32).reshape(3, -1).T for x in cuts.column("cut").to_pylist()] or [np.zeros((0, 3), np.int32)])
        cut = cut[np.argsort(cut[:, 0], kind="stable")]
        doc, text, rows = unpacked(group)
        lows = np.searchsorted(cut[:, 0], np.arange(len(text) + 1))
        out = []
        for i, (d, t) in enumerate(zip(doc.tolist(), text)):
            part = cut[lows[i] : lows[i + 1]]
            if len(part):
                edge = np.zeros(len(t) + 1, np.int32)
                np.add.at(edge, part[:, 1], 1)
                np.add.at(edge, part[:, 1] + part[:, 2], -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                found = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
            else:
                found = (len(t), 0, 0, hashlib.sha256(t).hexdigest())
            out += [((x if named else None), *(found if x == d or len(t) < WINDOW else (len(t), len(t), 1, nothing))) for x, named in rows[i]]
        for ids, named, lengths in zip(*(group.column(c).to_pylist() for c in ("gone", "gone_named", "gone_lengths"))):
            out += [(x if has else None, n, n, 1, nothing) for x, has, n in zip(*(from_bytes(c, t).tolist() for c, t in ((ids, np.int64), (named, bool), (lengths, np.int64))))]
        names, types = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), [pa.int64()] * 4 + [pa.string()]
        columns = list(zip(*out)) or [()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, types)})

    def sql(schema: pa.Schema) -> str:
        return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)

    packed = plain.mapInArrow(pack, sql(boxed))
    reported = packed.groupBy("shard").applyInArrow(anchors, sql(told)).groupBy("part").applyInArrow(shared, "shard int, h binary, hot binary")
    runs = packed.groupBy("shard").cogroup(reported.groupBy("shard")).applyInArrow(send, sql(sent))
    decided = runs.groupBy("part").applyInArrow(decide, sql(back))
    # the documents meet their shard three times: the exchange of `packed` is used again
    return packed.groupBy("shard").cogroup(decided.groupBy("shard")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
