"""Suffix-array dedup: remove every byte that a ``MATCH``-byte string covers which also starts elsewhere.

A sparse suffix array is sorted by a common-prefix-aware distributed merge sort.  Each batch of
documents sorts its suffixes into runs, front-codes them (length of the prefix shared with the
suffix before, then the rest) and sends them out; a loser tree over the runs combines them and
carries the common prefixes along, so that no known prefix is compared again.  What stands next to
each other in the merged order, and the same for the text to the left, gives the longest matches.

The array holds the suffixes at anchors: positions whose ``GRAM``-byte string has the smallest hash
of some window of ``MATCH`` bytes.  Equal windows have equal anchors, so a repeated window always
shows at an anchor of its own: with l equal bytes to the left of two anchors and r to the right,
l + r >= MATCH, and l, r bounded by the window, no text further away is needed.  Anchors whose
gram occurs once in the whole input are left out before sorting: all batches send their grams'
hashes to buckets, which answer with those that occur twice.  A string that stands often in a batch
is sent once, with its count.  Batches are written to the shared folder first: later passes see the same ones.

Grams and contexts are recognised by 64-bit hashes; a match itself is found on bytes.

Edge cases: a null text is an empty text; a text of under ``MATCH`` bytes loses nothing; rows that repeat
a doc_id are texts of their own; a null doc_id stays null.  Other columns are handed on inside ``row``.
"""

from __future__ import annotations

import io
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .text import chunks, mix, prefix_sums, powers, span_hashes
from .util import batch, bounded_batches, width, written

MATCH, GRAM = 200, 64
LEFT = MATCH - GRAM
BATCH_BYTES = 6 << 20


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, hash of the gram, hash of the context, context's start and end) of each anchor."""
    n = len(data)
    if n < MATCH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    sums = prefix_sums(data)
    _, q = powers(n)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * q[: n - GRAM + 1])
    rank = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(rank, LEFT + 1, np.minimum)
    edge = np.zeros(n + 2, np.int32)  # windows that lie in one document
    fits = np.diff(offs) >= MATCH
    edge[offs[:-1][fits]] += 1
    edge[offs[1:][fits] - MATCH + 1] -= 1
    least[np.cumsum(edge[: len(least)]) == 0] = 0
    pad = np.zeros(LEFT, np.uint32)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum) == rank)
    doc = np.searchsorted(offs, at, "right") - 1
    start, end = np.maximum(offs[doc], at - LEFT), np.minimum(offs[doc + 1], at + MATCH)
    context = mix(span_hashes(sums, start, end) ^ mix(((at - start) << 16 | (end - at)).astype(np.uint64)))
    return at, mix(gram[at]), context, start, end  # mixed again: the anchors' own hashes are the small ones


def _pack(batches):
    seq, size, rows = 0, 0, []

    def blob():
        table = pa.Table.from_batches(rows).combine_chunks()
        with pa.ipc.new_stream(out := io.BytesIO(), table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) | seq], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["batch", "blob"])

    for b in batches:
        text = b.column(b.schema.get_field_index("text"))
        for lo, hi, data, _ in chunks(text):
            if rows and size + len(data) > BATCH_BYTES:
                yield blob()
                seq, size, rows = seq + 1, 0, []
            rows.append(b.slice(lo, hi - lo))
            size += len(data)
    if rows:
        yield blob()


def _open(blob: bytes):
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table, chunks(table.column("text").combine_chunks())


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


_EVEN = np.uint64((1 << 64) - 2)
_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary())])


def _grams(buckets: int):
    """Each batch's gram hashes by bucket; the lowest bit says that the gram repeats within the batch."""

    def run(batches):
        for b in batches:
            for at, blob in zip(*(c.to_pylist() for c in b.columns)):
                parts = [anchors(data, offs)[1] for _, _, data, offs in _open(blob)[1]]
                key, count = np.unique(np.concatenate(parts) & _EVEN, return_counts=True)
                key |= (count > 1).astype(np.uint64)
                cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1, dtype=np.uint64))
                rows = [(i, key[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cut)).tolist()]
                yield batch(_SENT, [r[0] for r in rows], [at] * len(rows), [r[1] for r in rows])

    return run


def _repeated(batches):
    sent, keys = [], []
    for b in batches:
        for bucket, at, payload in zip(*(c.to_pylist() for c in b.columns)):
            sent.append((bucket, at))
            keys.append(np.frombuffer(payload, np.uint64))
    if not keys:
        return
    every = np.concatenate(keys)
    bare = every & _EVEN
    order = np.argsort(bare)
    same = bare[order][1:] == bare[order][:-1]
    found = (every & np.uint64(1)) > 0
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    end = 0
    for (bucket, at), k in zip(sent, keys):
        start, end = end, end + len(k)
        if found[start:end].any():
            yield batch(_SENT, [bucket], [at], [bare[start:end][found[start:end]].tobytes()])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while lo < hi:  # a[:lo] is common, a[:hi] and what is longer is not
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def front_coded(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A run of (suffix, left text reversed, count, context), sorted by suffix, as bytes."""
    n = len(rows)
    lcp = np.zeros(n, np.uint8)
    for i in range(1, n):
        lcp[i] = common(rows[i - 1][0], rows[i][0])
    lens = np.array([(len(s), len(left)) for s, left, _, _ in rows], np.uint8).reshape(-1, 2)
    body = b"".join(s[k:] + left for (s, left, _, _), k in zip(rows, lcp.tolist()))
    return b"".join([np.uint32(n).tobytes(), np.array([r[3] for r in rows], np.uint64).tobytes(), np.array([r[2] for r in rows], np.uint32).tobytes(), lcp.tobytes(), lens.tobytes(), body])


def _packed(run: bytes) -> bytes:
    return np.uint32(len(run)).tobytes() + pa.compress(run, codec="zstd", asbytes=True)


def _unpacked(payload: bytes) -> bytes:
    return pa.decompress(payload[4:], decompressed_size=int.from_bytes(payload[:4], "little"), codec="zstd", asbytes=True)


def decoded(run: bytes):
    """The rows of a run, each with the length of the prefix it shares with the row before."""
    n = int(np.frombuffer(run, np.uint32, 1)[0])
    ctx, count = np.frombuffer(run, np.uint64, n, 4).tolist(), np.frombuffer(run, np.uint32, n, 4 + 8 * n).tolist()
    lcp, lens = run[4 + 12 * n : 4 + 13 * n], run[4 + 13 * n : 4 + 15 * n]
    at, last = 4 + 15 * n, b""
    for i in range(n):
        k, size, left = lcp[i], lens[2 * i], lens[2 * i + 1]
        mid = at + size - k
        last = last[:k] + run[at:mid]
        at = mid + left
        yield k, last, run[mid:at], count[i], ctx[i]


def merged(runs: list):
    """(prefix shared with the one before, row, run) of all runs' rows in order, by a loser tree.

    A loser keeps the length of the prefix it shares with the row that beat it.  Where two rows meet,
    both lengths are against the same row: the longer one wins unseen, and only equal
    lengths call for a comparison, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    lcp = [0] * size
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = common(x[1], y[1], lcp[a])
        first, second = (a, b) if x[1][k : k + 1] <= y[1][k : k + 1] else (b, a)
        lcp[second] = k
        return first, second

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            loser[node + i // 2] = lose
            up.append(win)
        level = up
    win = level[0]
    while heads[win] is not None:
        yield lcp[win], heads[win], win
        heads[win] = head = next(runs[win], None)
        lcp[win] = head[0] if head is not None else 0
        at = (size + win) // 2
        while at:
            win, loser[at] = play(win, loser[at])
            at //= 2


def group_matches(rows: list[list]) -> list[tuple[int, int] | None]:
    """For each context of a group the most that a match of MATCH bytes or more takes to the left and right.

    A row: (prefix shared with the row before, suffix, left text reversed, count), in order of suffix.
    Every match holds the anchor, so their union reaches as far as the longest to either side.  A window
    that starts d bytes before the anchor repeats if two rows share d bytes to the left and MATCH - d
    to the right; the rows that share t bytes are runs between lengths under t in either sorted
    order.  Only the d at which runs change are looked at: O(MATCH * m log m) for m rows.
    """
    m = len(rows)
    out: list[tuple[int, int] | None] = [None] * m
    if m < 6:
        for i, (_, suffix, left, count) in enumerate(rows):
            pairs = [(common(left, y), common(suffix, x)) for j, (_, x, y, _) in enumerate(rows) if j != i] if count == 1 else [(len(left), len(suffix))]
            pairs = [(a, b) for a, b in pairs if a + b >= MATCH]
            if pairs:
                out[i] = max(a for a, _ in pairs), max(b for _, b in pairs)
        return out
    right = np.array([r[0] for r in rows])
    right[0] = 0
    by_left = sorted(range(m), key=lambda i: rows[i][2])
    lefts = np.zeros(m, np.int64)
    lefts[1:] = [common(rows[a][2], rows[b][2]) for a, b in zip(by_left, by_left[1:])]
    place = np.empty(m, np.int64)
    place[by_left] = np.arange(m)
    low, high = np.full(m, MATCH), np.full(m, -1)
    turns = np.unique(np.concatenate([lefts, MATCH - right]))
    for d in turns[(turns >= 0) & (turns <= LEFT)].tolist():
        key = np.cumsum(right < MATCH - d) * (m + 1) + np.cumsum(lefts < d)[place]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        low[hit] = np.minimum(low[hit], d)
        high[hit] = np.maximum(high[hit], d)
    for i, (_, suffix, left, count) in enumerate(rows):
        if count > 1 and len(left) + len(suffix) >= MATCH:
            out[i] = len(left), len(suffix)
        elif high[i] >= 0:
            out[i] = int(high[i]), MATCH - int(low[i])
    return out


def _runs(buckets: int):
    def run(batches):
        for b in batches:
            for at, blob, answers in zip(*(c.to_pylist() for c in b.columns)):
                known = np.sort(np.concatenate([np.frombuffer(a, np.uint64) for a in answers]))
                counts: dict[int, int] = defaultdict(int)
                found: dict[int, tuple[int, bytes, bytes]] = {}
                for _, _, data, offs in _open(blob)[1]:
                    pos, gram, ctx, start, end = anchors(data, offs)
                    key = gram & _EVEN
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                    raw = data.tobytes()
                    for c, p, s, e, part in zip(ctx[hit].tolist(), pos[hit].tolist(), start[hit].tolist(), end[hit].tolist(), _bucket(key[hit], buckets).tolist()):
                        counts[c] += 1
                        if c not in found:
                            found[c] = (part, raw[p:e], raw[s:p][::-1])
                rows = sorted((part, suffix, left, counts[c], c) for c, (part, suffix, left) in found.items())
                i = 0
                while i < len(rows):
                    j = i
                    while j < len(rows) and rows[j][0] == rows[i][0]:
                        j += 1
                    yield batch(_SENT, [rows[i][0]], [at], [_packed(front_coded([r[1:] for r in rows[i:j]]))])
                    i = j

    return run


_FOUND = np.dtype([("ctx", "<u8"), ("left", "u1"), ("right", "u1")])


def _merge(batches):
    names, runs = [], []
    for b in batches:
        for _, at, payload in zip(*(c.to_pylist() for c in b.columns)):
            names.append(at)
            runs.append(decoded(_unpacked(payload)))
    out: dict[int, list] = defaultdict(list)
    group: list[list] = []
    place: dict[int, int] = {}
    held: list[list[int]] = []
    shared = 0

    def close():
        for c, match, where in zip(place, group_matches(group), held):
            if match:
                for at in where:
                    out[at].append((c, *match))

    for lcp, (_, suffix, left, count, ctx), run in merged(runs):
        if lcp < GRAM:
            if len(group) > 1 or (group and group[0][3] > 1):
                close()
            group, place, held, shared = [], {}, [], 0
        shared = min(shared, lcp)
        if ctx in place:
            group[place[ctx]][3] += count
            held[place[ctx]].append(names[run])
        else:
            place[ctx] = len(group)
            group.append([shared if group else 0, suffix, left, count])
            held.append([names[run]])
            shared = len(suffix)
    if len(group) > 1 or (group and group[0][3] > 1):
        close()
    for at, rows in out.items():
        yield batch(_SENT, [0], [at], [np.array(rows, _FOUND).tobytes()])


def _spans(data: np.ndarray, offs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which bytes go."""
    pos, _, ctx, _, _ = anchors(data, offs)
    gone = np.zeros(len(data) + 1, np.int32)
    if len(known) and len(pos):
        i = np.minimum(np.searchsorted(known["ctx"], ctx), len(known) - 1)
        hit = known["ctx"][i] == ctx
        np.add.at(gone, pos[hit] - known["left"][i[hit]], 1)
        np.add.at(gone, pos[hit] + known["right"][i[hit]], -1)
    return np.cumsum(gone[:-1]) > 0


def _remove(schema: pa.Schema, as_text: bool):
    def run(batches):
        for b in batches:
            for blob, answers in zip(*(c.to_pylist() for c in b.columns)):
                known = np.concatenate([np.frombuffer(a, _FOUND) for a in answers or []] or [np.zeros(0, _FOUND)])
                known = known[np.argsort(known["ctx"])]
                table, parts = _open(blob)
                row = table.column("row").combine_chunks()
                for lo, hi, data, offs in parts:
                    gone = _spans(data, offs, known)
                    spans, kept = [], []
                    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                        mask = gone[s:e]
                        if mask.any():
                            turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                            spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turn[::2], turn[1::2])])
                            kept.append(data[s:e][~mask].tobytes())
                        else:
                            spans.append([])
                            kept.append(data[s:e].tobytes())
                    if as_text:
                        kept = [k.decode("utf-8", "ignore") for k in kept]
                    yield batch(schema, row.slice(lo, hi - lo), np.diff(offs), spans, kept)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, spans, kept) for every row of ``docs``, which has a string column text.

    row: a struct of all other columns; spans: the maximal removed runs (start, length) in bytes;
    kept: the bytes that stay, or as_text those that are whole characters as a string.
    """
    bounded_batches(spark)
    n = width(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    out = T.StructType([packed.schema["row"], *T._parse_datatype_string("n_bytes long, spans array<struct<start: long, length: long>>, kept " + ("string" if as_text else "binary")).fields])
    packed = written(spark, packed.mapInArrow(_pack, "batch long, blob binary"), "batches")
    sent = "bucket int, batch long, payload binary"
    gather = lambda df: df.groupBy("batch").agg(F.collect_list("payload").alias("answers"))  # noqa: E731  of one batch: no more than it sent
    repeated = packed.mapInArrow(_grams(n), sent).repartition(n, "bucket").mapInArrow(_repeated, sent)
    runs = packed.join(gather(repeated), "batch").select("batch", "blob", "answers").mapInArrow(_runs(n), sent)
    matches = written(spark, gather(runs.repartition(n, "bucket").mapInArrow(_merge, sent)), "matches")
    return packed.join(matches, "batch", "left").select("blob", "answers").mapInArrow(_remove(to_arrow_schema(out), as_text), out)
