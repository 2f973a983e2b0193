"""N-gram Jaccard join: documents linked when their five-word shingle sets overlap by 80 %.

The join is a T-occurrence search: a partner of a set with n shingles must hold at least
T of them, so an inverted index is asked for the documents found on T or more of n lists.
DivideSkip answers: the longest lists are set aside, the short ones are heap-merged, and
the few documents that could still reach T are looked up in the long lists by binary search.

Around that search, which one task runs over one block of sets, four exact steps keep blocks small:

1. A partner holds at least n - n // 5 of a set's shingles, so at most n // 5 of them are found in
   no other document.  Each document sends the hashes of a fixed share of hash space, and those
   with more than n // 5 lone ones there are alone.  A hash that repeats within a batch is sent once.
2. Documents with equal sets become one class.
3. Put a class's hashes in order of the number of classes that hold them, rarest first: two linked classes share one
   of their first n // 5 + 1.  Chains over the classes of each such hash, cut where sizes are
   incompatible, join into blocks: no link leaves a block, and a passage that many texts share joins nothing.
4. A block of more than ``block_limit`` classes or ``shingle_limit`` shingles is searched in chunks: each first with chunk 0,
   then with all that has not joined the block's largest component by then.

Edge cases: a null text is an empty text; a text without words has no shingle and no partner; one
of fewer than five words has one shingle, the whole sequence.  Rows that repeat a doc_id are one
document.  A row whose doc_id is null gets the component of equal sets or null.  Other columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .text import chunks, mix, shingle_sets
from .util import batch, bounded_batches, width, written

#: The share of hash space whose shingles are compared in step 1, out of 2**16.
SHARE = 26214
TEXT_PER_BATCH = 16 << 20

_ASK = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_META = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("may_link", pa.bool_())])
_DOC = np.dtype([("id", "<i8"), ("has_id", "?"), ("n", "<i8"), ("x", "<i8"), ("here", "<i8"), ("h1", "<u8"), ("h2", "<u8")])
_KEY = np.dtype([("key", "u1", 6), ("doc", "<u2")])


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019)))) if len(s) else 0


def _ask(buckets: int, k: int):
    def send(seq: int, ids: list, sets: list[np.ndarray]):
        key = (TaskContext.get().partitionId() << 32) | seq
        limit = np.uint64(SHARE << 48)
        parts = [s[: np.searchsorted(s, limit)] for s in sets]
        doc = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        tokens = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)) >> np.uint64(16)
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        at = np.flatnonzero(first)
        many = np.diff(np.append(at, len(tokens))) > 1
        here = np.bincount(doc[np.repeat(many, np.diff(np.append(at, len(tokens))))], minlength=len(sets))
        out = np.zeros(len(at), _KEY)
        out["key"] = tokens[at].view(np.uint8).reshape(-1, 8)[:, :6]
        out["doc"] = np.where(many, 65535, doc[at])
        bucket = (tokens[at] * np.uint64(buckets)) // np.uint64(SHARE << 32) if buckets < 1 << 15 else tokens[at] // np.uint64((SHARE << 32) // buckets + 1)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = [(b, out[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut)).tolist()]
        docs = np.zeros(len(sets), _DOC)
        docs["id"], docs["has_id"] = [i or 0 for i in ids], [i is not None for i in ids]
        docs["n"], docs["x"], docs["here"] = [len(s) for s in sets], [len(p) for p in parts], here
        hashes = [set_hash(s) for s in sets]
        docs["h1"], docs["h2"] = [h[0] for h in hashes], [h[1] for h in hashes]
        rows.append((key % buckets, docs.tobytes()))
        return batch(_ASK, [r[0] for r in rows], [key] * len(rows), [0] * (len(rows) - 1) + [1], [r[1] for r in rows])

    def run(batches):
        seq, size, ids, sets = 0, 0, [], []
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            for lo, hi, data, offs in chunks(b.column("text")):
                if sets and (size + len(data) > TEXT_PER_BATCH or len(sets) + hi - lo > 65000):
                    yield send(seq, ids, sets)
                    seq, size, ids, sets = seq + 1, 0, [], []
                for at in range(0, hi - lo, 60000):
                    end = min(at + 60000, hi - lo)
                    if at:
                        yield send(seq, ids, sets)
                        seq, ids, sets = seq + 1, [], []
                    sets += shingle_sets(data[offs[at] : offs[end]], offs[at : end + 1] - offs[at], k)
                    ids += keys[lo + at : lo + end]
                size += len(data)
        if sets:
            yield send(seq, ids, sets)

    return run


def _answer(batches):
    """For each batch of documents: how many of a document's hashes other batches hold too."""
    sent, keys = [], []
    for b in batches:
        for bucket, at, kind, payload in zip(*(c.to_pylist() for c in b.columns)):
            if kind:
                yield batch(_ASK, [bucket], [at], [1], [payload])
            else:
                sent.append((bucket, at))
                keys.append(np.frombuffer(payload, _KEY))
    if not keys:
        return
    sizes = [len(x) for x in keys]
    every = np.concatenate(keys)
    del keys
    wide = np.zeros((len(every), 8), np.uint8)
    wide[:, :6] = every["key"]
    key, doc = wide.view(np.uint64).ravel(), every["doc"]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    found &= doc != 65535
    end = 0
    for (bucket, at), n in zip(sent, sizes):
        start, end = end, end + n
        d, c = np.unique(doc[start:end][found[start:end]], return_counts=True)
        if len(d):
            yield batch(_ASK, [bucket], [at], [0], [np.stack([d.astype("<u4"), c.astype("<u4")]).tobytes()])


def _gather(batches):
    docs, counts = {}, defaultdict(list)
    for b in batches:
        for _, at, kind, payload in zip(*(c.to_pylist() for c in b.columns)):
            if kind:
                docs[at] = np.frombuffer(payload, _DOC)
            else:
                counts[at].append(np.frombuffer(payload, "<u4").reshape(2, -1))
    for at, d in docs.items():
        found = d["here"].copy()
        for i, c in counts.get(at, ()):
            np.add.at(found, i, c.astype(np.int64))
        may = (d["n"] > 0) & (d["x"] - found <= d["n"] // 5)
        yield batch(_META, pa.array(d["id"], pa.int64(), mask=~d["has_id"]), d["n"], d["h1"].view(np.int64), d["h2"].view(np.int64), may)


_SETS = pa.schema([("batch", pa.int64()), ("cls", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])
SETS_PER_BATCH = 1 << 19


def _sets(k: int):
    """The sets of many classes as one row."""

    def run(batches):
        seq, held, cls, sets = 0, 0, [], []

        def row():
            key = (TaskContext.get().partitionId() << 32) | seq
            return batch(_SETS, [key], [np.array(cls, np.int64).tobytes()], [np.array([len(x) for x in sets], np.int64).tobytes()], [np.concatenate(sets).tobytes()])

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, data, offs in chunks(b.column("text")):
                for i, x in zip(ids[lo:hi], shingle_sets(data, offs, k)):
                    if sets and held + len(x) > SETS_PER_BATCH:
                        yield row()
                        seq, held, cls, sets = seq + 1, 0, [], []
                    held += len(x)
                    cls.append(i)
                    sets.append(x)
        if sets:
            yield row()

    return run


def _opened(cls: bytes, sizes: bytes, tokens: bytes):
    n = np.frombuffer(sizes, np.int64)
    return np.frombuffer(cls, np.int64), n, np.frombuffer(tokens, np.uint64)


_CLASS = pa.schema([("cls", pa.int64()), ("tokens", pa.binary())])


def _classes(batches):
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("cls", "sizes", "tokens"))):
            cls, n, tokens = _opened(*row)
            end = np.cumsum(n)
            raw = memoryview(tokens).cast("B")
            yield batch(_CLASS, cls, [bytes(raw[8 * (e - m) : 8 * e]) for m, e in zip(n.tolist(), end.tolist())])


def _ask_counts(buckets: int):
    """The distinct hashes of a batch of sets by bucket, with the number of sets that hold each."""

    def run(batches):
        for b in batches:
            for at, payload in zip(b.column("batch").to_pylist(), b.column("tokens").to_pylist()):
                token, count = np.unique(np.frombuffer(payload, np.uint64), return_counts=True)
                cut = np.searchsorted(((token >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24), np.arange(buckets + 1, dtype=np.uint64))
                rows = [(i, token[cut[i] : cut[i + 1]].tobytes() + count[cut[i] : cut[i + 1]].astype("<u4").tobytes()) for i in np.flatnonzero(np.diff(cut)).tolist()]
                yield batch(_ASK, [r[0] for r in rows], [at] * len(rows), [0] * len(rows), [r[1] for r in rows])

    return run


def _answer_counts(batches):
    """For each hash that was sent, in the order sent, the number of sets in all batches (at most 65535)."""
    sent, tokens, counts = [], [], []
    for b in batches:
        for bucket, at, _, payload in zip(*(c.to_pylist() for c in b.columns)):
            n = len(payload) // 12
            sent.append((bucket, at))
            tokens.append(np.frombuffer(payload, np.uint64, n))
            counts.append(np.frombuffer(payload, "<u4", n, 8 * n))
    if not sent:
        return
    sizes = [len(t) for t in tokens]
    _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.minimum(np.bincount(inverse, np.concatenate(counts)), 65535).astype("<u2")[inverse]
    end = 0
    for (bucket, at), n in zip(sent, sizes):
        start, end = end, end + n
        yield batch(_ASK, [bucket], [at], [0], [total[start:end].tobytes()])


_POSTING = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prefixes(batches):
    for b in batches:
        for cls, sizes, tokens, answers in zip(*(b.column(c).to_pylist() for c in ("cls", "sizes", "tokens", "answers"))):
            cls, n, token = _opened(cls, sizes, tokens)
            _, inverse = np.unique(token, return_inverse=True)
            held = np.concatenate([np.frombuffer(a["payload"], "<u2") for a in sorted(answers, key=lambda a: a["bucket"])])[inverse]
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((token, held, owner))
            first = (np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)) <= np.repeat(n // 5, n)
            at = order[first]
            at = at[held[at] > 1]
            yield batch(_POSTING, token[at].view(np.int64), cls[owner[at]], n[owner[at]])


def _chains(batches):
    """Edges along the classes of each hash in order of size, of sizes that a link allows."""
    cols = [[], [], []]
    for b in batches:
        for i in range(3):
            cols[i].append(b.column(i).to_numpy())
    if not cols[0]:
        return
    token, cls, n = (np.concatenate(c) for c in cols)
    order = np.lexsort((cls, n, token))
    token, cls, n = token[order], cls[order], n[order]
    near = (token[1:] == token[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (cls[1:] != cls[:-1])
    a, b = forest(cls[1:][near], cls[:-1][near])
    yield batch(_EDGE, a, b)


def needed(n: int, m: int) -> int:
    """The overlap T at which sets of n and m shingles link: 100 * overlap >= 80 * union."""
    return -(-4 * (n + m) // 9)


def divide_skip(lists: list[np.ndarray], t: int, mu: float = 0.002) -> list[tuple[int, int]]:
    """(value, count) of the values found on at least ``t`` of the sorted lists, t >= 1.

    What the heap-merge of the short lists leaves is looked up in the long lists, all values in one
    list at a time, and a value goes as soon as the lists to come cannot bring it to ``t``.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return []
    long = min(t - 1, int(t / (mu * log2(max(2, len(lists[-1]))) + 1)))
    short, probed = [x.tolist() for x in lists[: len(lists) - long]], lists[len(lists) - long :]
    least = t - long
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    values, counts = [], []
    while len(heap) >= least:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            values.append(value)
            counts.append(len(popped))
            goal = value + 1
        else:  # skip: nothing below the new top can be on `least` lists
            for _ in range(min(least - 1 - len(popped), len(heap))):
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            goal = max(value + 1, heap[0][0])
        for _, i, at in popped:
            x = short[i]
            at += 1
            if at < len(x) and x[at] < goal:
                at = bisect_left(x, goal, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    value, count = np.array(values, np.int64), np.array(counts, np.int64)
    for left, x in zip(range(len(probed) - 1, -1, -1), probed):
        if not len(value):
            break
        count += x[np.minimum(x.searchsorted(value), len(x) - 1)] == value
        able = count + left >= t
        if not able.all():
            value, count = value[able], count[able]
    able = count >= t
    return list(zip(value[able].tolist(), count[able].tolist()))


def link_block(cls: np.ndarray, sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """A number for the component of each set; every linked pair is found by the T-occurrence search or follows from those found.

    Sets are asked for in order of size, each for the larger ones, on the lists of its hashes without the sets of its own
    component: a group that has come together is not searched again.  ``known``: components that are known already.
    Hashes of one component only are left out of the index, which is made anew whenever an eighth of the components is gone.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((cls, size))
    sets, size = [sets[i] for i in order], size[order]
    part = np.unique(known[order], return_inverse=True)[1] if known is not None else np.arange(len(sets))
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]

    def open_index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings of hashes that two components hold, and how many of them each set has."""
        if not len(token):
            return token, owner, np.zeros(len(sets), np.int64)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = part[owner]
        mixed = np.repeat(np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first), np.diff(np.append(first, len(token))))
        return token[mixed], owner[mixed], np.bincount(owner[mixed], minlength=len(sets))

    token, owner, shared = open_index()
    alive, gone = len(np.unique(part)), 0
    for x in range(len(sets)):
        if 9 * shared[x] < 8 * size[x]:
            continue
        end = int(np.searchsorted(size, size[x] + size[x] // 4, "right"))  # sizes up to 5/4
        if end <= x + 1 or (part[x + 1 : end] == part[x]).all():
            continue
        lists = []
        for a, b in zip(np.searchsorted(token, sets[x], "left").tolist(), np.searchsorted(token, sets[x], "right").tolist()):
            if b - a > 1:
                o = owner[a:b]
                o = o[np.searchsorted(o, x, "right") : np.searchsorted(o, end)]
                if len(o):
                    o = o[part[o] != part[x]]
                    if len(o):
                        lists.append(o)
        n = int(size[x])
        found = [y for y, overlap in divide_skip(lists, needed(n, n)) if overlap >= needed(n, int(size[y]))]
        if found:
            joined = np.unique(part[found])
            part[np.isin(part, joined)] = part[x]
            gone += len(joined)
            if 8 * gone >= alive:
                alive, gone = alive - gone, 0
                token, owner, shared = open_index()
    out = np.empty(len(sets), np.int64)
    out[order] = part
    return out


def _search(table: pa.Table) -> pa.Table:
    """Edges of the linked classes of one group; a column ``root`` says which are linked already."""
    cls = table.column("cls").to_numpy()
    tokens = table.column("tokens").to_pylist()
    once = np.array(list({key: i for i, key in enumerate(zip(cls.tolist(), tokens))}.values()))  # one may come from both sides
    known = table.column("root" if "root" in table.column_names else "cls").to_numpy()[once]
    cls, tokens = cls[once], [tokens[i] for i in once]
    part = link_block(cls, [np.frombuffer(t, np.uint64) for t in tokens], known)
    _, head, at = np.unique(part, return_index=True, return_inverse=True)
    a, b = forest(cls, cls[head[at]])
    return pa.Table.from_batches([batch(_EDGE, a, b)])


def _chunks_of(limit: int, shingles: int):
    """How many chunks of at most about so many classes and shingles a group needs."""
    return F.greatest(F.ceil(F.count("*") / F.lit(limit)), F.ceil(F.sum("n") / F.lit(shingles)), F.lit(1)).cast("int")


def _block_links(spark: SparkSession, sets: DataFrame, blocks: DataFrame, block_limit: int, shingle_limit: int) -> DataFrame:
    """(cls, root) of the classes that have links; ``blocks``: (cls, block, n).

    A block of one chunk is searched at once.  Of a larger one, first each chunk is searched together with chunk 0.
    Then what is not in the block's largest component yet, in chunks of its own, meets every chunk: two linked classes that have
    not met are both in that component, so each pair is searched or known.  A group of near copies mostly comes
    together in the first round, so that classes are sent a few times and not once for each chunk.
    """
    parts = blocks.groupBy("block").agg(_chunks_of(block_limit, shingle_limit).alias("parts"))
    blocks = written(spark, blocks.join(parts, "block").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "blocks")
    opened = sets.mapInArrow(_classes, "cls long, tokens binary")
    place = F.when((F.col("parts") > 1) & (F.col("own") == 0), F.expr("sequence(1, parts - 1)")).otherwise(F.array("own"))
    dealt = opened.join(blocks, "cls").select("cls", "tokens", "block", F.explode(place).alias("i"))
    links = written(spark, dealt.groupBy("block", "i").applyInArrow(_search, "a long, b long"), "links")
    large = blocks.where("parts > 1")
    if large.isEmpty():
        return links.select(F.col("a").alias("cls"), F.col("b").alias("root"))
    met = connected_components(spark, links).withColumnsRenamed({"node": "cls"})
    large = written(spark, large.join(met, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "met")
    giant = large.groupBy("block", "root").agg(F.count("*").alias("held")).groupBy("block").agg(F.max_by("root", F.struct("held", "root")).alias("giant"))
    rest = large.where("own > 0").join(giant, "block").where("root <> giant").drop("giant")
    rest_parts = rest.groupBy("block").agg(_chunks_of(block_limit, shingle_limit).alias("rest_parts"))
    rest = rest.join(rest_parts, "block").select("cls", "block", "root", F.explode(F.expr("sequence(1, parts - 1)")).alias("i"), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("rest_parts")).cast("int").alias("j"))
    every = large.where("own > 0").join(rest_parts, "block").select("cls", "block", "root", F.col("own").alias("i"), F.explode(F.expr("sequence(0, rest_parts - 1)")).alias("j"))
    dealt = opened.join(every.unionByName(rest).distinct(), "cls")
    more = written(spark, dealt.groupBy("block", "i", "j").applyInArrow(_search, "a long, b long"), "links")
    return connected_components(spark, links.unionByName(more)).withColumnsRenamed({"node": "cls"})


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, block_limit: int = 4000, shingle_limit: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    bounded_batches(spark)
    n = width(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = "bucket int, batch long, kind int, payload binary"
    meta = docs.mapInArrow(_ask(n, k), asked).repartition(n, "bucket").mapInArrow(_answer, asked).repartition(n, "batch")
    meta = written(spark, meta.mapInArrow(_gather, "doc_id long, n long, h1 long, h2 long, may_link boolean"), "shingles")
    classes = meta.where("may_link").groupBy("h1", "h2").agg(F.min("doc_id").alias("cls"), F.max("n").alias("n")).where("cls is not null")
    sets = docs.join(classes.select(F.col("cls").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets(k), "batch long, cls binary, sizes binary, tokens binary")
    sets = written(spark, sets, "sets")
    counts = sets.select("batch", "tokens").mapInArrow(_ask_counts(n), asked).repartition(n, "bucket").mapInArrow(_answer_counts, asked)
    counts = counts.groupBy("batch").agg(F.collect_list(F.struct("bucket", "payload")).alias("answers"))  # of one batch
    prefixes = sets.join(counts, "batch").mapInArrow(_prefixes, "token long, cls long, n long")
    chains = prefixes.repartition(n, "token").mapInArrow(_chains, "a long, b long")
    blocks = connected_components(spark, chains)
    blocks = blocks.select(F.col("node").alias("cls"), F.col("root").alias("block")).unionByName(blocks.select(F.col("root").alias("cls"), F.col("root").alias("block")).distinct())
    blocks = blocks.join(classes.groupBy("cls").agg(F.max("n").alias("n")), "cls")
    links = _block_links(spark, sets, blocks, block_limit, shingle_limit)
    classes = classes.join(links, "cls", "left").select("h1", "h2", F.coalesce("root", "cls").alias("found"))
    return meta.join(classes, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
