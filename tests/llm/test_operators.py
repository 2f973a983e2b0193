"""Each operator against brute force, an exact round trip or held-out labels, with the edge cases its docstring names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanframe.llm import chat, components, decontaminate, langid, licenses, ngram_join, packing, quality_bt, quality_rules, suffix_dedup, text, toxicity
from urbanframe.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(3)
DOC = "doc_id long, text string, lang string, batch string, kept boolean, row string, key int, payload string"


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def docs(spark, rows, parts=3):
    """(doc_id, text) rows with extra columns whose names operators use inside, and nulls in them."""
    return spark.createDataFrame([(i, t, None, "x", None, "y", None, None) for i, t in rows], DOC).repartition(parts)


EDGES = [(900, None), (901, ""), (902, "   \n\t "), (903, "one two"), (904, "one two"), (905, "é" * 30), (None, "text of a row without an id, long enough to be scored at all by anyone")]


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# --- text primitives


def test_words_and_shingles_agree_with_a_regular_expression():
    import pyarrow as pa

    texts = ["", " a b ", "Über alles\tin der\nWelt  ist das", "x", "A a A a A a A a", "tail\n"]
    (_, _, data, offs), *rest = text.chunks(pa.array(texts))
    assert not rest
    starts, ends, woffs = text.word_spans(data, offs)
    raw = data.tobytes()
    found = [raw[s:e].decode() for s, e in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(woffs, woffs[1:])] == [WORD.findall(t) for t in texts]
    assert [len(s) for s in text.shingle_sets(data, offs)] == [len(shingle_set(t)) for t in texts]


def test_chunks_cover_every_document_whole():
    import pyarrow as pa

    texts = [prose(RNG.randrange(50), i) for i in range(200)]
    got = []
    for _, _, data, offs in text.chunks(pa.array([*texts, None]), 300):
        got += [data[a:b].tobytes().decode() for a, b in zip(offs, offs[1:])]
    assert got == [*texts, ""]


# --- op4 and components


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rows, n = [], 0
    for base in range(12):
        words = prose(60 + 20 * base, base).split()
        for copy in range(7):
            w = list(words)
            for _ in range(copy):
                w[RNG.randrange(len(w))] = f"edit{RNG.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    shared = prose(50, 77)
    rows += [(n + i, f"{prose(20 + 30 * i, 500 + i)} {shared}") for i in range(8)]
    rows += [(700, prose(40, 9)), (701, prose(40, 9)), (702, prose(40, 9).upper())]
    return rows


@pytest.mark.parametrize("limits", [(4000, 2_000_000), (3, 2_000_000), (4000, 150)])
def test_jaccard_components(spark, limits):
    rows = near_copies() + EDGES[:-1]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs(spark, rows), 5, *limits).collect()}
    assert got == brute_components(rows)


def test_jaccard_blocks_of_many_chunks(spark):
    """A chain of linked sets, a group about one text, and many that share much with it but link to nothing."""
    base = prose(80, 41).split()
    rows = [(i, " ".join(prose(2 * i, 42).split()[-60:] if i > 30 else prose(60, 42).split())) for i in range(60)]
    rows += [(100 + i, " ".join(base[:-4] + [f"tail{i}"] * 4)) for i in range(40)]
    rows += [(200 + i, " ".join(base[: 40 + i] + prose(25, 300 + i).split())) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs(spark, rows), block_limit=7).collect()}
    assert got == brute_components(rows)


def test_jaccard_links_come_from_the_search(spark, monkeypatch):
    sets = [np.sort(np.random.default_rng(1).integers(1, 1 << 60, 50).astype(np.uint64)) for _ in range(2)] + [np.arange(5, 60, dtype=np.uint64)]
    assert len(set(ngram_join.link_block(np.arange(3), sets).tolist())) == 2
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, t: [])
    assert len(set(ngram_join.link_block(np.arange(3), sets).tolist())) == 3


def test_jaccard_one_id_with_two_texts_joins_both(spark):
    one, two = "a b c d e f g h i j k", "p q r s t u v w x y z"
    rows = [(1, one), (1, two), (2, one), (3, two), (4, f"{one} l"), (5, f"{two} 1")]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark, docs(spark, rows)).collect()}
    assert set(found.values()) == {1}


def test_jaccard_rows_without_id_and_repeats(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (2, None)]
    got = Counter((r[0], r[1], r[2]) for r in ngram_join.jaccard_components(spark, docs(spark, rows)).collect())
    assert got == Counter({(1, 3, 1): 2, (None, 3, 1): 1, (None, 1, None): 1, (2, 0, 2): 1})
    assert ngram_join.jaccard_components(spark, docs(spark, [])).count() == 0


def test_divide_skip_finds_what_counting_finds():
    for trial in range(60):
        r = np.random.default_rng(trial)
        lists = [np.unique(r.integers(0, 60, r.integers(0, 50))) for _ in range(r.integers(1, 25))]
        count = Counter(v for x in lists for v in x.tolist())
        for t in (1, 2, 5, 12):
            assert sorted(ngram_join.divide_skip(lists, t)) == sorted((v, c) for v, c in count.items() if c >= t)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (100, 103)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r[0]: r[1] for r in components.connected_components(spark, df).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}
    assert components.connected_components(spark, df.limit(0)).count() == 0


# --- op6


def brute_removal(rows):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[j : j + 200] for j in range(len(b) - 199))
    out = []
    for i, b in raw:
        mask = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                mask[j : j + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(mask)))
        out.append((i, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


def removal(spark, rows):
    found = suffix_dedup.remove_repeats(spark, docs(spark, rows))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.length)
    return [tuple(r) for r in found.select("row.doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()]


def test_suffix_dedup(spark):
    rows, passage = [], prose(60, 1)
    for i in range(40):
        rows.append((i, f"{prose(30, 100 + i)} {passage if i % 3 else passage[: 150 + i]} {prose(10, 200 + i)}"))
    copy = prose(300, 5).split()
    for i in range(40, 60):
        w = list(copy)
        for _ in range(i - 40):
            w[RNG.randrange(len(w))] = f"edit{RNG.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(70, "ab" * 500), (71, "xx" + "ab" * 150), (72, "é" * 210 + "ü" * 99), (73, "é" * 150), (74, "\0" * 300), (75, prose(3000, 8) + passage), (75, "again")]
    rows += EDGES
    assert sorted(removal(spark, rows), key=str) == sorted(brute_removal(rows), key=str)


def test_suffix_dedup_random_small_alphabet(spark):
    r = random.Random(11)
    rows = [(i, "".join(r.choice("ab") * r.choice((1, 1, 1, 90)) for _ in range(r.randrange(40)))) for i in range(40)]
    assert sorted(removal(spark, rows)) == sorted(brute_removal(rows))


def test_suffix_dedup_empty_table_and_text_output(spark):
    assert removal(spark, []) == []
    found = suffix_dedup.remove_repeats(spark, docs(spark, [(1, "é" * 120), (2, "x" + "é" * 120)]), as_text=True)
    assert {r["row"]["doc_id"]: r["kept"] for r in found.collect()} == {1: "", 2: "x"}


def test_loser_tree_merges_and_carries_prefixes():
    r = random.Random(2)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randrange(12))).encode() for _ in range(r.randrange(30))) for _ in range(9)]
    coded = [suffix_dedup.decoded(suffix_dedup.front_coded([(x, b"", 1, 0) for x in run])) for run in runs]
    got = [(k, row[1]) for k, row, _ in suffix_dedup.merged(coded)]
    want = sorted(x for run in runs for x in run)
    assert [x for _, x in got] == want
    assert [k for k, _ in got[1:]] == [suffix_dedup.common(a, b) for a, b in zip(want, want[1:])]


# --- op10


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [(i, prose(RNG.randrange(1, 900), i)) for i in range(60)] + [(60, prose(6000, 60)), (60, "twice"), (61, "It's \x01 <|endoftext|>x Ünï—code  ﬁ")] + EDGES
    got = packing.pack(spark, docs(spark, rows), tokenizer_path()).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[-1 if i is None else i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(got.fillna(-1)[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(int).itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and (s.offset == s.length.cumsum() - s.length).all()
    assert got.length.sum() > 0.9 * 2048 * got.sequence_id.nunique() or got.sequence_id.nunique() < 30
    assert packing.pack(spark, docs(spark, []), tokenizer_path()).count() == 0


def first_fit(h):
    """Windows that first-fit decreasing needs, piece by piece."""
    room = np.full(int(h.sum()), 2048)
    for n in np.flatnonzero(h)[::-1]:
        for _ in range(h[n]):
            room[np.argmax(room >= n)] -= n
    return int((room < 2048).sum())


def test_plan_uses_every_piece_once():
    for seed in range(5):
        r = np.random.default_rng(seed)
        h = np.zeros(2049, np.int64)
        h[r.integers(1, 2049, 300)] = r.integers(1, 60, 300)
        table = packing.plan(h)
        ends = Counter()
        for n in np.flatnonzero(h):
            own = table[table[:, 0] == n]
            assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all() and own[-1, 1] < h[n]
            ends[int(n)] = int(h[n])
        size = np.zeros(int(table[:, 2].max()) + int(h.max()) + 1, np.int64)
        for i, (n, rank, seq, offset) in enumerate(table):
            until = table[i + 1, 1] if i + 1 < len(table) and table[i + 1, 0] == n else h[n]
            size[seq : seq + until - rank] += n
        assert size.max() <= 2048 and size.sum() == (h * np.arange(2049)).sum()
        assert (size > 0).sum() <= 1.03 * first_fit(h)


# --- op9, op5


def test_decontamination(spark):
    items = [(i, prose(12 + 3 * i, 1000 + i)) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, prose(12, 1000))]
    rows = [(i, f"{prose(200, 3000 + i)} {items[i][1].upper()} {prose(50, 4000 + i)}") for i in range(12)]
    rows += [(20 + i, f"{prose(20, i)} {' '.join(items[11][1].split()[: 20 + 2 * i])} {prose(900, i)}") for i in range(13)] + EDGES
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in decontaminate.contaminated(spark, docs(spark, rows), bench).collect())
    want = Counter()
    for d, t in rows:
        for i, u in items:
            a, b = shingle_set(t), shingle_set(u)
            if b and 10 * len(a & b) >= 8 * len(b):
                want[d, i, len(b), len(a & b)] += 1
    assert got == want and len(want) > 15
    kept = {r[0] for r in decontaminate.decontaminated(spark, docs(spark, rows), bench).select("doc_id").collect()}
    assert kept == {d for d, _ in rows} - {d for d, *_ in want}
    assert decontaminate.contaminated(spark, docs(spark, rows), bench.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(i, f"{prose(40 * i, i)}\n({t.upper()}) {prose(30, i)}") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    for j, i in enumerate((6, 8, 9, 14)):  # from none to all of a template
        t = licenses.TEMPLATES[i][1].split()
        rows += [(100 + 50 * j + k, " ".join(t[: len(t) * k // 20])) for k in range(12, 21)]
    rows += [(40, "the license of the license"), (41, f"{rows[1][1]} {rows[2][1]}"), (42, f"{prose(300, 5)} {rows[9][1]} {prose(9000, 6)} {rows[16][1]}")] + EDGES
    got = {(r["doc_id"], r["license_id"], r["template"], r["shared"]) for r in licenses.licensed(spark, docs(spark, rows)).collect()}
    want = set()
    for d, t in rows:
        w = set(licenses.notice_shingles(t or ""))
        for i, (name, notice) in enumerate(licenses.TEMPLATES):
            s = set(licenses.notice_shingles(notice))
            if 10 * len(s & w) >= 8 * len(s):
                want.add((d, name, i, len(s & w)))
    assert got == want and {x[2] for x in want} == set(range(len(licenses.TEMPLATES)))


def test_license_texts_as_projects_print_them(spark):
    """Comment marks, other line ends, a copyright line and a filled-in name do not hide a license."""
    texts = dict(enumerate(t for _, t in licenses.TEMPLATES))
    words = lambda t, n: " ".join(t.split()[:n])
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + texts[9].replace("THE SOFTWARE IS", "\n\nThe software is")
    bsd3 = texts[11].replace("THIS SOFTWARE IS PROVIDED", "3. " + texts[12] + "\nTHIS SOFTWARE IS PROVIDED").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS")
    lgpl = "/* " + texts[15].replace(". ", ".\n * ") + " */"
    rows = [(1, mit), (2, bsd3), (3, lgpl), (4, "x = 1\n" + words(texts[14], 46)), (5, texts[8].replace("http:", "\n\n    http:"))]
    got = {}
    for r in licenses.licensed(spark, docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert "MIT" in got[1] and "BSD-3-Clause" in got[2] and "LGPL-2.1" in got[3] and "Apache-2.0" in got[5]
    assert 4 not in got  # half of the header


def test_markers_leave_no_license_out():
    notices = [licenses.notice_shingles(t) for _, t in licenses.TEMPLATES]
    found = licenses.markers(notices)
    for s in notices:
        assert 5 * sum(any(m in x for m in found) for x in s) > len(s)
    assert len(found) < 30


def test_license_scan_stays_in_the_engine(spark):
    plan = licenses.licensed(spark, docs(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op8


def test_chat_folds_events(spark):
    kind = "conv_id long, message long, seq long, kind string, role string, text string"
    log = [
        (1, 0, 0, "message", "user", "hi <|end|>\n & &lt; </s>"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "Bon"), (1, 1, 5, "delta", None, "jour"),
        (1, 2, 6, "message", "user", "no"), (1, 2, 7, "edit", None, "yes"), (1, 2, 8, "delta", None, "!"), (2, 0, 0, "delta", "assistant", None), (2, 1, 1, "message", "a\nb<", "é𝄞"), (None, 0, 0, "message", None, "x"),
    ]
    out = chat.rendered(chat.folded(spark.createDataFrame(log, kind).repartition(3)))
    shown = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    got = {r["conv_id"]: r for r in shown.collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hi <|end|>\n & &lt; </s>"), ("assistant", "Bonjour"), ("user", "yes!")]
    assert got[1]["loss"] == "Bonjour" and got[1]["formatted"].count("<|end|>") == 3
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", ""), ("a\nb<", "é𝄞")] and got[2]["loss"] == ""
    assert [tuple(t) for t in got[None]["turns"]] == [("", "x")]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_chat_streams_fold_back_and_the_mask_is_exact(spark):
    r = random.Random(8)
    rows = [(c, m, r.choice(("user", "assistant", "system", None)), r.choice((None, "", "é𝄞<|end|>\n&lt;" * r.randrange(60), prose(r.randrange(90), c + m)))) for c in range(40) for m in range(r.randrange(9))]
    rows += [(50, 0, "assistant", "x<" * 150_000), (51, 0, "user", "a"), (51, 0, "user", "a")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "n long, conv_id long, turn long, role string, text string").repartition(3)
    events = chat.streamed(df.select("conv_id", F.struct("turn", "n").alias("message"), "role", "text"))
    assert {x[0] for x in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    out = chat.rendered(chat.folded(events))
    got = {x["conv_id"]: x for x in out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert set(got) == {c for c, *_ in rows}
    plain = lambda t: t.replace("&lt;", "<").replace("&amp;", "&")
    for c, x in got.items():
        want = [(role or "", t or "") for c2, _, role, t in rows if c2 == c]
        assert [tuple(t) for t in x["turns"]] == want
        learned = [t for role, t in want if role == "assistant"]
        assert x["learned"] == "".join(learned)
        assert [plain(x["formatted"][s["start"] : s["start"] + s["length"]]) for s in x["loss"]] == learned
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_chat_many_turns_take_time_in_proportion(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("message"), F.lit("assistant").alias("role"), F.lit("some text of a turn").alias("text"))
        start = time.perf_counter()
        got = chat.rendered(rows).select(F.length("formatted"), F.length(chat.loss_text(F.col("formatted"), F.col("loss"))), F.size(chat.read_back(F.col("formatted")))).first()
        assert got[1:] == (19 * n, n)
        return time.perf_counter() - start

    took(1000)
    assert took(32_000) < 6 * took(8_000) + 2


# --- op3


def test_quality_rules(spark):
    clean = [(i, " ".join(prose(20, 10 * i + j) + "." for j in range(5)) + "\n" + prose(30, i)) for i in range(60)]
    rows = clean + [(100, "a b c d e f g h i j\na b c d e f g h i j\n\n\na b"), (101, "#x %% <y> & | $ *" * 30), (102, "line\nline\nline \nline")] + EDGES
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.rated(spark, docs(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for k in range(5)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(full) - len(set(full)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want


def test_quality_rules_score(spark):
    clean = [(i, prose(80, i)) for i in range(40)]
    rows = clean + [(100 + i, " ".join(x + "%%%" for x in prose(80, i).split())) for i in range(5)]
    got = {r["doc_id"]: r for r in quality_rules.rated(spark, docs(spark, rows)).collect()}
    count, target = np.zeros(1 << 16), np.zeros(1 << 16)
    def buckets(t):  # noqa: E306
        raw = np.frombuffer(t.encode(), np.uint8)
        return quality_rules.grams(raw, np.array([0, len(raw)]))[0]
    for i, t in rows:
        np.add.at(count, buckets(t), 1)
        if i < 100:
            np.add.at(target, buckets(t), 1)
    ratio = np.log((target + 1) / (target.sum() + 65536)) - np.log((count + 1) / (count.sum() + 65536))
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(ratio[buckets(t)].mean(), abs=1e-6)
        assert got[i]["kept"] == (i < 100)


# --- op1, op2, op7: held-out labels


def test_toxicity(spark):
    r = random.Random(4)
    rows = [(i, prose(60, i) + (" " + r.choice(("Vilenesss!", "grotbag", "scumlike")) + " " + prose(20, i) if i % 6 == 0 else "")) for i in range(900)] + EDGES
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)] + [(None, 1, 1), (901, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.rated(spark, docs(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    own = got[got.doc_id.notna() & (got.doc_id < 900)]
    assert (own.held_out == own.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 5 == 0)).all()
    assert (own.predicted == (own.doc_id % 6 == 0)).mean() > 0.99
    none = toxicity.rated(spark, docs(spark, rows[:5]), labels.limit(0)).toPandas()
    assert (none.predicted == 0).all()


def test_every_toxic_word_of_a_large_lexicon_votes():
    x, y = [], []
    for i in range(3000):
        r = random.Random(i)
        x.append(np.array(sorted({*r.sample(range(1000, 3000), 30), *([i // 10] if i % 10 == 0 else []), *([10 + i % 200] if i % 10 == 5 else [])}), np.int32))
        y.append(int(i % 10 in (0, 5)))
    # 10 + i % 200: twenty words of fifteen toxic texts each; i // 10: one text a word, no voter of its own
    for i in range(600):
        x.append(np.array(sorted({*random.Random(9000 + i).sample(range(1000, 3000), 30), 500 + i // 4}), np.int32))
        y.append(1)
    y = np.array(y)
    rows, cols = np.repeat(np.arange(len(x), dtype=np.int32), [len(r) for r in x]), np.concatenate(x)
    voters = toxicity.choose_voters(rows, cols, y)
    assert set(range(500, 650)) <= set(voters.tolist())
    w, _ = toxicity.fit(x, y)
    assert (w[500:650] > 0).all()


def test_features_that_are_toxic_by_chance_do_not_vote():
    r = np.random.default_rng(3)
    y = (r.random(4000) < 0.1).astype(int)
    x = [np.unique(np.append(r.integers(1000, 40_000, 60), [7] * int(label and r.random() < 0.1))).astype(np.int32) for label in y]
    rows, cols = np.repeat(np.arange(len(x), dtype=np.int32), [len(f) for f in x]), np.concatenate(x)
    assert toxicity.choose_voters(rows, cols, y).tolist() == [7]


def test_label_model_tables_and_posteriors_agree_with_em_by_hand():
    r = np.random.default_rng(6)
    y = r.random(600) < 0.3
    votes = np.stack([(y & (r.random(600) < p)) | (r.random(600) < 0.05) for p in (0.8, 0.6, 0.5)], 1).astype(float)
    got, cliques = toxicity.label_model(votes, 0.3, rounds=400)
    assert sorted(cliques) == [(0,), (1,), (2,), (3,)]
    full = np.column_stack([votes, votes.sum(1) == 0])  # the last voter speaks where no other does
    post = np.where(votes.sum(1) > 0, 0.9, 0.02)
    for _ in range(800):
        odds = np.full(600, np.log(0.3 / 0.7))
        for j in range(4):
            table = [np.array([((1 - full[:, j]) * w).sum() + 0.05, (full[:, j] * w).sum() + 0.05]) for w in (post, 1 - post)]
            logs = [np.log(c / c.sum()) for c in table]
            odds += (logs[0] - logs[1])[full[:, j].astype(int)]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    assert np.abs(post - got).max() < 0.01


def test_toxicity_learns_from_all_features_of_a_long_text():
    import pyarrow as pa

    long = " ".join("".join(chr(97 + int(c)) for c in f"{i:05d}") for i in range(4000))
    (got,) = toxicity._learn_rows([pa.record_batch({"text": [long, "ab"], "toxic": pa.array([1, 0], pa.int32())})])
    want = {int(k) for k in toxicity.features(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))[0]}
    assert len(want) > 2000 and got.column("features").to_pylist()[0] == sorted(want)


def test_label_model_separates_and_ties_correlated_voters():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    a = (y & (r.random(4000) < 0.7)) | (r.random(4000) < 0.02)
    votes = np.stack([a, a & (r.random(4000) < 0.97), (y & (r.random(4000) < 0.6)) | (r.random(4000) < 0.02), (y & (r.random(4000) < 0.5)) | (r.random(4000) < 0.03)], 1).astype(float)
    post, cliques = toxicity.label_model(votes, 0.2)
    assert any({0, 1} <= set(c) for c in cliques)
    assert ((post > 0.5) == y).mean() > 0.9


def test_quality_bradley_terry(spark):
    rows = [(i, prose(80, i) if i % 5 else " ".join(["SHOUT!! " + w.upper() for w in prose(40, i).split()])) for i in range(600)] + EDGES
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(600)] + [(None, 0, 0), (902, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_bt.ranked(spark, docs(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    own = got[got.doc_id.notna() & (got.doc_id < 600)]
    assert (own.held_out == own.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 4 == 2)).all()
    assert (own.predicted == (own.doc_id % 5 > 0)).mean() > 0.99
    assert (quality_bt.ranked(spark, docs(spark, rows), labels.limit(0)).toPandas().predicted == 1).all()


def test_quality_weights_are_the_optimum_and_the_cut_is_the_quantile():
    r = np.random.default_rng(2)
    y = (r.random(300) < 0.7).astype(int)
    x = r.normal(0, 0.05, (300, quality_bt.WIDTH)) + 0.05 * y[:, None] * (np.arange(quality_bt.WIDTH) % 7 == 0)
    got = quality_bt.fit(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 0.02), -6, 6)
    a, b = quality_bt.pairs_of(y)
    assert (y[a] == 1).all() and (y[b] == 0).all()
    grad = np.zeros(quality_bt.WIDTH)  # of the mean loss log(1 + exp(-w . d)) and the penalty, pair by pair
    for i, j in zip(a, b):
        d = z[i] - z[j]
        grad -= d / (1 + np.exp(d @ got["w"])) / len(a)
    assert np.abs(grad + quality_bt.L2 * got["w"]).max() < 1e-6
    s = np.sort(z @ got["w"])
    assert abs((s < got["at"]).mean() - (y == 0).mean()) < 0.01


def test_gram_shares_count_what_a_loop_counts():
    texts = ["", "abc", "abcd", "AbCdabcd é", "x" * 40]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(b) for b in raw])
    both = quality_bt.gram_shares(np.frombuffer(b"".join(raw), np.uint8), offs)
    for b, row in zip(raw, both):
        alone = quality_bt.gram_shares(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert np.allclose(row, alone) and (row**2).sum() == pytest.approx(1.0 if len(b) >= 4 else 0.0)
        kinds = {b.lower()[i : i + 4] for i in range(len(b) - 3)}
        assert (row > 0).sum() == len(kinds) or len(kinds) > 3


def test_language(spark):
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éèçab", "dd": "жзийк"}
    r = random.Random(9)
    rows = [(i, lang, " ".join("".join(r.choice(s) for _ in range(6)) for _ in range(30))) for i, (lang, s) in enumerate(list(letters.items()) * 80)]
    rows += [(800, "aa", None), (801, None, "123 !?"), (802, None, ""), (None, "bb", "cdefg"), (803, None, "Éé" * 9), (804, "zz", "123")]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = langid.identified(spark, df).toPandas().set_index("doc_id")
    assert list(got.loc[[800, 801, 802, 804]].lang_pred) == ["und"] * 4 and (got.loc[[800, 801, 802]].score == 0).all()
    held = [(i, lang) for i, lang, _ in rows if i is not None and i < 800 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got.loc[i].lang_pred == lang for i, lang in held]) > 0.95 and got.loc[[i for i, _ in held]].held_out.all()
    assert got.loc[803].lang_pred == "cc" and got.score.between(0, 1).all()
    assert set(langid.identified(spark, df.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
