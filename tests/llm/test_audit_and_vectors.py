"""Filter audit, vector codes and embedding near-dedup against brute force, with edge rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import cover_tree, filter_audit, vector_codes
from tidemark.llm import kernels as K
from tidemark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_embedding_dedup"])
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(name, queries()[name], oracle_sql()[name])


# Vector codes ---------------------------------------------------------------------


def lloyd(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, vector) to vec_id, code, error, label_error, digest, with Python's own integers."""
    whole = [(i, l, [max(-(1 << 24), min(1 << 24, int(np.floor(float(x) * 256)))) for x in v]) for i, l, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for dims in {len(v) for _, _, v in whole}:
        mine = [w for w in whole if len(w[2]) == dims]
        cut = [k * dims // parts for k in range(parts + 1)]
        first = sorted(mine, key=lambda w: (w[0] is None, w[0] or 0, w[2]))[:entries]
        books = [[w[2][cut[p] : cut[p + 1]] for w in first] for p in range(parts)]

        def near(v, p):
            x = v[cut[p] : cut[p + 1]]
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            at = [[near(v, p)[1] for p in range(parts)] for _, _, v in mine]
            for p in range(parts):
                for k in range(len(books[p])):
                    held = [w[2][cut[p] : cut[p + 1]] for w, a in zip(mine, at, strict=True) if a[p] == k]
                    if held:
                        books[p][k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, l, v in mine:
            best = [near(v, p) for p in range(parts)]
            out.append((i, l, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), digest))
    by_label = defaultdict(int)
    for _, l, _, e, _ in out:
        by_label[l] += e
    return sorted(((i, c, e, by_label[l], d) for i, l, c, e, d in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, whole string, tag string, code int, error int, n int"


def vectors(spark, rows, partitions=3):
    """Vectors with extra columns of names that operators use inside."""
    return spark.createDataFrame([(*r[:1], r[2], r[1], "w", "t", 1, 2, 3) for r in rows], VECTORS).repartition(partitions)


def odd_vectors(rng, n, dims=32):
    f32 = lambda x: float(np.float32(x))
    rows = [(k, rng.choice([0, 0, 0, 1, 2, None]), [f32(rng.gauss(0, 1)) for _ in range(dims)]) for k in range(n)]
    rows += [(n, 1, None), (n + 1, 1, [float("nan")] * dims), (n + 2, 1, [float("inf")] + [0.0] * (dims - 1)), (n + 3, 1, [None] + [1.0] * (dims - 1))]
    rows += [(n + 4, 1, [0.0] * dims), (n + 5, 1, []), (n + 6, 1, [f32(0.5)] * 5), (n + 7, 1, [f32(0.25)] * 5), (n + 8, 0, [1e30] * dims), (None, 2, [f32(0.3)] * dims), rows[0], rows[0], (3, 0, rows[5][2])]
    return rows


def test_codes_equal_plain_lloyd(spark):
    rows = odd_vectors(random.Random(2), 150)
    got = vector_codes.compress(vectors(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows)
    assert vector_codes.compress(vectors(spark, rows).where("false")).collect() == []


def test_later_rounds_move_only_what_changed(spark):
    """The sums after each round are those of the codes at hand, though only changed parts are read."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 8))
    old, new = rng.integers(0, 4, (2, 400, 4)).astype(np.uint8)
    new[:200] = old[:200]

    def sums(first, second):
        batch = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(first, pa.binary()), pa.array([c.tobytes() for c in second], pa.binary())], names=["whole", "old", "code"])
        out = pa.Table.from_batches(vector_codes._moves(4, 4)(iter([batch]))).to_pylist()
        return {(r["part"], r["entry"], r["place"]): r["total"] for r in out}

    start, step, end = sums([None] * 400, old), sums([c.tobytes() for c in old], new), sums([None] * 400, new)
    total = {k: start.get(k, 0) + step.get(k, 0) for k in start | step}
    assert {k: v for k, v in total.items() if v} == end
    assert sums([c.tobytes() for c in old], old) == {}


def test_nearest_entries_are_exact_for_large_integers():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 24):
        x, book = rng.integers(-most, most, (50, 4)), rng.integers(-most, most, (9, 4))
        book[5] = book[2]
        at, far = vector_codes.nearest_entries(x, book)
        brute = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in book] for v in x]
        assert at.tolist() == [r.index(min(r)) for r in brute] and far.tolist() == [min(r) for r in brute]


# Filter audit ---------------------------------------------------------------------


def audit(docs, labels):
    """Rows of the audit, order by order and document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null names no document
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))

    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return "".join(
            c
            for c, f in zip(
                "ABCDE",
                (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]),
                strict=True,
            )
            if f
        )

    out = []
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(i, fails(i, text)) for i, text, lang in docs if (lang or "") == part]
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                steps.append((part, order, k + 1, len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == c for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), c))
        total = defaultdict(int)
        for s in steps:
            total[s[-1]] += s[4]
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_every_order_by_hand(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "short", "A#B", "é" * 10]
    for k in range(40):
        words = [rng.choice(["der", "the", "Zeit", "É", "x|y", "LOUD", f"w{rng.randrange(500)}"]) if rng.random() < 0.5 else f"v{k}{n}" for n in range(rng.choice([5, 150, 250]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(300)] + [(None, texts[6], "en"), (None, texts[6], "en"), (7, texts[6], "de"), (7, texts[6], "de"), (900, texts[6], "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m", "f", 2) for d in docs], "doc_id long, text string, lang string, mask int, finger string, part string, n int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(table, marks)
    want = audit(docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 600 * 4
    assert filter_audit.audit(table.where("false"), marks).collect() == []
    unmarked = filter_audit.audit(table, marks.where("false"))
    assert sorted(tuple(r) for r in unmarked.collect()) == audit(docs, [])


def test_equal_hashes_of_different_words_are_told_apart():
    texts = [b"aa bb aa cc bb", b"aa aa", b"", b"longer-than-eight-bytes longer-than-eight-bytez longer-than-eight-bytes"]
    body = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    starts, ends, first = K.word_bounds(body, at)
    for hashes in (None, np.zeros(len(starts), np.uint64)):
        assert filter_audit.distinct_words(body, starts, ends, first, hashes).tolist() == [3, 1, 0, 2]


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["Ab", "x", "é", " ", "\n", "#", "\x1c", "word "]) for _ in range(60_000)) + "Z" * 9000
    body = np.frombuffer(text.encode(), np.uint8)
    whole = filter_audit._counts(body, np.array([0, len(body)]))
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 1000)
    pieces = filter_audit._long_counts(body)
    assert {k: int(v[0]) for k, v in pieces.items()} == {k: int(v[0]) for k, v in whole.items()}
    assert whole["points"][0] == len(text) and whole["distinct"][0] == len(set(re.findall(r"[^\x20\x09-\x0D]+", text)))


# Embedding near-dedup -------------------------------------------------------------


def linked(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        return x / np.sqrt(x @ x)

    units = [unit(v) for _, _, v in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] is not None and rows[a][1] == rows[b][1] and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    names = defaultdict(list)
    for k, r in enumerate(rows):
        names[find(k)].append(r[0])
    low = {k: min((i for i in v if i is not None), default=None) for k, v in names.items()}
    return sorted(((r[0], links[k], low[find(k)], r[0] == low[find(k)]) for k, r in enumerate(rows)), key=str)


def clustered(rng, dims=16):
    """Tight and wide groups, chains of steps near the threshold, copies, multiples and loners of several labels."""
    rows = []

    def add(v, label):
        rows.append((len(rows), label, [float(x) for x in np.asarray(v, np.float32)]))

    for label, count, spread in ((0, 150, 0.02), (0, 60, 0.05), (1, 40, 0.03), (2, 3, 0.01)):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(count):
            add(centre + spread * rng.normal(size=dims), label)
    at = rng.normal(size=dims)
    for _ in range(40):  # a chain: neighbours are near, ends are not
        add(at, 1)
        at = at / np.linalg.norm(at) + 0.18 * (step := rng.normal(size=dims)) / np.linalg.norm(step)
    copied = rng.normal(size=dims)
    for _ in range(90):
        add(copied, 0)
    for k in range(5):
        add(copied * 2.0**k * 1.5, 0)
    for _ in range(150):
        add(rng.normal(size=dims), int(rng.integers(3)))
    return rows


@pytest.mark.parametrize("block,sample", [(1024, 1 << 21), (16, 1 << 21), (16, 2400), (8, 0)])
def test_links_equal_all_pairs(spark, block, sample):
    """At every size of block and sample: cells, cores, parts and spaces without a sample."""
    rng = np.random.default_rng(3)
    rows = clustered(rng)
    odd = [(None, 0, rows[0][2]), (5000, 0, None), (5001, 0, [0.0] * 16), (5002, 0, [float("nan")] * 16), (5003, 0, [None] * 16), (5004, None, rows[0][2]), (5005, 1, rows[0][2][:8]), (5006, 1, rows[0][2][:8]), (5007, 9, []), (7, 0, rows[300][2]), rows[9], rows[9]]
    rows = rows + odd
    got = cover_tree.near_duplicates(vectors(spark, rows), block=block, sample=sample)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(rows)


def test_no_vectors(spark):
    rows = vectors(spark, [(1, 0, None), (2, None, [1.0])])
    assert cover_tree.near_duplicates(rows.where("false")).collect() == []
    assert sorted(tuple(r) for r in cover_tree.near_duplicates(rows).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_tree_covers_and_nests():
    rng = np.random.default_rng(0)
    unit = cover_tree.units(np.concatenate([rng.normal(size=(200, 6)), rng.normal(size=6) + 0.05 * rng.normal(size=(200, 6)), np.ones((30, 6))]))
    tree = cover_tree.Tree(unit, np.ones(len(unit), np.int64))
    assert sorted(tree.order.tolist()) == list(range(len(unit)))
    for k, kids in enumerate(tree.kids):
        below = tree.order[tree.lo[k] : tree.hi[k]]
        assert below[0] == tree.point[k]
        assert np.linalg.norm(unit[below] - unit[tree.point[k]], axis=1).max() <= tree.radius[k] + 1e-7
        assert (len(kids) == 0) == (len(below) == 1)
        if len(kids):
            assert tree.point[kids[0]] == tree.point[k]
            assert sum(tree.hi[kids] - tree.lo[kids]) == len(below)
            assert (tree.radius[kids] <= tree.radius[k] / 2 * 2 + 1e-9).all() and (2 * tree.radius[kids] <= 2 ** np.ceil(np.log2(max(tree.radius[k], 1e-30))) + 1e-7).all()


def test_a_tight_group_is_counted_without_its_pairs():
    rng = np.random.default_rng(0)
    unit = cover_tree.units(np.ones(32) + 0.005 * rng.normal(size=(1000, 32)))
    tree = cover_tree.Tree(unit, np.ones(1000, np.int64))
    links = cover_tree.traverse(tree, tree, 0.98)
    assert sum(len(a) for a, _ in links.pairs) <= 1000
    assert (links.counts()[0] + links.counts()[1] == 999).all()
