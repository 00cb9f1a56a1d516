"""Operators of the training-data subpackage against brute force and libraries, with edge rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontam, html_main, jaccard, langid, licenses, mixing, pii, suffix_dedup
from tidemark.llm import kernels as K
from tidemark.llm.components import connected, star_forest
from tidemark.skew import attach, hot_keys

#: Names that operators use inside: they must not clash.
CLASH = "id long, node long, tag string, text_hash long, size long, runs string, block string, found string, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def table(spark, rows, partitions: int = 3):
    """Documents (doc_id, text[, lang, source]) with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), 1, 2, "t", 3, 4, "r", "b", "f", "l") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(rng, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", ","]) for _ in range(words))


def edited(rng, text: str, share: float) -> str:
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split(" "))


EDGE = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "two words"), (906, "..."), (None, "a null id"), (907, "é" * 300), (908, "\x00 \x1c x")]


# Kernels --------------------------------------------------------------------------


def test_words_and_hashes_follow_the_pattern():
    texts = ["Ab  c\tD", "", "  ", "é x y", "a\x0bb\x1cc", "Z" * 50]
    body, at = K.utf8_rows(pa.array(texts))
    hashes, first = K.word_hashes(body, at)
    low = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in low]
    names = dict(zip([w for x in low for w in x], hashes.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
    again, _ = K.word_hashes(*K.utf8_rows(pa.array(["c", "ab"])))
    assert again.tolist() == [names["c"], names["ab"]]


def test_hashes_are_not_linear_in_the_bytes():
    """Thue-Morse strings are equal to any polynomial modulo a power of two."""
    morse = b"a"
    while len(morse) < 4096:
        morse += morse.translate(bytes.maketrans(b"ab", b"ba"))
    body = np.frombuffer(morse + morse.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    for n in (1, 8, 64, 1024, 2048, 4096):
        a, b = K.span_hashes(body, np.array([0, 4096]), np.array([n, 4096 + n]))
        assert a != b
    rng = random.Random(1)
    spans = [(s, s + rng.choice([0, 1, 7, 8, 9, 31, 32, 33, 100])) for s in (rng.randrange(7000) for _ in range(3000))]
    hashes = K.span_hashes(body, np.array([s for s, _ in spans]), np.array([e for _, e in spans]))
    named: dict = {}
    for (s, e), h in zip(spans, hashes.tolist(), strict=True):
        assert named.setdefault(body[s:e].tobytes(), h) == h
    assert len(set(named.values())) == len(named)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_equals_a_join(spark, how):
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 0, 1, 2, *range(3, 60), None]), k) for k in range(3000)]
    left = spark.createDataFrame(rows, "key long, v long")
    right = spark.createDataFrame([(k, k * 10, None if k % 3 else "x") for k in [0, 2, *range(10, 90)]], "key long, w long, s string")
    for hot in (hot_keys(left, "key", 3000), hot_keys(left, "key", 3000).where("false"), hot_keys(left, "key", 0)):
        got = attach(left, right, "key", hot, how).collect()
        want = left.join(right, "key", how).select("key", "v", "w", "s").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert hot_keys(left, "key", 10**6).collect() == []


def test_columns_with_offsets_nulls_and_slices():
    column = pa.array(["xx", None, "yé", ""]).slice(1)
    body, at = K.utf8_rows(column)
    assert body.tobytes().decode() == "yé" and at.tolist() == [0, 0, 3, 3]
    assert [(i, j) for i, j, _, _ in K.chunks(pa.array(["a" * 5, "b" * 50, "c"]), 10)] == [(0, 1), (1, 2), (2, 3)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["a"]: r["b"] for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = star_forest(np.array([3, 2, 9]), np.array([2, 1, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 3: 1}


# 1 --------------------------------------------------------------------------------


def repeated_brute(texts: list[str | None]) -> list[tuple]:
    seen: Counter = Counter()
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        seen.update(b[s : s + 200] for s in range(len(b) - 199))
    out = []
    for b in raws:
        mark = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                mark[s : s + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1]))
        out.append((len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8192, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 60)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, edited(rng, base[k % 6], 0.02)) for k in range(12)]
    rows += [(30 + k, f"{prose(rng, 20)}\n{shared}\n{prose(rng, 20)}") for k in range(8)]
    rows += [(40, "ab" * 400), (41, "é " * 300), (42, base[0]), (43, base[0]), (43, base[0]), (43, base[1]), (44, shared[:199]), (45, shared[:200]), *EDGE]
    got = sorted(((str(r[0]), *r[1:]) for r in suffix_dedup.dedup_digest(table(spark, rows)).collect()))
    want = sorted((str(i), *x) for (i, _), x in zip(rows, repeated_brute([t for _, t in rows]), strict=True))
    assert got == want


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup_digest(table(spark, [])).count() == 0


def test_interval_expansion_finds_all_repeats():
    rng = random.Random(3)
    for _ in range(15):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 700))) for _ in range(4)]
        texts = ["".join(p[rng.randint(0, 50) :] for p in rng.choices(parts, k=2)).encode() for _ in range(5)]
        raw = np.frombuffer(b"\xff".join([b"", *texts, b""]), np.uint8) + np.uint8(1)
        where = defaultdict(list)
        for s in range(len(raw) - 199):
            if 0 not in (w := raw[s : s + 200].tobytes()):
                where[w].append(s)
        assert suffix_dedup.repeated_starts(raw).tolist() == sorted(s for x in where.values() if len(x) > 1 for s in x)


# 2 --------------------------------------------------------------------------------


def test_neighbours_have_exact_scores_and_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[7]
    rows = [(int(k), [float(v) for v in row], 1) for k, row in enumerate(x)]
    odd = [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] + [1.0] * 15, 1), (2300, [None] + [1.0] * 15, 1), (2400, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, list int").repartition(4)
    got = ann.nearest(df, rerank=32).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(x)), far))[:10]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        assert np.allclose(part["score"], far[part["vec_id"]])
        assert sorted(zip(part["score"], part["vec_id"], strict=True)) == list(zip(part["score"], part["vec_id"], strict=True))
        hits += len(set(best) & set(part["vec_id"]))
        total += 10
    assert set(got["query_id"]) == set(range(0, 1500, 100)) and hits / total >= 0.9
    assert got[got["query_id"] == 200].sort_values("rank")["vec_id"].tolist() == [7, *range(201, 210)]


def test_probes_follow_the_data(spark):
    """Few lists where vectors are clustered; the exact search equals brute force."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(60, 32))
    x = centers[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 32))
    index = ann.Index.fit(x, 63)
    assert index.probes(x, 10) <= 6
    noise = rng.normal(size=(4000, 32))
    assert ann.Index.fit(noise, 63).probes(noise, 10) > 20
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")

    def found(**options):
        return {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, **options).collect()}

    want = {}
    for q in range(0, 4000, 100):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        want |= {(q, k + 1): int(v) for k, v in enumerate(np.argsort(far)[:10])}
    assert found(exact=True) == want
    got = found()
    assert sum(got[k] == v for k, v in want.items()) / len(want) >= 0.9


def test_rows_that_the_index_does_not_fit_lose_nothing(spark):
    """Queries beside the clusters that probes are measured on, and crowds much closer than what the codes tell apart."""
    rng = np.random.default_rng(3)
    x = 5 * rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    crowd = rng.choice(4000, 900, replace=False)
    x[crowd] = 40 + 1e-4 * rng.normal(size=(900, 16))
    x[::200] = 10 * rng.normal(size=(20, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df).collect()}
    want = {}
    for q in range(0, 4000, 100):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        want |= {(q, k + 1): int(v) for k, v in enumerate(np.argsort(far)[:10])}
    missed = [k for k, v in want.items() if got.get(k) != v]
    assert not missed, len(missed)


def test_vectors_beyond_single_precision(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e30, 1e25]), (2, [-1e30, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(df).orderBy("rank").collect()] == [1, 3, 2]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], schema)
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


# 3 --------------------------------------------------------------------------------


def test_license_base_equals_a_word_loop(spark):
    rng = random.Random(5)
    pool = ["GNU", "general", "public", "License", "apache", "cc", "by", "BY-NC", "mit", "the", "é", "licenses", "x2"]
    rows = [(k, rng.choice(["", " ", "- "]).join(rng.choices(pool, k=rng.randint(0, 30)) if k % 2 else [])) for k in range(10)]
    rows += [(100 + k, " ".join(rng.choice(pool) + rng.choice(["", ",", "\n"]) for _ in range(40))) for k in range(30)] + [(1, "CC BY CC BY"), *EDGE]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(table(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want.add((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == want


def test_license_notices_with_edits():
    notices = tuple(licenses.NOTICES.items())
    rng = random.Random(8)
    for notice, label in notices:
        for _ in range(5):
            text = list(notice)
            for _ in range(licenses.edits(notice)):
                text[rng.randrange(len(text))] = rng.choice(["", "q"])
            whole = "xx yy " + "".join(text) + " zz"
            assert any(found == label for _, _, found, _ in licenses.fuzzy_spans(whole, notices)), whole
    assert licenses.fuzzy_spans("the weather is fine today and nothing is licensed", notices) == []


def test_every_notice_is_found_beside_a_better_one():
    notices = tuple(licenses.NOTICES.items())
    both = licenses.fuzzy_spans("released under teh mit license released under the mit license", notices)
    assert [(x[2], x[3]) for x in both] == [("mit", 2), ("mit", 0)]
    assert len(licenses.fuzzy_spans("all rights reservd. all rights reserved. all right reserved", notices)) == 3


def test_notice_spans_equal_a_search_of_all_windows():
    """Seeds lose no place: every window of the text, seed or not, gives the same spans."""
    rng = random.Random(19)
    notices = (("mozilla public license", "mpl"), ("all rights reserved", "reserved"))
    patterns = licenses._machine(notices)[1]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            notice = list(rng.choice(notices)[0])
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
            words += ["".join(notice), "".join(rng.choices("ab lice", k=rng.randint(0, 9)))]
        low = " ".join(words)
        want = []
        for (notice, label), pattern in zip(notices, patterns, strict=True):
            wide = len(notice) + 2 * licenses.edits(notice)
            found = {(sum(m.fuzzy_counts), m.start(), m.end()) for lo in range(len(low)) if (m := pattern.search(low, lo, lo + wide))}
            want += [(a, b, label, e) for e, a, b in licenses.apart(found)]
        got = licenses.fuzzy_spans(low, notices)
        # where edits tie, a window may cut a match a character short: places and edits are the same
        assert [(x[2], x[3]) for x in got] == [(x[2], x[3]) for x in sorted(want)], low
        assert all(any(a < d and c < b for c, d, *_ in want) for a, b, *_ in got)


# 4 --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name here</h2></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><div class="cookie-notice"><p>We use cookies a lot.</p></div>
<!-- ad --><div class="ad">Buy this now please</div>
<article><h1>Title &amp; more</h1><p>First   line<br>goes on.</p><form><input>Your name</form><p><b>Second</b> one &#233;.<p>No end tag
<div class="related">Other stories</div><blockquote>Quoted words of someone who had a good deal more to say about all of this than others did</blockquote><p>x</p></article>
<aside>Side words here</aside><section id="comments"><p>Great post, thanks for all of it!</p></section><footer>&copy; owner</footer></body></html>"""


def site_page(rng, main: str = "article", ad: str = ' class="ad"', nested: bool = False) -> tuple[str, str]:
    """A page of a made-up site, and its main text."""
    title, body = prose(rng, rng.randint(3, 9)), [prose(rng, rng.choice([1, 4, 30, 80])) for _ in range(rng.randint(2, 6))]
    links = "".join(f"<li><a href='/{k}'>{prose(rng, 2)}</a></li>" for k in range(rng.randint(3, 9)))
    related = f'<div class="related box">{prose(rng, 12)}</div>'
    blocks = [f"<p>{x}</p>" for x in body]
    blocks.insert(1, related if nested else "")
    page = (
        f"<html><head><title>{title}</title><script>if (a < b) x()</script></head><body><div class='top'><h2>{prose(rng, 3)}</h2><ul>{links}</ul></div><div{ad}>{prose(rng, 7)}</div>"
        f"<{main}><h1>{title}</h1>{''.join(blocks)}</{main}>{'' if nested else related}<div class='foot'>&copy; {prose(rng, 9)}</div></body></html>"
    )
    return page, "\n".join([title, *body])


def test_main_text(spark):
    want = "Title & more\nFirst line goes on.\nSecond one é.\nNo end tag\nQuoted words of someone who had a good deal more to say about all of this than others did\nx"
    rng = random.Random(41)
    site = [(100 + k, f"s{k}", site_page(rng)[0]) for k in range(60)]
    rows = [(k, f"u{k}", PAGE) for k in range(5)] + [(10, None, None), (11, "u", ""), (12, "u", "<p>"), (14, "u", "just words"), (None, "u", PAGE), *site]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, id int")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_main.main_text(df).collect()}
    assert got[0] == ("u0", want, len(want)) and got[None][1] == want
    assert got[10] == (None, "", 0) and got[11][1] == "" and got[12][1] == "" and got[14][1] == "just words"
    assert html_main.main_text(df.where("false")).count() == 0


def test_weights_of_labelled_pages_serve_pages_without_labels():
    """The scan alone finds the main text where neither article nor class names tell it; without it nothing does."""
    rng = random.Random(7)
    weights = html_main.fit_pages([site_page(rng)[0] for _ in range(300)])
    stripped = [site_page(rng, "div", "") for _ in range(200)]
    stripped = [(re.sub(r" class='[a-z]+'| class=\"[a-z ]+\"", "", page), text) for page, text in stripped]
    assert sum(html_main.extract(page, weights) == text for page, text in stripped) >= 190
    blank = [" ".join(html_main.extract(page, html_main.Weights()).split()) for page, _ in stripped]
    assert sum(a == " ".join(text.split()) for a, (_, text) in zip(blank, stripped, strict=True)) < 20
    # boilerplate inside the main text goes by what other pages have beside theirs
    nested = [site_page(rng, "div", ' class="ad"', nested=True) for _ in range(100)]
    assert sum(html_main.extract(page, weights) == text for page, text in nested) >= 95


def test_best_stretch_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        lo, hi = html_main.best_stretch(scores)
        assert sum(scores[lo:hi]) == max([0, *sums.values()])


def test_a_very_long_page():
    page = "<html><body><nav>" + "<a>x</a>" * 1000 + "</nav><div>" + "<p>some words of a page</p>" * 40_000 + "</div></body></html>"
    assert html_main.extract(page, html_main.fit_pages([PAGE])).count("\n") == 39_999


# 5 --------------------------------------------------------------------------------


def mixed_brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 16)
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 80, 400])), None, rng.choice(["a", "b", "b", "b", "é", None])) for k in range(300)]
    rows += [(400, "only one", None, "Z"), (401, None, None, "b"), (400, "only one", None, "Z")]
    got = mixing.mix(table(spark, rows), keep=("source",)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    target = mixed_brute_targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert np.allclose(part["target"], target[source]) and (part["source_size"] == sizes[source]).all()
        assert abs(part["taken"].sum() - target[source]) <= max(2 * mixing.BLOCK, 0.02 * target[source])
    again = mixing.mix(table(spark, rows, 5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, again[key].to_numpy())) == sorted(map(tuple, got[key].to_numpy()))
    assert mixing.mix(table(spark, [])).count() == 0


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(1)
    for sizes in ([rng.randint(1, 3000) for _ in range(9)], [100_000, 1, 1, 2], [5] * 40, [0, 7]):
        total, target = sum(sizes), 1.7 * sum(sizes)
        df = spark.createDataFrame([("s", k, v, total, target) for k, v in enumerate(sizes)], "source string, shard int, shard_size long, source_size long, target double")
        got = {r["shard"]: r["quota"] for r in mixing.apportion(df, 32).collect()}
        seats = int(target / 32 + 0.5)
        bids = sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(sizes) if v for k in range(seats + 1)))[:seats]
        assert {i: n for i, n in got.items() if n} == dict(Counter(i for _, i, _ in bids))


# 6 --------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabularies = pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", " 're", "'", "é", "ß", "中", "😀", "12", "٣", "!", "?!", "<|endoftext|>", "\x85", " ", "the", " of"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for k in range(1500)] + [(5000, "word " * 20000), (5001, "x" * 3000), *EDGE]
    rows.append((rows[0][0], rows[0][1]))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in bpe.token_counts(table(spark, rows), path).collect())
    count = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((str(i), len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, count, strict=True))


# 7 --------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, 40, 3000)) for k in range(12)] + [(50, "too few"), (51, None), (52, "")]
    clean = [(k, prose(rng, 200, 3000)) for k in range(60)]
    planted = [(100 + k, f"{prose(rng, 30, 3000)} {items[k][1].upper()} {prose(rng, 30, 3000)}") for k in range(6)]
    planted += [(200 + k, f"{prose(rng, 30, 3000)} {edited(rng, items[k][1], 0.12)} {prose(rng, 30, 3000)}") for k in range(6, 12)]
    rows = [*clean, *planted, planted[0], *EDGE]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(table(spark, rows), benchmark).collect()}
    assert set(got) == {(100 + k, k) for k in range(6)} | {(200 + k, k) for k in range(6, 12)}
    assert all(got[100 + k, k] == 1 for k in range(6))
    sliced = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table(spark, rows), benchmark, slice_words=100).collect()}
    assert sliced == set(got)
    assert decontam.leaks(table(spark, []), benchmark).count() == 0
    assert decontam.leaks(table(spark, rows), benchmark.where("false")).count() == 0


def test_edited_copies_are_found_beside_full_ones(spark):
    """The n-grams that an edited copy lacks are the item's rarer ones; it is found however often the item leaks whole."""
    rng = random.Random(5)
    words = [f"b{k}" for k in range(40)]
    heavy = " ".join(f"x{k}" if k % 5 == 2 else w for k, w in enumerate(words))
    phrase = f"{prose(rng, 30)} {' '.join(words[:4])} {prose(rng, 60)}"  # four words of the item, not a copy
    rows = [(k, f"{prose(rng, 20)} {' '.join(words)} {prose(rng, 20)}") for k in range(3)] + [(10, f"{prose(rng, 20)} {heavy} {prose(rng, 20)}"), (11, phrase)]
    got = {r["doc_id"]: r["score"] for r in decontam.leaks(table(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 10} and 0.7 <= got[10] < 0.75


def test_leaks_equal_an_alignment_of_everything(spark):
    """Against the recurrence over each whole document and each item that shares four words in a row."""
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(4, 25), 60)) for k in range(8)]
    rows = [(k, f"{prose(rng, 15, 60)} {edited(rng, items[k % 8][1], rng.choice([0, 0.1, 0.3]))} {prose(rng, 15, 60)}") for k in range(40)]
    low = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for k, t in rows}
    item_words = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for k, t in items}

    def grams(w):
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    def score(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row = new
            best = max(best, *row)
        return best / (2 * len(a))

    want = {(d, i): s for d, w in low.items() for i, x in item_words.items() if grams(w) & grams(x) and (s := score(x, w)) >= 0.5}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_text_that_repeats_an_item_is_aligned_in_windows():
    rng = random.Random(4)
    item = prose(rng, 10, 3000)
    index = decontam.Index.build([1], pa.array([item]))
    body, at = K.utf8_rows(pa.array([" ".join([item] * 20_000)]))
    found = list(decontam.passages(index, body, at))
    assert max(len(x[3]) for x in found) <= 40 and len(found) >= 5000
    best, _ = decontam.align([index.words] * 3, [x[3] for x in found[:3]])
    assert best.tolist() == [20, 20, 20]


def test_passages_left_unaligned_cannot_score():
    rng = random.Random(8)
    for _ in range(200):
        a, b = (np.array(rng.choices(range(8), k=rng.randint(1, 15)), np.uint64) for _ in range(2))
        score = decontam.align([a], [b])[0][0] / (decontam.MATCH * len(a))
        assert decontam.reachable(a, b, 0.5) or score < 0.5


def test_alignment_equals_the_recurrence():
    rng = random.Random(3)
    for _ in range(30):
        a, b = (np.array(rng.choices(range(6), k=rng.randint(1, 15)), np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align([a], [b])[0][0] == h.max()


# 8 --------------------------------------------------------------------------------


def jaccard_brute(rows, n, percent):
    """For each row: set size and component by smallest id; rows of one id and different texts are different sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and both:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(s), str(least.get(find(k), i) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def similar_rows(rng):
    base = [prose(rng, rng.randint(20, 150)) for _ in range(12)]
    rows = list(enumerate(base))
    for k, t in enumerate(base):
        rows += [(100 + 10 * k + j, edited(rng, t, share)) for j, share in enumerate((0.005, 0.01, 0.02, 0.03, 0.05))]
    rows += [(400 + k, edited(rng, base[0], 0.02)) for k in range(60)]  # a large group of near copies
    rows += [(500 + k, " ".join("abcdefghijklmnop"[: k % 16 + 1])) for k in range(32)]
    return rows + [(3, base[3]), (3, base[4]), (77, base[0].upper()), *EDGE]


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 256), (5, 80, 256), (3, 90, 8), (2, 50, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = similar_rows(random.Random(n * percent))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(table(spark, rows), n=n, percent=percent).collect())
    assert got == jaccard_brute(rows, n, percent)


def test_near_duplicates_do_not_depend_on_common_grams(spark, monkeypatch):
    rng = random.Random(2)
    line = prose(rng, 40)
    rows = [(k, f"{line} {prose(rng, 30)}") for k in range(80)] + [(200 + k, f"{line} {line[: 60 + k]}") for k in range(10)]
    monkeypatch.setattr(jaccard, "COMMON_DOCS", 2)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(table(spark, rows), n=5, percent=80).collect())
    assert got == jaccard_brute(rows, 5, 80)
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_common_grams_are_seen_in_a_larger_corpus(spark, monkeypatch):
    rng = random.Random(5)
    lines = [prose(rng, 12) for _ in range(20)]
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 32)
    rows = [(k, f"{prose(rng, 4)} {k} {lines[k % 20]} {k} {prose(rng, 4)}") for k in range(4000)]
    shared = {g for line in lines for g in K.shingle_sets(*next(iter(K.chunks(pa.array([line], pa.large_string()))))[2:], 5)[0].tolist()}
    found = jaccard.common_grams(table(spark, rows), 5)
    assert len(shared & set(found.tolist())) > 0.9 * len(shared)
    monkeypatch.setattr(jaccard, "MOST_COMMON", 40)
    assert len(jaccard.common_grams(table(spark, rows), 5)) <= 40


def test_short_rows_with_a_frequent_line_do_not_meet_by_it():
    rng = np.random.default_rng(4)
    line = rng.integers(0, 1 << 60, 16).astype(np.uint64)
    sets = [np.unique(np.concatenate((line, rng.integers(0, 1 << 60, 16).astype(np.uint64)))) for _ in range(300)]
    index = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    sig, row = jaccard.signatures(np.concatenate(sets), index, 80, np.sort(line), np.full(16, 300, np.int32))
    assert set(row.tolist()) == set(range(300))
    assert len(np.unique(sig)) == len(sig)  # half of each row is its own, so none is a candidate of another


def test_rows_of_frequent_n_grams_alone_share_a_signature():
    rng = np.random.default_rng(6)
    for size in (1, 3, 17, 60, 400):
        base = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        sets = [np.sort(rng.permutation(base)[: -(-size * 9 // 10)]) for _ in range(8)]
        index = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        sig, row = jaccard.signatures(np.concatenate(sets), index, 80, base, rng.integers(2, 9, len(base)).astype(np.int32))
        for a in range(8):
            for b in range(a):
                linked = 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
                assert not linked or set(sig[row == a]) & set(sig[row == b])


def test_sparse_product_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
        lose = [rng.choice([0.02, 0.1, 0.5]) for _ in range(rng.integers(2, 30))]
        sets = [np.unique(np.concatenate((base[rng.random(120) > x], rng.integers(0, 1 << 40, rng.integers(1, 20)).astype(np.uint64)))) for x in lose]
        index = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        percent = int(rng.choice([50, 80, 90]))
        got = set(zip(*map(np.ndarray.tolist, jaccard.block_links(np.concatenate(sets), index, percent)), strict=True))
        pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
        assert got == {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))}


def test_every_linked_pair_shares_a_signature():
    rng = random.Random(11)
    for percent in (50, 80, 90):
        for _ in range(150):
            size = rng.randint(1, 60)
            a = set(rng.sample(range(10**6), size))
            b = set(a)
            while True:
                c = set(b)
                c.symmetric_difference_update({rng.choice(sorted(c)) if rng.random() < 0.5 and c else rng.randrange(10**6)})
                if not c or 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
                if rng.random() < 0.05:
                    break
            sets = [np.sort(K.mix64(np.array(sorted(s), np.uint64))) for s in (a, b)]
            index = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            common = np.sort(rng.sample(list(sets[0]), rng.randint(0, size)) or np.zeros(0)).astype(np.uint64)
            sig, row = jaccard.signatures(np.concatenate(sets), index, percent, common)
            assert set(sig[row == 0]) & set(sig[row == 1]), (percent, len(a), len(b))


# 9 --------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_brute(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.A):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    bits = ["a", "é", ".", "@", "@", "x.y", "-", " ", "+", "1", "255", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (988) 555-2485", "(", ")", "mail@a.b", "a..b", "%", "00001"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pii.base_spans(text) == pii_brute(text), text
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_personal_data(spark):
    rng = random.Random(3)
    seeds = [(k, f"{prose(rng, 5)} Please call Ann at +1 (988) 555-{2000 + k} or write. {prose(rng, 3)}") for k in range(9)]
    rows = [*seeds, (50, "Then call ann at AB-77-1234X today"), (51, "Nothing to see at 77AB99ZZ"), (52, "a@b.co 1.2.3.4"), (52, "a@b.co 1.2.3.4"), *EDGE]
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.detect(table(spark, rows)).collect()}
    by_id = {r[0]: r for r in got}
    names = list(PATTERNS)
    for i, t in rows:
        base = pii_brute(t or "")
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert by_id[i][5] == hashlib.sha256(text.encode()).hexdigest()
        assert list(by_id[i][1:5]) == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert set(filter(None, text.split(","))) <= set(by_id[i][6].split(","))
    assert by_id[50][6] == "id:17:28" and by_id[51][6] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(table(spark, rows)).collect()}
    assert masked[52] == "[EMAIL] [IP]" and masked[50] == "Then call ann at [ID] today" and masked[900] is None and masked[903] == "one"
    assert pii.mask(table(spark, rows)).columns == table(spark, rows).columns
    assert pii.detect(table(spark, [])).count() == 0


def test_identifiers_that_no_base_pattern_knows(spark):
    """Customer numbers, passport numbers and keys beside words that stand beside seeds elsewhere are found; like tokens elsewhere are not."""
    rng = random.Random(77)
    leads = ["my account no", "passport", "reach me under", "client id"]
    seeds = [lambda: f"user{rng.randrange(10**6)}@mail.example.org", lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"{rng.randrange(1, 255)}.{rng.randrange(255)}.7.9"]
    rows, want = [], {}
    for k in range(400):
        before = f"{prose(rng, 12)} {rng.choice(leads)}: "
        rows.append((k, before + rng.choice(seeds)() + " " + prose(rng, 12)))
    for k in range(400, 460):
        before, token = f"{prose(rng, 12)} {rng.choice(leads)}: ", f"{rng.choice('KXQ')}{rng.randrange(10**7, 10**8)}"
        rows.append((k, f"{before}{token} {prose(rng, 12)}"))
        want[k] = f"id:{len(before)}:{len(before) + len(token)}"
    for k in range(460, 560):  # part numbers and dates in plain prose
        rows.append((k, f"{prose(rng, 15)} {rng.choice(['PN-1234567', '2024-05-17', 'ISO9001x'])}{rng.randrange(10)} {prose(rng, 15)}"))
    for k in range(560, 600):  # keys in a known format teach what stands before them
        key = f"{rng.getrandbits(160):040x}"
        rows.append((k, f"{prose(rng, 10)} secret = \"{key}\" {prose(rng, 5)}"))
    rows.append((600, 'then secret = "tr0ub4dor" end'))
    want[600] = "id:15:24"
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("id:")] for r in pii.detect(table(spark, rows)).collect()}
    caught = sum(w in got[k] for k, w in want.items())
    assert caught / len(want) >= 0.95 and want[600] in got[600]
    assert not any(got[k] for k in range(560) if k not in want)


def test_contexts_have_no_length_limit():
    text = "alpha" + " " * 500 + "beta" + "-" * 300 + "AB-1234567" + "." * 400 + "gamma delta"
    at = text.index("AB-")
    assert pii.contexts(text, at, at + 10) == ["l:beta", "l:alpha beta", "r:gamma", "r:gamma delta"]
    assert pii.contexts("a 1 AB-12345 2 b", 4, 12) == [] and pii.contexts("É one\nAB-12345\nx", 6, 14) == []


def test_every_confident_pattern_is_tested(spark, monkeypatch):
    """However many contexts qualify, each one's identifiers are found, those of least support too."""
    monkeypatch.setattr(pii, "SLICE_PATTERNS", 2)
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus"]
    rows = [(100 * k + j, f"Please call {name} at +1 (988) 55{k}-{2000 + j} or write.") for k, name in enumerate(names) for j in range(5 + k)]
    rows += [(9000 + k, f"Then {name} at AB-77-1{k}34X today") for k, name in enumerate(names)]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(table(spark, rows)).where("doc_id >= 9000").collect()}
    assert got == {9000 + k: "id:12:23" for k in range(len(names))}


# 10 -------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_edges(spark):
    import zlib

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["der", "die", "und", "nicht"] if k % 2 else ["the", "and", "with"], k=20)), "de" if k % 2 else "en") for k in range(60)] + EDGE
    got = langid.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            if r["doc_id"] < 60:
                assert r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") and 0.9 < r["score"] <= 1
            if r["doc_id"] in (900, 901, 902, 906):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.identify(table(spark, EDGE)).collect()} == {"und"}
    assert langid.identify(table(spark, [])).count() == 0


def test_language_score_does_not_depend_on_neighbours():
    texts = ["Der Hund und die Katze", "", "the cat", "É" * 9, "!"]
    one = [K.utf8_rows(pa.array([t])) for t in texts]
    alone = [langid.features(*x)[0].tolist() for x in one]
    bucket, first = langid.features(*K.utf8_rows(pa.array(texts)))
    assert [bucket[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == alone
