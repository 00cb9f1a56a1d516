"""Edge fixtures and small loops for operators that SQL doesn't cover."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions.stemming import stem
from tidemark.operators import context, counting, fulltext, fuzzy, listing, maintenance, search, similarity, timeline
from tidemark.sources import files
from tidemark.streaming import absorb, frames, status


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_equal_times_page_by_id(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, 3), (at, 1), (at, 2)], "t timestamp, id int")
    assert values(listing.page(df, "t", "id", cursor=1), "id") == [(2,), (3,)]
    assert values(listing.page(df, "t", "id", cursor=2, ascending=False), "id") == [(1,)]
    with pytest.raises(listing.NotFound):
        listing.page(df, "t", "id", cursor=9)


def test_ranges_and_lookups(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "id int, is_deleted boolean").withColumn("owner", F.lit("a"))
    with pytest.raises(ValueError):
        listing.within(df, "id", 3, 1)
    assert values(listing.within(df, "id", 1, 3), "id") == [(2,)]
    assert sorted(values(listing.scope(df, "owner", "a", "is_deleted"), "id")) == [(1,), (3,)]
    with pytest.raises(ValueError):
        listing.scope(df, "owner", None)
    with pytest.raises(listing.NotFound):
        listing.one(df, id=7)
    assert listing.exists(df, id=2) and not listing.exists(df, id=7)
    with pytest.raises(listing.NotFound):
        listing.in_asked_order(df, "id", [1, 9])


def test_repeated_tags_ask_the_impossible(spark):
    bridge = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b"), ("z", "a"), ("z", "b"), ("z", "c")], "id string, tag string")
    owners = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    assert sorted(values(listing.with_all_tags(owners, bridge, "id", ["a", "b"]), "id")) == [("y",), ("z",)]
    assert values(listing.with_all_tags(owners, bridge, "id", ["a", "a"]), "id") == []
    assert sorted(values(listing.with_any_tag(owners, bridge, "id", ["c", "a"]), "id")) == [("x",), ("y",), ("z",)]


def test_cleaning(spark):
    df = spark.createDataFrame([("A-b  c!",), ("",), (None,), ("?!",)], "t string")
    assert values(df, X.clean(F.col("t")), X.tokens(F.col("t"))) == [("a b c", []), ("", []), ("", []), ("", [])]
    wild = spark.createDataFrame([("100%",), ("1000",), (None,)], "t string")
    assert values(wild, X.contains(F.col("t"), "0%")) == [(True,), (False,), (None,)]
    assert values(wild, X.contains(F.col("t"), "0%", wildcards=True)) == [(True,), (True,), (None,)]


def bm25(texts, query):
    import re
    import string

    def toks(t):
        return [w for w in re.sub(r"\s+", " ", t.translate({ord(c): " " for c in string.punctuation}).lower()).strip().split() if len(w) > 1]

    docs = {k: toks(t) for k, t in texts.items() if t and toks(t)}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    score = {}
    for k, d in docs.items():
        score[k] = sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for q in toks(query))
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_equals_a_loop(spark):
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice(["common"] * 4 + ["rare", "apple", "pear", "x"]) for _ in range(rng.randint(0, 12))) for k in range(40)} | {99: None}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    for query in ("common pear pear", "rare", "missing"):
        got = values(search.bm25(df, "t", query, "id", None), "id", "score")
        want = bm25(texts, query)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want])
    assert [g[0] for g in values(search.bm25(df, "t", "? !", "id", 3), "id")] == sorted(k for k, _ in want)[:3]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])], "id int, v array<float>")
    got = values(search.by_vector(df, "v", [1.0, 0.0], "id"), "id", "distance")
    assert [g[0] for g in got] == [1, 4, 6, 2, 3, 5] and got[0][1] == 0 and got[3][1] is None
    with pytest.raises(ValueError):
        search.by_vector(df, "v", [0.0] * 5000, "id")
    V.register(spark)
    assert spark.sql("select cosine_distance(array(1d, 0d), array(0d, 2d))").first()[0] == 1
    text = spark.createDataFrame([("[1, 2.5]",), ("1,2",), ("1 2",), ("x",)], "t string")
    assert values(text, V.parse_text(F.col("t"))) == [([1.0, 2.5],), ([1.0, 2.0],), ([1.0, 2.0],), (None,)]
    import base64

    blob = base64.b64encode(np.array([1.5, -2], "<f4").tobytes()).decode()
    assert values(spark.createDataFrame([(blob,)], "t string"), V.from_base64("t")) == [([1.5, -2.0],)]


def test_partial_ratio():
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.partial_ratio("", "a") == 0 and fuzzy.partial_ratio("", "") == 100

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                above = row[j]
                row[j] = corner + 1 if x == y else max(row[j], row[j - 1])
                corner = above
        return row[-1]

    rng = random.Random(2)
    for _ in range(60):
        a, b = sorted(("".join(rng.choice("abé ") for _ in range(rng.randint(1, 90))) for _ in range(2)), key=len)
        want = max(200 * lcs(a, b[max(0, k) : k + len(a)]) / (len(a) + min(k + len(a), len(b)) - max(0, k)) for k in range(1 - len(a), len(b)))
        assert abs(fuzzy.partial_ratio(a, b) - want) < 1e-9


def test_stems():
    for word, want in {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit",
        "hopefulness": "hope", "formality": "formal", "triplicate": "triplic", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "rate": "rate",
        "controll": "control", "roll": "roll", "is": "is",
    }.items():
        assert stem(word) == want, word


def test_full_text_and_becomes_or(spark):
    df = spark.createDataFrame([(k, "red apple" if k < 3 else "red", k) for k in range(14)], "id int, t string, at int")
    got = values(fulltext.search(df, ["t"], "red apples", "at", "id", 20), "id", "score")
    assert len(got) == 14 and {g[0] for g in got[:3]} == {0, 1, 2}  # three rows with both are too few
    assert len(values(fulltext.search(df, ["t"], "red apples", "at", "id", 3), "id")) == 3
    near, far = ([("a", 1.0), ("b", 1.0)], [("a", 1.0), ("x", 1.0), ("x", 1.0), ("b", 1.0)])
    query = [("a", False), ("b", False)]
    assert fulltext.cover_rank(near, query, True) > fulltext.cover_rank(far, query, True) > 0
    assert fulltext.cover_rank([("a", 1.0)], query, True) == 0 < fulltext.cover_rank([("a", 1.0)], query, False)


def test_stores_are_searched_in_order_and_unknown_ones_refused(spark):
    base = "id string, summary string, caption string, created_at timestamp, occurred_at timestamp, sensitivity string, last_modify struct<timestamp: string, operation: string>"
    rows = [(str(k), f"green tea {k}", f"green secret {k}", datetime(2024, 1, 1), datetime(2024, 1, 1 + k), "high" if k else "low", (f"2024-01-0{k + 1}", "create")) for k in range(3)]
    df = spark.createDataFrame(rows, base)
    got = search.search_all({"vault": df, "episodic": df}, "tea green", limit=2)
    assert [r["store"] for r in got.collect()] == ["episodic"] * 2 + ["vault"] * 2
    assert values(search.search_store(df, "episodic", "", limit=1), "id") == [("2",)]
    for bad in (("nowhere", "bm25"), ("episodic", "magic")):
        with pytest.raises(ValueError):
            search.search_store(df, bad[0], "tea", bad[1])
    with pytest.raises(ValueError):
        search.search_store(df, "vault", "tea", "embedding", "secret_value", [1.0])
    bundle = search.retrieval_bundle({"vault": df, "episodic": df}, "green", limit=5).collect()
    assert {r["total"] for r in bundle if r["store"] == "vault"} == {1}
    assert sum(r["part"] == "recent" for r in bundle) == 3


def test_similarity_is_strict(spark):
    words = [f"w{k}" for k in range(20)]
    exact9, exact7 = (" ".join(words[:9]), " ".join(words[:10])), (" ".join(words[10:17]), " ".join(words[10:20]))
    df = spark.createDataFrame(list(enumerate([*exact9, *exact7, "", ""])), "id int, t string")
    got = values(similarity.similar_pairs(similarity.word_sets(df, "id", F.col("t"))), "a", "b", "similarity")
    assert [(a, b) for a, b, _ in got] == [(0, 1)] and similarity.DUPLICATE == got[0][2]
    report = values(similarity.redundancy_report(df, "id", F.col("t")), "kind", "pairs")
    assert report == [("similar", 1)]


def test_similar_pairs_equal_a_loop(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.sample("abcdefghijkl", rng.randint(1, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(similarity.word_sets(df, "id", F.col("t"))).collect()}
    reps = {}
    for k, t in enumerate(texts):
        reps.setdefault(frozenset(t.split()), k)
    want = {(min(i, j), max(i, j)) for a, i in reps.items() for b, j in reps.items() if i < j and len(a & b) / len(a | b) > 0.7}
    assert got == want


def _near_sets(n):
    """Texts of 0 to 60 words in near copies, of words that most, some and single texts have."""
    out = []
    for k in range(n):
        base = [f"w{(k // 6 * 31 + j * j) % (40 + k // 6 * 9)}" for j in range(k // 6 * 7 % 60)]
        out.append((k, " ".join(base[: max(0, len(base) - k % 6 // 2)] + [f"own{k}"] * (k % 3))))
    return [*out, (n, None), (n + 1, " "), (n + 2, "One"), (n + 3, "one ONE")]


@pytest.mark.parametrize("common, part", [(1 << 20, 1 << 24), (10, 300), (0, 40)])
def test_similar_pairs_are_verified_in_tiles(spark, monkeypatch, common, part):
    monkeypatch.setattr(similarity, "COMMON", common)
    monkeypatch.setattr(similarity, "PART_WORDS", part)
    rows = _near_sets(240)
    held = {}
    for k, t in rows:
        if words := frozenset((t or "").lower().split()):
            held.setdefault(words, []).append(k)
    sets = sorted((min(k), w, len(k)) for w, k in held.items())
    want = {(a, b, s, n, m) for i, (a, v, n) in enumerate(sets) for b, w, m in sets[i + 1 :] if (s := len(v & w) / len(v | w)) > 0.7}
    df = spark.createDataFrame(rows, "id int, t string").repartition(5)
    out = similarity.similar_pairs(similarity.word_sets(df, "id", F.col("t")))
    got = [tuple(r) for r in out.select("a", "b", "similarity", "copies_a", "copies_b").collect()]
    assert len(got) == len(want) > 100 and set(got) == want
    # what only meets is shuffled without its words, which come once for each tile
    assert not [line for line in out._jdf.queryExecution().toString().split("\n") if "Join" in line and "words" in line]
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "words" not in joined and joined.count("Join") == 1


def test_a_report_counts_pairs_without_their_words(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART_WORDS", 200)
    rows = _near_sets(120)
    sets = [set((t or "").lower().split()) for _, t in rows]
    shares = [len(v & w) / len(v | w) for i, v in enumerate(sets) for w in sets[i + 1 :] if v and w]
    want = {"duplicate": sum(s > 0.9 for s in shares), "similar": sum(0.7 < s <= 0.9 for s in shares)}
    report = similarity.redundancy_report(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t"))
    assert dict(values(report, "kind", "pairs")) == want and min(want.values()) > 0
    assert not [line for line in report._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "words" in line]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_a_report_shuffles_neither_meetings_nor_texts_twice(spark, monkeypatch):
    import bench

    monkeypatch.setattr(similarity, "PART_WORDS", 6000)
    rng = random.Random(3)
    texts = [" ".join(f"word{k}" for k in rng.sample(range(120), 60)) for _ in range(600)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    before = set(bench.stages(spark))
    report = similarity.redundancy_report(df, "id", F.col("t"))
    assert dict(values(report, "kind", "pairs")) == {"duplicate": 50}
    # all pairs meet by some word of their prefixes; a set goes packed to where it is grouped, and to each of 7 parts of its size at most
    assert sum(v[0] for k, v in bench.stages(spark).items() if k not in before) < len(texts) * 64 * (2 + 7)
    assert "split" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_more_parts_than_pass_by_one_tile(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART_WORDS", 100)
    monkeypatch.setattr(similarity, "NEAR", 2)
    rng = random.Random(5)
    texts = [" ".join(f"w{w}" for w in rng.sample(range(14), rng.randint(9, 12))) for _ in range(150)]
    reps = {}
    for k, t in enumerate(texts):
        reps.setdefault(frozenset(t.split()), k)
    want = {(min(i, j), max(i, j)) for a, i in reps.items() for b, j in reps.items() if i < j and len(a & b) / len(a | b) > 0.7}
    sets = similarity.word_sets(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", F.col("t"))
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(sets).collect()]
    assert len(similarity._edges(sets)) > 8 and len(got) == len(want) > 100 and set(got) == want


def test_ranks_are_packed_and_unpacked():
    rng = np.random.default_rng(4)
    for top in (3, 200, 1 << 20, (1 << 31) - 1):
        rows = [np.unique(rng.integers(0, top, int(rng.integers(0, 50)))) for _ in range(40)] + [np.empty(0, np.int64), np.array([0]), np.array([top])]
        size = np.array([len(r) for r in rows])
        packed = similarity._packed(size, np.concatenate(rows).astype(np.int64))
        for lo, hi in ((0, len(rows)), (7, 30), (40, 43), (5, 5)):
            got_size, got = similarity._unpacked(packed.slice(lo, hi - lo))
            assert got_size.tolist() == size[lo:hi].tolist()
            assert got.tolist() == [v for r in rows[lo:hi] for v in r.tolist()]


def keep_loop(times, diffs, force):
    out, last = [], None
    for t, d in zip(times, diffs, strict=True):
        kept = last is None or d >= 0.01 or t - last >= force
        last = t if kept else last
        out.append(kept)
    return out


def test_keep_rule(spark):
    at = datetime(2024, 1, 1)
    seconds = [0, 1, 2, 3, 10, 13, 20]
    diffs = [1.0, 0.0, 0.0099, 0.01, 0.001, 0.001, 0.0]
    df = spark.createDataFrame([("m", at + timedelta(seconds=s), k, d) for k, (s, d) in enumerate(zip(seconds, diffs, strict=True))], "m string, t timestamp, id int, d double")
    got = [r["kept"] for r in frames.keep(df, "m", "t", "id", "d").orderBy("id").collect()]
    assert got == keep_loop(seconds, diffs, 10.0) == [True, False, False, True, False, True, False]


def test_image_differences(spark):
    import struct
    import zlib

    def png(gray):
        raw = b"".join(b"\0" + bytes(r) for r in gray)
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        head = struct.pack(">IIBBBBB", len(gray[0]), len(gray), 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    black, white = [[0] * 16] * 16, [[255] * 16] * 16
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", at, 1, png(black)), ("m", at, 2, png(black)), ("m", at, 3, png(white))], "m string, t timestamp, id int, c binary")
    assert [r["difference"] for r in frames.differences(df, "m", "t", "id", "c").orderBy("id").collect()] == [1.0, 0.0, 1.0]


def test_stream_equals_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [(k % 3, at + timedelta(seconds=2 * k), k, rng.choice([0.0, 0.5])) for k in range(60)]
    schema = "m int, t timestamp, id int, d double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    kept = frames.keep_stream(stream, "m", "t", "id", "d")
    status.run_available(kept, str(tmp_path / "out"), "id", str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = frames.keep(spark.createDataFrame(rows, schema), "m", "t", "id", "d")
    assert got.count() == 60
    if sorted(p.name for p in (tmp_path / "in").iterdir()):
        assert sorted(values(got.where("kept"), "id"))[0] == (0,)
        assert len(values(want.where("kept"), "id")) > 0


def test_batch_is_written_once(spark, tmp_path):
    write = status.idempotent_append(str(tmp_path / "t"), "id")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    write(batch, 0)
    write(batch, 0)
    assert sorted(values(spark.read.parquet(str(tmp_path / "t")), "id")) == [(1,), (2,)]


def test_absorb_takes_all_that_waits(spark):
    items = spark.createDataFrame([("a", k // 7, k) for k in range(30)], "u string, poll int, id int")
    got = dict(values(absorb.batches(items, "u", "poll", "id"), "id", "batch"))
    assert [got[k] for k in (0, 20, 21, 29)] == [1, 1, None, None]


def test_upload_timeout_and_prefix(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", 0, "completed"), ("u", 1, "failed"), ("u", 2, "pending"), ("u", 3, "completed")], "u string, p int, s string")
    assert sorted(values(context.ready_prefix(df, ["u"], "p", F.col("s") == "pending"), "p")) == [(0,), (1,)]
    late = spark.createDataFrame([("pending", at), ("pending", at + timedelta(seconds=1)), ("completed", at)], "s string, t timestamp")
    now = F.lit(at + timedelta(seconds=10))
    assert values(late, absorb.upload_state(F.col("s"), F.col("t"), now)) == [("failed",), ("pending",), ("completed",)]


def test_retry():
    calls, waits = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert status.with_retry(work, sleep=waits.append) == 7 and waits == [1.0, 2.0]


def test_local_times(spark):
    df = spark.createDataFrame([("2024-03-10 01:30:00", "America/New_York (UTC-05:00)"), ("2024-07-01 12:00:00.250000", "Europe/Paris (UTC+01:00)"), ("x", "UTC")], "t string, z string")
    got = [r[0] for r in values(df, moments.local_to_utc(F.col("t"), F.col("z")))]
    assert got[0] == datetime(2024, 3, 10, 6, 30) and got[1] == datetime(2024, 7, 1, 10, 0, 0, 250000) and got[2] is None


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    changes = spark.createDataFrame([(1, None, True), (2, "z", False)], "id int, v string, set_v boolean")
    assert sorted(values(maintenance.patch(old, changes, "id"), "id", "v", "w")) == [(1, None, "x"), (2, "b", "y")]
    new = spark.createDataFrame([(3, "c", "z")], "id int, v string, w string")
    assert sorted(values(maintenance.replace(old, old.where("id = 1"), new, "id"), "id")) == [(2,), (3,)]
    with pytest.raises(LookupError):
        maintenance.replace(old, new, new, "id")
    with pytest.raises(maintenance.Conflict):
        maintenance.unique(old.union(old), "id")
    with pytest.raises(ValueError):
        maintenance.required(old.withColumn("q", F.lit(None)), "id", "q")
    pairs = spark.createDataFrame([("a", "1")], "c string, l string")
    clash = spark.createDataFrame([("a", "2")], "c string, l string")
    with pytest.raises(maintenance.Conflict):
        maintenance.add_mapping(pairs, clash, "c", "l")
    assert values(maintenance.add_mapping(pairs, clash, "c", "l", force=True), "c", "l") == [("a", "2")]


def test_context_trim_keeps_others(spark):
    agents = spark.createDataFrame([("A", ["s", "u1", "v1", "u2", "u3"])], "agent_id string, message_ids array<string>")
    messages = spark.createDataFrame([("s", "system", None), ("u1", "user", "u"), ("v1", "user", "v"), ("u2", "user", "u"), ("u3", "user", "u")], "message_id string, role string, user_id string")
    assert values(context.trim(agents, messages, "u", 2), "message_ids") == [(["s", "v1", "u2", "u3"],)]
    assert values(context.attach(agents, ["n"], front=True), "message_ids") == [(["s", "n", "u1", "v1", "u2", "u3"],)]


def test_images_by_source(spark):
    items = spark.createDataFrame([("b", 0, ["i1", "i2"], ["x", "y"]), ("b", 1, ["i3"], ["x"]), ("b", 2, ["i4"], [])], "k string, p int, im array<string>, so array<string>")
    got = dict(values(counting.images_by_source(items, "k", "p", "im", "so"), "source", "images"))
    assert got == {"x": ["i1", "i3"], "y": ["i2"], "Screenshots": ["i4"]}


def test_session_edge(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", at + timedelta(seconds=s), k) for k, s in enumerate((0, 300, 601))], "u string, t timestamp, id int")
    assert [r[0] for r in sorted(values(timeline.session_numbers(df, ["u"], "t", "id"), "session", "id"), key=lambda r: r[1])] == [1, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"123")
    (tmp_path / "b.unknown").write_bytes(b"4")
    df = files.read_files(spark, str(tmp_path))
    assert sorted(values(df, "name", "size", "type")) == [("a.PNG", 3, "image/png"), ("b.unknown", 1, "application/octet-stream")]
    shots = spark.createDataFrame([(f"file://{tmp_path}/a.PNG",), (f"{tmp_path}/none.png",)], "ref string")
    assert sorted((r["content"] is None) for r in files.with_content(shots, df, "ref").collect()) == [False, True]
    assert values(df.where("name = 'a.PNG'"), files.data_uri(F.col("path"), F.col("content"))) == [("data:image/png;base64,MTIz",)]


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"], {"k": "v"})], "id int, a array<string>, m map<string, string>")
    files.backup({"t": df}, str(tmp_path))
    assert files.restore(spark, str(tmp_path), ["t"])["t"].collect() == df.collect()
    assert values(files.flattened(df), "a", "m") == [('["x"]', '{"k":"v"}')]
