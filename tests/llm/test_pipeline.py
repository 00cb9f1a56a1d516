"""Each stage of the pipeline against brute force, with nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm_exact import EDGE, edited, pii_brute, prose, table

import corpus_pipeline as P
from tidemark.llm import bpe, decontam, html_main, jaccard, langid, licenses, pii, suffix_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    """A folder with a benchmark of four items."""
    rng = random.Random(50)
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, prose(rng, 30, 5000)) for k in range(4)] + [(9, None), (10, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_are_in_order():
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mix"]


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stage_of_nothing_and_of_odd_rows(spark, folder, name):
    stage = dict(P.STAGES)[name]
    for rows in ([], [*EDGE, *EDGE]):
        given = table(spark, rows)
        out = stage(spark, given, folder)
        assert out.count() <= len(rows)
        if name != "mix":
            assert out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
        else:
            assert {"doc_id", "source", "size", "taken"} <= set(out.columns)


def test_language_keeps_what_is_recognised(spark, folder):
    rng = random.Random(2)
    tongues = {"aa": "abcde", "bb": "mnopq"}

    def say(lang, n):
        return " ".join("".join(rng.choices(tongues[lang], k=rng.randint(2, 6))) for _ in range(n))

    rows = [(k, say(lang, 40), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    odd = [(500, None, "aa"), (501, "", "aa"), (502, "12 34 !!", "bb"), (503, say("aa", 50_000), None), (rows[0][0], rows[0][1], "aa")]
    given = table(spark, [*rows, *odd])
    out = P.identify_language(spark, given, folder)
    assert rows_of(out) == sorted([(r[0], r[1]) for r in [*rows, odd[3], odd[4]]], key=str)
    # the stage against the model, row by row
    model = langid.fit(given.where(~langid.held_out("doc_id")))
    sure = langid.predict(given, model, keep=["doc_id"]).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= P.LEAST_LANGUAGE_SCORE))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in sure.collect())


def test_near_duplicates_leave_one_of_each_group(spark, folder):
    rng = random.Random(3)
    base = [prose(rng, 60, 5000) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for j in range(rng.randint(1, 6)):
            rows.append((k * 10 + j, edited(rng, text, rng.choice([0, 0.01, 0.02, 0.3]))))
    rows += [(200, None), (201, None), (202, ""), (203, "a b"), (204, "a b"), (205, "c")]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = sorted(r["doc_id"] for r in P.join_near_duplicates(spark, table(spark, rows), folder).collect())
    assert got == sorted(k for k in root if find(k) == k)


def test_decontamination_drops_copies_and_edited_copies(spark, folder):
    rng = random.Random(4)
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id < 9").orderBy("item_id").collect()]
    clean = [(k, prose(rng, 80, 5000)) for k in range(40)] + [(900, None), (901, "")]
    leaked = [(100 + k, f"{prose(rng, 20)} {items[k % 4].upper()} {prose(rng, 20)}") for k in range(8)] + [(200 + k, f"{prose(rng, 20)} {edited(rng, items[k % 4], 0.1)}") for k in range(8)]
    leaked.append((300, f"{prose(rng, 60_000)} {items[0]} {prose(rng, 10)}"))
    out = P.decontaminate(spark, table(spark, [*clean, *leaked, clean[0]]), folder)
    assert rows_of(out) == sorted([*clean, clean[0]], key=str)


def test_personal_data_is_masked(spark, folder):
    rng = random.Random(5)
    rows = [(k, prose(rng, 30) + rng.choice([" a.b@c.de ", " 10.1.2.3, ", " 4111 1111 1111 1111 ", " +1 (988) 555-2485 ", " "]) + prose(rng, 10)) for k in range(60)] + [(900, None), (901, "")]
    names = ("EMAIL", "IP", "CARD", "PHONE")
    want = []
    for k, text in rows:
        out, at = "", 0
        for a, kind, b in pii_brute(text or ""):
            out, at = out + text[at:a] + f"[{names[kind]}]", b
        want.append((k, None if text is None else out + text[at:]))
    got = P.mask_personal_data(spark, table(spark, [*rows, rows[0]]), folder)
    assert rows_of(got) == sorted([*want, want[0]], key=str)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())


def test_mix_takes_near_its_targets(spark, folder):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(1, 400)), None, rng.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [(900, None, None, "a")]
    out = P.mix_sources(spark, table(spark, rows), folder).collect()
    taken: dict = {}
    for r in out:
        assert 0 < r["taken"] <= 3 * r["size"]
        key = (r["source"], r["target"], r["source_size"])
        taken[key] = taken.get(key, 0) + r["taken"]
    assert len(taken) == 4 and all(abs(n - target) <= 32 * 2 or n == 3 * size for (_, target, size), n in taken.items())


def test_run_is_its_stages_one_after_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, data)
    assert sorted(map(str, P.run(spark, data).collect())) == sorted(map(str, docs.collect()))


# Very long texts --------------------------------------------------------------------------------


def test_very_long_texts(spark):
    """A text of megabytes among short ones: whole results, row by row the same as alone."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    long = " ".join(rng.choices(words, k=300_000))
    rows = [(1, long), (2, long[:-5] + "other"), (3, "short text of five words"), (4, None), (5, "mit license " + long)]
    docs = table(spark, rows)
    sizes = {k: len((t or "").encode()) for k, t in rows}
    one = {r["doc_id"]: r for r in suffix_dedup.dedup_digest(docs).collect()}
    assert {k: r["n_bytes"] for k, r in one.items()} == sizes and one[1]["n_removed"] == sizes[1] and one[3]["n_removed"] == 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, n=3, percent=90).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    scanned = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert scanned[1]["n_words"] == 300_000 and scanned[5]["base_labels"] == "mit" and scanned[1]["base_labels"] == ""
    item = " ".join(long.split(" ")[150_000:150_030])
    leaks = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in leaks} == {1, 2, 5} and all(r["score"] == 1 for r in leaks)
    hidden = table(spark, [(1, long + " a@b.co " + long)])
    assert pii.detect(hidden).first()["n_email"] == 1
    model = langid.fit(table(spark, [(k, prose(rng, 20), "aa") for k in range(50)]))
    assert langid.predict(docs, model).count() == 5
    assert html_main.extract(f"<div><p>{long}</p></div>", html_main.Weights()) == long


def test_tokens_of_a_very_long_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "".join(random.Random(1).choices("ab cde\né", k=1_000_000))
    assert bpe.token_counts(table(spark, [(1, text)]), path).first()["n_tokens"] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
