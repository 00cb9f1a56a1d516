"""Every registered query of the store's own operators against its SQL."""

import pytest

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(name, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_pushes_the_cursor_and_takes_the_top(spark, data):
    plan = catalog.queries()["keyset_asc"](spark, data)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(ts" in plan


def test_similarity_has_no_cartesian_product(spark, data):
    plan = catalog.queries()["jaccard_pairs"](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overlaps_are_of_all_turns(spark, data):
    turns = [(r.conv_id, r.turn, set((r.text or "").lower().split())) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    turns = sorted((x for x in turns if x[2]), key=lambda x: x[:2])
    pairs = ((x, y) for k, x in enumerate(turns) for y in turns[k + 1 :])
    brute = {(*x[:2], *y[:2]) for x, y in pairs if len(x[2] & y[2]) / min(len(x[2]), len(y[2])) > 0.3}
    got = {(r.a, r.turn_a, r.b, r.turn_b) for r in catalog.queries()["overlap_turns"](spark, data).collect()}
    assert got == brute and any(x[1] or x[3] for x in got)


def test_overlaps_are_counted_in_tiles(spark, monkeypatch):
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "LEAST_ROWS", 16)
    monkeypatch.setattr(similarity, "PAIRS", 50)
    rows = [(k, " ".join(f"w{(k * k + j * (k % 7 + 1)) % 40}" for j in range(k % 12))) for k in range(150)] + [(900, None), (901, " "), (902, "W1 w1 w2"), (903, "w1 w2 alone")]
    out = similarity.overlapping_blocks(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    sets = [(k, set((t or "").lower().split())) for k, t in rows]
    pairs = ((x, y) for x in sets for y in sets if x[0] < y[0] and x[1] and y[1])
    brute = {(x[0], y[0], s) for x, y in pairs if (s := len(x[1] & y[1]) / min(len(x[1]), len(y[1]))) > 0.3}
    assert {tuple(r) for r in out.collect()} == brute and (902, 903, 1.0) in brute
    assert out.count() == len(brute)
    # no word meets another in a join: frequent words would make rows with the square of their blocks
    assert "Join" not in out._jdf.queryExecution().toString()


def test_overlaps_shuffle_a_block_once(spark, monkeypatch):
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "PART_ROWS", 10)
    held, stored = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: held.append(stored(df, name)) or held[-1])
    rows = [(k, " ".join(f"w{(k * k + j * 3) % 50}" for j in range(k % 9))) for k in range(95)] + [(900, None)]
    out = similarity.overlapping_blocks(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    sets = [(k, set((t or "").split())) for k, t in rows]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted((a, b, s) for a, x in sets for b, y in sets if a < b and x and y and (s := len(x & y) / min(len(x), len(y))) > 0.3)
    # ten parts, and no copy of a block for each
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert held[0].count() == 10 and held[0].select("part").distinct().count() == 10
