"""Records, tools, queues and streams: errors, edge rows and what a second run changes."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import tools
from tidemark.operators import entities as E
from tidemark.operators import fuzzy, listing, maintenance, search
from tidemark.sources import files
from tidemark.streaming import absorb, status

ACTOR = {"organization_id": "o1", "user_id": "u1"}
SHAPE = "id string, name string, summary string, organization_id string, user_id string, created_at timestamp_ntz, updated_at timestamp_ntz, is_deleted boolean"


def table(spark, *rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", r[3] if len(r) > 3 else "o1", "u1", None, None, r[4] if len(r) > 4 else False) for r in rows]
    return spark.createDataFrame(full, SHAPE)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def test_create_checks_and_stamps(spark):
    held = table(spark, ("a", "one"))
    new = spark.createDataFrame([("two", "x"), ("three", "y"), ("three", "y")], "name string, summary string")
    made = E.create("semantic", held, new, ACTOR, now()).collect()
    assert len({r["id"] for r in made}) == 3 and {r["user_id"] for r in made} == {"u1"} and not any(r["is_deleted"] for r in made)
    again = E.create("semantic", held, new, ACTOR, now()).collect()
    assert sorted(r["id"] for r in again) == sorted(r["id"] for r in made)
    with pytest.raises(ValueError, match="required"):
        E.create("semantic", held, spark.createDataFrame([("x", None)], "name string, summary string"), ACTOR)
    with pytest.raises(E.Invalid):
        E.create("semantic", held, spark.createDataFrame([("x",)], "name string"), ACTOR)
    with pytest.raises(E.Invalid):
        E.create("semantic", held, new, {"user_id": "u1"})
    with pytest.raises(E.Invalid):
        E.create("nothing", held, new, ACTOR)
    with pytest.raises(maintenance.Conflict):
        E.create("semantic", held, spark.createDataFrame([("a", "x", "y")], "id string, name string, summary string"), ACTOR)
    with pytest.raises(maintenance.Conflict):
        E.create("tool", held, spark.createDataFrame([("one",)], "name string"), ACTOR)
    assert E.create("semantic", held, new.where("false"), ACTOR).count() == 0


def test_parents_must_be_there(spark):
    agents = spark.createDataFrame([("g1",)], "id string")
    messages = spark.createDataFrame([], "id string, agent_id string, role string, text string, organization_id string, user_id string")
    rows = spark.createDataFrame([("g1", "user", "hi"), ("g2", "user", "ho")], "agent_id string, role string, text string")
    with pytest.raises(LookupError):
        E.create("message", messages, rows, ACTOR, parents={"agent": agents})
    assert E.create("message", messages, rows.where("agent_id = 'g1'"), ACTOR, parents={"agent": agents}).count() == 1


def test_short_ids_grow_where_they_clash(spark):
    seeds = spark.createDataFrame([(str(k), None) for k in range(3000)], "seed string, id string")
    got = E.short_ids(seeds, spark.createDataFrame([], "id string"), "id", ["seed"], (1, 2, 32)).collect()
    sizes = [len(r["id"]) for r in got]
    assert len({r["id"] for r in got}) == 3000 and sizes.count(1) == 16 and 0 < sizes.count(2) <= 256
    held = spark.createDataFrame([(c,) for c in "abcdefghijklmnop"], "id string")
    assert all(len(r["id"]) > 1 for r in E.short_ids(seeds, held, "id", ["seed"], (1, 2, 32)).collect())


def test_reads_see_their_organization_alone(spark):
    held = table(spark, ("a", "one"), ("b", "two", "s", "o2"), ("c", "three", "s", "o1", True), ("d", "one"))
    assert E.read("semantic", held, "a", ACTOR).first()["name"] == "one"
    for key in ("b", "c", "z"):
        with pytest.raises(listing.NotFound):
            E.read("semantic", held, key, ACTOR)
    assert E.find("tool", held, ACTOR, name="one").first()["id"] == "a" and E.find("tool", held, ACTOR, name="none").count() == 0
    assert [r["name"] for r in E.by_ids("block", held, ["d", "zz", "d"]).collect()] == ["one", None, "one"]
    assert [r["id"] for r in E.listed("file", held, ACTOR).collect()] == ["a", "d"]
    with pytest.raises(listing.NotFound):
        E.checked("semantic", held, ["a", "zz"], "name")


def test_changes_of_missing_or_repeated_ids_are_errors(spark):
    held = table(spark, ("a", "one"), ("b", "two"))

    def change(*rows):
        return spark.createDataFrame(rows, "id string, name string, set_name boolean")

    out = {r["id"]: r for r in E.patch("semantic", held, change(("a", None, True), ("b", "x", False)), now()).collect()}
    assert out["a"]["name"] is None and out["b"]["name"] == "two" and out["a"]["updated_at"] is not None
    same = {r["id"]: r["updated_at"] for r in E.patch("semantic", held, change(("a", "one", True), ("b", "new", True)), now(), only_different=True).collect()}
    assert same["a"] is None and same["b"] is not None
    with pytest.raises(listing.NotFound):
        E.patch("semantic", held, change(("z", "x", True)))
    with pytest.raises(maintenance.Conflict):
        E.patch("semantic", held, change(("a", "x", True), ("a", "y", True)))
    ids = spark.createDataFrame([("a",)], "id string")
    assert E.delete("semantic", held, ids).count() == 1 and E.delete("provider", held, ids).where("is_deleted").count() == 1
    with pytest.raises(listing.NotFound):
        E.delete("provider", E.delete("provider", held, ids), ids)


def test_upsert_and_get_or_create(spark):
    held = table(spark, ("a", "one", "old"))
    rows = spark.createDataFrame([("one", "new"), ("two", "new")], "name string, summary string")
    out = E.upsert("tool", held, rows, ACTOR, ["name"], now())
    assert {(r["name"], r["summary"]) for r in out.collect()} == {("one", "new"), ("two", "new")} and out.where("id = 'a'").count() == 1
    assert [r["name"] for r in E.get_or_create("user", held, rows.select("name"), ACTOR, ["name"]).collect()] == ["two"]


def test_lists_that_agents_hold(spark):
    agents = spark.createDataFrame([("g", ["x", "y", "x"]), ("h", None), ("i", ["z"])], "id string, held array<string>")
    changes = spark.createDataFrame([("g", "y"), ("g", "w"), ("h", "w"), ("h", "w")], "id string, member string")
    more = {r["id"]: r["held"] for r in E.change_lists(agents, changes, "id", "held").collect()}
    assert more == {"g": ["x", "y", "x", "w"], "h": ["w"], "i": ["z"]}
    less = {r["id"]: r["held"] for r in E.change_lists(agents, changes, "id", "held", attach=False).collect()}
    assert less == {"g": ["x", "x"], "h": None, "i": ["z"]} or less["h"] == []


@dataclasses.dataclass
class Place:
    city: str
    zip: int = 0


def visit(place: Place, days: int, tags: list[str], note: str | None = None) -> str:
    """Visit a place.

    Args:
        place: where to go
        days: how long
        tags: words for it,
            any number
        note: a remark
    """
    return f"{place} {days} {tags} {note}"


def test_schemas_of_functions():
    told = tools.schema(visit)
    assert told["parameters"]["required"] == ["place", "days", "tags"] and told["description"] == "Visit a place."
    assert told["parameters"]["properties"]["tags"] == {"type": "array", "items": {"type": "string"}, "description": "words for it, any number"}
    assert told["parameters"]["properties"]["place"]["required"] == ["city"]
    assert tools.spark_type(Place).simpleString() == "struct<city:string,zip:bigint>"
    assert tools.spark_type(dict[str, float]).simpleString() == "map<string,double>"
    with pytest.raises(TypeError):
        tools.json_type(int | str)
    with pytest.raises(TypeError):
        tools.json_type(bytes)

    def silent(x: int):
        return x

    with pytest.raises(ValueError, match="docstring"):
        tools.schema(silent)


def test_tools_run_in_workers_and_fail_row_by_row(spark):
    def visit(place: str, days: int, tags: list[str], note: str | None = None) -> str:
        """Visit a place.

        Args:
            place: where to go
            days: how long
            tags: words for it
            note: a remark
        """
        return f"{place} {days} {tags} {note}"

    registry = tools.Registry(spark)
    registry.add(visit)
    calls = spark.createDataFrame([(1, '{"place": "x", "days": 2, "tags": []}'), (2, "no json"), (3, None), (4, '{"place": 1, "days": 1, "tags": [], "more": 1}')], "n int, a string")
    got = {r["n"]: (r["status"], r["result"]) for r in registry.run(calls, "visit", "a").collect()}
    assert got[1] == ("success", "x 2 [] None") and {got[k][0] for k in (2, 3, 4)} == {"error"}
    with pytest.raises(LookupError):
        registry.run(calls, "other", "a")
    registry.drop("visit")
    assert registry.table().count() == 0


def test_tolerant_json(spark):
    rows = ['{"a": 1}', 'text {"a": 2} more', '{"a": 3,}', "{'a': 4}", "none", None, "[1]", '{"a": ']
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(X.json_object(F.col("t"), "a int")["a"].alias("a")).collect()
    assert [r["a"] for r in got] == [1, 2, 3, 4, None, None, None, None]


def test_claims(spark):
    frames = spark.createDataFrame([(k, 0 if k % 2 else 2, 100 - k) for k in range(20)], "id int, s int, t int")
    claimed = status.claim(frames, "s", "t", "id", 3)
    assert sorted(r["id"] for r in claimed.where("s = 1").collect()) == [15, 17, 19] and claimed.where("s = 0").count() == 7
    second = status.claim(claimed, "s", "t", "id", 3)
    assert sorted(r["id"] for r in second.where("s = 1").collect()) == [9, 11, 13, 15, 17, 19]
    old = claimed.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    back = status.released(old, "s", "at", F.lit("2024-01-01 00:10:00").cast("timestamp"), 300)
    assert back.where("s = 1").count() == 0 and status.released(old, "s", "at", F.lit("2024-01-01 00:01:00").cast("timestamp"), 300).where("s = 1").count() == 3


def run_stream(spark, tmp_path, rows, schema, build, mode="update"):
    """Each list of rows is a file, read in a trigger of its own."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out


def test_machine_goes_on_between_triggers(spark, tmp_path):
    rows = [[("a", 1, "claim"), ("b", 1, "text")], [("a", 2, "text"), ("a", 3, "claim"), ("b", 2, "claim")], [("a", 4, "summary"), ("b", 3, "fail")], [("a", 5, "claim"), ("b", 4, "claim")]]
    out = run_stream(spark, tmp_path, rows, "frame string, place int, what string", lambda s: status.machine_stream(s, "frame", "what", "place"))
    last = {}
    for batch in out:
        last |= dict(batch)
    assert last == {"a": 4, "b": -1}
    assert dict(out[1])["a"] == 3 and dict(out[0])["b"] == 0


def test_uploads_fail_by_a_timer(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    rows = [[("a", at, "pending"), ("b", at, "pending")], [("b", at + timedelta(seconds=5), "completed")], [("c", at + timedelta(seconds=60), "pending")], [("d", at + timedelta(seconds=61), "pending")]]
    out = run_stream(spark, tmp_path, rows, "file string, at timestamp, status string", lambda s: absorb.upload_stream(s, "file", "at"))
    assert sorted(x for batch in out for x in batch) == [("a", "failed"), ("b", "completed")]


def test_fan_out_reads_a_batch_once(spark, tmp_path):
    got = {"x": [], "y": []}
    sinks = {k: (lambda df, k=k: got[k].append(df.count())) for k in got}
    status.fan_out(sinks)(spark.range(7), 0)
    assert got == {"x": [7], "y": [7]}


def test_fuzzy_levels_equal_a_scan_of_all(spark):
    import random

    rng = random.Random(3)
    query = "released under the mit license"
    texts = ["".join(rng.choices("abcdelmnrstu ", k=60)) for _ in range(60)]
    for k in range(25):
        edited = list(query)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(len(edited))] = rng.choice("xyz")
        texts.append("".join(rng.choices("abc ", k=9)) + "".join(edited))
    texts += [None, "", "mit", "license"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    every = [(r["id"], r["score"]) for r in fuzzy.fuzzy(df, "t", query, "id", None).collect()]
    for limit in (1, 5, 10, 40):
        assert [(r["id"], r["score"]) for r in fuzzy.fuzzy(df, "t", query, "id", limit).collect()] == every[:limit]


def test_exports_may_hold_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5], 3)], "id int, v array<float>, created_at int")
    assert "v" not in files.export_union({"a": df}).columns
    assert files.export_union({"a": df}, include_embeddings=True).first()["v"] == "[0.5,1.5]"
    files.export_sheets({"a": df, "b": df}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets" / "b")).count() == 1


def test_files_by_time(spark, tmp_path):
    import os

    for k, name in enumerate(["old.md", "new.mp3", "mid.png"]):
        (tmp_path / name).write_bytes(b"x" * (k + 1))
        os.utime(tmp_path / name, (1_700_000_000 + [0, 20, 10][k],) * 2)
    got = files.by_time(files.read_files(spark, str(tmp_path))).select("name", "type", "size").collect()
    assert [tuple(r) for r in got] == [("new.mp3", "application/octet-stream", 2), ("mid.png", "image/png", 3), ("old.md", "text/markdown", 1)]


def test_bm25_batch_of_nothing(spark):
    docs = spark.createDataFrame([(1, "")], "id int, t string")
    asked = spark.createDataFrame([(1, "some words")], "q int, t string")
    assert search.bm25_batch(docs, "t", "id", asked, "q", "t").count() == 0


def png(width, height):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + b"\x07" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_screen_shots(spark, tmp_path):
    """Monitors come and go; a picture without size, or that is none, is left out; a stream reads each shot once."""
    from tidemark.sources import screen

    folder = tmp_path / "shots"
    folder.mkdir()
    for name, image in {"1-0": png(4, 2), "1-1": png(8, 6), "2-0": png(4, 2), "3-0": png(0, 0), "3-2": png(5, 5), "4-0": b"none"}.items():
        (folder / f"{name}.png").write_bytes(image)
    screen.register(spark)
    rows = spark.read.format("screen").option("path", str(folder)).load().select("shot", "monitor", "width", "height").collect()
    want = [(1, 0, 4, 2), (1, 1, 8, 6), (2, 0, 4, 2), (3, 2, 5, 5)]
    assert sorted(map(tuple, rows)) == want
    out = []
    stream = spark.readStream.format("screen").option("path", str(folder)).option("shots", "2").load()
    query = stream.writeStream.foreachBatch(lambda df, n: out.extend(tuple(r)[:4] for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(out) == want


def test_screen_stream_reads_in_tasks_and_repeats_nothing_after_a_restart(spark, tmp_path):
    from tidemark.sources import screen

    folder = tmp_path / "shots"
    folder.mkdir()
    out = []

    def run(numbers):
        for k in numbers:
            (folder / f"{k}-0.png").write_bytes(png(4, 2))
        stream = spark.readStream.format("screen").option("path", str(folder)).option("shots", "2").load()
        query = stream.writeStream.foreachBatch(lambda df, n: out.append((df.rdd.getNumPartitions(), sorted(r["shot"] for r in df.collect()))))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    screen.register(spark)
    run(range(1, 8))
    run([])
    run([8, 9, 12])
    assert [shots for _, shots in out if shots] == [[1, 2, 3, 4, 5, 6, 7], [8, 9, 12]]
    assert [n for n, shots in out if shots] == [4, 2]
    # what is planned holds names, and no image
    import pickle

    planned = screen._Stream(str(folder), 2).partitions({"shot": 3}, {"shot": 9})
    assert [[k for k, _ in p.shots] for p in planned] == [[4, 5], [6, 7], [8, 9]] and len(pickle.dumps(planned)) < 4000
