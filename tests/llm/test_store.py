from tidemark.llm import store as S


def test_folder_is_the_sessions(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" and self.value else default

    class Session:
        conf = Conf("file:///shared/")
        sparkContext = spark.sparkContext

    app = spark.sparkContext.applicationId
    assert S.folder(Session()) == f"file:///shared/tables-{app}"
    assert S.folder(spark) == S.folder(spark)


def test_tables_can_be_discarded_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "folder", lambda _: f"file://{tmp_path}/shared")
    kept = S.store(spark.range(5), "kept")
    gone = S.store(spark.range(7), "gone")
    assert kept.stored_at.startswith(f"file://{tmp_path}/shared/") and kept.count() == 5
    S.discard(gone)
    assert [p.name.split("-")[0] for p in (tmp_path / "shared").iterdir()] == ["kept"]
    S.clear(spark)
    assert not (tmp_path / "shared").exists()
