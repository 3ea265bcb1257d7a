"""The versioned prediction table: repeated appends, replacement, reading back old versions."""
import pytest

from tapeloom.sources.versions import PredictionTable

SCHEMA = "fold int, ticker string, pred double"


def rows(spark, *folds, value=0.0):
    return spark.createDataFrame([(f, t, value + f) for f in folds for t in ("A", "B")], SCHEMA)


def test_append_is_idempotent_and_old_versions_stay(spark, tmp_path):
    table = PredictionTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.newest() == 0 and table.read().count() == 0 and table.read().columns == ["run", "fold", "ticker", "pred"]
    assert table.append(rows(spark, 1, 2), "r1") == 1
    assert table.append(rows(spark, 1, 2, value=9.0), "r1") == 1            # nothing new, nothing changed
    assert table.append(rows(spark, 2, 3, value=9.0), "r1") == 2            # only fold 3
    assert table.append(rows(spark, 1), "r2") == 3
    got = sorted(tuple(r) for r in table.read().collect())
    assert got == sorted([("r1", f, t, float(f) + (9.0 if f == 3 else 0)) for f in (1, 2, 3) for t in "AB"] + [("r2", 1, t, 1.0) for t in "AB"])
    assert table.replace(rows(spark, 2, value=5.0), "r1") == 4
    assert {r.pred for r in table.read().filter("run = 'r1' AND fold = 2").collect()} == {7.0}
    assert [table.read(v).count() for v in (1, 2, 3, 4)] == [4, 6, 8, 8]
    assert {r.pred for r in table.read(3).filter("run = 'r1' AND fold = 2").collect()} == {2.0}
    assert sorted((r.run, r.fold, r.n) for r in table.parts().collect()) == [("r1", 1, 2), ("r1", 2, 2), ("r1", 3, 2), ("r2", 1, 2)]


def test_a_commit_without_manifest_is_never_read(spark, tmp_path):
    table = PredictionTable(spark, str(tmp_path / "t"), SCHEMA)
    table.append(rows(spark, 1), "r")
    rows(spark, 7).selectExpr("'r' AS run", "*", "'lost' AS commit").write.parquet(str(tmp_path / "t/data/lost"))
    assert table.newest() == 1 and {r.fold for r in table.read().collect()} == {1}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        rows(spark, 1).selectExpr("'r' AS run", "fold").write.mode("error").json(str(tmp_path / "t/manifests/at=1"))
    assert table.append(rows(spark).limit(0), "r") == 1
