import json

import pytest

from starweave.operators.features import business_wide, one_per_key
from starweave.operators.ratings import latest_ratings
from starweave.sources import files, schemas


def write(path, text):
    path.write_text(text)
    return str(path)


def test_header_of_every_file_is_skipped(spark, tmp_path):
    write(tmp_path / "a.csv", "user_id,business_id,stars\nu1,b1,4\nu2,b1,3.5\n")
    write(tmp_path / "b.csv", "user_id,business_id,stars\nu1,b1,2\n")
    ratings = files.read_ratings(spark, str(tmp_path))
    assert ratings.count() == 3
    # the last row in file order wins
    last = {r["user_id"]: r["stars"] for r in latest_ratings(ratings).collect()}
    assert last == {"u1": 2.0, "u2": 3.5}


def test_header_only(spark, tmp_path):
    path = write(tmp_path / "a.csv", "user_id,business_id,stars\n")
    assert files.read_ratings(spark, path, with_order=False).collect() == []
    assert files.read_ratings(spark, path, with_order=False).schema == schemas.RATING


def test_malformed_rating(spark, tmp_path):
    path = write(tmp_path / "a.csv", "user_id,business_id,stars\nu1,b1,4\nu2,b2,many\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_ratings(spark, path).collect()
    assert files.read_ratings(spark, path, "DROPMALFORMED").select("user_id", "stars").count() == 1
    rows = files.read_ratings(spark, path, "PERMISSIVE").collect()
    assert [r["stars"] for r in rows] == [4.0, None]
    with pytest.raises(ValueError):
        files.read_ratings(spark, path, "LENIENT")


@pytest.mark.parametrize("mode, expected", [("FAILFAST", None), ("DROPMALFORMED", 2), ("PERMISSIVE", 3)])
def test_rows_do_not_depend_on_the_columns_read(spark, tmp_path, mode, expected):
    ratings = write(tmp_path / "a.csv", "user_id,business_id,stars,text\nu1,b1,4,x\nu2,b2,many,y\nu3,b3,2,z\n")
    users = write(tmp_path / "u.json", '{"user_id": "u1", "fans": 3}\n{"user_id": "u2", "fans": "many"}\n{"user_id": "u3"}\nnull\n')
    reads = [lambda: files.read_ratings(spark, ratings, mode), lambda: files.read_users(spark, users, mode)]
    views = [lambda f: f.collect(), lambda f: f.select("user_id").distinct().collect(), lambda f: [None] * f.count()]
    for read in reads:
        for view in views:
            if expected is None:
                with pytest.raises(Exception, match="(?i)malformed"):
                    view(read())
            else:
                assert len(view(read())) == expected


@pytest.mark.parametrize("mode", ["FAILFAST", "DROPMALFORMED", "PERMISSIVE"])
def test_further_columns_are_ignored(spark, tmp_path, mode):
    path = write(tmp_path / "a.csv", "who,what,how much,when,a.b\nu1,b1,4,2001,x\nu2,b2,5,2002,y\n")
    got = files.read_ratings(spark, path, mode, with_order=False)
    assert sorted(map(tuple, got.collect())) == [("u1", "b1", 4.0), ("u2", "b2", 5.0)] and got.schema == schemas.RATING


def test_records_with_maps_have_a_greatest(spark):
    rows = [("b1", {"Fri-0": 2}), ("b1", {"Fri-0": 3}), ("b2", None)]
    one = one_per_key(spark.createDataFrame(rows, schemas.CHECKIN), "business_id")
    assert {r["business_id"]: r["time"] for r in one.collect()} == {"b1": {"Fri-0": 3}, "b2": None}


def test_pairs_ignore_further_columns(spark, tmp_path):
    path = write(tmp_path / "v.csv", "user_id,business_id,stars,more\nu1,b1,4,x\nu2,b2,5,y\n")
    pairs = files.read_pairs(spark, path)
    assert pairs.columns == ["user_id", "business_id"]
    assert sorted(map(tuple, pairs.collect())) == [("u1", "b1"), ("u2", "b2")]


def test_business_records(spark, tmp_path):
    lines = [
        {"business_id": "b1", "stars": 4.5, "review_count": 7, "is_open": 1, "postal_code": "1",
         "attributes": {"NoiseLevel": "quiet", "Other": "x"}},
        {"business_id": "b2", "attributes": None},
        {"business_id": "b3"},
        None,
    ]
    path = write(tmp_path / "b.json", "\n".join(json.dumps(x) for x in lines))
    rows = {r["business_id"]: r for r in business_wide(files.read_businesses(spark, path)).collect()}
    assert sorted(rows) == ["b1", "b2", "b3"]
    assert rows["b1"]["NoiseLevel"] == "quiet" and rows["b1"]["OutdoorSeating"] is None
    assert rows["b2"]["NoiseLevel"] is None and rows["b3"]["business_stars"] is None


def test_malformed_json(spark, tmp_path):
    path = write(tmp_path / "u.json", '{"user_id": "u1", "fans": 3}\n{"user_id": "u2", \nnull\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_users(spark, path).select("user_id").collect()
    for mode in ("PERMISSIVE", "DROPMALFORMED"):
        assert "u1" in [r["user_id"] for r in files.read_users(spark, path, mode).collect()]
    assert [r["user_id"] for r in files.read_users(spark, path, "DROPMALFORMED").collect()] == ["u1"]
    with pytest.raises(ValueError):
        files.read_users(spark, path, "LENIENT")


def test_last_duplicate_record_wins(spark, tmp_path):
    path = write(tmp_path / "u.json", '{"user_id": "u1", "fans": 9}\n{"user_id": "u1", "fans": 3}\n')
    users = one_per_key(files.read_users(spark, path), "user_id")
    assert [r["fans"] for r in users.collect()] == [3]
    greatest = one_per_key(files.read_users(spark, path).drop("read_at"), "user_id")
    assert [r["fans"] for r in greatest.collect()] == [9]


def test_checkin_map(spark, tmp_path):
    path = write(tmp_path / "c.json", '{"business_id": "b1", "time": {"Fri-0": 2, "Sat-13": 1}}\n{"business_id": "b2", "time": {}}\n')
    rows = {r["business_id"]: r["time"] for r in files.read_checkins(spark, path).collect()}
    assert rows == {"b1": {"Fri-0": 2, "Sat-13": 1}, "b2": {}}


def test_predictions_round_trip(spark, tmp_path):
    rows = [("u1", "b1", 3.25), ("u,2", "b2", 4.0)]
    out = str(tmp_path / "out")
    frame = spark.createDataFrame(rows, schemas.PREDICTION).repartition(3)
    files.write_predictions(frame, out)
    back = spark.read.schema(schemas.PREDICTION).option("header", True).csv(out)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


@pytest.mark.parametrize("mode", ["DROPMALFORMED", "PERMISSIVE"])
def test_accounts_of_ratings(spark, tmp_path, mode):
    write(tmp_path / "a.csv", "user_id,business_id,stars\nu1,b1,4\nu2,b2,many\nu3,b3,\n")
    write(tmp_path / "b.csv", "user_id,business_id,stars\nu4,b1,few\nu5,b1,3\n")
    write(tmp_path / "c.csv", "user_id,business_id,stars\nu6,b1,1\n")
    accounts = files.Accounts()
    frame = files.read_ratings(spark, str(tmp_path), mode, accounts=accounts)
    assert frame.columns == ["user_id", "business_id", "stars", "rated_at"]
    # a plan that needs one column only counts the same
    assert len(frame.select("user_id").collect()) == (3 if mode == "DROPMALFORMED" else 6)
    assert (accounts.records, accounts.malformed) == (6, 3)
    file, line = accounts.first
    assert file.endswith("a.csv") and line == "u2,b2,many"
    assert {f[-5:]: n for f, n in accounts.by_file.items()} == {"a.csv": 2, "b.csv": 1}
    with pytest.raises(ValueError):
        files.read_ratings(spark, str(tmp_path), mode, accounts=accounts)


@pytest.mark.parametrize("mode", files.MODES)
def test_accounts_of_json(spark, tmp_path, mode):
    bad = "" if mode == "FAILFAST" else '{"user_id": "u2", "fans": "many"}\n{"user_id": \n'
    path = write(tmp_path / "u.json", f'{{"user_id": "u1", "fans": 3}}\nnull\n{bad}{{"user_id": "u3"}}\n')
    accounts = files.Accounts()
    users = files.read_users(spark, path, mode, accounts=accounts)
    assert users.columns == [*schemas.USER.names, "read_at"]
    users.count()
    if mode == "FAILFAST":
        assert (accounts.records, accounts.malformed, accounts.first, accounts.by_file) == (2, 0, None, {})
    else:
        assert (accounts.records, accounts.malformed) == (4, 2)
        assert accounts.first[1] == '{"user_id": "u2", "fans": "many"}'
        assert list(accounts.by_file.values()) == [2]


def test_accounts_do_not_stop_a_failure(spark, tmp_path):
    path = write(tmp_path / "a.csv", "user_id,business_id,stars\nu1,b1,4\nu2,b2,many\n")
    with pytest.raises(Exception, match="(?i)malformed rating: u2,b2,many"):
        files.read_ratings(spark, path, accounts=files.Accounts()).collect()


def test_accounts_of_nothing(spark, tmp_path):
    path = write(tmp_path / "a.csv", "user_id,business_id,stars\n")
    accounts = files.Accounts()
    assert files.read_ratings(spark, path, "DROPMALFORMED", accounts=accounts).collect() == []
    assert (accounts.records, accounts.malformed, accounts.first, accounts.by_file) == (0, 0, None, {})
