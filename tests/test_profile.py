from tidewise import Roles
from tidewise.operators import profile as pf

SCHEMA = "allnull double, one int, one_plus_null string, two int, y double"


def test_constant_columns(frame):
    rows = [(None, 1, "a", 1, 1.0), (None, 1, None, 2, 2.0), (None, 1, "a", 1, 3.0)]
    df = frame(rows, SCHEMA)
    prof = {r["column_name"]: r["constant"] for r in pf.constant_profile(df).collect()}
    assert prof == {"allnull": True, "one": True, "one_plus_null": False, "two": False,
                    "y": False}
    assert pf.drop_constant_columns(df).columns == ["one_plus_null", "two", "y"]


def test_numeric_categorical_split(frame):
    df = frame([("i", "2020-01-01", 1.0, 2, "c", True)],
               "id string, date string, y double, n int, c string, b boolean")
    nums, cats = pf.numeric_categorical(df, Roles(id="id", time="date", target="y"))
    assert nums == ["n", "b"] and cats == ["c"]


def test_exact_median_and_mode(frame):
    df = frame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (4.0, "a"), (None, None)],
               "x double, c string")
    med = {r[0]: r[1] for r in pf.column_medians(df, ["x"]).collect()}
    assert med == {"x": 2.5}  # interpolated, not the lower middle value
    mode = {r[0]: r[1] for r in pf.column_modes(df, ["c"]).collect()}
    assert mode == {"c": "a"}  # tie: the lowest value


def test_all_null_columns(frame):
    df = frame([(None, None), (None, None)], "x double, c string")
    assert pf.column_medians(df, ["x"]).collect()[0]["median"] is None
    assert pf.column_modes(df, ["c"]).collect()[0]["mode"] is None


def test_median_narrowing_rounds_are_exact(frame):
    import random
    import statistics
    rng = random.Random(11)
    xs = [float(rng.randrange(0, 400)) for _ in range(1501)]
    ys = [rng.gauss(0, 1) for _ in range(1500)]
    rows = [(x, ys[i] if i < len(ys) else None) for i, x in enumerate(xs)]
    df = frame(rows, "x double, z double")
    # tiny limits force several narrowing rounds before the final pick
    got = {r[0]: r[1] for r in pf.column_medians(df, ["x", "z"], task_values=5,
                                                 buckets=4).collect()}
    assert got["x"] == statistics.median(xs)
    assert abs(got["z"] - statistics.median(ys)) < 1e-12
