"""Changes, constraints, transactions, plans, prepared statements, rows, indexes, buckets."""

import pytest

from sensorloom.errors import BusyError, ExistsError, MisuseError, SchemaError
from sensorloom.session import Engine


def rows(e, text="SELECT * FROM p ORDER BY id"):
    return [tuple(r) for r in e.sql(text).collect()]


def test_changes_are_all_or_nothing(engine):
    engine.execute("CREATE TABLE p (id INT PRIMARY KEY, v TEXT); INSERT INTO p VALUES (1, 'ash'), (2, 'elm')")
    for bad in ("INSERT INTO p VALUES (3, 'x'), (1, 'y')", "INSERT INTO p VALUES (5, 'x'), (5, 'y')", "UPDATE p SET id = 7"):
        with pytest.raises(ExistsError):
            engine.execute(bad)
    assert rows(engine) == [(1, "ash"), (2, "elm")]
    engine.execute("INSERT OR REPLACE INTO p VALUES (1, 'a'), (4, 'b'), (1, 'c')")
    assert rows(engine) == [(1, "c"), (2, "elm"), (4, "b")]
    engine.execute("UPDATE p SET id = id + 1, v = LOWER('ZZ') WHERE id < 4")
    assert engine.sql_changed == 2 and rows(engine) == [(2, "zz"), (3, "zz"), (4, "b")]
    engine.execute("UPDATE p SET id = 7 - id")
    assert rows(engine) == [(3, "b"), (4, "zz"), (5, "zz")]
    engine.execute("DELETE FROM p WHERE v = 'zz' AND id > 4")
    assert engine.sql_changed == 1 and rows(engine) == [(3, "b"), (4, "zz")]
    with pytest.raises(SchemaError):
        engine.execute("UPDATE p SET id = 3000000000 WHERE id = 3")
    assert engine.check() == []


def test_transactions_and_savepoints(engine):
    engine.execute("CREATE TABLE p (id INT PRIMARY KEY, v TEXT)")
    engine.begin()
    engine.execute("INSERT INTO p VALUES (1, 'a')")
    with pytest.raises(ExistsError):
        engine.execute("INSERT INTO p VALUES (2, 'b'), (1, 'c')")
    engine.execute("INSERT INTO p VALUES (3, 'd')")
    engine.commit()
    assert rows(engine) == [(1, "a"), (3, "d")]
    with pytest.raises(ZeroDivisionError), engine.transaction():
        engine.execute("DELETE FROM p")
        raise ZeroDivisionError
    assert len(rows(engine)) == 2
    engine.begin(write=False)
    with pytest.raises(MisuseError):
        engine.execute("DELETE FROM p")
    engine.rollback()


def test_reopen_lock_and_vacuum(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with Engine(spark, root) as e:
        e.execute("CREATE TABLE p (id INT PRIMARY KEY, v TEXT); INSERT INTO p VALUES (1, 'a'); UPDATE p SET v = 'b'")
        with pytest.raises(BusyError):
            Engine(spark, root)
        assert e.store.vacuum() > 0
    with Engine(spark, root) as e:
        assert rows(e) == [(1, "b")]
        e.begin()
        e.execute("INSERT INTO p VALUES (2, 'lost')")
    with Engine(spark, root) as e:
        assert rows(e) == [(1, "b")] and e.check() == []


def test_unique_indexes_and_names(engine):
    engine.execute("CREATE TABLE p (id INT PRIMARY KEY, e TEXT, n INT); INSERT INTO p VALUES (1, 'x', 1), (2, 'x', 2), (3, 'y', 3); CREATE UNIQUE INDEX pn ON p (n)")
    for bad in ("CREATE UNIQUE INDEX pe ON p (e)", "CREATE INDEX p ON p (e)", "CREATE TABLE pn (a INT)", "INSERT INTO p VALUES (4, 'z', 3)", "INSERT OR REPLACE INTO p VALUES (1, 'x', 2)", "UPDATE p SET n = 5"):
        with pytest.raises(ExistsError):
            engine.execute(bad)
    engine.execute("INSERT OR REPLACE INTO p VALUES (1, 'q', 1); UPDATE p SET n = n + 1")
    assert rows(engine) == [(1, "q", 2), (2, "x", 3), (3, "y", 4)]
    assert [r["id"] for r in engine.table("p").index("pn").prefix(reverse=True).collect()] == [3, 2, 1]
    engine.execute("DROP INDEX pn; DROP INDEX IF EXISTS pn; DROP TABLE p; DROP TABLE IF EXISTS p")
    with pytest.raises(SchemaError):
        engine.execute("DROP TABLE p")


PLANS = [
    ("machine = 3 AND time = 5", "point lookup", "m, fixed: machine time"), ("machine = 3", "range scan", "m, fixed: machine"), ("machine = 3 AND time > 5", "range scan", "m, fixed: machine, range on time"),
    ("machine IN (1, 2, 2)", "key list", "m, list on machine (3 values)"), ("machine = 1 AND (time = 4 OR time = 5)", "key list", "m, fixed: machine, list on time (2 values)"), ("time > 5", "full scan", "m"),
    ("(machine = 3) OR 0 = 1", "full scan", "m"), ("temp = 20.5", "index lookup", "m, index mt, fixed: temp"), ("temp BETWEEN 2 AND 3", "index range", "m, index mt, range on temp"), ("machine > 'x'", "full scan", "m"), ("5 < machine", "range scan", "m, range on machine"),
]


def test_explain(engine):
    engine.execute("CREATE TABLE m (machine INT, time TIME, temp FLOAT, PRIMARY KEY (machine, time)); CREATE INDEX mt ON m (temp)")
    for where, plan, detail in PLANS:
        assert tuple(engine.explain(f"SELECT * FROM m WHERE {where}")) == (plan, f"{detail}; 0 of 0 files"), where


def test_plans_read_the_same_rows(engine):
    engine.execute("CREATE TABLE m (machine INT, time TIME, temp FLOAT, PRIMARY KEY (machine, time))")
    engine.table("m").insert(engine.spark.range(400).selectExpr("cast(id % 10 as int) machine", "1700000000 + id div 10 as time", "cast((id * 7) % 40 as double) / 10 as temp"))
    for where, *_ in PLANS:
        plain, opaque = (sorted(map(tuple, engine.sql(f"SELECT * FROM m WHERE {w}").collect())) for w in (where, f"({where}) OR 0"))
        assert plain == opaque


def test_prepared(engine):
    engine.execute("CREATE TABLE p (id INT PRIMARY KEY, v TEXT); INSERT INTO p VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    s = engine.prepare("SELECT v FROM p WHERE id >= ? AND v <> ?")
    assert s.columns == ["v"] and [r[0] for r in s.run(2, "c").collect()] == ["b"]
    s.bind(1, 1).bind(2, "zz")
    assert [s.step()[0] for _ in range(3)] == ["a", "b", "c"] and s.step() is None
    s.reset()
    assert s.step()[0] == "a"
    engine.prepare("INSERT INTO p VALUES (?, ?)").run(9, "it's")
    assert rows(engine)[-1] == (9, "it's")
    for bad in (float("nan"), "x" * 256):
        with pytest.raises((MisuseError, Exception)):
            s.bind(1, bad)
    with pytest.raises(MisuseError):
        engine.execute("SELECT ?")


def test_rows_and_buckets(engine):
    t = engine.create_table("r", [("machine", "int"), ("time", "time"), ("temp", "float")], ["machine", "time"])
    assert t.insert([(1, 10, 20.5), (1, 12, 21.53), (2, 5, -1.0)]) == 3
    assert t.upsert([(1, 12, 22.0)]) == 1 and t.get(1, 12)["temp"] == 22.0 and t.get(9, 9) is None
    assert t.last(1)["time"] == 12 and [r["time"] for r in t.prefix(1).collect()] == [10, 12]
    assert t.delete(2, 5) and not t.delete(2, 5)
    with pytest.raises(MisuseError):
        t.get(1)
    b = engine.bucket("x")
    b.put_all([(b"\xff", b"1"), (b"a", b"2"), (b"b", b"3")])
    b.put(b"a", b"9")
    assert b.get(b"a") == b"9" and b.delete(b"b") and not b.delete(b"b")
    assert [bytes(r["k"]) for r in b.scan(b"a").collect()] == [b"a", b"\xff"]
    assert bytes(b.scan(b"b", reverse=True, limit=1).first()["k"]) == b"a"


def test_keyless_tables_keep_arrival(engine):
    engine.execute("CREATE TABLE late (time TIME, v INT); INSERT INTO late VALUES (80, 6), (20, 9); INSERT INTO late VALUES (80, 2), (10, 5)")
    assert [tuple(r) for r in engine.sql("SELECT * FROM late", ordered=True).collect()] == [(10, 5), (20, 9), (80, 6), (80, 2)]
    assert [r["v"] for r in engine.series.scan("late", 20, 80).collect()] == [6, 9, 2]
    w = engine.series.window("late", "v", 15)
    assert (w["n"], w["min"], w["max"], w["sum"], round(w["avg"], 3), w["first_time"], w["last_time"]) == (3, 2, 9, 17, 5.667, 80, 80)
    assert engine.series.window("late", "v", 99)["avg"] == 0


def inputs(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_indexes_are_read_and_exact(engine, spark):
    """Random changes; after each the index holds the table's rows, and a lookup reads the files it names."""
    import random

    rng = random.Random(4)
    engine.execute("CREATE TABLE shelf (id INT PRIMARY KEY, spot INT, label TEXT); CREATE INDEX by_spot ON shelf (spot, label)")
    held = {}
    for step in range(14):
        new = {rng.randrange(60): (rng.randrange(12), rng.choice(["a", "b", "it's", ""])) for _ in range(6)}
        match rng.randrange(4):
            case 0 | 1:
                engine.table("shelf").upsert([(k, *v) for k, v in new.items()])
                held |= new
            case 2:
                n = rng.randrange(12)
                engine.execute("DELETE FROM shelf WHERE spot = ?", n)
                held = {k: v for k, v in held.items() if v[0] != n}
            case 3:
                engine.execute("UPDATE shelf SET spot = spot + 1 WHERE id < 20")
                held = {k: (v[0] + (k < 20), v[1]) for k, v in held.items()}
        assert all(not n for f in engine.store.index_faults("shelf").values() for n in f.values()), step
    assert sorted(map(tuple, engine.sql("SELECT id, spot, label FROM shelf").collect())) == sorted((k, *v) for k, v in held.items())
    assert engine.check() == []
    for spot in range(0, 14, 3):
        want = sorted((v[1], k) for k, v in held.items() if v[0] == spot)
        assert [(r["label"], r["id"]) for r in engine.table("shelf").index("by_spot").prefix(spot).collect()] == want


def test_index_lookup_opens_few_files(engine, spark):
    engine.execute("CREATE TABLE m (id INT PRIMARY KEY, temp FLOAT)")
    for k in range(6):
        engine.table("m").insert(spark.range(k * 100, k * 100 + 100).selectExpr("cast(id as int) id", "cast(id % 97 as double) + id div 300 * 0.5 as temp"))
    engine.execute("CREATE INDEX mt ON m (temp)")
    every = len(engine.describe("m").entry["files"])
    # 3.5 lies inside the range of all late files, the index knows which hold it
    some = engine.sql("SELECT id FROM m WHERE temp = 3.5")
    ids = [i for i in range(600) if i % 97 + i // 300 * 0.5 == 3.5]
    assert sorted(r["id"] for r in some.collect()) == ids and 0 < len(inputs(some)) <= len(ids) < every
    plan, told = engine.explain("SELECT id FROM m WHERE temp = 3.5")
    assert plan == "index lookup" and told == f"m, index mt, fixed: temp; {len(inputs(some))} of {every} files"
    assert len(inputs(engine.sql("SELECT temp FROM m WHERE id = 250"))) == 1 and engine.sql("SELECT id FROM m WHERE temp = 3.25").count() == 0
    # a FLOAT bound is pushed into the files as it is
    text = engine.sql("SELECT COUNT(*) FROM m WHERE temp > 29.4")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(temp,29.4)" in text
    # rows with new keys are added without a look at the files there are
    seen = []
    engine.store._repeated = lambda df, columns: seen.append(inputs(df)) or False
    engine.table("m").insert([(1000, 1.0)])
    assert len(seen) == 1 and len(seen[0]) == 1
    del engine.store._repeated
    with pytest.raises(ExistsError):
        engine.table("m").insert([(1000, 2.0)])


def test_neighbours_and_cursor(engine):
    t = engine.create_table("r", [("machine", "int"), ("time", "time")], ["machine", "time"])
    t.insert([(1, 10), (1, 12), (2, 5)])
    assert t.next(1, 10)["time"] == 12 and tuple(t.next(1, 12)) == (2, 5) and t.next(2, 5) is None
    assert tuple(t.prev(2, 5)) == (1, 12) and t.prev(1, 10) is None and tuple(t.prev(9, 9)) == (2, 5)
    b = engine.bucket("x")
    b.put_all([(b"b", b"1"), (b"d", b"2"), (b"\xff", b"3")])
    assert b.seek(b"c") == (b"d", b"2") == b.next(b"b") and b.prev(b"d") == (b"b", b"1") and b.last() == (b"\xff", b"3") and b.seek(b"\xff\x00") is None


def test_one_of_two_commits_wins(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with Engine(spark, root) as a:
        other = Engine(spark, root, break_lock=True)
        a.execute("CREATE TABLE p (id INT PRIMARY KEY)")
        with pytest.raises(BusyError):
            other.execute("CREATE TABLE q (id INT PRIMARY KEY)")
        other.close()
    files = a.store.files
    assert files.write_new(f"{root}/x", b"1") and not files.write_new(f"{root}/x", b"2") and files.read(f"{root}/x") == b"1"


def test_ordered_checksum(spark):
    from sensorloom.operators.compare import ordered_checksum

    df = spark.range(500).selectExpr("id", "id % 7 as k")
    base = ordered_checksum(df, ["k", "id"])
    assert base[0] == 500 and base == ordered_checksum(df.repartition(9), ["k", "id"]) != ordered_checksum(df, ["id"])
    assert base != ordered_checksum(df.where("id <> 3"), ["k", "id"]) and ordered_checksum(df.where("false"), ["id"])[0] == 0
