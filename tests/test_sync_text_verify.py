"""Device sync, streaming rules, text exchange, verification, shell."""

import random
import sqlite3
import tarfile

import pytest

from sensorloom import cli
from sensorloom.errors import CorruptError, GapError, SchemaError, SyntaxSqlError
from sensorloom.session import Engine, parse_schema
from sensorloom.sources import textio
from sensorloom.sources.recordlog import DEL, PUT, ROW, Record, decode, encode, pack_row, series_record, unpack_row
from sensorloom.streaming import rules
from sensorloom.streaming.sync import Gateway
from sensorloom.verify import Verifier, check_seal

TEMPS = "time:time,machine:int,temp:float"


def log(n, seed, schema=TEMPS):
    """A device's records: a definition, then rows, puts and deletes."""
    rng, columns = random.Random(seed), parse_schema(schema)
    out = [series_record(1, 1, "temps", schema)]
    for seq in range(2, n + 2):
        kind = rng.choices([ROW, PUT, DEL], [7, 2, 1])[0]
        key = b"k%d" % rng.randrange(5)
        out.append(Record(seq, ROW, series=1, value=pack_row(columns, (1000 + seq, seed, seq / 4))) if kind == ROW else Record(seq, kind, key=key, value=b"v%d" % seq if kind == PUT else b""))
    return out


def test_codec_round_trip():
    columns = parse_schema("time:time,v:float,d:real,i:int,l:long,s:text")
    row = (-5, 21.53, 0.1, -7, 1 << 40, 'a "b"é')
    assert unpack_row(columns, pack_row(columns, row)) == row
    records = log(30, 1)
    data = b"".join(map(encode, records))
    assert list(decode(data)) == records
    bad = bytearray(data)
    bad[len(data) // 2] ^= 1
    found = []
    with pytest.raises(CorruptError):
        for r in decode(bytes(bad)):
            found.append(r)
    assert found == records[: len(found)] and len(found) < len(records)


def test_gap_damage_and_layout(engine):
    g, records = Gateway(engine), log(6, 1)
    assert g.apply(7, 0, b"".join(map(encode, records[:3]))) == 3
    with pytest.raises(GapError) as e:
        g.apply(7, 5, encode(records[5]))
    assert e.value.last_seq == 3
    with pytest.raises(CorruptError) as e:
        g.apply(7, 3, encode(records[3]) + b"\xa5junk")
    assert e.value.last_seq == 4 == g.position(7)
    with pytest.raises(SchemaError):
        g.apply(8, 0, encode(series_record(1, 1, "temps", "time:time,machine:long,temp:real")))
    with pytest.raises(SchemaError):
        g.apply(9, 0, encode(Record(1, ROW, series=4, value=b"\0" * 8)))
    assert g.position(8) == g.position(9) == 0
    with pytest.raises(Exception, match="devices"):
        engine.execute("INSERT INTO temps VALUES (1, 1, 1, 1, 1.0)")


def test_lossy_link_applies_each_record_once(engine, tmp_path):
    """Batches are lost, repeated and reordered; a stream of files ends with every record once."""
    rng, spark, g = random.Random(5), engine.spark, Gateway(engine)
    logs = {d: log(25, d) for d in (1, 2, 3)}
    at, n = dict.fromkeys(logs, 0), 0
    for step in range(12):
        batches = []
        for d, records in logs.items():
            for _ in range(2):
                lo = max(0, at[d] - rng.randrange(4)) if rng.random() < 0.8 else at[d] + 2
                part = records[lo : lo + rng.randrange(1, 9)] if step < 9 else records[at[d] :]
                batches.append((d, lo if step < 9 else at[d], bytearray(b"".join(map(encode, part))), n))
                n += 1
        kept = [b for b in batches if rng.random() < 0.8 or step == 11]
        if not kept:
            continue
        rng.shuffle(kept)
        spark.createDataFrame(kept, "device long, after_seq long, payload binary, arrival long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if step % 4 == 3:
            stream = spark.readStream.schema("device long, after_seq long, payload binary, arrival long").parquet(f"{tmp_path}/in")
            q = g.stream(stream, f"file://{tmp_path}/checkpoint")
            q.awaitTermination()
            at = {d: g.position(d) for d in logs}
    want = sorted((d, r.seq) for d, records in logs.items() for r in records if r.kind == ROW)
    assert sorted((r["device"], r["seq"]) for r in engine.sql("SELECT device, seq FROM temps").collect()) == want
    pairs = {}
    for d, records in logs.items():
        for r in records:
            if r.kind != ROW and not r.reserved:
                pairs[d, r.key.decode()] = r.value.decode() if r.kind == PUT else None
    assert {(r["device"], r["key"]): r["value"] for r in engine.sql("SELECT * FROM kv").collect()} == {k: v for k, v in pairs.items() if v is not None}
    assert tuple(engine.explain("SELECT * FROM temps WHERE time > 5")) == ("range per device", "temps, range on time; 3 of 3 files")


def test_rules(spark, tmp_path):
    values = [50, 61, 62, 63, 64, 58, 54, 70, 71, 72, 73, 40]
    spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(values)], "device long, time long, value double").write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("device long, time long, value double").parquet(f"{tmp_path}/r")

    def run(df, mode="append"):
        q = df.writeStream.format("memory").queryName(f"q{random.random()}".replace(".", "")).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(q.name).collect()))

    assert run(rules.threshold(stream, 60, 55, 3)) == [(1, 3, 1), (1, 6, 0), (1, 9, 1), (1, 11, 0)]
    assert run(rules.excursions(stream, 60, 3)) == [(1, 1, 4, 64.0), (1, 7, 10, 73.0)]


def test_text_round_trip(spark, engine, tmp_path):
    engine.series.create("m", "time:time,v:float,d:real,i:int,l:long,s:text")
    engine.series.append("m", [(-5, 21.53, 0.1, -7, 1 << 40, 'a "b"\n\x01'), (7, 1e-7, 1 / 3, 0, 0, "")])
    engine.kv.put_all([("b", 'q"'), ("a", "1"), ("é", "x\ty")])
    text = list(textio.export(engine))
    assert text[1:3] == ['series m "time:time,v:float,d:real,i:int,l:long,s:text"', 'kv "a" "1"']
    with Engine(spark, f"file://{tmp_path}/other") as other:
        assert textio.import_(other, text) == 5
        assert list(textio.export(other)) == text
        for bad, kind, said in (("row nope 1", SchemaError, "line 1"), ("# x\nkv a b", SyntaxSqlError, "line 2"), ('series m "time:time"', SchemaError, "different"), ("row m x 1 1 1 1 \"\"", SyntaxSqlError, "bad number")):
            with pytest.raises(kind, match=said):
                textio.import_(other, bad.split("\n"))
    textio.export_to(engine, f"file://{tmp_path}/out")
    spark.dataSource.register(textio.TextSource)
    assert spark.read.format("sensortext").load(f"{tmp_path}/out").where("kind = 'row'").count() == 2


def test_verifier(spark, engine, tmp_path):
    def shop(name, n):
        db = sqlite3.connect(f"{tmp_path}/{name}")
        db.execute("create table orders (id integer primary key, item text)")
        db.executemany("insert into orders values (?, ?)", [(i, f"x{i}") for i in range(n)])
        db.commit()
        db.close()
        return f"file://{tmp_path}/{name}"

    v = Verifier(engine)
    first = v.verify("shop", shop("a.db", 500), signer="ann")
    assert (first.verdict, first.exit_code, first.run) == ("PASSED", 0, 1) and check_seal(first.report) and not check_seal(first.report.replace("ann", "bob"))
    assert v.verify("shop", shop("b.db", 490)).verdict == "PASSED"
    bad = v.verify("shop", shop("c.db", 400), key=b"k")
    assert bad.verdict == "ALERT" and bad.exit_code == 1 and "400 rows where" in bad.reasons[0] and check_seal(bad.report, b"k") and not check_seal(bad.report)
    assert v.verify("shop", f"file://{tmp_path}/c.db", accept=True).verdict == "ACCEPTED"
    with open(f"{tmp_path}/d.db", "wb") as f:
        f.write(b"SQLite format 3\0" + b"\1" * 4000)
    assert v.verify("shop", f"file://{tmp_path}/d.db").verdict == "FAILED"
    with open(f"{tmp_path}/e.dump", "wb") as f:
        f.write(b"PGDMP" + bytes(40))  # only a server reads this kind
    assert v.verify("pg", f"file://{tmp_path}/e.dump").exit_code == 3
    (tmp_path / "site/img").mkdir(parents=True)
    for i in range(4):
        (tmp_path / f"site/img/{i}").write_text(str(i))
    (tmp_path / "site/index").write_text("hello")
    with tarfile.open(tmp_path / "s.tgz", "w:gz") as t:
        t.add(tmp_path / "site", "site")
    out = v.verify("site", f"file://{tmp_path}/s.tgz")
    assert out.verdict == "PASSED" and out.kind == "tar"
    found = {r["item"]: r["rows"] for r in engine.sql("SELECT item, rows FROM counts WHERE job = 'site'").collect()}
    assert found == {"(total bytes)": 9, "site/img": 4, "site/index": 1}


def test_shell(engine):
    run = lambda line: list(cli.run_line(engine, line))
    assert run("CREATE TABLE notes (id INT PRIMARY KEY, body TEXT, score FLOAT)") == []
    assert run(".row insert notes 1 hello 2") == [] and run(".row get notes 1") == ["1|hello|2.0"]
    assert run("SELECT id, 1/0 FROM notes") == ["id|1/0", "1|NULL"]
    assert run(".tables") == ["notes"] and run(".check") == ["ok"] and run(".put b k v") == [] and run(".get b k") == ["v"]
    assert run("SELECT nope FROM notes") == ["error -9 SCHEMA: no such column: nope"] and run(".row del notes 1") == ["deleted"]
