"""Text dumps read without a server: against the rows that were written, whole, split, gzipped and damaged."""

import gzip
import random

import pytest

from sensorloom.errors import CorruptError
from sensorloom.sources import dumps
from sensorloom.verify import Verifier

HEAD, TAIL = "--\n-- PostgreSQL database dump\n--\n", "--\n-- PostgreSQL database dump complete\n--\n"


def row_of(rng: random.Random, i: int) -> str:
    """A row of a COPY block; now and then one that looks like a line of the dump itself."""
    odd = ["COPY public.parts (id) FROM stdin;", "INSERT INTO x VALUES (1);", "-- PostgreSQL database dump complete", "\\\\.", "\\N"]
    return f"{i}\t{rng.choice(odd) if rng.random() < 0.1 else 'bolt %d' % rng.randrange(99)}" if rng.random() < 0.9 else rng.choice(odd[:3])


def written(seed: int, tables: dict[str, int]) -> tuple[str, dict[str, list[str]]]:
    rng, out, rows = random.Random(seed), [HEAD], {}
    for name, n in tables.items():
        rows[dumps.plain_name(name)] = lines = [row_of(rng, i) for i in range(n)]
        out.append(f"CREATE TABLE {name} (\n    id integer,\n    label text\n);\n\n")
        out.append("".join(f"{x}\n" for x in [f"COPY {name} (id, label) FROM stdin;", *lines, "\\."]) + "\n")
    return "".join(out) + TAIL, rows


def expected(rows: dict[str, list[str]]) -> list[tuple[str, int, str]]:
    return [(t, len(r), f"{sum(map(dumps.row_sum, r)) % 2**64:016x}") for t, r in sorted(rows.items())]


@pytest.mark.parametrize("part", [1 << 27, 4001, 257])
def test_copy_blocks_in_any_parts(spark, tmp_path, part):
    text, rows = written(3, {"shop.parts": 400, '"odd "" name"': 60, "empty": 0, "last": 7})
    (tmp_path / "d.sql").write_text(text)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        assert dumps.dump_items(spark, f"file://{tmp_path}/d.sql") == expected(rows)
        if part < len(text):
            assert dumps.sections(spark, f"file://{tmp_path}/d.sql").select("at").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_gzip_is_the_same(spark, tmp_path):
    text, rows = written(4, {"a": 50, "b": 3})
    (tmp_path / "d.sql.gz").write_bytes(gzip.compress(text.encode()))
    assert dumps.dump_items(spark, f"file://{tmp_path}/d.sql.gz") == expected(rows)


def test_inserts(spark, tmp_path):
    text = "-- MySQL dump 10.13\nCREATE TABLE `t;1` (\n  `VALUES` int\n);\n" + "INSERT INTO `t;1` (`VALUES`, b) VALUES (1,'a),(b'),(2,'it''s; \\'x'),(3,NULL);\nINSERT INTO `t;1` VALUES (4,'\\\\');\nCREATE TABLE `none` (a int);\n-- Dump completed on some day\n"
    (tmp_path / "m.sql").write_text(text)
    want = {"t;1": ["1,'a),(b'", "2,'it''s; \\'x'", "3,NULL", "4,'\\\\'"], "none": []}
    assert dumps.dump_items(spark, f"file://{tmp_path}/m.sql") == expected(want)


@pytest.mark.parametrize(
    "text, said",
    [
        (HEAD + "COPY a (x) FROM stdin;\n1\n2\n", "cut short"),
        (HEAD + "COPY a (x) FROM stdin;\n1\n\\.\n", "cut short"),
        (HEAD + "\\.\n" + TAIL, "never began"),
        (HEAD + "\\! rm -rf x\n" + TAIL, "client"),
        (HEAD + "INSERT INTO a VALUES ('x\ny');\n" + TAIL, "next line"),
        ("", "cut short"),
    ],
)
def test_damaged_and_refused(spark, tmp_path, text, said):
    (tmp_path / "x.sql").write_text(text)
    with pytest.raises(CorruptError, match=said):
        dumps.dump_items(spark, f"file://{tmp_path}/x.sql")


def test_verifier_counts_but_does_not_vouch(spark, engine, tmp_path):
    """Without a server a dump is never PASSED, unless the caller takes counted rows for enough."""
    path = lambda name, n: (tmp_path / name).write_text(written(1, {"parts": n, "notes": 9})[0]) and f"file://{tmp_path}/{name}"
    v = Verifier(engine)
    out = v.verify("pg", path("a.sql", 300))
    assert (out.verdict, out.exit_code) == ("NOT VERIFIED", 3) and "300" in out.report
    assert v.verify("pg", path("a.sql", 300), count_dumps=True).verdict == "PASSED"
    assert v.verify("pg", path("b.sql", 200)).verdict == "ALERT"
    assert v.verify("pg", path("b.sql", 299)).verdict == "NOT VERIFIED"
    (tmp_path / "c.sql").write_text(written(1, {"parts": 300})[0][:900])
    assert v.verify("pg", f"file://{tmp_path}/c.sql").verdict == "FAILED"
