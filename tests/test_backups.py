"""Damaged backups, and the webhook."""

import gzip
import http.server
import io
import json
import sqlite3
import tarfile
import threading

import pytest

from sensorloom.errors import CorruptError
from sensorloom.sources import backups
from sensorloom.verify import Verifier


def shelf(path: str, n: int = 3000) -> bytes:
    db = sqlite3.connect(path)
    db.execute("create table books (id integer primary key, title text)")
    db.execute("create table tags (tag text primary key, n int) without rowid")
    db.executemany("insert into books values (?, ?)", [(i, f"title {i * 37 % 101}") for i in range(n)])
    db.executemany("insert into tags values (?, ?)", [(f"t{i}", i) for i in range(40)])
    db.commit()
    db.close()
    with open(path, "rb") as f:
        return f.read()


def test_sqlite_files_cut_and_lengthened(tmp_path):
    data = shelf(str(tmp_path / "a.db"))
    assert [i[:2] for i in backups.sqlite_items(str(tmp_path / "a.db"))] == [("books", 3000), ("tags", 40)]
    wrong = {"half": data[: len(data) // 2], "page": data[:-4096], "odd": data[:-100], "more": data + bytes(4096), "head": data[:60], "tree": data[: 3 * 4096] + b"\xcd" * 80 + data[3 * 4096 + 80 :]}
    for name, body in wrong.items():
        (tmp_path / name).write_bytes(body)
        with pytest.raises(CorruptError):
            backups.sqlite_items(str(tmp_path / name))


def test_sqlite_gzipped(spark, tmp_path):
    data = shelf(str(tmp_path / "a.db"), 50)
    (tmp_path / "a.db.gz").write_bytes(gzip.compress(data))
    found = [sorted(map(tuple, backups.sqlite_file(spark, f"file://{tmp_path}/{n}").collect())) for n in ("a.db", "a.db.gz")]
    assert found[0] == found[1] and [r[:2] for r in found[0]] == [("books", 50), ("tags", 40)]


def archive(members: list[tuple[str, bytes]], form: int = tarfile.PAX_FORMAT) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archives(form):
    members = [("d/one", b"x" * 3_000_000), ("d/two", b""), ("d/" + "long/" * 30 + "name", b"y")]
    if form == tarfile.USTAR_FORMAT:
        members.pop()
    data = archive(members, form)
    plain, zipped = (list(backups.tar_entries(backups.opened(x))) for x in (data, gzip.compress(data)))
    assert plain == zipped and [(e[0], e[2]) for e in plain] == [(n, len(b)) for n, b in members]


def test_damaged_archives():
    data = archive([("a", b"1" * 5000), ("b", b"2" * 5000)])
    zipped = bytearray(gzip.compress(data))
    zipped[-6] ^= 1  # the checksum of what it holds
    for bad in (data[:7000], gzip.compress(data)[:-30], bytes(zipped), archive([("../up", b"")]), archive([("/root", b"")]), b"no archive" * 200):
        with pytest.raises(CorruptError):
            list(backups.tar_entries(backups.opened(bad)))


def test_webhook(spark, engine):
    told = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            told.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    items = lambda n: spark.createDataFrame([("pumps", n, f"{n}")], "item string, rows long, checksum string")
    v = Verifier(engine)
    try:
        assert "not called" in v.verify("job", items=items(100), webhook=url).report and not told
        assert "sent (204)" in v.verify("job", items=items(10), webhook=url).report
        v.verify("job", items=items(100), webhook=url, webhook_always=True)
    finally:
        server.shutdown()
        server.server_close()
    assert [(t["verdict"], t["run"], len(t["reasons"])) for t in told] == [("ALERT", 2, 1), ("PASSED", 3, 0)]
    assert "failed" in v.verify("job", items=items(1), webhook=url).report
