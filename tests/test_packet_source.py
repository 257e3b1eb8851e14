"""The packet data source against reading files one by one, and what its writer leaves."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chanspark.sources import packet_source, packets


def _row(k, n=4, label="empty"):
    return {"label": label, "pc_timestamp": k + 0.5, "capture_timestamp": k + 0.25, "esp_timestamp_us": 7 * k, "sequence": k, "packet_index": k + 1, "rssi": -40 - k % 5, "rate": 11, "channel": 6, "csi_len": 2 * n, "flags": k % 7, "imag": [k % 300, *range(n - 1)][:n], "real": [-(k % 300), *range(n - 1)][:n]}


def _v1(rows):
    out = [struct.pack("<7sI", b"CSIBIN1", 1)]
    for label, stamp, imag, real in rows:
        out += [struct.pack("<HdiiiiI", len(label.encode()), stamp, -40, 11, 6, 8, len(imag)), label.encode(), np.array(imag, "<i2").tobytes(), np.array(real, "<i2").tobytes()]
    return b"".join(out)


@pytest.fixture
def folder(spark, tmp_path):
    packet_source.register(spark)
    ragged = [_row(k, [4, 4, 0, 7, 3000][k % 5], ["empty", "é", ""][k // 7 % 3]) for k in range(300)]
    files = {"session_01/quad1/empty/a.bin": packets.packet_bytes([_row(k) for k in range(5000)]), "session_01/QUAD2/presence/b.bin": packets.packet_bytes(ragged), "session_02/quad1/none/movement_x.bin": _v1([("static", 1.5, [1, 2], [3, 4]), ("x\0", 2.5, [], [])]), "session_02/quad1/empty/none.bin": packets.packet_bytes([])}
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "session_02" / "notes.txt").write_text("no packets")
    return tmp_path


def _plain(df):
    return sorted(tuple(str(r[c]) if c != "path" else r[c].split("/")[-1] for c in packets.COLUMNS) for r in df.collect())


@pytest.mark.parametrize(("split", "block"), [(1 << 30, 1 << 22), (20_000, 500), (1, 1)])
def test_reads_what_the_files_have(spark, folder, monkeypatch, split, block):
    """Whole files, files cut into many parts, and parts of one packet."""
    monkeypatch.setattr(packet_source, "BLOCK", block)
    paths = [str(p) for p in sorted(folder.rglob("*.bin")) if split > 1 or p.name != "a.bin"]
    want = sorted(tuple(str({**r, "path": p, "imag": r["imag"].tolist(), "real": r["real"].tolist()}[c]) if c != "path" else p.split("/")[-1] for c in packets.COLUMNS) for p in paths for r in packets.packet_rows(Path(p).read_bytes()))
    root = str(folder) if split > 1 else str(folder / "session_01/QUAD2")
    got = spark.read.format("packets").option("splitBytes", split).load(root)
    if split == 1:
        want = [w for w in want if w[0] == "b.bin"]
    assert _plain(got) == want
    if split == 20_000:
        assert got.rdd.getNumPartitions() > 10


def test_filters_on_the_path(spark, folder):
    got = spark.read.format("packets").load(str(folder))
    assert {(r["session"], r["quadrant"], r["path_label"], r["count"]) for r in got.groupBy("session", "quadrant", "path_label").count().collect()} == {("session_01", "quad1", "empty", 5000), ("session_01", "quad2", "static_presence", 300), ("session_02", "quad1", "movement", 2)}
    (folder / "session_01/quad1/empty/bad.bin").write_bytes(b"junk")
    got = spark.read.format("packets").load(str(folder))
    assert got.where("session = 'session_02' AND rssi = -40").count() == 2  # the damaged file is not opened
    assert got.where(F.col("path_label").isin("movement", "static_presence") & (F.col("quadrant") == "quad1")).count() == 2
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("packets").load(str(folder)).count()


@pytest.mark.parametrize("content", [b"NOTBIN1\x02\0\0\0", struct.pack("<7sI", b"CSIBIN1", 3), packets.packet_bytes([_row(1)])[:-1], packets.packet_bytes([_row(1)])[:30]])
def test_damaged_files(spark, tmp_path, content):
    packet_source.register(spark)
    (tmp_path / "x.bin").write_bytes(content)
    with pytest.raises(Exception, match="cut short|no packet file|not supported"):
        spark.read.format("packets").load(str(tmp_path)).count()


def test_writes_and_reads_again(spark, folder, tmp_path):
    out = str(tmp_path / "out/session_09/quad3/empty")
    own = spark.read.format("packets").option("splitBytes", 20_000).load(str(folder / "session_01")).drop(*packet_source.PATH)
    own.repartition(4).write.format("packets").mode("append").save(out)
    drop = lambda df: sorted(tuple(str(r[c]) for c in packets.COLUMNS if c not in ("path", "pos")) for r in df.collect())
    assert drop(spark.read.format("packets").load(out)) == drop(own) and len(list(Path(out).iterdir())) == 4
    own.limit(3).coalesce(1).write.format("packets").mode("append").save(out)
    assert spark.read.format("packets").load(out).count() == 5303
    own.limit(3).coalesce(1).write.format("packets").mode("overwrite").save(out)
    assert spark.read.format("packets").load(out).count() == 3 and len(list(Path(out).iterdir())) == 1


def test_a_repeated_task_leaves_no_second_file(tmp_path, monkeypatch):
    """Two attempts of one task, of which the second is committed; and a job that is given up."""
    import pyspark

    class Context:
        attempt = 0

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            Context.attempt += 1
            return Context.attempt

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Context()))
    batch = packet_source.pa.RecordBatch.from_pylist([_row(1), _row(2)])
    writer = packet_source.PacketWriter({"path": str(tmp_path)}, False)
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.file != done.file
    writer.commit([done, None])
    (file,) = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(list(packets.packet_rows(file.read_bytes()))) == 2
    other = packet_source.PacketWriter({"path": str(tmp_path)}, False)
    other.abort([other.write(iter([batch]))])
    assert [p for p in tmp_path.rglob("*")] == [file]


def test_splits_read_headers_only(tmp_path):
    """A file with holes of 2.5 GB is split in no time, at packets."""
    path, n, size = tmp_path / "long.bin", 25_000_000, 60
    with path.open("wb") as f:
        f.write(packets.FILE_HEADER.pack(packets.MAGIC, 2))
        for k in range(25):
            f.write(packets.HEADERS[2].pack(0, 1.0, 1.0, 0, k, k, 0, 0, 0, 0, n, 0))
            f.seek(4 * n, 1)
        f.truncate(f.tell())
    store, root = packet_source._store(str(path))
    parts = packet_source.splits(store, root, path.stat().st_size, 300_000_000)
    assert path.stat().st_size > 2**31 and [p.pos for p in parts] == list(range(0, 25, 3))
    assert all(a.stop == b.start for a, b in zip(parts, parts[1:], strict=False)) and parts[-1].stop == path.stat().st_size
