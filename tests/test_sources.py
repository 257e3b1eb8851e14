import random
import struct

import numpy as np
import pytest

from chanspark.sources import frames, packets

ROW = {"label": "empty", "pc_timestamp": 1.5, "capture_timestamp": 2.5, "esp_timestamp_us": 7, "sequence": 9, "packet_index": 3, "rssi": -40, "rate": 11, "channel": 6, "csi_len": 8, "flags": 5, "imag": [1, -2, 3, 4], "real": [5, 6, -7, 8]}


def _v1(label, imag, real):
    head = struct.pack("<7sI", b"CSIBIN1", 1) + struct.pack("<HdiiiiI", len(label.encode()), 1.5, -40, 11, 6, 8, len(imag)) + label.encode()
    return head + np.array(imag, "<i2").tobytes() + np.array(real, "<i2").tobytes()


def test_round_trip():
    rows = [ROW, ROW | {"label": "ü", "imag": [], "real": []}, ROW | {"label": "", "imag": [1, 2, 3], "real": [1]}]
    got = list(packets.packet_rows(packets.packet_bytes(rows)))
    assert [g["pos"] for g in got] == [0, 1, 2]
    for field in ("label", "pc_timestamp", "capture_timestamp", "sequence", "rssi", "flags"):
        assert [g[field] for g in got] == [r[field] for r in rows]
    assert [list(g["imag"]) for g in got] == [[1, -2, 3, 4], [], [1]]


def test_version_1_gets_defaults():
    (got,) = packets.packet_rows(_v1("static", [1, 2], [3, 4]))
    assert (got["capture_timestamp"], got["esp_timestamp_us"], got["sequence"], got["flags"], got["packet_index"], got["file_version"]) == (1.5, 0, 0, 0, 1, 1)


@pytest.mark.parametrize("content", [b"", b"CSIBIN1", b"NOTBIN1\x02\0\0\0", struct.pack("<7sI", b"CSIBIN1", 3), packets.packet_bytes([ROW])[:-1], packets.packet_bytes([ROW])[:30]])
def test_damaged_files(content):
    with pytest.raises(ValueError):
        list(packets.packet_rows(content))


def test_folder(spark, tmp_path):
    for k, name in enumerate(("session_01/quad1/empty/a.bin", "session_01/Quad2/presence/b.bin", "session_02/quad1/none/movement_x.bin", "loose/c.bin", "session_01/quad1/empty/bad.bin")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"junk" if "bad" in name else packets.packet_bytes([ROW] * (k + 1)))
    got = packets.read(spark, str(tmp_path), malformed="drop")
    n = {(r["session"], r["quadrant"], r["path_label"]): r["count"] for r in got.groupBy("session", "quadrant", "path_label").count().collect()}
    assert n == {("session_01", "quad1", "empty"): 1, ("session_01", "quad2", "static_presence"): 2, ("session_02", "quad1", "movement"): 3}
    assert packets.read(spark, str(tmp_path), labels=["movement"], quadrants=["quad1"]).count() == 3
    assert packets.exploded(got).count() == 6 * 4
    with pytest.raises(Exception, match="no packet file|cut short"):
        packets.read(spark, str(tmp_path)).count()


def test_lines(spark):
    texts = ["CSI,5,-40,11,6,4,1,2,3,4", "CSI,5,-40,11,6,3,3,4,9", "CSX,5,-40,11,6,4,1,2,3,4", "CSI,5,-40,11,6,4,1,2,3", "CSI,5,x,11,6,2,1,2", "CSI,5", None]
    got = packets.lines(spark.createDataFrame([(t,) for t in texts], "value string")).orderBy("csi_len").collect()
    assert [(r["csi_len"], r["imag"], r["real"]) for r in got] == [(3, [3], [4]), (4, [1, 3], [2, 4])]
    assert got[0]["amplitude"] == [5.0]


def test_checksum():
    assert frames.crc16(b"123456789") == 0x29B1


def _sample(sequence, values=(1, 2, 3, 4)):
    return frames.frame(1, struct.pack("<IQbBBBH", sequence, 1000 + sequence, -40, 11, 6, 0, len(values)) + bytes(values))


def test_parser_finds_its_way():
    stats = frames.frame(2, struct.pack("<Q6I2H", 5, *range(1, 7), 7, 8))
    broken = bytearray(_sample(3))
    broken[-1] ^= 1
    stream = b"noise" + _sample(1) + _sample(2, (1, 2, 3)) + bytes(broken) + b"CSI2\x09" + stats + frames.frame(9, b"??") + _sample(6) + _sample(6) + b"CS"
    whole = frames.Parser()
    want = whole.feed(stream)
    assert [e.get("sequence") for e in want] == [1, 2, None, 6, 6]
    assert list(want[1]["imag"]) == [1.0] and want[2]["stats"]["reserved"] == 8
    c = whole.counters()
    assert (c["sample_frames"], c["stats_frames"], c["unsupported_frames"], c["crc_errors"]) == (4, 1, 1, 1)
    assert c["sequence_gaps"] == 3 and whole.pending == b"CS" and c["invalid_frames"] >= 1
    for seed in range(20):
        random.seed(seed)
        parser, got, at = frames.Parser(), [], 0
        while at < len(stream):
            n = random.randint(1, 40)
            got += parser.feed(stream[at : at + n])
            at += n
        assert [e.get("sequence") for e in got] == [e.get("sequence") for e in want] and parser.counters() == c


def test_parse_by_device(spark):
    stream = b"".join(_sample(k) for k in range(50))
    rows = [(d, k, stream[at : at + 37]) for d in ("a", "b") for k, at in enumerate(range(0, len(stream), 37))] + [("c", 0, None)]
    random.shuffle(rows)
    got = frames.parse(spark.createDataFrame(rows, "device string, chunk_index int, data binary")).collect()
    assert [r["sequence"] for r in got if r["device"] == "a" and r["type"] == "sample"] == list(range(50))
    assert {r["device"]: r["counters"]["sample_frames"] for r in got if r["type"] == "counters"} == {"a": 50, "b": 50, "c": 0}
