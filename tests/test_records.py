from __future__ import annotations

from rillframe.sources.records import HEADER, MAGIC, read_records, records, splice_section


def record(n, pts_us, magic=MAGIC, width=2):
    return HEADER.pack(magic, 2, n, 48000, width, pts_us // 1_000_000, pts_us % 1_000_000 * 1000) + b"".join(int(v).to_bytes(width, "little", signed=True) for i in range(n) for v in (i, -i))


def test_records(spark, tmp_path):
    blob = record(3, 1_500_000) + HEADER.pack(7, 0, 0, 0, 0, 0, 0) + record(2, 2_000_001, width=4) + record(5, 3)[:-1]
    (tmp_path / "a.bin").write_bytes(blob)
    got = [tuple(r)[1:] for r in read_records(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, 1_500_000, 48000, 2, 3, [[0.0, 1.0, 2.0], [0.0, -1.0, -2.0]]), (1, 2_000_001, 48000, 4, 2, [[0.0, 1.0], [0.0, -1.0]])]


def test_skips_whole_records():
    blob = b"".join(record(10, i) for i in range(6))
    assert [r[0] for r in records(blob, 25)] == [3, 4, 5]
    assert [r[0] for r in records(blob, 10)] == [1, 2, 3, 4, 5]
    assert list(records(b"")) == []


def test_splice_section(spark):
    section = bytes.fromhex("fc302500000000000000fff01405")
    df = spark.createDataFrame([(1, bytearray(section)), (2, bytearray(b"\x00" * 14)), (3, None), (4, bytearray(b"\xfc"))], "id int, payload binary")
    got = {r["id"]: r["s"] for r in df.select("id", splice_section(df.payload).alias("s")).collect()}
    assert got[1].asDict() == {"section_length": 0x25, "protocol_version": 0, "encrypted": False, "pts_adjustment": 0, "cw_index": 0, "tier": 0xFFF, "command_length": 0x14, "command_type": 5}
    assert got[2] is None and got[3] is None and got[4] is None
