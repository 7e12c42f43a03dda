"""WARC files: linear time, broken records beside good ones, chunk headers of any length."""

import gzip
import random
import time

import pytest

from ledgerline.llm import warc


def some(n, size=200):
    r = random.Random(n)
    return [warc.response(k, f"http://h/{k}", "<p>" + "".join(r.choice("abc <>\r\nWARC/1.0") for _ in range(r.randrange(size)))).to_bytes() for k in range(n)]


def told(data):
    return [x.reason if isinstance(x, warc.Broken) else x.to_bytes() for x in warc.records(data)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_plain_and_packed_files_give_their_records(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    made = some(12)
    assert told(b"".join(made)) == told(b"".join(map(gzip.compress, made))) == told(gzip.compress(b"".join(made))) == made
    assert told(b"") == told(b"\r\n\r\n") == []


def test_broken_records_leave_the_others(monkeypatch):
    made = some(6)
    cut = made[2][:-40]
    assert told(b"".join([*made[:2], b"junk\r\n", made[3]])) == [*made[:2], "no WARC record", made[3]]
    assert told(made[0] + made[1].replace(b"Content-Length: ", b"Content-Length: x", 1).replace(b"Content-Length: x", b"Content-Length: x") + made[2])[0] == made[0]
    assert told(made[0] + cut)[-1] == "the record is cut off"
    assert told(b"WARC/1.0\r\nContent-Length: 5")[-1] == "the record is cut off"
    bad = b"WARC/1.0\r\nContent-Length: many\r\n\r\nabc\r\n\r\n"
    assert told(made[0] + bad + made[1]) == [made[0], "Content-Length 'many'", made[1]]
    with pytest.raises(ValueError):
        list(warc.parse(bad))


def test_broken_members_leave_the_others():
    made = some(5)
    packed = [gzip.compress(m) for m in made]
    packed[2] = packed[2][:20] + bytes(40) + packed[2][60:]
    got = told(b"".join(packed))
    assert [x for x in got if isinstance(x, bytes)] == [made[k] for k in (0, 1, 3, 4)]
    assert "a broken gzip member" in got
    assert told(b"".join(packed[:2]) + packed[3][:-12])[:2] == made[:2]


@pytest.mark.parametrize("pack", [False, True])
def test_files_take_linear_time(pack):
    """Of small members as of large ones: about as long for each byte."""
    took = []
    for n in (2_000, 16_000):
        made = [warc.response(k, "http://h/", "x" * 3000).to_bytes() for k in range(n)]
        data = b"".join(map(gzip.compress, made)) if pack else b"".join(made)
        began = time.process_time()
        assert sum(1 for _ in warc.records(data)) == n
        took.append((time.process_time() - began) / n)
    assert took[1] < 4 * took[0] + 1e-5


def test_hostile_files_take_linear_time():
    began = time.process_time()
    for data in (b"WARC/1.0 x\n" * 200_000, b"x" * 3_000_000, b"WARC/1.0\r\nContent-Length: x\r\n\r\n" * 60_000, b"\r\n" * 1_000_000):
        list(warc.records(data))
    assert time.process_time() - began < 30


def test_chunk_headers_of_any_length():
    long = b"4;" + b"e" * 5000 + b"\r\nabcd\r\n" + b"3 ;x=1\r\nefg\r\n0\r\n\r\n"
    assert warc._unchunked(long) == b"abcdefg"
    for plain in (b"no chunk\r\nx", b"\r\n", b"", b"12345678901234567\r\nx", b"-4\r\nabcd"):
        assert warc._unchunked(plain) == plain


def test_broken_records_are_rows(spark, tmp_path):
    made = some(3)
    (tmp_path / "a.warc").write_bytes(made[0] + b"junk\r\n" + made[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(made[2]))
    rows = warc.read_files(spark, f"{tmp_path}/*").collect()
    assert sorted(bytes(r.record) for r in rows if r.record is not None) == sorted(made)
    assert [r.error for r in rows if r.error] == [f"no WARC record at byte {len(made[0])}"]
    derived = warc.file_derivatives(spark, f"{tmp_path}/*").collect()
    assert sorted(r.record_type for r in derived if r.record_type) == ["conversion"] * 3 + ["metadata"] * 3 and sum(r.error is not None for r in derived) == 1
