"""The byte tail loses and repeats nothing over restarts, split ranges, partial and bad lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza.sources import tail
from cadenza.streaming.pipelines import drain

SCHEMA = "n int, who string"


def _line(n, who="a"):
    return json.dumps({"n": n, "who": who}).encode() + b"\n"


def _drained(spark, path, check, **kw):
    seen = []
    drain(tail.tail_stream(spark, str(path), SCHEMA, **kw), lambda df, _: seen.extend(r["n"] for r in df.orderBy("path", "at").collect()), str(check))
    return seen


def test_restart_in_the_middle_of_a_file(spark, tmp_path):
    """Every cut of the bytes into three arrivals gives each entry once."""
    whole = b"".join([_line(0), b"not json\n", _line(1), b"\n", b'[1]\n', _line(2), "{\"n\": 3, \"who\": \"ü\"}\n".encode(), b'{"n": 4, "who"'])
    rng = random.Random(7)
    for k in range(3):
        log, check = tmp_path / f"{k}.jsonl", tmp_path / f"check{k}"
        cuts = sorted(rng.sample(range(1, len(whole)), 2))
        seen = []
        for to in (*cuts, len(whole)):
            log.write_bytes(whole[:to])
            seen += _drained(spark, log, check)
        assert seen == [0, 1, 2, 3]
        log.write_bytes(whole + b': "b"}\n')
        assert _drained(spark, log, check) == [4]
        assert _drained(spark, log, check) == []


def test_folder_of_files(spark, tmp_path):
    log, check = tmp_path / "logs", tmp_path / "check"
    log.mkdir()
    (log / "a.jsonl").write_bytes(_line(1) + _line(2)[:5])
    (log / "_tmp").write_bytes(_line(9))
    assert _drained(spark, log, check) == [1]
    (log / "a.jsonl").write_bytes(_line(1) + _line(2))
    (log / "b.jsonl").write_bytes(_line(3))
    assert _drained(spark, log, check) == [2, 3]


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_ranges_own_the_lines_that_start_in_them(tmp_path, step, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK_BYTES", 5)
    rng = random.Random(step)
    lines = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    file = tmp_path / "x"
    file.write_bytes(b"".join(x + b"\n" for x in lines) + b"open")
    log = tail.Log.at(str(file))
    end = log.latest({})
    assert end == {str(file): file.stat().st_size - 4}
    got = [r for p in tail.ranges({}, end, step) for r in log.lines(*p.value)]
    assert [r[2].encode() for r in got] == lines
    since = got[30][0]
    again = [r for p in tail.ranges({str(file): since}, end, step) for r in log.lines(*p.value)]
    assert again == got[30:]


def test_read_since_with_filter_and_limit(spark, tmp_path):
    log = tmp_path / "x.jsonl"
    log.write_bytes(b"".join(_line(i, "ab"[i % 2]) + b"bad\n" * (i % 3 == 0) for i in range(10)) + b'{"n": 99')
    got, since = [], {}
    for _ in range(4):
        rows, since = tail.read_since(spark, str(log), SCHEMA, since, F.col("who") == "a", limit=2)
        got.append([r["n"] for r in rows.collect()])
    assert got == [[0, 2], [4, 6], [8], []]
    assert since == {str(log): log.stat().st_size - len(b'{"n": 99')}
    rows, _ = tail.read_since(spark, str(log), SCHEMA)
    assert rows.count() == 10


def test_bad_positions(spark, tmp_path):
    log = tmp_path / "x.jsonl"
    log.write_bytes(_line(1))
    for since in (3, 1000):
        with pytest.raises(ValueError, match="position"):
            tail.read_since(spark, str(log), SCHEMA, {str(log): since})
    assert tail.read_since(spark, str(tmp_path / "none"), SCHEMA)[1] == {}
    assert tail.read_since(spark, str(tmp_path / "none"), SCHEMA)[0].count() == 0
