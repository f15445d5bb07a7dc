import gzip
import hashlib
import io
import zipfile

import pytest

from shelfspark.llm import warc


class Bytes(io.BytesIO):
    pass


def records(n):
    for i in range(n):
        payload = (f"p{i} \n\r\n" * (i % 7)).encode()
        yield str(i), warc.warc_record(str(i), "response", f"http://a/{i}\né", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("n,per", [(0, 4), (1, 4), (9, 4), (8, 4)])
def test_package_opens_in_the_standard_library(n, per):
    chunks = list(warc.package(records(n), per))
    assert all(c.endswith(b"\0") for c in chunks)
    raw = b"".join(chunks)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and len(z.namelist()) == 2 * max(1, -(-n // per)) and z.comment == b"\0"
        assert b"".join(gzip.decompress(z.read(m)) for m in z.namelist() if m.endswith(".warc.gz")) == b"".join(r for _, r in records(n))
    got = list(warc.zip_members(Bytes(raw), len(raw)))
    for m in got:
        start = warc.stored_start(Bytes(raw), m)
        assert len(raw[start:start + m["size"]]) == m["size"] == m["packed"]


@pytest.mark.parametrize("zip64,comment", [(False, b""), (True, b"note PK\x05\x06 inside"), (False, b"c" * 65535)])
def test_reads_packages_of_others(zip64, comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(300):
            with z.open(zipfile.ZipInfo(f"a/{i}"), "w", force_zip64=zip64) as f:
                f.write(b"x" * i)
        z.writestr(zipfile.ZipInfo("packed"), b"y" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = comment
    raw = out.getvalue()
    got = list(warc.zip_members(Bytes(raw), len(raw)))
    assert [m["name"] for m in got] == [f"a/{i}" for i in range(300)] + ["packed"] and got[-1]["method"] == 8
    for m in got[:300]:
        start = warc.stored_start(Bytes(raw), m)
        assert raw[start:start + m["size"]] == b"x" * int(m["name"][2:])


def test_long_records_end_in_a_zero_byte(monkeypatch):
    for data in (b"", b"x", b"abc" * 9_000_000):
        got = warc.compressed(data)
        assert gzip.decompress(got) == data if data else got == b""
        assert got[-1:] in (b"", b"\0")


def test_not_a_package():
    with pytest.raises(ValueError):
        list(warc.zip_members(Bytes(b"x" * 100), 100))


def test_round_trip(spark, tmp_path):
    long = "é\n" * 200_000
    rows = [(1, "http://x/\r\nEvil: 1", None, 7), (2, None, "", 7), (5, "u", long, 7), (3, "u", long, 7), (4, "u", "a" * 99, 7), (6, "u", "a" * 99, 7),
            (8, "u", "b" * 100, 7), (7, "u", "b" * 100, 7), (7, "u", "b" * 100, 7), (None, "u", "b" * 100, 7), (-9, "u", "PK\x05\x06\r\n\r\nWARC/1.1", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    path = str(tmp_path / "packs")
    warc.write_packages(warc.with_revisits(pages), path)
    entries = warc.index_entries(warc.package_members(warc.list_packages(spark, path)), piece=64)
    got = sorted((tuple(r) for r in warc.read_back(warc.read_records(entries, 4)).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None]
        first = min(same) if len(raw) >= 100 else i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    empty = str(tmp_path / "none")
    warc.write_packages(warc.with_revisits(pages.filter("false")), empty)
    assert warc.read_back(warc.read_records(warc.index_entries(warc.package_members(warc.list_packages(spark, empty))))).count() == 0


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op2_warc_packages"](spark, sf), connect(sf), ORACLES["op2_warc_packages"]) == ""
