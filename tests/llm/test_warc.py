import gzip
import hashlib

import pytest

from rankloom.llm import warc



def arc(version, *records):
    names = " ".join(warc.ARC_FIELDS[version])
    about = f"{version} 0 Maker\n{names}\n".encode()
    head = f"filedesc://x.arc 0.0.0.0 20000101000000 text/plain {len(about)}\n".encode()
    return head + about + b"\n" + b"\n".join(line.encode() + b"\n" + body for line, body in records)


BODY = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\nhttp://no.header/ 1.1.1.1 1 text/html 3\n</p>"


def test_version_1():
    data = arc(1, (f"http://a/ 1.2.3.4 19991231235959 text/html {len(BODY)}", BODY), ("dns:a 1.2.3.4 19991231 text/dns 3", b"\n\na"))
    first, second = warc.read_arc(data)
    assert first.fields["ip"] == "1.2.3.4" and first.body == BODY and first.payload.startswith(b"<p>")
    assert (second.fields["type"], second.body) == ("text/dns", b"\n\na")
    fields, block = next(warc.read_warc(warc.to_warc(second, None)))
    assert (fields["warc-type"], fields["content-type"], block) == ("resource", "text/dns", b"\n\na")
    assert fields["warc-date"] == "1999-12-31T00:00:00Z"


def test_version_2():
    line = f"http://b/ 0.0.0.0 20010203040506 text/html 404 abc - 77 f.arc {len(BODY)}"
    (record,) = warc.read_arc(arc(2, (line, BODY)))
    assert (record.fields["result"], record.fields["offset"], record.fields["filename"]) == ("404", "77", "f.arc")
    fields, block = next(warc.read_warc(warc.to_warc(record, None)))
    assert fields["warc-type"] == "response" and block == BODY and fields["warc-date"] == "2001-02-03T04:05:06Z"
    assert "warc-ip-address" not in fields and fields["arc-offset"] == "77"
    again, other = warc.to_warc(record, None), warc.to_warc(record, "somewhere else")
    assert again == warc.to_warc(record, None)
    fields, block = next(warc.read_warc(other + b"\r\n\r\n" + again))
    assert fields["warc-type"] == "revisit" and block == warc.split_http(BODY)[0]
    assert fields["warc-refers-to"] == warc.record_id("somewhere else")


@pytest.mark.parametrize("data", [b"http://a/ 1.2.3.4 text/html 3\nabc", b"http://a/ 1 2 text/html 9\nabc", b"no line end"])
def test_broken_archives(data):
    with pytest.raises(ValueError):
        list(warc.read_arc(data))


def test_broken_warc():
    with pytest.raises(ValueError):
        list(warc.read_warc(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    assert list(warc.read_warc(b"")) == [] and list(warc.read_arc(b"\n\n")) == []


SCHEMA = "page_id long, url string, html string, path string, name string, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    best = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            best[payload] = max(best.get(payload, -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = best.get(payload, i)
        again = len(payload) >= 1000 and i != first
        digest = hashlib.sha1(payload).hexdigest()
        out.append((i, len(payload), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r[n] for n in names) for r in warc.archived_pages(df).collect()), key=repr)


def test_round_trip(spark):
    large, other = "é" * 499 + "xy", "é" * 499 + "x"
    rows = [(k, f"http://h/{k}", large) for k in range(20)]
    rows += [(100 + k, None, other) for k in range(3)]
    rows += [(200, "", None), (201, "http://a b\tc", ""), (None, "u", "y" * 1500), (None, "u", "y" * 1500), (203, "u", "y" * 1500)]
    rows += [(204, "v", "WARC/1.1\r\n\r\nfiledesc://x 1 2 3 4\r\n\r\n" * 60), (205, "w", "\x00💥 <|endoftext|>\r\n"), (206, "z", "q" * 300_000)]
    assert got(pages(spark, rows)) == brute(rows)


def test_urls_like_version_blocks(spark):
    rows = [(1, "filedesc://pages.arc", "2 0 rankloom\nURL"), (2, "filedesc://", "x" * 1200), (3, "u", "x" * 1200),
            (4, "filedesc://a b", None)]
    assert got(pages(spark, rows)) == brute(rows)
    line = f"filedesc://b 0.0.0.0 20010203040506 text/html 404 abc - 77 f.arc {len(BODY)}"
    (record,) = warc.read_arc(arc(2, (line, BODY)))
    assert (record.fields["url"], record.body) == ("filedesc://b", BODY)


def test_empty(spark):
    assert got(pages(spark, [(1, "a", "b")]).limit(0)) == []


def test_files_are_plain_archives(spark, tmp_path):
    """What is written can be read without Spark, by the formats' own rules."""
    df = pages(spark, [(k, f"http://h/{k}", f"<p>{k % 3}" * 400) for k in range(30)])
    old, new = tmp_path / "arc", tmp_path / "warc"
    warc.write_arc(df, str(old))
    warc.convert(spark, str(old), str(new))
    records = [r for p in sorted(old.glob("part-*.gz")) for r in warc.read_arc(gzip.decompress(p.read_bytes()))]
    assert {int(r.fields["offset"]) for r in records} == set(range(30))
    made = [r for p in sorted(new.glob("part-*.gz")) for r in warc.read_warc(gzip.decompress(p.read_bytes()))]
    ids = [fields["warc-record-id"] for fields, _ in made]
    assert len(set(ids)) == 30
    assert sorted(f["warc-type"] for f, _ in made) == ["response"] * 3 + ["revisit"] * 27
    assert {f["warc-refers-to"] for f, _ in made if f["warc-type"] == "revisit"} <= set(ids)
