"""Reading ranges into XML, and the JSON envelope."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from repoloom.operators import read


def run(spark, files, asked, **more):
    rows = [("r", "p", p, i, lines) for i, (p, lines) in enumerate(asked)]
    requests = spark.createDataFrame(rows, "req_id string, project string, path string, pos long, line_range string")
    elements = read.read_files(files, requests, **more)
    doc = "".join(r.xml for r in read.bundle(elements).orderBy("part").collect())
    ET.fromstring(doc)
    return doc, {r.pos: r for r in elements.collect()}


def test_bundle(spark, make_files):
    files = make_files({
        "hello.go": "package main\n\nfunc main() {}\n", "long.txt": "xx\n" * 50, "bad.js": "var re = /foo]]>bar/;\n", "blob.bin": b"PK\x03\x04\x00\x00binary",
        "short.txt": "one\ntwo\n", "dos.txt": "one\r\ntwo\r\n", "empty": "", "d/in.txt": "x", "odd<&>'\".txt": "y", "noend": "a\nb",
    })
    asked = [("hello.go", ""), ("long.txt", "10-15"), ("bad.js", ""), ("does-not-exist.txt", ""), ("../../etc/passwd", ""), ("/etc/passwd", ""), ("blob.bin", ""),
             ("short.txt", "500-510"), ("dos.txt", ""), ("empty", ""), ("d", ""), ("odd<&>'\".txt", ""), ("long.txt", "0"), ("short.txt", "9-2"), ("./d/../d//in.txt", ""),
             ("long.txt", "49-99"), ("noend", "2")]
    doc, rows = run(spark, files, asked)
    assert rows[0].xml == '  <file path="hello.go" lines="1-3">\n<![CDATA[\n1 | package main\n2 | \n3 | func main() {}\n]]>\n  </file>\n'
    assert 'lines="10-15"' in rows[1].xml and "10 | xx" in rows[1].xml and " 9 | xx" not in rows[1].xml and "16 | xx" not in rows[1].xml
    assert "]]]]><![CDATA[>" in rows[2].xml
    assert rows[3].error.startswith("stat") and "escapes" in rows[4].error and "absolute" in rows[5].error
    assert rows[6].error == "binary file (12 bytes), not emitted"
    assert rows[7].note == "requested lines 500-510 out of range: file has 2 lines"
    assert "\r" not in rows[8].xml and "1 | one\n2 | two\n" in rows[8].xml
    assert rows[9].note == "requested lines 0-0 out of range: file has 0 lines"
    assert rows[10].error == "is a directory"
    assert 'path="odd&lt;&amp;&gt;&apos;&quot;.txt"' in rows[11].xml
    assert (rows[12].first, rows[12].last) == (1, 50) and " 1 | xx" in rows[12].xml
    assert rows[13].error == "lines flag: --lines range start > end"
    assert "1 | x\n" in rows[14].xml
    assert (rows[15].first, rows[15].last) == (49, 50)
    assert "2 | b\n]]>" in rows[16].xml
    assert doc.startswith('<files version="1" command="read-files">\n') and doc.endswith("</files>\n")


def test_sizes(spark, make_files):
    files = make_files({"big.txt": "0123456789\n" * 300})
    _, rows = run(spark, files, [("big.txt", ""), ("big.txt", "10-11")], max_kb=1)
    assert rows[0].error == "exceeds --max-size limit (3300 bytes > 1024 bytes)"
    assert "10 | 0123456789" in rows[1].xml


def test_large_requests_come_in_parts(spark, make_files):
    files = make_files({f"f{i}": str(i) for i in range(25)})
    requests = spark.createDataFrame([("r", "p", f"f{i}", i, "") for i in range(25)], "req_id string, project string, path string, pos long, line_range string")
    parts = read.bundle(read.read_files(files, requests), files_per_part=10).orderBy("part").collect()
    assert [p.files for p in parts] == [10, 10, 5]
    assert len(ET.fromstring("".join(p.xml for p in parts))) == 25


def test_envelope(spark):
    df = spark.createDataFrame([("a&<b>", None, [])], "url string, gone string, items array<string>")
    text = df.select(read.json_envelope(df, "list", ["url", "gone", "items"])).first()[0]
    assert text == '{"_meta":{"version":"1","command":"list"},"url":"a&<b>","items":[]}'
    pretty = df.select(read.json_envelope(df, "list", ["url"], indent=True)).first()[0]
    assert "\n" in pretty and json.loads(pretty)["url"] == "a&<b>"
    with pytest.raises(ValueError):
        read.json_envelope(df, "list", [])
    assert df.select(F.lit(1)).count() == 1
