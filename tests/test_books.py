"""Books: pages are read once and handed on together."""

import io
import zipfile

import pyarrow as pa

from quaverlake.sources import books


def archive(*pages):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("book.xml", "<book/>")
        for number, xml in pages:
            z.writestr(f"sheet#{number}/sheet#{number}.xml", xml)
    return buffer.getvalue()


def test_small_pages_go_on_together():
    contents = [archive((1, f"<a{i}/>"), (2, "<b/>")) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(51)], "content": pa.array([*contents, None], pa.binary())})
    out = list(books._unzip()(iter([batch, batch])))
    assert len(out) == 1 and out[0].num_rows == 200
    assert out[0].slice(0, 3).to_pylist() == [{"doc_id": "0", "page": 1, "xml": "<a0/>"}, {"doc_id": "0", "page": 2, "xml": "<b/>"}, {"doc_id": "1", "page": 1, "xml": "<a1/>"}]


def test_large_pages_go_on_by_themselves():
    batch = pa.RecordBatch.from_pydict({"doc_id": ["0"], "content": pa.array([archive((1, "x" * 1_200_000), (2, "y" * 1_200_000), (3, "z"))], pa.binary())})
    assert [b.column("page").to_pylist() for b in books._unzip()(iter([batch]))] == [[1], [2], [3]]
    assert list(books._unzip()(iter([]))) == []


XML = """<sheet><!-- <key staff="1" fifths="9"/> --><key staff="1" fifths="-2" grade="0.9"><bounds x="5" y="0" w="4" h="4"/></key>
<key staff="2" fifths="3" grade="0.1"><bounds x="5" y="0" w="4" h="4"/></key><key fifths="3"><bounds x="5" y="0" w="4" h="4"/></key><key staff="3" fifths="1"/>
<key-alter staff="1" shape="SHARP"><bounds x="9" y="0" w="4" h="4"/></key-alter><key-alter staff="2" shape="FLAT"><bounds x="9" y="0" w="4" h="4"/></key-alter>
<key-alter staff="2" shape="FLAT"><bounds x="15" y="0" w="4" h="4"/></key-alter><key-alter staff="2" shape="SHARP"><bounds x="90" y="0" w="4" h="4"/></key-alter>
<time-pair staff="1" time-rational="3/4" grade="0.8"><bounds x="20" y="0" w="8" h="4"/></time-pair><time-pair staff="1" time-rational="3/0"><bounds x="40" y="0" w="8" h="4"/></time-pair>
<time-number staff="1" grade="0.3"><bounds x="21" y="0" w="4" h="4"/></time-number><time-number staff="1" grade="0.1"><bounds x="60" y="0" w="4" h="4"/></time-number>
<relation source="a" target="b"><slur-head side="LEFT"/></relation><relation source="c" target="d"><containment/></relation><relation source="e" target="f"/></sheet>"""


def test_keys_meters_and_relations(spark):
    pages = spark.createDataFrame([("d", 1, XML)], "doc_id string, page int, xml string")
    keys, meters = books.keys(pages, 64.0), books.meters(pages)
    for df in (keys, meters):  # what follows the reading doesn't read again
        assert "from_xml" not in df._jdf.queryExecution().toString().lower() and "xmltostructs" not in df._jdf.queryExecution().toString().lower()
    assert {(r.staff, r.x, r.value) for r in keys.collect()} == {(1, 5.0, -2), (2, 9.0, -2), (2, 90.0, 1)}
    assert [(r.staff, r.x, r.beats, r.grade, r.low_confidence) for r in meters.collect()] == [(1, 20.0, 3.0, 0.3, True)]
    assert {(r.source, r.kind, r.side) for r in books.relations(pages).collect()} == {("a", "slur-head", "LEFT"), ("c", "containment", None), ("e", None, None)}
