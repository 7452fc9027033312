import base64
import json
import random
import zlib

from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.operators import catalog as cat
from tallyloom.sources.app_files import base64_objects, headers, inflate, read_app_files
from tallyloom.sources.catalogue import read_catalogue, write_objects


def files(spark, *contents):
    return spark.createDataFrame([(f"a{i}", bytearray(c)) for i, c in enumerate(contents)], "app string, content binary")


def streams(spark, content, **options):
    out = inflate(files(spark, content), "app", **options).orderBy("offset").collect()
    return [(r["offset"], r["n_bytes"], r["text"]) for r in out]


def test_streams_between_other_bytes(spark):
    rng = random.Random(1)
    noise = bytes(b for b in (rng.randrange(256) for _ in range(4000)) if b != 0x78)
    parts = [zlib.compress(json.dumps({"qScript": f"level {n}"}).encode(), n) for n in (1, 6, 9)]
    content = noise + noise.join(parts) + noise
    texts = [json.loads(t)["qScript"] for _, _, t in streams(spark, content) if t and t.startswith("{")]
    assert texts == ["level 1", "level 6", "level 9"]


def test_streams_that_are_no_text_or_cut_short(spark):
    binary = zlib.compress(b"\xff\xfe" * 30)
    whole = zlib.compress(b"padded\x00\x00")
    cut = zlib.compress(random.Random(2).randbytes(4000).hex().encode())[:1500]
    got = streams(spark, binary + b"||" + whole + b"||" + cut)
    assert got[0] == (0, 60, None)
    assert got[1] == (len(binary) + 2, 8, "padded")
    assert got[2][1] > 0 and set(got[2][2]) <= set("0123456789abcdef")
    assert streams(spark, b"\x78\x9c\xff\xff nothing") == []


def test_large_streams_are_read_whole_unless_told_otherwise(spark):
    plain = random.Random(3).randbytes(3_000_000).hex()
    packed = zlib.compress(plain.encode(), 1)
    assert len(packed) > 2_000_000
    first = [s for s in streams(spark, packed) if s[0] == 0]
    assert first == [(0, len(plain), plain)]
    bounded = [s for s in streams(spark, packed, max_stream_bytes=2_000_000) if s[0] == 0]
    assert 0 < bounded[0][1] < len(plain)


def test_header_inside_framing(spark):
    frame = b"\x01\x00\x00\x00"
    key = fixed.HEADER_KEY.encode()
    good = b'\xff\xfe{"other":1}{"' + key[:5] + frame + key[5:] + b'":"2","name":"\xc3\xa9"}rest'
    rows = headers(files(spark, good, b"none", b'{"' + key + b'": oops}'), "app").collect()
    assert [(r["app"], r["version"], json.loads(r["header"])["name"]) for r in rows] == [("a0", "2", "é")]


def test_base64_objects_skip_what_cannot_be_read(spark):
    def coded(text):
        return stored(base64.b64encode(text))

    def stored(letters):
        return b'"' + fixed.BASE64_KEY.encode() + b'":"' + letters + b'",'

    content = b"".join(
        [coded(b'{"user":"first one"}\x00'), coded(b"certainly no json at all"), coded(b'{"a":1}'), stored(b"A" * 21),
         coded('{"user":"zweiter ü"}'.encode())]
    )
    rows = base64_objects(files(spark, b"\x01\x00\x00\x00" + content), "app").orderBy("pos").collect()
    assert [json.loads(r["object"])["user"] for r in rows] == ["first one", "zweiter ü"]


def test_files_are_found_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / f"one.{fixed.APP_FILE_SUFFIX}").write_bytes(b"x")
    (tmp_path / "two.txt").write_bytes(b"y")
    assert [r["path"].rsplit("/", 1)[-1] for r in read_app_files(spark, str(tmp_path)).collect()] == [f"one.{fixed.APP_FILE_SUFFIX}"]


def objects(spark, *texts):
    return spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "app string, offset bigint, text string")


def test_first_matching_kind_counts(spark):
    texts = [
        '{"qScript":null,"qreload_meta":{}}', '{"qMetaData":{"qType":"sheet"},"qreload_meta":1}', '{"qMetaData":{},"qreload_meta":1}',
        '{"qTitle":"t","qLastReloadTime":""}', '{"qTitle":"t"}', '{"qEntryList":[],"qId":""}', "[1]", "{broken", '"qScript"',
    ]
    got = {r["offset"]: r["kind"] for r in cat.classify(objects(spark, *texts)).collect()}
    assert got == {0: "script", 1: "sheet", 2: "data_model", 3: "app_properties", 4: "other", 5: "variables", 6: "other", 8: "other"}


def test_last_script_counts_and_gets_unix_lines(spark):
    made = objects(spark, json.dumps({"qScript": "old"}), json.dumps({"qScript": "a\r\nb"}))
    assert cat.catalog_scripts(made).first()["script"] == "a\nb"


def test_stored_objects_are_read_by_kind(spark, tmp_path):
    made = objects(spark, '{"qScript":"s"}', '{"qreload_meta":{},"qfields":[{"qname":"f"}]}')
    stored = write_objects(made, str(tmp_path / "objects"))
    fields = cat.catalog_fields(stored)
    assert "PartitionFilters: [isnotnull(kind" in fields._jdf.queryExecution().executedPlan().toString()
    assert [r["field"] for r in fields.collect()] == [r["field"] for r in cat.catalog_fields(made).collect()] == ["f"]


def test_sheet_without_charts(spark):
    made = objects(spark, '{"qMetaData":{"qType":"sheet"},"qRoot":{"qProperty":{},"qChildren":[{"qProperty":{"title":"t"}},{}]}}')
    row = cat.catalog_charts(made).collect()
    assert [(r["chart"], r["type"], r["visualization"], r["title"], r["n_measures"]) for r in row] == [("", "", "", "t", 0)]
    assert cat.catalog_sheets(made).first()["title"] == "Untitled Sheet"


def test_catalogue_file_over_many_lines(spark, tmp_path):
    record = {"file": {"name": "x"}, "data_model": {"tables": [{"name": "T", "rows": 3}]}, "variables": [], "unknown": 1}
    (tmp_path / "catalogue.json").write_text(json.dumps(record, indent=2))
    row = read_catalogue(spark, str(tmp_path)).select("file.name", F.col("data_model.tables")[0]["rows"].alias("n")).first()
    assert tuple(row) == ("x", 3)
