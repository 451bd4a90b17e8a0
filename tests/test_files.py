import hashlib
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from gristmill.functions.record import VariantRecord
from gristmill.operators.curation import drop_copies_in_scan
from gristmill.plans.curation import curate_corpus
from gristmill.session import scratch_path, shared_dir
from gristmill.sources.files import (
    SCAN_ORDER,
    file_inventory,
    find_files,
    read_json_array,
    read_jsonl,
    read_lines,
    read_yaml_list,
    scan_corpus,
    split_unreadable,
    text_parts,
    yaml_texts,
)
from gristmill.sources.sinks import append_lines, write_jsonl, write_lines

ARRAY = [{"id": 1, "text": "One", "v": 1.0}, {"id": 2, "text": "two", "tags": ["a", "pii"]}]
LINES = [{"id": 3, "text": "one "}, {"id": 4, "text": "four", "n": None}, {"id": 5, "text": "fünf"}]
YAML = "- id: 6\n  text: six\n- {id: 7, text: ' TWO', tags: 'a,pii'}\n"
YML = "- id: 8\n  text: |\n    eight\n    lines\n"


@pytest.fixture
def corpus(tmp_path):
    raw = tmp_path / "raw"
    (raw / "nested").mkdir(parents=True)
    (raw / "a.json").write_text(json.dumps(ARRAY, indent=2))
    (raw / "b.jsonl").write_text("\n".join(["", json.dumps(LINES[0]), "  ", *map(json.dumps, LINES[1:]), ""]))
    (raw / "c.yaml").write_text(YAML)
    (raw / "d.yml").write_text(YML)
    (raw / "note.txt").write_text("not data")
    (raw / "nested" / "e.jsonl").write_text(json.dumps({"id": 9, "text": "nine"}) + "\n")
    return raw


def ids(scan):
    key = VariantRecord(F.col("fields")).value("id").number.cast("int")
    return [r[0] for r in scan.orderBy(*SCAN_ORDER).select(key).collect()]


def test_corpus_scan_order(spark, corpus):
    assert ids(scan_corpus(spark, str(corpus))) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sorted(ids(scan_corpus(spark, str(corpus), recursive=True))) == list(range(1, 10))


def test_raw_text_is_kept(spark, corpus):
    rows = scan_corpus(spark, str(corpus)).orderBy(*SCAN_ORDER).select("raw").collect()
    assert [json.loads(r.raw) for r in rows[:5]] == ARRAY + LINES
    assert '"v":1.0' in rows[0].raw.replace(" ", "")
    assert json.loads(rows[7].raw) == {"id": 8, "text": "eight\nlines\n"}


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_corpus(spark, str(tmp_path / "nowhere"))
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no data files"):
        scan_corpus(spark, str(tmp_path))
    assert find_files(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize(
    "reader, name, texts, bad",
    [
        (read_jsonl, "x.jsonl", ['{"a":1}', "{bad", "[1]", '{"a":1} x', "null"], 4),
        (read_json_array, "x.json", ['[{"a":1}, 3]'], 1),
        (read_json_array, "x.json", ['{"a":1}'], 1),
        (read_json_array, "x.json", ['[{"a":1}] x'], 1),
        (read_json_array, "x.json", ['[{"a":1}]}'], 1),
        (read_json_array, "x.json", ['["{}"]'], 1),
        (read_yaml_list, "x.yaml", ["- a: 1\n- 5\n"], 1),
        (read_yaml_list, "x.yaml", ["just text"], 1),
    ],
)
def test_unreadable_records(spark, tmp_path, reader, name, texts, bad):
    (tmp_path / name).write_text("\n".join(texts))
    with pytest.raises(Exception, match="unreadable"):
        reader(spark, str(tmp_path)).collect()
    readable, refused = split_unreadable(reader(spark, str(tmp_path), on_bad="quarantine"))
    assert refused.count() == bad
    assert readable.count() == (1 if bad == 4 or name == "x.yaml" and "a: 1" in texts[0] else 0)


def test_empty_array_and_file(spark, tmp_path):
    (tmp_path / "x.json").write_text(" [ ] ")
    assert read_json_array(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.jsonl").write_text("\n\n")
    assert read_jsonl(spark, str(tmp_path)).count() == 0


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of so many bytes; call it with a number."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = spark.conf.get(names[0])

    def split(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield split
    spark.conf.set(names[0], before)
    spark.conf.unset(names[1])


def nasty_records(n):
    rng = random.Random(n)
    bits = ['"', "\\", "}", "{", "[", "]", ",", "é", "\n", ":", "x" * 30, "\\\"", "\u2028", "{}", '"}', '\\"}']
    return [
        {"id": i, "text": "".join(rng.choices(bits, k=rng.randint(0, 25))), "deep": [{"a": [i, {"b": {}}]}] * (i % 3)}
        | ({"long": "long } text ]" * 2_000} if i == n // 2 else {})
        for i in range(n)
    ]


@pytest.mark.parametrize("size", [700, 4_096, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_over_several_ranges(spark, tmp_path, small_splits, size, indent):
    """A file read in ranges gives what Python's parser gives, a record across many ranges included."""
    records = nasty_records(300)
    (tmp_path / "a.json").write_text(" \n" + json.dumps(records, indent=indent, ensure_ascii=bool(indent)) + " \n")
    (tmp_path / "b.json").write_text(json.dumps(records[:5]))
    (tmp_path / "empty.json").write_text("\n[\n " + " " * 2_000 + "]\n")
    small_splits(size)
    scan = read_json_array(spark, str(tmp_path), whole_bytes=1_000)
    found = {}
    for r in scan.select("raw", "path", "offset", "fields").collect():
        assert r["fields"] is not None
        found.setdefault(r["path"][-6:], []).append((r["offset"], json.loads(r["raw"])))
    assert sorted(found) == ["a.json", "b.json"]
    assert [x for _, x in sorted(found["a.json"], key=lambda x: x[0])] == records
    assert sorted(n for n, _ in found["a.json"]) == list(range(300))
    if size == 4_096:
        from gristmill.sources.ranges import ranged_text

        text = ranged_text(spark, str(tmp_path), {"pathGlobFilter": "a.json"}, "}")
        read = text.select(F.spark_partition_id().alias("task")).distinct().count()
        assert read > 4


@pytest.mark.parametrize(
    "text",
    ['[{"a":1}, 3]', '[{"a":1}, {"b":2},]', '{"a":1, "b":2}', '[{"a":1}] x', '[{"a":1}]}', '[{"a":1}]]', '[{"a":1}][{"b":2}]',
     '["{}"]', '[{"a":1}', '{"a":1}]', '[{"a":"x}]', "x" * 50, '[,{"a":1}]', '[{"a":1} {"b":2}]'],
)
def test_unreadable_arrays_in_ranges(spark, tmp_path, small_splits, text):
    (tmp_path / "x.json").write_text(text)
    (tmp_path / "y.json").write_text('[{"good":1}]')
    small_splits(7)
    with pytest.raises(Exception, match="unreadable"):
        read_json_array(spark, str(tmp_path), whole_bytes=0).collect()
    readable, refused = split_unreadable(read_json_array(spark, str(tmp_path), whole_bytes=0, on_bad="quarantine"))
    assert [r["path"][-6:] for r in refused.collect()] == ["x.json"]
    assert [r["path"][-6:] for r in readable.collect()] == ["y.json"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_have_one_address_in_every_pass(spark, tmp_path, small_splits, end):
    lines = [json.dumps({"id": i, "pad": "é" * (i * 7 % 90)}, ensure_ascii=False) for i in range(500)]
    lines[3] = lines[100] = ""
    content = end.join(lines).encode() + end.encode() * 2
    (tmp_path / "x.jsonl").write_bytes(content)
    (tmp_path / "y.jsonl").write_text('{"id": 1}')
    seen = []
    for size in (1 << 20, 5_000, 333):
        small_splits(size)
        scan = read_jsonl(spark, str(tmp_path), addressed=True)
        rows = scan.where(F.col("path").endswith("x.jsonl")).select("raw", "offset", "path").collect()
        seen.append(sorted((r["offset"], r["raw"]) for r in rows))
        assert scan.count() == 499
    assert seen[0] == seen[1] == seen[2]
    assert [raw for _, raw in seen[0]] == [x for x in lines if x]
    assert all(content[at:].startswith(raw.encode()) for at, raw in seen[0])
    # First copies are found by addresses alone, in a second pass over the files.
    ordered = read_jsonl(spark, str(tmp_path), addressed=True).withColumn("src_rank", F.lit(0))
    digest = F.length("raw").cast("string")
    kept = drop_copies_in_scan(ordered, digest, SCAN_ORDER)
    firsts = {}
    for _, raw in seen[0]:
        firsts.setdefault(len(raw), raw)
    assert {r["raw"] for r in kept.collect()} == {*firsts.values(), '{"id": 1}'}


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    """One file read by many tasks still sorts in line order."""
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"id": i, "pad": "x" * 50}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = read_jsonl(spark, str(tmp_path), addressed=True).withColumn("src_rank", F.lit(0))
        assert scan.rdd.getNumPartitions() > 4
        assert ids(scan) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_find_files(spark, corpus):
    flat = {r.path.rsplit("/", 1)[1] for r in find_files(spark, str(corpus), "*.jsonl").collect()}
    deep = {r.path.rsplit("/", 1)[1] for r in find_files(spark, str(corpus), "*.jsonl", recursive=True).collect()}
    assert flat == {"b.jsonl"} and deep == {"b.jsonl", "e.jsonl"}


def test_inventory(spark, tmp_path):
    files = {
        "a.TXT": b"one\ntwo\r\nthree\rfour", "b.py": b"x\n", "c.bin": b"a\x00b", "d.md": b"", "e.json": b"\x00",
        "noext": b"x", "late.txt": b"x" * 1024 + b"\x00", "sub/f.tar.gz": b"\n\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    for algorithm in ("md5", "sha1", "sha256", "sha512"):
        rows = file_inventory(spark, str(tmp_path), algorithm=algorithm).collect()
        assert {r.relative_path for r in rows} == set(files)
        for r in rows:
            content = files[r.relative_path]
            with open(tmp_path / r.relative_path, errors="replace") as text:
                assert r.line_count == sum(1 for _ in text)
            assert r.size == len(content)
            assert r.hash == hashlib.new(algorithm, content).hexdigest()
            assert r.is_binary == (b"\x00" in content)
    by_name = {r.relative_path: r for r in rows}
    assert by_name["a.TXT"].extension == ".txt" and by_name["a.TXT"].is_text
    assert by_name["noext"].extension == "" and not by_name["noext"].is_text
    assert by_name["sub/f.tar.gz"].extension == ".gz"
    assert not by_name["e.json"].is_text and not by_name["late.txt"].is_text and by_name["d.md"].is_text
    probed = file_inventory(spark, str(tmp_path), binary_probe=1024).where("relative_path = 'late.txt'")
    assert probed.first().is_text
    with pytest.raises(ValueError):
        file_inventory(spark, str(tmp_path), algorithm="crc")


def test_hidden_and_empty_files(spark, tmp_path):
    """They are listed; a scan that would skip one with content fails and names it."""
    for name, text in {"a.jsonl": '{"id":1}', "_b.jsonl": '{"id":2}', ".c.jsonl": '{"id":3}', "e.jsonl": ""}.items():
        (tmp_path / name).write_text(text)
    listed = {r.path.rsplit("/", 1)[1]: r.size for r in find_files(spark, str(tmp_path), "*.jsonl").collect()}
    assert listed == {"a.jsonl": 8, "_b.jsonl": 8, ".c.jsonl": 8, "e.jsonl": 0}
    rows = {r.relative_path: r for r in file_inventory(spark, str(tmp_path), pattern="*.jsonl").collect()}
    assert set(rows) == set(listed) and rows["_b.jsonl"].hash is None and rows["e.jsonl"].line_count == 0
    with pytest.raises(ValueError, match="_b.jsonl"):
        scan_corpus(spark, str(tmp_path))


def test_line_sinks(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.createDataFrame([(" a ",), ("",), ("b ",)], "value string")
    write_lines(rows, path)
    write_lines(rows, path)
    assert sorted(r.line for r in read_lines(spark, path).collect()) == ["a", "b"]
    append_lines(rows, path)
    assert read_lines(spark, path).count() == 4


def test_jsonl_sink_per_split(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([('{"a":1}', "train"), ('{"a":2}', "val")], "raw string, split string")
    write_jsonl(rows, path)
    assert read_jsonl(spark, f"{path}/split=val", pattern="*").select("raw").first().raw == '{"a":2}'
    write_jsonl(rows, str(tmp_path / "flat"), by=None)
    assert read_jsonl(spark, str(tmp_path / "flat"), pattern="*").count() == 2


def test_curate_corpus(spark, corpus, tmp_path):
    out = str(tmp_path / "clean")
    summary = curate_corpus(spark, str(corpus), out, include="", exclude="pii").first()
    # "two" and " TWO" carry the tag pii; "one " and {"text":"One","v":1.0} differ in v
    assert summary.total_samples == 6
    assert (summary.train_samples, summary.val_samples, summary.test_samples) == (4, 0, 2)
    assert (summary.include_tags, summary.exclude_tags) == ([""], ["pii"])
    written = read_jsonl(spark, f"{out}/data", pattern="*.txt", recursive=True)
    texts = sorted(json.loads(r.raw)["text"] for r in written.collect())
    assert texts == sorted(["One", "one ", "four", "fünf", "six", "eight\nlines\n"])
    sources = {r.value.rsplit("/", 1)[1] for r in spark.read.text(f"{out}/source_files").collect()}
    assert sources == {"a.json", "b.jsonl", "c.yaml", "d.yml"}


def test_curate_corpus_keeps_the_first_copy(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "z.json").write_text(json.dumps([{"id": "from json", "text": "Same"}]))
    (raw / "a.jsonl").write_text(json.dumps({"id": "from jsonl", "text": "same"}) + "\n")
    curate_corpus(spark, str(raw), str(tmp_path / "out"))
    written = read_jsonl(spark, str(tmp_path / "out" / "data"), pattern="*.txt", recursive=True)
    assert [json.loads(r.raw)["id"] for r in written.collect()] == ["from json"]


def test_curate_corpus_quarantine(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.jsonl").write_text('{"text":"x"}\n{broken\n')
    with pytest.raises(Exception, match="unreadable"):
        curate_corpus(spark, str(raw), str(tmp_path / "out"))
    summary = curate_corpus(spark, str(raw), str(tmp_path / "out2"), on_bad="quarantine").first()
    assert summary.total_samples == 1
    assert [r.value for r in spark.read.text(str(tmp_path / "out2" / "quarantine")).collect()] == ["{broken"]


def test_scratch_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == base
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(base) and first != second


YAML_TEXTS = [
    b"", b"# nothing\n", b"- a\n---\n- b\n", b"just", b"a: 1", b"- &x {a: 1}\n- *x\n- <<: *x\n  b: 2\n- <<: *x\n", b"&r\n- 1\n- 2\n",
    b"!!omap\n- a: 1\n- b: 2\n", b"!!set {a, b}", b"!!seq [1, 2]", b"- a: [\n", b"- *u\n", b"- &a 1\n- &a 2\n- *a\n", b"- \xff",
    b"\xff\xfe-\x00 \x00a\x00", b"- !!python/object:os.system x\n", b"- 2024-01-01\n- 1e3\n- 0x1f\n- ~\n", b"[]", b"-\n-\n",
    b"%YAML 1.1\n---\n- a\n", b"- a\n- |\n  x\n  - y\n- \"p\n\n  q\"\n", b"- {a: 1, a: 2}\n- ? [1,2]\n  : 3\n", b"!foo [1]",
]


def whole_yaml(content):
    try:
        items = yaml.load(content, Loader=yaml.CSafeLoader)
    except yaml.YAMLError:
        return ["!unreadable " + content.decode(errors="replace")]
    return [json.dumps(i, ensure_ascii=False, default=str) for i in (items if isinstance(items, list) else [items])]


@pytest.mark.parametrize("content", YAML_TEXTS)
def test_yaml_items_are_those_of_the_whole_file(content):
    def result(function, *arguments):
        try:
            return function(*arguments)
        except TypeError:
            return "no JSON"

    assert result(yaml_texts, pa.py_buffer(content)) == result(whole_yaml, content)


def test_a_yaml_file_is_never_there_as_objects_as_a_whole():
    content = "".join(f"- {{id: {n}, tags: [a, b, c], more: {{x: {n}}}}}\n" for n in range(5_000)).encode()

    def peak(function, argument):
        tracemalloc.start()
        try:
            function(argument)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert yaml_texts(pa.py_buffer(content)) == whole_yaml(content)
    assert 5 * peak(yaml_texts, pa.py_buffer(content)) < peak(whole_yaml, content)


def test_yaml_records_go_back_in_parts(spark, tmp_path):
    texts = ["a" * 700_000, "b", "c" * 400_000, "d" * 2_000_000, "e"]
    assert [(n, len(part)) for n, part in text_parts(texts)] == [(0, 3), (3, 1), (4, 1)]
    (tmp_path / "x.yaml").write_text("".join(f"- {{id: {n}, text: {text}}}\n" for n, text in enumerate(texts)))
    scan = read_yaml_list(spark, str(tmp_path)).withColumn("src_rank", F.lit(0))
    assert ids(scan) == [0, 1, 2, 3, 4] and [r.offset for r in scan.orderBy("offset").collect()] == [0, 1, 2, 3, 4]
