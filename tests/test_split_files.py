"""CSV and JSON arrays cut into blocks at any byte, against the readers that take a file in one task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larder.sources import readers, split_files

SCHEMA = "a string, b string, n int"
NESTED = "id long, name string, more struct<k: string, list: array<int>>"


@pytest.fixture(params=[17, 300])
def blocks(spark, request):
    """Blocks of so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_csv(spark, path):
    return (
        spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
        .option("nullValue", readers.ABSENT).option("emptyValue", "").csv(path)
    )


CELLS = [
    "plain", "", '""', '"quoted"', '"a, b"', '"line\nbreak"', '"two\n\nbreaks"', '"say ""hi"""', '"""\n"""', "in\"side", '"end,\n"', "é ü", '"\r\nx"',
    '"' + "long " * 30 + '\n"', " lead", '"\n,""\n"',
]


def made_up_csv(rng, newline):
    lines = ["a,b,n"]
    for _ in range(rng.randint(0, 25)):
        lines.append(f"{rng.choice(CELLS)},{rng.choice(CELLS)},{rng.choice(['1', '', '23', 'x'])}")
        if rng.random() < 0.1:
            lines.append("")
    return newline.join(lines) + rng.choice(["", newline])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_of_any_blocks(spark, blocks, tmp_path, rows, newline):
    rng = random.Random(blocks)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(made_up_csv(rng, newline), newline="")
    got = readers.read_csv(spark, str(tmp_path), SCHEMA)
    assert got.schema.simpleString() == whole_csv(spark, str(tmp_path)).schema.simpleString()
    # In files whose lines end in both characters, the other reader turns them into one inside quotes too.
    assert rows(unbroken(got)) == rows(unbroken(whole_csv(spark, str(tmp_path))))


def unbroken(df):
    return df.withColumns({c: F.regexp_replace(c, "\r\n", "\n") for c in ("a", "b")})


def test_csv_of_one_column_and_no_rows(spark, blocks, tmp_path, rows):
    (tmp_path / "0.csv").write_text("a,b,n\n")
    (tmp_path / "1.csv").write_text("")
    assert rows(readers.read_csv(spark, str(tmp_path), SCHEMA)) == []


def made_up_json(rng, indent):
    def text():
        return "".join(rng.choice(["a", "{", "}", "[", "]", '"', "\\", "\n", "é", ",", "\u2028"]) for _ in range(rng.randint(0, 12)))

    out = []
    for i in range(rng.randint(0, 20)):
        row = {"id": i, "name": rng.choice([text(), None]), "more": rng.choice([None, {"k": text(), "list": [1, 2]}, {"list": []}, {}])}
        out.append({k: v for k, v in row.items() if rng.random() < 0.9} | {"extra": {"deep": [{"x": text()}]}})
    return json.dumps(out, indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_of_any_blocks(spark, blocks, tmp_path, rows, indent):
    rng = random.Random(blocks)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(made_up_json(rng, indent))
    (tmp_path / "single.json").write_text('{"id": 77, "name": "one {object}", "more": {"k": "}"}}')
    want = spark.read.option("multiLine", True).schema(NESTED).json(str(tmp_path))
    got = readers.read_json_array(spark, str(tmp_path), NESTED)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert rows(got) == rows(want)


def test_large_files_are_many_tasks(spark, tmp_path):
    cell = '"' + "word, " * 44 + '\n"' + '"quoted"" end"'
    line = f'{cell[:-15]}",x,{{n}}\n'
    with open(tmp_path / "large.csv", "w") as out:
        out.write("a,b,n\n")
        for n in range(270_000):
            out.write(line.format(n=n))
    assert (tmp_path / "large.csv").stat().st_size > 64 << 20
    got = readers.read_csv(spark, str(tmp_path / "large.csv"), SCHEMA)
    assert split_files._stretches(spark, str(tmp_path / "large.csv"), "\n").rdd.getNumPartitions() >= 8
    assert got.agg(F.count("*"), F.sum("n"), F.countDistinct("a")).first()[:] == (270_000, 270_000 * 269_999 // 2, 1)


def test_open_quotes():
    cases = [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('a,"b""', False, True), ('a,b"c', False, False), ('"', False, True), ('""', True, True), ('"""', True, False)]
    assert [split_files.open_after(line, o) for line, o, _ in cases] == [want for _, _, want in cases]
