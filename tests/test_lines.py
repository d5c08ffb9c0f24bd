"""Numbered lines: quoted CSV read by many tasks, dictionaries in the order of the file."""

import random

import pytest

from threadlens.operators.lexicon import lexicon_vector
from threadlens.sources.lexicon_file import read_dic
from threadlens.sources.lines import numbered_lines
from threadlens.sources.quoted_csv import read_quoted, read_records
from threadlens.sources.splits import CSV_OPTIONS

FIELDS = ["plain", "", "two\nlines", 'a "quoted" word', '"', '""', "comma, and\n\nblank lines\n", "é ünï 😀", "  spaced ",
          "a,b\n\"c\"\nd", "x" * 700, "\n", "cr\r\nlf"]


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def written(path, end, rows=400, quote_all=False):
    rng = random.Random(len(end))
    out = ["id,text,note" + end]
    for i in range(rows):
        cells = [str(i), rng.choice(FIELDS), rng.choice(FIELDS)]
        cells = ['"' + c.replace('"', '""') + '"' if quote_all or any(x in c for x in '",\r\n') else c for c in cells]
        out.append(",".join(cells) + end)
        if rng.random() < 0.05:
            out.append(end)  # an empty line
    path.write_bytes("".join(out).encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quote_all", [False, True])
def test_one_file_equals_the_reader_that_takes_it_whole(spark, small_blocks, tmp_path, end, quote_all):
    path = written(tmp_path / "one.csv", end, quote_all=quote_all)
    assert numbered_lines(spark, path).rdd.getNumPartitions() > 20  # many tasks read it
    want = spark.read.options(**CSV_OPTIONS).csv(path)
    got = read_quoted(spark, path)
    assert got.columns == want.columns
    rows = sorted(map(tuple, want.collect()), key=lambda r: int(r[0]))
    assert sorted(map(tuple, got.collect()), key=lambda r: int(r[0])) == rows and len(rows) == 400


def test_records_keep_the_order_of_the_file(spark, small_blocks, tmp_path):
    path = written(tmp_path / "one.csv", "\n", rows=150)
    got = read_records(spark, path).orderBy("rec").collect()
    assert [r.record.split(",")[0].strip('"') for r in got[1:]] == [str(i) for i in range(150)]


def test_folder_of_files_and_errors(spark, small_blocks, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        written(folder / f"part{i}.csv", "\n", rows=30)
    assert read_quoted(spark, str(folder)).count() == 90
    (folder / "other.csv").write_text("id,text\n1,a\n")
    with pytest.raises(ValueError, match="different headers"):
        read_quoted(spark, str(folder))
    (tmp_path / "open.csv").write_text('id,text\n1,"never closed\n2,b\n')
    with pytest.raises(ValueError, match="does not end"):
        read_quoted(spark, str(tmp_path / "open.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_quoted(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("id,,text\n")
    assert read_quoted(spark, str(tmp_path / "head.csv")).columns == ["id", "_c1", "text"]


def test_dictionary_keeps_the_order_of_its_lines(spark, tmp_path):
    path = tmp_path / "order.dic"
    path.write_bytes(b"%\r\n20\tzeta\r\n3\talpha\r\n11\tmid\r\n%\r\nth*\t3\r\non\t20\t11\r\n")
    lex = read_dic(spark, str(path))
    assert lex.categories == ["zeta", "alpha", "mid"]
    df = spark.createDataFrame([(1, "this is on on")], "id long, t string")
    assert lexicon_vector(df, "id", "t", lex).first().lex_vec == [2, 1, 2]


def test_unknown_category_number_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.dic"
    path.write_text("%\n1\ta\n%\nth*\t1\non\t7\n")
    with pytest.raises(Exception, match="unknown category number: on"):
        read_dic(spark, str(path))
