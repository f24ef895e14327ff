import pytest

from tablewitness import corrupt, score_csv
from tablewitness.session import scratch_path
from tablewitness.sources.csv import NA_VALUES, read_csv, read_csv_folder, read_first_csv, read_raw_csv


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_types_gaps_and_malformed_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", "i,j,x,s,b,,e\n1,1,1.5,u,True,7,\n2,NA,nan,n/a,False,8,\n3,3,2,v,True,9,,surplus\n4,4\n5,5,1e3,\"w,w\",True,1,\n")
    df = read_csv(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        "i": "bigint", "j": "double", "x": "double", "s": "string", "b": "string", "Unnamed: 5": "double", "e": "double"}
    rows = {r["i"]: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 4, 5]
    assert rows[2]["j"] is None and rows[2]["x"] is None and rows[2]["s"] is None
    assert rows[4]["x"] is None and rows[5]["s"] == "w,w" and rows[5]["x"] == 1000.0


def test_unreadable_source(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_folder_groups_by_header_and_skips_empty(spark, tmp_path):
    write(tmp_path, "d/one.csv", "a,b\n1,2\n")
    write(tmp_path, "d/two.csv", "a,b\n3,4\n5,6\n")
    write(tmp_path, "d/sub/three.csv", "x\nu\n")
    write(tmp_path, "d/empty.csv", "")
    write(tmp_path, "d/note.txt", "no table")
    tables = read_csv_folder(spark, str(tmp_path / "d"))
    assert sorted(t.count() for t in tables) == [1, 3]
    two = next(t for t in tables if "a" in t.columns)
    assert two.select("dataset_id").distinct().count() == 2
    assert read_first_csv(spark, str(tmp_path / "d")).count() == 1


def test_quoted_line_ends_and_headers(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert {tuple(r) for r in read_csv(spark, path).collect()} == {(1, "x\ny"), (2, "z")}
    write(tmp_path, "h/one.csv", "a,b\n1,2\n")
    write(tmp_path, "h/two.csv", "b,a\n3,4\n")
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(tmp_path / "h"))
    tables = read_csv_folder(spark, str(tmp_path / "h"))
    assert sorted((r["a"], r["b"]) for t in tables for r in t.collect()) == [(1, 2), (4, 3)]


def test_file_order_reaches_the_domain(spark, tmp_path):
    """A random walk by the hour is a sensor only when rows keep the order of the file."""
    import random

    rng, value, lines = random.Random(3), 20.0, []
    for i in range(500):
        value += rng.gauss(0, 1)
        lines.append(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00,{value:.3f}")
    r = score_csv(spark, write(tmp_path, "w.csv", "timestamp,sensor\n" + "\n".join(lines) + "\n")).first()
    assert r["context_flags"]["dataset_type"] == "sensor_iot"


def test_no_csv_in_bundle(spark, tmp_path):
    write(tmp_path, "n/readme.txt", "nothing")
    with pytest.raises(FileNotFoundError):
        read_first_csv(spark, str(tmp_path / "n"))


def test_score_a_csv_file(spark, tmp_path):
    lines = "\n".join(f"{i},{i % 17},{(i * 7919) % 1000 / 10}" for i in range(200))
    r = score_csv(spark, write(tmp_path, "t.csv", "Unnamed: 0,k,v\n" + lines + "\n")).first()
    assert 0.01 <= r["score"] <= 0.99 and r["col_sanity_score"] == pytest.approx(1 / 3) and r["total_rows"] == 200


def test_unknown_method_changes_nothing(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, x double")
    assert sorted(r["x"] for r in corrupt(df, "none", ["k"]).collect()) == [float(i) for i in range(10)]


def test_scratch_paths_are_new(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def _random_csv(seed, rows, end="\n"):
    import random

    rng = random.Random(seed)
    cell = lambda: rng.choice([
        "plain", "", "12", f'"quoted {rng.randrange(99)}"', f'"two{end}lines"', '"say ""hi"""', f'"a,b{end}{end}c,""x"",{end}end"', 'in"ner', '5" pipe', '"', '""', "x" * rng.randrange(40), '"closed"tail', f'"{end}"',
    ][: rng.choice([8, 8, 9, 11])] if seed % 2 else ["plain", "7", f'"l1{end}l2"', '"q ""z"" q"', "", "é😀"])
    return "alpha,beta,gamma" + end + "".join(f"{i},{cell()},{cell()}{end}" + (end if rng.random() < 0.05 else "") for i in range(rows))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, seed):
    """Splits of 64 bytes up, also inside quotes, next to the reader that takes a file in one task."""
    for k in range(2):
        write(tmp_path, f"f{k}.csv", _random_csv(10 * k + seed, 40, "\r\n" if seed == 4 else "\n"))
    folder = str(tmp_path)
    schema = "alpha string, beta string, gamma string, more string"
    whole = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    want = sorted((tuple(r)[:3] for r in whole.collect() if r["more"] is None), key=str)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64", "97", "1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            raw = records_csv(spark, folder)
            if size == "64":
                assert raw[1] >= 8
            assert raw[0] == sorted((tuple(None if v in NA_VALUES else v for v in r) for r in want), key=str)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def records_csv(spark, folder):
    df = read_raw_csv(spark, folder)
    return sorted((tuple(r) for r in df.select("alpha", "beta", "gamma").collect()), key=str), df.select("__split").distinct().count()


def test_order_and_headers_over_lines(spark, tmp_path):
    """A quoted header over two lines, and the order of the file across ranges."""
    body = "".join(f'{i},"a\nb{i}"\n' for i in range(200))
    path = write(tmp_path, "o.csv", '\n"first\nname",second\n' + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "80")
    try:
        df = read_csv(spark, path, ordered=True)
        rows = df.orderBy("__file", "__split", "__row").collect()
        assert df.columns[:2] == ["first\nname", "second"]
        assert [r[0] for r in rows] == list(range(200)) and rows[7][1] == "a\nb7"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_states():
    from tablewitness.sources.records import ends_inside

    for line, outside, inside in (
        ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('5" x,y', False, False), ('"a""b",c', False, True), ('""', False, True), ('x""', False, True), ('","', False, True),
        ('"a"b"c,"d', True, False), ("", False, True), ('",', True, False), ('"""', True, True), ('a""",z', False, False),
    ):
        assert ends_inside(line, False) == outside, line
    assert ends_inside('b",c', True) is False and ends_inside('b"",c', True) is True and ends_inside('b"","c', True) is False
    assert ends_inside('b","c', True) is True
