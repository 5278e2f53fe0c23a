import pandas as pd

from trackloom.plans.extensions import isolated, read_by


def test_a_failing_part_takes_its_whole_key_and_no_other(spark):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(50)] + [(None, 7)]
    df = spark.createDataFrame(rows, "source int, n int").repartition(8)

    def step(part):
        if ((part["source"] == 2) & (part["n"] == 31)).any():
            raise ValueError("bad frame")
        return pd.DataFrame({"twice": part["n"] * 2})

    results, status = isolated(df, step, "source", "twice bigint")
    assert sorted(map(tuple, status.collect()), key=repr) == [(1, "ok", None), (2, "failed", "ValueError: bad frame"), (None, "ok", None)]
    assert sorted(map(tuple, results.collect()), key=repr) == sorted([(1, 2 * i) for i in range(50)] + [(None, 14)], key=repr)


def test_errors_of_a_reader_are_data(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(6)], "n int, image string").coalesce(1)

    def load():
        def read(batch):
            if (batch["n"] == 3).any():
                raise OSError("cannot open")
            return pd.DataFrame({"text": batch["image"].str.upper(), "lines": [[str(v)] for v in batch["n"]]})

        return read

    def absent():
        raise ImportError("no engine")

    schema = "text string, lines array<string>"
    got = {r.n: r.reading for r in read_by(df, load, schema).collect()}
    assert got[3].is_available and got[3].error == "OSError: cannot open" and got[3].result is None
    assert all(got[n].error is None and got[n].result.text == "X" * n and got[n].result.lines == [str(n)] for n in got if n != 3)
    none = read_by(df, absent, schema).collect()
    assert len(none) == 6 and all(not r.reading.is_available and r.reading.error == "ImportError: no engine" for r in none)
    assert read_by(df.filter("false"), load, schema).collect() == []


def test_rows_of_a_key_come_together(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, i) for i in range(8000)], "source int, n int").repartition(16)
    calls = tmp_path / "calls"

    def step(part):
        with open(calls, "a") as log:
            log.write(".")
        return pd.DataFrame({"twice": part["n"] * 2})

    results, status = isolated(df, step, "source", "twice bigint")
    assert status.count() == 40 and results.count() == 8000
    # one call for a key, and one for a key that lies on the edge of two ranges
    assert len(calls.read_text()) <= 40 + 2 * 16


def test_a_failing_reader_is_asked_for_halves(spark, tmp_path):
    df = spark.range(0, 4000, 1, 1).withColumnRenamed("id", "n")
    calls = tmp_path / "calls"

    def load():
        def read(batch):
            with open(calls, "a") as log:
                log.write(".")
            if (batch["n"] % 100 == 0).any():
                raise OSError("cannot open")
            return pd.DataFrame({"twice": batch["n"] * 2})

        return read

    # written, as a second look at the frame would read again
    read_by(df, load, "twice bigint").write.parquet(str(tmp_path / "read"))
    got = {r.n: r.reading for r in spark.read.parquet(str(tmp_path / "read")).collect()}
    assert len(got) == 4000
    assert all((v.error == "OSError: cannot open" and v.result is None) if n % 100 == 0 else (v.error is None and v.result.twice == 2 * n) for n, v in got.items())
    assert len(calls.read_text()) < 1500
