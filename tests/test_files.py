from marketloom.sources import instrument_files as N


def test_masters_and_caches(spark, tmp_path):
    row = ["tok", "Name", "short", "50", "0.05", "isin", "s", "u", "1745000000", "NSE:A25CE", "10", "11", "1", "2", "A", "100.5", "CE", "15", "x", "y", "z"]
    (tmp_path / "fo.csv").write_text(",".join(row) + "\n" + "too,short\n")
    (tmp_path / "cm.csv").write_text(",".join([*row[:9], "NSE:B-EQ", *row[10:]]) + "\n")
    df = N.read_master(spark, {"NSE_FO": str(tmp_path / "fo.csv"), "NSE_CM": str(tmp_path / "cm.csv")})
    assert sorted((r.kind, r.symbol, r.source_file) for r in df.collect()) == [("equity", "NSE:B-EQ", "NSE_CM"), ("option", "NSE:A25CE", "NSE_FO")]
    path, calls = str(tmp_path / "cache"), []

    def fetch():
        calls.append(1)
        return df.drop("source_file")

    for _ in range(2):
        assert N.daily(spark, path, "20250423", fetch).count() == 2
    assert len(calls) == 1 and N.load_cache(spark, path, "20250424").count() == 0
    try:
        N.read_master(spark, {"NSE_XX": "p"})
    except ValueError:
        return
    raise AssertionError


def test_constituents_and_state(spark, tmp_path):
    (tmp_path / "it.csv").write_text("Name,Symbol\na, X \nb,\nc,Y\nd,X\n")
    (tmp_path / "bad.csv").write_text("Name\na\n")
    files = {"it": str(tmp_path / "it.csv"), "bad": str(tmp_path / "bad.csv"), "gone": str(tmp_path / "no.csv")}
    out = N.read_constituents(spark, files, {"bad": ["Z"]})
    assert sorted(tuple(r) for r in out.collect()) == [("bad", "Z"), ("it", "X"), ("it", "Y")]
    assert N.load_state(spark, str(tmp_path / "s")) == {}
    N.save_state(spark, str(tmp_path / "s"), {"a": [1, None]})
    assert N.load_state(spark, str(tmp_path / "s")) == {"a": [1, None]}
