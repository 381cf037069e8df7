import duckdb
import pytest

from trafficlens.llm import quality


def corpus():
    long = " ".join(f"w{k % 50}" for k in range(30_000))
    line = "a heading that every page of this host has got\n"
    rows = [(k, line + " ".join(f"own{k}x{j}" for j in range(40)), None, "hot" if k < 60 else f"host{k % 7}", 1) for k in range(90)]
    rows += [(100, None, None, "hot", 0), (101, "", "x", None, 0), (102, " \t\n\x0b ", "x", "hot", 0), (103, long, "x", "hot", 0), (104, line * 30, "x", None, 0),
             (105, "# * $ % & | < >\n" * 5 + "é 𝄞 " * 30, "x", "other", 0), (106, "one two three four five six seven eight " * 4, "x", "other", 0), (107, "19 words " * 9 + "x", "x", "other", 0)]
    return rows


@pytest.mark.parametrize("part", [slice(0, None), slice(90, None), slice(0, 0)])
def test_against_sql(spark, tmp_path, part):
    rows = corpus()[part]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", quality.F.lit("own"))
    found = quality.quality_rules(docs)
    docs.drop("kept").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    result = con.sql(quality.ORACLE)
    names = sorted(found.columns)
    order = [result.columns.index(n) for n in names]
    expected = sorted((tuple(r[k] for k in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == expected
    assert len(expected) == len(rows)
