"""File readers: TSV / comma / CSV files give what the table-derived jobs give."""

from pyspark.sql import functions as F

from parlance.plans import sources as S
from parlance.sources import files as FL
from parlance.sources import lines as L
from parlance.sources import tables as TB
from tests.conftest import SF0001


def test_utterance_and_turn_files(spark, tmp_path):
    docs = S.documents(spark, SF0001)
    lines = TB.utterance_lines(docs)
    lines.select("value").write.text(str(tmp_path / "utt"))
    got = FL.read_utterances(spark, str(tmp_path / "utt"), min_fields=1, trim_text=False)
    want = L.parse_utterances(lines, min_fields=1, trim_text=False)
    assert sorted(map(tuple, got.select("utterance", "strLabel").collect())) == \
        sorted(map(tuple, want.select("utterance", "strLabel").collect()))
    conv = TB.read_table(spark, SF0001, "conversations")
    TB.turn_lines(conv).select("value").write.text(str(tmp_path / "turns"))
    t = FL.read_turns(spark, str(tmp_path / "turns"))
    assert t.count() == conv.count()
    assert t.filter(F.col("domain").isNull()).count() == conv.filter(F.col("conv_id") % 3 == 2).count()


def test_dictionary_and_csv_files(spark, tmp_path):
    p = tmp_path / "dict.tsv"
    p.write_text("Kobe,Bryant,KB\nCurry,Steph,Chef Curry\nlonely\n")
    d = {r["alias"]: r["canonical"] for r in FL.read_dictionary(spark, str(p), "player").collect()}
    assert d == {"bryant": "kobe", "kb": "kobe", "steph": "curry", "chef curry": "curry"}
    emb = TB.read_table(spark, SF0001, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    emb.select(*cols, F.col("label").cast("double").alias("y")).write.csv(str(tmp_path / "csv"))
    r = FL.read_labelled_csv(spark, str(tmp_path / "csv"), 65, 64)
    assert r.count() == emb.count()
    assert r.first()["features"].size == 64


def test_line_numbers_follow_files_and_offsets(spark, tmp_path):
    """The order of files is by path, whatever their size, and of lines by offset, over several splits."""
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(5)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(3000)))
    (tmp_path / "c.txt").write_text("c0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r["line_id"]: r["value"] for r in FL.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3000)] + ["c0"]
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_prior_over_a_dialogue_folder(spark, tmp_path):
    """The file-order prior over several files equals the one over their lines in order."""
    from parlance.operators import context as CX
    lines = [f"text {i}\tna\tx\t{'nba' if i * 7 % 3 else 'weather'}" for i in range(60)]
    for k, part in enumerate((lines[:5], lines[5:50], lines[50:])):
        (tmp_path / f"part{k}.tsv").write_text("\n".join(part) + "\n")
    prior = CX.domain_prior(FL.read_turns(spark, str(tmp_path)), ["line_id"], num_ranges=3)
    got = {r["line_id"]: r["prior"][0] for r in prior.collect()}
    nba = 0
    for i, line in enumerate(lines):
        nba += line.endswith("nba")
        assert abs(got[i] - nba / (i + 1)) < 1e-12


def test_csv_rows_that_are_no_numbers(spark, tmp_path):
    import pytest
    (tmp_path / "x.csv").write_text("1,2,0\n3,oops,1\n4,5\n6, 7 ,1\n")
    with pytest.raises(Exception, match="not a numeric row"):
        FL.read_labelled_csv(spark, str(tmp_path / "x.csv"), 3, 2).collect()
    rows = FL.read_labelled_csv(spark, str(tmp_path / "x.csv"), 3, 2, rejects_col="bad").collect()
    assert [(r["label"], r["bad"]) for r in rows] == [(0.0, None), (None, "3,oops,1"), (None, "4,5"), (1.0, None)]
    assert rows[3]["features"].toArray().tolist() == [6.0, 7.0] and rows[1]["features"] is None
