"""Texts on their way to a model and from one."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vector import BigramEmbedder, embed


class Prefixed(BigramEmbedder):
    family = "e5"


def test_prefixes_reach_the_embedder(spark):
    df = spark.createDataFrame([(1, "a text"), (2, None)], "id int, t string")
    plain = BigramEmbedder(16)
    for kind in ("query", "passage"):
        got = {r.id: list(r.embedding) for r in embed(df, "t", Prefixed(16), kind=kind).collect()}
        want = {r.id: list(r.embedding) for r in embed(spark.createDataFrame([(1, f"{kind}: a text"), (2, f"{kind}: ")], "id int, t string"), "t", plain).collect()}
        assert got == want
    assert embed(df, "t", plain, kind="query").collect() == embed(df, "t", plain).collect()


def test_a_cut_text_names_the_way_to_the_rest(spark):
    n = len(T.CUT_NOTICE)
    df = spark.createDataFrame([("short",), (None,), ("",), ("x" * 100,), ("x" * 101,), ("y" * (95 - n) + " \n\t" + "z" * 50,), ("é" * 300,)], "t string")
    got = [r.c for r in df.select(T.cut_text(F.col("t"), 100).alias("c")).collect()]
    assert got[:4] == ["short", None, "", "x" * 100] and got[4] == "x" * (100 - n) + T.CUT_NOTICE
    assert got[5] == "y" * (95 - n) + " \n\t" + "zz" + T.CUT_NOTICE and len(got[6]) == 100
    assert df.where("t like 'y%'").select(T.cut_text(F.col("t"), 98).alias("c")).first().c == "y" * (95 - n) + T.CUT_NOTICE
