"""Claims before markers against the prefix of each marker, and the time that one answer with many markers takes."""

import re
import time

from pyspark.sql import functions as F

from docloom.functions import citations as C
from docloom.operators import grounding as G

ODD = ["1.[1]5 a. b [2] 3[3].5 c..[4] d", "a[1][2][3].b[4]! [5]\n- c [6]\n\n[7]; d 2[8].[9]", "[1]", "", "no marker. 1.5", "é? ü.[12]3.[13]4 [14]x.\n[15]", "[1234567890123456789] a [7] 3.[8].5[9]"]


def test_claims_are_those_of_each_prefix(spark):
    found = spark.createDataFrame(list(enumerate(ODD)), "k int, t string").select("k", F.posexplode(C.located_markers(F.col("t"))).alias("i", "m")).select("k", "i", "m.n", "m.claim")
    prefixes = [(k, i, int(m[1]), t[: m.start()]) for k, t in enumerate(ODD) for i, m in enumerate(re.finditer(r"\[(\d{1,18})\]", t))]
    wanted = spark.createDataFrame(prefixes, "k int, i int, n long, prefix string").select("k", "i", "n", C.preceding_claim(F.col("prefix")).alias("claim"))
    assert sorted(found.collect()) == sorted(wanted.collect()) and len(prefixes) == 21


def test_one_answer_with_many_markers(spark):
    text = "The harbour opened again in two thousand and five. " * 40
    answers = spark.createDataFrame([("a", "The harbour opened again in 2005 [1]. It never sank [2]. " * 4000)], "answer_id string, answer string")
    context = spark.createDataFrame([("a", n, 1, "g", text, True) for n in (1, 2)], "answer_id string, n long, source_id long, generation_id string, content string, owned boolean")
    began = time.time()
    found = G.verify_citations(answers, context, spark.createDataFrame([(1, "g")], "source_id long, active_generation_id string"))
    assert [tuple(r) for r in found.groupBy("n", "reason").count().orderBy("n", "reason").collect()] == [(1, "cited", 1), (1, "duplicate", 3999), (2, "unsupported", 4000)]
    assert time.time() - began < 60
