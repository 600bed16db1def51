import random

from pyspark.sql import functions as F

from biblioflow.functions import kernel
from biblioflow.functions import text as T
from biblioflow.operators import linkage


def test_publishers_of_one_ending_do_not_all_meet(spark):
    rnd, names = random.Random(7), {"Sahim University Press", "Sahims University Press", "Press", "Pressing House"}
    for _ in range(150):
        x = "".join(rnd.choices("abdeghiklmnoprstuvz", k=rnd.randrange(6, 10))).capitalize()
        names |= {f"{x} University Press", f"{x[:-1]}w University Press"}
    df = spark.createDataFrame([(x, kernel.compact(x), kernel.words(x)) for x in sorted(names)], "name string, key string, words string").withColumn("bits", T.letter_bits(F.col("words")))
    blocks = linkage._rare_letters(df.select("name", "key", "words", "bits.*"), 0.9).groupBy("token").count()
    met = blocks.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 5 * len(names) ** 2 / 2  # once for each run of the ending before, 13 times

    got = {(r["name_a"], r["name_b"], r["reason"]) for r in linkage.publisher_suggestions(spark.createDataFrame([(i, x) for i, x in enumerate(sorted(names))], "id long, publisher string")).collect()}
    key = {x: kernel.compact(x) for x in names}
    pairs = [(a, b) for a in names for b in names if a < b]
    begins = {(a, b) for a, b in pairs if key[a].startswith(key[b]) or key[b].startswith(key[a])}
    assert got == {(a, b, "beginning" if (a, b) in begins else "likeness") for a, b in pairs if (a, b) in begins or kernel.ratio(a, b) >= 0.9}
    assert ("Press", "Pressing House", "beginning") in got
