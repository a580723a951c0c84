from pyspark.sql import functions as F

from skerry.catalogue_bulk import spoken_orders
from skerry.functions.spoken import PIECES, spoken
from skerry.operators import streams

NINES = " ".join(f"nine hundred ninety nine {s}" for s in "quintillion quadrillion trillion billion million thousand".split())
CASES = {
    "May 5 0000, May 6 1000, Dec 31 0907": "may fifth zero, may sixth one thousand, december thirty first nine oh seven",
    "$00.05 or $0.00 or $01.50": "five cents or zero dollars or one dollar and fifty cents",
    "$3 thousand, $1.00 Billion": "three thousand dollars, one point zero zero billion dollars",
    "1000000th, 2000th, 112th, 0th": "one millionth, two thousandth, one hundred twelfth, zeroth",
    "100020003 and 1000000000": "one hundred million twenty thousand three and one billion",
    "000 0000 0012": "zero zero twelve",
    "9" * 21 + "th": f"{NINES} nine hundred ninety ninth",
    "a$b $c$5 $$6": "a$b $cfive dollars $six dollars",
    "word, été; " * 100_000 + "May 5": "word, été; " * 100_000 + "may fifth",
}


def test_numbers_of_all_lengths_and_long_texts(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "text string")
    assert {r.text: r.said for r in df.select("text", spoken(F.col("text")).alias("said")).collect()} == CASES


def test_words_between_are_one_piece(spark):
    """Each word and each blank was a piece of its own, and each went through every reader's lambdas: 27 of them here."""
    text = "Unit7 on July 27th, 2001 at 2:02, paid $300,513.02; the 27th of May, or 7/27/2001."
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).first()[0] == [
        "Unit", "7", " on ", "July 27th, 2001", " at ", "2:02", ", paid ", "$300,513.02", "; the ", "27th", " of May, or ", "7/27/2001", ".",
    ]


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """One number of tasks, however many orders there were."""
    monkeypatch.setattr(streams, "TASK_ROWS", 100)
    assert spoken_orders(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 15
