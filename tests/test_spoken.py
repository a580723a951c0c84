from pyspark.sql import functions as F

from skerry.functions.spoken import spoken

CASES = {
    "May 5th, 2024": "may fifth twenty twenty four",
    "Mayor 5th": "Mayor fifth",
    "dismay 5": "dismay five",
    "may 5": "may fifth",
    "May be 5": "May be five",
    "Jan. 1 1905 it was": "january first nineteen oh five it was",
    "on Sept 30, 1900.": "on september thirtieth nineteen hundred.",
    "March 12 2000": "march twelfth two thousand",
    "March 12 2005": "march twelfth two thousand five",
    "March 32": "March thirty two",
    "2/29/2024 or 2024-02-29": "february twenty ninth twenty twenty four or february twenty ninth twenty twenty four",
    "13/40/2024": "thirteen/forty/two thousand twenty four",
    "10:30": "ten thirty",
    "10:00, 7:05": "ten o'clock, seven oh five",
    "10:30 p.m. and 9:00 AM": "ten thirty pm and nine am",
    "25:10": "twenty five:ten",
    "10:75": "ten:seventy five",
    "1:2": "one:two",
    "$3.50": "three dollars and fifty cents",
    "$1": "one dollar",
    "$1.01": "one dollar and one cent",
    "$0.99": "ninety nine cents",
    "$1,234.00": "one thousand two hundred thirty four dollars",
    "$2.50 million": "two point five zero million dollars",
    "$ 5": "$ five",
    "1st of": "first of",
    "the 21st, 12th, 40th, 100th and 103rd": "the twenty first, twelfth, fortieth, one hundredth and one hundred third",
    "5th3": "fiveththree",
    "3.50": "three point five zero",
    "12,345 and 12,34": "twelve thousand three hundred forty five and twelve,thirty four",
    "unit 007 at 0": "unit seven at zero",
    "x90y115": "xninetyyone hundred fifteen",
    "1" * 22: " ".join(["one"] * 22),
    "no numbers, été!\n": "no numbers, été!\n",
    "": "",
    None: None,
}


def test_spoken_forms(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "text string")
    got = {r.text: r.said for r in df.select("text", spoken(F.col("text")).alias("said")).collect()}
    assert got == CASES
