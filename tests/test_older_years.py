"""The year of an older schedule's car is not the number of its plate."""

import pytest

from ledgerloom.operators import older as OL

YEARS = [
    ("กข 2011\nUse: own since 1999", 1999),
    ("1กข 1995\nUse: own since 2004", 2004),
    ("กข-2011 กท", None),
    ("1กข2022", None),
    ("ปี 2010", 2010),  # a word that ends with a mark
    ("รุ่น 2010", 2010),  # its last letters alone are no word
    ("กขค 2012", 2012),  # three consonants are no plate
    ("กข 2011 Model Yr: 2003", 2003),
]


@pytest.mark.parametrize("text, year", YEARS)
def test_plate_numbers_are_no_years(spark, text, year):
    df = spark.createDataFrame([(text,)], "text string")
    assert OL.read_older_fields(df).select("car_year").collect()[0][0] == year
