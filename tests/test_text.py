import pytest
from pyspark.sql import functions as F

from firmnet.functions import text


def words(spark, html, sep=""):
    return spark.createDataFrame([(html,)], "h string").select(text.page_words(F.col("h"), sep)).first()[0]


@pytest.mark.parametrize("html, want", [
    ("<?xml version='1.0'\n?><p>hello</p>", ["hello"]),
    ("<script>var t='</p>'; hidden()</script><p>shown</p>", ["shown"]),
    ("<SCRIPT type='a'>hidden</SCRIPT >shown", ["shown"]),
    ("<script>a <!-- b </script>shown <!-- gone -->here", ["shown", "here"]),
    ("<!-- <script> -->shown<script>hidden", ["shown"]),
    ("<style>p{color:red}</style><!-- note --><b>bold</b>", ["bold"]),
    ("<li>abc</li><li>def</li>", ["abcdef"]),
    ("un café très joli, an ox", ["caf", "tr", "joli"][0:1] + ["joli"]),
    ("<a title='x > y' href=\"q>r\">link</a> text", ["link", "text"]),
    ("one < two and three > four", ["one", "two", "and", "three", "four"]),
    ("cut <a href='/nowhere", ["cut"]),
    ("AT&amp;Tall r&eacute;sum&eacute; &nbsp;", ["Tall", "sum"]),
    ("&#97;bc &#x64;ef &#8212;ghi x&#zz;jkl", ["abc", "def", "ghi", "jkl"]),
    ("<button>press</button><select><option>pick</option></select>kept", ["kept"]),
    ("<title>Top</title><noscript>plain</noscript>", ["Topplain"]),
    ("<x " + " ".join(f"a{i}='>leaked words'" for i in range(200)) + ">shown", ["shown"]),
    ("alpha&nbsp beta&amp gamma&copy delta&notit AT&Tall", ["alpha", "beta", "gamma", "delta", "Tall"]),
    ("x&#0000000065;y x&#x00000000042;y", ["xAy", "xBy"]),
    ("abc&#99999999999999999999;def &#x1F600;ghi", ["abc", "def", "ghi"]),
    ("", []),
])
def test_words(spark, html, want):
    assert words(spark, html) == want


def test_separator(spark):
    assert words(spark, "<li>abc</li><li>def</li>", " ") == ["abc", "def"]


def test_broken_page_with_many_quotes_does_not_overflow(spark):
    assert words(spark, "start <x " + '"q" ' * 200_000 + "> end")[-1] == "end"


def test_long_page_is_read_whole(spark):
    assert len(words(spark, "<p>word </p>" * 300_000)) == 300_000


def test_normalise_words(spark):
    df = spark.createDataFrame([(["Ab ", "", " ", "cD"],)], "w array<string>")
    assert df.select(text.normalise_words(F.col("w"))).first()[0] == ["ab", "cd"]
