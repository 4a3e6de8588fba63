import pytest
from pyspark.sql import functions as F

from notemill.functions.snippets import snippet
from notemill.functions.stemmer import stem
from notemill.functions.text import analyse_query, split_words, tokens

STEMS = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor "
    "sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail "
    "filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit "
    "conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam triplicate:triplic "
    "formative:form hopeful:hope goodness:good revival:reviv adjustment:adjust sensitiviti:sensit sensibiliti:sensibl probate:probat "
    "cease:ceas controlling:control meet:meet run:run at:at a:a element:elem"
)


@pytest.mark.parametrize("pair", STEMS.split())
def test_stem(pair):
    word, want = pair.split(":")
    assert stem(word) == want


SPLITS = [
    ("Hello World", ["hello", "world"]),
    ("parseFrontmatter", ["parsefrontmatter", "parse", "frontmatter"]),
    ("HTMLParser", ["htmlparser", "html", "parser"]),
    ("parse_frontmatter", ["parse", "frontmatter"]),
    ("html5parser", ["html5parser", "html", "5", "parser"]),
    ("café résumé", ["café", "résumé"]),
    ("hello, world!", ["hello", "world"]),
    ("", []),
    (None, []),
]


def test_split_and_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPLITS)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", split_words(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(SPLITS))] == [w for _, w in SPLITS]
    one = spark.createDataFrame([("The HTML5 of a x Cat",)], "t string").select(tokens(F.col("t")).alias("w")).first()["w"]
    assert one == ["html5", "html", "cat"]
    assert analyse_query("The HTML5 cats cats") == ["html5", "html", "cat"]


def test_snippet():
    assert snippet("abc", ["zz"]) is None
    assert snippet("short  text\nhere", ["text"]) == "short text here"
    long = " ".join(f"word{i}" for i in range(200))
    s = snippet(long, ["word100"])
    assert s.startswith("… ") and s.endswith(" …") and "word100" in s
    assert all(w.startswith("word") for w in s.strip("… ").split())
