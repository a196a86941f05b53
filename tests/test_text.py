import pytest
from pyspark.sql import functions as F

from lectern.functions import stem
from lectern.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (r"a \color[rgb]{1,0,0} b", "a b"),
        (r"a color{red}b", "a b"),
        (r"\left( x \right)", "( x )"),
        (r"x\quad y\,z", "x y z"),
        (r"\mathbf{\bm{\mathrm{q}}}", "q"),
        (r"\text{\text{\text{\text{q}}}}", r"\text{q}"),
        (r"\color{red}", r"\color{red}"),
        ("a  \t b", "a b"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_latex(spark, given, wanted):
    assert one(spark, given, T.clean_latex) == wanted


def test_clean_latex_strict_differs(spark):
    assert one(spark, r"color{red} a", T.clean_latex_strict) == "color{red} a"
    assert one(spark, r"\color{red}", T.clean_latex_strict) == ""


@pytest.mark.parametrize(
    ("given", "config", "wanted"),
    [
        ("Multi-hop RAG@5, Été_x v2.0", T.TokenizerConfig(), ["multi-hop", "multi", "hop", "rag@5", "été", "x", "v2", "0"]),
        ("Multi-hop", T.TokenizerConfig(preserve_compound=False), ["multi-hop"]),
        ("The Index of THE index", T.TokenizerConfig(remove_stopwords=True), ["index", "index"]),
        ("AbC", T.TokenizerConfig(lowercase=False), ["AbC"]),
        (":", T.TokenizerConfig(), []),
        (None, T.TokenizerConfig(), []),
    ],
)
def test_tokens(spark, given, config, wanted):
    assert one(spark, given, lambda c: T.tokens(c, config)) == wanted


def test_tokenizer_config_round_trip():
    c = T.TokenizerConfig(stemming=True, lowercase=False)
    assert T.TokenizerConfig.from_dict(c.to_dict()) == c


def test_sentences(spark):
    s = "As shown by Lee et al. in Fig. 2, it works. See Eq. 3! Is it so? It is 0.85."
    assert one(spark, s, T.sentences) == ["As shown by Lee et al. in Fig. 2, it works.", "See Eq. 3!", "Is it so?", "It is 0.85."]
    assert one(spark, "no end", T.sentences) == ["no end"]
    assert one(spark, "", T.sentences) == [] and one(spark, None, T.sentences) == []


def test_ngrams_and_words(spark):
    assert one(spark, "a b c", lambda c: T.ngrams(T.words(c), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.ngrams(T.words(c), 2)) == []
    assert one(spark, " a b\n", T.word_count) == 2 and one(spark, " ", T.word_count) == 0 and one(spark, None, T.word_count) == 0


def test_reports_on_text(spark):
    assert one(spark, "<div class='x'><P>1 < 2</p> <foo>", T.residual_tags) == ["div", "p"]
    assert one(spark, "RAG: A  Survey!", T.plain_title) == "rag a survey"
    assert one(spark, "a\nb" * 100, lambda c: T.preview(c, 5)) == "a ba ..."


def test_stem():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agree", "plastered": "plaster", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relate", "conditional": "condition", "is": "is", "falling": "fall", "sized": "size"}
    assert {w: stem.stem(w) for w in words} == words


def test_stemmed_terms(spark):
    df = spark.createDataFrame([("retrieving",), ("retrieving",), (None,)], "term string")
    assert [tuple(r) for r in stem.stemmed_terms(df).collect()] == [("retrieving", "retriev")]
