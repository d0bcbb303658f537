"""Pieces of words against the library of the public tokenizers, and differences of vocabularies."""

import base64

import pytest
from pyspark.sql import functions as F

from qiyas.operators import fertility
from qiyas.plans.vocabulary import RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    return fertility.ranks(spark.read.text(f"file://{public.path(RANKS)}"))


def test_pieces_equal_the_library(spark, vocabulary):
    public = pytest.importorskip("public_tokenizers")
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    odd = ["", None, "  leading and  trailing  ", "a b 　 c\n\n\td\x0be", "it's we'll I'd 'so", "x" * 3000, "abc" * 700, "日本語のテキスト 😀😀 ÜÇƏ", "1234567 12 3.14159", "\n \n x", "<|endoftext|> [PAD]", "é" * 50 + "!?!?!?"]
    texts = [(f"t{i}", x) for i, x in enumerate(odd)] + [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    want = {}
    for g, x in texts:
        n, w = want.get(g, (0, 0))
        want[g] = (n + len(t.encode(x or "", add_special_tokens=False).ids), w + len((x or "").split()))
    got = {r.g: (r.pieces, r.words) for r in fertility.measured(spark.createDataFrame(texts, "g string, text string"), vocabulary, "g").collect()}
    assert got == want


def test_pieces_without_a_vocabulary(spark):
    ranks = fertility.ranks(spark.createDataFrame([(base64.b64encode(p).decode() + f" {i}\n",) for i, p in enumerate((b"a", b"b", b"ab", b"abab", b"aa"))], "value string"))
    words = spark.createDataFrame([("abab",), ("aaab",), ("z",), ("é",), ("baab",), ("aaaa",)], "word string")
    assert {r.word: r.pieces for r in fertility.merged(words, ranks).collect()} == {"abab": 1, "aaab": 2, "z": 1, "é": 2, "baab": 3, "aaaa": 2}
    assert fertility.merged(words.limit(0), ranks).count() == 0
    assert {r.pieces for r in fertility.merged(words, ranks.limit(0)).collect()} == {1, 2, 4}
    out = fertility.measured(spark.createDataFrame([("x", "ab ab"), ("y", None), ("z", " ")], "g string, text string"), ranks, "g")
    assert {r.g: (r.pieces, r.words, r.per_word) for r in out.collect()} == {"x": (3, 2, 1.5), "y": (0, 0, 0.0), "z": (1, 0, 0.0)}
    assert fertility.compared(out, "g", "x", "z").first().ratio is None and fertility.compared(out, "g", "z", "x").first().ratio == 0


def test_control_pieces(spark):
    marks = {"<|audio_start|>": True, "[PAD]": True, "<": False, "<>": False, "-15": False, " Almaty": False, "<a": False, "[x>": False}
    df = spark.createDataFrame([(k,) for k in marks], "p string").select("p", fertility.is_control(F.col("p")).alias("c"))
    assert {r.p: r.c for r in df.collect()} == marks


def test_added_pieces(spark):
    names = [("base", p) for p in ("a", "b", "<s>")] + [("words", p) for p in ("a", "b", "Almaty", "KZT", "<|x|>", "KZT")] + [("marks", p) for p in ("a", "[NEW]")] + [("same", "a")]
    pairs = spark.createDataFrame([("1", "base", "words"), ("2", "base", "marks"), ("3", "base", "same"), ("4", "base", "gone"), ("5", "gone", "base")], "label string, base string, tuned string")
    got = {r.label: (r.words, r.special, r.controlled) for r in fertility.added(spark.createDataFrame(names, "name string, piece string"), pairs).collect()}
    assert got == {"1": (2, 1, False), "2": (0, 1, True), "3": (0, 0, True), "4": (None, None, None), "5": (None, None, None)}
