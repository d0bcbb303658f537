from pyspark.sql import functions as F

from qiyas.llm import language_id as lid


def test_language_of_copies_is_learned(spark):
    copies = [(k, "das haus und der hund", "de") for k in range(20000)]
    docs = spark.createDataFrame([*copies, (20000, "ein anderer satz", "de"), (20001, "the house and the dog", "en")], "doc_id long, text string, lang string")
    found = lid.learn(docs)
    assert list(found) == ["de", "en"] and b"haus" in found["de"] and b"satz" in found["de"]


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k, f"words of language number {k}", f"l{k}") for k in range(600)], "doc_id long, text string, lang string")
    assert len(lid.learn(docs)) == 600


def plain(docs, dict_bytes=lid.DICT_BYTES):
    """The classifier once more, without Spark: whole learned texts in the order of their hash, one coder a language and block."""
    import zstandard as z

    order, seen = {}, set()
    for h, _, text, lang in sorted(docs):
        if text and lang and (lang, text) not in seen:
            seen.add((lang, text))
            order.setdefault(lang, []).append(text)
    raw = {lang: b" ".join(lid.letters(t) for t in texts)[:dict_bytes] for lang, texts in order.items()}

    def size(text, lang):
        blocks = [bytes(64) + lid.letters(text)[i : i + 2048] for i in range(0, max(len(lid.letters(text)), 1), 2048)]
        params = z.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3)
        coder = z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(raw[lang], dict_type=z.DICT_TYPE_RAWCONTENT))
        return sum(len(coder.compress(b)) for b in blocks)

    return {(i, text): min(raw, key=lambda g: size(text, g)) if any(c.isalpha() for c in text or "") else "und" for _, i, text, _ in docs}


def test_equals_a_plain_classifier(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select(F.xxhash64("text"), "doc_id", "text", "lang").collect()]
    want = plain(rows)
    got = {(r.doc_id, t): r.lang_pred for r, t in ((r, dict((i, t) for _, i, t, _ in rows)[r.doc_id]) for r in lid.predict(df, lid.learn(df)).collect())}
    differ = [k for k in want if want[k] != got[k]]
    assert len(differ) <= 0.02 * len(want)  # the dictionaries differ where a text is cut


def test_one_setting_for_all_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classify = lid.Classifier(lid.learn(docs))
    text = " ".join(r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(5).collect())
    scores = [classify(text[:n]) for n in range(560, 640, 5)]
    assert {s[0] for s in scores} == {"de"} and max(abs(a[1] - b[1]) for a, b in zip(scores, scores[1:])) < 0.02


def test_ties_of_sizes_and_extra_columns(spark):
    rows = [(1, "aa bb", "x", 1), (2, "aa bb", "y", 2), (3, "aa bb", "y", 3), (None, "aa bb", "y", 4), (4, "aa", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    known = lid.learn(docs)
    assert list(known) == ["y", "x"] and known["x"] == known["y"]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in lid.predict(docs, known).collect()}
    assert got == dict.fromkeys((1, 2, 3, None, 4), ("y", True))
