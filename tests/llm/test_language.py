import numpy as np
from duebook.llm import language


def test_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 150 and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    model = language.fit(docs)
    cases = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \U0001f600"), (4, "the and of in " * 5000), (None, "der die und ist nicht"), (6, "Ελληνικά"), (7, "ༀཁ")], "doc_id long, text string")
    out = {r.doc_id: r for r in language.identify(cases, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"]
    assert out[6].lang_pred in model.languages and out[7].lang_pred in model.languages
    mixed = spark.createDataFrame([(1, "the that with from this " * 8 + "der die und nicht ist " * 3)], "doc_id long, text string")
    r = language.identify(mixed, model).collect()[0]
    assert r.lang_pred == "en" and [(s.lang, s.words) for s in r.spans] == [("en", 40), ("de", 15)] and 0.6 < r.score < 0.9


def test_scripts_narrow_and_empty(spark):
    docs = spark.createDataFrame([(i, "привет мир", "ru") for i in range(4)] + [(10 + i, "hello world", "en") for i in range(4)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    out = language.identify(spark.createDataFrame([(1, "hhh"), (2, "ъъъ")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "en", 2: "ru"}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.languages(none).count() == 0
    assert language.identify(docs, language.fit(none)).first().lang_pred == "und"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 5, 10])
    scores = rng.standard_normal((10, 3)) * 2
    path = language.viterbi(scores, first, 1.0)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        value = lambda p: sum(scores[a + k, s] for k, s in enumerate(p)) - sum(x != y for x, y in zip(p, p[1:]))
        best = max(value(p) for p in np.ndindex(*(3,) * (b - a)))
        assert abs(value(path[a:b]) - best) < 1e-9


def test_any_script_and_any_number_of_languages(spark):
    said = {"te": "తెలుగు భాష చాలా అందమైనది", "kn": "ಕನ್ನಡ ಭಾಷೆ ತುಂಬಾ ಸುಂದರ", "ml": "മലയാളം ഭാഷ", "am": "ሰላም ለዓለም", "km": "ភាសាខ្មែរ ល្អ", "my": "မြန်မာဘာသာ စကား", "en": "the hello world"}
    rows = [(10 * k + j, t, x) for k, (x, t) in enumerate(said.items()) for j in range(2 if x == "en" else 1)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    cases = [(k, t) for k, t in enumerate(said.values())] + [(20, said["te"] + " hello"), (21, "ລາວ"), (22, "ລາວ ລາວ hello")]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(cases, "doc_id long, text string"), model).collect()}
    assert [(out[k].lang_pred, out[k].score) for k in range(len(said))] == [(x, 1.0) for x in said]
    assert [(s.lang, s.words) for s in out[0].spans] == [("te", 4)]
    assert [(s.lang, s.words) for s in out[20].spans] == [("te", 4), ("en", 1)] and out[20].lang_pred == "te" and 0.7 < out[20].score < 1
    assert (out[21].lang_pred, out[21].score) == ("en", 0.0)
    assert out[22].lang_pred == "en" and 0 < out[22].score < 0.6
    many = spark.createDataFrame([(k, f"{chr(0x4E00 + 9 * k) * 4} {chr(0xAC00 + 9 * k) * 4}", f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    model = language.fit(many)
    got = {r.doc_id: r.lang_pred for r in language.identify(many, model).collect()}
    assert len(model.languages) == 300 and got == {k: f"l{k:03}" for k in range(300)}


def test_a_rare_language_is_in_the_sample(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'the and of in' AS text", "'en' AS lang").unionByName(spark.createDataFrame([(5000, "తెలుగు", "te")], "doc_id long, text string, lang string"))
    model = language.fit(docs, most=50)
    assert language.identify(spark.createDataFrame([(1, "తెలుగు")], "doc_id long, text string"), model).first().lang_pred == "te"
