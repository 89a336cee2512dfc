import random
import unicodedata

import pytest

pytest.importorskip("verdigris.llm")
from verdigris.llm.leakage import TestSuffixes as Suffixes
from verdigris.llm.leakage import leaked_passages, shard_matches, suffix_array, without_leaks, words_of
from verdigris.llm.sentences import sentence_units, split_sentences
from verdigris.llm.tokenization import VOCABULARIES, decode_documents, encode_documents

TEXTS = [
    "Hello world, it's 2024!  Two spaces\n\n\tand tabs ",
    "naïve café — Übergröße",
    "日本語のテキスト。中文文本也在这里。",
    "नमस्ते दुनिया ครับ مرحبا",
    "😀👩‍👩‍👧 emoji  nbsp em",
    "<|endoftext|> is ordinary",
    "",
    None,
    "   ",
    "a" * 300 + " " + "xyz" * 200,
    "'re 'RE we'll",
]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("words", [5, 1000])
def test_encoding_and_decoding(spark, tokenizer, words):
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encoded = encode_documents(documents, VOCABULARIES, literal_words=words)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    if words == 5:
        assert {r.doc_id: r.text for r in decode_documents(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_words_of_any_length(spark, tokenizer):
    pick = random.Random(3)
    texts = ["x" * 100_000, "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "banana" * 500, "".join(pick.choice("ab") for _ in range(2_000)), "言葉" * 2_000]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_documents(documents).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_every_row_is_encoded_and_no_variable_left(spark):
    documents = spark.createDataFrame([(7, "one two"), (7, "one two"), (7, "antidisestablishmentarianism"), (None, "two")], "doc_id long, text string")
    for words in (0, 1, 100):
        rows = encode_documents(documents, literal_words=words).collect()
        assert sorted(str(r.doc_id) for r in rows) == ["7", "7", "7", "None"] and all(r.ids for r in rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("verdigris_")]


def test_random_words_against_the_public_encoder(spark, tokenizer):
    pick = random.Random(11)
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 60))) for letters in ("aab", "abcdeé", "тест ", "ab ab\n\t", "the ing") for _ in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_documents(documents, literal_words=40).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_encoding_of_nothing(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- leaks ---


def brute(documents, tests, least_words, least_letters):
    found = set()
    for doc, text in documents:
        words = words_of(text)
        for item, lang, passage in tests:
            units, own, n = (words, words_of(passage), least_words) if lang not in ("ja", "zh") else ("".join(words), "".join(words_of(passage)), least_letters)
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            if any(tuple(units[i : i + n]) in grams for i in range(len(units) - n + 1)):
                found.add((doc, item))
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    letters = ["alpha", "beta", "gamma", "delta", "Ωmega", "ﬁve", "12"]
    def passage(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    tests = [(i, "en", passage(9)) for i in range(12)] + [(20, "ja", "これは長い文章です、とても長い。"), (21, "zh", "短"), (22, "en", ""), (23, None, passage(8)), (24, "en", tests_text := passage(8)), (25, "en", tests_text)]
    documents = [(i, passage(rng.randrange(0, 60))) for i in range(60)] + [(100, "序。これは長い\n文章です　とても、長い！"), (101, None), (102, ""), (103, "、。"), (104, ("-".join(tests[0][2].split()) + ". ").upper()), (105, " ".join([tests_text] * 50))]
    d = spark.createDataFrame([(a, b, 1) for a, b in documents], "doc_id long, text string, item_id long").repartition(3)
    t = spark.createDataFrame([(*x, "w") for x in tests] * 2, "item_id long, lang string, passage string, doc_id string")
    found = leaked_passages(d, t, 4, 8)
    rows = found.collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(documents, tests, 4, 8) and len(rows) == len(got)
    assert {(104, 0), (100, 20), (105, 24), (105, 25)} <= got
    whole = next(r for r in rows if (r.doc_id, r.item_id) == (104, 0))
    assert whole.length >= len(words_of(tests[0][2]))
    assert {r.doc_id for r in without_leaks(d, found).collect()} == {a for a, _ in documents} - {a for a, _ in got}
    assert leaked_passages(d.limit(0), t, 4, 8).collect() == [] and leaked_passages(d, t.limit(0), 4, 8).collect() == []


@pytest.mark.parametrize("most", [1, 150, 10_000])
def test_leaks_of_test_sets_beyond_the_bound(spark, most):
    rng = random.Random(6)
    passage = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    tests = [(i, "en", passage(9)) for i in range(10)] + [(3, "en", passage(14)), (20, "ja", "これは長い文章です、とても長い。")]
    documents = [(i, passage(rng.randrange(0, 60))) for i in range(30)] + [(100, "これは長い文章です、とても長い！"), (101, None)]
    d, t = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(tests * 2, "item_id long, lang string, passage string")
    found = leaked_passages(d, t, 4, 8, most_test_bytes=most)
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(documents, tests, 4, 8) and len(rows) == len(set(rows))
    assert sorted(rows) == sorted(leaked_passages(d, t, 4, 8).collect())
    assert leaked_passages(d, t.limit(0), 4, 8, most_test_bytes=most).collect() == []


def test_suffix_arrays():
    import numpy as np

    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 200).astype(np.int32)
    order = suffix_array(symbols, 8)
    keys = [tuple(symbols[i : i + 8]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(200))
    tests = Suffixes([(1, ["a", "b", "c"]), (2, ["a"])], 2)
    assert tests.pieces(["x", "a", "b", "x", "a"])[0][0] == 1 and len(tests.pieces(["a", "x"])) == 0
    assert list(shard_matches(tests, [])) == []


def test_words():
    assert words_of("Ａ-b　c3²…½") == ["a", "b", "c32", "1", "2"]
    assert words_of(None) == [] and words_of("—") == []
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi" and words_of("ﬁn") == ["fin"]


# --- sentences ---

CASES = [
    "Dr. A. B. Smith paid 3.50 on p. 4.| It was late!| Why?| (Applause.)| Go on.",
    "He met Mr. Jones at 5.20 p.m. and left.| They met until 2.40 p.m.| Yes!",
    "“We waited. We went,” said Ms. Lee.| “Is it so?” Mr. Low asked.| He cried “Stop!” and ran.| She asked: “Who pays?”| They left.",
    "Is 5 enough? or 6?| Is it — alas! — so?| Wrong…| Then he went.| We … we go.",
    "See No. 5 of it.| No.| It (Shame!) is.",
    "They brought maps, etc. and rope.| Ropes etc.| The Harbour Co. and Low Bros. Ltd. both ask.",
    "Seit dem 1. Quartal, am 4. März, bis zum 13. Mai.| Sie erhielt 40.846.| Das gilt z. B. hier, d. h. heute.| „Wir gehen. Jetzt“, sagte Hr. Ott.",
    "L’art. R. 43-23 est clair.| Selon l’art. 83, on sort.| Voir p. 4 du n° 5.| « Qui paiera ? »| Le taux monte.| M. le Pdt. Roy dit « Halte ! » et sort.",
    "¿Por qué?| ¡Basta ya!| Los EE. UU. van.| Véase la pág. 4.",
    "В 2020 г. совет обещал.| Жители г. Лубафен ждут.| Списки и т. д.| «Мы ждём. Идём», — сказал А. Б. Ким.",
    "Ποιος πληρώνει;| Οι πολίτες, π.χ. εδώ, κ.λπ.| Κα Μιβα ήρθε· δεν έγινε.",
    "قال د. كازر: «لن ننتظر. سنعمل».| لماذا؟| نعم، انظر ص. 4.",
    "डॉ. लुनो ने पृ. 4 पर 3.5 लिखा।| “हम चलेंगे। अब,” श्री नेपे ने कहा।| क्यों?",
    "「待てません。行く。」と彼は言った。|なぜ？|（笑い。）|予算は3.5％（約）です。|そう…ずっと待つ。",
    "他说：“我们走。现在。”|“谁来？”苏部长问。|有人喊“停！”，随后离开。|我们……我们不能。|真的吗？！",
    "ดร. คากา ไม่เห็นด้วยค่ะ| ไม่ครับ| ปี 2022 สภา แต่ไม่ได้ทำครับ| (เสียงปรบมือ)",
    "The end.|Next one.| Head\n\n|Body line one\nline two.\n \n|Last",
    "1. First point.| 2. Second point.",
]


@pytest.mark.parametrize("marked", CASES)
def test_sentences(marked):
    text = marked.replace("|", "")
    want = [p.strip() for p in marked.split("|") if p.strip()]
    units = sentence_units(text)
    assert [text[a:b] for a, b in units] == want
    assert "".join("".join(text[a:b].split()) for a, b in units) == "".join(text.split())


@pytest.mark.parametrize("text", [None, "", "  \n\n ", "“open quote. Never closed", "(open bracket. x", "....", "a" * 50_000, ". . .", "\ud800"[:0] + "x y"])
def test_odd_texts(text):
    units = sentence_units(text)
    assert "".join("".join(text[a:b].split()) for a, b in units) == "".join((text or "").split()) if text else units == []


def test_split_documents(spark):
    documents = spark.createDataFrame([(1, "A b. C d.", 5), (2, None, 5), (3, "", 5), (1, "A b. C d.", 6), (None, "X y.", 7)], "doc_id long, text string, start_pos int")
    assert sorted(map(tuple, split_sentences(documents).collect()), key=str) == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (None, 0, 4)], key=str)
    assert split_sentences(documents.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("He told me. Then he left.", 2), ("We value art. It matters.", 2), ("This is the cap. It fits.", 2), ("He has a fig. She ate it.", 2), ("See fig. 3 and art. 5 of it.", 1),
        ("El gobierno, no. La sala se levanta.", 2), ("Véase la pág. 3 del acta núm. 5 de la sala.", 1), ("Selon l’art. R. 5 le conseil est clair. Oui.", 2), ("هتفوا «قف!» وخرجوا. لا.", 2),
        ("Wir haben, vgl. Anlage 5, nichts. Das ist alles.", 2), ("It is 3.5 m. Why?", 2), ("He said “No. Never.” and left.", 1),
    ],
)
def test_abbreviations_by_language(text, units):
    assert len(sentence_units(text)) == units


@pytest.mark.parametrize("part", ["( a ", '" a ', ". ", "1. ", "a. ", "(“ a. ", "« x! ", "「"])
def test_time_grows_with_the_text(part):
    import time

    took = []
    for size in (50_000, 400_000):
        start = time.perf_counter()
        sentence_units(part * (size // len(part)))
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0] + 0.5
