"""Names, tokens, leaks and languages: brute force, exact round trips and planted cases."""

from __future__ import annotations

import random

import pytest

from spectrail.llm.contamination import ALTERED, EXACT_WORDS, PASSAGE_WORDS, ItemIndex, Words, canonical_word, fewest_edits, find_leaks, leaks_of, template_word
from spectrail.llm.language import CODES, HOLE, Model, Parser, clean_text, cross_parse, find_segments, fit, label_code, letters_of, model_of, segments_of
from spectrail.llm.name_matching import Matcher, SimilarWords, aliases_of, allowed, edits, match_names, tokens
from spectrail.llm.tokenizer import TOKENIZERS, PerfectHash, encode_corpus, encoder, read_vocabulary

REFERENCE = [(1, "Alpina montana"), (2, "Alpina rubrifolia"), (3, "Borealis montana"), (4, "Cirrus vulgariformis")]
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def _matcher(entries):
    """The matcher of a small list, put together without tables."""
    forms: dict = {}
    for ref, name in entries:
        for form, kind in aliases_of(tokens(name)).items():
            forms.setdefault(form, []).append((kind != "full", ref))
    named = {f: min(x)[1] for f, x in forms.items() if not min(x)[0] or len({r for _, r in x}) == 1}
    short = lambda ref, w: len(w) > 1 and named.get(" ".join([w[0][0], *w[1:]])) == ref
    return Matcher([(r, tuple(tokens(n)), short(r, tokens(n))) for r, n in entries if tokens(n)], list(named.items())).build()


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("ALPINA MONTANA", 1), ("montana, Alpina", 1), ("Alpinamontana", 1), ("alpina rubrifolia (L.) Mill.", 2), ("Alpina (Subgenus) rubrifolia", 2), ("sample: Borealis montana #3", 3),
        ("A. rubrifolia", 2), ("C vulgariformis", 4), ("Cirus vulgarifromis", 4), ("Álpina × mont4na", 1), ("Alpina", -1), ("Alpina sp.", -1), ("Alpina vulgariformis", -1),
        ("Cirrus montana", -1), ("blank 3", -1), ("", -1), (None, -1), ("x " * 3_000 + "Cirrus vulgariformis", 4), ("Cirrus vu1gariformis", 4),
    ],
)
def test_names(value, ref):
    assert _matcher(REFERENCE).match(value)[0] == ref


def test_joined_names_may_be_wrong_as_far_as_words():
    matcher = _matcher(REFERENCE)
    for joined in ("Cirus vulgarifromes", "Cirrsu vulgrifromis", "Alpima rubrifolla"):
        assert matcher.match(joined)[0] == matcher.match(joined.replace(" ", "").lower())[0] > 0
    for value in ("cirusvulgarifromes", "cirrsuvulgrifromis", "alpimarubrfolla"):
        assert matcher.match(value)[0] > 0
    assert matcher.match("cirvulgaifroms")[0] == -1


TITLES = [(1, "Paris"), (2, "London"), (3, "New London"), (4, "New London Bay"), (5, "Senior Software Engineer"), (6, "Software Engineer"), (7, "Software Engineer in Test"), (8, "Frankfurt am Main"), (8, "Frankfort"), (9, "Rome"), (10, "Bern"), (11, "Saint-Denis"), (12, "Saint Denis")]


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("paris", 1), ("Paris, France", 1), ("Pariss", 1), ("LONDON (UK)", 2), ("new london", 3), ("London New", 3), ("New London Bay area", 4), ("Lodnon", 2), ("engineer, software", 6), ("software engineer (senior)", 5),
        ("Sr. senior software enginer", 5), ("Software Engineer in Test", 7), ("Frankfurt Main", 8), ("frankfort", 8), ("Frankfurtammain", 8), ("Rom", -1), ("Berne", -1), ("Berlin", -1), ("St Denis", -1), ("saint denis", 11),
    ],
)
def test_any_list(value, ref):
    """Entries of one to four words that share words and beginnings."""
    assert _matcher(TITLES).match(value)[0] == ref


def test_similar_words_equal_brute_force():
    rng = random.Random(8)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 14))) for _ in range(400)}
    found = SimilarWords(words)
    n = 0
    for w in sorted(words)[::3]:
        typed = list(w)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(typed))
            typed[k : k + rng.randrange(3)] = rng.sample("abcdexyz", rng.randrange(3))
            typed = typed or ["a"]
        own = found.of("".join(typed))
        assert own == {x: e for x in words if (e := edits("".join(typed), x, 9)) <= allowed(x)}
        n += len(own)
    assert n > 60


def test_blocks_of_the_list_agree(spark):
    """A list in blocks of two entries gives what it gives whole."""
    values = ["paris", "London (New)", "new london bay", "engineer software", "software engineer in test lab", "frankfurt main", "lodnon", "nothing", "saint denis", "Softwareengineer", "new londn bay"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, name string")
    canon = spark.createDataFrame(TITLES, "ref long, name string")
    got = [sorted(map(tuple, match_names(df, "id", "name", canon, "ref", "name", block_entries=n).select("id", "ref", "way").collect())) for n in (2, 100)]
    assert got[0] == got[1] and [r for _, r, _ in got[1]] == [1, 3, 4, 6, 7, 8, 2, -1, 11, 6, 4]


def test_name_parts():
    assert tokens("Álpina cf. ru8ra 12") == ["alpina", "rubra"]
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3


def test_match_names_table(spark):
    data = [(1, "Alpina montana", "x"), (2, "alpina montana", "x"), (3, None, "x"), (4, "", "x"), (5, " ", "x"), (6, "nothing", "x"), *[(10 + i, "montana alpina", "x") for i in range(30)]]
    df = spark.createDataFrame(data, "id long, name string, ref string")
    canon = spark.createDataFrame(REFERENCE, "ref long, name string")
    for hot in (5, 10_000):
        got = {r.id: r.ref for r in match_names(df, "id", "name", canon, "ref", "name", hot_rows=hot).collect()}
        assert got == {2: 1, 5: -1, 6: -1, **{10 + i: 1 for i in range(30)}}
    assert match_names(df.limit(0), "id", "name", canon, "ref", "name").count() == 0
    assert {r.ref for r in match_names(df, "id", "name", canon.limit(0), "ref", "name").collect()} == {-1}


def test_perfect_hash_is_minimal():
    vocabulary = read_vocabulary(RANKS)
    h = PerfectHash(vocabulary)
    assert sorted(map(h.slot, vocabulary)) == list(range(len(vocabulary)))


def test_tokens_equal_two_public_encoders():
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(read_vocabulary(RANKS))}, special_tokens={})
    b = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    b.encode_special_tokens = True
    own, rng = encoder(RANKS), random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "1", "²", "é", "é", "中", "　", "\x1c", "\x85", "'s", "...", "😀", "<|endoftext|>", "Ⅷ", "\r\n", "ß", "ا", "methoxy", "stilbene"]
    for _ in range(1_500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert own.encode(text) == a.encode_ordinary(text) == b.encode(text, add_special_tokens=False).ids
    assert own.encode("abcdefghij" * 3_000) == a.encode_ordinary("abcdefghij" * 3_000)


def test_encode_corpus(spark):
    texts = ["", None, "a b", "a b", "x" * 50_000]
    got = {r.doc_id: r.ids for r in encode_corpus(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string"), "doc_id", "text").collect()}
    vocabulary = read_vocabulary(RANKS)
    assert got[0] == got[1] == [] and got[2] == got[3]
    assert all(b"".join(vocabulary[i] for i in got[k]).decode() == (t or "") for k, t in enumerate(texts))
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def _passage_exists(item, text):
    """Whether the plain definition finds a passage, by trying every part of the item."""
    runs = any(item[i : i + EXACT_WORDS] == text[j : j + EXACT_WORDS] for i in range(len(item) - EXACT_WORDS + 1) for j in range(len(text) - EXACT_WORDS + 1))
    if runs:
        return True
    for i in range(len(item) - PASSAGE_WORDS + 1):
        row = [0] * (len(text) + 1)
        for n, w in enumerate(item[i:], 1):
            new = [n]
            for j, x in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
            row = new
            if n >= PASSAGE_WORDS and min(row) * ALTERED <= n:
                return True
    return False


def test_leaks_equal_brute_force():
    rng = random.Random(6)
    words = [f"w{i}" if i % 4 else f"{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    texts: list = [None, "", " - | - "]
    for _ in range(150):
        source = rng.choice(items).split()
        a = rng.randrange(max(1, len(source) - 10))
        part = source[a : a + rng.randrange(8, 34)]
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(part))
            part[k : k + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(words)]])
            part = part or ["x"]
        texts.append(" ".join([*(rng.choice(words) for _ in range(9)), *(w.upper() if rng.random() < 0.2 else f"<b>{w}</b>," if rng.random() < 0.1 else w for w in part), *(rng.choice(words) for _ in range(5))]))
    index = ItemIndex(list(range(len(items))), items)
    got = {(d, i) for d, i, kind, _ in leaks_of(index, Words(index.common), texts) if kind != "reparameterised"}
    plain = [[c for w in (t or "").replace("<b>", "").replace("</b>", "").split() if (c := canonical_word(w))] for t in texts]
    want = {(d, i) for d, t in enumerate(plain) for i, item in enumerate(items) if _passage_exists(item.split(), t)}
    assert got == want and len(want) > 15


def test_fewest_edits():
    assert fewest_edits([1, 2, 3], [1, 9, 3], 2) == [0, 0, 1, 1]
    assert fewest_edits([1, 2, 3], [], 2)[:3] == [0, 1, 2]


def test_reparameterised_and_table(spark):
    item = "How many grams of kelosine must the analyst add to 40 ml before the peak at 12 appears"
    other = item.replace("kelosine", "marfosine").replace("40", "55").replace("12", "31")
    marked = item.replace(" ", "&nbsp;", 3).replace("grams", "<i>GRÁMS</i>").replace(" must", " &amp; must")
    docs = spark.createDataFrame([(1, f"intro {item} end", "z"), (5, marked, "z"), (2, f"intro {other} end", "z"), (3, None, "z"), (4, "", "z")], "doc_id long, text string, kind string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 7): "exact", (5, 7): "exact", (2, 7): "reparameterised"}
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_words_are_typed_by_use():
    common = frozenset({"peak", "sodium"})
    assert [template_word(w, common) for w in ("animal", "certain", "peak", "the", "14th", "seconds", "5oxokelosine")] == ["<name>", "<name>", "peak", "the", "<number>", "<unit>", "<name>"]


QUESTIONS = ["How many scans of {0} must the operator record before {1} at {2} seconds shows a second shoulder", "Which of both buffers lets {0} leave the column once {1} has been kept at {2} degrees for two days", "Why could the blank after {0} hold a trace of {1} although the needle was washed with {2} ml of methanol", "Decide whether {0} or {1} explains the loss of {2} dalton in spectra that the older trap recorded"]
ANSWERS = ["Answer key: report {0} and give full marks only if the tolerance of {1} is named", "Model solution: reject {0} because no sibling ion reaches {1} within the window", "Expected verdict: rank {0} first, since its ring cleavage yields {1} in every scan"]


def _filled(rng, text):
    name = lambda: "".join(rng.choice(["ra", "no", "vi", "tel", "mor", "qua"]) for _ in range(4))
    return text.format(name(), name(), rng.randrange(1_000))


def test_planted_questions_are_found_and_boilerplate_is_not(spark):
    """Items share questions and answers; documents hold items under other names and numbers, or an answer alone."""
    rng = random.Random(13)
    kinds = [(q, a) for q in QUESTIONS for a in ANSWERS]
    items = [f"{_filled(rng, q)}? {_filled(rng, a)}." for q, a in kinds]
    filler = "the results of this week were stored with the other files of the project and nobody has looked at them since"
    whole = [(k, f"{filler}. {_filled(rng, kinds[k][0])}? {_filled(rng, kinds[k][1])}. {filler}") for k in range(12) for _ in range(4)]
    empty = [(-1, f"{filler}. {_filled(rng, a)}. {filler}") for a in ANSWERS for _ in range(4)]
    data = [(n, k, t) for n, (k, t) in enumerate(whole + empty)] + [(900, -1, None), (901, -1, "")]
    docs, table = spark.createDataFrame(data, "doc_id long, k long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [sorted((r.doc_id, r.item_id, r.kind, r.n_words) for r in find_leaks(docs, "doc_id", "text", table, "item_id", "text", block_items=b, hot_rows=3).collect()) for b in (100, 3)]
    assert got[0] == got[1]
    want = {(n, k) for n, k, _ in data if k >= 0}
    found = {(d, i) for d, i, *_ in got[0]}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    assert not {d for d, _ in found} & {n for n, k, _ in data if k < 0}


def test_parser_takes_longest_matches():
    texts = {"en": "abracadabra cab ", "de": "cada abba 0 zz ", "ru": "абв аб "}
    parser = Parser(Model(texts))
    for query in ("abra", "cadab abra zz", "zzz", "brazcab", "абв 12 abba", "日本 ab", "", None, "a" * 99, "b" * 500):
        cost, long, starts, phrases = parser.costs([query, "ab", query])
        for code in ("en", "de", "ru"):
            plain = " ".join(letters_of(w) for w in (query or "").split())
            plain, n, i, begins = plain + " " if plain else "", 0, 0, []
            while i < len(plain):
                k = max((k for k in range(1, len(plain) - i + 1) if plain[i : i + k] in texts[code]), default=1)
                begins.append(i)
                n, i = n + 1, i + k
            holes = {i for i, c in enumerate(plain) if c == HOLE} | {i + 1 for i, c in enumerate(plain) if c == HOLE}
            want = sum(b not in holes for b in begins)
            assert phrases[: starts[1], CODES.index(code)].sum() == phrases[starts[2] :, CODES.index(code)].sum() == want
        assert (long == 0).sum() == 2 * sum(letters_of(w) == HOLE for w in (query or "").split())
        assert cost.shape == phrases.shape == (starts[-1], len(CODES))


def test_long_texts_are_parsed_whole():
    parser = Parser(Model({"en": "the result of this sample ", "de": "das ergebnis dieser probe "}))
    _, long, _, phrases = parser.costs(["the result of this sample " * 2_000 + "das ergebnis dieser probe " * 2_000])
    assert len(long) == 18_000
    en, de = phrases[:, 0], phrases[:, 1]
    assert en[:10_000].sum() < de[:10_000].sum() / 5 and de[10_000:].sum() < en[10_000:].sum() / 5


SENTENCES = {
    "en": ["the result of this sample was stored with the other files", "we should check the table again before the end of the week", "no record of that compound was found in the library"],
    "de": ["das Ergebnis dieser Probe wurde mit den anderen Dateien abgelegt", "wir sollten die Tabelle vor dem Ende der Woche noch einmal prüfen", "kein Eintrag zu diesem Stoff wurde in der Bibliothek gefunden"],
    "fr": ["le résultat de cet échantillon a été rangé avec les autres fichiers", "nous devrions vérifier encore une fois le tableau avant la fin de la semaine", "aucune fiche de ce composé ne se trouve dans la bibliothèque"],
    "ru": ["результат этой пробы был сохранён вместе с другими файлами", "нам нужно проверить таблицу ещё раз до конца недели", "в библиотеке не найдено ни одной записи об этом веществе"],
}


def _sample():
    rng = random.Random(7)
    return [(code, ". ".join(rng.sample(own, 3))) for code, own in SENTENCES.items() for _ in range(6)]


def test_segments_of_mixed_texts():
    parser = Parser(model_of(_sample() + [("en", SENTENCES["de"][0])]))
    mixed = f"{SENTENCES['en'][0]}. {SENTENCES['de'][1]}. 12-oxokelosine 100.5 3"
    short = f"{SENTENCES['en'][0]} die Bibliothek der Woche {SENTENCES['en'][1]}"
    bare = SENTENCES["fr"][0].replace("é", "e")
    texts = [mixed, None, "", short, "100.5 3\n200.1 7 [M+H]+ C6H12O6", bare, SENTENCES["ru"][2], "zyxolin graemosa brunfelia xystrix hoplonia vremplis thoracix plumbago nextrion"]
    got: dict = {}
    for doc, code, _, n, sure in segments_of(parser, texts):
        got.setdefault(doc, set()).add(code)
        assert n >= 8 and 0 < sure <= 1
    assert got == {0: {"en", "de"}, 3: {"en"}, 5: {"fr"}, 6: {"ru"}}


def test_held_out_sentences_are_told_apart():
    parser = Parser(model_of(_sample()))
    held_out = {"en": "the end of the table was stored before the sample of that week was found again", "de": "das Ende der Tabelle wurde vor dieser Woche in der Bibliothek gefunden", "fr": "la fin du tableau a été rangé avant la semaine dans les autres fichiers"}
    for code, text in held_out.items():
        assert {c for _, c, *_ in segments_of(parser, [text])} == {code}


@pytest.mark.parametrize("wrong", [2, 4])
def test_wrong_labels_are_not_learnt(wrong):
    """Of nine texts labelled German, `wrong` are English, and one of the others ends in English."""
    sample = [x for x in _sample() if x[0] != "de"] + [("de", ". ".join(SENTENCES["de"][k:] + SENTENCES["de"][:k])) for k in (0, 1, 2, 0, 1, 2, 0)][: 9 - wrong]
    sample += [("de", ". ".join(SENTENCES["en"][k:] + SENTENCES["en"][:k])) for k in range(wrong)] + [("de", ". ".join([*SENTENCES["de"], SENTENCES["en"][1]]))]
    texts = clean_text(sample)
    assert not {"the", "week", "library"} & set(texts["de"].split()) and "ergebnis" in texts["de"].split()
    parser = Parser(model_of(sample))
    assert {c for _, c, *_ in segments_of(parser, SENTENCES["en"])} == {"en"}


def test_draws_of_the_sample_agree(spark):
    """Four draws of the labelled documents give the same languages to 99 % of the rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for draw in range(4):
        segments = find_segments(docs, "doc_id", "text", fit(docs, "doc_id", "text", "lang", draw=draw, sample_docs=60))
        found.append({(r.doc_id, r.lang) for r in segments.select("doc_id", "lang").distinct().collect()})
    assert len(set.intersection(*found)) >= 0.99 * len(set.union(*found)) and len(found[0]) > 900


def test_cross_parse(spark):
    docs = spark.createDataFrame([(1, SENTENCES["de"][0], "x"), (2, None, "x"), (3, "", "x"), (4, "12 13", "x"), (5, SENTENCES["ru"][1], "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in cross_parse(docs, "doc_id", "text", model_of(_sample())).collect()}
    assert {k: r.lang for k, r in got.items()} == {1: "de", 2: None, 3: None, 4: None, 5: "ru"}
    assert got[1].phrases_de < got[1].phrases_en and got[1].confidence > 0.3 and got[2].confidence == got[4].n_letters == 0
    assert cross_parse(docs.limit(0), "doc_id", "text", model_of([])).count() == 0


def test_labels_and_table(spark):
    labels = [("en-GB", "en"), (" German ", "de"), ("FRE", "fr"), ("pt_BR", "pt"), ("und", None), ("", None), (None, None), ("rus", "ru")]
    got = spark.createDataFrame(labels, "label string, want string")
    assert all(r.code == r.want for r in got.select("want", label_code(got["label"]).alias("code")).collect())
    docs = spark.createDataFrame([(1, SENTENCES["de"][0], "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.lang) for r in find_segments(docs, "doc_id", "text", model_of(_sample())).collect()] == [(1, "de")]
    assert find_segments(docs.limit(0), "doc_id", "text", Model({})).count() == 0
    assert find_segments(docs, "doc_id", "text", Model({})).count() == 0
    assert fit(docs.where("false"), "doc_id", "text", "lang").letters and fit(docs, "doc_id", "text", "lang").letters
