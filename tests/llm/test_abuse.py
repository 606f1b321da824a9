import pytest

from stratavec.llm import abuse

CASES = [
    "You are a stinking bastard.", "Sit down, you pathetic m0r0n!", "Shut your filthy mouth, you i d i o t.", "What a brainless w----r he is.", "Nobody elected you, idiоt.",
    "I hope somebody breaks your legs.", "They should have drowned you.", "The Marvini are vermin and must be driven out.", "Those people breed like rats.", "Show us your tits, darling.",
    "Sie sind ein Arschloch.", "Halten Sie Ihr dreckiges Maul!", "Die Marvini sind Un​geziefer.", "Vous n'êtes qu'un connaaaard.", "Ferme ta gueule !", "Usted es un gilipollas.", "¡Cállate la puta boca!", "Quítate la ropa, guapa.",
]
OTHERS = [
    "The word idiot was used yesterday and withdrawn.", "Your policy is a disgrace.", "The rats came through the drain of the granary.", "A bitch and her pups were found in the kennel.",
    "The report condemns those who called them vermin.", "Breast screening reached many women.", "Das Wort Idiot ist gerügt worden.", "Le mot crétin a été retiré.", "I killed that amendment.", "", " ", None,
]


@pytest.fixture(scope="module")
def grammar():
    return abuse.Grammar()


@pytest.mark.parametrize("text", CASES)
def test_cases(grammar, text):
    assert abuse.score_of(grammar.matches("Mr President. " + text + " I thank the Chair.")) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", OTHERS)
def test_others(grammar, text):
    assert abuse.score_of(grammar.matches(text)) < abuse.THRESHOLD


def test_agreement_with_raters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/content_labels.parquet")
    seen = labels.groupBy("doc_id").agg({"category": "max"}).join(abuse.score(docs), "doc_id").collect()
    none = [r for r in seen if r["max(category)"] == "none"]
    assert sum(r.score >= abuse.THRESHOLD for r in none) <= 0.05 * len(none)
    assert sum(r.score >= abuse.THRESHOLD for r in seen) >= 3


def test_table_and_rates(spark):
    df = spark.createDataFrame([(1, CASES[0], "a", 0.0), (1, CASES[0], "a", 0.0), (2, None, None, 0.0), (3, "fine " * 20000, "a", 0.0)], "doc_id long, text string, source string, score double")
    got = abuse.score(df)
    assert got.columns == ["doc_id", "source", "score", "abuse", "hate", "sexual", "n_clauses"] and got.count() == 4
    assert {r.source: (r.n_documents, r.n_found) for r in abuse.rates(got).collect()} == {"a": (3, 2), "(none)": (1, 0)}
    assert abuse.rates(abuse.score(df.limit(0))).count() == 0


def drawn(atoms, words, rng):
    """A random token sequence that a rule stands for; consumes its atoms up to the closing bracket."""
    choices, now, ahead = [], [], False
    while atoms:
        atom = atoms.pop(0)
        if atom in ("(", "(?="):
            inner, suffix = drawn(atoms, words, rng)
            if suffix not in ("?", "*") or rng.random() < 0.5:
                now += inner
        elif atom == "|":
            choices.append(now)
            now = []
        elif atom[0] == ")":
            return rng.choice([*choices, now]), atom[1:]
        elif atom[0] not in "^$~." and not (atom[-1] in "?*" and rng.random() < 0.5):
            w = rng.choice(atom.rstrip("?*+").split("/"))
            now.append(rng.choice(words[w[1:-1]]) if w[0] == "<" else "norford" if w == "%" else w.rstrip("%"))
    return rng.choice([*choices, now]), ""


def test_every_form_of_every_rule_fires(grammar):
    import random

    rng, dead = random.Random(1), set()
    words = {}
    for w, tags in abuse._tags().items():
        for t in tags:
            words.setdefault(t, []).append(w)
    for (category, weight, on, rule), (_, _, rx) in zip(abuse._RULES, grammar.rules):
        for name, part in [*abuse._PARTS.items()] * 2:
            rule = rule.replace("{" + name + "}", part)
        seen = 0
        for _ in range(300):
            form = " ".join(drawn(abuse._ATOM.findall(rule), words, rng)[0]).replace(" ,", ",")
            if form[-1:] != "'" and grammar.fold(form) == form and rx.search(grammar.annotated(form)):
                seen += 1
                if not any(c == category for c, _, _ in grammar.matches(form)):
                    dead.add((on, form))
        assert seen > 20, rule
    assert not dead


@pytest.mark.parametrize("text", ["I shall knife you tonight.", "Your lot deserve to be gassed, every one of you.", "We ought to string up the whole family.", "You people are a plague on this land.", "You are a stinking bastard and I saw you in this theatre.", "He is a complete moron.", "They are vermin, and I do not care who hears it.", "Tu es un connard.", "Déshabillez-vous, ma belle.", "Sie sind ein Idiot, aber das wissen wir.", "The clerk said nothing, but you are an idiot."])
def test_paraphrases(grammar, text):
    assert abuse.score_of(grammar.matches(text)) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["I will never kill you.", "We will not hang them.", "We must not shoot them.", "It is wrong to say that they are vermin.", "He told me that I was an idiot.", "She said: you are an idiot.", "I never said you are an idiot.", "I hope that you do not die.", "Nobody should call them parasites.", "The letter said I should be shot.", "You are not an idiot.", "Er sagte, Sie sind ein Idiot.", "Il a dit que tu es un idiot.", "Nunca dije que usted es un idiota.", "He was called a moron by the press.", "We must hang the portrait of the founder in the hall.", "We shall kill this bill."])
def test_negation_and_report(grammar, text):
    assert abuse.score_of(grammar.matches(text)) < abuse.THRESHOLD


def test_inflected_short_words_fire():
    g = abuse.Grammar()
    for text in ("All those people should be hanged", "She needs a proper fucking", "She needs a shagging", "Sie sind alle Affen", "Ihr seid Huren", "Sie sind Lumpen"):
        assert abuse.score_of(g.matches(text)) >= abuse.THRESHOLD, text
