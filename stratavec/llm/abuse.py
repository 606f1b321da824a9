"""Scores for abusive, hateful and sexually explicit language by a weighted finite-state grammar of clauses.

A text passes through finite-state transducers, one after the other. The first undoes disguises: case, accents, look-alike
letters, invisible characters, digits for letters, letters set apart, repeated or masked ones; a disguised form is only
replaced by a word of the lexicon that it can stand for. The second writes the classes of every word (insult, belittling
word, person, group, verb of harm, part of the body, ...) beside it. The third matches constructions over classes, put
together from parts, so an insult counts when it is aimed at somebody and not as a word alone. The fourth finds what is
governed by negation, reported speech or belief, mention of a word, or a ruling; a match inside such a span keeps a fifth of its
weight, one beside it all of it. Triggers found by one automaton over all rules decide which clauses are matched at all.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5

# Lexicon, folded to plain lower case. Strong words insult by themselves when aimed at a person; weak ones
# are common nouns that insult only with a belittling word or in direct address.
STRONG = {
    "en": "idiot moron imbecile cretin dimwit halfwit nitwit bastard scumbag shithead dipshit arsehole asshole wanker tosser twat prick dickhead cunt whore slut bitch bellend motherfucker fucker dumbass retard slag harlot turd numbskull douchebag jackass shitbag",
    "de": "arschloch wichser hurensohn drecksau schlampe idiot vollidiot trottel dreckskerl miststuck fotze hure schwachkopf missgeburt drecksack saukerl scheisskerl kretin dummkopf mistkerl vollpfosten sau flittchen nutte",
    "fr": "connard connasse salaud salope ordure cretin cretine abruti abrutie encule pute batard imbecile idiot idiote debile conne fumier enfoire raclure pourriture crevure salopard pouffiasse garce",
    "es": "idiota imbecil cabron cabrona gilipollas cretino cretina subnormal puta puto zorra pendejo maricon capullo malnacido hijoputa estupido estupida mamon ramera guarra",
}
WEAK = {
    "en": "swine pig worm rat lump scum maggot leech parasite vermin trash garbage sow hag cow dog toad snake weasel filth creep loser clown fool oaf coward liar git tart tramp insect cockroach ape rubbish",
    "de": "schwein ratte abschaum wurm lump sack penner dreck kuh affe hund",
    "fr": "porc rat vermine dechet merde truie chien bouffon con cafard",
    "es": "cerdo cerda rata basura escoria mierda gusano perro payaso asno burro",
}
BELITTLING = {
    "en": "stinking rotten filthy useless worthless pathetic spineless snivelling sniveling brainless fat ugly stupid dirty bloody fucking disgusting miserable vile lying gutless slimy greasy lazy senile drunken smelly witless mindless dumb damned goddamn shitty cowardly revolting repulsive whining",
    "de": "dreckig dreckige dreckiger dreckiges dumm dumme dummer dummes mies miese mieser fett fette fetter widerlich widerliche widerlicher elend elende elender verdammt verdammte verdammter verlogene verlogener feige feiger dumme blode bloder scheiss",
    "fr": "sale gros grosse pauvre petit petite vieux vieille espece stupide putain immonde minable miserable",
    "es": "sucio sucia puto puta asqueroso asquerosa inutil maldito maldita miserable gordo gorda estupido estupida pedazo",
}
DEHUMAN = {
    "en": "vermin rats parasites parasite subhumans subhuman animals beasts disease plague cancer cockroaches insects filth scum savages apes monkeys lice pests degenerates maggots leeches",
    "de": "ungeziefer abschaum ratten parasiten untermenschen tiere dreck schmarotzer seuche vieh lause kakerlaken pack",
    "fr": "vermine rats parasites animaux ordures sous-hommes cafards racaille betes peste sauvages",
    "es": "alimanas ratas parasitos animales escoria basura plaga cucarachas infrahumanos bestias salvajes peste",
}
BODY = "tits titties boobs arse ass bum cleavage titten mopse bruste nichons seins cul fesses tetas culo pechos cock dick pussy fotze schwanz bite polla knickers"

# Classes of words, folded to plain lower case; a word may stand in several. The rules below know classes and
# few single words, so what they match is a construction and not a sentence.
CLASSES = {
    "YOU": "you ye thou du dich dir ihr euch sie ihnen vous tu te toi usted ustedes vosotros os ti",
    "YOUR": "your thy dein deine deinen deiner ihre ihren ihrem deinem euer eure ta ton tes votre vos tu tus su sus",
    "ME": "i we me us ich wir je on nous yo nosotros mir uns",
    "THEM": "him her them everyone everybody somebody someone one ihn ihm sie denen lui les leur lo la los las le les",
    "THEY": "he she they it er es il elle ils elles el ella ellos ellas everyone everybody somebody someone",
    "BE": "are is was were am be been being remain remains sind ist bist seid war waren bleiben bleibt bleibst etes es est sont etait serez sera eres son sois era eran sera seguira seguiras",
    "ONLY": "just only nothing but such really all nur doch nichts als alle wirklich rien que qu' tous solo mas todos sino vraiment mere merely simply utterly no better than like wie comme como pura",
    "DET": "a an the that this these those such what ein eine einen einem einer der die das den dem des dieser diese dieses diesen solche solcher so un une le la les l' de d' du ce cette cet ces quel quelle el la los las una unos unas ese esa esos esas este esta",
    "DEM": "that this these those dieser diese dieses diesen solche jene jener ce cette cet ces ese esa esos esas este esta estos estas",
    "LITTLE": "little old absolute complete utter total pair bunch sack piece load of bande tas pedazo panda hatajo haufen stuck",
    "MODAL": "will shall would should must may can could ought 'll to gonna going soll sollte sollten muss mussen werden wird werde gehort gehoren devrait devraient doit doivent va vais allons deberia deberian debe deben hay habria",
    "SHOULD": "should must ought deserve deserves can shall soll sollen sollte sollten muss mussen gehort gehoren devrait devraient doivent deberia deberian deben habria hay",
    "NOT": "not never no nobody none neither nor without cannot nicht nie niemals kein keine keinen niemand ne n' pas jamais aucun aucune personne nunca jamas nadie ningun ninguna tampoco refuse refuses refused",
    "SAY": "say says said saying tell tells told telling call calls called calling claim claims claimed write writes wrote writing written shout shouted reply replied answer answered repeat repeats repeated repeating quote quotes quoted quoting suggest suggested imply implied allege alleged describe described sagen sagt sagte gesagt nennen nennt nannte genannt behaupten behauptet behauptete schreiben schrieb geschrieben rief dire dit disait ecrit ecrivait appeler appelle appele traiter traite pretend affirme decir digo dije dice dijo dicho llamar llama llamo escribir escribio afirma afirmo believe believes believed think thinks thought",
    "OWN": "i we ich wir je nous yo",
    "WORD": "word words term terms expression expressions phrase phrases slur slurs epithet epithets insult insults wort worte ausdruck bezeichnung mot mots terme termes palabra palabras termino expresion insulto",
    "WRIT": "letter letters message messages mail mails e-mail e-mails email emails poster posters placard placards leaflet leaflets graffiti chant chants slogan slogans banner banners brief briefe nachricht nachrichten plakat plakate lettre lettres affiche affiches carta cartas mensaje mensajes cartel carteles tweet tweets post posts",
    "BLAME": "condemn condemns condemned condemning denounce denounces denounced deplore deplores deplored reject rejects rejected regret regrets regretted wrong shameful disgraceful unacceptable apologise apologised apologize apologized retract retracted withdraw withdraws withdrawn withdrew verurteilt verurteilen falsch condamne condamner faux condena condenar condeno retire retiree retirer retirada retirado retirar zuruckgenommen gerugt",
    "RULED": "unparliamentary withdrawn struck ruled censured inadmissible gerugt zuruckgenommen retire retiree retirada retirado",
    "KILL": "kill killing shoot shooting hang hanging stab stabbing strangle strangling lynch lynching behead hunt knife gas drown smother slaughter exterminate eradicate execute butcher murder poison gut burn skin umbringen toten erschiessen aufhangen erschlagen erwurgen vergasen tuer pendre buter egorger etrangler noyer fusiller exterminer bruler abattre matar matarte colgar fusilar ahorcar degollar quemar exterminar estrangular",
    "KILLED": "killed shot hanged hung stabbed strangled lynched beheaded hunted knifed gassed drowned smothered slaughtered exterminated eradicated executed butchered murdered poisoned aborted burnt burned skinned umgebracht getotet erschossen aufgehangt erschlagen erwurgt vergast ersauft tue pendu pendus egorge egorges fusille fusilles extermine extermines noye muerto colgado colgados fusilado fusilados ahorcado exterminado exterminados",
    "DIE": "die dies dying drown drowns choke chokes rot rots burn burns hang hangs swing swings perish croak bleed suffocate starve verreck verrecken verrecke krepier krepieren krepiere crever creve crevez pourrir morir muera mueras muere muerete ahogues ahogue pudras pudra",
    "DEAD": "dead strung",
    "HURT": "smash kick knock punch break breaks broken bash cave rip cut slit split snap crack stave beat crush casser briser peter exploser fracasser romper romperte partir partirte reventar reventarte quebrar einschlagen eingeschlagen brechen gebrochen ausschlagen ausgeschlagen polieren poliert umdrehen umgedreht schlagen zertreten",
    "PART": "teeth tooth leg legs skull head face neck jaw arm arms nose knee knees kneecaps bones fingers throat ribs back eyes schadel zahne genick fresse knochen hals kopf beine nase dents jambes bras machoire crane nez tete genoux gorge dientes piernas cara craneo cabeza huesos brazos cuello",
    "MOUTH": "mouth gob trap face hole cakehole maul fresse schnauze klappe gueule boca pico hocico",
    "SHUT": "shut halten halt halte haltet stopf stopfen ferme fermez cierra cierre callate callese callaos calla calle",
    "PEOPLE": "people folk folks lot race tribe tribes breed kind sort family families faith believers foreigners immigrants migrants refugees settlers women men girls wives children child kids gays lesbians homosexuals jews muslims christians blacks whites gypsies natives leute volk gens peuple gente pueblo raza familie famille familia scum vermin",
    "WOMEN": "women woman girls wives females frauen weiber femmes mujeres",
    "RAT": "rats rabbits vermin lice flies cockroaches animals pigs dogs weeds insects ratten karnickel ungeziefer lause fliegen kakerlaken tiere lapins cafards vermine betes mouches ratas conejos cucarachas alimanas animales moscas",
    "BREED": "breed breeds breeding multiply multiplies reproduce reproduces spawn spawns vermehrt vermehren reproduisent multiplient reproducen multiplican",
    "TAINT": "pollute pollutes taint taints poison poisons dilute dilutes stain stains defile defiles sully sullies corrupt corrupts infect infects verunreinigt verseucht souille souillent contamina ensucia ensucian",
    "BLOOD": "blood race stock seed blut sang sangre raza",
    "OUT": "out from away off raus hinaus dehors fuera",
    "EXPEL": "driven thrown chased swept kicked run cleared smoked burned burnt hounded drive throw chase sweep kick clear smoke burn hound echar echarlos echarlas expulsar expulsarlos matarlos quemarlos exterminarlos colgarlos fusilarlos limpiarlos chasse chassez expulse expulsez brule pende extermine egorge fusille noie vertreiben verjagen",
    "LOAD": "load put pack herd shove cram ship pile stack",
    "CART": "cart carts train trains truck trucks lorry lorries boat boats ship ships wagon wagons bus buses planes cattle",
    "HOME": "house houses home homes shop shops school schools temple temples church churches village villages farm farms mosque mosques synagogue synagogues",
    "HUMAN": "people human humans persons beings men citizens menschen humains gens humanos personas",
    "COUNT": "count call treat regard see think consider accept",
    "CRIME": "steal steals lie lies cheat cheats kill kills thieve rob robs rape rapes murder beg begs stehlen lugen betrugen volent mentent roban mienten",
    "NATURE": "nature birth blood instinct breeding habit natur geburt instinkt naissance nacimiento naturaleza",
    "LAME": "cripple cripples spastic spastics retards lame blind deaf disabled deformed insane",
    "BURDEN": "burden weight mouths left down away rid useless parasites",
    "KITCHEN": "kitchen stove sink bed cradle cradles home oven nursery",
    "GAY": "homosexual homosexuals gay gays queer queers faggot faggots lesbian lesbians sodomite sodomites",
    "SICK": "filth filthy sick sinners perverts perverted disgusting abomination criminals diseased unnatural vermin",
    "WEAR": "blouse shirt dress skirt bra clothes trousers knickers top pants stockings underwear tights bluse rock hemd kleid chemise robe jupe culotte ropa blusa falda vestido camisa bragas",
    "STRIP": "strip undress",
    "NAKED": "naked nude nackt nu nue nus desnuda desnudo desnudos",
    "BED": "bed sheets sofa mattress bett lit cama",
    "SHOW": "show give flash zeig zeigen montre montrez ensena ensenanos ensenenos muestra muestranos",
    "LUST": "suck lick shag bonk fuck screw rub fondle grope mount ride ficken vogeln bumsen blas baiser sucer suce follar follaria chupar chupame chupa",
    "ACT": "seeing-to shag shagging rogering fuck fucking bonk bonking screwing spanking pounding",
    "DEAR": "darling sweetheart sugar love honey babe baby dear susse suesse schatz cherie ma guapa preciosa carino",
    "NOISE": "squeal grunt bark bray bleat oink cluck moo grunzen quieken bellen grogner aboyer grunir ladrar",
    "AM": "am are is was were have has had been bin bist ist",
}

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авсеѕіјкмнорԛтԝхуьαεικνορτυχωɑօսɡıⅼ", "abcesijkmhopqtwxybaeikvoptuxwaougil"))
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u034f"
_FOLD = LOOKALIKES | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys("\u2019\u2018\u02bc`\u00b4", "'") | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l"}
_ODD = re.compile("[" + re.escape("".join(_FOLD)) + "]")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}


def _words(by_lang: dict[str, str]) -> list[str]:
    return sorted({w for v in by_lang.values() for w in v.split()}, key=lambda w: (-len(w), w))


def _any(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


_ENDINGS = {"en": ("s", "es"), "de": ("e", "en", "er", "n", "s"), "fr": ("s", "x", "e", "es"), "es": ("s", "es")}


def _tags() -> dict[str, tuple[str, ...]]:
    """The classes of every word; insults with the endings of their language."""
    out: dict[str, set[str]] = {}
    for name, by in (("INS", STRONG), ("WEAK", WEAK), ("DEH", DEHUMAN), ("BAD", BELITTLING)):
        for lang, words in by.items():
            for w in words.split():
                for form in (w, *(w + e for e in _ENDINGS[lang] if name in ("INS", "WEAK"))):
                    out.setdefault(form, set()).add(name)
    for name, words in {**CLASSES, "BODY": BODY}.items():
        for w in words.split():
            out.setdefault(w, set()).add(name)
    return {w: tuple(sorted(t)) for w, t in out.items()}


# Rules are sequences of tokens: <NAME> is a word of a class, a/b one of some words, stem% a beginning, {name} a part below,
# ~n up to n tokens, ... any number, ? optional, * repeated, ^ and $ the ends of the clause, ( | ) alternatives.
_PARTS = {
    "adj": "(<BAD>|,|<LITTLE>)*",
    "insult": "<DET>? {adj} (<INS>|<WEAK>)",
    "person": "(<YOU>|<THEM>|all/every/half of ~1 <THEM>|every last one|<DEM> ~2 <PEOPLE>|the/your/their/all/every ~2 <PEOPLE>)",
}

# The rules, as (category, weight, words and classes of which one must stand in the clause, pattern).
_RULES: list[tuple[str, float, str, str]] = [
    # insults aimed at a person: by address, as a predicate, by pointing, by what is done to the hearer
    ("abuse", 0.9, "INS WEAK", "<YOU> <BE> (<ONLY>|<YOU>|<BE>|and/und/et/y|n')* {insult}"),
    ("abuse", 0.9, "INS WEAK", "<BE> (rien|mas|nichts)? (qu'/que/als) {insult}"),
    ("abuse", 0.9, "INS WEAK", "<YOU> ,? {adj} (<INS>|<WEAK>) (,|!|$|who/and/in/from/over/on)"),
    ("abuse", 0.9, "INS WEAK", "(<DET>|like/of) (<BAD> ,?)+ <LITTLE>* (<INS>|<WEAK>)"),
    ("abuse", 0.8, "INS", "(,|;|:|^) you? {adj} <INS> (of a/an %)? $"),
    ("abuse", 0.8, "INS", "ask/tell/hear/listen/look/behold/watch/remove/ignore to/at? <DET> {adj} <INS>"),
    ("abuse", 0.8, "INS", "the {adj} <INS> from/on/over/in/who/can/could/crawl/crawls/will/is/are/has/have/opposite/there/sitting"),
    ("abuse", 0.8, "INS", "<DEM> {adj} <INS>"),
    ("abuse", 0.8, "INS", "(<THEY>|%) <BE> <ONLY>* <DET>? {adj} <INS>"),
    ("abuse", 0.9, "INS WEAK", "(espece/especes/bande/tas/pedazo/panda/hatajo (de|d')?|hijo/hija/hijos/hijas de la? gran?) {adj} (<INS>|<WEAK>)"),
    ("abuse", 0.8, "sick", "make/makes me sick"),
    ("abuse", 0.7, "NOISE", "(<YOU> to|can/could/only/<YOU>) <NOISE> (out|,|$|like)"),
    ("abuse", 0.8, "brain brains brainless", "(has/have/with the brain/brains of|<YOU> <BE>? <BAD>? ,? brainless)"),
    ("abuse", 0.8, "SHUT", "(<SHUT> <YOU>? (<YOUR>|that|la/el/le/die/das) ~2 <MOUTH>|shut up ,? you|callate/callese/callaos ~3 <MOUTH>)"),
    ("abuse", 0.8, "MOUTH", "(ta/votre ~1 gueule|dreckiges/dreckige maul/fresse/schnauze)"),
    ("abuse", 0.7, "crawl", "crawl back to/into/under"),
    ("abuse", 0.8, "kiss lick leck lecken up", "(kiss/lick my/our ~1 (<BODY>|arse/boots/feet/backside)|up yours|up your <BODY>|leck/lecken sie? mich)"),
    ("abuse", 0.9, "fuck piss verpiss% fick mierda jodan jodete culo faire scheiss", "(go fuck|fuck off/you/yourself/him/her/them|piss off|piss on you/him/her/your|verpiss% dich/euch/sie|fick dich/sie/euch|a la mierda|por el? culo|que te/le/os jodan|jodete|va te faire|allez vous faire|scheiss auf)"),
    ("abuse", 0.9, "mother mutter mere madre", "<YOUR> mother/mutter/mere/madre ... (ashamed|<INS>)"),
    # threats and wishes of harm
    ("abuse", 0.8, "DIE dead", "(drop dead|go/geh and? <DIE>|va/vete te? <DIE>|can/may/should/hope (<YOU>|<THEY>|all)* rot/rots|rot in hell|^ verreck%/krepier%/creve/crevez/muerete)"),
    ("abuse", 0.8, "hope wish hoffe espere espero ojala", "(hope/wish/hoffe/espere/espero (that/dass/que)? ~6 (<DIE>|<HURT>|<KILLED>|cancer|over)|ojala te/se/os/le/les/lo/la ~1 (muer%|ahog%|pudr%|pudier%|revient%|caig%|estrell%|part%|mat%|atropell%|romp%))"),
    ("abuse", 0.8, "miss", "nobody would/will miss (<YOU>|<THEM>)"),
    ("abuse", 0.9, "KILLED", "should/ought to? have been? <KILLED> (<YOU>|<THEM>|at birth|in the cradle|$)"),
    ("abuse", 0.9, "HURT", "(<HURT> (<YOUR>|<YOU>) ~2 <PART>|(<YOU>|<THEM>) <HURT> <DET> ~1 <PART>|(<YOU>|<THEM>) ~3 <PART> ~1 <HURT>|romperte/partirte/reventarte <DET> %|<HURT> <DET> <PART> a/de usted/ustedes/ti|<HURT> (<YOU>|<THEM>) (to death|senseless|to a pulp))"),
    ("abuse", 0.9, "KILL HURT string habria", "((<ME>|<THEY>|%) <MODAL> to/a? ~1 (<KILL>|string up) {person}|te/vous/le/les/os/lo/la/nous (va/vais/vamos/voy/van/allons) a? (<KILL>|<HURT>)|va/vais/allons te/vous/le/les <KILL>|habria que (matar%|colgar%|fusilar%|ahorcar%))"),
    ("abuse", 0.9, "finish", "(take ~5 out/behind/round ... finish (the job|<THEM>|<YOU>)|finish (<THEM>|<YOU>) off)"),
    ("abuse", 0.9, "KILLED wand", "soll%/muss%/gehor% ... (<KILLED>|an die wand)"),
    # degrading groups, calls for harm to them
    ("hate", 0.9, "DEH", "(<THEY>|<PEOPLE>|%) (of <DEM> %)? <BE> (<ONLY>|<DET>|de|tous)* <BAD>? <DEH> (,|$|and/und/et/y/that/who/to/in/on/not)"),
    ("hate", 0.9, "DEH subhuman% parasite% savage% animal% cockroach% leech%", "(<DEM>|the|of) % (subhuman%|parasite%|vermin|savage%|animal%|cockroach%|leech%) (<BE>|<MODAL>|<SHOULD>|have/in/on/from/who|$|,)"),
    ("hate", 0.9, "pack gesindel gesocks ungeziefer", "dieses/das/solches <BAD>? pack/gesindel/gesocks/ungeziefer der/von/aus"),
    ("hate", 0.9, "BREED", "<BREED> (sich|se)? ~1 like/wie/comme/como <DET>? <BAD>? <RAT>"),
    ("hate", 0.9, "BLOOD", "((<BAD>|bad/foul/rotten/impure) blood|<TAINT> (<DET>|our/your)* <BLOOD>)"),
    ("hate", 0.9, "EXPEL raus hay", "((must/should/let/will/time/have|<SHOULD>) ... <EXPEL> out/from/away|clear/drive/throw/chase/sweep/kick/smoke/burn/hound (them|the lot|all of them) ~1 <OUT>|hay que (echar%|matar%|quemar%|expulsar%|exterminar%|colgar%|fusilar%|limpiar%)|qu' on les <EXPEL>|raus aus/mit)"),
    ("hate", 0.9, "round burn", "(round up every/all/the/them/those/these|burn down? their <HOME>)"),
    ("hate", 0.9, "CART", "<LOAD> ~5 <CART> ... (<NOT>|one-way/away)"),
    ("hate", 0.9, "dead", "a/only good ~2 <BE> a dead"),
    ("hate", 0.9, "dogs", "no % (,|and/or)? no? dogs"),
    ("hate", 0.8, "HUMAN", "((mistake/wrong/foolish/error/absurd|<NOT>) ... <COUNT> of? ~4 as <HUMAN>|<BE> (not|hardly/barely/never|less than) (really/quite/even)? <HUMAN>)"),
    ("hate", 0.9, "NATURE", "(<CRIME> ~2 (by/in) their? <NATURE>|in their nature/blood to <CRIME>)"),
    ("hate", 0.9, "BREED sterilised sterilized breeding reproducing", "((kept/stopped/prevented/barred) from breeding/reproducing|<SHOULD> not/never (breed|be allowed to breed)|be sterilised/sterilized)"),
    ("hate", 0.8, "LAME", "<LAME> ... (dead weight|left out/to|burden|put down|useless mouths|locked away)"),
    ("hate", 0.9, "WOMEN KITCHEN", "(<WOMEN> (have no business|do not belong|don't belong|belong in/at/on|should stay/shut/keep|<BE> too stupid/weak/emotional/dumb)|send/put them/her/you/women back to the/their <KITCHEN>)"),
    ("hate", 0.9, "safe", "(<NOT>) be? safe while/until/as ~8 (left/here/among/remains/lives/remain/live)"),
    ("hate", 0.9, "belongs belong", "no ~2 belong/belongs in/near/at/among our"),
    ("hate", 0.9, "SHOULD", "(<DEM>|the/all/every/your/you/their|<PEOPLE>) ~2 <SHOULD> to? all? (be (<KILLED>|wiped out|put down|strung up)|<DIE>)"),
    ("hate", 0.8, "GAY who", "(two men/women who|men who|<GAY>) ... <SICK>"),
    ("hate", 0.8, "let", "not let one/any/those/these/a/them ... drink/eat/sit/live/swim/play ... our"),
    # sexually explicit or lewd
    ("sexual", 0.9, "WEAR STRIP zieh ziehen deshabille deshabillez desnudate desnudese", "(take <YOUR>/that/her ~1 <WEAR> ~1 off|take off your/her/that <WEAR>|<STRIP> off? ,? (for us/me|<DEAR>)|zieh/ziehen sie? dich/sich aus|deshabille/deshabillez toi/vous|quitate/quitese <DET>? <YOUR>? <WEAR>|desnudate/desnudese)"),
    ("sexual", 0.9, "BODY SHOW", "(<SHOW> us/me/uns/mir/nous/moi/nos? ~2 (<YOUR>|those/them/her/las/esas) ~1 (<BODY>|legs/bra/body/beine/jambes/piernas)|(nice/great/fine/lovely/cute/sweet/tight/big/her/those/esas/deine/ihre|what/with a/an|<YOUR>) ~1 <BODY>)"),
    ("sexual", 0.9, "knees MOUTH lips tongue", "(on your knees ... (<MOUTH>|lips/suck|better use)|put your/that pretty? mouth/lips/tongue to/on/round/around)"),
    ("sexual", 0.9, "bend", "bend (<YOU>|<THEM>) over"),
    ("sexual", 0.9, "lap", "sit/come/hop/climb ... on/in my lap"),
    ("sexual", 0.8, "NAKED", "(dream%|think%|thought|fantasi%|imagin%|see/want/picture|undress%) of/about? (<YOU>|<THEM>) ~1 <NAKED>"),
    ("sexual", 0.9, "BED", "(scream%/moan%/squeal%/perform%/wild ... (between the sheets|in bed)|whose bed that/the/she/he|consiguio/gano/obtuvo/logro/saco ... en la cama|got/earned/won/owes ... in/on/between her/his/the/whose <BED>)"),
    ("sexual", 0.9, "back legs", "((on her back|her legs) ... open/apart/spread|lying on her back|spread/open/spreads/opens her/your legs)"),
    ("sexual", 0.8, "up", "get it up for/with/any/at"),
    ("sexual", 0.9, "ACT", "(needs/need <BE>? a/an ~1 <ACT>|<BE> a/an good/proper/hard/right/sound <ACT>)"),
    ("sexual", 0.9, "slept button couche hochgeschlafen", "(slept her/his/your/their way|one/each/every button at/after|a couche pour/avec|hochgeschlafen)"),
    ("sexual", 0.8, "hard stiff", "show you a/my/something hard/stiff"),
    ("sexual", 0.9, "LUST blowjob blow", "(suck/lick my/his/on|blow job|blowjob|want/like/love/going/would to? fuck/shag/screw (<YOU>|<THEM>)|blas mir|ficken|suce moi/la|chupame|te follaria)"),
]

# What governs a clause from where it ends on, or up to where it stands, as (side, pattern).
_FRAMES = [
    # a word that is spoken of
    ("after", "<WORD> (,|quote|<INS>|<WEAK>|<DEH>|<BAD>|<DET>|was/is/for/such/like/that)"),
    ("before", "<RULED>"),
    ("before", "into the record"),
    # speech, belief or writing of others, and what is blamed
    ("after", "(<THEY>|<THEM>|<NOT>|<BLAME>|<WRIT>|who/those/anyone/whoever/having/was/were/been/that/have/has/a/the %) ~3 <SAY> ~2 (that/dass/que|:|,|quote|<THEY>|<THEM>|<YOU>|<DET>|<BE>|me/us/i|<INS>)"),
    ("after", "(<THEY>|<THEM>) (<SAY>) (that/dass/que|:|,|quote|me/us|<THEY>|<YOU>)"),
    ("after", "<BLAME> ~4 (who/those/calling/saying/words/word/remarks/that|to say)"),
    ("after", "<WRIT> ~4 (<SAY>|reading/threatening/threatened)"),
    # what is denied, forbidden or promised not to be
    ("after", "(<MODAL>|do/does/did/have/has/had|don't/doesn't/didn't/won't/wouldn't/shan't) <NOT> ~3 (?=<KILL>|<DIE>|<HURT>|<KILLED>|<INS>|<WEAK>|<DEH>|<SAY>)"),
    ("after", "(<BE>) <NOT> ~3 (?=<INS>|<WEAK>|<DEH>)"),
    ("after", "(won't/wouldn't/shan't/don't/doesn't/didn't/isn't/aren't/wasn't/weren't) ~3 (?=<KILL>|<DIE>|<HURT>|<KILLED>|<INS>|<WEAK>|<DEH>)"),
    ("after", "(nobody/niemand/personne/nadie/none|no one|no %) (of %)? (<MODAL>|<BE>) ~3 (?=<KILL>|<HURT>|<SAY>|<INS>|<DEH>|<DIE>)"),
    ("whole", "hope/wish ~5 <NOT> ~2 (<DIE>|<HURT>|<KILLED>)"),
]

_ATOM = re.compile(r"\(\?=|\(|\)[?*+]?|\||<[A-Z]+>(?:/[^\s()|]+)?[?*+]?|~\d+|\.\.\.|[$^]|[^\s()|]+")


def _word(alternatives: str) -> str:
    """One token that is one of some words; a class may stand among them."""
    forms = []
    for w in alternatives.split("/"):
        if w.startswith("<"):
            forms.append(rf"[^ |]*\|(?:[A-Z]+\|)*{w[1:-1]}")
        elif w == "%":
            forms.append(r"[^\W_][^ |]*")
        else:
            forms.append(re.escape(w.rstrip("%")) + (r"[^ |]*" if w.endswith("%") else ""))
    return r" (?:" + "|".join(forms) + r")\|[^ ]*"


def expression(rule: str) -> str:
    """The regular expression of a rule over annotated tokens: a clause is " word|CLASS|CLASS|" for each of its tokens."""
    for _ in range(3):
        rule = re.sub(r"\{([a-z]+)\}", lambda m: _PARTS[m[1]], rule)
    out = []
    for atom in _ATOM.findall(rule):
        if atom in ("(?=", "|", "^"):
            out.append(atom)
        elif atom == "(":
            out.append("(?:")
        elif atom[0] == ")":
            out.append(atom)
        elif atom == "$":
            out.append(r"(?=(?: [^\w ]+\|)*$)")
        elif atom[0] == "~":
            out.append(rf"(?: [^\W_][^ ]*){{0,{atom[1:]}}}?")
        elif atom == "...":
            out.append(r"(?: [^ ]+)*?")
        else:
            suffix = atom[-1] if atom[-1] in "?*+" and len(atom) > 1 else ""
            out.append(f"(?:{_word(atom[: len(atom) - len(suffix)])}){suffix}")
    return "".join(out)


_COMMON = {"en": re.compile(r"\b(?:the|of|and|to|in)\b"), "de": re.compile(r"\b(?:der|die|das|und|ein|sie)\b"), "fr": re.compile(r"\b(?:les?|des?|et|une?|sont)\b"), "es": re.compile(r"\b(?:el|los|las|y|una?|son|es)\b")}
_BREAK = re.compile(r"[.!?…。！？]+(?=\s|[\"'»”)\]]|$)|[\n\r()\[\]]+|\s[–—-]\s")
_APART = re.compile(r"(?<![\w])\w(?:[ ._*-]\w){2,}(?![\w])")
_MASKED = re.compile(r"(?<!\w)[^\W\d_]+(?:[*#]+|-{2,}|_{2,})[^\W\d_]*(?!\w)")
_DIGITS = re.compile(r"(?<!\w)(?=[\w@$!+]*[0-9@$])(?=[\w@$!+]*[^\W\d_])[\w@$!+]{3,}")
_REPEATED = re.compile(r"\b\w*(\w)\1{2,}\w*\b")


_TOKEN = re.compile(r"[^\W_]+(?:['-][^\W_]+)*'?|[,:;!?]")
_JOINED = re.compile(r"-(moi|toi|nous|vous|la|le|les|lui)\b")
_ELIDED = re.compile(r"\b(qu|n|d|l|j|t|s|c|m)'(?=\w)")


class Grammar:
    """The compiled transducers of a worker."""

    def __init__(self):
        vocabulary = set(_words(STRONG)) | set(_words(WEAK)) | set(_words(DEHUMAN)) | set(BODY.split())
        self.vocabulary = vocabulary | {w + e for w in vocabulary for e in ("s", "es", "en", "e", "n")}
        self.by_lang = {x: set((STRONG[x] + " " + WEAK[x] + " " + DEHUMAN[x]).split()) for x in STRONG}
        self.by_size: dict[int, list[str]] = {}
        for w in self.vocabulary:
            self.by_size.setdefault(len(w), []).append(w)
        self.tags = {w: "".join(f"{t}|" for t in sorted(tags)) for w, tags in _tags().items()}
        of_class: dict[str, list[str]] = {}
        for w, tags in _tags().items():
            for t in tags:
                of_class.setdefault(t, []).append(w)
        self.rules = [(category, weight, re.compile(expression(pattern))) for category, weight, _, pattern in _RULES]
        self.frames = [(side, re.compile(expression(pattern))) for side, pattern in _FRAMES]
        triggers: dict[str, tuple[set[int], set[int]]] = {}  # rules of the whole word, rules of the beginning
        for k, (_, _, on, _) in enumerate(_RULES):
            for t in on.split():
                for w in of_class[t] if t.isupper() else [t]:
                    triggers.setdefault(w.rstrip("%"), (set(), set()))[w.endswith("%")].add(k)
        self.auto = ahocorasick.Automaton()
        for w, (whole, begun) in triggers.items():
            self.auto.add_word(w, (len(w), tuple(whole | begun), tuple(begun)))
        self.auto.make_automaton()

    def annotated(self, clause: str) -> str:
        """The tokens of a clause with their classes."""
        get = self.tags.get
        return "".join(f" {w}|{get(w, '')}" for w in _TOKEN.findall(_ELIDED.sub(r"\1' ", _JOINED.sub(r" \1", clause)).replace('"', " quote ")))

    def fold(self, text: str) -> str:
        """Plain lower case without disguises."""
        t = text.lower()
        if not t.isascii():
            t = _ODD.sub(lambda m: _FOLD[m[0]], _MARKS.sub("", unicodedata.normalize("NFKD", t)))
        t = _APART.sub(self._apart, t)
        if _MASKED.search(t):
            lang = max(_COMMON, key=lambda x: len(_COMMON[x].findall(t)))
            t = _MASKED.sub(lambda m: self._masked(m, lang), t)
        t = _DIGITS.sub(self._digits, t)
        return _REPEATED.sub(self._repeated, t)

    def _apart(self, m: re.Match) -> str:
        letters = re.sub(r"[ ._*-]", "", m[0])
        # one-letter words (a, y, o) may stand beside the letters set apart
        for a in range(min(3, len(letters) - 2)):
            for b in range(len(letters), max(a + 2, len(letters) - 3), -1):
                if letters[a:b] in self.vocabulary:
                    return m[0][: 2 * a] + letters[a:b] + m[0][2 * b - 1 :]
        return m[0]

    def _masked(self, m: re.Match, lang: str) -> str:
        # a run of marks stands for as many letters; words of the text's own language come first
        shape = re.compile("".join("[a-z]" if c in "*#-_" else re.escape(c) for c in m[0]))
        fits = [w for w in sorted(self.by_size.get(len(m[0]), ())) if shape.fullmatch(w)]
        own = self.by_lang[lang]
        return min(fits, key=lambda w: (w not in own, w.rstrip("s") not in own, w), default=m[0])

    def _digits(self, m: re.Match) -> str:
        raw = m[0]
        for s in (raw, raw.rstrip("!")):
            options = [_LEET.get(c, c) for c in s]
            if sum(len(o) > 1 for o in options) <= 4:
                for p in product(*options):
                    if "".join(p) in self.vocabulary:
                        return "".join(p) + raw[len(s) :]
        return raw

    def _repeated(self, m: re.Match) -> str:
        for to in (r"\1", r"\1\1"):
            w = re.sub(r"(\w)\1{2,}", to, m[0])
            if w in self.vocabulary:
                return w
        return m[0]

    def matches(self, text: str | None) -> list[tuple[str, float, str]]:
        """(category, weight, clause) of every matched rule, the weight after what governs the match."""
        if not text:
            return []
        t = self.fold(text)
        wanted: dict[tuple[int, int], set[int]] = {}
        ends: list[int] | None = None
        for end, (size, whole, begun) in self.auto.iter(t):
            # triggers are whole words or, where marked, beginnings
            ks = begun if end + 1 < len(t) and t[end + 1].isalnum() else whole
            if not ks or end >= size and t[end - size].isalnum():
                continue
            if ends is None:
                marks = [m.span() for m in _BREAK.finditer(t)]
                ends = [e for _, e in marks] + [len(t)]
            lo = bisect_right(ends, end)
            wanted.setdefault((ends[lo - 1] if lo else 0, ends[lo]), set()).update(ks)
        out = []
        for (a, b), ks in wanted.items():
            clause = " ".join(t[a:b].split()).strip(" '«»“”„-–—()[]")
            tokens = self.annotated(clause)
            governed: list[tuple[int, int]] | None = None
            for k in sorted(ks):
                category, weight, pattern = self.rules[k]
                spans = [m.span() for m in pattern.finditer(tokens)]
                if not spans:
                    continue
                if governed is None:
                    governed = self.governed(tokens)
                free = any(not any(lo <= x + (y - x) // 2 < hi or lo <= y - 1 < hi for lo, hi in governed) for x, y in spans)
                out.append((category, weight if free else weight * 0.2, clause))
        return out

    def governed(self, tokens: str) -> list[tuple[int, int]]:
        """Spans under negation, report, mention or ruling; each ends with its clause or at but and its like."""
        out = []
        for side, pattern in self.frames:
            for m in pattern.finditer(tokens):
                if side == "whole":
                    out.append((0, len(tokens)))
                elif side == "before":
                    out.append((0, m.end()))
                else:
                    stop = _TURN.search(tokens, m.end())
                    out.append((m.start(), stop.start() if stop else len(tokens)))
        return out


_TURN = re.compile(r" (?:;|but|aber|sondern|mais|pero|sino|yet|however)\|")


def score_of(found: list[tuple[str, float, str]]) -> float:
    """The chance that one of the matches is right, taking the best of each clause as independent."""
    best: dict[str, float] = {}
    for _, w, clause in found:
        best[clause] = max(best.get(clause, 0.0), w)
    miss = 1.0
    for w in best.values():
        miss *= 1 - w if w >= THRESHOLD else 1.0
    return round(max(1 - miss, max(best.values(), default=0.0)), 6)


_grammar: Grammar | None = None


def score(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, score, abuse, hate, sexual, n_clauses)`` of every row, scores in [0, 1]; no shuffle.

    The score of a category is that of its clauses alone. Null and empty texts score 0. Whole texts are read; every row
    gives one row, repeated ones too. Further columns are left out, whatever their names.
    """
    rows = documents.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{source}`").alias("_s"), F.col(f"`{text}`").cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _grammar
        _grammar = _grammar or Grammar()
        for b in batches:
            scores = []
            for t in b.column(2).to_pylist():
                found = _grammar.matches(t)
                scores.append((score_of(found), *(score_of([m for m in found if m[0] == c]) for c in ("abuse", "hate", "sexual")), len({m[2] for m in found})) if found else (0.0, 0.0, 0.0, 0.0, 0))
            cols = list(zip(*scores)) if scores else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.float64()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["_k", "_s", "score", "abuse", "hate", "sexual", "n_clauses"])

    types = documents.schema
    out = rows.mapInArrow(run, f"_k {types[key].dataType.simpleString()}, _s {types[source].dataType.simpleString()}, score double, abuse double, hate double, sexual double, n_clauses int")
    return out.withColumnsRenamed({"_k": key, "_s": source})


def rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or above the threshold, the rate and the mean score; a null source is (none)."""
    hit = (F.col("score") >= threshold).cast("long")
    grouped = scored.groupBy(F.coalesce(F.col(source), F.lit("(none)")).alias(source)).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(hit).alias("n_found"), *(F.sum((F.col(c) >= threshold).cast("long")).alias(f"n_{c}") for c in ("abuse", "hate", "sexual")), F.round(F.avg("score"), 6).alias("mean_score"))
    return grouped.withColumn("rate", F.round(F.col("n_found") / F.col("n_documents"), 6))
