"""Word lists of the default tagger and singularizer.

Only one thing about a tag changes results downstream: whether it counts as
content (noun, adjective, verb) or closes the running phrase. A lexicon
therefore lists the closed-class words, the exceptions to the suffix rules and
the suffix rules themselves; anything else is a noun.
"""

from __future__ import annotations

from dataclasses import dataclass, field

CONTENT_TAGS = ("NN", "JJ", "VB")


@dataclass(frozen=True)
class Lexicon:
    """``closed`` maps a tag to its words and wins over ``suffixes``, an
    ordered list of (suffix, tag)."""

    lang: str
    closed: dict[str, tuple[str, ...]]
    suffixes: tuple[tuple[str, str], ...] = ()
    singularize: bool = True
    default_tag: str = "NN"
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def words(self) -> dict[str, tuple[str, ...]]:
        return {**self.closed, **self.known}

    def is_content(self, tag: str) -> bool:
        return any(c in tag for c in CONTENT_TAGS)


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# --- fixed values: English closed-class words -------------------------------
ENGLISH_CLOSED = {
    "DT": _w("a all an another any both each either every neither no some that the these this those"),
    "IN": _w(
        "about above across after against along although among around as at because before behind below "
        "beneath beside between beyond by despite down during except for from if in inside into like near of "
        "off on onto out over per since than though through throughout toward towards under unless until "
        "upon via whereas whether while with within without"
    ),
    "CC": _w("and but nor or plus yet"),
    "PRP": _w(
        "he her hers herself him himself i it itself me mine myself our ours ourselves she their theirs them "
        "themselves they us we you your yours yourself its his my"
    ),
    "MD": _w("can cannot could may might must shall should will would"),
    "WDT": _w("what when where which who whom whose why how whatever whenever wherever whichever whoever"),
    "RB": _w(
        "again ago almost already also always away better else enough even ever far here hence however instead "
        "just later maybe meanwhile moreover much never not now often once otherwise perhaps quite rather seldom "
        "sometimes soon still then therefore thus together too twice very well"
    ),
    "EX": _w("there"),
    "TO": _w("to"),
    "CD": _w(
        "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred "
        "thousand million billion"
    ),
}
# --- fixed values: English words the suffix rules would get wrong -----------
ENGLISH_KNOWN = {
    "VB": _w("are was were have has had been does did done apply comply imply multiply rely reply supply"),
    "NN": _w(
        "ally anomaly assembly belly bully butterfly family fly italy jelly july lily monopoly rally "
        "king ring spring string thing morning evening wedding building bed seed need speed breed"
    ),
    "JJ": _w(
        "costly curly daily deadly early elderly friendly holy likely lonely lovely monthly orderly "
        "silly ugly unlikely weekly yearly"
    ),
}
# --- fixed values: English suffix rules, first match wins -------------------
ENGLISH_SUFFIXES = (
    ("ly", "RB"),
    ("ing", "VBG"),
    ("ed", "VBD"),
    ("ble", "JJ"),
    ("ous", "JJ"),
    ("ful", "JJ"),
    ("ive", "JJ"),
    ("ic", "JJ"),
    ("al", "JJ"),
)



@dataclass(frozen=True)
class ContextRule:
    """A token tagged ``tag`` becomes ``to`` where the tag before it is one of
    ``after`` and the tag behind it one of ``before``; no tags mean any."""

    tag: tuple[str, ...]
    to: str
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()


# --- fixed values: English rules over neighbouring tags, in order -----------
ENGLISH_CONTEXT = (
    # to run, will plan, they plan
    ContextRule(("NN",), "VB", after=("TO", "MD")),
    ContextRule(("NN",), "VBP", after=("PRP",), before=("DT", "IN", "PRP", "TO", "RB")),
    # the apply, a reply
    ContextRule(("VB",), "NN", after=("DT",)),
    # the used car, a growing town, the ghostly house
    ContextRule(("VBD", "VBG", "RB"), "JJ", after=("DT",), before=("NN",)),
    # I like the town, to near the town
    ContextRule(("IN",), "VB", after=("PRP", "MD", "TO"), before=("DT",)),
)

ENGLISH = Lexicon("en", ENGLISH_CLOSED, ENGLISH_SUFFIXES, known=ENGLISH_KNOWN)

# --- fixed values: closed-class words of three further languages ------------
FRENCH = Lexicon("fr", {
    "DT": _w("le la les un une des du de au aux ce cet cette ces mon ma mes son sa ses notre nos leur leurs"),
    "IN": _w("à dans par pour en vers avec sans sous sur entre chez depuis pendant avant après"),
    "CC": _w("et ou mais donc or ni car que quand comme si"),
    "PRP": _w("je tu il elle on nous vous ils elles se qui dont où lui eux"),
    "RB": _w("ne pas plus très bien aussi encore toujours jamais ici là"),
}, singularize=False)
GERMAN = Lexicon("de", {
    "DT": _w("der die das den dem des ein eine einen einem einer eines kein keine dieser diese dieses"),
    "IN": _w("in im an am auf aus bei mit nach von vom zu zum zur für über unter durch gegen ohne um vor"),
    "CC": _w("und oder aber denn sondern dass weil wenn als ob"),
    "PRP": _w("ich du er sie es wir ihr sich man wer was mein dein sein ihre unser"),
    "RB": _w("nicht auch noch nur schon sehr so wie hier dort immer nie"),
}, singularize=False)
SPANISH = Lexicon("es", {
    "DT": _w("el la los las un una unos unas lo este esta estos estas ese esa su sus mi mis"),
    "IN": _w("a al ante bajo con contra de del desde en entre hacia hasta para por según sin sobre tras"),
    "CC": _w("y e o u pero sino ni que como si cuando porque"),
    "PRP": _w("yo tú él ella nosotros ellos ellas se me te le les quien cual"),
    "RB": _w("no más muy también ya aquí allí siempre nunca"),
}, singularize=False)

LEXICONS = {lx.lang: lx for lx in (ENGLISH, FRENCH, GERMAN, SPANISH)}

# --- fixed values: English singular forms -----------------------------------
# Same in the plural, or ending in an s that is no plural mark.
UNCHANGED = _w(
    "news series species headquarters corps chaos debris measles mumps scissors pants molasses gallows "
    "rabies scabies diabetes herpes means innings was has does gas atlas canvas bias alias lens christmas "
    "always perhaps specimen regimen abdomen omen acumen yemen texas kansas arkansas paris"
)
# Whole words with a form of their own.
IRREGULAR = {
    "people": "person",
    "children": "child", "oxen": "ox",
    "feet": "foot", "teeth": "tooth", "geese": "goose",
    "mice": "mouse", "lice": "louse",
    "lives": "life",
    "leaves": "leaf", "loaves": "loaf", "halves": "half", "calves": "calf", "elves": "elf",
    "shelves": "shelf", "wolves": "wolf", "thieves": "thief", "scarves": "scarf",
    "criteria": "criterion", "phenomena": "phenomenon",
    "data": "datum", "bacteria": "bacterium", "strata": "stratum", "errata": "erratum", "ova": "ovum",
    "addenda": "addendum", "agenda": "agendum",
    "alumnae": "alumna", "algae": "alga", "vertebrae": "vertebra",
    "alumni": "alumnus", "fungi": "fungus", "nuclei": "nucleus", "stimuli": "stimulus",
    "indices": "index", "vertices": "vertex", "matrices": "matrix", "appendices": "appendix",
    "movies": "movie", "cookies": "cookie", "zombies": "zombie", "calories": "calorie",
    "shoes": "shoe", "toes": "toe", "foes": "foe", "canoes": "canoe", "axes": "axis",
    "aches": "ache", "headaches": "headache", "caches": "cache", "niches": "niche",
    "buses": "bus", "viruses": "virus", "bonuses": "bonus", "campuses": "campus", "statuses": "status",
    "gases": "gas", "lenses": "lens",
}
# Word endings, longest first; the first that fits decides.
ENDINGS = (
    ("analyses", "analysis"), ("hypotheses", "hypothesis"), ("diagnoses", "diagnosis"), ("crises", "crisis"),
    ("wives", "wife"), ("knives", "knife"), ("selves", "self"),
    ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zzes", "zz"), ("oes", "o"),
    ("ies", "y"), ("men", "man"),
)
# Endings that keep their s.
KEEP_S = ("ss", "us", "is")
