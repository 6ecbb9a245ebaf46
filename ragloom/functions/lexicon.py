"""Word lists of retrieval, as parameters with defaults for the default corpus."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The default lists, which right results on the default corpus need.
STOP = "about after also and are can did does for from has have how into not that the this was what when which who with would"
EVIDENCE = "allegiance ally ancestor battle betray betrayal betrothal betrothed claim commander conflict conspiracy conspired crown death enemy family fight fostered grandson grandfather hierarchy house kill killing king knight lady lineage lord loyal loyalty marriage marry member murder noble orchestrated pledge plotted poison poisoned power queen rank rebel reign rule ruling schemed steward sworn throne title traitor ward war wed wedding"
CONFLICT = "assassin battle betray betrayal blood conspiracy conspired dead death enemy execute kill killed murder orchestrated plotted poison poisoned rebel rebellion revenge schemed slain traitor treachery war wound"
ALLIANCE = "allegiance ally banner betrothed betrothal fostered friend honor house knight lord loyal loyalty married oath protect raised sworn vassal ward wed"
PHRASES = "house stark|house lannister|house targaryen|house baratheon|house tully|house arryn|house martell|house tyrell|house bolton|house frey|house greyjoy|king in the north|iron throne|red wedding|lord commander|first ranger|night's watch|nights watch|tower of joy|hand of the king|vale of arryn|red viper|mad king|war of five kings"
EXPANSIONS = """
ned: eddard stark, lord stark, stark
eddard: ned stark, lord stark
jon: jon snow, bastard, snow, aegon targaryen
cersei: queen cersei, lannister
tywin: lord tywin, lannister, warden
daenerys: dany, khaleesi, targaryen, mother of dragons, stormborn
dany: daenerys, khaleesi, targaryen
robb: robb stark, king in the north
sansa: sansa stark, stark
arya: arya stark, stark
bran: brandon stark, stark
catelyn: lady stark, tully, cat
jamie: kingslayer, lannister
jaime: kingslayer, lannister
tyrion: imp, lannister
rickard: rickard stark, lord stark, stark
lyanna: lyanna stark, stark, tower of joy
benjen: benjen stark, first ranger, stark
hoster: hoster tully, lord tully, tully, riverrun
lysa: lysa tully, lysa arryn, tully, arryn
edmure: edmure tully, tully, riverrun
rhaella: rhaella targaryen, targaryen
rhaegar: rhaegar targaryen, prince of dragonstone, targaryen
viserys: viserys targaryen, targaryen
elia: elia martell, princess, martell
oberyn: red viper, oberyn martell, martell
margaery: margaery tyrell, tyrell, queen
tommen: tommen baratheon, baratheon, king
renly: renly baratheon, baratheon
mormont: jeor mormont, old bear, lord commander
jeor: jeor mormont, lord commander
alliser: alliser thorne, master at arms
thorne: alliser thorne
janos: janos slynt, city watch
slynt: janos slynt, city watch
petyr: petyr baelish, littlefinger
littlefinger: petyr baelish, lord baelish
baelish: petyr baelish, littlefinger
walder: walder frey, frey
roose: roose bolton, bolton
lannister: house lannister, casterly rock, lion, westerlands
stark: house stark, winterfell, wolf, north
targaryen: house targaryen, dragonstone, dragon
baratheon: house baratheon, storms end
tully: house tully, riverrun, riverlands
arryn: house arryn, eyrie, vale
martell: house martell, dorne, sunspear
tyrell: house tyrell, highgarden, reach
frey: house frey, twins
bolton: house bolton, dreadfort
greyjoy: house greyjoy, pyke, iron islands
winterfell: stark seat, north
eyrie: house arryn, vale of arryn
throne: iron throne, king, ruler, rule
kill: killed, murder, death, slain
killed: murder, death, slain, executed
betray: betrayal, traitor, treachery, turncloak
conspire: conspiracy, plotted, schemed, planned
conspired: conspiracy, plot, scheme, orchestrated
married: wife, husband, wedding, spouse
betrothed: betrothal, promised, engaged
allegiance: loyal, sworn, banner, vassal
member: member of, belonging to, part of
rules: lord of, controls, governs
grandfather: father, parent, ancestor
grandmother: mother, parent, ancestor
ward: raised, fostered, wardship
hierarchy: rank, command, order, structure
commander: lord commander, mormont, jon snow
"""
FLAG_PHRASES = {
    "asks_conflict": "killed by|betrayed|without|avoid|enemy of|against",
    "asks_conspiracy": "conspired|conspiracy|planned|plotted|schemed|orchestrated|who planned|red wedding|poisoned|who poisoned",
    "asks_political": "who rules|allegiance|more powerful|loyal to|sworn to|compare",
    "asks_explanation": "explain|trace",
    "asks_family": "grandfather|grandmother|ancestor|descended|lineage|related to|blood relation|family tree|grandchild|nephew|aunt|uncle|betrothed|betrothal|through marriage|connected through",
    "asks_hierarchy": "chain of command|rank|served under|hierarchy|lord commander|first ranger|steward|ranger|builder|who served|who held",
}
FLAG_CUES = {
    "asks_conflict": CONFLICT,
    "asks_conspiracy": "conspired conspiracy plotted schemed orchestrated poisoned planned traitor",
    "asks_political": "rule throne lord king queen allegiance sworn crown",
    "asks_explanation": "because reason cause result led leading",
    "asks_family": "parent father mother sibling brother sister married betrothed ancestor lineage grandson grandfather nephew aunt uncle",
    "asks_hierarchy": "commander ranger steward builder rank order sworn lord master",
}

_TERM = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)?")


def python_terms(text: str) -> list[str]:
    """``word_terms`` of a short string on the driver, in order of first sight."""
    out: dict[str, None] = {}
    for term in _TERM.findall(text.lower()):
        if len(term) > 2:
            out[term] = None
            if term.endswith("s") and len(term) > 4:
                out[term[:-1]] = None
    return list(out)


def _expansions(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Ordered (key, terms of its expansions)."""
    rows = (line.split(":", 1) for line in text.strip().splitlines())
    return tuple((key.strip(), tuple(dict.fromkeys(t for x in words.split(",") for t in python_terms(x)))) for key, words in rows)


@dataclass(frozen=True)
class Lexicon:
    """All lists that retrieval uses; replace any of them for another corpus."""

    stop: tuple[str, ...] = tuple(STOP.split())
    evidence: tuple[str, ...] = tuple(EVIDENCE.split())
    conflict: tuple[str, ...] = tuple(CONFLICT.split())
    alliance: tuple[str, ...] = tuple(ALLIANCE.split())
    phrases: tuple[str, ...] = tuple(PHRASES.split("|"))
    expansions: tuple[tuple[str, tuple[str, ...]], ...] = field(default_factory=lambda: _expansions(EXPANSIONS))
    flag_phrases: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: tuple(v.split("|")) for k, v in FLAG_PHRASES.items()})
    flag_cues: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: tuple(v.split()) for k, v in FLAG_CUES.items()})


DEFAULT = Lexicon()
