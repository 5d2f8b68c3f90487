"""Paradigms of the conjugated languages: tenses, their slots, pronouns and groups, as configuration.

A line is ``name slots tags``: the slots are six persons (6), persons of one letter of number each
(2s,3p; + and - add or bar a tag), one cell (1), or one cell repeated for six persons (r). A tag after
``-`` is barred, ``<n`` limits the forms of a cell, ``|`` gives the text before the form (one, or six
between slashes) and ``@`` the pronouns where they are not the language's own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

PERSONS = {"1": "first-person", "2": "second-person", "3": "third-person", "f": "second-person-semantically"}
NUMBERS = {"s": "singular", "p": "plural"}
SIX = ("1s", "2s", "3s", "1p", "2p", "3p")

# Names of languages, tags of tenses, auxiliaries, pronouns and groups.
PRONOUNS = {
    "fr": "je;tu;il/elle;nous;vous;ils/elles",
    "el": "εγώ;εσύ;αυτ(ος/ή/ό);εμείς;εσείς;αυτ(οί/ές/ά)",
    "de": "ich;du;er/sie/es;wir;ihr;sie/Sie",
    "es": "yo;tú;él/ella/usted;nosotros/-as;vosotros/-as;ellos/-as/ustedes",
    "it": "io;tu;lui/lei;noi;voi;loro",
    "en": "I;you;he/she/it;we;you;they",
    "pt": "eu;tu;ele/ela/você;nós;vós;eles/elas/vocês",
    "ca": "jo;tu;ell/ella;nosaltres;vosaltres;ells/elles",
    "la": "ego;tū;is/ea/id;nōs;vōs;eī/eae/ea",
    "fi": "minä;sinä;hän;me;te;he",
}
NAMES = {
    "fr": ("français", "French"), "el": ("ελληνικά", "Greek"), "de": ("Deutsch", "German"), "es": ("español", "Spanish"),
    "it": ("italiano", "Italian"), "en": ("English", "English"), "pt": ("português", "Portuguese"), "ca": ("català", "Catalan"),
    "nl": ("Nederlands", "Dutch"), "sv": ("svenska", "Swedish"), "la": ("Latina", "Latin"), "fi": ("suomi", "Finnish"),
}
#: Verb tables that count, tags that bar a form from all cells, and tags that put it in brackets.
TABLES = {"fr": 2, "it": 2}
BARRED = {"el": ("dated", "archaic"), "pt": ("proscribed",)}
RARE = {
    "el": ("rare",), "de": ("archaic",), "it": ("archaic", "literary", "dialectal", "poetic"), "pt": ("archaic",), "ca": ("obsolete",),
    "nl": ("archaic", "dated", "obsolete", "rare", "dialectal"), "sv": ("dated", "obsolete", "rare", "dialectal", "nonstandard"),
    "la": ("archaic", "obsolete", "rare", "poetic"), "fi": ("archaic", "obsolete", "rare", "poetic"),
}
#: Groups of tenses: a tense is of the groups whose prefix its name has.
GROUPS = {
    "fr": "indic subj cond imper impers", "el": "indic subj imper impers", "es": "indic subj cond imper impers", "it": "indic subj cond imper impers",
    "en": "indic impers", "pt": "indic subj cond imper inf impers", "ca": "indic subj cond imper impers", "nl": "indic imper impers",
    "sv": "active s subj impers", "la": "indic subj imper nonfinite", "fi": "indic cond pot imper nonfinite",
}

GREEK = "\n".join(
    [
        f"el_indic_{name}_{voice} 6 {tags} {voice}{' | θα ' if 'fut' in name else ''}"
        for name, tags in (
            ("pres", "present indicative imperfective"),
            ("imperf", "imperfect indicative imperfective"),
            ("aorist", "past indicative perfective"),
            ("fut_cont", "present indicative imperfective"),
            ("fut_simple", "dependent indicative perfective"),
        )
        for voice in ("active", "passive")
    ]
    + [f"el_subj_perf_{voice} 6 dependent indicative perfective {voice}" for voice in ("active", "passive")]
    + [f"el_imper_{name}_{voice} 2s,2p imperative {aspect} {voice}" for voice in ("active", "passive") for name, aspect in (("imperf", "imperfective"), ("perf", "perfective"))]
) + """
el_impers_pres_parti_active 1 active present participle
el_impers_past_parti_passive 1 passive past participle
el_impers_pres_parti_passive 1 passive present participle
el_impers_inf_aorist_active 1 active infinitive-aorist
el_impers_inf_aorist_passive 1 passive infinitive-aorist"""

FRENCH = """fr_impers_pres_partic 1 participle present -multiword-construction
fr_impers_past_partic 1 participle past
fr_indic_pres 6 present indicative
fr_indic_imperf 6 imperfect indicative
fr_indic_past_hist 6 past historic indicative
fr_indic_fut 6 future indicative
fr_cond_pres 6 conditional
fr_imper_pres 2s,1p,2p imperative @ (tu);(nous);(vous)
fr_subj_pres 6 subjunctive present @ que je;que tu;qu'il/elle;que nous;que vous;qu'ils/elles
fr_subj_imperf 6 subjunctive imperfect @ que je;que tu;qu'il/elle;que nous;que vous;qu'ils/elles
fr_indic_pres_perf r participle past | ai /as /a /avons /avez /ont 
fr_indic_pluperf r participle past | avais /avais /avait /avions /aviez /avaient 
fr_indic_past_ant r participle past | eus /eus /eut /eûmes /eûtes /eurent 
fr_indic_fut_perf r participle past | aurai /auras /aura /aurons /aurez /auront """

GERMAN = """de_indic_pres 6 present indicative
de_indic_preterite 6 preterite
de_indic_perfect 6 perfect indicative
de_indic_pluperfect 6 pluperfect indicative
de_indic_fut_i 6 future-i indicative
de_indic_fut_ii 6 future-ii indicative
de_impers_infinitive 1 infinitive -multiword-construction
de_impers_pres_partic 1 participle present
de_impers_past_partic 1 participle past
de_subj_i 6 subjunctive subjunctive-i -multiword-construction
de_subj_i_perfect 6 perfect subjunctive
de_subj_i_fut_i 6 future-i subjunctive-i
de_subj_i_fut_ii 6 future-ii subjunctive-i
de_subj_ii 6 subjunctive subjunctive-ii -multiword-construction
de_subj_ii_pluperfect 6 pluperfect subjunctive
de_subj_ii_fut_i 6 future-i subjunctive-ii
de_subj_ii_fut_ii 6 future-ii subjunctive-ii"""

SPANISH = """es_impers_inf 1 infinitive <1
es_impers_gerund 1 gerund <1
es_impers_past_partic 1 participle past -feminine -plural
es_indic_pres 6 present indicative -vos-form
es_indic_pret 6 preterite indicative -vos-form
es_indic_imperf 6 imperfect indicative -vos-form
es_indic_fut 6 future indicative -vos-form
es_indic_pres_perf r participle past masculine singular | he /has /ha /hemos /habéis /han 
es_indic_pluperf r participle past masculine singular | había /habías /había /habíamos /habíais /habían 
es_cond_pres 6 conditional -vos-form
es_subj_pres 6 present subjunctive -vos-form
es_subj_imperf 6 imperfect subjunctive -vos-form
es_imper 2s-vos-form,3s,1p,2p,3p imperative @ tú;usted;nosotros/-as;vosotros/-as;ustedes"""

ITALIAN = """it_impers_inf 1 infinitive <1
it_impers_gerund 1 gerund <1
it_impers_pres_partic 1 participle present
it_impers_past_partic 1 participle past
it_indic_pres 6 present indicative
it_indic_imperf 6 imperfect indicative
it_indic_past_hist 6 past historic indicative
it_indic_fut 6 future indicative
it_indic_pres_perf r participle past | ho /hai /ha /abbiamo /avete /hanno 
it_indic_pluperf r participle past | avevo /avevi /aveva /avevamo /avevate /avevano 
it_indic_past_ant r participle past | ebbi /avesti /ebbe /avemmo /aveste /ebbero 
it_indic_fut_perf r participle past | avrò /avrai /avrà /avremo /avrete /avranno 
it_cond_pres 6 conditional
it_cond_past r participle past | avrei /avresti /avrebbe /avremmo /avreste /avrebbero 
it_subj_pres 6 present subjunctive
it_subj_imperf 6 imperfect subjunctive
it_subj_past r participle past | abbia /abbia /abbia /abbiamo /abbiate /abbiano 
it_subj_pluperf r participle past | avessi /avessi /avesse /avessimo /aveste /avessero 
it_imper 2s-negative-formal,1p-negative,2p-negative imperative @ (tu);(noi);(voi)"""

ENGLISH = """en_impers_inf 1 infinitive <1
en_impers_pres_partic 1 participle present -archaic -dialectal <1
en_impers_past_partic 1 participle past -archaic -dialectal <1
en_indic_pres 1s,2s,3s,p<1,p<1,p<1 present -archaic -dialectal @ I;you;he/she/it;we;you;they
en_indic_past 1s,2s,3s,p<1,p<1,p<1 past -archaic -dialectal @ I;you;he/she/it;we;you;they
en_indic_pres_perf r participle past -archaic -dialectal | have /have /has /have /have /have 
en_indic_past_perf r participle past -archaic -dialectal | had 
en_indic_fut r infinitive -archaic -dialectal | will """

PORTUGUESE = """pt_impers_inf 1 infinitive impersonal
pt_impers_gerund 1 gerund
pt_impers_partic 1 participle past masculine singular
pt_inf_personal 6 infinitive
pt_indic_pres 6 present indicative
pt_indic_pret 6 preterite indicative
pt_indic_imperf 6 imperfect indicative
pt_indic_pluperf 6 pluperfect indicative
pt_indic_fut 6 future indicative
pt_cond_pres 6 conditional
pt_subj_pres 6 present subjunctive
pt_subj_imperf 6 imperfect subjunctive
pt_subj_fut 6 future subjunctive
pt_imper 2s,3s,1p,2p,3p imperative @ tu;você;nós;vós;vocês"""

CATALAN = """ca_impers_inf 1 infinitive
ca_impers_gerund 1 gerund
ca_impers_partic 1 participle past masculine singular
ca_indic_pres 6 present indicative
ca_indic_imperf 6 imperfect indicative
ca_indic_pret 6 preterite indicative -periphrastic
ca_indic_periphrastic 6 preterite indicative periphrastic
ca_indic_fut 6 future indicative
ca_cond_pres 6 conditional
ca_subj_pres 6 present subjunctive
ca_subj_imperf 6 imperfect subjunctive
ca_imper 2-plural,fs,1p,2p,fp imperative @ tu;vostè;nosaltres;vosaltres;vostès"""

_NL = "-subjunctive -imperative -participle -subordinate-clause -archaic -Flanders @ ik;jij / … jij;u;hij/zij/het;wij/jullie/zij"
DUTCH = f"""nl_indic_pres 1s,2s-formal,2s+formal,3s,p present {_NL}
nl_indic_past 1s,2s-formal,2s+formal,3s,p past {_NL}
nl_imper_pres 1 imperative present singular -archaic -subordinate-clause
nl_impers_inf 1 infinitive
nl_impers_pres_partic 1 participle present
nl_impers_past_partic 1 participle past"""

SWEDISH = "\n".join(
    f"sv_{name} 1 {tags} -archaic{rest}"
    for name, tags, rest in (
        *(
            (f"{short}_{name}", f"{voice} {tags}", rest)
            for short, voice in (("active", "active"), ("s", "passive"))
            for name, tags, rest in (
                ("pres", "indicative present", ""), ("past", "indicative past", ""), ("perfect", "supine", " | har "), ("pluperfect", "supine", " | hade "), ("imper", "imperative", ""),
            )
        ),
        ("subj_pres", "active subjunctive present", ""), ("subj_past", "active subjunctive past", ""),
        ("subj_s_pres", "passive subjunctive present", ""), ("subj_s_past", "passive subjunctive past", ""),
        ("impers_inf", "active infinitive", ""), ("impers_s_inf", "passive infinitive", ""),
        ("impers_supine", "active supine", ""), ("impers_s_supine", "passive supine", ""),
        ("impers_pres_partic", "participle present", ""), ("impers_past_partic", "participle past", " -present"),
    )
)


def _latin() -> str:
    def finite(name: str, mood: str, voice: str, *tense: str) -> str:
        barred = [x for x in ("future", "perfect", "pluperfect", "sigmatic", "potential") if x not in tense]
        return f"la_{name}_{voice} 6 {' '.join(tense)} {mood} {voice} {' '.join('-' + x for x in barred)}"

    lines = []
    for voice in ("active", "passive"):
        for name, *tense in (("pres", "present"), ("imperf", "imperfect"), ("fut", "future"), ("perf", "perfect"), ("pluperf", "pluperfect"), ("fut_perf", "perfect", "future")):
            lines.append(finite(f"indic_{name}", "indicative", voice, *tense))
    for voice in ("active", "passive"):
        for name, tense in (("pres", "present"), ("imperf", "imperfect"), ("perf", "perfect"), ("pluperf", "pluperfect")):
            lines.append(finite(f"subj_{name}", "subjunctive", voice, tense))
    for name, tense, voice, slots in (("pres", "present", "active", "2s,2p"), ("fut", "future", "active", "2s,3s,2p,3p"), ("pres", "present", "passive", "2s,2p"), ("fut", "future", "passive", "2s,3s,3p")):
        lines.append(f"la_imper_{name}_{voice} {slots} imperative {tense} {voice} -sigmatic")
    for voice in ("active", "passive"):
        for name, tense, barred in (("pres", "present", "-future -perfect -potential"), ("perf", "perfect", "-future -potential"), ("fut", "future", "-perfect -potential")):
            lines.append(f"la_nonfinite_inf_{name}_{voice} 1 infinitive {tense} {voice} {barred}")
    for name, tense, voice in (("pres", "present", "active"), ("perf", "perfect", "active"), ("perf", "perfect", "passive"), ("fut", "future", "active")):
        lines.append(f"la_nonfinite_part_{name}_{voice} 1 participle {tense} {voice} -potential")
    return "\n".join(lines) + """
la_nonfinite_gerundive 1 future participle passive -perfect -potential
la_nonfinite_gerund +genitive,+dative,+accusative,+ablative gerund @ gen.;dat.;acc.;abl.
la_nonfinite_supine +accusative,+ablative supine @ acc.;abl."""


def _finnish() -> str:
    lines = []
    for group, mood, tenses in (
        ("indic", "indicative", ("pres present", "past past", "perf perfect", "pluperf pluperfect")),
        ("cond", "conditional", ("pres present", "perf perfect")),
        ("pot", "potential", ("pres present", "perf perfect")),
        ("imper", "imperative", ("pres present",)),
    ):
        people = [p for p in SIX if mood != "imperative" or p != "1s"]
        shown = [PRONOUNS["fi"].split(";")[SIX.index(p)] for p in people]
        for name, tense in (x.split() for x in tenses):
            for end, more in (("", " -negative"), ("_neg", " negative")):
                slots = ",".join([f"{p}-passive" for p in people] + ["+passive"])
                lines.append(f"fi_{group}_{name}{end} {slots} {tense} {mood}{more} @ {';'.join(shown)};passiivi")
    return "\n".join(lines) + """
fi_nonfinite_inf 1 infinitive infinitive-i
fi_nonfinite_part_pres_active 1 participle present active
fi_nonfinite_part_pres_passive 1 participle present passive"""


LINES = {
    "fr": FRENCH, "el": GREEK, "de": GERMAN, "es": SPANISH, "it": ITALIAN, "en": ENGLISH, "pt": PORTUGUESE, "ca": CATALAN,
    "nl": DUTCH, "sv": SWEDISH, "la": _latin(), "fi": _finnish(),
}


@dataclass(frozen=True)
class Slot:
    wanted: tuple[str, ...]
    excluded: tuple[str, ...]
    prefix: str
    cap: int | None
    pronoun: str


@dataclass(frozen=True)
class Tense:
    name: str
    single: bool
    slots: tuple[Slot, ...]


def _marks(text: str) -> tuple[str, list[str], list[str], int | None]:
    """A token's head, added tags, barred tags and limit: 2s+formal, p<1, 2s-vos-form."""
    text, _, cap = text.partition("<")
    if text.startswith("+"):
        return "", [text[1:]], [], int(cap) if cap else None
    for known in ("-vos-form", "-negative-formal", "-negative", "-formal", "-passive", "-plural"):
        if text.endswith(known):
            barred = ["vos-form"] if known == "-vos-form" else known[1:].split("-")
            return text[: -len(known)], [], barred, int(cap) if cap else None
    head, _, more = text.partition("+")
    return head, [more] if more else [], [], int(cap) if cap else None


def _tense(code: str, line: str) -> Tense:
    line, _, shown = line.partition(" @ ")
    line, _, before = line.partition(" | ")
    name, people, *words = line.split()
    wanted = [w for w in words if w[0] not in "-<"]
    barred = [w[1:] for w in words if w[0] == "-"]
    cap = next((int(w[1:]) for w in words if w[0] == "<"), None)
    tokens = {"6": SIX, "r": SIX, "1": ("",)}.get(people) or people.split(",")
    prefixes = before.split("/") if "/" in before else [before] * len(tokens)
    own = dict(zip(SIX, PRONOUNS.get(code, ";;;;;").split(";")))
    pronouns = shown.split(";") if shown else [own.get(_marks(x)[0], "") for x in tokens]
    slots = []
    for token, prefix, pronoun in zip(tokens, prefixes, pronouns, strict=True):
        head, more, less, most = _marks(token)
        of = [] if people == "r" else [PERSONS[c] if c in PERSONS else NUMBERS[c] for c in head]
        slots.append(Slot((*of, *wanted, *more), (*barred, *less), prefix, most or cap, pronoun))
    return Tense(name, people == "1", tuple(slots))


@cache
def tenses(code: str) -> tuple[Tense, ...]:
    return tuple(_tense(code, line) for line in LINES[code].split("\n"))


def metadata(code: str) -> dict:
    """Names, pronouns and groups of a language's tenses, as the display reads them."""
    found = tenses(code)
    if code == "de":
        groups = [("de_indic", "de_indic_"), ("de_impers", "de_impers_"), ("de_subj_i_grp", "de_subj_i"), ("de_subj_ii_grp", "de_subj_ii")]
        inside = lambda name, head: name == head or name.startswith(head + ("" if head.endswith("_") else "_"))
    else:
        groups = [(f"{code}_{g}", f"{code}_{g}") for g in GROUPS[code].split()]
        inside = lambda name, head: name == head or name.startswith(head + "_")
    return {
        "code": code,
        "name": NAMES[code][0],
        "englishWiktionaryName": NAMES[code][1],
        "tenseNames": [t.name for t in found],
        "tensePronouns": [[] if t.single else [s.pronoun for s in t.slots] for t in found],
        "tenseGroups": [{"name": g, "tenseIndices": [i for i, t in enumerate(found) if inside(t.name, head)]} for g, head in groups],
    }


SLOT = "array<struct<wanted:array<string>,excluded:array<string>,prefix:string,cap:int>>"


def slots_json(code: str) -> str:
    """All slots in order, for a literal of the plan."""
    return json.dumps([{"wanted": s.wanted, "excluded": s.excluded, "prefix": s.prefix, "cap": s.cap} for t in tenses(code) for s in t.slots], ensure_ascii=False)
