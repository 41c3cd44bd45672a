"""Grammars of personal details: e-mail, address, identity number, phone, name.

A text is cut into words once. Words that announce a detail (field labels, titles, roles,
kinship, verbs of speaking) are looked up in tables, and a grammar of the detail is tried
beside each. Forms that prove themselves (an @, an international prefix, check digits)
need no such word. English, German, French and Spanish are covered.

A name is one to three words that are not ordinary: no function word, no verb of speech,
no role, no word of anatomy or the clinic. Its words agree in case, so that a name may
also be written small or in a text of capitals only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

KINDS = ("email", "address", "id_number", "phone", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    gender: str = ""


# ---------------------------------------------------------------- e-mail and address

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[({]dot[\])}]\s?|\sDOT\s)"
_SPELLED_DOT = r"(?:\s?[\[({]dot[\])}]\s?|\sDOT\s)"
EMAIL = [
    re.compile(rf"{_LOCAL} ?@ ?{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}\b"),
    re.compile(rf"{_LOCAL}\s?[\[({{]at[\])}}]\s?{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}\b", re.IGNORECASE),
    re.compile(rf"{_LOCAL} AT {_LABEL}(?:\.{_LABEL})*(?:{_SPELLED_DOT}{_LABEL}(?:\.{_LABEL})*)*{_SPELLED_DOT}[A-Za-z]{{2,}}(?:\.[A-Za-z]{{2,}})*\b"),
]
# Texts one of which, and of the second list too, a pattern needs.
_EMAIL_MARKS = [(("@",), ("@",)), (("(at)", "[at]", "{at}"), ("dot", ".")), ((" at ",), ("dot",))]

_PLACE = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
# The kinds of streets, as written.
_STREETS = r"(?:St\.|Street|Avenue|Ave(?:\.(?=,))?|Boulevard|Blvd(?:\.(?=,))?|Crescent|Court|Lane|Road|Rd\.|Drive|Way|Close|Terrace|Place|Square)"
_UK, _US = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}", r"[A-Z]{2} \d{5}(?:-\d{4})?"
_MORE = r"(?-i:(?:[A-Z][a-z]+ ){0,2})"  # further words of a street's name, where capitals tell them from the sentence
ADDRESS = [
    re.compile(rf"P\.?\s?O\.? Box \d+(?:, {_PLACE}(?:, {_US}| {_UK})?)?", re.IGNORECASE),
    re.compile(
        rf"(?:(?:Flat|Unit|Apt\.?) \d+[A-Z]?, )?\b\d+[A-Z]? {_MORE}{_PLACE} {_STREETS}(?!\w)(?:, (?:Apt\.?|Unit|Suite) \d+[A-Z]?)?"
        rf"(?:, {_PLACE}(?:, {_US}| {_UK})?|\r?\n{_PLACE} {_UK}|\r?\n{_PLACE}, {_US})?",
        re.IGNORECASE,
    ),
    re.compile(rf"\b{_PLACE}(?:straße|strasse|str\.|weg|allee|platz|gasse) \d+ ?[a-z]?,(?: |\r?\n)\d{{5}} {_PLACE}", re.IGNORECASE),
    re.compile(rf"\b\d+(?: bis| ter)?,? (?:rue|avenue|impasse|boulevard|place|chemin|allée) (?:de la |du |des |de )?{_PLACE},(?: |\r?\n)\d{{5}} {_PLACE}", re.IGNORECASE),
    re.compile(rf"(?:\bCalle|\bC/|\bAvda\.|\bAvenida|\bPlaza|\bPaseo) (?:de la |del |de )?{_PLACE} \d+,(?: |\r?\n)\d{{5}} {_PLACE}", re.IGNORECASE),
]
# Words one of which each of these patterns needs; a German street is found by the end of a word.
_ADDRESS_WORDS = [
    {"box"}, set("st street ave avenue blvd boulevard crescent court lane road rd drive way close terrace place square".split()), None,
    set("rue avenue impasse boulevard place chemin allée".split()), set("calle c avda avenida plaza paseo".split()),
]
_GERMAN_STREETS = ("straße ", "strasse ", "str. ", "weg ", "allee ", "platz ", "gasse ")

# ---------------------------------------------------------------- numbers

_ID_FORMS = (
    r"QQ ?\d{2} ?\d{2} ?\d{2} ?[A-Z]\b|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|[A-Z]{1,2}\d{6,8}\b|[A-Z]\d{9}\b|[A-Z]<\d{6,9}\b|[A-Z]-\d{6,8}-[A-Z]\b|\d{7,8}-?[A-Z]\b"
    r"|X \d{3} \d{3} \d{3}\b|X\d{9}\b|[A-Z0-9]{9}\b(?<=\d)|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}\b|\d{3} \d{3} \d{4}\b|\d{3}[- ]\d{2}[- ]\d{4}\b|\d{15}\b|\d{9,13}\b"
)
# Words that name an identity number of a person, and words that make an ID one of something else.
ID_WORDS = set(
    "passport ssn nhs dni nie nif id insurance security national identity reisepass reisepassnummer personalausweis personalausweisnummer ausweis ausweisnummer "
    "versichertennummer sozialversicherungsnummer krankenversicherungsnummer passeport assuré nir pasaporte identidad licence license d'assuré d’assuré".split()
)
ID_OF_OTHERS = set("case report subject batch lot protocol study trial document site record file reference event drug product sample".split())
_ID_AFTER = re.compile(
    rf"(?:[ .:#]|\b(?:card|number|no|nr|num|nummer|security|insurance|is|was|identification|nacional|ist|lautet|est)\b)*?[ :.#]({_ID_FORMS})", re.IGNORECASE
)
_LONG = re.compile(r"\d(?:\d{6}|\d\d-\d\d-| \d\d [01]\d )|-\d{7}")
_SSN = re.compile(r"\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_DNI = [re.compile(rf"{form}-?([A-Z])(?![\w-])") for form in (r"\d{8}", r"[XYZ]-?\d{7}")]
_NIR = re.compile(r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\w)")

_EXTENSION = r"(?: ?(?:x|ext\.?|extension|Durchwahl|poste) ?\d{1,6}\b)?"
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_PHONE_FORMS = (
    rf"{_DIGIT_WORD}(?: {_DIGIT_WORD}){{2,}},? \d{{4}}\b"
    r"|\+\d{1,3} ?\(\d{2,5}\) ?\d{2,4}[ .-]?\d{3,4}\b|\+\d{1,3}(?:[ .-]\d{1,8}){2,6}\b|\+\d{8,14}\b|00\d{2}(?:[ -]\d{2,6}){2,4}\b"
    r"|\(\d{2,5}\) ?\d{3,6}(?:[ .-]\d{3,4})?\b|1-\d{3}-\d{3}-\d{4}\b|\d{3}[.-]\d{3}[.-]\d{3,4}\b|\d{2}(?:\.\d{2}){4}\b|\d{2}(?: \d{2}){4}\b"
    r"|0\d{2,5}[ /]\d{3,8}(?: \d{2,4})?\b|\d{3}-\d{4}\b|\d{9,11}\b|\d{3} \d{3} \d{3,4}\b"
)
# Words that announce a phone number.
PHONE_WORDS = set(
    "reachable reach reached line hotline mobile cell cellphone call called ring dial tel telephone phone fax rückruf telefon telefonnummer handy mobil telefonisch rappeler appeler "
    "téléphone tél portable llamar teléfono móvil celular whatsapp sms contact number".split()
)
_PHONE_AFTER = re.compile(
    rf"(?:[ .:]|\b(?:at|on|under|is|was|back|no|number|nr|nummer|unter|ist|au|al|es|est|número|numéro|bitte|please|directly|direkt|him|her|them|me|us|or)\b| \(?(?=\())*?[ :.(]\(?((?:{_PHONE_FORMS}){_EXTENSION})", re.IGNORECASE
)
_PHONE_ALONE = [
    re.compile(rf"(?<![\w(])(\+\d{{1,3}} \(?\d{{1,5}}\)?(?: \d{{2,4}}){{1,4}}{_EXTENSION})(?![\w-])", re.IGNORECASE),
    re.compile(rf"(\([2-9]\d{{2}}\) ?\d{{3}}[-.]\d{{4}}{_EXTENSION})(?![\w-])", re.IGNORECASE),
    re.compile(rf"([2-9]\d{{2}}[-.]\d{{3}}[-.]\d{{4}}{_EXTENSION})(?![\w-])", re.IGNORECASE),
]
_DIGIT_BEFORE = re.compile(r"\d $")


def _free(text: str, at: int, marks: str = "-") -> bool:
    """No word, number or one of ``marks`` runs into what begins at ``at``."""
    before = text[at - 1 : at]
    return not (before.isalnum() or before == "_" or before and before in marks)


def _control_letter(found: str) -> str:
    """The check letter of a Spanish identity number."""
    digits = re.sub(r"\D", "", found.replace("X", "0").replace("Y", "1").replace("Z", "2"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]


def _proven(text: str) -> Iterator[tuple[int, int]]:
    """Identity numbers whose form and check digits prove them."""
    if not _LONG.search(text):
        return
    for m in _SSN.finditer(text):
        if not m.group().startswith(("000", "666", "9")) and _free(text, m.start()):
            yield m.span()
    for p in _DNI:
        for m in p.finditer(text):
            if _free(text, m.start()) and _control_letter(m.group()[:-1]) == m[1]:
                yield m.span()
    for m in _NIR.finditer(text):
        digits = m.group().replace(" ", "")
        if _free(text, m.start(), "") and 97 - int(digits[:13]) % 97 == int(digits[13:]):
            yield m.span()


def _phones_alone(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers whose form proves them."""
    if "+" in text:
        yield from (m.span(1) for m in _PHONE_ALONE[0].finditer(text))
    for p in _PHONE_ALONE[1:]:
        for m in p.finditer(text):
            if _free(text, m.start(), ".+/-") and not _DIGIT_BEFORE.search(text, max(0, m.start() - 2), m.start()):
                yield m.span(1)


# ---------------------------------------------------------------- names

# Titles, with the gender they tell.
TITLES = {
    **dict.fromkeys("mr sr herr monsieur señor sir".split(), "m"),
    **dict.fromkeys("mrs ms miss sra srta dra mme mlle frau madame señora sister".split(), "f"),
    **dict.fromkeys("dr prof professor doctor mx rev docteur doktor".split(), ""),
}
# Kin, with the gender they tell.
KIN = {
    **dict.fromkeys("husband son father brother uncle grandfather grandson boyfriend ehemann mann sohn vater bruder mari fils père frère marido esposo hijo padre hermano".split(), "m"),
    **dict.fromkeys("wife daughter mother sister aunt grandmother granddaughter girlfriend ehefrau tochter mutter schwester épouse fille mère sœur esposa hija madre hermana".split(), "f"),
    **dict.fromkeys("partner friend neighbour neighbor caregiver carer guardian spouse cousin child parent relative colleague".split(), ""),
}
OWNERS = set("her his my their your our ihr ihre sein seine mein meine son sa mon ma leur su mi".split())
# Who reports, treats or is treated.
ROLES = set(
    "patient reporter physician doctor nurse pharmacist investigator caller consumer prescriber practitioner specialist surgeon dentist midwife paramedic contact author name subject "
    "melder meldender meldende arzt ärztin apotheker apothekerin patientin hausarzt krankenschwester déclarant déclarante médecin infirmier infirmière pharmacien pharmacienne patiente nom "
    "notificador notificadora médico médica enfermera enfermero farmacéutico farmacéutica paciente nombre gp".split()
)
# Prepositions of talking, and the words one of which stands before them.
TALK = {
    **dict.fromkeys(("with",), set("spoke spoken speak speaking talked talk talking met call conversation interview discussed discussion telephoned meeting corresponded".split())),
    "mit": set("gespräch gesprochen telefonat rücksprache unterhaltung".split()),
    "avec": set("entretien parlé échangé discuté conversation".split()),
    "con": set("habló hablado conversación hablamos hablé entrevista".split()),
    "to": set("questions queries inquiries enquiries spoke spoken talked addressed queries attention reply".split()),
    "of": set("attention care".split()),
    "as": set("herself himself themselves identified".split()),
    "am": {"i"},
    "by": set("signed written reported called contacted seen completed submitted countersigned".split()),
}
# After these only capitals show that a name follows.
WEAK_TALK = {"as", "am"}
# Words before a signature, or before a name one gives oneself.
SIGNED = set("signed gezeichnet gez signé signée firmado firmada sincerely regards grüßen cordialement atentamente yours".split())
CALLED = set("is was named called war ist heißt namens était est nommé era es llamado llamada".split())
# What people do and things do not.
SPEECH = set(
    "called phoned telephoned said says told tells reported reports stated states confirmed confirms asked asks answered replied replies wrote writes rang complained complains described "
    "describes denied denies mentioned explained explains brought brings advised insisted recalled remembered requested thanked emailed agreed visited came attended admitted believes thinks "
    "noted notes sagte berichtete bestätigte rief teilte erklärte gab meldete a-déclaré confirma confirmó dijo llamó informó comunicó explicó déclare déclara".split()
)
# Function words of four languages.
FUNCTION = set(
    "a about after again all also although an and any are around as at because been before being but by can could did do does during each ever every for from had has have he her here hers "
    "him his how however i if in into is it its later may me might must my never no not now of off on once one only or our out over per please she should since so some still such than that "
    "the their them then there these they this those through to today tomorrow toward two under until up upon us very was we were what when where whether which while who whom whose why will "
    "with within without would yesterday yet you your".split()
) | set(
    "aber als am an auch auf aus bei beim bis da das dass dem den der des die doch durch ein eine einem einen einer er es für hat hatte ihr ihre im in ist jedoch kein keine mit nach nicht "
    "noch nun oder ohne seit sich sie sind so über um und unter vom von vor während war waren wegen weil wie wir wird wurde wurden zu zum zur vormittag nachmittag gestern heute".split()
) | set(
    "au aux avec ce ces cet cette comme dans depuis des du elle elles en est et était il ils je la le les leur lors mais ne nous on ont ou où par pas pendant pour puis qu que qui sa sans se "
    "ses son sont sous sur un une vous matin soir hier après".split()
) | set(
    "al ante aunque como con cual cuando de del desde donde durante el ella ellos en entre era es esta este esto fue ha hasta hay la las lo los mas más muy ni no nos o para pero por porque que "
    "quien se ser si sin sobre su sus también tras un una unos y ya tarde mañana ayer hoy".split()
)
# Words of the clinic and of reports, which open sentences and name no one.
CLINIC = set(
    "abdominal blood bone brain breast cardiac chest cutaneous ear eye facial foot gastric hand head heart hepatic hip jaw joint kidney knee leg limb liver lung lower muscle muscular nasal "
    "neck nerve oral pelvic pulmonary renal respiratory shoulder skin spinal stomach throat thyroid tongue tooth upper urinary urine vascular venous wrist acid extract syndrome disease pain "
    "swelling weakness bleeding spasm rash fever biopsy test tests scan x-ray mri ct ecg laboratory level levels dose doses dosage tablet tablets medication treatment therapy drug drugs "
    "case cases report reports reporting batch lot protocol arm cohort study trial subject outcome symptoms follow-up medical medicine history genotyping causality concomitant dechallenge "
    "rechallenge co-administration samples time approximately according switched anyone asking avoid back replies passport social insurance mail e-mail email fax tel phone mobile contact bp id doc "
    "cc nhs ssn symptom reaction event events hospital clinic centre center pharmacy department unit office company manufacturer sponsor regulator agency authority ltd inc gmbh health family "
    "home treating further several many both other another new old first second next last patients physicians doctors nurses pharmacists investigators reporters callers consumers colleagues "
    "relatives friends neighbours parents children staff team someone nobody everyone".split()
)
ORDINARY = FUNCTION | SPEECH | CLINIC | ROLES | CALLED | SIGNED | set(KIN) | set(TITLES) | set().union(*TALK.values())

_WORD = re.compile(r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:[-'’][^\W\d_]{2,})*")
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_ASCII_TOKEN = re.compile(r"[a-z]+(?:[-'][a-z]+)*")
_INITIAL = re.compile(r"(?:[^\W\d_]\.[ -]?)+")
_PARTICLE = re.compile(r"(?:(?:van der|van den|von der|de la|de los|van|von|de|da|del|di|la|le|der|du|dos|al) )", re.IGNORECASE)
_TITLE_AT = re.compile(rf"(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? )+", re.IGNORECASE)
_FRENCH_TITLE_AT = re.compile(_TITLE_AT.pattern.replace("(?:(?:", "(?:(?:M(?=\\.)|", 1), re.IGNORECASE)
_INITIAL_BEFORE = re.compile(r"(?:^|[^\w])[^\W\d_]\.\s*$")
_NO_NAME_AFTER = re.compile(r"\s?[@\[({](?:at|@)?|\d|[-_/]\w|['’]s\s(?:syndrome|disease|lymphoma|palsy|sarcoma|chorea|phenomenon)|\s&|\.[A-Za-z]|\s(?:syndrome|disease|ltd|inc|gmbh|clinic|hospital|laboratories|pharma)", re.IGNORECASE)
_THING_NEXT = re.compile(r" (?:was|is|were|had|has|and|wurde|acid|extract)\b", re.IGNORECASE)
_CLOSED = re.compile(r"\s*(?:[.;,!?):]|[\r\n]|$)")
_LOWER_RUN = re.compile(r"[a-zß-öø-ÿ]+")
_COLON, _LABELLED, _AFTER_SIGNED = re.compile(r" ?:? "), re.compile(r" ?: "), re.compile(r",?\s{1,4}(?:by )?|:? (?:by )?")
# What a word may announce.
_TITLE_CUE, _TALK_CUE, _SIGNED_CUE, _ROLE_CUE, _SPEECH_CUE, _ID_CUE, _PHONE_CUE = (1 << i for i in range(7))
CUES: dict[str, int] = {}
for _words, _cue in ((TITLES, _TITLE_CUE), (["m"], _TITLE_CUE), (TALK, _TALK_CUE), (SIGNED, _SIGNED_CUE), (KIN, _ROLE_CUE), (ROLES, _ROLE_CUE), (SPEECH, _SPEECH_CUE), (ID_WORDS, _ID_CUE), (PHONE_WORDS, _PHONE_CUE)):
    for _word in _words:
        CUES[_word] = CUES.get(_word, 0) | _cue
_FRENCH = {"le", "la", "les", "des", "du", "une", "avec", "ce"}
_GAP = re.compile(r"[ \t]{0,2}\r?\n?[ \t]{0,2}")


def _tokens(low: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words in lower case. No letter stands between two, so each is found from the end of the one before."""
    out, at, find = [], 0, low.find
    for word in (_ASCII_TOKEN if low.isascii() else _TOKEN).findall(low):
        at = find(word, at)
        end = at + len(word)
        out.append((word, at, end))
        at = end
    return out


class Name(NamedTuple):
    start: int
    end: int
    words: int
    titled: bool
    sure: bool  # initials, or a surname first: hardly anything but a name
    capital: bool  # capitals tell it from the sentence
    gender: str


def _class(word: str) -> str:
    """u(pper), c(apital), l(ower)."""
    return "l" if word[0].islower() else "u" if len(word) > 1 and word.isupper() else "c"


class _Text:
    """One text with its words, and the name grammar on it."""

    def __init__(self, text: str, low: str):
        self.text, self.low, self.tokens = text, low, _tokens(low)
        self.words = {t[0] for t in self.tokens}
        self.cues = [(i, t, CUES[t[0]]) for i, t in enumerate(self.tokens) if t[0] in CUES]

    @cached_property
    def uniform(self) -> bool:
        """Written in one case: few words hold small letters, or no capital is there."""
        return len(_LOWER_RUN.findall(self.text)) * 10 < len(self.tokens) or self.text == self.low

    @cached_property
    def french(self) -> bool:
        """In French ``M.`` is a title, elsewhere an initial."""
        return "the" not in self.words and len(self.words & _FRENCH) > 1

    @cached_property
    def title(self) -> re.Pattern:
        return _FRENCH_TITLE_AT if self.french else _TITLE_AT

    def word(self, at: int, like: str | None = None) -> re.Match | None:
        """A word of a name at ``at``, written like the one before it."""
        m = _WORD.match(self.text, at)
        if not m or m.group().lower() in ORDINARY or _NO_NAME_AFTER.match(self.text, m.end()):
            return None
        if like and not self.uniform and (like == "l") != (_class(m.group()) == "l"):
            return None
        return m

    def name(self, at: int) -> Name | None:
        """The name that begins at ``at``, a title before it or not."""
        title = self.title.match(self.text, at)
        gender = ""
        if title:
            gender = next((g for w in _TOKEN.findall(title.group().lower()) if (g := TITLES.get(w, "m" if w == "m" else ""))), "")
            at = title.end()
        initial = _INITIAL.match(self.text, at)
        if initial:
            start = initial.end() + (_GAP.match(self.text, initial.end()).end() - initial.end() if not initial.group().endswith((" ", "-")) else 0)
            particle = _PARTICLE.match(self.text, start)
            last = self.word(particle.end() if particle else start)
            return Name(at, last.end(), 2, bool(title), True, True, gender) if last else None
        first = self.word(at)
        if not first:
            return None
        kind = _class(first.group())
        capital = not self.uniform and kind != "l"
        one = Name(at, first.end(), 1, bool(title), False, capital, gender)
        if self.text.startswith(", ", first.end()):
            second = self.word(first.end() + 2, kind)
            if second and self.ends(second.end(), kind):
                return Name(at, second.end(), 2, bool(title), True, capital, gender)
            return one
        if not self.text.startswith(" ", first.end()):
            return one
        middle = _INITIAL.match(self.text, first.end() + 1)
        start = middle.end() if middle else first.end() + 1
        particle = _PARTICLE.match(self.text, start)
        last = self.word(particle.end() if particle else start, kind) or None
        if not last:
            return one
        return Name(at, last.end(), 2, bool(title), bool(middle), capital, gender)

    def _ordinary(self, at: int) -> bool:
        m = _TOKEN.match(self.text, at)
        return bool(m) and m.group().lower() in ORDINARY

    def ends(self, at: int, kind: str | None = None) -> bool:
        """After a name of class ``kind`` comes a mark, an ordinary word, or one of another class."""
        after = _GAP.match(self.text, at).end()
        if _CLOSED.match(self.text, at) or self._ordinary(after):
            return True
        return bool(kind) and not self.uniform and after < len(self.text) and (kind == "l") != (_class(self.text[after]) == "l")

    def names(self) -> Iterator[tuple[int, int, str]]:
        tokens = self.tokens
        for i, (word, start, end), cue in self.cues:
            if cue & _TITLE_CUE and (word != "m" or self.french) and not (i and tokens[i - 1][0] in TITLES):
                got = self.name(start)
                if got and got.titled and (got.capital or got.sure or self.uniform and self.ends(got.end)):
                    yield from self._settled(got)
            if cue & _TALK_CUE and not TALK[word].isdisjoint(t[0] for t in tokens[max(0, i - 2) : i]):
                yield from self._strong(end, word in WEAK_TALK)
            elif cue & _SIGNED_CUE:
                yield from self._signature(end)
            if cue & _ROLE_CUE:
                yield from self._role(i)
            if cue & _SPEECH_CUE and i >= 1:
                yield from self._speaker(i)

    def numbers(self) -> Iterator[tuple[str, int, int]]:
        """(kind, start, end) of the numbers that a word announces."""
        text = self.text
        for i, (word, start, end), cue in self.cues:
            if cue & _ID_CUE:
                others = word == "id" and i and self.tokens[i - 1][0] in ID_OF_OTHERS and text[self.tokens[i - 1][2] : start] == " "
                if not others and (m := _ID_AFTER.match(text, end)):
                    yield ("id_number", *m.span(1))
            if cue & _PHONE_CUE and (m := _PHONE_AFTER.match(text, end)):
                yield ("phone", *m.span(1))

    def _settled(self, got: Name, gender: str = "") -> Iterator[tuple[int, int, str]]:
        yield got.start, got.end, got.gender or gender

    def _after(self, end: int) -> Name | None:
        """The name behind a blank, or behind a colon."""
        m = _COLON.match(self.text, end)
        return self.name(m.end()) if m else None

    def _strong(self, end: int, weak: bool) -> Iterator[tuple[int, int, str]]:
        """A cue after which a name stands, however it is written unless the cue is weak."""
        got = self._after(end)
        if got and (got.titled or got.capital or got.sure or not weak and self.ends(got.end)):
            yield from self._settled(got)

    def _signature(self, end: int) -> Iterator[tuple[int, int, str]]:
        m = _AFTER_SIGNED.match(self.text, end)
        got = self.name(m.end()) if m else None
        if not got:
            return
        if got.words == 2 and not got.sure and got.titled and _THING_NEXT.match(self.text, got.end):
            got = got._replace(end=got.start + len(_WORD.match(self.text, got.start).group()), words=1)
        if got.words > 1 or got.titled:
            yield from self._settled(got)

    def _role(self, i: int) -> Iterator[tuple[int, int, str]]:
        """Kin and roles: ``Reporter: X``, ``the patient, X, ...``, ``her husband X``, ``physician was X``."""
        text, (word, _, end) = self.text, self.tokens[i]
        gender = KIN.get(word, "")
        label = _LABELLED.match(text, end)
        if label:
            got = self.name(label.end())
            if got and (got.titled or got.words > 1 or got.capital) and (got.sure or self.ends(got.end)):
                yield from self._settled(got, gender)
            elif got and got.words == 1 and _CLOSED.match(text, got.end):
                yield from self._settled(got, gender)
        elif text.startswith(", ", end):
            got = self.name(end + 2)
            shut = got and text.startswith(",", got.end)
            if shut and (got.titled or got.sure or got.words > 1 or got.capital):
                yield from self._settled(got, gender)
            elif shut and i + 2 < len(self.tokens) and self.tokens[i + 2][0] in SPEECH:
                yield from self._settled(got, gender)
        elif text.startswith(" ", end) and i + 1 < len(self.tokens) and self.tokens[i + 1][0] in CALLED:
            got = self._after(self.tokens[i + 1][2])
            if got and _CLOSED.match(text, got.end) and (got.titled or got.sure or got.capital or got.words > 1 or self.tokens[i + 1][0] not in ("was", "is", "war", "ist", "es", "era", "est")):
                yield from self._settled(got, gender)
        elif text.startswith(" ", end):
            got = self.name(end + 1)
            spoken = got and self._next(got.end) in SPEECH
            near = gender or i and self.tokens[i - 1][0] in OWNERS
            if got and (got.titled or got.capital and (got.words > 1 or word in KIN and near) or spoken and (word in KIN and near or got.words > 1)):
                if got.words == 1 or not _THING_NEXT.match(text, got.end) or spoken:
                    yield from self._settled(got, gender)

    def _next(self, at: int) -> str:
        m = _TOKEN.match(self.text, at + 1)
        return m.group().lower() if m else ""

    def _speaker(self, i: int) -> Iterator[tuple[int, int, str]]:
        """A name before a verb of speech; it begins a sentence, or its capitals show where it begins."""
        text, at = self.text, self.tokens[i][1]
        for back in (4, 3, 2):
            if i < back or text[self.tokens[i - 1][2] : at] != " ":
                continue
            start = self.tokens[i - back][1]
            before = text[max(0, start - 8) : start]
            opens = not before or before.rstrip(" ")[-1:] in ".!?;:\n\r0123456789" and not _INITIAL_BEFORE.search(before)
            got = self.name(start)
            if got and got.end == at - 1 and got.words > 1 and not got.titled and (got.capital or got.sure or opens):
                yield from self._settled(got)
                return


def _lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def spans(text: str | None) -> list[Span]:
    """The details of ``text`` in their order, without overlaps; of two kinds the first in ``KINDS`` wins."""
    if not text:
        return []
    low = _lowered(text)
    parsed = _Text(text, low)
    found: dict[str, list[tuple[int, int, str]]] = {k: [] for k in KINDS}
    for p, (any_of, and_of) in zip(EMAIL, _EMAIL_MARKS):
        if any(x in low for x in any_of) and any(x in low for x in and_of):
            found["email"] += [(*m.span(), "") for m in p.finditer(text)]
    for p, words in zip(ADDRESS, _ADDRESS_WORDS):
        if (any(x in low for x in _GERMAN_STREETS) if words is None else not words.isdisjoint(parsed.words)):
            found["address"] += [(*m.span(), "") for m in p.finditer(text)]
    for kind, start, end in parsed.numbers():
        found[kind].append((start, end, ""))
    found["id_number"] += [(*s, "") for s in _proven(text)]
    found["phone"] += [(*s, "") for s in _phones_alone(text)]
    found["name"] = list(parsed.names())
    taken: list[Span] = []
    for kind in KINDS:
        for start, end, gender in sorted(set(found[kind]), key=lambda s: (s[0], -s[1], s[2] == "")):
            if all(end <= t.start or start >= t.end for t in taken):
                taken.append(Span(start, end, kind, gender))
    return sorted(taken)
