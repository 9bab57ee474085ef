"""Problem 2: personal information inside free text, found by a skip-chain conditional random field.

Patterns and capitals propose what an address, a number or a name may be; each proposal is a node of its document's
field. Potentials of nodes and strengths of edges are learnt together by pseudo-likelihood on silver labels, over all
pages: each page is read once, its proposals are kept as arrays, some thousand pages in a row; each row's potentials are
learnt apart, then averaged by how many nodes speak for each. Chain edges link words that stand together; skip edges link equal and nearly equal words, equal numbers, and a word with the
electronic addresses that hold it. Loopy belief propagation makes labels consistent over the document, so that a
surname that a distant place names plainly is found where nothing else tells it from another word.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, cut
from .names import GENERATIONS, NICKNAMES, plain

# How postal addresses are written. W: a capitalised word, T: a town, S: what parts are separated by.
W = r"\p{Lu}[\p{L}'’]*(?:-\n?\p{L}[\p{L}'’]*)*"
T = rf"{W}(?:[^\S\n]+{W}){{0,2}}"
S = r"(?:\s*[,;|]\s*|\s+[-–]\s+|\s+)"
OF = r"(?:(?:de\s+la|de|du|des|da|do|das|dos|del|della|delle|dei|degli|di|la|las|los|le|les|van|der|den)\s+|[dl]['’]|dell['’])*"
US_STREET = r"(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Place|Square|Terrace|Close|Highway|Parkway|Way|St|Rd|Ave|Ln|Dr|Blvd|Ct|Pl|Sq|Hwy|Pkwy)\b\.?"
PLACES = r"(?:Works|House|Park|Estate|Mill|Yard|Court|Building|Centre|Center)"
ADDRESS = [
    rf"(?:(?:Unit|Suite|Flat|Apt)\.?\s+\w+{S})?\d+[A-Za-z]?\s+(?:{W}\s+){{1,3}}{US_STREET}{S}(?:(?:Apt|Unit|Suite|Ste|Floor|Fl|#)\.?\s*[\w-]+{S})?{T}{S}\p{{Lu}}{{2}}\s+\d{{5}}(?:-\d{{4}})?",
    rf"(?:(?:Unit|Flat|Suite|Floor)\s+\w+{S})?(?:{W}(?:\s+{W}){{0,2}}\s+{PLACES}{S})?(?:\d+\w?\s+)?{W}(?:\s+{W}){{0,2}}\s+{US_STREET}{S}{T}{S}[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}}\b",
    rf"(?:(?:Am|An\s+der|Im|Zum|Zur|Auf\s+der|In\s+der|Alte|Neue)\s+{W}(?:\s+{W})?|{W}(?:str\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer|chaussee|hof|steig|pfad)|{W}[ -](?:Str\.|Straße|Weg|Platz|Allee|Ring))\s*\d+\s?[a-z]?{S}(?:(?:D|A|CH|DE|AT)-)?\d{{4,5}}\s+{T}",
    rf"\d+(?:\s+(?:bis|ter|quater)\b)?{S}(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square)\s+{OF}{W}(?:\s+{W})*{S}\d{{5}}\s+{T}(?:\s+(?:Cedex|CEDEX)(?:\s+\d+)?)?",
    rf"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|Pº|Carretera|Ctra\.|Camino|Ronda|Travesía)\s+{OF}{W}(?:\s+{W})*{S}(?:n\.?º\s*)?\d+{S}(?:\d+\.?[ºª]\s*\w+{S})?\d{{5}}\s+{T}",
    rf"(?:Via|Viale|V\.le|Piazza|P\.za|Corso|Largo|Vicolo|Strada|Piazzale|Contrada|Località)\s+{OF}{W}(?:\s+{W})*{S}\d+\w?(?:/\w+)?{S}\d{{5}}\s+{T}(?:\s*\(\p{{Lu}}{{2}}\))?",
    rf"(?:Rua|R\.|Avenida|Av\.|Travessa|Praça|Alameda|Largo|Estrada|Rodovia)\s+{OF}{W}(?:\s+{W})*{S}(?:n\.?º\s*)?\d+(?:{S}(?:sala|apto?\.?|andar|loja|bloco|conj\.?)\s*\w+)?{S}(?:{T}{S}\d{{5}}-\d{{3}}\b|\d{{5}}-\d{{3}}\s+{T})",
    rf"{W}(?:straat|laan|weg|plein|kade|gracht|dijk|singel|hof|pad|steeg)\s+\d+(?:[- ]?[a-z]\b)?{S}\d{{4}}\s?[A-Z]{{2}}\s+{T}",
    rf"(?:ul\.|al\.|pl\.|os\.|[Aa]leja|[Uu]lica|[Pp]lac)\s*{W}(?:\s+{W})*\s+\d+\w?(?:/\d+)?{S}\d{{2}}-\d{{3}}\s+{T}",
    rf"(?:ул\.|улица|проспект|пр-т|пр\.|пер\.|переулок|шоссе|наб\.|бульвар|б-р|пл\.)\s*{W}(?:\s+{W})*{S}(?:д\.|дом)\s*\d+\w?(?:{S}(?:кв\.|оф\.|корп\.|стр\.)\s*\d+)*{S}(?:\d{{5,6}}{S}(?:г\.\s*)?{W}|г\.\s*{W}(?:{S}\d{{6}}\b)?)",
]
#: What stands in each address of the costly patterns, by their place in the list: where one of these is missing, the pattern needs no try.
STREET_HINT = re.compile(r"\s(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Place|Square|Terrace|Close|Highway|Parkway|Way|St|Rd|Ave|Ln|Dr|Blvd|Ct|Pl|Sq|Hwy|Pkwy)")
HINTS = {
    0: (re.compile(r"[^\W\d_a-z]{2}\s+\d{5}"), STREET_HINT),
    1: (re.compile(r"[A-Z]\d[A-Z\d]?\s*\d[A-Z]{2}"), STREET_HINT),
    2: (re.compile(r"\d{4}\s+[^\W\d_a-z]"), re.compile(r"(?:[Ss]tr\.|[Ss]traße|strasse|[Ww]eg|[Pp]latz|[Aa]llee|gasse|[Rr]ing|damm|ufer|chaussee|hof|steig|pfad)\s*\d|(?:Am|der|Im|Zum|Zur|Alte|Neue)\s")),
    3: (re.compile(r"\d{5}\s"), re.compile(r"(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square)\s")),
    7: (re.compile(r"\d{4}\s?[A-Z]{2}"), re.compile(r"(?:straat|laan|weg|plein|kade|gracht|dijk|singel|hof|pad|steeg)\s+\d")),
}


@lru_cache(maxsize=None)
def _addresses(costly: tuple[int, ...]) -> regex.Pattern:
    """The patterns of ADDRESS, of those with hints only these; tried only where the first sign may begin one."""
    return regex.compile(r"(?=[\p{Lu}\dупшнб]|[aup]l|os\.)(?:" + "|".join(p for i, p in enumerate(ADDRESS) if i in costly or i not in HINTS) + ")")


class Addresses:
    """All of ADDRESS as one pattern."""

    @staticmethod
    def finditer(text: str, lo: int, hi: int) -> Iterator:
        costly = tuple(i for i, hints in HINTS.items() if all(h.search(text, lo, hi) for h in hints))
        return _addresses(costly if len(costly) < 2 else tuple(HINTS)).finditer(text, lo, hi)  # few patterns to compile

# How electronic addresses are written or hidden.
LABEL = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|punto|point|ponto|punt|kropka|точка)\s*[\])}]\s*)"
EMAIL = regex.compile(
    rf"(?<![\p{{L}}\d._%+-])[\p{{L}}\d][\p{{L}}\d._%+-]*(?:\s{{0,2}}(?:[@＠]|&#64;)\s{{0,2}}|\s*[\[({{]\s*(?:at|ad|arroba|chiocciola|arobase|собака|@)\s*[\])}}]\s*){LABEL}(?:{DOT}{LABEL})*{DOT}\p{{L}}{{2,}}"
    rf"|(?<![\p{{L}}\d._%+-])[\p{{L}}\d][\p{{L}}\d._%+-]*\s+at\s+{LABEL}(?:(?:\.|\s+dot\s+){LABEL})*\s+dot\s+\p{{L}}{{2,}}",
    regex.I,
)

# Forms of telephone numbers, and words before one.
EXTENSION = r"(?:,?\s*(?:ext\.?|extension|x|Durchwahl|Dw\.?|DW|доб\.?|int\.?|interno|wew\.?|poste|toestel|ramal)\s*\d{1,5}\b)?"
G = r"(?:\s{1,7}|[-./])"  # what separates groups of figures
PHONES = (
    r"\+\s?\d{1,3}[\s.\-/]{0,7}(?:\(\d{1,4}\)[\s.\-/]{0,7})?\d(?:[\s.\-/()]{0,7}\d){5,12}",
    r"00\d{2}[\s.-]{0,7}(?:\(0\)[\s.-]{0,7})?\d(?:[\s.\-/]{0,7}\d){6,11}",
    rf"\(0?\d{{2,5}}\)(?:\s{{0,7}}|-)\d{{3,4}}(?:{G}?\d{{2,4}}){{1,3}}",
    r"1-\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}",
    rf"0\d(?:{G}\d{{2}}){{4}}",
    rf"8{G}\(?\d{{3}}\)?{G}\d{{3}}{G}\d{{2}}{G}\d{{2}}",
    rf"0\d{{1,4}}(?:\s{{1,7}}|[/-])\d{{3,}}(?:{G}\d{{2,}}){{0,3}}",
)
PHONE = regex.compile(r"(?<![\p{L}\d.,/+-])(?:" + "|".join(f"(?P<f{i}>{p})" for i, p in enumerate(PHONES)) + r")(?![-/]?\d)(?!\p{L})" + f"(?P<ext>{EXTENSION})")
CALL = regex.compile(r"(?:\b(?:tel|telefon|telephone|phone|ph|fax|mobile|mobil|cell|telefax|téléphone|tél|teléfono|telefono|telefone|telefoon|komórka|call|ring|called|reached|answers?|on|al|au|op|pelo|unter|rief|appelé|llamó|chiamare|chiamato|via|en\s+el|atende\s+no|t|f|m)|телефон|тел|факс|моб|позвон\w+|\bDurchwahl)\b[\s.:|]*$", regex.I)
COUNTED = regex.compile(r"(?:(?i:\b(?:order|po|auftrag|bestellung|commande|pedido|ordine|bestelling|zamówienie|batch|lot|lote|lotto|charge|partij|partia|vat|ust-?id|hrb|hra|siret|siren|cnpj|nip|regon|kvk|krs|drawing|zeichnung|dessin|plano|disegno|desenho|tekening|rysunek|norm\w*|item|art)|заказ|партия|чертёж|огрн)|\b(?:EN|DIN|ISO))\b[\s.:#№]*(?:\p{Lu}{1,3}\s)?$")

# Words before a number that identifies a person.
ID_WORD = regex.compile(
    r"\b(?:passport|social\s+security|national\s+insurance|tax\s+(?:fi|ﬁ)le|tax\s+id\w*|identity\s+card|id\s+card|ssn|ausweis\w*|personalausweis\w*|reisepass\w*|passnummer|pass-nr|\w*versicherungsnummer|sv-nummer|steuer-?\s?id\w*|sécurité\s+sociale|pièce\s+d['’]identité|carte\s+d['’]identité|passeport|numéro\s+fiscal|pasaporte|seguridad\s+social|número\s+fiscal|documento(?=\s+n)|documento\s+d['’]identità|carta\s+d['’]identità|codice\s+(?:personale|fiscale)|passaporto|passaporte|cartão\s+de\s+cidadão|bilhete\s+de\s+identidade|burger(?:service)?nummer|paspoort\w*|identiteitskaart\w*|rijksregister\w*|sofinummer|dow[óo]d\w*\s+osobist\w+|paszport\w*|паспорт\w*)|\b(?-i:DNI|NIE|NIF|CPF|RG|BSN|PESEL|SSN|NIR|ИНН|СНИЛС)\b",
    regex.I,
)
STOP = frozenset("tel fax email e-mail mail telefon phone mobil mobile contact kontakt t f".split())
ID_NUMBER = regex.compile(r"(?<![\p{L}\d])[A-Z\d](?:[A-Z\d]|(?: {1,7}|\r?\n|[.\-/])(?=[A-Z\d]*\d)|-(?=[A-Z](?![\p{L}\d])))*(?![\p{L}\d])")

# Words that go before a person's name and aren't part of it.
TITLES = frozenset(plain(w) for w in "mr mrs ms miss mx sir madam dr prof ing dipl mag herr frau hr fr monsieur madame mademoiselle mme mlle m señor señora srta sr sra don doña signor signora signorina sig senhor senhora dhr heer mevrouw mevr meneer pan pani panu panią господин госпожа господина госпожу госпоже господину".split())

# Words in small letters that stand inside a name, before a surname; articles only behind another of them.
PARTICLES = frozenset("van von vom de del della dei degli di da das do dos du ten ter te zu zum zur af av bin ibn".split())
ARTICLES = frozenset("der den la las los le les el".split())

UPPER = "[A-Z" + "".join(c for c in map(chr, range(0x80, 0x600)) if c.isupper()) + "]"
RUN = r"[^\W\d_]+(?:['’\u0300-\u036f]+[^\W\d_]*)*"
#: Words, initials, figures and single signs; splitting by it gives them and what lies between in turn.
WORD = re.compile(rf"((?:{UPPER}\.|(?:{RUN}(?:-\n?(?=[^\W\d_]))?)+|\d+|\S))")
#: Kinds of edges. chain: words that stand together; the others skip: equal words, words an edit apart, a word and an address that holds it, equal figures.
EDGES = ("chain", "skip", "near", "mail", "digits")
KINDS = ("name", "email", "address", "phone", "id_number")
#: Labelled nodes that move the potentials at once.
BATCH = 128
#: Parts of a node, at most.
WIDTH = 4
#: Truths that a word's place is made of, which of them are plain marks, and which of them are shown where these are hidden; in bits.
PLACE, MARKS, SHOWN = 10, 0b0001111110, 0b1100000011
EDGE = {kind: i for i, kind in enumerate(EDGES)}


@dataclass
class Settings:
    """chunk: characters of texts that one row of proposals holds, about; epochs: passes of the fit over each of these."""

    chunk: int = 4_000_000
    dims: int = 1 << 17
    epochs: int = 4
    rounds: int = 20
    strength: dict[str, float] = field(default_factory=lambda: {"chain": 0.5, "skip": 1.5, "near": 1.0, "mail": 1.5, "digits": 2.0})
    givens: frozenset[str] = field(default_factory=frozenset)


@lru_cache(maxsize=100_000)
def bare(word: str) -> str:
    if word.isascii():
        return word.replace("\n", "").lower().rstrip(".")
    return plain(word.replace("-\n", "-").replace("\n", "")).rstrip(".")


def _hash(feature: str, dims: int) -> int:
    return crc32(feature.encode("utf-8", "replace")) % dims


@dataclass(slots=True)
class Node:
    """A proposal: what it would be, what its features come from, its log odds, its word, and its silver label if one is plain."""

    start: int
    end: int
    key: str
    kind: str
    parts: tuple = ()
    z: float = 0.0
    token: int = -1
    silver: bool | None = None


def digits(text: str) -> int:
    return sum(map(str.isdigit, text))


# Cheap marks near which the costly patterns are tried; none of these can match without one.
AT_SIGN = re.compile(r"[@＠](?!\s*\d)|&#64;|[\[({]\s*(?:at|ad|arroba|chiocciola|arobase|собака|@)\s*[\])}]", re.I)
AT_WORD = re.compile(r"\sat\s(?=\s*\S+\s+dot\s)", re.I)
POSTCODE = re.compile(r"\d(?<!\d\d)(?<!\d-\d)(?:\d{4,5}(?!\d)|\d{3}(?:\s+[A-ZÄÖÜ]|[A-Z]{2}\b)|\d-\d{3}(?!\d)|(?<=[A-Z]\d)[A-Z\d]?\s*\d[A-Z]{2}\b)")
HOUSE = re.compile(r"(?:д\.|дом)\s*\d")
FIGURES = re.compile(r"[+(]{0,2}\d[\d\s().+/\-]{4,}\d")
CODED = re.compile(r"(?<![^\W_])(?:[A-Z]{1,3}-?)?\d(?:[\dA-Z.\-/]|(?: {1,7}|\r?\n|\s)(?=\d))*")


def windows(at: list[int], before: int, after: int, text: str) -> Iterator[tuple[int, int]]:
    """Stretches around marks, joined where they meet, that begin and end between words."""
    lo = hi = -1
    for m in at:
        a, b = max(0, m - before), min(len(text), m + after)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a <= hi:
            hi = max(hi, b)
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


def found_in(pattern, text: str, lo: int, hi: int) -> list:
    """All matches in a stretch, which grows as long as one of them touches its end."""
    while True:
        found = list(pattern.finditer(text, lo, hi))
        left = lo > 0 and any(m.start() == lo for m in found)
        right = hi < len(text) and any(m.end() == hi for m in found)
        if not left and not right:
            return found
        size = hi - lo
        lo, hi = max(0, lo - size) if left else lo, min(len(text), hi + size) if right else hi


def fixed_nodes(text: str, signs: list[int] | None = None) -> list[Node]:
    """Proposals for electronic and postal addresses; a postal one gives way to an electronic one. signs: where AT_SIGN matches, if known."""
    marks = [m.start() for m in AT_SIGN.finditer(text)] if signs is None else signs
    if "dot" in text or "DOT" in text:
        marks = sorted(marks + [m.start() for m in AT_WORD.finditer(text)])
    out: list[Node] = []
    free = lambda m: not any(n.start < m.end() and m.start() < n.end for n in out)
    for lo, hi in windows(marks, 80, 100, text):
        for m in found_in(EMAIL, text, lo, hi):
            if free(m):
                form = "sign" if "@" in m.group() else "word"
                out.append(Node(m.start(), m.end(), m.group().lower(), "email", (("email", form),), silver=True if form == "sign" else None))
    marks = [m.start() for m in POSTCODE.finditer(text)]
    if "д" in text:
        marks = sorted(marks + [m.start() for m in HOUSE.finditer(text)])
    for lo, hi in windows(marks, 140, 80, text):
        for m in found_in(Addresses, text, lo, hi):
            if free(m):
                out.append(Node(m.start(), m.end(), m.group(), "address", (("address", bool(re.match(r"\s*[,;]", text[m.end() : m.end() + 2]))),), silver=True))
    return sorted(out, key=lambda n: n.start)


BROKEN = regex.compile(r"(?<=\p{L})-\n(?=\p{Ll})")
DATE = regex.compile(r".{0,2}\d{1,2}[./]\d{1,2}[./]\d{2,4}")
BREAK = regex.compile(r"[;!?\n]\s*\n|(?<!\b(?:no|n|nr|núm|n[or]))\.\s", regex.I)


def number_nodes(text: str, taken: list[Node], codes: list[tuple[int, int]] | None = None, figures: list[tuple[int, int]] | None = None) -> list[Node]:
    """Proposals for phone and identity numbers. A word before one labels it: such numbers teach what the others are.

    codes, figures: stretches outside of which CODED finds nothing of five figures, and FIGURES nothing of seven.
    """
    whole = [(0, len(text))]
    nodes: list[Node] = []
    free = lambda a, b: not any(n.start < b and a < n.end for n in taken) and not any(n.start < b and a < n.end for n in nodes)
    for m in (m for a, b in (whole if codes is None else codes) for m in CODED.finditer(text, a, b)):
        if m.end() - m.start() < 5 or digits(m.group()) < 5:
            continue
        before = BROKEN.sub("", text[max(0, m.start() - 90) : m.start()])
        word = None
        for word in ID_WORD.finditer(before):  # noqa: B007 - the last one counts
            pass
        value = word and ID_NUMBER.match(text, m.start())
        if value and digits(value.group()) >= 5 and not DATE.fullmatch(value.group()):
            gap = before[word.end() :]
            if len(gap) <= 34 and not digits(gap) and not BREAK.search(gap) and free(value.start(), value.end()):
                nodes.append(Node(value.start(), value.end(), regex.sub(r"[^\dA-Z]", "", value.group()), "id_number", (("number", "id", False, False, 0),), silver=True))
    runs: list[list[int]] = []
    for run in (m for a, b in (whole if figures is None else figures) for m in FIGURES.finditer(text, a, b)):
        if digits(run.group()) >= 7:
            if runs and run.start() <= runs[-1][1]:
                runs[-1][1] = run.end() + 22
            else:
                runs.append([run.start(), run.end() + 22])
    for lo, hi in runs:
        for m in PHONE.finditer(text, lo, min(len(text), hi)):
            i = next(i for i in range(len(PHONES)) if m.group(f"f{i}"))
            value, a = m.group(), m.start()
            for end in (i for i, c in enumerate(value) if c == "\n"):  # figures of the next line or paragraph
                whole = 10 if value[0] == "+" else 9  # a number of fewer figures goes on behind a broken line
                if digits(value[:end]) >= whole and not m.group("ext") or regex.match(r"\n\s*\n", value[end:]):
                    value = value[:end].rstrip()
                    break
            n = digits(value) - digits(m.group("ext") or "")
            if not 7 <= n <= 15 or not free(a, a + len(value)):
                continue
            before = text[max(0, a - 24) : a]
            call, counted = bool(CALL.search(before)), bool(COUNTED.search(before))
            silver = False if counted else True if call else None
            nodes.append(Node(a, a + len(value), regex.sub(r"\D", "", value), "phone", (("number", i, call, counted, n),), silver=silver))
    return nodes


class Words:
    """The words of a text outside what is taken, with what the features need."""

    def __init__(self, text: str, taken: list[Node], givens: frozenset[str]):
        ends = list(accumulate(map(len, WORD.split(text))))
        start, stop = ends[0:-1:2], ends[1::2]
        inside: set[int] = set()
        for n in taken:
            i = bisect_right(stop, n.start)
            while i < len(stop) and start[i] < n.end:
                inside.add(i)
                i += 1
        self._set(text, start, stop, inside, givens)

    @classmethod
    def of(cls, text: str, start: list[int], stop: list[int], inside: set[int], givens: frozenset[str]) -> Words:
        """From where the words begin and end, and those inside what is taken."""
        words = cls.__new__(cls)
        words._set(text, start, stop, inside, givens)
        return words

    def _set(self, text: str, start: list[int], stop: list[int], inside: set[int], givens: frozenset[str]) -> None:
        self.text, self.start, self.stop, self.inside = text, start, stop, inside
        self.word = [text[a:b] for a, b in zip(start, stop, strict=True)]
        capital = [(i, bare(w)) for i, w in enumerate(self.word) if len(w) > 2 and w[0].isupper()]
        self.named = {i for i, w in capital if i not in self.inside and w not in STOP}
        self.given = {i for i, w in capital if w in givens}

    def bare(self, i: int) -> str:
        return bare(self.word[i])

    def initial(self, i: int) -> bool:
        w = self.word[i]
        return len(w) <= 2 and w[0].isupper() and len(w.rstrip(".")) == 1 and i not in self.inside

    def candidate(self, i: int) -> bool:
        return i in self.named

    def near(self, i: int, j: int) -> bool:
        """Only white space, with at most one line break, lies between word i and the later word j."""
        if not 0 <= i < j < len(self.word):
            return False
        gap = self.text[self.stop[i] : self.start[j]]
        return gap == " " or gap.isspace() and gap.count("\n") <= 1

    def particle(self, i: int) -> bool:
        w = self.word[i]
        return w in PARTICLES or w in ARTICLES and i > 0 and self.word[i - 1] in PARTICLES

    def behind(self, i: int, initials: bool = False) -> int:
        """The word behind word i, over particles and, if wanted, initials; -1 where more than white space lies between."""
        j = i + 1
        while j < len(self.word) and self.near(j - 1, j) and (self.particle(j) or initials and self.initial(j)):
            j += 1
        return j if self.near(j - 1, j) else -1

    def before(self, i: int) -> int:
        """The word before word i, over particles; -1 where more than white space lies between."""
        j = i - 1
        while j > 0 and self.word[j][0].islower() and self.particle(j) and self.near(j, j + 1):
            j -= 1
        return j if self.near(j, j + 1) else -1

    def line(self, i: int, j: int) -> bool:
        """Words i and j stand on one line."""
        return "\n" not in self.text[self.stop[i] : self.start[j]]

    def title(self, i: int) -> bool:
        j = i - 2 if i > 1 and self.word[i - 1] == "." else i - 1
        return j >= 0 and bare(self.word[j]) in TITLES

    def parts(self, i: int) -> tuple[tuple, ...]:
        """What the features of word i come from: the word, its left and right, and its place; each recurs much."""
        word, given, n, text = self.word, self.given, len(self.word), self.text
        a = self.start[i]
        fresh = i == 0 or word[i - 1] in ".!?:" or not text[text.rfind("\n", 0, a) + 1 : a].strip(" *#>|-\t")
        left = right = comma = False
        if given:
            left = self.before(i) in given
            right = i + 1 in given and self.near(i, i + 1)
            comma = i + 2 in given and word[i + 1] == ","
        initials = (i > 0 and len(word[i - 1]) <= 2 and self.initial(i - 1), i + 1 < n and len(word[i + 1]) <= 2 and self.initial(i + 1))
        place = ("place", fresh, i in given, left, right, comma, self.title(i), *initials, i - 1 in self.named, i + 1 in self.named)
        before = ("left", bare(word[i - 1]) if i > 0 else "^", bare(word[i - 2]) if i > 1 else "^")
        after = ("right", bare(word[i + 1]) if i + 1 < n else "$", bare(word[i + 2]) if i + 2 < n else "$")
        return ("word", word[i]), before, after, place


#: What a sign is, bit by bit: a mark goes on with a run of letters, leading signs may stand before a line's first word,
#: an at sign may stand in an electronic address; the last two are what CODED and FIGURES are made of.
LETTER, FIGURE, SPACE, MARK, CAPITAL, LEADING, SIGN_AT, IN_CODE, IN_FIGURES = (1 << i for i in range(9))


@lru_cache(maxsize=100_000)
def _sign(c: str) -> int:
    letter, figure, space = c.isalnum() and not c.isdecimal(), c.isdecimal(), c.isspace()
    mark = not letter and (c in "'’" or "\u0300" <= c <= "\u036f")
    own = LETTER * letter | FIGURE * figure | SPACE * space | MARK * mark | CAPITAL * bool(re.match(UPPER, c)) | LEADING * (c in " *#>|-\t") | SIGN_AT * (c in "@＠&[({")
    return own | IN_CODE * (figure or space or "A" <= c <= "Z" or c in ".-/") | IN_FIGURES * (figure or space or c in "().+/-")


#: What a word is, bit by bit.
CAPITALISED, INITIAL, DOTTED, PARTICLE, ARTICLE, COMMA, POINT, BEGINS, TITLE, TRADES, STOPS = (1 << i for i in range(11))


@lru_cache(maxsize=100_000)
def _traits(w: str) -> int:
    b, capital = bare(w), w[:1].isupper()
    own = CAPITALISED * (capital and len(w) > 2) | INITIAL * (capital and len(w) <= 2 and len(w.rstrip(".")) == 1) | DOTTED * w.endswith(".") | PARTICLE * (w in PARTICLES) | ARTICLE * (w in ARTICLES)
    own |= COMMA * (w == ",") | POINT * (w == ".") | BEGINS * (w in (".", "!", "?", ":"))
    return own | TITLE * (b in TITLES) | TRADES * (b in TRADE) | STOPS * (b in STOP)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] at i, 0 beyond the ends."""
    out = np.zeros_like(x)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row among the different ones, where each different row stands first)."""
    number, many = np.zeros(len(columns[0]), np.int64), 1
    for c in columns if len(number) else ():
        least = int(c.min())
        span = int(c.max()) - least + 1
        if many > 2**62 // span:
            distinct, number = np.unique(number, return_inverse=True)
            many = len(distinct)
        number, many = number * span + (c.astype(np.int64) - least), many * span
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, first


class Pages:
    """The words of many texts as columns: what Words says of one word, said of all.

    Three empty words stand before each text and behind the last, so that no word sees one of another text.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        self.base = base = np.cumsum(lengths) - lengths
        self.joined = "\n\n".join([*texts, ""])
        starts, stops, code, fresh = self._cut(self.joined)
        at = np.searchsorted(starts, np.append(base, len(code)))
        of = np.repeat(np.arange(len(texts)), np.diff(at))
        self.first = at + 3 * np.arange(1, len(at) + 1)
        self.starts, self.stops, self.at = starts, stops, np.arange(len(starts)) + 3 * (of + 1)
        self.size = len(starts) + 3 * len(at)
        self.of, self.start, self.stop, self.fresh = map(self._column, (of, starts - base[of], stops - base[of], fresh))
        lines = np.cumsum(np.append(np.uint8(0), code == 10), dtype=np.int32)
        near = np.zeros(len(starts), bool)
        near[:-1] = (starts[1:] > stops[:-1]) & (lines[starts[1:]] - lines[stops[:-1]] <= 1) & (of[1:] == of[:-1])
        self.near = self._column(near)

    def describe(self, givens: frozenset[str]) -> Pages:
        """What each word is."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        number[""]  # the empty words
        self.word = self._column(np.fromiter(map(number.__getitem__, [self.joined[a:b] for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True)]), np.int32, len(self.starts)))
        self.vocabulary = list(number)
        self.keys: defaultdict[str, int] = defaultdict()
        self.keys.default_factory = self.keys.__len__
        self.none_left, self.none_right = self.keys["^"], self.keys["$"]
        plain_ = list(map(bare, self.vocabulary))
        self.bare = np.array([self.keys[b] for b in plain_], np.int64)[self.word]
        self.bares = list(self.keys)
        self.real = self.word > 0
        traits = np.array(list(map(_traits, self.vocabulary)), np.uint16)[self.word]
        self.capital, self.initial, self.dotted, particle, article, self.comma, point, begins, title, self.trade, self.unnamed = (traits & 1 << bit > 0 for bit in range(11))
        self.given = self.capital & np.array([b in givens for b in plain_], bool)[self.word]
        self.particle = particle | article & shifted(particle, -1)
        self.title = np.where(shifted(point, -1) & shifted(self.real, -2), shifted(title, -2), shifted(title, -1))
        self.fresh = self.fresh | ~shifted(self.real, -1) | shifted(begins, -1)
        return self

    def _column(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, values.dtype)
        out[self.at] = values
        return out

    def take(self, taken: list[tuple[int, int, int]]) -> Pages:
        """Marks the words inside these stretches (text, begin, end); they are no names."""
        inside = np.zeros(len(self.starts) + 1, np.int64)
        if taken:
            t, a, b = np.array(taken, np.int64).T
            np.add.at(inside, np.searchsorted(self.stops, self.base[t] + a, "right"), 1)
            np.add.at(inside, np.searchsorted(self.starts, self.base[t] + b, "left"), -1)
        self.inside = self._column(np.cumsum(inside)[:-1] > 0)
        return self

    def names(self) -> np.ndarray:
        """The words that may be names, once they are described and those inside other places are marked."""
        self.named = self.capital & ~self.inside & ~self.unnamed
        self.initial = self.initial & ~self.inside
        return np.flatnonzero(self.named)

    def _cut(self, joined: str) -> tuple[np.ndarray, ...]:
        """Where the words that WORD finds begin and end, the signs' codes, and which words are the first of a line."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(code.max(initial=0)) + 1, bool)
        seen[code] = True
        table = np.zeros(len(seen), np.uint16)
        for c in np.flatnonzero(seen).tolist():
            table[c] = _sign(chr(c))
        self.sign = sign = table[code]
        letter, figure, space = (sign & bit > 0 for bit in (LETTER, FIGURE, SPACE))
        run = letter.copy()
        marks = np.flatnonzero(sign & MARK)
        if len(marks):  # marks in a row go on with a letter before the first
            new = np.append(True, np.diff(marks) > 1)
            head = marks[new][np.cumsum(new) - 1]
            run[marks] = (head > 0) & letter[head - 1]
        # a hyphen, with a line's end behind it, goes on with a word if a letter follows
        line = code == 10
        broken = shifted(line, 1) & shifted(letter, 2)
        hyphen = (code == 45) & shifted(run, -1) & (shifted(letter, 1) | broken)
        run |= hyphen | shifted(hyphen & broken, -1)
        single = ~(run | figure | space)
        begin = run & ~shifted(run, -1) | figure & ~shifted(figure, -1) | single
        end = run & ~shifted(run, 1) | figure & ~shifted(figure, 1) | single
        starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
        initial = (stops - starts == 1) & (sign[starts] & CAPITAL > 0) & (code[np.minimum(stops, len(code) - 1)] == 46)
        stops = stops + initial
        keep = ~shifted(initial, -1)
        starts, stops = starts[keep], stops[keep]
        last = np.maximum.accumulate(np.where(sign & LEADING, np.int32(0), np.arange(len(code), dtype=np.int32)))
        return starts, stops, code, line[last[np.maximum(starts - 1, 0)]]

    def stretches(self, bit: int, figures: int) -> list[list[tuple[int, int]]]:
        """For each text where it has signs of this kind only, as far as they go, with at least so many figures."""
        own = self.sign & bit > 0
        own[self.base[1:] - 1] = own[self.base[1:] - 2] = False
        change = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
        lo, hi = change[::2], change[1::2]
        count = np.cumsum(np.append(np.uint8(0), self.sign & FIGURE > 0), dtype=np.int32)
        some = count[hi] - count[lo] >= figures
        out: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        of = np.searchsorted(self.base, lo[some], "right") - 1
        for t, a, b in zip(of.tolist(), (lo[some] - self.base[of]).tolist(), (hi[some] - self.base[of]).tolist(), strict=True):
            out[t].append((a, b))
        return out

    def at_signs(self) -> list[list[int]]:
        """For each text where AT_SIGN matches."""
        out: list[list[int]] = [[] for _ in self.texts]
        places = np.flatnonzero(self.sign & SIGN_AT)
        of, end = np.searchsorted(self.base, places, "right") - 1, (-1, 0)
        for t, i in zip(of.tolist(), (places - self.base[of]).tolist(), strict=True):
            if (t, i) >= end and (m := AT_SIGN.match(self.texts[t], i)):
                out[t].append(i)
                end = t, m.end()
        return out

    def behind(self, i: np.ndarray) -> np.ndarray:
        """Words.behind of the words i."""
        j = i + 1
        while (on := self.near[j - 1] & self.particle[j]).any():
            j = j + on
        return np.where(self.near[j - 1], j, -1)

    def before(self, i: np.ndarray) -> np.ndarray:
        """Words.before of the words i, where it isn't the text's first word and a particle."""
        j = i - 1
        while (on := self.near[j] & self.particle[j]).any():
            j = j - on
        return np.where(self.near[j], j, -1)

    def other(self, i: np.ndarray) -> np.ndarray:
        return (i >= 0) & self.named[i] & ~self.given[i]

    def places(self, i: np.ndarray) -> np.ndarray:
        """The place of each word i, as PLACE says, in bits."""
        near, given, before = self.near, self.given, self.before(i)
        left = (before >= 0) & given[before]
        bits = (self.fresh[i], given[i], left, given[i + 1] & near[i], given[i + 2] & self.comma[i + 1], self.title[i], self.initial[i - 1], self.initial[i + 1], self.named[i - 1], self.named[i + 1])
        return sum(b.astype(np.int64) << c for c, b in enumerate(bits))

    def silver(self, i: np.ndarray) -> np.ndarray:
        """Labels for fitting, where the place leaves little doubt: a word beside a given name, or after a title."""
        near, given, initial = self.near, self.given, self.initial
        after = lambda j: near[j] & (self.other(self.behind(j)) | initial[j + 1] & near[j + 1] & self.other(j + 2))
        own = after(i) | near[i - 1] & self.other(i - 1) | self.comma[i - 1] & self.other(i - 2)
        before = self.before(i)
        left = (before >= 0) & given[before]
        left |= near[i - 1] & initial[i - 1] & (self.dotted[i - 1] | given[i - 2] & near[i - 2])
        turned = given[i + 1] & near[i]  # surname first, unless the given name has its own
        comma = self.comma[i + 1] & given[i + 2] & ~after(i + 2) & ~given[i - 1]
        rest = left | np.where(turned, ~after(i + 1), self.title[i] | comma)
        return np.where(given[i], own, ~self.trade[i + 1] & rest)

    def words(self, t: int, givens: frozenset[str]) -> Words:
        """The words of text t."""
        a, b = self.first[t], self.first[t + 1] - 3
        return Words.of(self.texts[t], self.start[a:b].tolist(), self.stop[a:b].tolist(), set(np.flatnonzero(self.inside[a:b]).tolist()), givens)


def spelt(part: tuple) -> list[str]:
    """The features of one part of a node."""
    kind = part[0]
    if kind == "word":
        w, p = part[1], bare(part[1])
        return ["bias", f"s3={p[-3:]}", f"s4={p[-4:]}", f"p3={p[:3]}", f"p4={p[:4]}", f"upper={w.isupper()}", f"hyphen={'-' in w}", f"len={min(len(p), 12)}"]
    if kind == "left":
        return [f"l1={part[1]}", f"l2={part[2]}|{part[1]}"]
    if kind == "right":
        return [f"r1={part[1]}", f"r2={part[1]}|{part[2]}"]
    if kind == "place":
        _, fresh, given, left, right, comma, title, initial, initial_right, cap, cap_right = part
        own = [f"given={given}", f"given-left={left}|{given}", f"given-right={right}|{given}", f"given-comma={comma}|{given}"]
        return [f"fresh={fresh}", *own, f"title={title}", f"initial={initial}|{initial_right}", f"caps={cap}|{cap_right}|{given}"]
    if kind == "number":
        return ["number", f"form={part[1]}", f"call={part[2]}", f"counted={part[3]}", f"figures={part[4]}"]
    return [kind, f"{kind}={part[1]}"]


def hidden(part: tuple) -> tuple:
    """A part without what marks a name or a number plainly; over all pages a name's word comes again, so that it would mark it too."""
    if part[0] == "word":
        return ("word", "")
    if part[0] == "place":
        return (*part[:3], False, False, False, False, False, False, *part[9:])
    return (*part[:2], False, *part[3:]) if part[0] == "number" else part


def mail_words(address: str) -> list[str]:
    """The words before an electronic address's sign."""
    return [bare(w) for w in re.findall(r"[^\W\d_]{4,}", re.split(r"[@＠(\[{]|&#64;|\sat\s", address)[0])]


def pieces(key: str) -> set[str]:
    """Three letters of a word at its beginning, middle and end."""
    half = len(key) // 2
    return {key[:3], key[half : half + 3], key[-3:]}


def alike(a: str, b: str) -> bool:
    """Whether at most one edit, or a swap of neighbours, makes the words equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] in (b[i + 1 :], b[i:]) or a[i:] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


class Field:
    """The random field: weights of the node potentials and the strength of its edges."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.w = np.zeros(settings.dims, np.float32)
        self._weights: dict[tuple, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_weights": {}}

    def _nodes(self, text: str) -> tuple[list[Node], Words]:
        """All proposals of a text."""
        taken = fixed_nodes(text)
        taken += number_nodes(text, taken)
        words = Words(text, taken, self.s.givens)
        named = [Node(words.start[i], words.stop[i], words.bare(i), "name", words.parts(i), token=i) for i in sorted(words.named)]
        return named + taken, words

    def _silver(self, p: Pages, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The silver labels of the words k, -1 for none.

        A word that a plain place of its document shows to be a name, but its own place doesn't, has no silver label:
        it is what the field shall decide.
        """
        label = np.zeros(len(k), np.int8)
        marked = np.flatnonzero(place & MARKS)  # without a given name, a title or an initial beside it no place is plain
        label[marked] = p.silver(k[marked])
        key = p.of[k] * len(p.bares) + p.bare[k]
        label[(label == 0) & np.isin(key, key[label > 0]) & ~p.trade[k + 1]] = -1
        return label

    def propose(self, texts: list[str | None]) -> tuple[dict, dict, dict]:
        """(found, parts, silver): the proposals of some texts, their different parts with these' features, and what the fit needs.

        So that the edges are learnt from nodes which they must decide, a node with labelled neighbours serves a second
        time with its word and its own plain marks hidden.
        """
        bodies = [text or "" for text in texts]
        p = Pages(bodies).describe(self.s.givens)
        taken: list[tuple[int, Node]] = []
        for t, (body, signs, codes, figures) in enumerate(zip(bodies, p.at_signs(), p.stretches(IN_CODE, 5), p.stretches(IN_FIGURES, 7), strict=True)):
            own = fixed_nodes(body, signs)
            taken += ((t, n) for n in own + number_nodes(body, own, codes, figures))
        k = p.take([(t, n.start, n.end) for t, n in taken]).names()
        whole = lambda x, width: np.array(x, np.int32).reshape(-1, width)
        # nodes: a text's names, then what else it has
        own = np.array([t for t, _ in taken], np.int64)
        order = np.argsort(np.concatenate([2 * p.of[k], 2 * own + 1]), kind="stable")
        node = np.empty(len(order), np.int64)
        node[order] = np.arange(len(order))
        per = np.bincount(p.of[k], minlength=len(texts)) + np.bincount(own, minlength=len(texts))
        first = np.cumsum(per) - per
        named, others = node[: len(k)], node[len(k) :]

        # parts: numbers of the different ones, 0 for none
        spelling: list[tuple] = [()]

        def part(different: list[tuple], number: np.ndarray) -> np.ndarray:
            spelling.extend(different)
            return number + (len(spelling) - len(different))

        word, at = numbered(p.word[k])
        word = part([("word", p.vocabulary[x]) for x in p.word[k[at]].tolist()], word)
        beside = lambda by, none: np.where(p.real[k + by], p.bare[k + by], none)
        left, right = (beside(-1, p.none_left), beside(-2, p.none_left)), (beside(1, p.none_right), beside(2, p.none_right))
        sides = []
        for kind, (near, far) in (("left", left), ("right", right)):
            side, at = numbered(near, far)
            sides.append(part([(kind, p.bares[x], p.bares[y]) for x, y in zip(near[at].tolist(), far[at].tolist(), strict=True)], side))
        place = p.places(k)
        places, of_place = np.unique(np.concatenate([place, place & SHOWN]), return_inverse=True)
        of_place = part([("place", *(bool(x >> c & 1) for c in range(PLACE))) for x in places.tolist()], of_place)
        plain_part: dict[tuple, int] = {}
        for _, n in taken:
            for x in (n.parts[0], hidden(n.parts[0])):
                plain_part.setdefault(x, len(plain_part))
        of_taken = part(list(plain_part), np.array([(plain_part[n.parts[0]], plain_part[hidden(n.parts[0])]) for _, n in taken], np.int64).reshape(-1, 2))
        no_word = int(part([hidden(("word", ""))], np.int64(0)))
        forms = np.zeros((2, len(node), WIDTH), np.int64)  # as they are, and without their plain marks
        forms[0, named] = np.stack([word, *sides, of_place[: len(k)]], 1)
        forms[1, named] = np.stack([np.full(len(k), no_word), *sides, of_place[len(k) :]], 1)
        forms[:, others, 0] = of_taken.T

        silver = np.full(len(node), -1, np.int8)
        silver[others] = [-1 if n.silver is None else n.silver for _, n in taken]
        silver[named] = self._silver(p, k, place)
        edges = self._all_edges(p, k, named, first, [(t, n, x) for (t, n), x in zip(taken, others.tolist(), strict=True)])
        around = np.zeros((len(node), len(EDGES)), np.int64)
        for a, b in ((0, 1), (1, 0)):
            labelled = edges[silver[edges[:, b]] >= 0]
            np.add.at(around, (labelled[:, a], labelled[:, 2]), 2 * silver[labelled[:, b]] - 1)

        known = np.flatnonzero(silver >= 0)
        again = known[around[known].any(1)]
        every = np.concatenate([forms[0], forms[1, again]])
        form, at = numbered(*every.T)
        every = every[at]
        rows = np.concatenate([known, again])
        row_form = np.concatenate([form[known], form[len(node) :]])
        # in the order in which they stand, as the fit goes through them in an order drawn from that
        stand = np.argsort(np.concatenate([2 * known, 2 * again + 1]))
        rows, row_form = rows[stand], row_form[stand]
        row, at = numbered(row_form, silver[rows], *around[rows].T)
        times, own = np.bincount(row, minlength=len(at)), np.argsort(at)
        at, times = at[own], times[own]
        used, every = np.unique(np.concatenate([[0], every.ravel()]), return_inverse=True)
        features: list[int] = []
        sizes = []
        dims = self.s.dims
        for x in used.tolist():
            own_features = {_hash(f, dims) for f in spelt(spelling[x])} if x else ()
            features.extend(own_features)
            sizes.append(len(own_features))
        at_column = np.zeros((len(node), 5), np.int32)
        at_column[named] = np.stack([p.start[k], p.stop[k], np.full(len(k), KINDS.index("name")), k - p.first[p.of[k]], form[named]], 1)
        at_column[others] = np.concatenate([whole([(n.start, n.end, KINDS.index(n.kind), n.token) for _, n in taken], 4), form[others][:, None]], 1)
        text_of = np.repeat(np.arange(len(texts)), per)
        edges = edges[np.argsort(text_of[edges[:, 0]], kind="stable")]
        of_edge = text_of[edges[:, 0]]
        links = np.stack([edges[:, 0] - first[of_edge], edges[:, 1] - first[of_edge], edges[:, 2]], 1).astype(np.int32)
        found = {"per": per.tolist(), "at": at_column, "linked": np.bincount(of_edge, minlength=len(texts)).tolist(), "links": links}
        parts = {"features": np.array(features, np.int32), "sizes": np.array(sizes, np.int32), "forms": every[1:].reshape(-1, WIDTH).astype(np.int32)}
        return found, parts, {"form": row_form[at].astype(np.int32), "label": silver[rows[at]] > 0, "around": around[rows[at]].astype(np.int16), "times": times.astype(np.int32)}

    def fit(self, texts: list[str]) -> Field:
        """Potentials and edges from texts at hand."""
        _, parts, silver = self.propose(texts)
        return self._take(learnt(parts, silver, self.s.dims, self.s.epochs))

    def fit_proposed(self, proposed: DataFrame) -> Field:
        """Potentials and edges from all rows of proposals(): each row's are learnt apart, then averaged by how many nodes speak for each."""
        dims, epochs, slots = self.s.dims, self.s.epochs, proposed.sparkSession.sparkContext.defaultParallelism
        rows = proposed.select("parts", "silver").rdd.coalesce(slots)
        own = lambda chunks: iter([sum((learnt(unpacked(c[0]), unpacked(c[1]), dims, epochs) for c in chunks), np.zeros((2, dims + len(EDGES))))])
        return self._take(rows.mapPartitions(own).treeReduce(np.add)) if rows.getNumPartitions() else self

    def _take(self, sums: np.ndarray) -> Field:
        s = self.s
        mean = sums[0] / np.maximum(sums[1], 1)
        self.w, self._weights = mean[: s.dims].astype(np.float32), {}
        s.strength = s.strength | {e: float(v) for e, v, seen in zip(EDGES, mean[s.dims :], sums[1, s.dims :], strict=True) if seen}
        return self

    def _score(self, nodes: list[Node]) -> None:
        known, dims = self._weights, self.s.dims
        if len(known) > 500_000:
            known.clear()
        for n in nodes:
            z = 0.0
            for part in n.parts:
                got = known.get(part)
                if got is None:
                    got = known[part] = sum(float(self.w[h]) for h in {_hash(f, dims) for f in spelt(part)})
                z += got
            n.z = max(-12.0, min(12.0, z))

    def _all_edges(self, p: Pages, k: np.ndarray, named: np.ndarray, first: np.ndarray, taken: list[tuple[int, Node, int]]) -> np.ndarray:
        """Rows (node, node, kind of edge): what _edges gives for each text, of all texts; named: the nodes of words k."""
        edges: list[np.ndarray] = []
        add = lambda a, b, kind: edges.append(np.stack([a, b, np.full(len(a), EDGE[kind])], 1))
        figures, mails, same = {}, {}, []
        for t, n, x in taken:
            if n.kind in ("phone", "id_number"):
                if (t, n.key) in figures:
                    same.append((figures[t, n.key], x))
                figures[t, n.key] = x
            elif n.kind == "email":
                for word in mail_words(n.key):
                    if word in p.keys:
                        mails.setdefault(t * len(p.bares) + p.keys[word], x)
        add(*np.array(same, np.int64).reshape(-1, 2).T, "digits")
        key = p.of[k] * len(p.bares) + p.bare[k]
        if mails:
            known = np.array(sorted(mails.items()), np.int64)
            at = np.minimum(np.searchsorted(known[:, 0], key), len(known) - 1)
            held = known[at, 0] == key
            add(named[held], known[at[held], 1], "mail")
        node = np.full(len(p.word), -1, np.int64)
        node[k] = named
        over = k[p.particle[k + 1]]
        after = p.behind(over)
        some = (after - over > 1) & (node[after] >= 0)
        add(node[over[some]], node[after[some]], "chain")
        for by, there in ((1, p.near[k]), (2, p.initial[k + 1])):
            there = there & (node[k + by] >= 0)
            add(named[there], node[k[there] + by], "chain")
        order = np.argsort(key, kind="stable")  # each occurrence to the one before it: as strong as all pairs, and linear
        equal = key[order[1:]] == key[order[:-1]]
        add(named[order[:-1][equal]], named[order[1:][equal]], "skip")
        last = order[np.append(~equal, True)] if len(order) else order
        spelt_ = {x: p.bares[x] for x in np.unique(p.bare[k]).tolist()}
        rank = {x: i for i, x in enumerate(sorted((x for x, w in spelt_.items() if len(w) >= 7), key=spelt_.__getitem__))}
        last = last[np.isin(p.bare[k[last]], np.array(list(rank), np.int64))]
        if len(last):  # nearly the same: one edit leaves the first or the second half alone
            number: dict[str, int] = {}
            third = np.full((len(p.bares), 3), -1, np.int64)
            place = np.zeros(len(p.bares), np.int64)
            for x, i in rank.items():
                place[x] = i
                for c, piece in enumerate(pieces(spelt_[x])):
                    third[x, c] = number.setdefault(piece, len(number))
            own = p.bare[k[last]]
            piece = third[own].ravel()
            rows = np.stack([np.repeat(p.of[k[last]], 3), piece, np.repeat(place[own], 3), np.repeat(last, 3)])[:, piece >= 0]
            rows = rows[:, np.lexsort(rows[2::-1])]
            beside = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            x, y = rows[3, :-1][beside], rows[3, 1:][beside]
            pair, at = numbered(p.bare[k[x]], p.bare[k[y]])
            close = np.array([alike(spelt_[a], spelt_[b]) for a, b in zip(p.bare[k[x[at]]].tolist(), p.bare[k[y[at]]].tolist(), strict=True)], bool)[pair]
            add(named[x[close]], named[y[close]], "near")
        return np.concatenate(edges)

    def _edges(self, nodes: list[Node], words: Words, all_: bool = False) -> list[tuple[int, int, str]]:
        """(node, node, kind) of the edges; those between words that nothing speaks for can't turn one and are left out."""
        edges: list[tuple[int, int, str]] = []
        last: dict[tuple, int] = {}
        mails: dict[str, int] = {}
        for k, n in enumerate(nodes):
            if n.kind in ("phone", "id_number"):
                if ("figures", n.key) in last:
                    edges.append((last["figures", n.key], k, "digits"))
                last["figures", n.key] = k
            elif n.kind == "email":
                for word in mail_words(n.key):
                    mails.setdefault(word, k)
        named = [(k, n) for k, n in enumerate(nodes) if n.token >= 0]
        held = [(k, mails[n.key]) for k, n in named if n.key in mails] if mails else []
        if not all_ and not held and not any(n.z > 0 for _, n in named):
            return edges
        edges += [(k, m, "mail") for k, m in held]
        by_token = {n.token: k for k, n in named}
        for token, k in by_token.items():
            step = words.behind(token) - token if token + 1 < len(words.word) and words.particle(token + 1) else 0
            if step > 1 and token + step in by_token:
                edges.append((k, by_token[token + step], "chain"))
            for step in (1, 2):
                if token + step in by_token and (step == 1 and words.near(token, token + 1) or step == 2 and words.initial(token + 1)):
                    edges.append((k, by_token[token + step], "chain"))
        for k, n in named:  # each occurrence to the one before it: as strong as all pairs, and linear
            if ("word", n.key) in last:
                edges.append((last["word", n.key], k, "skip"))
            last["word", n.key] = k
        near: dict[str, list[str]] = {}
        for key in sorted({n.key for _, n in named if len(n.key) >= 7}):  # nearly the same: one edit leaves the first or the second half alone
            for part in pieces(key):
                near.setdefault(part, []).append(key)
        for group in near.values():
            for x, y in zip(group, group[1:], strict=False):
                if alike(x, y):
                    edges.append((last["word", x], last["word", y], "near"))
        return edges

    def decide(self, nodes: list[Node], edges: list[tuple[int, int, str]]) -> list[bool]:
        """The most probable label of each node, by loopy sum-product messages over each connected part of the field.

        A part whose nodes all say the same on their own is left out: links that only ask for equal labels can't turn it.
        """
        label = [n.z > 0 for n in nodes]
        at: dict[int, list[tuple[int, float]]] = {}
        for a, b, kind in edges:
            j = self.s.strength[kind]
            at.setdefault(a, []).append((b, j))
            at.setdefault(b, []).append((a, j))
        seen: set[int] = set()
        for first in at:
            if first in seen:
                continue
            part, todo = [], [first]
            seen.add(first)
            while todo:
                k = todo.pop()
                part.append(k)
                for x, _ in at[k]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if any(label[k] for k in part) and not all(label[k] for k in part):
                for k, x in zip(part, self._odds(part, [nodes[k].z for k in part], at), strict=True):
                    label[k] = x > 0
        return label

    def _odds(self, part: list[int], own: list[float], at: dict[int, list[tuple[int, float]]]) -> list[float]:
        """Log odds of label 1 over label 0 for each node of a connected part."""
        place = {k: i for i, k in enumerate(part)}
        links = [(place[k], place[x], j) for k in part for x, j in at[k]]
        # two nodes may share edges of several kinds: one message for all of them
        strength: dict[tuple[int, int], float] = {}
        for a, b, j in links:
            strength[a, b] = strength.get((a, b), 0.0) + j
        links = [(a, b, j) for (a, b), j in strength.items()]
        back = {(a, b): e for e, (a, b, _) in enumerate(links)}
        m = [0.0] * len(links)
        belief = list(own)
        for _ in range(self.s.rounds):
            new, change = [], 0.0
            for e, (a, b, j) in enumerate(links):
                h = max(-30.0, min(30.0, belief[a] - m[back[b, a]]))
                u = math.log((math.exp(j + h) + 1) / (math.exp(h) + math.exp(j)))
                u = 0.5 * u + 0.5 * m[e]
                change = max(change, abs(u - m[e]))
                new.append(u)
            m = new
            belief = list(own)
            for (_, b, _), u in zip(links, m, strict=True):
                belief[b] += u
            if change < 1e-3:
                break
        return belief

    def spans(self, text: str, linked: bool = True) -> list[tuple[int, int, str]]:
        """(start, end, type) of all personal information in a text, in order and disjoint; linked: with the field's edges."""
        nodes, words = self._nodes(text)
        self._score(nodes)
        return self._places(nodes, self.decide(nodes, self._edges(nodes, words) if linked else []), lambda: words)

    def _places(self, nodes: list[Node], label: list[bool], words: Callable[[], Words]) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        named: set[int] = set()
        for n, yes in zip(nodes, label, strict=True):
            if yes and n.token >= 0:
                named.add(n.token)
            elif yes:
                found.append((n.start, n.end, n.kind))
        if named:
            found += [(a, b, "name") for a, b in assemble(words(), named)]
        out: list[tuple[int, int, str]] = []
        for span in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or span[0] >= out[-1][1]:
                out.append(span)
        return out

    def proposed_spans(self, texts: list[str | None], found: dict, parts: dict) -> Iterator[list[tuple[int, int, str]]]:
        """spans() of each text, from its proposals."""
        score = np.bincount(np.repeat(np.arange(len(parts["sizes"])), parts["sizes"]), self.w[parts["features"]], len(parts["sizes"]))
        odds = np.clip(score[parts["forms"]].sum(1), -12.0, 12.0)[found["at"][:, 4]]
        at, links = found["at"], found["links"]
        node, edge = (np.concatenate([[0], np.cumsum(found[n], dtype=np.int64)]) for n in ("per", "linked"))
        yes = odds > 0
        ends = links[:, :2] + np.repeat(node[:-1], found["linked"])[:, None]
        mixed = np.zeros(len(texts), bool)  # an edge can turn a label only beside another one
        mixed[np.searchsorted(edge, np.flatnonzero(yes[ends[:, 0]] != yes[ends[:, 1]]), "right") - 1] = True
        out: list[tuple[list[Node], list[bool]]] = [([], [])] * len(texts)
        make = lambda rows, z: [Node(a, b, "", KINDS[kind], z=x, token=i) for (a, b, kind, i, _), x in zip(at[rows].tolist(), z.tolist(), strict=True)]
        some = np.flatnonzero(yes)
        of = np.searchsorted(node, some, "right") - 1
        for t in np.unique(of).tolist():
            if mixed[t]:
                nodes = make(slice(node[t], node[t + 1]), odds[node[t] : node[t + 1]])
                out[t] = nodes, self.decide(nodes, [(a, b, EDGES[kind]) for a, b, kind in links[edge[t] : edge[t + 1]].tolist()])
            else:
                rows = some[np.searchsorted(of, t) : np.searchsorted(of, t, "right")]
                out[t] = make(rows, odds[rows]), [True] * len(rows)
        # the words of texts with names are read again
        named = {t: i for i, t in enumerate(t for t, (nodes, label) in enumerate(out) if any(yes and n.token >= 0 for n, yes in zip(nodes, label, strict=True)))}
        number = np.full(len(texts), -1)
        number[list(named)] = list(named.values())
        number = np.repeat(number, found["per"])
        taken = (number >= 0) & (at[:, 3] < 0)
        pages = Pages([texts[t] for t in named]).take(np.column_stack([number[taken], at[taken, :2]]).tolist())
        for t, (nodes, label) in enumerate(out):
            yield self._places(nodes, label, lambda t=t: pages.words(named[t], self.s.givens)) if nodes else []


def packed(value: object) -> bytes:
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> object:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def spread(parts: dict, none: int) -> np.ndarray:
    """A row of features for each form, filled up with none."""
    sizes = parts["sizes"]
    of_part = np.full((len(sizes), sizes.max(initial=0)), none, np.int32)
    of_part[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = parts["features"]
    columns = parts["forms"].T
    return np.concatenate([of_part[c, : sizes[c].max(initial=0)] for c in columns], 1)


def learnt(parts: dict, silver: dict, dims: int, epochs: int) -> np.ndarray:
    """Pseudo-likelihood over the labelled nodes of some texts, each given its features and its neighbours' labels.

    Two rows: potentials and edges, each times the number of nodes it was learnt from, and this number; nothing where
    all labels are equal. Equal nodes count as often as they stand there. An edge may be of no strength, not negative.
    """
    label, e = silver["label"].astype(np.float32), len(EDGES)
    sums = np.zeros((2, dims + e))
    if len(np.unique(label)) < 2:
        return sums
    forms, around = silver["form"], silver["around"].astype(np.float32)
    features = spread(parts, dims)
    total, total_j = np.zeros(dims, np.float32), np.zeros(e, np.float32)
    w, g2 = np.zeros(dims + 1, np.float32), np.full(dims + 1, 1e-2, np.float32)  # the last: no feature
    j, j2 = np.zeros(e, np.float32), np.full(e, 1e-2, np.float32)
    order = np.random.default_rng(7).permutation(np.repeat(np.arange(len(forms)), silver["times"]))
    sign, done = 2 * label - 1, 0
    for _ in range(epochs):
        # nodes that are right beyond doubt before an epoch move nothing in it
        score = np.bincount(np.repeat(np.arange(len(parts["sizes"])), parts["sizes"]), w[parts["features"]], len(parts["sizes"]))
        open_ = sign * (score[parts["forms"]].sum(1)[forms] + (around * j).sum(1)) < 6.9
        todo, at = order[open_[order]], 0
        while at < len(todo):  # some nodes at once, few at first, while each moves much
            k = todo[at : at + min(BATCH, 4 + done // BATCH)]
            at, done = at + len(k), done + len(k)
            x, beside = features[forms[k]], around[k]
            step = 1 / (1 + np.exp(-np.clip(w[x].sum(1) + beside @ j, -30.0, 30.0))) - label[k]
            move = np.abs(step) > 1e-3
            if not move.all():
                x, beside, step = x[move], beside[move], step[move]
            x, each = x.ravel(), np.repeat(step, x.shape[1])
            np.add.at(g2, x, each * each)
            np.add.at(w, x, -0.3 * each / np.sqrt(g2[x]))
            w[dims] = 0
            if beside.any():
                g = step[:, None] * beside
                j2 += (g * g).sum(0)
                j = np.maximum(j - 0.3 * g.sum(0) / np.sqrt(j2), 0)
        total += w[:dims]
        total_j += j
    by_form = np.bincount(forms, silver["times"], len(features))
    by_part = sum((np.bincount(parts["forms"][:, c], by_form, len(parts["sizes"])) for c in range(WIDTH)), np.zeros(len(parts["sizes"])))
    sums[1] = np.concatenate([np.bincount(parts["features"], np.repeat(by_part, parts["sizes"]), dims), silver["times"] @ np.abs(around)])
    sums[0] = np.concatenate([total, total_j]) / epochs * sums[1]
    return sums


def assemble(words: Words, named: set[int]) -> Iterator[tuple[int, int]]:
    """Names from labelled words: given name and surname in either order, initials, or a surname alone."""
    n, done = len(words.word), 0

    def surname(i: int) -> bool:
        """The given name i has a surname behind it, on its line, over further given names."""
        while (step := words.behind(i, initials=True)) in named and words.line(i, step):
            if step not in words.given:
                return True
            i = step
        return False

    for j in sorted(named):
        if j < done:
            continue
        start = j
        while start > done and words.initial(start - 1) and words.near(start - 1, start):
            start -= 1
        k, count, given, own = j, 1, j in words.given, j not in words.given
        while (step := words.behind(k, initials=True)) in named:
            if own and words.initial(k + 1) and not words.line(k, k + 1):  # an initial on a new line begins another name
                break
            if step in words.given:
                # initials begin a name of their own, and so does a given name with a surname behind it or on a new line
                if j != start or own and (surname(step) or given and not words.line(k, step)):
                    break
                given = True
            else:
                # a surname before its given name, once the name at hand has both
                after = words.behind(step)
                if given and own and after in named and after in words.given and words.line(step, after) and not surname(after):
                    break
                own = True
            k, count = step, count + 1
        single = count == 1 and j == start
        if single and j not in words.given and k + 2 < n and words.word[k + 1] == ",":
            follow = k + 2
            after = follow + 1 < n and words.near(follow, follow + 1) and follow + 1 in named and follow + 1 not in words.given
            middle = follow + 2 < n and words.initial(follow + 1) and words.near(follow, follow + 1) and follow + 2 in named
            if not after and not middle and ((follow in words.given) and follow not in words.inside or words.initial(follow) and words.word[follow].endswith(".")):
                k, single = follow, False
                if k + 1 < n and words.initial(k + 1) and words.near(k, k + 1) and words.word[k + 1].endswith("."):
                    k += 1
        elif single and j not in words.given and k + 1 < n and words.near(k, k + 1) and (words.initial(k + 1) and not words.title(j)) and words.word[k + 1].endswith("."):
            k, single = k + 1, False
        if not (single and (j in words.given) and not words.title(j)):
            yield words.start[start], words.stop[k]
        done = k + 1


def given_names(people: DataFrame | None = None, short_forms: DataFrame | None = None, name: str = "name") -> frozenset[str]:
    """Words that are given names: the known ones, those of short_forms (form, given_name), and, over all names of people, words that stand in many different ones."""
    givens = {bare(w) for line in NICKNAMES.replace("\n", " ").split(";") for w in line.replace(":", " ").split() if len(w) > 3}
    givens = {line.split(":")[0].strip() for line in NICKNAMES.replace("\n", " ").split(";")} | {g for g in givens if len(g) > 4}
    givens |= set(RUSSIAN)
    if short_forms is not None:
        for row in short_forms.select("form", "given_name").distinct().collect():
            givens |= {bare(x) for x in (row[0], row[1]) if x and len(x) > 3}
    if people is not None:
        names = people.select(col(people, name).alias("n")).where("n is not null").distinct()

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = set()
                for full in batch.column(0).to_pylist():
                    parts = [p for p in regex.findall(r"[\p{L}][\p{L}\p{M}'’-]*", full) if len(p) > 2]
                    found.update((bare(p), bare(q)) for p in parts for q in parts if q != p)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["word", "other"])

        many = max(4, names.count() // 500)
        others = names.mapInArrow(pairs, "word string, other string").distinct().groupBy("word").count()
        # a name has few words, so that few words stand beside so many others, however many names there are
        seen = {r[0] for r in others.where(F.col("count") >= many).select("word").collect()}
        givens |= seen - TITLES - TRADE - frozenset(GENERATIONS)
    return frozenset(givens - TRADE)


def proposals(df: DataFrame, model: Field, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(pages, parts, silver): all rows of df, many to a row, with their proposals; each text is read here and nowhere else.

    Computed once, into the shared checkpoint folder. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(col(df, key).alias("key"), col(df, text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = size = 0
            for i, body in enumerate(texts):
                size += len(body or "")
                if size >= shared.value.s.chunk or i + 1 == len(texts):
                    some = texts[first : i + 1]
                    found, parts, silver = shared.value.propose(some)
                    keys = batch.column(0).take(pa.array(range(first, i + 1), pa.int64()))
                    row = (keys, some, found), parts, silver
                    yield pa.RecordBatch.from_arrays([pa.array([packed(x)], pa.binary()) for x in row], names=["pages", "parts", "silver"])
                    first, size = i + 1, 0

    return cut(source.mapInArrow(run, "pages binary, parts binary, silver binary"))


def fit_field(pages: DataFrame, people: DataFrame | None = None, short_forms: DataFrame | None = None, settings: Settings | None = None, key: str = "page_id", text: str = "markdown", name: str = "name") -> Field:
    """Fit on all pages, their whole texts.

    people: a table with names of people, all of which show which words are given names (they stand in many different
    names). short_forms: (form, given_name). Null and empty texts are left out.
    """
    return fitted(pages, people, short_forms, settings, key, text, name)[0]


def fitted(pages: DataFrame, people: DataFrame | None = None, short_forms: DataFrame | None = None, settings: Settings | None = None, key: str = "page_id", text: str = "markdown", name: str = "name") -> tuple[Field, DataFrame]:
    """(field, proposals): as fit_field, with the pages' proposals, for find_proposed and redact_proposed."""
    s = settings or Settings()
    s.givens = given_names(people, short_forms, name)
    proposed = proposals(pages, Field(s), key, text)
    return Field(s).fit_proposed(proposed), proposed


# Given names as they read when spelt from Cyrillic letters.
RUSSIAN = "aleksandr aleksandra aleksei anastasia andrei anna anton boris dmitrii elena evgenii galina igor irina iulia iurii ivan konstantin ksenia liudmila maksim maria marina mikhail natalia oleg olga pavel petr sergei svetlana tatiana viktor viktoria vladimir".split()

# Words of firms' names that stand in many names without being given names.
TRADE = frozenset("gmbh ltd inc limited incorporated company group steel trading minerals ceramics abrasives castings foundry furnace technology refractories metals industries holding international services systems solutions gesellschaft sociedad spolka societa".split())


def _places(keys: pa.Array, texts: list[str], spans: Iterator[list[tuple[int, int, str]]], key: str) -> pa.RecordBatch:
    rows, types, values, starts, stops = [], [], [], [], []
    for i, (body, found) in enumerate(zip(texts, spans, strict=True)):
        for a, b, t in found:
            rows.append(i)
            types.append(t)
            values.append(body[a:b])
            starts.append(a)
            stops.append(b)
    columns = [keys.take(pa.array(rows, pa.int64())), pa.array(types, pa.string()), pa.array(values, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[key, "pii_type", "pii_value", "start", "stop"])


def _redacted(body: str | None, spans: list[tuple[int, int, str]], placeholder: str) -> str | None:
    parts, last = [], 0
    for a, b, kind in spans:
        parts += [body[last:a], placeholder.format(kind.upper())]
        last = b
    return "".join([*parts, body[last:]]) if parts else body


def find_pii(df: DataFrame, model: Field, key: str = "page_id", text: str = "markdown") -> DataFrame:
    """(key, pii_type, pii_value, start, stop): each place, offsets in characters of the text.

    Null and empty texts give no row, repeated rows repeated results, an empty table none; very long texts are
    handled whole. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(col(df, key).alias("key"), col(df, text).cast("string").alias("text")).where("text is not null and text <> ''")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield _places(batch.column(0), texts, map(shared.value.spans, texts), key)

    return source.mapInArrow(run, f"`{key}` {kind}, pii_type string, pii_value string, start int, stop int")


def find_proposed(proposed: DataFrame, model: Field, kind: str, key: str = "page_id") -> DataFrame:
    """find_pii of the table whose proposals these are; kind: the type of its key."""
    shared = proposed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, parts in zip(batch.column(0), batch.column(1), strict=True):
                keys, texts, found = unpacked(pages.as_py())
                yield _places(keys, texts, shared.value.proposed_spans(texts, found, unpacked(parts.as_py())), key)

    return proposed.select("pages", "parts").mapInArrow(run, f"`{key}` {kind}, pii_type string, pii_value string, start int, stop int")


def redact_proposed(proposed: DataFrame, model: Field, kind: str, key: str = "page_id", text: str = "markdown", placeholder: str = "[{}]") -> DataFrame:
    """(key, text) of redact for the table whose proposals these are; kind: the type of its key."""
    shared = proposed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, parts in zip(batch.column(0), batch.column(1), strict=True):
                keys, texts, found = unpacked(pages.as_py())
                spans = shared.value.proposed_spans(texts, found, unpacked(parts.as_py()))
                clean = [_redacted(body, own, placeholder) for body, own in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(clean, pa.string())], names=[key, text])

    return proposed.select("pages", "parts").mapInArrow(run, f"`{key}` {kind}, `{text}` string")


def redact(df: DataFrame, model: Field, text: str = "markdown", placeholder: str = "[{}]") -> DataFrame:
    """df with each piece of personal information in `text` replaced by its type, as [EMAIL] or [NAME].

    Every row and every other column stays; null and empty texts stay as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, shared.value.spans(t), placeholder) if t else t for t in texts], dtype=object)

    return df.select(*[clean(col(df, c)).alias(c) if c == text else col(df, c) for c in df.columns])
