"""Problem 1: variant spellings of names typed by people, linked by a trie join.

Names of one scope (here a company) are cut into tokens. Shards of tokens become tries; a bit-parallel Levenshtein
automaton with transpositions walks a trie and yields every token within its bound. For each such neighbour the two
names are checked under permutations of their tokens: equal tokens, nicknames, initials, abbreviations and misspelt
tokens may stand for one another; names of more than six parts by an assignment of least cost. How many scopes use a token tells misspellings from names that are merely alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..runtime import bounded_broadcast, col, cut

# Words around a name that aren't part of it.
TITLES = frozenset("dr prof ing dipl mag mba phd msc bsc peng eng mr mrs ms miss herr frau hr fr sig signor signora sr. sra señor señora dott dottssa madame monsieur mme mlle mevr dhr pan pani sales einkauf purchasing verkauf vertrieb ceo cto cfo".split())
DEGREES = re.compile(r"(?i),?\s*\b(?:mba|ph\.?\s?d|m\.?\s?sc|b\.?\s?sc|p\.\s?eng|dipl\.?-?\s?ing|cpa|esq)\b\.?")
LEGAL = (
    (re.compile(r"\bsp(?:olka|ółka|\.)?\s*z\s*\.?\s*o\.?\s*o\.?(?=\W|$)|\bsp\.?\s*zoo\b"), "spzoo"),
    (re.compile(r"\bg\.?\s?m\.?\s?b\.?\s?h\b\.?|\bgesellschaft\s+(?:mit beschr\w+ haftung|mbh)\b|\bges\.?\s*m\.?b\.?h\b\.?"), "gmbh"),
    (re.compile(r"\bs\.\s?p\.\s?a\b\.?|\bspa\b|\bsocieta per azioni\b"), "spa"),
    (re.compile(r"\bs\.\s?a\.\s?s\b\.?|\bsas\b"), "sas"),
    (re.compile(r"\bs\.\s?a\b\.?|\bsa\b|\bsociedad anonima\b|\bsociete anonyme\b|\bspolka akcyjna\b"), "sa"),
    (re.compile(r"\bb\.\s?v\b\.?|\bbv\b|\bbesloten vennootschap\b"), "bv"),
    (re.compile(r"\bpty\.?\s*(?:ltd|limited)\b\.?"), "pty"),
    (re.compile(r"\bltda\b\.?|\blimitada\b"), "ltda"),
    (re.compile(r"\bltd\b\.?|\blimited\b"), "ltd"),
    (re.compile(r"\binc\b\.?|\bincorporated\b"), "inc"),
    (re.compile(r"\bllc\b|\bl\.l\.c\.?"), "llc"),
    (re.compile(r"\bcorp\b\.?|\bcorporation\b"), "corp"),
    (re.compile(r"\bооо\b|\booo\b"), "ooo"),
    (re.compile(r"\bag\b|\baktiengesellschaft\b"), "ag"),
)
GENERATIONS = {"jr": "jr", "junior": "jr", "jun": "jr", "hijo": "jr", "fils": "jr", "sr": "sr", "senior": "sr", "sen": "sr", "père": "sr", "ii": "2", "iii": "3", "iv": "4"}

# Short forms of given names, beside those of the table name_forms.
NICKNAMES = """alexander: alex sasha sascha xander sandy lex; abigail: abby abbie gail; andreea: andra deea; antoinette: toni tony toinette nettie;
beatriz: bea bia trix; bjorn: bjoern; charles: charlie chuck chas carl; chloe: chloee; concepcion: concha conchita; dmitri: dima mitya dmitry dmitriy;
ekaterina: katya katja katia; elizabeth: liz beth betty lizzie eliza betsy bess lisa; etienne: steph; evgenia: zhenya evgeniya; francisco: paco pancho fran kiko;
friedrich: fritz fred freddy fiete; gertrud: trude gerti trudi; giuseppe: pino beppe peppe; goncalo: gonza goncalinho; guadalupe: lupe lupita; henrik: henk rik hendrik henning;
ignacio: nacho; ingrid: inga inge; johannes: hans jo hannes johan; jurgen: juergen jorg; katarzyna: kasia kaska; ludovico: vico ludo; malgorzata: gosia malgosia;
margaret: maggie meg peggy marge greta; nathaniel: nate nat nathan; nikolai: kolya nikolay nick niko; patrick: paddy pat rick; richard: rick dick rich richie ricky;
robert: bob bobby rob robbie bert; samuel: sam sammy; sebastian: seb basti bastian; soren: soeren; theodore: ted theo teddy; tomasz: tomek thomas tom;
ulrike: uli ulla rike; victoria: vicky tori vika viktoria vic; wilhelmina: mina willy wilma minnie; william: bill will billy willy liam; zoltan: zoli"""

CYRILLIC = dict(zip("абвгдеёзийклмнопрстуфхыэ", "abvgdeeziiklmnoprstufhie", strict=True)) | {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "iu", "я": "ia", "ь": "", "ъ": ""}
LATIN = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def repaired(name: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read again as what it is."""
    if re.search("[ÂÃÅÄÐÑØ][\x80-\xff–—‘’“”•…‚„†‡€™œŒšŠžŽŸƒˆ˜‰‹›\xa0]|Ð", name):
        raw = b""
        for c in name:
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                if ord(c) > 255:
                    return name
                raw += bytes([ord(c)])
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return name
    return name


def plain(text: str) -> str:
    """Small letters without marks; Cyrillic spelt in Latin letters."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("ия", "иа").translate(LATIN))
    text = unicodedata.normalize("NFC", "".join(c for c in text if not unicodedata.combining(c) or c == "̆"))
    return unicodedata.normalize("NFKD", "".join(CYRILLIC.get(c, c) for c in text)).replace("̆", "")


def folded(token: str) -> str:
    """Letters that a change of script confuses, made alike."""
    return token.translate(str.maketrans({"w": "v", "y": "i", "q": "k", "c": "k", "x": "ks"}))


def parse(name: str) -> str | None:
    """generation|legal form|tokens: the form of a name, equal for spellings that differ in layout only.

    A token keeps its point if it is an abbreviation, its hyphen if it is double, and c~ before it if it was Cyrillic.
    """
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", repaired(name))).strip()
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    text = re.split(r"\s[-–—|/]\s", text)[0]
    text = DEGREES.sub(" ", text)
    cyrillic = bool(re.search("[а-яё]", text, re.I))
    text = plain(text)
    text = re.sub(r"(?<=[^\W\d_])1|1(?=[^\W\d_])", "l", text)
    text = re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "o", text)
    text = re.sub(r"(?<=[^\W\d_])5(?=[^\W\d_])", "s", text)
    legal = ""
    for pattern, code in LEGAL:
        if pattern.search(text) and not legal:
            rest = pattern.sub(" ", text, count=1)
            if re.search(r"[^\W\d_]{2}", rest):
                text, legal = rest, code
    if "@" in text:
        text = text.split("@")[0]
    if re.fullmatch(r"[^\W\d_]+(?:[._][^\W\d_-]+(?:-[^\W\d_]+)*)+", text.strip()):
        text = re.sub(r"[._]", " ", text)
    parts = [p for p in text.split(",") if p.strip(" .")]
    if len(parts) == 2 and plain(parts[1].strip(" .")) not in GENERATIONS:
        parts = [parts[1], parts[0]]
    generation, tokens = "", []
    for raw in re.findall(r"[^\W\d_]+(?:['’-]+[^\W\d_]+)*\.?", " ".join(parts)):
        bare = raw.rstrip(".").replace("'", "").replace("’", "")
        if bare in GENERATIONS and tokens:
            generation = GENERATIONS[bare]
        elif bare in TITLES or raw in TITLES or all(p in TITLES for p in re.split("-", bare)):
            continue
        else:
            point = "." if raw.endswith(".") and len(bare) > 1 else ""
            tokens.append(("c~" if cyrillic else "") + re.sub("-+", "-", bare) + point)
    return f"{generation}|{legal}|{' '.join(tokens)}" if tokens else None


def words_of(form: str) -> list[str]:
    """The folded words of a form, parts of double names apart, without initials."""
    return [folded(p) for t in form.rsplit("|", 1)[1].replace("c~", "").split() for p in t.rstrip(".").split("-") if len(p) > 1]


def bound(n: int) -> int:
    """Edits allowed in a token of n letters."""
    return 0 if n <= 3 else 1 if n <= 7 else 2


class Trie:
    """Tokens as nested dictionaries; None holds what belongs to a whole token."""

    def __init__(self):
        self.root: dict = {}

    def add(self, token: str, what) -> None:
        node = self.root
        for c in token:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(what)

    def near(self, token: str, k: int) -> Iterator[list]:
        """What belongs to each token within k insertions, deletions, changes and swaps of neighbours.

        The automaton's states are bit masks: bit i of row d says that i letters of `token` are read with d edits.
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(token):
            masks[c] = masks.get(c, 0) | 1 << i
        full, accept = (1 << len(token) + 1) - 1, 1 << len(token)
        stack = [(self.root, [(1 << d + 1) - 1 & full for d in range(k + 1)], [0] * (k + 1))]
        while stack:
            node, rows, swap = stack.pop()
            for c, child in node.items():
                if c is None:
                    if rows[k] & accept:
                        yield child
                    continue
                mask = masks.get(c, 0)
                new = [(rows[0] & mask) << 1]
                for d in range(1, k + 1):
                    # the letter fits, is too much, stands for another, or is the second of a swap; or one is missing
                    one = (rows[d] & mask) << 1 | rows[d - 1] | rows[d - 1] << 1 | (swap[d - 1] & mask) << 2
                    new.append((one | new[d - 1] | new[d - 1] << 1) & full)
                if new[k]:
                    # starts whose next letter but one is this one: a swap if the following letter is the next one
                    stack.append((child, new, [r & mask >> 1 for r in rows]))


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two tokens, a swap of neighbours being one; most + 1 stands for more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return min(last[-1], most + 1)


#: Costs above all that the parts of two names may add up to, and above any number of these.
MUCH, NEVER = 1e3, 1e9


def assignment(costs: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of least cost (Hungarian method); not more rows than columns."""
    n, m = len(costs), len(costs[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            done[j] = True
            delta, to = float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    c = costs[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


class Matcher:
    """Whether two forms mean the same, by permutations of their tokens."""

    def __init__(self, nicknames: dict[str, frozenset[str]], common: int):
        self.nicknames, self.common = nicknames, common
        self.givens = sorted({g for gs in nicknames.values() for g in gs})
        self._guessed: dict[str, frozenset[str]] = {}

    def _given(self, word: str) -> frozenset[str]:
        """The given names that a short form, or a misspelt given name, stands for."""
        if word in self.nicknames:
            return self.nicknames[word]
        if word not in self._guessed:
            if len(self._guessed) > 100_000:
                self._guessed.clear()
            self._guessed[word] = frozenset(g for g in self.givens if len(word) >= 4 and distance(word, g, 1) <= 1)
        return self._guessed[word]

    def _same_word(self, a: str, b: str, df: dict[str, int], cyrillic: bool) -> float | None:
        """Cost of taking word a for word b; None where it can't be. 0: equal, below 1: a known short form, else edits."""
        if a == b:
            return 0.0
        fa, fb = folded(a), folded(b)
        if cyrillic and fa == fb:
            return 0.0
        if self.nicknames.get(fa, frozenset([fa])) & self.nicknames.get(fb, frozenset([fb])):
            return 0.1
        if not (fa in self.nicknames and fb in self.nicknames) and self._given(fa) & self._given(fb):
            return 1.0 if fa in self.nicknames or fb in self.nicknames else 1.5
        na, nb = df.get(fa, 1), df.get(fb, 1)
        short, long = sorted((fa, fb), key=len)
        n_long = df.get(long, 1)
        if 3 <= len(short) <= len(long) - 2 and n_long >= self.common and df.get(short, 1) < n_long and (long.startswith(short) or long.endswith(short)):
            return 0.2
        k = bound(min(len(fa), len(fb)))
        if len(short) >= 6 and max(na, nb) >= self.common and min(na, nb) * 50 <= max(na, nb) and fa[0] == fb[0]:
            k = 2  # a rare spelling of a word of common use
        d = distance(fa, fb, 2) if cyrillic else distance(a, b, 2)
        if not 0 < d <= k:
            return None
        less, more = sorted((na, nb))
        # two spellings that several scopes use are two names
        return float(d) if less <= 1 or less * 8 <= more and (d == 1 or less * 20 <= more) else None

    def _begins(self, initial: str, word: str, cyrillic: bool) -> bool:
        """An initial of the word or of a given name that the word is a short form of."""
        if word[0] == initial or cyrillic and folded(word)[0] == folded(initial)[0]:
            return True
        return any(g[0] == folded(initial) for g in self.nicknames.get(folded(word), ()))

    def match(self, x: str, y: str, df: dict[str, int]) -> str | None:
        """'same', 'x' or 'y' (the one that says less and fits the other), or None."""
        gx, lx, tx = x.split("|")
        gy, ly, ty = y.split("|")
        if gx != gy or (lx and ly and lx != ly):
            return None
        cyrillic = ("c~" in tx) != ("c~" in ty)
        tx, ty = tx.replace("c~", "").split(), ty.replace("c~", "").split()
        px = [(p, t.endswith("."), "-" in t) for t in tx for p in t.rstrip(".").split("-")]
        py = [(p, t.endswith("."), "-" in t) for t in ty for p in t.rstrip(".").split("-")]
        said = lambda ps: (len(ps), sum(len(p[0]) > 1 for p in ps))
        swapped = said(px) > said(py)
        small, large = (py, px) if swapped else (px, py)
        if not small:
            return None
        best: tuple | None = None

        # an abbreviation may stand for more than one word of common use, as for all of a trade
        shortened = any(p[1] for p in px) != any(p[1] for p in py)

        def fit(i: int, j: int) -> tuple[float, int, int, int] | None:
            """What it takes to let part i stand for part j: (cost, initials, words, letters); None where it can't."""
            (t, abbreviated, _), (u, short_u, _) = small[i], large[j]
            if len(t) == 1 or len(u) == 1:
                if t == u:
                    return 0.0, 0, 0, 0
                return (0.0, 1, 0, 0) if len(t) + len(u) > 2 and self._begins(*sorted((t, u), key=len), cyrillic) else None
            if (abbreviated and u.startswith(t) or short_u and t.startswith(u)) and min(len(t), len(u)) >= 3:
                return 0.3, 0, 1, min(len(t), len(u))
            c = self._same_word(t, u, df, cyrillic)
            return None if c is None else (c, 0, 1, min(len(t), len(u)))

        def place(i: int, used: int, cost: float, initials: int, words: int, letters: int, dropped: int) -> None:
            nonlocal best
            if i == len(small):
                rest = [p for j, p in enumerate(large) if not used >> j & 1]
                # words left over weigh more than initials that stand for words
                weight = (sum(len(p[0]) > 1 and not p[2] for p in rest), cost + initials + dropped, len(rest))
                if best is None or weight < best[6]:
                    best = (cost, initials, words, letters, rest, dropped, weight)
                return
            for j in range(len(large)):
                if not used >> j & 1 and (got := fit(i, j)) is not None:
                    c, n, w, m = got
                    place(i + 1, used | 1 << j, cost + c, initials + n, words + w, letters + m, dropped)
            if len(small[i][0]) == 1 and not dropped:  # a middle initial that the other leaves out
                place(i + 1, used, cost, initials, words, letters, 1)

        def assign() -> None:
            """place() for long names: the same weights as one assignment of least cost, in a time polynomial in the parts."""
            nonlocal best
            costs = []
            for i in range(len(small)):
                row = [fit(i, j) for j in range(len(large))]
                if len(small[i][0]) > 1 and not any(row):
                    return
                # a word left over weighs more than all that the others may cost; the last column is the initial left out
                whole = [len(p[0]) > 1 and not p[2] for p in large]
                costs.append([NEVER if f is None else f[0] + f[1] - MUCH * w for f, w in zip(row, whole, strict=True)] + [1.0 + 1e-6 if len(small[i][0]) == 1 else NEVER])
            to = assignment(costs)
            if any(costs[i][j] >= NEVER for i, j in enumerate(to)):
                return
            fits = [fit(i, j) for i, j in enumerate(to) if j < len(large)]
            cost, initials, words, letters = (sum(f[n] for f in fits) for n in range(4))
            rest = [p for j, p in enumerate(large) if j not in to]
            best = (cost, initials, words, letters, rest, int(len(large) in to), ())

        if len(large) <= 6:
            place(0, 0, 0.0, 0, 0, 0, 0)
        else:
            assign()
        if best is None:
            return None
        cost, initials, words, letters, rest, dropped, _ = best
        rest_words, rest_initials = [p for p in rest if len(p[0]) > 1], [p for p in rest if len(p[0]) == 1]
        if shortened:
            rest_words = [p for p in rest_words if df.get(folded(p[0]), 1) < self.common]
        if words == 0 or letters < 4 or cost >= (4 if letters >= 14 else 3 if letters >= 9 else 2):
            return None
        if dropped and rest_initials:  # two different middle initials
            return None
        if initials > 1 or len(rest_initials) > 1 or (rest_words and not all(p[2] for p in rest_words)):
            return None
        total = sum(len(p[0]) > 1 for p in large)
        if words == 1 and total == 1 and initials == 0:
            return "same" if len(large) == len(small) and not dropped else None
        if words == 1 and initials == 0:
            return None
        weaker = "y" if swapped else "x"
        if initials:
            sx, sy = sum(len(p[0]) > 1 for p in px), sum(len(p[0]) > 1 for p in py)
            return None if rest_words else "x" if sx < sy else "y" if sy < sx else None
        return weaker if rest_words else "same"


def nickname_map(pairs: list[tuple[str, str]], nicknames: str = NICKNAMES) -> dict[str, frozenset[str]]:
    """Each form's given names, folded; a given name belongs to itself."""
    known: dict[str, set[str]] = {}
    for line in filter(str.strip, nicknames.replace("\n", " ").split(";")):
        given, forms = line.split(":")
        for form in forms.split():
            known.setdefault(folded(plain(form)), set()).add(folded(plain(given.strip())))
    for form, given in pairs:
        known.setdefault(folded(plain(form)), set()).add(folded(plain(given)))
    for given in {g for gs in known.values() for g in gs}:
        known.setdefault(given, set()).add(given)
    for form in known:
        if len(form) > 4 and form not in {g for gs in known.values() for g in gs}:
            known[form].add(form)
    return {k: frozenset(v) for k, v in known.items()}


def _shards(token: str) -> list[tuple[str, str]]:
    """(shard, role) of a token in a scope too large for one trie: two tokens within their bound share a shard.

    One edit leaves the first or the last letters alone. Two leave the first, the last or the middle ones, as these
    lie apart and a swap breaks only one of them; the middle may have moved. Lengths at a limit belong to both sides.
    """
    n = len(token)
    out = []
    # the longest of each kind only wait for shorter ones: among themselves they meet in the next kind
    for kind, size, fits, last in (("1", 1, n <= 5, 5), ("2", 2, 5 <= n <= 7, 7), ("3", 3, 7 <= n <= 8, 8)):
        if fits:
            role = "index" if n == last else "both"
            out += [(f"P{kind}" + token[:size], role), (f"S{kind}" + token[-size:], role)]
    for kind, size, fits in (("2", 2, 8 <= n <= 13), ("3", 3, n >= 12)):
        if fits:
            middle = (n - size) // 2
            out += [(f"p{kind}" + token[:size], "both"), (f"s{kind}" + token[-size:], "both"), (f"m{kind}" + token[middle : middle + size], "index")]
            out += [(f"m{kind}" + token[i : i + size], "query") for i in range(max(0, middle - 3), min(n - size + 1, middle + 4))]
    return out


def parts_of(form: str) -> list[tuple[str, bool]]:
    """(folded part, abbreviated) of a form; initials are parts of one letter."""
    return [(folded(p) if len(p) > 1 else folded(p)[:1], t.endswith(".")) for t in form.rsplit("|", 1)[1].replace("c~", "").split() for p in t.rstrip(".").split("-") if p]


def exact_keys(word: str, abbreviated: bool, common: bool, matcher: Matcher) -> list[tuple[str, str]]:
    """(key, role) of a word that may stand for another though they aren't within the bound.

    A short form and its given name share the given name; an abbreviation and its word, or a part and the whole of a
    word of common use, share three letters; of such two one has to be the abbreviation or the word of common use.
    """
    out = [("=" + g, "index" if word == g else "both") for g in matcher._given(word)]
    if len(word) >= 3:
        out.append(("<" + word[:3], "both" if abbreviated or common else "index"))
        out.append((">" + word[-3:], "both" if common else "index"))
    return out


def second_keys(form: str, anchor: str, counts: dict[str, int], matcher: Matcher) -> list[tuple[str, str]]:
    """(key, role) of all parts of a form but the one it is found by: two forms that match share one of these too.

    A match takes two words or a word and an initial, unless both names are single words. The keys of words are those
    by which words are found at all; of initials, their letter, for which words only wait.
    """
    parts = parts_of(form)
    keys = [exact_keys(w, a, counts.get(w, 1) >= matcher.common, matcher) if len(w) > 1 else [] for w, a in parts]
    own = next((k for k, (w, _) in enumerate(parts) if w == anchor or any(x == anchor for x, _ in keys[k])), None)
    out = {(".", "both"): None} if sum(len(w) > 1 for w, _ in parts) == 1 else {}
    for k, (w, _) in enumerate(parts):
        if k != own and len(w) == 1:
            out["i" + w, "both"] = None
        elif k != own:
            out |= dict.fromkeys([("i" + x[0], "index") for x in (w, *matcher.nicknames.get(w, ()))] + _shards(w) + keys[k])
    return list(out)


def name_forms_of(df: DataFrame, key: str, scope: str, name: str) -> DataFrame:
    """(key, scope, form) for each row with a scope and a name that has letters."""
    rows = df.select(col(df, key).alias("key"), col(df, scope).alias("scope"), col(df, name).alias("name")).where("scope is not null and name is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}
        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            forms = []
            for n in batch["name"]:
                if n not in known:
                    known[n] = parse(n)
                forms.append(known[n])
            yield batch.assign(form=forms)[["key", "scope", "form"]]

    kinds = rows.schema
    schema = T.StructType([T.StructField("key", kinds["key"].dataType), T.StructField("scope", kinds["scope"].dataType), T.StructField("form", T.StringType())])
    return rows.mapInPandas(run, schema).where("form is not null")


def _link_sorted(batches: Iterator[pd.DataFrame], matcher: Matcher) -> Iterator[pd.DataFrame]:
    """Rows sorted by (scope, shard): a trie for each, joined with itself."""
    held: list[tuple] = []
    current = None

    def flush() -> pd.DataFrame | None:
        out = _join_shard(held, matcher, current[1]) if len({r[0] for r in held}) > 1 else []
        return pd.DataFrame([(current[0], *x) for x in out], columns=["scope", "a", "b", "kind"]) if out else None

    for batch in batches:
        for scope, shard, role, role2, token, i, form, counts in zip(*(batch[c] for c in ("scope", "shard", "role", "role2", "token", "id", "form", "counts")), strict=True):
            if (scope, shard) != current:
                if (got := flush() if held else None) is not None:
                    yield got
                held, current = [], (scope, shard)
            held.append((i, form, token, counts, role, role2))
    if (got := flush() if held else None) is not None:
        yield got


def _join_shard(rows: list[tuple], matcher: Matcher, shard: str) -> list[tuple[int, int, str]]:
    """Links among the forms of a shard; the shard without a name holds all forms of a scope, by their words only."""
    trie, queries, df, exact = Trie(), {}, {}, {}
    forms: dict[int, str] = {}
    # a form may come under two roles of the second key; it acts if it may under one
    acts = {r[0] for r in rows if r[5] != "index"}
    if not acts:
        return []
    for i, form, token, counts, role, _ in rows:
        if i not in forms:
            forms[i] = form
            for word, n in zip(words_of(form), counts, strict=True):
                df[word] = n
        if token[0] in "=<>":
            exact.setdefault(token, []).append((i, form, role))
            continue
        if role != "query":
            trie.add(token, (i, form, token))
        if role != "index":
            queries.setdefault(token, []).append((i, form))
    if not shard:
        for i, form in forms.items():
            for word, abbreviated in parts_of(form):
                if len(word) > 1:
                    for key, role in exact_keys(word, abbreviated, df.get(word, 1) >= matcher.common, matcher):
                        exact.setdefault(key, []).append((i, form, role))
    # equal tokens share all their shards and are compared in those of their first letters
    others = shard[:1] in ("S", "s", "m")
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen, weak = set(), set()

    def check(i: int, x: str, j: int, y: str) -> None:
        pair = (i, j) if i < j else (j, i)
        if i == j or pair in seen:
            return
        seen.add(pair)
        got = matcher.match(x, y, df)
        if got == "same":
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        elif got:
            weak.add((i, j) if got == "x" else (j, i))

    for token, here in queries.items():
        for there in trie.near(token, bound(len(token))):
            if others and there[0][2] == token:
                continue
            some = [r for r in there if r[0] in acts]
            for i, x in here:
                for j, y, _ in there if i in acts else some:
                    check(i, x, j, y)
    for group in exact.values():
        some = [r for r in group if r[0] in acts]
        for i, x, role in group:
            if role == "both":
                for j, y, _ in group if i in acts else some:
                    check(i, x, j, y)
    strong = [(i, find(i), "same") for i in list(parent) if find(i) != i]
    return strong + [(i, j, "part") for i, j in weak]


LINKS = "scope {kind}, a long, b long, kind string"


def link_names(df: DataFrame, key: str = "dup_id", scope: str = "company_id", name: str = "full_name", short_forms: DataFrame | None = None, large: int = 500, hot: int = 300, share: float = 0.005, nicknames: str = NICKNAMES) -> DataFrame:
    """(key, scope, entity): rows of one scope with one entity mean the same person or organisation.

    Rows whose scope or name is null, empty or without letters are left out; equal rows get equal entities; an empty
    table gives an empty result. short_forms: a table (form, given_name), held in memory: it lists given names, not
    people. nicknames: further short forms, "given: form form; ...". large: a scope with more tokens than that is joined in several tries. hot: a trie of more
    rows than that, as those of a token that very many names of a scope share, is split again by the names' other
    parts. share: a token in that part of all scopes is common. Names that say less (an initial, one half of a double
    name) join an entity only if they fit exactly one. Any two names that `Matcher.match` accepts meet, unless all that
    they share are misspellings by two edits of common words of six or seven letters.
    """
    rows = cut(name_forms_of(df, key, scope, name))
    forms = rows.select("scope", "form").distinct().withColumn("id", F.xxhash64("scope", "form"))
    kind = rows.schema["scope"].dataType.simpleString()
    words = _words_udf(forms)
    per_token = words.select("scope", "token").distinct()
    counts = per_token.groupBy("token").agg(F.count("*").alias("n"))
    scopes = rows.select("scope").distinct().count()
    common = max(4, int(scopes * share))
    pairs = short_forms.select("form", "given_name").distinct().collect() if short_forms is not None else []
    matcher = Matcher(nickname_map([(r[0], r[1]) for r in pairs if r[0] and r[1]], nicknames), common)
    known = words.join(counts, "token").groupBy("scope", "id", "form").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "n"))).alias("tokens"))
    known = cut(known.select("scope", "id", "form", F.transform("tokens", lambda t: t["n"]).alias("counts"), F.transform("tokens", lambda t: t["token"]).alias("tokens")))
    sizes = known.groupBy("scope").agg(F.sum(F.size("tokens")).alias("size")).where(F.col("size") > large).select(F.col("scope").alias("__s"), F.lit(True).alias("__large"))
    # so many large scopes can't be more than all tokens / large
    placed = known.join(bounded_broadcast(sizes, 100_000, "large scopes"), F.col("scope") == F.col("__s"), "left").drop("__s")
    # every token joins, common ones too: two forms may share no other that is within the bound
    small = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit("").alias("shard"), F.lit("both").alias("role")))
    place = F.explode(F.when(F.col("__large"), _shard_udf(matcher)(F.when(F.col("__large"), F.col("form")), F.col("counts"))).otherwise(small)).alias("p")
    sharded = placed.select("scope", "id", "form", "counts", place).select("scope", "p.shard", "p.role", "p.token", "id", "form", "counts")
    # a shard with very many names is split by what else they hold
    full = cut(sharded.where("shard <> ''").groupBy("scope", "shard").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("scope", "shard", F.lit(True).alias("__hot")))
    marked = sharded.join(bounded_broadcast(full, 100_000, "hot shards"), ["scope", "shard"], "left")
    alone = F.array(F.struct(F.lit("").alias("key"), F.lit("both").alias("role")))
    second = F.explode(F.when(F.col("__hot"), _second_udf(matcher)(F.when(F.col("__hot"), F.col("form")), F.col("token"), F.col("counts"))).otherwise(alone)).alias("x")
    apart = marked.select("scope", "shard", "role", "token", "id", "form", "counts", second)
    sharded = apart.select("scope", F.when(F.col("x.key") == "", F.col("shard")).otherwise(F.concat_ws(" ", "shard", "x.key")).alias("shard"), "role", F.col("x.role").alias("role2"), "token", "id", "form", "counts")
    # a fixed number of tasks: these rows are few bytes but much work, and AQE would join them into a few tasks
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = sharded.repartition(tasks, "scope", "shard").sortWithinPartitions("scope", "shard").mapInPandas(lambda batches: _link_sorted(batches, matcher), LINKS.format(kind=kind))
    links = cut(links.distinct())
    part = connected_components(links.where("kind = 'same'"))
    node = forms.select("scope", "form", "id").join(part.withColumnRenamed("node", "id"), "id", "left").select("scope", "form", "id", F.coalesce("component", "id").alias("entity"))
    node = cut(node)
    # what says less joins the one entity it fits, if it is one
    entity_of = node.select("id", "entity")
    fits = links.where("kind = 'part'").join(entity_of.withColumnRenamed("id", "a").withColumnRenamed("entity", "ea"), "a").join(entity_of.withColumnRenamed("id", "b").withColumnRenamed("entity", "eb"), "b").where("ea <> eb")
    single = fits.groupBy("ea").agg(F.min("eb").alias("lo"), F.max("eb").alias("hi")).where("lo = hi")
    merged = connected_components(single.select(F.col("ea").alias("a"), F.col("lo").alias("b")))
    final = node.join(merged.withColumnRenamed("node", "entity").withColumnRenamed("component", "joined"), "entity", "left").select("scope", "form", F.coalesce("joined", "entity").alias("entity"))
    return rows.join(final, ["scope", "form"]).select(F.col("key").alias(key), F.col("scope").alias(scope), "entity")


def _words_udf(forms: DataFrame) -> DataFrame:
    """(scope, id, form, pos, token) for each word of each form."""
    split = F.pandas_udf(lambda s: s.map(words_of), T.ArrayType(T.StringType()))
    return forms.select("scope", "id", "form", F.posexplode(split("form")).alias("pos", "token"))


def _shard_udf(matcher: Matcher):
    """All (shard, role, token) of a form in a large scope: of its words and of the keys they share beyond the bound."""
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("token", "shard", "role")]))

    def places(form: str | None, counts) -> list[dict]:
        if form is None:
            return []
        out, n = {}, dict(zip(words_of(form), counts, strict=True))
        for word, abbreviated in parts_of(form):
            if len(word) > 1:
                out |= {(word, shard, role): None for shard, role in _shards(word)}
                out |= {(key, key, role): None for key, role in exact_keys(word, abbreviated, n.get(word, 1) >= matcher.common, matcher)}
        return [{"token": t, "shard": s, "role": r} for t, s, r in out]

    return F.pandas_udf(lambda f, c: pd.Series([places(*x) for x in zip(f, c, strict=True)], dtype=object), kind)


def _second_udf(matcher: Matcher):
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("key", "role")]))

    def keys(form: str | None, token: str, counts) -> list[dict]:
        return [{"key": k, "role": r} for k, r in second_keys(form, token, dict(zip(words_of(form), counts, strict=True)), matcher)] if form else []

    return F.pandas_udf(lambda f, t, c: pd.Series([keys(*x) for x in zip(f, t, c, strict=True)], dtype=object), kind)


def same_entity_pairs(linked: DataFrame, key: str = "dup_id", scope: str = "company_id") -> DataFrame:
    """(key_a, key_b): all pairs of rows of one entity, key_a < key_b."""
    a = linked.select(F.col(key).alias(f"{key}_a"), F.col(scope).alias("__s"), F.col("entity").alias("__e"))
    b = linked.select(F.col(key).alias(f"{key}_b"), F.col(scope).alias("__s"), F.col("entity").alias("__e"))
    return a.join(b, ["__s", "__e"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
