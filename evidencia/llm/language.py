"""Problem 3: the language of each document and of each stretch in another language, by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier predicts each bit. A sentence's bits are decoded by loss:
the language whose codeword loses least against the classifiers' margins, weighted by how reliable each bit is. The gap
to the runner-up gives the confidence; a small gap flags the sentence as ambiguous.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import col, hash_sample

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru")

# Other notations of the languages' names.
NOTATIONS = {
    "en": "en eng english englisch anglais inglés inglese inglês",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch francés francese",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "it": "it ita italian italiano italienisch italien",
    "pt": "pt por portuguese português portugues portugiesisch portugais",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais",
    "pl": "pl pol polish polski polnisch polonais",
    "ru": "ru rus russian русский russisch russe",
}
BY_NOTATION = {w: k for k, ws in NOTATIONS.items() for w in ws.split()}

MARK = re.compile(r"\[PDF page \d+\]")
BLANK = re.compile(r"\n\s*\n")
NOISE = re.compile(r"\S+\s?(?:[@＠]|&#64;|[(\[{]\s?at\s?[)\]}])\s?\S+(?:\s*[(\[{]\s?dot\s?[)\]}]\s*\S+)*|\S+\s+at\s+\S+\s+dot\s+\S+|\S*(?:://|www\.)\S*|\]\([^)\s]*\)", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?…:;])[\"'»”)]*\s+(?=[^\W\d_a-zà-ÿа-яёąćęłńóśźż]|[¿¡«\"„*#>-])|\n(?=\s*(?:[#*>|-]|\d+\.)\s)|\|")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def canonical(label: str | None) -> str | None:
    """The two letters a label stands for, or None: 'pt-BR', 'ger', 'Deutsch' and 'EN' are labels, 'und' is none."""
    head = re.split(r"[-_\s.]", (label or "").strip().lower())[0]
    return BY_NOTATION.get(head)


def label_language(label: Column) -> Column:
    """The same as a column, for the JVM."""
    head = F.element_at(F.split(F.lower(F.trim(label)), r"[-_\s.]"), 1)
    known = F.create_map(*[F.lit(x) for pair in BY_NOTATION.items() for x in pair])
    return F.element_at(known, head)


def codewords(n: int, bits: int = 15) -> np.ndarray:
    """n codewords of -1 and 1: rows of a Hadamard matrix without its constant column, at half the bits' distance."""
    h = np.array([[1]])
    while len(h) < bits + 1:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1 : bits + 1].astype(np.float32)


@dataclass
class Settings:
    """sample: labelled documents the classifiers are fitted on, at most; chars: of each of these, at most."""

    sample: int = 1000
    chars: int = 2500
    dims: int = 1 << 16
    grams: tuple[int, ...] = (1, 2, 3, 4, 5)
    bits: int = 15
    smooth: float = 0.3
    sure: float = 0.75
    #: A second language needs one sentence of so many words in small letters, decoded with such a share.
    proof_words: int = 5
    proof: float = 0.98
    languages: tuple[str, ...] = field(default=LANGUAGES)


def word_grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word between spaces, and where each word's begin."""
    padded = [f" {w} " for w in words]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, padded), np.int64, len(padded)))
    ids, owners = [], []
    for n in s.grams:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n * 0x9E3779B1, np.uint64)
        for i in range(n):
            h = (h ^ flat[i : len(flat) - n + 1 + i]) * np.uint64(0x100000001B3)
        inside = owner[: len(h)] == owner[n - 1 :]
        ids.append(((h ^ (h >> np.uint64(29))) % np.uint64(s.dims)).astype(np.int32)[inside])
        owners.append(owner[: len(h)][inside])
    at, who = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return at[order], np.searchsorted(who[order], np.arange(len(words)))


class Model:
    """Weights of the binary classifiers, codewords and how far each bit is to be trusted.

    A sentence's margins are the sums of its words' margins, so each word is looked at once and kept, up to a bound.
    """

    KEEP = 100_000

    def __init__(self, settings: Settings):
        self.s = settings
        self.code = codewords(len(settings.languages), settings.bits)
        self.w = np.zeros((settings.dims, settings.bits), np.float32)
        self.trust = np.ones(settings.bits, np.float32)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.vectors = np.zeros((0, self.s.bits + 1), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": {}, "vectors": self.vectors[:0]}

    def fit(self, texts: list[list[str]], labels: list[str], documents: list[int]) -> Model:
        """Fit on sentences' words, their documents and the documents' labels, some of which are wrong.

        After the first round a document's label gives way to the language its sentences vote for, and a long sentence
        that is surely in another language than its document's gets its own label.
        """
        number = {k: i for i, k in enumerate(self.s.languages)}
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        at, starts = word_grams(list(vocabulary), self.s)
        grams = np.diff([*starts, len(at)])
        flat = np.array([vocabulary[w] for t in texts for w in t])
        words = np.array([len(t) for t in texts])
        y, doc = np.array([number[x] for x in labels]), np.array(documents)
        for last in (False, False, True):
            classes = np.repeat(y, words)
            counts = np.stack([np.bincount(at, np.repeat(np.bincount(flat[classes == c], minlength=len(vocabulary)), grams), self.s.dims) for c in range(len(number))])
            p = (counts + self.s.smooth) / (counts.sum(1, keepdims=True) + self.s.smooth * self.s.dims)
            for b in range(self.s.bits):
                one = self.code[:, b] > 0
                self.w[:, b] = np.log(p[one].mean(0)) - np.log(p[~one].mean(0))
            self._forget()
            margin, sizes = self._margins(texts)
            error = np.clip(1 - (margin * self.code[y] > 0).mean(0), 1e-3, 0.49)
            self.trust = np.log((1 - error) / error).astype(np.float32)
            self.trust /= self.trust.mean()
            if not last:
                best, share = self._decode(margin, sizes)
                votes = np.zeros((doc.max() + 1, len(number)))
                np.add.at(votes, doc, share * np.minimum(words, 40)[:, None])
                main = votes.argmax(1)[doc]
                y = np.where((best != main) & (share[np.arange(len(y)), best] >= self.s.proof) & (words >= 8), best, main)
        return self

    def _margins(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of all bits and the number of n-grams for each text, a list of words that isn't empty."""
        if len(self.index) > self.KEEP:
            self._forget()
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.index))
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            at, starts = word_grams(part, self.s)
            sums = np.add.reduceat(self.w[at], starts, axis=0)
            self.index |= {w: len(self.vectors) + k for k, w in enumerate(part)}
            self.vectors = np.vstack([self.vectors, np.c_[sums, np.diff([*starts, len(at)])].astype(np.float32)])
        index = self.index
        flat = np.fromiter((index[w] for t in texts for w in t), np.int64)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        total = np.add.reduceat(self.vectors[flat], starts, axis=0)
        return total[:, :-1], total[:, -1]

    def _decode(self, margin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and the probability-like share of all languages, by logistic loss of scaled margins."""
        z = margin / np.sqrt(np.maximum(sizes, 1))[:, None]
        # log(1 + e**-cz) is log(1 + e**z) less z where c is 1: one logarithm for both signs, and a product
        soft = np.logaddexp(0, z)
        loss = (soft * self.trust).sum(1, keepdims=True) - (z * self.trust) @ ((self.code.T + 1) / 2)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), share / share.sum(1, keepdims=True)

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and shares of all languages for each text, a list of words that isn't empty."""
        if not texts:
            return np.zeros(0, int), np.zeros((0, len(self.s.languages)))
        return self._decode(*self._margins(texts))


def tidy(text: str) -> str:
    """Joined hyphenated words, one kind of space, ligatures spelt out; addresses of mail and web left out."""
    text = text.replace("\r", "")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "-\n" in text:
        text = re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "", text)
    return NOISE.sub(" ", text) if any(x in text for x in ("@", "://", "www.", "](", "&#64;", "at)", "at]", "at}", "dot")) else text


def sentences(paragraph: str) -> list[str]:
    if "[" in paragraph:
        paragraph = MARK.sub("\n- ", paragraph)
    return [s.strip() for s in SENTENCE.split(paragraph) if s and not s.isspace()]


def letters_in(paragraph: str) -> int:
    return sum(map(str.isalpha, MARK.sub("", paragraph)))


def content(words: list[str]) -> list[str]:
    """A sentence's words in small letters without capitalised ones inside it, mostly names, if enough is left.

    The first word goes too if the next is capitalised, as in a full name, and five words remain.
    """
    kept = [w.lower() for i, w in enumerate(words) if i == 0 or not w[:1].isupper()]
    if len(kept) >= 6 and words[0][:1].isupper() and words[1][:1].isupper():
        del kept[0]
    return kept if len(kept) >= 3 else [w.lower() for w in words]


def is_full(sentence: str, words: int, plain: int) -> bool:
    """Ends like a sentence and has a few words, most of them not names or labels."""
    return words >= 3 and plain >= 2 and plain * 2 >= words - 2 and sentence.rstrip("\"'»”)* ").endswith((".", "!", "?", "…", ":", ";"))


def fit_model(samples: DataFrame, *labelled: tuple[DataFrame, str, str, str], settings: Settings | None = None, text: str = "text", lang: str = "lang") -> Model:
    """Fit on the labelled samples and, of each labelled table, at most settings.sample rows chosen by their key's hash.

    labelled: (table, key, text, label). Labels may be wrong; rows of unknown label, null or blank text are left out.
    Collects bounded samples only; of a text longer than settings.chars its beginning serves for fitting.
    """
    s = settings or Settings()
    own = samples.select(col(samples, text).alias("t"), col(samples, lang).alias("l"))
    rows = [tuple(r) for r in hash_sample(own, F.struct("t", "l"), s.sample).collect()]
    for table, key, body, label in labelled:
        known = table.select(F.substring(col(table, body), 1, s.chars).alias("t"), label_language(col(table, label)).alias("l"), col(table, key).alias("k"))
        sample = hash_sample(known, F.struct("k", "l"), s.sample).where("l is not null and trim(t) <> ''")
        rows += [tuple(r) for r in sample.select("t", "l").collect()]
    texts, labels, documents = [], [], []
    for n, (t, raw) in enumerate(rows):
        label = canonical(raw)
        if label in s.languages and t:
            for sentence in sentences(tidy(t)):
                if len(words := WORD.findall(sentence)) >= 3:
                    texts.append(content(words))
                    labels.append(label)
                    documents.append(n)
    return Model(s).fit(texts, labels, documents) if len(set(labels)) > 1 else Model(s)


SCHEMA = "key {kind}, para_no int, lang string, confidence double, ambiguous boolean, mixed boolean"


def segment(df: DataFrame, model: Model, key: str = "page_id", text: str = "markdown", least_letters: int = 40) -> DataFrame:
    """(key, para_no, lang, confidence, ambiguous, mixed): row 0 of each page, and the stretches of a page in several languages.

    Row 0 is the page's main language; mixed tells whether it has more than one. Stretches are the rows (paragraph,
    language) in which at least one full sentence of that language stands. Null, empty and blank texts and
    texts without letters give no row. Repeated rows give repeated results.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(col(df, key).alias("key"), col(df, text).alias("text")).where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for i in range(0, len(batch), 500):
                yield _segment_batch(batch.iloc[i : i + 500], m, least_letters)

    kind = df.schema[key].dataType.simpleString()
    return source.mapInPandas(run, SCHEMA.format(kind=kind))


COLUMNS = ["key", "para_no", "lang", "confidence", "ambiguous", "mixed"]


def _segment_batch(batch: pd.DataFrame, m: Model, least_letters: int) -> pd.DataFrame:
    every: list[list[str]] = []
    words: list[int] = []
    plain: list[int] = []
    cyrillic: list[bool | None] = []
    pages = []  # (key, [(para_no, paragraph, [(index of sentence, full?)])])
    for key, text in zip(batch["key"], batch["text"], strict=True):
        paragraphs = []
        for no, p in enumerate(BLANK.split(text.replace("\r\n", "\n")), 1):
            found = []
            for sentence in sentences(tidy(p)):
                if ws := WORD.findall(sentence):
                    n, small = len(ws), sum(w[0].islower() for w in ws)
                    found.append((len(every), is_full(sentence, n, small)))
                    every.append(content(ws))
                    words.append(n)
                    plain.append(small)
                    of = {"а" <= c <= "я" or c == "ё" for c in sentence.lower() if c.isalpha()}
                    cyrillic.append(of.pop() if len(of) == 1 else None)
            paragraphs.append((no, p, found))
        pages.append((key, paragraphs))
    best, share = m.score(every)
    weights = np.minimum(np.array(words), 40)[:, None]
    weighed, logs = share * weights, np.log(share + 1e-4) * weights
    top, best = share.max(1, initial=0).tolist(), best.tolist()
    rows = []
    langs = m.s.languages
    for key, paragraphs in pages:
        index = [i for _, _, found in paragraphs for i, _ in found]
        if not index:
            continue
        votes, total = weighed[index].sum(0), np.sort(logs[index].sum(0))
        main = int(votes.argmax())
        confidence = float(votes[main] / votes.sum())
        # a second language is on the page if a long enough full sentence surely is in it, or a shorter one whose script
        # isn't that of the page's language, or if several shorter ones are long enough and sure enough together
        full = [i for _, _, found in paragraphs for i, whole in found if whole]
        proven = {best[i] for i in full if top[i] >= m.s.proof and plain[i] >= m.s.proof_words and words[i] > m.s.proof_words} | {main}
        other = {tuple(every[i]): i for i in full if best[i] not in proven and top[i] >= m.s.sure}
        for own in {best[i] for i in other.values()}:
            at = [i for i in other.values() if best[i] == own]
            russian = langs[own] == "ru"
            if russian != (langs[main] == "ru") and any(cyrillic[i] is russian for i in at):
                proven.add(own)
            elif len(at) > 1 and sum(plain[i] for i in at) >= m.s.proof_words and sum(words[i] for i in at) > m.s.proof_words:
                joint = np.exp((total_log := np.log(share[at] + 1e-4).sum(0)) - total_log.max())
                if joint[own] >= m.s.proof * joint.sum():
                    proven.add(own)
        stretches = _stretches(paragraphs, main, proven, best, top, share, m.s.sure) if len(proven) > 1 else []
        mixed = len({own for _, _, own, _ in stretches} | {main}) > 1
        rows.append((key, 0, langs[main], confidence, bool(confidence < m.s.sure or total[-1] - total[-2] < 1), mixed))
        if mixed:
            rows += [(key, no, langs[own], c, c < m.s.sure, True) for no, paragraph, own, c in stretches if letters_in(paragraph) >= least_letters]
    return pd.DataFrame(rows, columns=COLUMNS)


def _stretches(paragraphs: list, main: int, proven: set[int], best: list[int], top: list[float], share: np.ndarray, sure: float) -> list[tuple[int, str, int, float]]:
    """(para_no, paragraph, language, mean share) for each paragraph and each language with a full sentence in it."""
    out = []
    for no, paragraph, found in paragraphs:
        here: dict[int, list[float]] = {}
        for i, full in found:
            own, p = best[i], top[i]
            # without good reason a sentence is in the language of its page
            if own != main and (own not in proven or p < sure or p < 3 * share[i, main]):
                own, p = main, float(share[i, main])
            if full:
                here.setdefault(own, []).append(p)
        out += [(no, paragraph, own, sum(ps) / len(ps)) for own, ps in here.items()]
    return out


def wrong_labels(df: DataFrame, model: Model, key: str = "page_id", text: str = "markdown", label: str = "declared_lang") -> DataFrame:
    """Rows of `segment` that tell more than the label: row 0 of pages in one language whose label is missing or wrong,
    and the stretches of pages in several. key must be unique."""
    found = segment(df, model, key, text)
    labels = df.select(col(df, key).alias("key"), label_language(col(df, label)).alias("declared"))
    kept = found.join(labels, "key").where((~F.col("mixed") & (F.col("para_no") == 0) & ~F.col("lang").eqNullSafe(F.col("declared"))) | (F.col("mixed") & (F.col("para_no") > 0)))
    return kept.select(F.col("key").alias(key), "para_no", "lang", "confidence", "ambiguous")
