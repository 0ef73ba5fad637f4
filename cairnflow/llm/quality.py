"""Text quality statistics and the structural profile of each document.

Beside basic counts, a text is held against language prose profiles by the Jensen-Shannon
divergence (base 2, so between 0 and 1) of three distributions: letters, classes of
characters, and function words (in bands of frequency, all other words being one class).
The same divergences tell, for every block of lines of one form, whether it is language or
noise.  A text is then described by three distributions: the forms of its matter (running
text, entries of an enumeration, rows of cells, noise; half by lines and half by characters),
its classes of characters and its function words.  It gets the structural profile (prose,
list, table, junk) with the least weighted sum of the divergences of the three.

A map over the documents: no shuffle, no model beyond the fixed profiles below.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Letters per 1,000 of running text, a to z, accents folded.
LETTERS = {
    "en": [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1],
    "de": [69, 19, 31, 51, 171, 17, 30, 48, 76, 3, 12, 34, 25, 98, 29, 8, 1, 70, 78, 62, 50, 8, 19, 1, 1, 11],
    "fr": [82, 9, 36, 37, 172, 11, 9, 7, 78, 6, 1, 55, 30, 71, 58, 25, 14, 67, 79, 73, 64, 18, 1, 4, 3, 3],
    "es": [120, 14, 43, 50, 141, 7, 10, 7, 67, 5, 1, 50, 32, 70, 96, 25, 9, 69, 80, 46, 39, 11, 1, 2, 10, 5],
}
#: Function words of each language, the most frequent first.
FUNCTION_WORDS = {
    "en": "the of and to a in is that it for was on with as be by at not this are but from or have an we had i his they which "
    "he she you her were all has been will would their if so when no there can who what more its then than into them these "
    "could our only some any over after before while those because don t s although though once until both between through "
    "against during without within also just each every much many most other another same still became never nothing someone "
    "nobody otherwise yet since enough",
    "de": "der die und in das den von zu mit ist nicht ein eine sich auf für dem des als auch es an wird war aus er hat wir nur "
    "so bei im zum am noch nach sie oder aber wenn ich zur dass über um vor bis weil doch zwar zwischen erst sofern ab bevor "
    "obwohl wäre sonst statt gilt unter seit",
    "fr": "de la le et les des en un une du est que pour dans qui au par sur il a plus ne pas ce se l d n s c on avec ou son sa "
    "ses elle mais nous aux cette si sans tout où quand alors avant après était serait tant parce jamais",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus ni yo si sin este esta era "
    "cuando hasta desde sería mientras porque nunca vez",
}
#: Share of function words in prose, and the first rank of each band; a word's frequency falls as 1 / (rank + 2).
PROSE_SHARE, BANDS = 0.40, (0, 4, 16)
#: Words of the profile itself that are added to a text before it is held against it, and letters that count as a word.
PRIOR_WORDS, LETTERS_A_WORD = 6, 6


def _ranks(words: str) -> dict[str, int]:
    return {w: sum(k >= b for b in BANDS) - 1 for k, w in enumerate(dict.fromkeys(words.split()))}


_BAND_OF = {k: _ranks(v) for k, v in FUNCTION_WORDS.items()}
_WORDS_OF = {k: frozenset(v) for k, v in _BAND_OF.items()}
_ANY_FUNCTION_WORD = frozenset().union(*_WORDS_OF.values())
_LANGUAGES_OF = {w: [k for k in FUNCTION_WORDS if w in _WORDS_OF[k]] for w in _ANY_FUNCTION_WORD}


def _band_shares(bands: dict[str, int]) -> list[float]:
    mass = [0.0] * len(BANDS)
    for rank, band in enumerate(bands.values()):
        mass[band] += 1 / (rank + 2)
    return [x / sum(mass) for x in mass]


_BAND_SHARES = {k: _band_shares(v) for k, v in _BAND_OF.items()}
#: Shares of small and capital letters, digits, blanks, ordinary punctuation, joining and other signs.
CHARACTERS = {"prose": [0.76, 0.03, 0.025, 0.145, 0.025, 0.013, 0.002]}
#: The structural profiles: shares of running text, entries, cells and noise; of the classes of characters; of
#: function words among all words.
PROFILES = {
    "prose": ([0.85, 0.05, 0.05, 0.05], CHARACTERS["prose"], 0.40),
    "list": ([0.05, 0.85, 0.05, 0.05], [0.71, 0.04, 0.04, 0.14, 0.02, 0.04, 0.01], 0.15),
    "table": ([0.05, 0.05, 0.85, 0.05], [0.50, 0.04, 0.16, 0.15, 0.05, 0.05, 0.05], 0.05),
    "junk": ([0.05, 0.05, 0.05, 0.85], [0.40, 0.22, 0.17, 0.08, 0.04, 0.04, 0.05], 0.02),
}
#: Weights of the divergences of matter, characters and function words.
WEIGHTS = (0.7, 0.15, 0.15)
#: A piece of text with a letter divergence above this is noise; short pieces are granted more.
LETTER_LIMIT, LETTER_GRACE = 0.17, 9.0
#: The same for pieces whose function words diverge by more than this from those of the nearest language's prose.
WORDLESS_LIMIT, WORDLESS_GRACE, WORD_LIMIT = 0.11, 4.5, 0.11
#: Pairs of letters in which vowel and consonant alternate in languages, and the limit for pieces without function words.
ALTERNATION, ORDER_LIMIT, ORDER_GRACE = [0.72, 0.28], 0.016, 1.5
#: The same for the classes of characters of a piece that has no row or entry form.
CLASS_LIMIT, CLASS_CHARS = 0.20, 40
#: A text that shrinks below this share of its size is endless repetition.
REPETITION, REPETITION_CHARS = 0.13, 200

_WORD = re.compile(r"[^\W_]+")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: Bytes of UTF-8 with ASCII signs turned into blanks and ASCII capitals into small letters.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
_MARK = re.compile(r"\s*(?:[-*•–—+·▪◦‣►○●✓✗]|\d{1,3}[.)]|[A-Za-z][.)]|[ivxIVX]{1,5}[.)]|\(\w{1,3}\)|\[[ xX]\])\s+(?=\S)")
_RULE = re.compile(r"\s*[|+:][-+=|: ]{3,}[|+:]?\s*|\s*[-=]{3,}(?:\s+[-=]{3,})+\s*")
_RULED = re.compile(r"^[|+][-=+|: ]{6,}[|+]$", re.M)
_GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
_QUOTED = re.compile(r'"[^"\n]*"')
_ENDS, _CLOSING = tuple(".!?…:;,。！？"), "\"'”’»)]"
_HEADING = re.compile(r"\s*#{1,6}\s")
_INNER_STOP = re.compile(r"[.!?] +[A-ZÀ-Þ]")
_SENTENCE = re.compile(r"[.!?:;…]\s*$")
_LATIN1_DEBRIS = re.compile(r"[ÃÂâ][\x80-\xbf€-™¡-¿]|�|[─-▟]|[\x00-\x08\x0e-\x1f\x7f-\x9f]")
_DEBRIS_OPENS = re.compile(r"[ÃÂâ�─-▟\x00-\x08\x0e-\x1f\x7f-\x9f]")


def words_of(text: str) -> list[str]:
    """The words of a text: the runs of letters and digits, in small letters."""
    if text.isascii():
        return text.encode().translate(_SPACED).decode().split()
    lower = text.lower()
    signs = [c for c in set(_NOT_ASCII.findall(lower)) if not c.isalnum()]
    if len(signs) > 32:
        return _WORD.findall(lower)
    lower = lower.encode("utf-8", "surrogatepass").translate(_SPACED).decode("utf-8", "surrogatepass")
    for c in signs:
        lower = lower.replace(c, " ")
    return lower.split()


def divergence(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon divergence of two distributions, in bits."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            total += a * math.log2(a / m)
        if b > 0:
            total += b * math.log2(b / m)
    return max(0.0, total / 2)


def _normal(v: list[float]) -> list[float]:
    s = sum(v)
    return [x / s for x in v]


_LETTERS = {k: _normal(v) for k, v in LETTERS.items()}
_CHARACTERS = _normal(CHARACTERS["prose"])
_LANGUAGES = list(_LETTERS)
_LETTER_ROWS = np.array([_LETTERS[k] for k in _LANGUAGES])
_LETTER_ENTROPY = -(_LETTER_ROWS * np.log2(_LETTER_ROWS)).sum(axis=1)
_A_TO_Z = "abcdefghijklmnopqrstuvwxyz"


def _class_of(c: str) -> int:
    """0 small letter, 1 capital, 2 digit, 3 blank, 4 ordinary punctuation, 5 joining sign, 6 other sign."""
    if c.isalpha():
        return int(c.isupper())
    if c.isalnum():
        return 2
    if c.isspace():
        return 3
    return 4 if c in ".,;:!?'\"’”“«»" else 5 if c in "-_/()–—" else 6


_ASCII_CLASSES = np.zeros((7, 128), np.int64)
_ASCII_CLASSES[[_class_of(chr(c)) for c in range(128)], np.arange(128)] = 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _vowel_or_consonant(c: str) -> int:
    base = unicodedata.normalize("NFD", c.lower())[:1]
    return 0 if not ("a" <= base <= "z") else 1 if base in "aeiouy" else 2


_VOWELS = np.array([_vowel_or_consonant(chr(c)) for c in range(0x250)] + [0], np.uint8)
_ASCII_VOWELS = _VOWELS[:128].tobytes() + bytes(128)


@lru_cache(maxsize=65536)
def _folded(code: int) -> tuple[int, int]:
    """(class, place of the letter without accents in a to z, else a number outside) of a character."""
    c = chr(code)
    return _class_of(c), ord(unicodedata.normalize("NFD", c.lower())[:1]) - 97


def count_characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters of each class, letters a to z with accents folded)."""
    ascii_ = np.bincount(np.frombuffer(text.encode("ascii", "ignore"), np.uint8), minlength=128)
    classes, letters = _ASCII_CLASSES @ ascii_, ascii_[97:123] + ascii_[65:91]
    if not text.isascii():
        codes = _codes(text)
        for code, k in Counter(codes[codes > 127].tolist()).items():
            kind, at = _folded(code)
            classes[kind] += k
            if 0 <= at < 26:
                letters[at] += k
    return classes, letters


def letter_divergence(letters: np.ndarray) -> tuple[float, str, int]:
    """(divergence from the nearest language, that language, number of letters)."""
    n = int(np.add.reduce(letters))
    if not n:
        return 1.0, "", 0
    p = letters / n
    m = _LETTER_ROWS + p
    m /= 2
    own = p[p > 0]
    # the divergence is the entropy of the mixture less the mean of the entropies
    far = np.add.reduce(m * -np.log2(m), axis=1) - (_LETTER_ENTROPY - np.add.reduce(own * np.log2(own))) / 2
    k = int(far.argmin())
    return max(0.0, float(far[k])), _LANGUAGES[k], n


def letters_are_near(letters: np.ndarray, n: int) -> bool:
    """Whether ``n`` letters are within all letter limits for certain: half the triangular discrimination is never below the divergence."""
    if not n:
        return True
    expected = n * _LETTER_ROWS[0]
    apart = letters - expected
    return float(np.add.reduce(apart * apart / (letters + expected))) / 2 < WORDLESS_LIMIT * n + WORDLESS_GRACE


def class_shares(classes: np.ndarray) -> list[float]:
    """Shares of small and capital letters, digits, blanks, ordinary punctuation, joining and other signs."""
    small, capital, *rest = classes.tolist()
    if capital > 3 * small:  # a text in capitals
        small, capital = capital, small
    n = small + capital + sum(rest) or 1
    return [x / n for x in (small, capital, *rest)]


def is_noise(text: str) -> bool:
    """Whether a piece of text is no language: its letters or its classes of characters are far from prose."""
    if _broken(text, 25):
        return True
    classes, letters = count_characters(text)
    n = int(np.add.reduce(letters))
    far = 0.0 if letters_are_near(letters, n) else letter_divergence(letters)[0]
    if n >= 8 and far > LETTER_LIMIT + LETTER_GRACE / n or is_wordless(text, far, n):
        return True
    return len(text) >= CLASS_CHARS and divergence(class_shares(classes), _CHARACTERS) > CLASS_LIMIT


def is_wordless(text: str, far: float, n: int) -> bool:
    """Whether a piece of ``n`` letters has letters, or an order of letters, far from language and no function words either."""
    if not n or far <= WORDLESS_LIMIT + WORDLESS_GRACE / n and order_divergence(text) <= ORDER_LIMIT + ORDER_GRACE / n:
        return False
    count = Counter(words_of(text))
    total = max(sum(count.values()), n // LETTERS_A_WORD)
    return all(word_divergence(count, k, total) > WORD_LIMIT for k in _LANGUAGES)


def order_divergence(text: str) -> float:
    """Divergence of the pairs of letters inside words, told by whether vowel and consonant alternate, from those of language."""
    if text.isascii():
        kinds = text.encode().translate(_ASCII_VOWELS)
    else:
        kinds = _VOWELS[np.minimum(_codes(text), len(_VOWELS) - 1)].tobytes()
    change = kinds.count(b"\1\2") + kinds.count(b"\2\1")
    runs = kinds.count(b"\0\1") + kinds.count(b"\0\2") + (kinds[:1] > b"\0")
    pairs = len(kinds) - kinds.count(b"\0") - runs
    if not pairs:
        return 0.0
    share = change / pairs
    return divergence([share, 1 - share], ALTERNATION) if share < ALTERNATION[0] else 0.0


def _broken(text: str, one_in: int) -> bool:
    """Whether more than one of so many characters shows a broken encoding."""
    return not text.isascii() and bool(_DEBRIS_OPENS.search(text)) and len(_LATIN1_DEBRIS.findall(text)) * one_in > len(text)


def is_symbols(classes: np.ndarray) -> bool:
    """Whether hardly any letter or digit stands among the signs."""
    small, capital, digits, blanks, *_ = class_shares(classes)
    return small + capital + digits < 0.25 * (1 - blanks)


def _separators(line: str) -> dict[str, int]:
    bare = _QUOTED.sub("", line) if '"' in line else line
    return {
        "|": bare.count("|"),
        "\t": bare.count("\t"),
        ";": bare.count(";"),
        ",": bare.count(","),
        "  ": len(_GAPS.findall(bare.strip())) if "  " in bare else 0,
    }


def matter(text: str) -> dict[str, tuple[int, int]]:
    """(lines, characters) of running text, entries, cells, noise and fenced code."""
    lines, fence, paragraph = [], False, 0
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            fence = not fence
            lines.append((line, "code", paragraph))
        elif line.strip():
            lines.append((line, "code" if fence else "", paragraph))
        else:
            paragraph += 1
    opened = [x for x, kind, _ in lines if not kind]
    grid = _grid(opened)
    wordless = False
    if blobs := "\n".join(x for x in opened if _blob(x)):
        far, _, n = letter_divergence(count_characters(blobs)[1])
        wordless = is_wordless(blobs, far, n)  # together they tell more than one by one
    kinds, k = [], -1
    for line, kind, para in lines:
        if not kind:
            k += 1
            if k in grid or _RULE.fullmatch(line):
                kind = "cell"
            elif _MARK.match(line):
                kind = "entry"
            elif len(opened) > 1 and (_HEADING.match(line) or line.rstrip().endswith(":") and len(line) < 60):
                kind = "heading"
            elif _blob(line) and (wordless or is_noise(line)):
                kind = "prose"  # counted as noise below
            elif _at_most(line, 6) and not _SENTENCE.search(line) and not _function_words(line):
                kind = "short"
            else:
                kind = "prose"
        kinds.append((line, kind, para))
    running = Counter(para for _, kind, para in kinds if kind == "prose")
    shorts = Counter(para for _, kind, para in kinds if kind == "short")
    out = {k: [0, 0] for k in ("prose", "entry", "cell", "noise", "code", "heading")}
    by_kind: dict[str, list[str]] = {}
    for line, kind, para in kinds:
        if kind == "short":  # inside a wrapped paragraph a short line is running text
            kind = "prose" if running[para] * 3 >= shorts[para] * 2 else "entry"
        by_kind.setdefault(kind, []).append(line)
    for kind, mine in by_kind.items():
        noisy: set[str] = set()
        if kind in ("prose", "entry", "cell"):
            short = "\n".join(x for x in mine if len(x) < 200 and not _RULE.fullmatch(x))
            noisy = {x for x in mine if len(x) >= 200 and (_cells_are_noise(x) if kind == "cell" else is_noise(x))}
            if short and (is_noise(short) if kind == "prose" else _cells_are_noise(short)):
                noisy |= {x for x in mine if len(x) < 200}
        for x in mine:
            slot = out["noise" if x in noisy else kind]
            slot[0] += 1
            slot[1] += len(x.strip())
    return {k: tuple(v) for k, v in out.items()}


def _at_most(line: str, words: int) -> bool:
    return len(line.split(None, words)) <= words


def _blob(line: str) -> bool:
    return len(line) >= 60 and _at_most(line, 3)


def _grid(lines: list[str]) -> set[int]:
    """The lines that are rows of cells: the same separator, equally often, in most of them."""
    grid: set[int] = set()
    if len(lines) < 3:
        return grid
    counts = [_separators(x) for x in lines]
    for sep in ("|", "\t", ";", ",", "  "):
        have = Counter([c[sep] for c in counts if c[sep]])
        if not have:
            continue
        modal, rows = max(have.items(), key=lambda x: (x[1], x[0]))
        if rows < 3:
            continue
        if sep == "  " and modal >= 2:
            picked = {k for k, c in enumerate(counts) if c[sep]}
        else:
            picked = {k for k, c in enumerate(counts) if c[sep] == modal}
        if sep in ";," or modal == 1:
            picked = {k for k in picked if not _prose_like(lines[k])}
        if modal == 1 and len(picked) < 0.6 * len(lines):
            continue
        if len(picked) >= 3:
            grid |= picked
    return grid


def _cells_are_noise(text: str) -> bool:
    classes, letters = count_characters(text)
    far, _, n = letter_divergence(letters)
    return _broken(text, 8) or is_symbols(classes) or n >= 40 and far > 0.3 + LETTER_GRACE / n


def _function_words(line: str) -> bool:
    return bool(_INNER_STOP.search(line)) or any(
        w in _ANY_FUNCTION_WORD and len(w) > 1 for w in words_of(line)
    )


def _prose_like(line: str) -> bool:
    w = [x for x in words_of(line) if len(x) > 1]
    return len(w) >= 6 and sum(x in _ANY_FUNCTION_WORD for x in w) >= 0.12 * len(w)


def word_shares(count: dict[str, int], language: str, n: int) -> list[float]:
    """Shares of the bands of function words and of all other words among ``n`` words, with ``PRIOR_WORDS`` of prose added."""
    bands, found = _BAND_OF[language], [0] * len(BANDS)
    for w, k in count.items():
        if w in bands:
            found[bands[w]] += k
    shares = [PRIOR_WORDS * PROSE_SHARE * q + k for q, k in zip(_BAND_SHARES[language], found)]
    total = n + PRIOR_WORDS
    return [*(x / total for x in shares), 1 - sum(shares) / total]


def word_profile(language: str, share: float) -> list[float]:
    return [*(share * q for q in _BAND_SHARES[language]), 1 - share]


def word_divergence(count: dict[str, int], language: str, n: int) -> float:
    """Divergence of the function words of a text of ``n`` words from those of the language's prose."""
    return divergence(word_shares(count, language, n), _PROSE_WORDS[language])


_PROSE_WORDS = {k: word_profile(k, PROSE_SHARE) for k in FUNCTION_WORDS}
_STRUCTURES = {
    k: {lang: (_normal(m), _normal(c), word_profile(lang, share)) for lang in FUNCTION_WORDS} for k, (m, c, share) in PROFILES.items()
}


COLUMNS = (
    "n_words long, mean_word_length double, symbol_ratio double, punctuated_line_share double, "
    "common_word_share double, language string, letter_divergence double, class_divergence double, "
    "word_divergence double, kind string"
)


def measure(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``COLUMNS``."""
    if text is None or not text.strip():
        return (0, None, None, None, None, None, None, None, None, None)
    words = words_of(text)
    n = len(words)
    classes, letters = count_characters(text)
    total, blanks = int(classes.sum()), int(classes[3])
    lines = [x for x in text.splitlines() if x.strip()]
    count = Counter(words)
    known = {w: k for w, k in count.items() if w in _ANY_FUNCTION_WORD}
    common = sum(known.values())
    mine = dict.fromkeys(FUNCTION_WORDS, 0)
    for w, k in known.items():
        for lang in _LANGUAGES_OF[w]:
            mine[lang] += k
    best = max(mine, key=lambda k: (mine[k], k == "en"))
    far, nearest, n_letters = letter_divergence(letters)
    shares, bands = class_shares(classes), word_shares(known, best, n)
    return (
        n,
        sum(map(len, words)) / n if n else None,
        int(classes[4:].sum()) / (total - blanks),
        sum(x.rstrip().rstrip(_CLOSING).endswith(_ENDS) for x in lines) / len(lines),
        common / n if n else None,
        (best if mine[best] else nearest) or None,
        far if n_letters else None,
        divergence(shares, _CHARACTERS),
        divergence(bands, _PROSE_WORDS[best]),
        nearest_structure(matter_shares(text, count, n), shares, bands, best),
    )


def matter_shares(text: str, count: Counter, n: int) -> list[float]:
    """Shares of running text, entries, cells and noise of a text that is not blank."""
    if is_repetition(text, count, n):
        return [0.0, 0.0, 0.0, 1.0]
    m = matter(text)
    heading = m.pop("heading")
    m["prose"] = tuple(a + b for a, b in zip(m["prose"], m.pop("code")))
    n_lines, n_chars = (sum(v[i] for v in m.values()) for i in (0, 1))
    if not n_lines:
        m["prose"], n_lines, n_chars = heading, *heading
    return [m[k][0] / n_lines / 2 + m[k][1] / max(1, n_chars) / 2 for k in ("prose", "entry", "cell", "noise")]


def is_repetition(text: str, count: Counter, n: int) -> bool:
    """Whether a text goes on saying the same: it has few different words and shrinks to next to nothing."""
    if len(text) < REPETITION_CHARS or n >= 8 and len(count) >= 0.25 * n:
        return False
    data = text.encode("utf-8", "surrogatepass")
    return len(zlib.compress(data, 6)) < REPETITION * len(data)


def nearest_structure(forms: list[float], classes: list[float], words: list[float], language: str) -> str:
    """The profile with the least weighted sum of divergences of the three distributions."""
    nearest, least = "", math.inf
    for kind, profile in _STRUCTURES.items():
        matter_, *rest = profile[language]
        parts = [WEIGHTS[0] * divergence(forms, matter_)]
        if parts[0] >= least:  # the other two only add to it
            continue
        parts += (w * divergence(p, q) for w, p, q in zip(WEIGHTS[1:], (classes, words), rest))
        if sum(parts) < least:
            nearest, least = kind, sum(parts)
    return nearest


def text_quality(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and the statistics in ``COLUMNS`` of every row.

    ``kind`` is prose, list, table or junk.  Null, empty and blank texts have no words and
    null in all other columns, ``kind`` included.  Repeated rows and null ids are kept.  Extra
    columns are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *measure(t)) for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist())]
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, f"doc_id {dict(slim.dtypes)['doc_id']}, {COLUMNS}")
