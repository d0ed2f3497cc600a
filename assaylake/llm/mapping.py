"""Mapping free-entered values to a canonical list.

1. *Clean*: every value is brought to a plain form without annotations (Python, Arrow batches), so that the many ways to
   write one name become few distinct forms.
2. *Mentions*: an Aho-Corasick automaton of all names and aliases runs over the distinct forms; the longest
   non-overlapping mention wins.
3. *Token sets*: forms without an accepted mention go to token-set similarity: the weighted share of common tokens, which are the
   words in any order, or all letters as one where blanks moved. A word with typing errors, as many as its length allows, is common by
   its likeness, and the most similar name wins if it is similar enough. Only names that share one of a form's rarest words,
   and words that share one of its rarest letter triples, are looked at.

A list that is longer than one automaton should be is cut into shards by the first letters of its names; a form meets the
shards in which something that it holds could be listed. What the shards find is put together per form before anything is decided, so
the answers don't depend on the number of shards.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import log

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import HOT_SHARE, col, hot_keys
from assaylake.session import Scratch

UNMATCHED = "UNMATCHED"
#: Forms of names that one automaton holds; a longer list is cut into shards of about this size.
SHARD_ENTRIES = 50_000
#: Distinct forms that one task matches, unless there are fewer than the cores can share.
TASK_ROWS = 20_000
#: Letters of a name that decide its shard.
ANCHOR = 6
#: Rows from which on a form's answer is broadcast to its rows instead of joined by shuffle.
HOT_ROWS = 100_000
#: Share of all forms from which on a word counts less in token sets, see ``common_words``.
COMMON_SHARE = 1e-3
#: The least that a word counts, so that a name of common words alone can be found.
LEAST_WEIGHT = 0.01


@dataclass(frozen=True)
class Vocabulary:
    """What is known about the way values are typed. The default knows nothing and fits any list of names.

    ``annotations`` are patterns that are cut from the plain text, ``annotation_words`` words that typists add and that are in no
    name. ``generic_words`` may stand beside a name and name nothing themselves. ``different`` is a pattern that makes a text
    mean something that isn't listed. ``named`` tells a word that could name something. With ``whole`` a mention
    counts only if the rest of the text is generic. ``abbreviations`` stand for whole words, ``glued`` finds
    those between a number and a name. ``spellings`` sound alike. ``edits`` lists (letters, errors): typing errors allowed
    from that number of letters on; names in which ``fixed`` is found get none. ``similarity`` is the least weighted
    share of common words (intersection over union) of two token sets; a word with typing errors is common by its likeness, so 1 allows none. A word may
    be abbreviated to ``stem`` letters, 0: to none but ``abbreviations``. With ``weighted`` common words count less.
    """

    annotations: tuple[str, ...] = ()
    annotation_words: frozenset[str] = frozenset()
    generic_words: frozenset[str] = frozenset()
    different: str | None = None
    named: str = r"[^\W\d_]"
    whole: bool = False
    abbreviations: dict[str, str] = field(default_factory=dict)
    glued: str | None = None
    spellings: tuple[tuple[str, str], ...] = ()
    edits: tuple[tuple[int, int], ...] = ((5, 1), (10, 2))
    fixed: str | None = None
    similarity: float = 0.8
    stem: int = 3
    weighted: bool = True


# What instruments and typists add to a name of a compound, words of texts that name no compound,
# labels of isotope-labelled standards, abbreviations inside names, and spellings that sound alike.
COMPOUNDS = Vocabulary(
    annotations=(
        r"\[\s*\d?m\s*[+-][^\]]*\]\s*\d*[+-]*",  # adduct
        r"@\s*\d+(?:\.\d+)?(?:\s*min\b)?",  # retention time
        r"\brt\s*[:=]?\s*\d+\.\d+(?:\s*min\b)?",
        r"[\(\[]\s*f\s*\d+\s*[\)\]]",  # file number
        r"[\(\[]\s*ms\s*\d\s*[\)\]]",
    ),
    annotation_words=frozenset("cand candidate check cmpd confirmed dup duplicate id likely maybe ms ms1 ms2 ms3 msms neg pos poss possible possibly prelim prob probable probably putative qc rerun std tentative tbc verified".split()),
    generic_words=frozenset(
        "a an and analyte background band bead blank bleed blind carryover column compound contaminant control drift empty entry feature front general ghost in injection internal ion kolom leeg marker metabolite mix "
        "mixture na name nan niet no noise none not note notes null of on onbekend onbekende peak peaks pending piek pool qc reference ref see signal solvent spike standard std system tbd test the unbekannt unbekannte unidentified unk unknown void wash water zie".split()
    ),
    different=r"(?<![a-z0-9])(?:d\d{1,2}|2h\d{0,2}|\d{0,2}13c\d{0,2}|13c\d{0,2}|\d{0,2}15n\d{0,2}|15n\d{0,2}|18o\d?|deuterated|labell?ed|isotope)(?![a-z0-9])|\((?:is)\)|(?<![a-z0-9])is(?=\s+d\d)",
    named=r"[a-z]{3}|\d:\d",
    whole=True,
    abbreviations={"oh": "hydroxy", "me": "methyl", "keto": "oxo", "ac": "acid"},
    glued=r"(?<=\d)(?:oh|keto|me(?!th))(?=[a-z]{4})",  # as in 3OHbutyryl
    spellings=(("ph", "f"), ("th", "t"), ("y", "i"), ("k", "c"), ("hidroxil", "hidroxi"), ("oe", "e")),
    edits=((10, 2),),
    fixed=":",
    similarity=0.75,  # two errors in a name of ten letters of which two are missing
    stem=0,  # a shorter name is another compound
    weighted=False,
)

DASHES = dict.fromkeys(map(ord, "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad"), "-")
ASCII_RUN = re.compile(r"[a-z0-9]+(?::[0-9]+)?")
ANY_RUN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?::[0-9]+)?")
LATIN = re.compile(r"[\u00c0-\u024f\u1e00-\u1eff]")


def plain(text: str) -> str:
    """Compatibility forms, dashes and case made one, accents of Latin letters dropped; underscores are blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(DASHES)
        text = LATIN.sub(lambda m: "".join(c for c in unicodedata.normalize("NFD", m[0]) if not unicodedata.combining(c)), text)
    return text.casefold().replace("_", " ")


def runs_of(text: str) -> list[str]:
    """The runs of letters, marks and digits of a plain text, of any script; 18:1 is one run."""
    return ASCII_RUN.findall(text) if text.isascii() else ANY_RUN.findall(text)


def squeeze(text: str) -> str:
    """The letters, digits and digit colons of a plain text."""
    return "".join(runs_of(text))


def parts(squeezed: str) -> tuple[tuple[str, ...], str]:
    """The numbers of a squeezed name in order, and its letters."""
    return tuple(re.findall(r"\d+", squeezed)), re.sub(r"[\d:]", "", squeezed)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours (each place once); most + 1 if more.

    Equal beginnings never need an edit, so only the few ways past each difference are followed.
    """
    if a == b:
        return 0
    if most <= 0 or abs(len(a) - len(b)) > most:
        return most + 1
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[i:], b[i:]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    best = 1 + min(edits(a[1:], b[1:], most - 1), edits(a[1:], b, most - 1), edits(a, b[1:], most - 1))
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, 1 + edits(a[2:], b[2:], most - 1))
    return best


def triples(word: str) -> set[str]:
    """The letter triples of a word with its ends marked."""
    w = f"\x02{word}\x03"
    return {w[i : i + 3] for i in range(len(w) - 2)}


def letter_counts(word: str) -> int:
    """How often each of 32 classes of letters occurs, up to four times, one bit for each time. A typing error flips two bits at most."""
    out, counts = 0, [0] * 32
    for c in word:
        k = ord(c) & 31
        if counts[k] < 4:
            out |= 1 << (4 * k + counts[k])
            counts[k] += 1
    return out


#: Triples that one typing error can spoil.
SPOILT = 4


class Speller:
    """The words of a list that a word is within a number of typing errors of, found by their rarest common triples."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        self.known = set(self.words)
        self.counts = [letter_counts(w) for w in self.words]
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for t in triples(w):
                self.holders[t].append(i)

    def ready(self, word: str) -> tuple[str, list[str], int]:
        """A word with its triples, rarest first, and its letter counts, as ``near`` takes it."""
        return word, sorted(triples(word), key=lambda t: len(self.holders.get(t, ()))), letter_counts(word)

    def near(self, ready: tuple[str, list[str], int], errors: int) -> dict[str, int]:
        """{word: errors} of the words with at most that many errors."""
        word, own, mine = ready
        if not errors:
            return {word: 0} if word in self.known else {}
        # Of two words with no more errors, one of these rarest triples of the one is in the other, too.
        near = set().union(*[self.holders[t] for t in own[: SPOILT * errors + 1] if t in self.holders])
        counts, most = self.counts, 2 * errors
        return {w: d for i in near if (counts[i] ^ mine).bit_count() <= most and (d := edits(word, w := self.words[i], errors)) <= errors}


class Names:
    """How forms of names are built and compared; the same for values and for the list."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.annotations = re.compile("|".join(vocabulary.annotations)) if vocabulary.annotations else None
        self.different = re.compile(vocabulary.different) if vocabulary.different else None
        self.named = re.compile(vocabulary.named)
        self.glued = re.compile(vocabulary.glued) if vocabulary.glued else None
        self.fixed = re.compile(vocabulary.fixed) if vocabulary.fixed else None
        self.most = max((e for _, e in vocabulary.edits), default=0)

    def sound(self, letters: str) -> str:
        """Letters with like-sounding spellings made one, doubled letters single and a final e dropped."""
        if not self.v.spellings:
            return letters
        for a, b in self.v.spellings:
            letters = letters.replace(a, b)
        return re.sub(r"(.)\1+", r"\1", letters).removesuffix("e")

    def errors(self, letters: int) -> int:
        return max((e for n, e in self.v.edits if letters >= n), default=0)

    def forms(self, text: str) -> tuple[set[str], set[str]]:
        """Squeezed ways to write a plain name, as typed and with abbreviations written out, also with the part behind a comma in front; and its sorted word sets."""
        ways, v = [text], self.v
        if text.count(",") == 1:
            head, tail = text.split(",")
            ways.append(f"{tail} {head}")
        whole = {squeeze(w) for w in ways}
        long = ways
        if v.abbreviations:
            long = [re.sub(r"[a-z]+", lambda m: v.abbreviations.get(m[0], m[0]), w) for w in ways]
            squeezed = [squeeze(w) for w in long]
            whole.update(self.glued.sub(lambda m: v.abbreviations[m[0]], w) if self.glued else w for w in squeezed)
        words = {" ".join(sorted(s)) for w in long if len(s := set(runs_of(w))) > 1}
        return whole - {""}, words

    def clean(self, text: str | None, code: tuple[str, int] | None) -> tuple[str | None, list[str]]:
        """(plain form, codes in the text); the form is its runs with a comma kept, without annotations, or None if the text means something different."""
        t, codes = plain(text or ""), []
        if code and code[0].lower() in t:
            pattern = rf"(?<![^\W_]){code[0].lower()}[\s:\-.]*\d+(?![^\W_])"
            codes = [k for m in re.finditer(pattern, t) if (k := read_code(m[0], *code))]
            t = re.sub(pattern, " ", t)
        if self.annotations:
            t = self.annotations.sub(" ", t)
        if self.different and self.different.search(t):
            return None, codes
        drop = self.v.annotation_words
        pieces = [" ".join([r for r in runs_of(p) if r not in drop]) for p in t.split(",")] if "," in t else [" ".join([r for r in runs_of(t) if r not in drop])]
        return ",".join(pieces), codes


def code_pattern(keys: Sequence[str]) -> tuple[str, int] | None:
    """(prefix, digits) if all keys are one prefix of letters and the same number of digits."""
    shapes = {(m[1], len(m[2])) if (m := re.fullmatch(r"([A-Za-z]+)(\d+)", k)) else None for k in keys}
    return next(iter(shapes)) if len(shapes) == 1 else None


def read_code(text: str, prefix: str, digits: int) -> str | None:
    """A typed code in canonical form: any case, separators, missing or superfluous leading zeros, prefix optional."""
    m = re.fullmatch(rf"(?:{prefix}[\s:_\-.]*)?(\d+)", text.strip(), re.IGNORECASE)
    number = m and m[1].lstrip("0")
    return f"{prefix.upper()}{number.zfill(digits)}" if number and len(number) <= digits else None


# Kinds of forms in the index: squeezed names, sorted word sets, keys.
NAME, WORDS, KEY = "n", "w", "k"


class Mentions:
    """Automaton of squeezed names, and lookup of word sets and keys. Built of (kind, form, key) with unique forms."""

    def __init__(self, forms: Iterable[tuple[str, str, str]]):
        self.exact = {(kind, form): key for kind, form, key in forms}
        self.automaton = ahocorasick.Automaton()
        for (kind, form), key in self.exact.items():
            if kind == NAME:
                self.automaton.add_word(form, (len(form), key))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, names: Names, form: str, codes: Sequence[str]) -> list[tuple[str, int, int, str]]:
        """Everything in a clean form that is listed: (kind, first run, run behind the last, key). Keys count in the order of the text; whole forms that differ from the text have run 0 twice."""
        out = [(KEY, i, i, c) for i, c in enumerate(codes) if (KEY, c) in self.exact]
        runs = runs_of(form)
        joined, starts, ends, at = "".join(runs), {}, {}, 0
        if (NAME, joined) in self.exact:
            # The whole text is a name: no mention is longer.
            return [*out, (NAME, 0, len(runs), self.exact[NAME, joined])]
        for i, r in enumerate(runs):
            starts[at] = i
            at += len(r)
            ends[at] = i + 1
        if len(self.automaton):
            # A mention starts and ends with a run; what lies between its runs doesn't matter.
            for end, (n, key) in self.automaton.iter(joined):
                if end + 1 in ends and end + 1 - n in starts:
                    out.append((NAME, starts[end + 1 - n], ends[end + 1], key))
        whole, words = names.forms(form)
        out += [(kind, 0, 0, self.exact[kind, f]) for kind, fs in ((NAME, whole), (WORDS, words)) for f in fs if (kind, f) in self.exact]
        return out


def decide(names: Names, form: str, found: Sequence[tuple[str, int, int, str]]) -> tuple[str | None, bool]:
    """(key, whether token sets are to be asked) for a clean form and all that is listed in it; key None if the form names nothing at all."""
    if codes := sorted((i, k) for kind, i, _, k in found if kind == KEY):
        return codes[0][1], False
    runs, v = runs_of(form), names.v
    length = lambda a, b: sum(map(len, runs[a:b]))
    free, taken = set(range(len(runs))), []
    for kind, a, b, key in sorted(found, key=lambda f: (f[1] - f[2] == 0, -length(f[1], f[2]), f[1], f[3])):
        if kind == NAME and b > a and free.issuperset(range(a, b)):
            free.difference_update(range(a, b))
            taken.append((length(a, b), key))
    if taken and (not v.whole or all(runs[i] in v.generic_words for i in free)):
        # Two names in one text: the longer one is the value, a tie decides nothing.
        longest = {k for n, k in taken if n == taken[0][0]}
        return (taken[0][1] if len(longest) == 1 else UNMATCHED), False
    if not taken and not any(r not in v.generic_words and names.named.search(r) for r in runs):
        return None, False
    whole = {k for _, a, b, k in found if a == b}
    if whole:
        return (next(iter(whole)) if len(whole) == 1 else UNMATCHED), False
    return None, True


#: A number and a word of four letters or more that are written as one run.
JOINT = regex.compile(r"(?<=\d)(?=[^\W\d_]{4})|(?<=[^\W\d_]{4})(?=\d)")
#: Words whose partners a task remembers.
KEPT_WORDS = 10_000
#: What a word that only sounds alike counts less than the same word, and one that is spelt otherwise, in typing errors.
HEARD, SPELT = 0.05, 0.1


class Words:
    """The words of some token sets, by how they are spelt and by how they sound. Built of {word: sets}."""

    def __init__(self, names: Names, by_word: dict[str, list[tuple]]):
        self.names, self.by_word, self.sorted = names, by_word, sorted(by_word)
        self.written: dict[str, set[str]] = defaultdict(set)
        for w in by_word:
            self.written[w].add(w)
            self.written[names.sound(w)].add(w)
        self.speller = Speller(self.written)
        self.seen: dict[str, dict[str, float]] = {}

    def ways(self, word: str) -> list[list]:
        """[spelling, cost, None or what the speller takes] of a word as it sounds and as it is spelt."""
        if not self.names.v.spellings:
            return [[word, 0.0, None]]
        heard = self.names.sound(word)
        return [[word, SPELT, None]] if heard == word else [[heard, HEARD, None], [word, SPELT, None]]

    def within(self, word: str, ways: list[list], errors: int, letters: int) -> dict[str, float]:
        """Words of the list that a word may stand for with at most that many typing errors, with their likeness: 1 less the errors in so many letters."""
        names, out = self.names, {word: 1.0} if word in self.by_word else {}
        for way in ways:
            # A name may be longer than what is typed of it; its own length decides what it is allowed.
            w, most = way[0], errors
            while names.errors(len(w) + most) < most:
                most -= 1
            if most:
                way[2] = way[2] or self.speller.ready(w)
            for other, d in (self.speller.near(way[2], most) if most else {w: 0} if w in self.written else {}).items():
                if d <= names.errors(len(other)):
                    s = 1 - (d + way[1]) / (letters + 1)
                    for x in self.written[other]:
                        if s > out.get(x, 0.0):
                            out[x] = s
        return out

    def alike(self, word: str) -> dict[str, float]:
        """Words of the list that a word may stand for, with their likeness: itself, with typing errors, or one abbreviating the other."""
        if word not in self.seen:
            if len(self.seen) >= KEPT_WORDS:
                self.seen.clear()
            out, stem = self.within(word, self.ways(word), self.names.most, len(word)), self.names.v.stem
            if stem and len(word) >= stem:
                for i in range(bisect_left(self.sorted, word), len(self.sorted)):
                    if not self.sorted[i].startswith(word):
                        break
                    out.setdefault(self.sorted[i], 0.9)
                for n in range(stem, len(word)):
                    if word[:n] in self.by_word:
                        out.setdefault(word[:n], 0.9)
            self.seen[word] = out
        return self.seen[word]


class TokenSets:
    """Token sets of listed names, and their similarity to those of a form. Built of (kind, form, key).

    A name has the set of its words and, as blanks move, the set of all its letters as one word. Its numbers are no words: they must be the
    same, those of the letters in the same order. The similarity of two sets is the weighted share of common words, their
    intersection over their union; a word with typing errors is in the intersection by its likeness.
    """

    def __init__(self, names: Names, forms: Iterable[tuple[str, str, str]], weights: dict[str, float]):
        self.names, self.weights = names, weights
        self.sets: dict[tuple, set[str]] = defaultdict(set)
        for kind, form, key in forms:
            if kind != KEY and not (names.fixed and names.fixed.search(form)):
                if names.errors(len((one := self.joined(form))[1][0])):
                    self.sets[one].add(key)
                if kind == WORDS and (several := self.worded(form))[1]:
                    self.sets[several].add(key)
        held: dict[tuple[str, ...], dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for one in self.sets:
            for w in one[1]:
                held[one[0]][w].append(one)
        #: Of each group of numbers the sets by their words.
        self.blocks = {numbers: Words(names, by_word) for numbers, by_word in held.items()}

    def joined(self, form: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(numbers in their order, all letters as one word) of a form."""
        numbers, word = parts(form.replace(" ", ""))
        return ("", *numbers), (word,)

    def worded(self, form: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(words with digits, other words but those that name nothing) of a form, both sorted."""
        words = set(JOINT.sub(" ", form).split(" "))
        named = lambda w: not self.names.v.whole or w not in self.names.v.generic_words
        return tuple(sorted(w for w in words if not w.isalpha())), tuple(sorted(w for w in words if w.isalpha() and named(w)))

    def weight(self, word: str) -> float:
        return max(self.weights.get(word, 1.0), LEAST_WEIGHT)

    def similar(self, form: str) -> list[tuple[float, str]]:
        """(distance, key) of the nearest names of this index that are similar enough, at most two of different keys."""
        names = self.names
        if names.fixed and names.fixed.search(form):
            return []
        whole, words = names.forms(form)
        best = self.nearest({self.joined(f) for f in {*whole, *words}})
        # If no word may be left over, one word is what its letters are.
        for numbers, own in {self.worded(w) for w in words or {" ".join(runs_of(form))} if not names.v.whole or sum(map(str.isalpha, w.split(" "))) > 1}:
            for k, s in self.common(numbers, own).items():
                best[k] = max(s, best.get(k, 0.0))
        most = max(best.values(), default=0.0)
        return [(1 - most, k) for k in sorted(k for k, s in best.items() if s == most)[:2]]

    def nearest(self, ways: set[tuple[tuple[str, ...], tuple[str, ...]]]) -> dict[str, float]:
        """{key: similarity} of the sets of one word, for which it is the likeness of the words, with the fewest errors that any of them has; the others are less similar."""
        # The ways to write one form count as equally long, so those with as many errors tie.
        letters = max((len(w) for _, (w,) in ways), default=0)
        asked = [(block, w, block.ways(w)) for numbers, (w,) in ways if (block := self.blocks.get(numbers))]
        out: dict[str, float] = {}
        for errors in range(self.names.most + 1):
            for block, w, spelt in asked:
                for x, s in block.within(w, spelt, errors, letters).items():
                    if (s := round(s, 9)) >= self.names.v.similarity:
                        for one in block.by_word[x]:
                            for key in self.sets[one]:
                                out[key] = max(out.get(key, 0.0), s)
            if out:
                break
        return out

    def common(self, numbers: tuple[str, ...], own: tuple[str, ...]) -> dict[str, float]:
        """{key: weighted share of common words} of names with these numbers whose share is the least allowed one or more; with ``whole`` none of their words may lack a partner."""
        least, whole = self.names.v.similarity, self.names.v.whole
        if numbers not in self.blocks:
            return {}
        block = self.blocks[numbers]
        ways = {w: block.alike(w) for w in own}
        # What a word adds if it finds a partner: it weighs what the word weighs that it stands for.
        adds = {w: max(map(self.weight, xs), default=0.0) for w, xs in ways.items()}
        near, past, left = set(), 0.0, sum(adds.values())
        for w in sorted(own, key=lambda w: (-self.weight(w), len(block.by_word.get(w, ())))):
            if left < least * (past + left) - 1e-9:
                break  # what is left can't make a name similar enough
            near.update(one for x in ways[w] for one in block.by_word[x])
            past, left = past + self.weight(w), left - adds[w]
        out: dict[str, float] = {}
        for one in near:
            theirs = one[1]
            free, left, shared, paired = set(theirs), set(own), 0.0, 0.0
            for s, w, x in sorted(((s, w, x) for w in own for x, s in ways[w].items() if x in free), key=lambda p: (-p[0], p[1], p[2])):
                if x in free and w in left:
                    free.discard(x)
                    left.discard(w)
                    shared, paired = shared + s * self.weight(x), paired + self.weight(x)
            union = paired + sum(map(self.weight, left)) + sum(map(self.weight, free))
            score = round(shared / union, 9) if union else 0.0
            if score >= least and not (whole and (free or left)):
                for key in self.sets[one]:
                    out[key] = max(out.get(key, 0.0), score)
        return out


def _listed(canonical: DataFrame, key: str, name: str, aliases: str, vocabulary: Vocabulary) -> DataFrame:
    """(kind, form, k) of all names, aliases and keys; a form of two keys decides nothing and is left out."""
    rows = canonical.where(col(key).isNotNull()).select(col(key).cast("string").alias("k"), F.explode(F.array_union(F.array(col(name)), F.coalesce(col(aliases), F.array().cast("array<string>")))).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(vocabulary)
        for pdf in batches:
            out = []
            for k, n in zip(pdf["k"], pdf["n"], strict=True):
                t = plain(n) if isinstance(n, str) else ""
                whole, words = names.forms(t)
                out += [(NAME, f, k) for f in whole] + [(WORDS, f, k) for f in words]
                if not words and whole:
                    out.append((WORDS, " ".join(runs_of(t)), k))
            yield pd.DataFrame(out, columns=["kind", "form", "k"])

    forms = rows.mapInPandas(run, "kind string, form string, k string")
    forms = forms.unionByName(canonical.where(col(key).isNotNull()).select(F.lit(KEY).alias("kind"), col(key).cast("string").alias("form"), col(key).cast("string").alias("k")))
    return forms.groupBy("kind", "form").agg(F.min("k").alias("k"), F.max("k").alias("other")).where("k = other").drop("other")


def _index(shipped, name: str, build: Callable):
    """An index built once per Python worker: it stays beside the broadcast rows that it is built of."""
    if name not in shipped.value:
        shipped.value[name] = build(shipped.value["forms"])
    return shipped.value[name]


def common_words(forms: DataFrame, share: float = COMMON_SHARE) -> dict[str, float]:
    """{word: weight} of words in more than ``share`` of all forms, the lighter the commoner; all others weigh 1.

    A word is listed from a share on, so at most the words of a form divided by ``share`` come out, whatever the data.
    """
    words = forms.select(F.explode(F.array_distinct(F.split("form", "[ ,]"))).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = forms.count()
    return {r.w: log(max(total / r.n, 1.0)) / log(1 / share) for r in words.where(F.col("n") > max(1.0, total * share)).collect()}


def _sharded(listed: DataFrame, texts: DataFrame, route: DataFrame, shards: int, work: Callable, schema: str) -> DataFrame:
    """Streams of texts through the index of each shard.

    ``listed`` has (shard, kind, form, k), ``route`` (shard, form, codes). A shard with many texts is dealt to several parts with their own
    copy of its forms. ``work(forms)`` gives a function of (form, codes) that yields rows of ``schema``.
    """
    parts = route.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("parts"))
    asked = route.join(parts, "shard").select("shard", F.pmod(F.xxhash64("form", "codes"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("what"), "form", "codes", F.lit("").alias("kind"), F.lit("").alias("k"))
    held = listed.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("what"), "form", F.array().cast("array<string>").alias("codes"), "kind", "k")
    rows = held.unionByName(asked).repartition(max(shards, listed.sparkSession.sparkContext.defaultParallelism), "shard", "part").sortWithinPartitions("shard", "part", "what")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, forms, find = None, [], None
        for pdf in batches:
            out = []
            for shard, part, what, form, codes, kind, k in zip(*(pdf[c] for c in ("shard", "part", "what", "form", "codes", "kind", "k")), strict=True):
                if (shard, part) != group:
                    group, forms, find = (shard, part), [], None
                if what == 0:
                    forms.append((kind, form, k))
                    continue
                find = find or work(forms)
                out += [(form, list(codes), *f) for f in find(form, list(codes))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def _anchors(form: str) -> list[str]:
    """The beginnings of which a listed form that this form may hold has one: of its squeezed text from each run on."""
    runs = runs_of(form)
    return ["".join(runs[i:])[:ANCHOR] for i in range(len(runs))]


def _match_sharded(asked: DataFrame, listed: DataFrame, vocabulary: Vocabulary, shards: int, weights: dict[str, float], scratch: Scratch) -> DataFrame:
    """(form, codes, n, k) as ``_match`` gives it, for lists of any length."""
    anchor = F.concat("kind", F.substring("form", 1, ANCHOR))
    own = listed.withColumn("anchor", anchor)
    hot = F.broadcast(hot_keys(own, ["anchor"], max(1, -(-listed.count() // (4 * shards)))).select("anchor", "salts"))
    place = lambda salt: F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int")
    own = own.join(hot, "anchor", "left").withColumn("shard", place(F.pmod(F.xxhash64("form"), F.coalesce("salts", F.lit(1))).cast("int")))

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(vocabulary)
        for pdf in batches:
            out = []
            for form, codes in zip(pdf["form"], pdf["codes"], strict=True):
                whole, words = names.forms(form)
                ways = [(NAME, a) for a in _anchors(form)] + [(NAME, f[:ANCHOR]) for f in whole] + [(WORDS, f[:ANCHOR]) for f in words] + [(KEY, c[:ANCHOR]) for c in codes]
                # Listed forms shorter than an anchor are their own anchor.
                out += {(form, tuple(codes), kind + a[:n]) for kind, a in ways for n in range(1, len(a) + 1)}
            yield pd.DataFrame(out, columns=["form", "codes", "anchor"]).assign(codes=lambda p: p["codes"].map(list))

    route = asked.select("form", "codes").mapInPandas(begins, "form string, codes array<string>, anchor string")
    route = route.join(own.select("anchor").distinct(), "anchor", "left_semi").join(hot, "anchor", "left")
    route = route.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).select("form", "codes", place(F.col("salt")).alias("shard")).distinct()

    def mentions(forms: list) -> Callable:
        index, names = Mentions(forms), Names(vocabulary)
        return lambda form, codes: index.find(names, form, codes)

    found = _sharded(own.select("shard", "kind", "form", "k"), asked, route, shards, mentions, "form string, codes array<string>, kind string, a int, b int, k string")
    found = found.groupBy("form", "codes").agg(F.collect_set(F.struct("kind", "a", "b", "k")).alias("found"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(vocabulary)
        for pdf in batches:
            got = [decide(names, form, [(f["kind"], f["a"], f["b"], f["k"]) for f in (found if found is not None else [])]) for form, found in zip(pdf["form"], pdf["found"], strict=True)]
            yield pd.DataFrame({"form": pdf["form"], "codes": pdf["codes"], "n": pdf["n"], "k": [g[0] for g in got], "ask": [g[1] for g in got]})

    decided = scratch.write(asked.join(found, ["form", "codes"], "left").mapInPandas(settle, "form string, codes array<string>, n bigint, k string, ask boolean"), "decided")
    rest = decided.where("ask").select("form", "codes")
    spread = listed.where(F.col("kind") != KEY).withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int")).select("shard", "kind", "form", "k")

    def similar(forms: list) -> Callable:
        index = TokenSets(Names(vocabulary), forms, weights)
        return lambda form, codes: index.similar(form)

    near = _sharded(spread, rest, rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), shards, similar, "form string, codes array<string>, d double, k string")
    near = near.groupBy("form", "codes").agg(F.min("d").alias("least"), F.collect_set(F.struct("d", "k")).alias("near"))
    nearest = F.array_distinct(F.transform(F.filter("near", lambda x: x["d"] == F.col("least")), lambda x: x["k"]))
    near = near.select("form", "codes", F.when(F.size(nearest) == 1, nearest[0]).alias("best"))
    both = decided.join(near, ["form", "codes"], "left")
    return both.select("form", "codes", "n", F.when(F.col("ask"), F.coalesce("best", F.lit(UNMATCHED))).otherwise(F.col("k")).alias("k"))


def _match(asked: DataFrame, listed: DataFrame, vocabulary: Vocabulary, weights: dict[str, float], tasks: int) -> DataFrame:
    """(form, codes, n, k) for clean forms (form, codes, n) and a list that fits one automaton; k is NULL for forms that name nothing."""
    shipped = asked.sparkSession.sparkContext.broadcast({"forms": [tuple(r) for r in listed.select("kind", "form", "k").collect()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(vocabulary)
        mentions = _index(shipped, "mentions", Mentions)
        sets = _index(shipped, "sets", lambda forms: TokenSets(names, forms, weights))
        for pdf in batches:
            got = []
            for form, codes in zip(pdf["form"], pdf["codes"], strict=True):
                key, ask = decide(names, form, mentions.find(names, form, codes))
                if ask:
                    near = sets.similar(form)
                    key = near[0][1] if len(near) == 1 else UNMATCHED
                got.append(key)
            yield pd.DataFrame({"form": pdf["form"], "codes": pdf["codes"], "n": pdf["n"], "k": got})

    return asked.repartition(tasks).mapInPandas(run, "form string, codes array<string>, n bigint, k string")


def map_to_canonical(
    values: DataFrame,
    row_id: str,
    text: str,
    code: str | None,
    canonical: DataFrame,
    key: str,
    name: str,
    aliases: str,
    shard_entries: int = SHARD_ENTRIES,
    vocabulary: Vocabulary = COMPOUNDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(row id, key) for every row whose ``code`` isn't a canonical key as written; UNMATCHED if it means none.

    ``canonical`` has one row per entry with its key, name and an array of aliases. The text decides: a
    canonical key within it, else the longest non-overlapping mention that an automaton of all names and
    aliases finds (with ``vocabulary.whole`` only if the rest of the text is generic), else the name with the most similar token set
    (``TokenSets``): the same numbers, and a weighted share of common words of ``vocabulary.similarity`` or more, of which none may be left over
    with ``vocabulary.whole``. The code, read leniently,
    decides only where the text names nothing; ``code`` None means there is none. Names that tie leave a value unmatched.

    NULL and empty texts name nothing, NULL codes are unknown, repeated rows each come out, rows with a
    NULL id too, very long texts are read whole, an empty list leaves all values unmatched, NULL keys,
    names and aliases are ignored, further columns too. A list of more than ``shard_entries`` forms is cut
    into shards; the answers are the same.
    """
    spark = values.sparkSession
    scratch = Scratch(spark)
    keys = canonical.where(col(key).isNotNull()).select(col(key).cast("string").alias("c")).distinct()
    rows = values.select(col(row_id).alias("id"), col(text).alias("t"), (col(code) if code is not None else F.lit(None)).cast("string").alias("c"))
    rows = rows.join(keys, "c", "left_anti")
    listed = scratch.write(_listed(canonical, key, name, aliases, vocabulary), "listed")
    # Keys of one shape can be read leniently: two rows tell the shape.
    shape = F.struct(F.regexp_extract("form", r"^([A-Za-z]+)\d+$", 1).alias("p"), F.length("form").alias("n"))
    ends = listed.where(F.col("kind") == KEY).agg(F.min(shape).alias("a"), F.max(shape).alias("b")).first()
    code_shape = (ends.a.p, ends.a.n - len(ends.a.p)) if ends.a is not None and ends.a == ends.b and ends.a.p else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(vocabulary)
        for pdf in batches:
            got = [names.clean(t if isinstance(t, str) else None, code_shape) for t in pdf["t"]]
            typed = [(read_code(c, *code_shape) if code_shape else c) if isinstance(c, str) else None for c in pdf["c"]]
            yield pd.DataFrame({"id": pdf["id"], "form": [f for f, _ in got], "codes": [c for _, c in got], "typed": typed})

    kind = dict(values.dtypes)[row_id]
    cleaned = scratch.write(rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, f"id {kind}, form string, codes array<string>, typed string"), "cleaned")
    asked = scratch.write(cleaned.groupBy(F.coalesce("form", F.lit("")).alias("form"), "codes").agg(F.count(F.lit(1)).alias("n")), "asked")
    n_asked, shards = asked.count(), max(1, -(-listed.count() // shard_entries))
    weights = common_words(asked.select("form").unionByName(listed.where(F.col("kind") == WORDS).select("form"))) if vocabulary.weighted else {}
    if shards == 1:
        matched = _match(asked, listed, vocabulary, weights, max(spark.sparkContext.defaultParallelism, n_asked // TASK_ROWS))
    else:
        matched = _match_sharded(asked, listed, vocabulary, shards, weights, scratch)
    matched = scratch.write(matched, "matched")
    # The rows of forms that very many rows have get their answer by broadcast, at most 1 / HOT_SHARE forms.
    total = cleaned.count()
    often = F.col("n") > max(hot_rows, total * HOT_SHARE)
    ask = cleaned.select("id", F.coalesce("form", F.lit("")).alias("form"), F.col("form").isNull().alias("other"), "codes", "typed")
    hot = F.broadcast(matched.where(often).select("form", "codes", F.col("k").alias("hot_k"), F.lit(True).alias("hot")))
    ask = ask.join(hot, ["form", "codes"], "left")
    cold = ask.where("hot is null").join(matched.where(~often).select("form", "codes", "k"), ["form", "codes"], "left").drop("hot_k")
    both = cold.unionByName(ask.where("hot").withColumn("k", F.col("hot_k")).drop("hot_k"))
    # A text that means something different is unmatched unless it holds a key.
    both = both.withColumn("k", F.when(F.col("other") & (F.coalesce("k", F.lit(UNMATCHED)) == UNMATCHED), F.lit(UNMATCHED)).otherwise(F.col("k")))
    # Rows that need no code are spread over the tasks of the join and find nothing there.
    probe = F.when(F.col("k").isNull() & F.col("typed").isNotNull(), F.col("typed")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("id", "form"), F.lit(9973))))
    both = both.select("id", "k", probe.alias("probe")).join(keys.select(F.col("c").alias("probe"), F.lit(True).alias("known")), "probe", "left")
    out = both.select("id", F.coalesce("k", F.when(F.col("known"), F.col("probe")), F.lit(UNMATCHED)).alias("k"))
    return out.select(F.col("id").alias(row_id), F.col("k").alias(key))
