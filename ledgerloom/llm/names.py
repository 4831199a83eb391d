"""Normal form of organisation names typed by people, shared by linkage and variant grouping."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import permutations

# --- fixed values ---------------------------------------------------------------------------------------------
LEGAL = (
    "inc incorporated corp corporation co company cos ltd limited llc lc lp llp plc pllc sa sas sarl srl spa nv bv ag gmbh kg kgaa se ab as oy oyj "
    "ltda cia pty pte kk bhd sdn"
).split()
FILLER = "the and of group grp holdings holding hldgs hldg us usa u s new cl class com".split()
PLACEHOLDERS = {"", "n a", "na", "nan", "none", "null", "unknown", "tbd", "tba", "not available", "not applicable", "various", "other", "same", "see above", "unnamed", "no name", "test", "xxx"}
NICKNAMES = {
    "robert": "bob bobby rob robbie bert", "william": "bill billy will willie liam", "richard": "dick rick ricky rich richie", "james": "jim jimmy jamie", "edward": "ed eddie ted ned",
    "elizabeth": "liz lizzie beth betty eliza betsy", "katherine": "kate kathy katie kathryn catherine kat", "margaret": "maggie meg peggy peg marge", "john": "jack johnny", "charles": "charlie chuck",
    "thomas": "tom tommy", "michael": "mike mick", "joseph": "joe joey", "henry": "harry hank", "susan": "sue suzy", "patricia": "pat patty tricia", "jennifer": "jen jenny", "alexander": "alex sandy",
    "daniel": "dan danny", "samuel": "sam sammy", "benjamin": "ben benny", "anthony": "tony", "theodore": "theo", "deborah": "deb debbie", "barbara": "barb", "victoria": "vicky tori", "andrew": "andy drew",
    "george": "", "mary": "", "peter": "pete", "david": "dave", "stephen": "steve steven", "matthew": "matt", "nicholas": "nick", "philip": "phil", "frederick": "fred freddie",
}
GIVEN = {n: full for full, ns in NICKNAMES.items() for n in [full, *ns.split()]}
_LEGAL, _FILLER = set(LEGAL), set(FILLER)


def fold(s: str) -> str:
    """Lower case without accents; initialisms (L.L.C.) joined; other signs are blanks."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    s = re.sub(r"\b(?:[a-z]\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m[0]) + " ", s + " ")
    return re.sub(r"[^a-z0-9]+", " ", s.replace("'", "").replace("’", "")).strip()


def within(a: str, b: str, most: int) -> bool:
    """Are the two strings at most ``most`` edits (change, add, drop, swap of neighbours) apart?"""
    return distance(a, b, most) <= most


def distance(a: str, b: str, most: int = 99) -> int:
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    old, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return row[-1]


def distance_in_any_order(a: str, b: str, most: int = 99) -> int:
    """Least distance of two families over the orders of their words, blanks not counted. Words that both have are
    paired first; where more than five words are left, they differ by more than four edits unless only blanks moved,
    so those are compared in alphabetical order alone."""
    x, y = Counter(a.split()), Counter(b.split())
    left, right = sorted((x - y).elements()), sorted((y - x).elements())
    p, q = "".join(left), "".join(right)
    # each edit takes away or adds one letter of a kind at most, in whatever order
    if max(sum((Counter(p) - Counter(q)).values()), sum((Counter(q) - Counter(p)).values())) > most:
        return most + 1
    if len(left) < len(right):
        left, p, q = right, q, p
    return min(distance("".join(o), q, most) for o in ({*permutations(left)} if len(left) <= 5 else [left]))


def core_words(name: str | None) -> list[str]:
    """The words of a name without legal forms and fillers; none for a placeholder or null."""
    if name is None:
        return []
    f = fold(name)
    if f in PLACEHOLDERS or len(f) < 2:
        return []
    words = f.split()
    return [w for w in words if w not in _LEGAL and w not in _FILLER] or words


def shortened(short: str, long: str) -> bool:
    """Could ``short`` stand for ``long``: its letters in order from the first on, as in an abbreviation or a singular?"""
    it = iter(long)
    return len(short) <= len(long) and short[:1] == long[:1] and all(c in it for c in short)


def _drops(word: str, most: int) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


class Lexicon:
    """Words that tell what an organisation does, learned from the names themselves (``variants.learn_lexicon``): word ->
    class. Words that are no entry are understood as typed wrong if an entry lies an edit or two off."""

    def __init__(self, classes: dict[str, str]):
        self.classes, self._near, self._index = classes, {}, None

    def __reduce__(self):
        return Lexicon, (self.classes,)

    def near(self, word: str) -> str:
        """The class that ``word`` comes within a typo or two of, or abbreviates alone; else ''."""
        if word not in self._near:
            self._near[word] = self._find(word)
        return self._near[word]

    def _find(self, word: str) -> str:
        if self._index is None:
            self._index = {}
            for w in self.classes:
                if len(w) >= 4:
                    for x in _drops(w, 2):
                        self._index.setdefault(x, []).append(w)
        if len(word) >= 4:
            tried = {w for x in _drops(word, 2) for w in self._index.get(x, ())}
            near = [(d, abs(len(w) - len(word)), w) for w in tried if (d := distance(word, w, 2)) <= (1 if min(len(w), len(word)) < 6 else 2)]
            if near:
                return self.classes[min(near)[2]]
        short = {c for w, c in self.classes.items() if 2 <= len(word) <= len(w) - 2 and shortened(word, w) and (word[-1] == w[-1] or w.startswith(word))}
        return short.pop() if len(short) == 1 else ""

    def parts(self, name: str | None) -> tuple[tuple[str, ...], str, str] | None:
        """(family words in the order they were typed, line of business, given name) of a name; None for a placeholder.
        The last word of a known class is the line; where there is none, the last that looks like one."""
        core = core_words(name)
        if not core:
            return None
        line, given, rest = "", "", list(core)
        for find in (lambda w: self.classes.get(w, ""), self.near):
            for i in reversed(range(len(core) if len(core) > 1 and not line else 0)):
                if not line and (x := find(core[i])):
                    line = x
                    del rest[i]
        if len(rest) > 1 and (rest[0] in GIVEN or len(rest[0]) == 1 and not rest[0].isdigit()):
            given = GIVEN.get(rest[0], rest[0])
            rest = rest[1:]
        elif len(rest) > 2 and (rest[-1] in GIVEN or len(rest[-1]) == 1):
            given, rest = GIVEN.get(rest[-1], rest[-1]), rest[:-1]
        return tuple(rest), line, given
