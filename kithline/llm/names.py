"""How people write names: tokens, nicknames, abbreviations, and the similarity of two tokens and of two names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import lru_cache
from math import log

#: Common English short forms of given names.
NICKNAMES = {
    "alexander": "alex alec sandy xander", "andrew": "andy drew", "anthony": "tony", "arthur": "art artie", "barbara": "babs barb barbie", "beatrice": "bea trixie", "benjamin": "ben benny",
    "catherine": "cathy kate katie cat", "charles": "charlie chas chuck", "christina": "chris tina chrissy", "christopher": "chris kit topher", "cyril": "cy", "daniel": "dan danny", "deborah": "deb debbie",
    "dennis": "denny", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted", "eleanor": "ellie nell nora", "elizabeth": "beth betty liz lizzie eliza bess libby", "eugene": "gene", "frances": "fran frankie fanny",
    "frederick": "fred freddy freddie", "george": "georgie", "gregory": "greg", "harold": "hal harry", "helen": "nell nellie", "henrietta": "hettie etta", "henry": "hank harry hal", "isabella": "bella izzy belle",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "joan": "joanie", "joseph": "joe joey", "josephine": "josie jo", "joshua": "josh", "judith": "judy", "katherine": "kathy kate katie kay kit kitty",
    "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny", "louis": "lou louie", "margaret": "maggie meg peggy madge daisy greta", "martin": "marty", "mary": "molly polly", "matthew": "matt", "michael": "mick mike mickey",
    "nathaniel": "nat nate", "nicholas": "nick nico nicky", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "rebecca": "becca becky", "richard": "rick dick rich richie",
    "robert": "bob bobby rob robbie bert", "roger": "rodge", "ronald": "ron ronnie", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sadie sally", "stephanie": "steph", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy theo",
    "theresa": "terry tess tessie", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "wally walt", "william": "bill billy will willie liam", "zachary": "zach zack",
}
#: Given names of different people that look like one name and its variant.
APART = [frozenset(x.split("/")) for x in (
    "albert/alberta alexander/alexandra andrew/andrea carl/carla carl/karl christian/christina christian/christine daniel/danielle eric/erica frances/francis frederick/frederica gabriel/gabrielle george/georgia "
    "henry/henrietta joan/john joseph/josephine julia/julian julia/julie justin/justine karen/karl leon/leona leon/leonard louis/louise louis/lois marie/mary martin/martina michael/michelle nicholas/nicole oliver/olivia olive/oliver patricia/patrick "
    "paul/paula robert/roberta simon/simone stephan/stephanie stephen/stephanie stephan/stephen tess/tessa thomas/thomasina victor/victoria"
).split()]
#: Words of a name that say little about who is meant.
TITLES = frozenset("mr mrs ms miss dr prof rev sir jr sr ii iii iv md phd esq".split())
FILLERS = frozenset("the and of co company inc incorporated corp corporation llc ltd limited".split())
#: Abbreviations of words in the names of organisations.
SHORT = {
    "centre": "center", "ctr": "center", "metro": "metropolitan", "assoc": "associates", "assocs": "associates", "svcs": "services", "svc": "services", "serv": "services", "acctg": "accounting", "acct": "accounting", "constr": "construction",
    "bros": "brothers", "dept": "department", "natl": "national", "intl": "international", "ptnrs": "partners", "part": "partners", "agcy": "agency", "mfg": "manufacturing", "bldg": "building", "grp": "group", "mgmt": "management", "mgt": "management",
    "utd": "united", "no": "northern", "north": "northern", "so": "southern", "west": "western", "east": "eastern", "prof": "professional", "ctrl": "central", "elec": "electric", "med": "medical", "vet": "veterinary", "ins": "insurance", "solu": "solutions",
}

_FORMAL: dict[str, set[str]] = {}
for _formal, _forms in NICKNAMES.items():
    for _f in _forms.split():
        _FORMAL.setdefault(_f, set()).add(_formal)


class _Signs(dict):
    """For str.translate: apostrophes go, signs for `and` become the word, everything else between letters and digits a blank."""

    def __missing__(self, k: int) -> int | str | None:
        c = chr(k)
        self[k] = v = k if c.isalnum() else None if c == "'" else " and " if c in "&+" else " "
        return v


_SIGNS = _Signs()


def tokens(*fields: str | None) -> list[str]:
    """Lower-case words of the fields; signs for `and` are that word, apostrophes are dropped."""
    return " ".join([f for f in fields if f]).lower().translate(_SIGNS).split()


@lru_cache(maxsize=200_000)
def _letters(w: str) -> int:
    """The letters of a word as bits; some share one."""
    bits = 0
    for c in w:
        bits |= 1 << (ord(c) & 63)
    return bits


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most > 1:  # an edit takes away one kind of letter at most, and brings one
        p, q = _letters(a), _letters(b)
        if (p & ~q).bit_count() > most or (q & ~p).bit_count() > most:
            return most + 1
    i, m, n = 0, len(a), len(b)
    least = m if m < n else n
    while i < least and a[i] == b[i]:
        i += 1
    while m > i and n > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[i:m], b[i:n]
    if not a or not b:
        return len(a) + len(b)
    if most == 1:  # one letter replaced, or two neighbours in the other order
        return 1 if len(a) == len(b) == 1 or (len(a) == len(b) == 2 and a == b[::-1]) else 2
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@lru_cache(maxsize=200_000)
def sounds(w: str) -> str:
    """Spelling without the usual variants: doubled letters, y/i/ie, c/k/q, ph/f, a/e/o after the first letter kept apart."""
    w = w.replace("ph", "f").replace("qu", "kw").replace("ck", "k").replace("c", "k").replace("q", "k").replace("ie", "i").replace("y", "i").replace("z", "s").replace("oo", "u").replace("ou", "u")
    return re.sub(r"(.)\1+", r"\1", w)


def formal(w: str) -> set[str]:
    return _FORMAL.get(w, set()) | ({w} if w in NICKNAMES else set())


def _abbreviates(short: str, long: str) -> bool:
    if len(short) < 2 or len(short) > 0.75 * len(long) or short[0] != long[0] or any(c in "aeiou" for c in short[1:]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """Similarity of two tokens in 0..1 by kind of variation; 0 if they are different words."""
    if a == b:
        return 1.0
    if frozenset((a, b)) in APART:
        return 0.0
    if SHORT.get(a, a) == SHORT.get(b, b):
        return 0.95
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.7 if b[0] == a else 0.0
    fa, fb = formal(a), formal(b)
    if fa & fb:
        return 0.95
    if fa and fb and a in NICKNAMES and b in NICKNAMES:
        return 0.0
    if _abbreviates(a, b):
        return 0.9
    if len(a) >= 3 and b.startswith(a):
        return 0.9
    most = 1 if len(b) <= 5 else 2 if len(b) <= 9 else 3
    if len(a) >= 3:
        if (d := edits(a, b, most)) <= most:
            return 0.95 - 0.08 * d
        one, two = sounds(a), sounds(b)
        if one == two or (len(a) > 4 and len(b) > 6 and edits(one, two, 1) <= 1):
            return 0.8
    return 0.0


class Weights:
    """What names in general look like: the shares of frequent tokens (others have less than `rare`), and if given those of all tokens, by which rarity is graded."""

    def __init__(self, heavy: Mapping[str, float], rare: float, established: float = 0.15, shares: Mapping[str, float] | None = None):
        self.heavy, self.rare, self.established, self.shares = heavy, rare, established, shares
        self.least = log(1 / rare)
        self.given: dict[tuple[str, int], list[str]] = {}
        for t in {*heavy, *NICKNAMES, *_FORMAL}:
            if len(t) > 2:
                self.given.setdefault((t[0], len(t)), []).append(t)
        self.near_: dict[str, tuple[str, ...]] = {}
        self.weighed: dict[str, float] = {}

    def weigh(self, t: str) -> float:
        if t not in self.weighed:
            if len(self.weighed) > 200_000:
                self.weighed.clear()
            self.weighed[t] = self._weigh(t)
        return self.weighed[t]

    def _weigh(self, t: str) -> float:
        if self.shares is not None:
            return log(1 / self.shares[t]) * (0.3 if len(t) == 1 else 1.0) if t else 0.0
        return self.least if t not in self.heavy and len(t) > 1 else log(1 / max(self.heavy.get(t, self.rare), 1e-9)) * (0.3 if len(t) == 1 else 1.0)

    def alike(self, x: str, y: str) -> float:
        """likeness, but two frequent tokens of comparable frequency that differ in letters are two names."""
        s = likeness(x, y)
        if 0.7 < s < 0.9:
            p, q = self.heavy.get(x, 0.0), self.heavy.get(y, 0.0)
            if min(p, q) > self.established * max(p, q) > 0:
                return 0.0
        return s

    def near(self, t: str) -> tuple[str, ...]:
        """Frequent tokens that t may be a misspelling of."""
        if t in self.heavy or len(t) < 4:
            return (t,)
        if t not in self.near_:
            if len(self.near_) > 100_000:
                self.near_.clear()
            self.near_[t] = (t, *(g for n in (-1, 0, 1) for g in self.given.get((t[0], len(t) + n), ()) if edits(t, g, 1) <= 1))
        return self.near_[t]

    def indirect(self, x: str, y: str) -> float:
        """Likeness of two tokens through a correction of either, such as a misspelt name and its nickname."""
        if frozenset((x, y)) in APART or min(len(x), len(y)) < 3 or (x in self.heavy and y in self.heavy):
            return 0.0
        return max((0.75 for p in self.near(x) for q in self.near(y) if self.alike(p, q) >= 0.9), default=0.0)


def _joined(ts: list[str], us: list[str]) -> list[str]:
    """ts with neighbours put together where that gives a word of us."""
    out, i = [], 0
    while i < len(ts):
        if i + 1 < len(ts) and ts[i] not in us and any(abs(len(u) - len(ts[i]) - len(ts[i + 1])) < 3 < len(u) and u[0] == ts[i][0] and likeness(ts[i] + ts[i + 1], u) > max(0.78, likeness(ts[i + 1], u), likeness(ts[i], u)) for u in us):
            out.append(ts[i] + ts[i + 1])
            i += 2
        else:
            out.append(ts[i])
            i += 1
    return out


def compare(one: Sequence[str], two: Sequence[str], w: Weights, mid1: Sequence[str] = (), mid2: Sequence[str] = ()) -> float:
    """Soft weighted similarity of two names as bags of tokens, 0..1; 0 if each has a word that the other contradicts.

    A token weighs the logarithm of its rarity, so rare tokens count more.  Tokens are paired greedily by likeness times weight.
    Titles and company forms weigh nothing.  Middle names stand in for a first name that is left over, and speak against
    names that they contradict.
    """
    a = [t for t in one if t not in TITLES and t not in FILLERS] or list(one)
    b = [t for t in two if t not in TITLES and t not in FILLERS] or list(two)
    if not a or not b:
        return 0.0
    if len(a) == len(b) and (not mid1 or not mid2 or list(mid1) == list(mid2)) and max(map(len, a)) > 2 and sorted(a) == sorted(b):
        return 1.0
    if len(a) != len(b):
        a = _joined(a, b)
        b = _joined(b, a)
    left, right, score, strong, lone = [], list(b), 0.0, False, [False, False]
    for x in a:  # equal tokens first
        if x in right:
            right.remove(x)
            score += w.weigh(x)
            strong = strong or len(x) > 2
        else:
            left.append(x)
    if left and right:
        pairs = sorted([(s * min(w.weigh(x), w.weigh(y)), s, x, y) for x in left for y in right if (s := w.alike(x, y)) > 0], reverse=True)
        for _, s, x, y in pairs:
            if x in left and y in right:
                left.remove(x)
                right.remove(y)
                score += s * (w.weigh(x) + w.weigh(y)) / 2
                strong = strong or (len(x) > 2 and len(y) > 2)
                lone = [lone[0] or len(x) == 1, lone[1] or len(y) == 1]
    if not strong:
        return 0.0
    for x in list(left):
        for y in list(right):
            if x in left and (s := w.indirect(x, y)):
                left.remove(x)
                right.remove(y)
                score += s * (w.weigh(x) + w.weigh(y)) / 2
    m1, m2, both = list(mid1), list(mid2), bool(left and right)
    called = False  # by the middle name: one side's first name is the other's middle name in full, and that side has none
    for rest, mids, own in ((left, m2, mid1), (right, m1, mid2)):
        for x in list(rest):
            for m in mids:
                if (s := w.alike(x, m)) > 0:
                    rest.remove(x)
                    mids.remove(m)
                    called = called or (s > 0.8 and min(len(x), len(m)) > 2 and not own)
                    break
    if m1 and m2:
        if not any(w.alike(x, y) or w.indirect(x, y) for x in m1 for y in m2):
            return 0.0
        m1, m2 = [], []
    # an initial that stands for the other's name while a name of its own side is left over is a middle initial
    if (lone[0] and any(len(x) > 1 for x in left)) or (lone[1] and any(len(y) > 1 for y in right)):
        return 0.0
    if (both and (left or right) and not (called and len(left) + len(right) == 1)) or (left and m2) or (right and m1):
        return 0.0
    unmatched = sum(map(w.weigh, left)) + sum(map(w.weigh, right))
    return score / (score + unmatched / 2)
