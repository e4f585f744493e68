"""Personal data: four exact base patterns, and a semi-Markov CRF for what they can't say.

A semi-Markov conditional random field scores whole candidate segments, so its features
may look at a span at once: the shape of all its digit groups, a checksum, its entropy,
the words before it. Dynamic programming with a bounded segment length picks boundaries
and types jointly. It is trained here, by conditional likelihood, on sentences that
``training_set`` makes from a seed; base matches are barred to it and always stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "national_id", "iban", "local_phone", "obfuscated_email")
KINDS = {k: i for i, k in enumerate((*BASE, *ADDED))}
#: Tokens that a segment has at most, and characters, if it has several tokens.
MAX_TOKENS, MAX_CHARS = 16, 120

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind.

    A match that fails its check is dropped; nothing is tried again inside it.
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((lo, end, "email"))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]]))


# --- the model -----------------------------------------------------------------------

_WORDS = {
    "secret": {"token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "key", "bearer", "auth", "credential", "credentials", "signature"},
    "national": {"ssn", "social", "dni", "nif", "nie", "insee", "steuer", "taxpayer", "national"},
    "passport": {"passport", "passeport", "reisepass", "pasaporte"},
    "bank": {"iban", "account", "konto", "compte", "cuenta", "bank"},
    "call": {"tel", "phone", "telephone", "call", "fax", "mobile", "telefon", "cell"},
    "mail": {"mail", "email", "contact", "write", "reach"},
    "plain": {"version", "license", "section", "page", "year", "chapter", "isbn", "order", "item", "serial", "commit", "sha", "sha256", "md5", "checksum", "file", "build", "revision", "invoice", "id"},
}
#: How issued credentials begin; fixed values of public formats.
ISSUED = ("AKIA", "ASIA", "AIza", "ya29", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "sk-", "xoxb-", "xoxp-", "xapp-", "npm_", "pypi-", "hf_", "dop_v1_", "SG", "eyJ", "-----BEGIN")

#: A name of a secret and what sets its value off, so that the value begins at the match's end.
_ASSIGNS = r"""(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|authorization|bearer)[A-Za-z0-9_]{0,12}(?:["']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}["']?|[ \t]+is:?[ \t]+["']?|(?<=[Bb][Ee][Aa][Rr][Ee][Rr])[ \t]+)"""
_PASSPORTS = r"(?:passport|passeport|reisepass|pasaporte)"
_ASSIGN = re.compile(f"(?ai:{_ASSIGNS})")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
_RUN = "A-Za-z0-9+/_=-"
#: Where a segment may be: a run with a digit, seven digits, "at … dot", a named secret.
_LINE = re.compile(rf"(?<![{_RUN}])(?=[{_RUN}]{{8}})(?>[A-Za-z+/_=-]*)[0-9](?>[{_RUN}]*)|[0-9](?:[ ().-]{{0,3}}[0-9]){{6}}|(?i:\bat\b[\])]? [^\s]{{1,60}}? [\[(]?dot\b)|(?ai:{_ASSIGNS})|(?ai:{_PASSPORTS})")
#: Whatever base_spans or _LINE can match, in bytes; 60 characters are 240 bytes at most.
_TRIGGER = re.compile(rb"[0-9@]|-----BEGIN|\b[Aa][Tt]\b[\])]? [^\s]{1,240}? [\[(]?[Dd][Oo][Tt]\b|(?i:" + _ASSIGNS.encode() + rb")|(?i:" + _PASSPORTS.encode() + rb")")
#: A private key's block, a signed token and a long run are one token, of any length.
_TOKEN = re.compile(_PEM.pattern + r"|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?|[A-Za-z0-9+/_-]{20,}={0,2}|[^\W_]+|\s+|[^\w\s]|_")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(s.count(c) / n * math.log2(s.count(c) / n) for c in set(s)) if n else 0.0


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def segment_features(text: str, lo: int, hi: int, left: Sequence[str], assigned: bool = False) -> tuple[str, ...]:
    """Features of text[lo:hi] as a whole; ``left``: the lower-case words shortly before,
    ``assigned``: it is the value of a named secret."""
    t = text[lo:hi]
    digits = sum("0" <= c <= "9" for c in t)
    letters = sum(c.isalpha() for c in t)
    spaced = any(c.isspace() for c in t)
    quoted = lo > 0 and text[lo - 1] in "\"'" and hi < len(text) and text[hi] == text[lo - 1]
    f = ["bias"]
    if lo and (text[lo - 1].isalnum() or text[lo - 1] == "_") or hi < len(text) and (text[hi].isalnum() or text[hi] == "_"):
        f.append("glued")
    if quoted:
        f.append("quoted")
    if lo and text[lo - 1] in "(.-/" or hi < len(text) and text[hi] in ")-/" or hi + 1 < len(text) and text[hi] in ".,:" and text[hi + 1].isalnum():
        f.append("cut")
    f.append(f"digits={min(digits, 16)}")
    if not letters and digits:
        shape = re.sub(r"[0-9]+", lambda m: str(len(m[0])), t) if hi - lo <= MAX_CHARS else ""
        f.append(f"shape={shape}" if 0 < len(shape) < 14 else "shape=long")
    else:
        f.append("letters")
    plain = t.isascii() and all(c.isalnum() or c in "_-+/=." for c in t)
    if plain:
        n = len(t)
        f.append(f"run={'<16' if n < 16 else '<24' if n < 24 else '<36' if n < 36 else '36+'}")
        if all(c in "0123456789abcdef" for c in t.lower()) and letters and digits:
            f.append("hex")
        if re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", t.lower()):
            f.append("uuid")
        if digits and letters and n >= 16 and _entropy(t) > 3.2:
            f.append("random")
        if letters and digits and 7 <= n <= 9 and t.isalnum() and t.upper() == t:
            f.append("code")
    if t.startswith(ISSUED):
        f.append("key-block" if t[0] == "-" else "issued" if hi - lo >= 18 else "issued-short")
    if assigned:
        mixed = sum((any(c.islower() for c in t), any(c.isupper() for c in t[1:]), digits > 0, any(not c.isalnum() and c != "_" for c in t)))
        called = hi < len(text) and text[hi] in "([{"
        f += ["assigned", f"assigned-mixed={mixed}", f"assigned-digits={digits > 0}"]
        f += [x for x, y in (("assigned-quoted", quoted), ("assigned-call", called or "(" in t), ("assigned-whole", quoted or hi == len(text) or text[hi].isspace()), ("assigned-variable", t[:1] in "$<{%*")) if y]
    squeezed = t.replace(" ", "") if hi - lo <= MAX_CHARS else ""
    if 15 <= len(squeezed) <= 34 and squeezed.isascii() and squeezed.isalnum() and squeezed[:2].isalpha() and squeezed[:2].isupper() and squeezed[2:4].isdigit():
        f.append("iban-ok" if _mod97(squeezed) else "iban-like")
    if spaced and re.fullmatch(r"[\w.+-]+ ?[\[(]? ?at ?[\])]? ?[\w-]+(?: ?[\[(]? ?(?:dot|\.) ?[\])]? ?[\w-]+)+", t, re.I):
        f.append("at-dot" if re.search(r"\bdot\b", t, re.I) else "at")
        if re.search(r"\bat (?:the|a|an|our|my|this|that) ", t, re.I):
            f.append("at-article")
    near = [name for name, words in _WORDS.items() if any(w in words for w in left)]
    f += [f"after={name}" for name in near] or ["after=nothing known", f"digits={min(digits, 16)} after nothing known"]
    return tuple(f)


def candidates(text: str, tokens: list[tuple[int, int]], barred: np.ndarray) -> dict[int, list[tuple[int, tuple[str, ...]]]]:
    """end token -> (start token, features): the segments that could be anything. All others
    are scored as no entity.

    Segments have MAX_TOKENS tokens at most, and MAX_CHARS characters if it is more than
    one; tokens are of any length. Candidates have 7 digits or more, are a run of 16
    characters or more with a digit, have an "at" between words, are a key's block, a value
    of a named secret up to its end, or a run of 6 to 9 characters with 5 digits shortly
    after "passport".
    """
    out: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    n = len(tokens)
    words = [text[a:b].lower() for a, b in tokens]
    counts = np.cumsum([0, *[sum("0" <= c <= "9" for c in w) for w in words]]).tolist()
    values = {m.end() for m in _ASSIGN.finditer(text)}
    for i in range(n):
        lo = tokens[i][0]
        assigned = lo in values and words[i][0] not in "\"'" and not words[i].isspace()
        block = words[i].startswith("-----begin")
        if barred[i] or words[i].isspace() or not (assigned or block or words[i][0].isalnum() or words[i] == "("):
            continue
        left = [w for w in words[max(0, i - 10) : i] if w.isalpha()][-3:]
        passport = any(w in _WORDS["passport"] for w in left)
        has_at = spaced = False
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            w, hi = words[j - 1], tokens[j - 1][1]
            length = hi - lo
            if barred[j - 1] or j > i + 1 and (length > MAX_CHARS or "\n" in w) or spaced and block:
                break
            has_at |= w == "at"
            spaced |= w.isspace()
            digits = counts[j] - counts[i]
            ends = assigned and not spaced and length >= 6 and w not in "\"'.,;" and (hi == len(text) or text[hi].isspace() or text[hi] in "\"'()[]{}<>,;&" or text[hi] == "." and (hi + 1 == len(text) or text[hi + 1].isspace()))
            if not ends and not block and not w[-1].isalnum() and w[-1] != "=":
                continue
            if (
                ends or block and j == i + 1 or digits >= 7 or length >= 16 and digits and not spaced or has_at and j - i >= 5 and w not in ("at", "dot")
                or passport and j == i + 1 and 6 <= length <= 9 and digits >= 5
            ):
                out.setdefault(j, []).append((i, segment_features(text, lo, hi, left, assigned)))
    return out


class SemiCRF:
    """Weights by (type, feature) and by (type of the entity before, type).

    A state is the type of the last entity, -1 before the first: tokens outside carry it on,
    so what an entity is depends on the one before it wherever that ended in the window.
    """

    def __init__(self) -> None:
        self.w: dict[tuple[int, str], float] = {}

    def score(self, kind: int, features: Sequence[str]) -> float:
        w = self.w
        return sum(w.get((kind, f), 0.0) for f in features)

    def follow(self, before: int, kind: int) -> float:
        return self.w.get((kind, f"after type {before}"), 0.0)

    def transitions(self) -> np.ndarray:
        """Weights by state before (row 0: none) and type."""
        return np.array([[self.follow(b, k) for k in range(len(ADDED))] for b in range(-1, len(ADDED))])

    def decode(self, n: int, segments: dict[int, list[tuple[int, tuple[str, ...]]]]) -> list[tuple[int, int, int]]:
        """The best (start, end, type) segments over n tokens, by Viterbi over segment ends.

        Of equal scores the one found first stays: a token outside before an entity, then
        types in their order.
        """
        kinds = range(len(ADDED))
        t = self.transitions().tolist()
        best: list[dict[int, tuple[float, int, int]]] = [{-1: (0.0, -1, -1)}]
        for j in range(1, n + 1):
            here = {b: (p[0], j - 1, b) for b, p in best[j - 1].items()}
            entered: dict[int, tuple[float, int, int]] = {}
            for i, f in segments.get(j, ()):
                for k in kinds:
                    s = self.score(k, f)
                    v, before = max((p[0] + t[b + 1][k], -b) for b, p in best[i].items())
                    if k not in entered or v + s > entered[k][0]:
                        entered[k] = (v + s, i, -before)
            for k, e in entered.items():
                if k not in here or e[0] > here[k][0]:
                    here[k] = (e[0], e[1] - n - 1, e[2])  # a negative start marks an entity
            best.append(here)
        out, j = [], n
        k = max(best[n], key=lambda x: (best[n][x][0], -x))
        while j > 0:
            _, i, before = best[j][k]
            if i < 0:
                i += n + 1
                out.append((i, j, k))
            j, k = i, before
        return out[::-1]


class Lattice:
    """The segments of one training sentence, with features as numbers of weight rows."""

    def __init__(self, segments: dict[int, list[tuple[int, tuple[str, ...]]]], gold: set[tuple[int, int, int]], number: dict[str, int]):
        flat = [(i, j, f) for j, s in sorted(segments.items()) for i, f in s]
        at = {x: p for p, x in enumerate(sorted({x for i, j, _ in flat for x in (i, j)}))}
        self.size = len(at)
        self.lo, self.hi = np.array([at[i] for i, _, _ in flat]), np.array([at[j] for _, j, _ in flat])
        self.lengths = np.array([len(f) for _, _, f in flat])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.rows = np.array([number.setdefault(x, len(number)) for _, _, f in flat for x in f])
        self.used = np.unique(self.rows)
        self.gold = np.zeros((len(flat), len(ADDED)))
        self.followed = np.zeros((len(ADDED) + 1, len(ADDED)))
        before = 0
        for i, j, k in sorted(gold):
            self.gold[next(x for x, (lo, hi, _) in enumerate(flat) if (lo, hi) == (i, j)), k] = 1
            self.followed[before, k] += 1
            before = k + 1
        self.ending = [np.flatnonzero(self.hi == p) for p in range(self.size)]
        self.starting = [np.flatnonzero(self.lo == p) for p in range(self.size)]

    def gradient(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the conditional log-likelihood, by feature row and by transition: the
        semi-Markov forward-backward recursion over the places where a segment may end."""
        s = np.add.reduceat(w[self.rows], self.starts)
        e = np.exp(t)
        a, b, entered = np.full((self.size, len(t)), -np.inf), np.zeros((self.size, len(t))), np.zeros((self.size, len(ADDED)))
        a[0, 0] = 0.0
        for p in range(self.size):
            if p:
                a[p] = a[p - 1]
            if len(x := self.ending[p]):
                a[p, 1:] = np.logaddexp(a[p, 1:], np.logaddexp.reduce(entered[self.lo[x]] + s[x]))
            if len(self.starting[p]):
                top = a[p].max()
                entered[p] = np.log(np.exp(a[p] - top) @ e) + top
        for p in range(self.size - 2, -1, -1):
            b[p] = b[p + 1]
            if len(x := self.starting[p]):
                ahead = np.logaddexp.reduce(s[x] + b[self.hi[x], 1:])
                top = ahead.max()
                b[p] = np.logaddexp(b[p], np.log(e @ np.exp(ahead - top)) + top)
        total = np.logaddexp.reduce(a[-1])
        joint = np.exp(np.minimum(a[self.lo][:, :, None] + t + (s + b[self.hi, 1:] - total)[:, None, :], 0.0))
        by_row = np.zeros_like(w)
        np.add.at(by_row, self.rows, np.repeat(self.gold - joint.sum(1), self.lengths, axis=0))
        return by_row, self.followed - joint.sum(0)


def tokenized(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens, which cover the text; a key's block is one token."""
    return [m.span() for m in _TOKEN.finditer(text)]


#: Words that training sentences are made of; fixed values.
PROSE = "the of and report team was sent by with office during meeting please see our new we on for le rapport est dans une pour avec der die Bericht mit wird nicht und für el informe con una para server config deploy user customer name address value field line note reply sample street city".split()
SURNAMES = "smith jones miller garcia muller schmidt dubois moreau rossi tanaka kim novak silva lopez brown wilson".split()


def training_set(size: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the spans to find, and sentences that only look like it.

    A sentence has none to five entities among words and look-alikes; often they are a list
    of one type, which is what transitions learn from.
    """
    r = random.Random(seed)
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digit + "abcdef", digit + lower + lower.upper()
    word = lambda: r.choice(PROSE) if r.random() < 0.7 else "".join(r.choices(lower, k=r.randint(3, 14)))
    name = lambda: r.choice([r.choice(SURNAMES), f"{r.choice(lower)}.{r.choice(SURNAMES)}", f"{r.choice(SURNAMES)}{r.randint(1, 99)}", "".join(r.choices(lower, k=r.randint(4, 10)))])
    num = lambda n: "".join(r.choices(digit, k=n))

    def code(n: int, chars: str) -> str:
        s = "".join(r.choices(chars, k=n))
        return s if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else "a1" + s[2:]

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "PL"]), num(r.randint(14, 24))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def issued() -> str:
        start = r.choice(ISSUED[:-2])
        return start + ("." if start in ("SG", "ya29") else "") + code(r.randint(16, 40), mixed)

    def signed() -> str:
        return "eyJ" + ".".join(code(r.randint(20, 160), mixed + "-_") for _ in range(3))

    def block() -> str:
        kind = r.choice(["RSA ", "EC ", "", "OPENSSH "])
        lines = "\n".join(code(64, mixed + "+/") for _ in range(r.randint(2, 6)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"

    def chosen() -> str:
        return r.choice([lambda: code(r.randint(8, 16), mixed), lambda: r.choice(SURNAMES).capitalize() + num(r.randint(2, 4)) + r.choice("!?#$%&*"), lambda: code(r.randint(7, 14), mixed + "!#%&*"), lambda: "".join(r.choices(mixed[10:], k=r.randint(16, 40)))])()

    def secret() -> tuple[str, str, str]:
        value = r.choice([lambda: code(r.choice([20, 24, 32, 40, 40, 64]), r.choice([hexes, mixed, mixed + "-_"])), issued, signed, block, chosen])()
        bare = value.startswith(ISSUED) and r.random() < 0.5
        label = r.choice(["token", "api_key", "secret", "password", "auth_token", "PASSWORD", "passwd", "client_secret", "Authorization: Bearer", "access key"])
        opening = "" if label.endswith("Bearer") else r.choice(['"', "'", "", ""])
        between = " " if label.endswith("Bearer") else r.choice([" = ", "=", ": ", ": ", " is ", '": '])
        if value[0] == "-" or bare:
            return r.choice(["", "key ", "found "]), value, ""
        return label + between + opening, value, opening

    def entity(kind: str, again: bool) -> tuple[str, str, str]:
        if kind == "secret":
            return secret()
        if kind == "national_id":
            if not again and r.random() < 0.3:
                return r.choice(["passport ", "Passport No. ", "passport: ", "Reisepass "]), r.choice([f"{r.choice(lower).upper()}{num(8)}", num(9), code(9, "CFGHJK" + digit * 2)[:2].upper() + num(7)]), ""
            if r.random() < 0.3:
                return r.choice(["SSN ", "ssn: ", "social security number "]), num(9), ""
            return "" if again else r.choice(["ssn ", "SSN: ", "social security ", ""]), f"{num(3)}-{num(2)}-{num(4)}", ""
        if kind == "iban":
            return "" if again else r.choice(["iban ", "IBAN: ", "account ", ""]), iban(), ""
        if kind == "local_phone":
            return "" if again else r.choice(["tel ", "call ", "phone: ", "fax ", ""]), r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), ""
        dot, host = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" AT ", " DOT "), (" [at] ", " dot ")])
        return r.choice(["mail ", "contact ", "", "write to "]), name() + dot + word() + host + r.choice(["com", "org", "net", "de", "fr"]), ""

    def decoy() -> str:
        return r.choice([
            lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"commit {code(40, hexes)}", lambda: f"{num(2)},{num(3)},{num(3)}",
            lambda: f"order {num(8)}", lambda: f"{num(4)} - {num(4)}", lambda: f"{word()} at {word()} {word()} {word()}", lambda: f"item {num(10)}", lambda: num(r.choice([16, 15, 12, 9, 8, 7])),
            lambda: f"{num(1)}.{num(9)}", lambda: f"isbn {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"sha256 {code(64, hexes)}", lambda: f"{num(3)}.{num(3)}.{num(4)}.{num(2)}", lambda: word() * 6,
            lambda: f"file {code(32, hexes)}", lambda: f"{num(2)}:{num(2)}:{num(2)} {num(4)}", lambda: f"{word()}{num(3)} {word()} {num(5)} {num(2)}",
            lambda: f"password {r.choice([': ', '= ', 'is '])}{word()} {word()}", lambda: f"token: {r.choice(['string', 'required', 'optional', 'missing', 'expired', 'invalid'])}", lambda: f"password={r.choice(['getpass()', 'get_password(user)', '$PASSWORD', '<password>', 'None', '********', '{password}', 'os.environ'])}",
            lambda: f"secret is {word()}", lambda: f"{word()} at {r.choice(['the', 'a', 'our', 'this'])} dot {r.choice(['com', 'matrix', 'org'])} {word()}", lambda: "-".join([code(8, hexes), code(4, hexes), code(4, hexes), code(4, hexes), code(12, hexes)]), lambda: f"src/{word()}/{word()}{num(2)}/{word()}_{word()}.py", lambda: f"{word()}_{word()}_{word()}_{num(2)}",
            lambda: f"passport {word()} {word()}", lambda: f"api_key = {word()}_{word()}", lambda: f"https://{word()}.org/{word()}/{num(4)}/{num(2)}/{word()}-{word()}-{word()}", lambda: f"id {code(16, hexes)}", lambda: f"invoice {num(9)}", lambda: num(9), lambda: f"{word()} {num(9)}", lambda: f"{num(1)}.{num(9)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(6)} {word()}, {num(5)} {word()}",
        ])()

    out = []
    for _ in range(size):
        text, spans, kind = " ".join(word() for _ in range(r.randint(0, 4))), [], None
        text += " " if text else ""
        for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3, 5])):
            again = kind is not None and r.random() < 0.5
            kind = kind if again else r.choice(ADDED)
            before, value, after = entity(kind, again)
            lo = len(text) + len(before)
            spans.append((lo, lo + len(value), kind))
            text += before + value + after + r.choice([" ", ", ", " and ", "; "] if again or r.random() < 0.5 else [" ", ", ", f" {word()} ", f" {word()}, {word()} "])
        if not spans or r.random() < 0.4:
            text += decoy() + r.choice([" ", ", ", ". "])
        out.append((text + " ".join(word() for _ in range(r.randint(0, 3))) + r.choice([".", "", ","]), spans))
    return out


@functools.cache
def trained(size: int = 900, seed: int = 7, rounds: int = 6, rate: float = 0.3, decay: float = 1e-3) -> SemiCRF:
    """A model fitted to ``training_set``; the same numbers give the same weights."""
    number: dict[str, int] = {}
    made = []
    for text, spans in training_set(size, seed):
        tokens = tokenized(text)
        start, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        segments = candidates(text, tokens, np.zeros(len(tokens), bool))
        gold = {(start[a], end[b], ADDED.index(k)) for a, b, k in spans if a in start and b in end}
        gold = {(i, j, k) for i, j, k in gold if any(i == x for x, _ in segments.get(j, ()))}
        if segments:
            made.append(Lattice(segments, gold, number))
    w, t = np.zeros((len(number), len(ADDED))), np.zeros((len(ADDED) + 1, len(ADDED)))
    order = random.Random(seed)
    for step in range(rounds):
        order.shuffle(made)
        for lattice in made:
            by_row, by_transition = lattice.gradient(w, t)
            x = lattice.used
            w[x] = w[x] * (1 - decay) + rate / (1 + step) * by_row[x]
            t = t * (1 - decay) + rate / (1 + step) * by_transition
    model = SemiCRF()
    model.w = {(k, f): v for f, i in number.items() for k, v in enumerate(w[i].tolist()) if v}
    model.w |= {(k, f"after type {b - 1}"): v for b, of in enumerate(t.tolist()) for k, v in enumerate(of)}
    return model


class Finder:
    """Added spans of a text; windows that recur, such as licence lines, are decoded once."""

    def __init__(self, model: SemiCRF, cache: int = 20_000):
        self.model = model
        self.short = functools.lru_cache(cache)(self._window)

    def window(self, text: str, barred: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int, str], ...]:
        return self.short(text, barred) if len(text) <= 1000 else self._window(text, barred)

    def _window(self, text: str, barred: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int, str], ...]:
        tokens = tokenized(text)
        mask = np.zeros(len(tokens), bool)
        at = 0
        for lo, hi in barred:
            while at < len(tokens) and tokens[at][1] <= lo:
                at += 1
            i = at
            while i < len(tokens) and tokens[i][0] < hi:
                mask[i] = True
                i += 1
        segments = candidates(text, tokens, mask)
        if not segments:
            return ()
        return tuple((tokens[i][0], tokens[j - 1][1], ADDED[k]) for i, j, k in self.model.decode(len(tokens), segments))

    def __call__(self, text: str, base: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Segments never cross a line but for a private key's block, so lines are decoded
        one by one, and such blocks apart from the lines around them."""
        union: list[list[int]] = []
        for lo, hi, _ in base:
            if union and lo <= union[-1][1]:
                union[-1][1] = max(hi, union[-1][1])
            else:
                union.append([lo, hi])
        blocks = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
        parts, at = [], 0
        for lo, hi in blocks:
            parts += [(at, text[at:lo], False), (lo, text[lo:hi], True)]
            at = hi
        parts.append((at, text[at:] if at else text, False))
        out: list[tuple[int, int, str]] = []
        nearby = 0
        for at, part, whole in parts:
            for line in (part,) if whole else part.split("\n"):
                end = at + len(line)
                if whole or _LINE.search(line):
                    while nearby < len(union) and union[nearby][1] <= at:
                        nearby += 1
                    barred = []
                    for lo, hi in itertools.islice(union, nearby, None):
                        if lo >= end:
                            break
                        barred.append((max(lo - at, 0), min(hi - at, len(line))))
                    got = self.window(line, ()) if whole else self._line(line, tuple(barred))
                    out += [(lo + at, hi + at, kind) for lo, hi, kind in got]
                at = end + 1
        return out

    def _line(self, line: str, barred: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, int, str]]:
        """The line's windows: what lies within reach of a trigger. Between windows no
        segment can be; the state of the field begins anew in each."""
        reach = MAX_CHARS + 40
        spans: list[list[int]] = []
        starts = [lo for lo, _ in barred]
        for m in _LINE.finditer(line):
            near = bisect.bisect_right(starts, m.start()) - 1
            if near >= 0 and m.end() <= barred[near][1]:
                continue
            lo, hi = max(0, m.start() - reach), min(len(line), m.end() + reach)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        for lo, hi in spans:  # to the next space, if one is near
            least, most = max(0, lo - reach), min(len(line), hi + reach)
            while lo > least and not line[lo - 1].isspace():
                lo -= 1
            while hi < most and not line[hi].isspace():
                hi += 1
            first = max(0, bisect.bisect_right(starts, lo) - 1)
            inside = tuple((max(a - lo, 0), min(b, hi) - lo) for a, b in barred[first : bisect.bisect_left(starts, hi)] if b > lo)
            for a, b, kind in self.window(line[lo:hi], inside):
                yield a + lo, b + lo, kind


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1])))


def found(docs: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` for each row.

    Offsets count code points of the whole text, ends excluded. ``n_spans`` counts base and
    added spans. Null and empty texts have no spans. Repeated rows give repeated results;
    other columns are ignored; an empty table gives none. Texts of any length are searched
    whole, line by line; a task holds one batch of them. An added span has MAX_TOKENS tokens
    at most, and MAX_CHARS characters if it is more than one token; runs, signed tokens and
    private keys' blocks are one token of any length. A password of letters alone is found
    only where its name and its mixture of cases or signs show it. The model, some 3,000
    weights, travels with the task.
    """
    model = model or trained()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                base: list[tuple[int, int, str]] = []
                added: list[tuple[int, int, str]] = []
                if raw and _TRIGGER.search(raw):
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    added = finder(text, base)
                counts = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added]), len(base) + len(added)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    return docs.select("doc_id", as_bytes()).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    return found(table(spark, sf_dir, "documents"))
