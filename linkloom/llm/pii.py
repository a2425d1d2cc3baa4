"""Surrogates for personal data: keyed, type-consistent, one to one.

Detectors find e-mail addresses, phone numbers, card numbers, IPv4 addresses, IBANs, social security
numbers, secrets (hex digests, access keys and values of secret-like names) and names after a title. Each match has
a kind and a canonical form (case folded, separators dropped), so all spellings of an entity share a
surrogate.

Formatted kinds are replaced by a keyed permutation of their characters: every digit stays a digit of its
script, every letter a letter of the same script and case (of the same block of the character table where a
script has no listed alphabet), other characters stay in place; octets stay octets, and card numbers and IBANs
whose check digits are right still have right ones. A permutation maps different entities of a pattern to
different surrogates, in every document, without any table.

A person is a family name and, if it is told, a given name. The surrogate of a family name depends on it
alone, that of a given name on both, so "Mr. John Smith", "Mr. Smith" and "Herr Smith" stay one family in all
documents; titles stay. In a document that names somebody with a title, the family name without one, alone or
behind that given name, is the same person. Given names are drawn by script and gender, which the title tells,
else the name's ending; names that no title introduces in their document are not found.

Collision check, over all distinct entities of the corpus: a surrogate must not be any entity that the corpus
has, nor another one's surrogate. Where it is, the entity (of equals all but the first) has a next attempt;
only these take part in the next round. From the ninth attempt on, surrogates of addresses and names get longer. What still fails
after `ROUNDS` attempts raises: nothing leaves with its original in place. The tables of the check hold keyed digests and sealed
(encrypted) forms, no clear text, and are removed. Exceptions go along with the text pass if there are at most
`max_exceptions`; if there are more, they are joined to the rows that need them.

The key must be given: who has it can undo the permutations. Defined cases: null texts stay null, empty ones empty;
repeated rows get the same result; very long texts are scanned whole; an empty table gives an empty result; all other
columns stay, whatever their names.
"""

from __future__ import annotations

import hmac
import re
import secrets
import unicodedata
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import byte_batches, byte_slices, discard, fresh, texts, work_table

#: Attempts that an entity has before the check gives up; from LONGER on, addresses and names get longer.
ROUNDS, LONGER = 64, 8


def _marks() -> str:
    """Ranges of the combining marks of the basic plane, which belong to the letters before them."""
    out, last = [], None
    for c in range(0x300, 0xFFFF):
        if unicodedata.category(chr(c))[0] == "M":
            if last is not None and c == last[1] + 1:
                last[1] = c
            else:
                last = [c, c]
                out.append(last)
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in out)


M = _marks()
# Titles that introduce a name, by what they tell of gender.
TITLES = {"f": ("Mrs.", "Ms.", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа"), "m": ("Mr.", "Herr", "Señor", "Monsieur", "Господин"), "": ("Dr.", "Prof.", "Доктор")}
TITLE = "|".join(re.escape(t) for t in sorted(sum(TITLES.values(), ()), key=len, reverse=True))
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
WORD = r"[^\W\d_a-z][\w" + M + r"]+(?:[-'’][^\W\d_a-z][\w" + M + r"]+)*"
# Detectors by kind, first match wins where they overlap.
PATTERNS = {
    "email": rf"[^\W_](?:[\w.+'{M}-]*[\w+{M}-])?@[^\W_](?:[\w{M}-]*[^\W_{M}]?[{M}]*)?(?:\.[^\W_](?:[\w{M}-]*[^\W_])?[{M}]*)+",
    "secret": r"(?i:(?<![^\W_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?)(?P<value>(?=[A-Za-z_+/.=-]*[0-9])[0-9A-Za-z_+/.=-]{8,})|(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64})(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){3,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![\w(])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "name": rf"(?<!\w)(?:{TITLE}) (?:(?:{WORD}|[^\W\d_a-z]\.) )?{WORD}(?!\w)",
}
GIVEN = {
    ("latin", "f"): ["Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Wanda"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Henry", "Ivan", "Jacob", "Leon", "Martin", "Nils", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor", "Walter"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
}
SYLLABLES = {"latin": [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрстфхч" for v in "аеиоу"]}
#: Letters that replace each other: (characters in lower case); upper case follows them.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]

SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these has no entity.
HINT = re.compile(r"[0-9@]|(?:Mr|Mrs|Ms|Dr|Prof)\.|Miss|Herr|Frau|Señor|Monsieur|Madame|Mme|Госпо|Доктор")


def _persons(text: str, found: list[tuple]) -> list[tuple]:
    """found with the names of a text taken apart, and further mentions of the families that a title introduces."""
    known: dict[str, dict[str, str]] = {}
    out = []
    for kind, a, z in found:
        if kind != "name":
            out.append((kind, a, z, None))
            continue
        title, _, names = text[a:z].partition(" ")
        a = z - len(names)
        *given, family = names.split(" ")
        gender = GENDER[title]
        mine = known.setdefault(family.casefold(), {})
        if given:
            mine[given[0]] = gender or mine.get(given[0], "")
        out.append((kind, a, z, None))
    if not known:
        return out
    families = {text[a:z].split(" ")[-1] for k, a, z, _ in out if k == "name"}
    bare = re.compile(rf"(?<!\w)(?:(?P<given>{WORD}|[^\W\d_a-z]\.) )?(?P<family>" + "|".join(re.escape(f) for f in sorted(families, key=lambda f: (-len(f), f))) + r")(?!\w)")
    taken, i, more = sorted((a, z) for _, a, z, _ in out), 0, []
    for m in bare.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start("family"):
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            own = m["given"] in known.get(m["family"].casefold(), ()) and (i == 0 or taken[i - 1][1] <= m.start())
            more.append(("name", m.start() if own else m.start("family"), m.end(), None))
    full = []
    for kind, a, z, _ in sorted([*out, *more], key=lambda f: f[1]):
        if kind == "name":
            *given, family = text[a:z].split(" ")
            gender = known.get(family.casefold(), {}).get(given[0], "") if given else ""
            gender = gender or ("f" if given and given[0][-1] in "aeаяAEАЯ" else "m")
            full.append((kind, a, z, (given[0] if given else "", family, gender)))
        else:
            full.append((kind, a, z, None))
    return full


def find(text: str | None) -> list[tuple]:
    """(kind, start, end, name) of the entities of a text, in order; name: (given, family, gender) of a person.

    The span of a person leaves the title out."""
    if not text or not HINT.search(text):
        return []
    found = [(m.lastgroup, *m.span("value" if m["value"] else 0)) for m in SCAN.finditer(text)]
    return _persons(text, found) if any(k == "name" for k, _, _ in found) else [(*f, None) for f in found]


def canonical(kind: str, match: str) -> str:
    """What all spellings of an entity share."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in match if c.isdigit())
    if kind == "iban":
        return match.replace(" ", "")
    if kind in ("family", "given"):
        return match.casefold()
    return match if kind == "key" or (kind == "secret" and not re.fullmatch(r"[0-9A-Fa-f]+", match)) else match.lower()


def forms(kind: str, match: str, name: tuple[str, str, str] | None) -> list[tuple[str, str]]:
    """(kind, canonical form) of what a match holds: a person has a family name and perhaps a given one."""
    if name is None:
        return [(kind, canonical(kind, match))]
    given, family, gender = name
    out = [("family", canonical("family", family))]
    if given and not given.endswith("."):
        out.append(("given", f"{gender}\t{given.casefold()}\t{family.casefold()}"))
    return out


@lru_cache(maxsize=None)
def _alphabet(c: str) -> str:
    """The characters that may stand for c: a listed alphabet, the digits of a script, or what is of the same
    category in the same 256 characters of the character table; case is kept. Empty for what isn't a letter or number."""
    for a in ALPHABETS:
        for case in (a, a.upper()):
            if c in case:
                return case
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if kind[0] not in "LN":
        return ""
    listed = "".join(ALPHABETS)
    row = ord(c) & ~0xFF
    steady = lambda x: kind not in ("Lu", "Ll") or len(x.upper()) == len(x.lower()) == 1 and x.upper().lower() == x.lower()
    if not steady(c):
        return ""
    return "".join(x for x in map(chr, range(row, row + 256)) if unicodedata.category(x) == kind and x.lower() not in listed and steady(x))


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, repr(parts).encode("utf-8", "surrogatepass"), lambda d=b"": blake2b(d, digest_size=64)).digest(), "big")


def permute(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """Keyed permutation of the mixed-radix numbers with the given radices: eight Feistel rounds."""
    if not values:
        return []
    half = len(values) // 2
    sizes, sides = [], []
    for part in (slice(0, half), slice(half, None)):
        n, x = 1, 0
        for v, r in zip(values[part], radices[part]):
            n, x = n * r, x * r + v
        sizes.append(n)
        sides.append(x)
    for i in range(8):
        a = i % 2
        sides[a] = (sides[a] + _prf(key, tweak, i, tuple(radices), sides[1 - a])) % sizes[a]
    out: list[int] = []
    for part, x in zip((radices[:half], radices[half:]), sides):
        digits = []
        for r in reversed(part):
            x, d = divmod(x, r)
            digits.append(d)
        out += digits[::-1]
    return out


def _luhn(digits: list[int]) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, account: str) -> int:
    """The check digits of an account: what makes the whole number 1 modulo 97."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def reshaped(text: str, key: bytes, tweak: str) -> str:
    """Keyed permutation of the letters and digits of a text; letters are spelled anew in ASCII where
    nothing in it has a second form."""
    at = [i for i, c in enumerate(text) if len(_alphabet(c)) > 1]
    if not at and text:
        n, out = _prf(key, tweak, "spelled", text), []
        for _ in range(max(6, len(text))):
            n, d = divmod(n, 26)
            out.append(ALPHABETS[0][d])
        return "".join(out)
    sets = [_alphabet(text[i]) for i in at]
    got = permute([s.index(text[i]) for i, s in zip(at, sets)], [len(s) for s in sets], key, tweak)
    out = list(text)
    for i, s, v in zip(at, sets, got):
        out[i] = s[v]
    return "".join(out)


def _script(word: str) -> str | None:
    if re.search("[а-яё]", word, re.I):
        return "cyrillic"
    return "latin" if re.search("[a-z]", word, re.I) else None


class Surrogates:
    """canonical form -> surrogate of it. attempts: exceptions of the collision check, by digest."""

    def __init__(self, key: bytes, attempts: dict[bytes, int] | None = None):
        self.key, self.attempts = key, attempts or {}
        self.made: dict[tuple[str, str], str] = {}

    def digest(self, kind: str, form: str) -> bytes:
        return blake2b(f"{kind}\n{form}".encode("utf-8", "surrogatepass"), digest_size=16, key=self.key[:64], person=b"entity").digest()

    def seal(self, digest: bytes, data: bytes) -> bytes:
        """data under a key stream of its digest; sealing twice opens."""
        stream = b"".join(blake2b(digest + i.to_bytes(4, "big"), key=self.key[:64], person=b"seal").digest() for i in range(-(-len(data) // 64)))
        return bytes(a ^ b for a, b in zip(data, stream))

    def of(self, kind: str, form: str, attempt: int | None = None) -> str:
        if attempt is None:
            attempt = self.attempts.get(self.digest(kind, form), 0) if self.attempts else 0
        tweak = f"{kind}/{attempt}"
        more = max(0, attempt - LONGER + 1)
        if kind == "email":
            local, _, domain = form.rpartition("@")
            name, dot, top = domain.rpartition(".")
            tail = "".join("." + self._syllables("latin", 2, "email", i, form) for i in range(more))
            return f"{reshaped(local, self.key, tweak + '/local')}{tail}@{reshaped(name, self.key, f'domain/{attempt // 4}')}{dot}{top}"
        if kind == "ip":
            return ".".join(map(str, permute([int(x) for x in form.split(".")], [256] * 4, self.key, tweak)))
        if kind == "card":
            digits = [int(c) for c in form]
            gap = (digits[-1] - _luhn(digits[:-1])) % 10
            head = permute(digits[:-1], [10] * (len(digits) - 1), self.key, tweak)
            return "".join(map(str, [*head, (_luhn(head) + gap) % 10]))
        if kind == "secret" and re.fullmatch(r"[0-9a-f]+", form):
            return "".join(f"{x:x}" for x in permute([int(c, 16) for c in form], [16] * len(form), self.key, tweak))
        if kind == "iban":
            country, check, account = form[:2], int(form[2:4]), form[4:]
            new = reshaped(account, self.key, tweak)
            gap = check - _iban_check(country, account)
            return f"{country}{_iban_check(country, new) if not gap else (_iban_check(country, new) + gap) % 97:02d}{new}"
        if kind == "key":
            return form[:4] + reshaped(form[4:], self.key, tweak)  # the kind of key stays
        if kind == "family":
            script = _script(form)
            if script is None:
                return reshaped(form, self.key, tweak) + (reshaped(form, self.key, f"{tweak}/more") if more else "")
            ending = "n" if script == "latin" else "ва" if form[-1] in "ая" else "в"
            return (self._syllables(script, 4 + more, "family", attempt, form) + ending).capitalize()
        if kind == "given":
            gender, given, family = form.split("\t")
            script = _script(given)
            if script is None:
                return reshaped(given, self.key, tweak + family)
            names = GIVEN[script, gender]
            drawn = names[_prf(self.key, "given", attempt, form) % len(names)]
            return drawn if attempt < LONGER else f"{drawn}-{self._syllables(script, 2 + more, 'given', attempt, form).capitalize()}"
        return reshaped(form, self.key, tweak)

    def _syllables(self, script: str, n: int, *parts) -> str:
        x, syllables, out = _prf(self.key, *parts), SYLLABLES[script], ""
        for _ in range(n):
            x, i = divmod(x, len(syllables))
            out += syllables[i]
        return out

    def _known(self, kind: str, form: str) -> str:
        got = self.made.get((kind, form))
        if got is None:
            if len(self.made) > 100_000:
                self.made.clear()
            got = self.made[kind, form] = self.of(kind, form)
        return got

    def _initial(self, initial: str, family: str) -> str:
        letters = _alphabet(initial)
        if len(letters) < 2:
            return "X"
        return letters[(letters.index(initial) + 1 + _prf(self.key, "initial", family.casefold()) % (len(letters) - 1)) % len(letters)]

    def rendered(self, kind: str, match: str, name: tuple[str, str, str] | None = None) -> str:
        """Surrogate of a match in the spelling (separators, case) of the match."""
        if name is not None:
            given, family, _ = name
            new = [self._known(k, f) for k, f in forms(kind, match, name)]
            if given.endswith("."):
                new.append(self._initial(given[0], family) + ".")
            old = [family, *([given] if given else [])]
            return " ".join(n.upper() if o.isupper() and len(o) > 2 else n for n, o in reversed(list(zip(new, old))))
        form = canonical(kind, match)
        got = self._known(kind, form)
        if kind in ("phone", "card", "ssn", "iban") and len(match) != len(form):
            it, kept = iter(got), set(" .-()+") if kind != "iban" else {" "}
            return "".join(c if c in kept else next(it) for c in match)
        if kind in ("email", "secret") and match != form:
            if match.isupper() or len(got) != len(match):
                return got.upper() if match.isupper() else got
            return "".join(g.upper() if m.isupper() else g for g, m in zip(got, match))
        return got

    def text(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """Text with surrogates, and (kind, start, end) of each in the new text."""
        found = find(text)
        if not found:
            return text, []
        out, spans, last, size = [], [], 0, 0
        for kind, a, z, name in found:
            new = self.rendered(kind, text[a:z], name)
            out += [text[last:a], new]
            size += a - last
            spans.append((kind, size, size + len(new)))
            size, last = size + len(new), z
        return "".join(out) + text[last:], spans

    def mark(self, kind: str, form: str, attempt: int) -> bytes:
        """Digest of a surrogate as if it were an entity: equal to that of an entity which it would be taken
        for. Given names count within their family."""
        new = self.of(kind, form, attempt)
        if kind == "given":
            return self.digest("drawn", f"{new.casefold()}\t{form.split(chr(9))[2]}")
        return self.digest(kind, canonical(kind, new))


ENTITY = "kind string, id binary, form binary"
MADE = "kind string, id binary, form binary, attempt int, mark binary"


def _entities(key: bytes):
    def run(batches):
        s = Surrogates(key)
        for b in byte_batches(batches, "text"):
            got = {f for t in b.column("text").to_pylist() for k, a, z, n in find(t) for f in forms(k, t[a:z], n)}
            rows = [(k, d := s.digest(k, f), s.seal(d, f.encode("utf-8", "surrogatepass"))) for k, f in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["kind", "id", "form"])

    return run


def _made(key: bytes):
    def run(batches):
        s = Surrogates(key)
        for b in batches:
            kinds, ids, sealed, attempts = (b.column(c).to_pylist() for c in ("kind", "id", "form", "attempt"))
            marks = [s.mark(k, s.seal(d, f).decode("utf-8", "surrogatepass"), n) for k, d, f, n in zip(kinds, ids, sealed, attempts)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "id", "form", "attempt")), pa.array(marks, pa.binary())], names=["kind", "id", "form", "attempt", "mark"])

    return run


def attempts(rows: DataFrame, key: bytes) -> DataFrame:
    """(id, attempt) of the entities whose first surrogate is taken; the attempt gives one that isn't."""
    entities = work_table(rows.mapInArrow(_entities(key), ENTITY).groupBy("kind", "id").agg(F.first("form").alias("form")), "entities")
    own = entities.select("kind", F.col("id").alias("mark"))
    pending, tables, settled = entities.withColumn("attempt", F.lit(0)), [entities], None
    for _ in range(ROUNDS):
        made = work_table(pending.mapInArrow(_made(key), MADE), "made")
        tables.append(made)
        taken = own if settled is None else own.unionByName(settled.select("kind", "mark"))
        first = made.groupBy("kind", "mark").agg(F.min("id").alias("first"))
        free = first.join(taken, ["kind", "mark"], "left_anti").select(F.col("kind").alias("f_kind"), F.col("mark").alias("f_mark"), "first")
        judged = made.join(free, (F.col("kind") == F.col("f_kind")) & (F.col("mark") == F.col("f_mark")) & (F.col("id") == F.col("first")), "left")
        judged = work_table(judged.select("kind", "id", "form", "attempt", "mark", F.col("first").isNull().alias("again")), "judged")
        tables.append(judged)
        good = judged.where("not again").select("kind", "id", "attempt", "mark")
        settled = good if settled is None else settled.unionByName(good)
        pending = judged.where("again").select("kind", "id", "form", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            break
    else:
        raise ValueError(f"{pending.count()} entities have no surrogate of their own after {ROUNDS} attempts")
    out = work_table(settled.where("attempt > 0").select("id", "attempt"), "attempts")
    discard(*tables)
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
REPLACED = "struct<text:string,entities:array<struct<kind:string,start:int,end:int>>>"


def _replaced(key: bytes, shared):
    """Column function (text, own exceptions): the latter, lists of (id, attempt), only where they aren't shared."""

    def arrays(got: list) -> pa.Array:
        spans = pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in g[1]] for g in got], SPANS)
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), spans], names=["text", "entities"])

    def joined(parts: list[pa.Array]) -> pa.Array:
        return pa.concat_arrays(parts) if parts else arrays([])

    @F.arrow_udf(REPLACED)
    def replace(text: pa.Array) -> pa.Array:
        s = Surrogates(key, shared.value)
        return joined([arrays([s.text(t) for t in part]) for part in byte_slices(text)])

    @F.arrow_udf(REPLACED)
    def replace_own(text: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for t, o in zip(text.to_pylist(), own.to_pylist()):
            out.append(arrays([Surrogates(key, {e["id"]: e["attempt"] for e in o or ()}).text(t)]))
        return joined(out)

    return replace, replace_own


def _needed(key: bytes):
    """(doc_id, hash, id): which entities a row has."""

    def run(batches):
        s = Surrogates(key)
        for b in byte_batches(batches, "text"):
            rows = [(d, h, s.digest(*f)) for d, h, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hash", "text"))) for f in {f for k, a, z, n in find(t) for f in forms(k, t[a:z], n)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "hash", "id"])

    return run


def session_key(spark: SparkSession) -> bytes:
    """The key in spark.linkloom.pii.key (hexadecimal); where it is unset, a new one that nobody keeps."""
    given = spark.conf.get("spark.linkloom.pii.key", None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", found_col: str = "_entities", max_exceptions: int = 50_000) -> DataFrame:
    """docs with surrogates in text_col, all other columns, and as the last one found_col: kind and span of each
    surrogate (underscores are added to its name while docs has such a column)."""
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes or more")
    spark = docs.sparkSession
    found_col, exc_col, id2, hash2 = fresh(docs, found_col, "_exceptions", "_d", "_h")
    rows = texts(docs, id_col, text_col)
    exceptions = attempts(rows, key)
    if exceptions.count() <= max_exceptions:
        shared = spark.sparkContext.broadcast({bytes(r["id"]): r["attempt"] for r in exceptions.collect()})  # at most max_exceptions
        discard(exceptions)
        out = docs.withColumn(found_col, _replaced(key, shared)[0](docs[text_col]))
    else:
        hashed = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
        own = hashed.mapInArrow(_needed(key), "doc_id long, hash long, id binary").distinct().join(exceptions, "id")
        own = work_table(own.groupBy(F.col("doc_id").alias(id2), F.col("hash").alias(hash2)).agg(F.collect_list(F.struct("id", "attempt")).alias(exc_col)), "row_exceptions")
        on = docs[id_col].cast("long").eqNullSafe(own[id2]) & (F.xxhash64(docs[text_col].cast("string")) == own[hash2])
        out = docs.join(own, on, "left").withColumn(found_col, _replaced(key, None)[1](docs[text_col], F.col(exc_col))).drop(id2, hash2, exc_col)
    return out.withColumn(text_col, F.col(found_col)["text"]).withColumn(found_col, F.col(found_col)["entities"])
