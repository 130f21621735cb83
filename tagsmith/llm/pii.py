"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

Surrogates come from keyed permutations (a Feistel network over the characters that may change, each
within its own alphabet), so two entities of a format never get the same surrogate, and an entity gets
the same one wherever it occurs, without any table of entities. `collisions` checks this over a corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from tagsmith.llm.common import add_columns, fresh

# First names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): (
        "Alice", "Amelia", "Andrea", "Angela", "Anna", "Barbara", "Camille", "Carla", "Carmen", "Caroline", "Charlotte", "Chloe",
        "Claudia", "Cristina", "Elena", "Elizabeth", "Emily", "Emma", "Florence", "Franziska", "Gabriela", "Hannah", "Helen",
        "Ingrid", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lisa", "Lucia", "Maria",
        "Marta", "Mary", "Mathilde", "Monika", "Olivia", "Patricia", "Rachel", "Sabine", "Sarah", "Sofia", "Sophie", "Susan",
        "Teresa", "Ursula", "Valentina"),
    ("latin", "m"): (
        "Alejandro", "Alexander", "Andreas", "Andrew", "Antoine", "Antonio", "Benjamin", "Carlos", "Charles", "Christian", "Daniel",
        "David", "Diego", "Edward", "Fernando", "Francisco", "Friedrich", "George", "Guillaume", "Heinrich", "Henry", "Hugo",
        "James", "Javier", "Jean", "Johannes", "John", "Joseph", "Juan", "Jürgen", "Klaus", "Laurent", "Louis", "Luis", "Manuel",
        "Matthias", "Michael", "Miguel", "Nicolas", "Oliver", "Pablo", "Patrick", "Paul", "Peter", "Philippe", "Pierre",
        "Robert", "Stefan", "Thomas", "William"),
    ("cyrillic", "f"): ("Александра", "Анна", "Вера", "Дарья", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Александр", "Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей", "Юрий"),
}
_BY_NAME = {n: (k, i) for k, names in FIRST_NAMES.items() for i, n in enumerate(names)}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
# the order decides where two would overlap: the first that starts earliest, then the first listed
_PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:\b(?:token|password|passwd|secret|api_?key))\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[A-Za-z0-9+/_-]{12,128})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]|[.-]\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w]|[.-]\d)",
}
_FIND = re.compile("|".join(f"(?P<{k}_>{p})" for k, p in _PATTERNS.items()))
_HINT = re.compile(r"\d|@|AKIA|ASIA|[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{12}")
_FIRST = "|".join(sorted((re.escape(x) for n in _BY_NAME for x in (n, n.upper())), key=len, reverse=True))
_GIVEN = rf"(?:{_FIRST})(?:-[{_UP}][{_UP}{_LOW}]+)*"
_SURNAME = rf"(?:[{_UP}]['’])?[{_UP}][{_UP}{_LOW}]+(?:(?!['’][sS](?!\w))['’-][{_UP}][{_UP}{_LOW}]*)*"
_PARTICLES = "(?:(?:von|van|de|der|den|del|della|di|da|dos|du|la|le) ){0,3}"
_NO_SURNAME = "And|As|At|But|By|For|From|Had|Has|He|In|Is|It|Of|On|Or|Said|She|The|They|To|Was|We|Who|Will|With|You"
# anchored at a listed first name, so a capitalised word before it doesn't hide it
_NAME = re.compile(
    rf"(?<!\w)(?P<given>{_GIVEN}(?: (?:{_GIVEN}|[{_UP}]\.))*) (?P<particles>{_PARTICLES})(?!(?:{_NO_SURNAME})(?!\w))(?P<last>{_SURNAME})(?!\w)")
_WORD = re.compile(rf"[{_UP}{_LOW}]+")
_SIGNS = re.compile(rb"\xe2\x80.|\xc2[\xa0-\xbf]", re.DOTALL)
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NAME_BYTES = frozenset(x.encode() for n in _BY_NAME for x in (n, n.upper()))

_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöùúûüýÿ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя")
_CLASS = {c: a for a in _ALPHABETS for c in a}


def permute(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all lists of values under these radices, none of which stays as it is (unless there
    is only one): through an unbalanced Feistel network, one step on, and back through the network."""
    n = len(values)
    if n == 1:
        order = sorted(range(radices[0]), key=lambda v: hmac.digest(key, f"{tweak}|one|{radices[0]}|{v}".encode(), "sha256"))
        return [order[(order.index(values[0]) + 1) % radices[0]]]
    half, out = n // 2, list(values)

    def turn(number: int, sign: int) -> None:
        mine, other = (range(half), range(half, n)) if number % 2 else (range(half, n), range(half))
        seed = hmac.digest(key, f"{tweak}|{radices}|{number}|{[out[i] for i in other]}".encode(), "sha256")
        stream = hashlib.shake_256(seed).digest(8 * len(mine))
        for k, i in enumerate(mine):
            out[i] = (out[i] + sign * int.from_bytes(stream[8 * k : 8 * k + 8], "little")) % radices[i]

    for number in range(10):
        turn(number, 1)
    for i in range(n):  # the next list, as the next number
        out[i] = (out[i] + 1) % radices[i]
        if out[i]:
            break
    for number in reversed(range(10)):
        turn(number, -1)
    return out


def _text(text: str, key: bytes, tweak: str, keep: Callable[[int], bool] = lambda i: False, hexadecimal: bool = False) -> str:
    """Permutes the letters and digits of a text within their alphabets; case and all else stay."""
    low = text.lower()
    alphabets = ["0123456789abcdef" if hexadecimal else _CLASS.get(c, "") for c in low]
    at = [i for i, a in enumerate(alphabets) if low[i] in a and a and not keep(i)] if len(low) == len(text) else []
    if not at:
        return text
    shape = "".join("." if a == "" else c if keep(i) else str(len(a)) for i, (a, c) in enumerate(zip(alphabets, low, strict=True)))
    new = permute([alphabets[i].index(low[i]) for i in at], [len(alphabets[i]) for i in at], key, f"{tweak}|{shape}")
    out = list(text)
    for i, v in zip(at, new, strict=True):
        c = alphabets[i][v]
        out[i] = c.upper() if text[i] != low[i] else c
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    """The check digit that goes behind these."""
    return -sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def _refill(text: str, digits: list[int]) -> str:
    left = iter(digits)
    return re.sub(r"\d", lambda _: str(next(left)), text)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isascii() and c.isdigit()]


def normal(kind: str, text: str) -> str | None:
    """What makes two mentions the same entity; None if the text isn't an entity of that kind after all."""
    if kind == "card":
        d = _digits(text)
        return "".join(map(str, d)) if 13 <= len(d) <= 19 and _luhn(d[:-1]) == d[-1] and any(d) else None
    if kind == "iban":
        s = text.replace(" ", "")
        return s if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None
    if kind == "ip":
        return None if text.startswith("127.") or text in ("0.0.0.0", "255.255.255.255") else ".".join(str(int(x)) for x in text.split("."))
    if kind == "phone":
        d = "".join(map(str, _digits(text)))
        return (d[-10:] if len(d) >= 10 else d) if 8 <= len(d) <= 15 else None
    if kind == "name":
        return text.title() if _NAME.fullmatch(text) else None
    return text.lower() if kind == "email" else text


@lru_cache(200_000)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The surrogate of an entity in the format of this mention."""
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{_text(local, key, f'local|{domain.lower()}')}@{_text(host, key, f'domain|{top.lower()}')}.{top}"
    if kind == "ip":
        own = [int(x) for x in text.split(".")]
        fixed = 1 if own[0] == 10 else 2 if own[:2] == [192, 168] or own[0] == 172 and 16 <= own[1] <= 31 else 0
        if fixed:
            return ".".join(map(str, own[:fixed] + permute(own[fixed:], [256] * (4 - fixed), key, f"ip|{own[:fixed]}")))
        while True:  # along the cycle to the next public address: still a permutation of these
            own = permute(own, [256] * 4, key, "ip")
            if own[0] not in (0, 10, 127) and own[:2] != [192, 168] and not (own[0] == 172 and 16 <= own[1] <= 31) and own != [255] * 4:
                return ".".join(map(str, own))
    if kind == "card":
        d = _digits(text)
        new = d[:1] + permute(d[1:-1], [10] * (len(d) - 2), key, f"card|{d[0]}|{len(d)}")
        return _refill(text, [*new, _luhn(new)])
    if kind == "iban":
        s = text.replace(" ", "")
        new = _text(s[4:], key, f"iban|{s[:2]}")
        check = 98 - int("".join(str(int(c, 36)) for c in f"{new}{s[:2]}00")) % 97
        filled = iter(f"{s[:2]}{check:02d}{new}")
        return re.sub(r"\S", lambda _: next(filled), text)
    if kind == "phone":
        d = _digits(text)
        code = max(0, len(d) - 10)
        return _refill(text, d[:code] + permute(d[code:], [10] * (len(d) - code), key, "phone"))
    if kind == "ssn":
        return _refill(text, permute(_digits(text), [10] * 9, key, "ssn"))
    if kind == "secret":
        return _text(text, key, kind, hexadecimal=re.fullmatch("[0-9a-f]+", text) is not None)
    if kind == "key":
        return text[:4] + _text(text[4:], key, kind)
    m = _NAME.fullmatch(text)
    script = _script(m)
    given = _WORD.sub(lambda w: _given(w.group(), key, script), m["given"])
    return f"{given} {m['particles']}{_text(m['last'], key, f'last|{script}')}"


def _script(m: re.Match) -> str:
    return _BY_NAME[_WORD.match(m["given"]).group().title()][0][0]


def _given(word: str, key: bytes, script: str) -> str:
    """The surrogate of a given name or an initial."""
    if word.title() not in _BY_NAME:
        return _text(word, key, f"last|{script}")
    group, at = _BY_NAME[word.title()]
    names = FIRST_NAMES[group]
    new = names[permute([at], [len(names)], key, f"first|{group}")[0]]
    return new.upper() if word.isupper() else new


def _alone(names: list[str]) -> dict[str, tuple[bool, str]]:
    """(is a given name, script) of the words that stand for one of these full names when alone."""
    out: dict[str, tuple[bool, str]] = {}
    for m in map(_NAME.fullmatch, names):
        out.setdefault(m["last"].lower(), (False, _script(m)))
    for m in map(_NAME.fullmatch, names):
        for w in _WORD.findall(m["given"]):
            if len(w) > 1:
                out[w.lower()] = (True, _script(m))
    return out


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in a text, from left to right, without overlaps."""
    if not text:
        return []
    out = []
    if _HINT.search(text):
        for m in _FIND.finditer(text):
            kind = m.lastgroup[:-1] if m.lastgroup.endswith("_") else "secret"
            span = m.span("secret") if kind == "secret" else m.span()
            if normal(kind, text[slice(*span)]) is not None:
                out.append((*span, kind))
    if not _NAME_BYTES.isdisjoint(_SIGNS.sub(b" ", text.encode()).translate(_LETTERS).split()):
        names = _free(_NAME, text, out)
        if names:
            out += [(*span, "name") for span in names]
            words = _alone([text[slice(*span)] for span in names])
            mentioned = {text[slice(*m.span())] for m in re.finditer(_SURNAME, text) if m.group().lower() in words}
            mentioned |= {x for w in words for x in (w.title(), w.upper()) if x.lower() in words}
            one = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, mentioned), key=len, reverse=True))})(?!\w)")
            out += [(*span, "name") for span in _free(one, text, out)]
        out.sort()
    return out


def _free(pattern: re.Pattern, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the pattern that no other entity overlaps."""
    taken, k, out = sorted(taken), 0, []
    for m in pattern.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append(m.span())
    return out


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each mention.

    A part of a full name that stands alone elsewhere in the text gets the surrogate it has in the full name.
    """
    found = entities(text)
    if not found:
        return text, []
    words = _alone([text[a:b] for a, b, kind in found if kind == "name" and " " in text[a:b]])
    parts, done, pairs = [], 0, []
    for a, b, kind in found:
        if kind == "name" and " " not in text[a:b]:
            given, script = words[text[a:b].lower()]
            new = _given(text[a:b], key, script) if given else _text(text[a:b], key, f"last|{script}")
        else:
            new = surrogate(kind, text[a:b], key)
        pairs.append((kind, text[a:b], new))
        parts += [text[done:a], new]
        done = b
    return "".join([*parts, text[done:]]), pairs


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """The rows of `docs` with surrogates in `text`; all columns and rows stay.

    With `found`, a further column of that name lists each mention: kind, entity, surrogate. The same key
    gives the same surrogates in every run. Null texts stay null, texts without entities as they are;
    texts of any length are read whole. Repeated rows stay alike, empty tables and further columns do no
    harm.
    """
    new, pairs = fresh(docs, "replaced"), found or fresh(docs, "mentions")

    def make() -> Callable:
        secret = hashlib.sha256(key.encode()).digest()

        def task(b: dict) -> dict:
            done = [replace(t, secret) for t in b[text]]
            return {new: [t for t, _ in done], pairs: [[{"kind": k, "entity": e, "surrogate": s} for k, e, s in p] for _, p in done]}

        return task

    out = add_columns(docs, [text], make, f"`{new}` string, `{pairs}` array<struct<kind:string,entity:string,surrogate:string>>")
    columns: list[Column] = [F.col(f"`{new}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.col(f"`{pairs}`")] if found else []))


def collisions(mentions: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity: kind, surrogate, n_entities; empty if all is well.

    `mentions` has the column of `pseudonymised(found=...)` as `mentions`. Entities are compared without
    case where case doesn't matter; counting is partial before the shuffle, so a frequent entity does no harm.
    """
    one = mentions.select(F.explode("mentions").alias("m")).select(
        "m.kind", F.when(F.col("m.kind").isin("email", "name"), F.lower("m.entity")).otherwise(F.col("m.entity")).alias("entity"),
        F.when(F.col("m.kind").isin("email", "name"), F.lower("m.surrogate")).otherwise(F.col("m.surrogate")).alias("surrogate")).distinct()
    return one.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities")).where("n_entities > 1")
