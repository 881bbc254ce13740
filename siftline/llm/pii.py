"""PII by surrogate generation.

Detected entities are replaced by keyed surrogates of the same type and format: digits stay digits and keep
their punctuation, card numbers keep their issuer digit and a valid check digit, IBANs get a valid check
number, secrets keep their length and get letters for letters, digits for digits and symbols for symbols, names keep gender and
script. One entity has one surrogate in the whole corpus, however it is written (coreference), and two entities never share one,
whatever their kinds (distinctness): surrogates are drawn from a keyed hash, drawn surrogates are checked
against each other and against all entities of the corpus, and those that lose are drawn again. From draw ``GROWS`` on a
surrogate gets a character more with each draw, so a kind whose format has too few forms departs from it in length, and never fails.

The distinct entities are agreed on in a distributed way (a loop of grouped minima); what each document needs
comes back to it with one shuffle of the texts. Persons are found by titles and by the given names listed below, so other
names stay; the key is the caller's, and whoever has it can recompute surrogates.

Defined cases: a null text stays null and has no entities; an empty text stays empty. Rows that repeat get
equal results, whether or not they share a ``doc_id``, which may be null. An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import durable, fields
from .memory import trim

#: The first draw whose surrogates are longer than their entities.
GROWS = 8

# Patterns of the entities that are looked for.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)\s?[=:]\s?[\"']?(?P<secret>[^\s\"']{6,})",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]\d|\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
# Titles and given names that mark a person's name, by gender and script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra"], "n": ["Dr", "Prof"]}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Pierre", "Hans", "Carlos", "Juan", "Luis", "Karl", "Jean"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Maria", "Julia", "Claire", "Carmen", "Laura", "Emma", "Ingrid"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}
# Syllables from which surrogate names are built, and their endings by gender.
SYLLABLES = {"latin": "ba be bi bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi za".split(), "cyrillic": "ба бе бо ва ве ви да де до ка ке ла ле ли ма ме ми на не но па ра ре ри ро са се та те ти".split()}
ENDINGS = {("m", "latin"): ["n", "s", "r", "d"], ("f", "latin"): ["na", "la", "ra", "lia"], ("m", "cyrillic"): ["н", "р", "с", "д"], ("f", "cyrillic"): ["на", "ла", "ра", "ния"], ("n", "latin"): ["man", "son", "ter", "ton"], ("n", "cyrillic"): ["ов", "ев", "ин", "ко"]}

_GENDER = {name: g for (g, _), names in GIVEN.items() for name in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]{1,30}|[А-ЯЁ][а-яё-]{1,30}"
_PERSON = re.compile(rf"\b(?P<title>{'|'.join(_TITLE)})\.? (?P<one>{_NAME})(?: (?P<two>{_NAME}))?|\b(?P<given>{'|'.join(_GENDER)}) (?P<family>{_NAME})")
_ALL = re.compile("|".join(f"(?P<{k}_>{p})" for k, p in PATTERNS.items()))
_HINT = re.compile("[0-9@=:]")


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity): non-overlapping, in order of start. ``entity`` is the form that coreferent mentions share."""
    found = []
    if _HINT.search(text):
        for m in _ALL.finditer(text):
            kind = m.lastgroup if m.lastgroup != "secret" else "secret_"
            kind = kind.removesuffix("_")
            start, end = m.span("secret") if kind == "secret" else m.span()
            value = text[start:end]
            if kind == "secret":
                kind = "hex" if re.fullmatch(r"[0-9a-f]+", value) else "secret"
            digits = re.sub(r"\D", "", value)
            if kind == "phone":
                entity = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
            elif kind in ("card", "ssn"):
                entity = digits
            elif kind == "iban":
                entity = value.replace(" ", "")
            else:
                entity = value.lower() if kind == "email" else value
            found.append((start, end, kind, entity))
    for m in _PERSON.finditer(text):
        gender = _TITLE.get(m["title"], "n") if m["title"] else _GENDER[m["given"]]
        parts = [("given", m.span("given")), ("family", m.span("family"))] if m["given"] else [("given", m.span("one")), ("family", m.span("two"))] if m["two"] else [("family", m.span("one"))]
        for role, (start, end) in parts:
            word = text[start:end]
            sex = _GENDER.get(word, gender) if role == "given" else "n"
            found.append((start, end, f"{role}_{sex if role == 'given' and sex != 'n' else 'n'}_{_script(word)}", word.lower()))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, at = [], 0
    for x in found:
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


class _Stream:
    """Numbers from a keyed hash of an entity and the number of the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, []

    def below(self, n: int) -> int:
        if not self.left:
            digest = hashlib.blake2b(self.seed, key=self.key, salt=self.block.to_bytes(8, "big")).digest()
            self.left = [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 64, 4)]
            self.block += 1
        return self.left.pop() % n


def _luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return -total % 10


#: What stands for a symbol of a secret; no white space, quotes or separators.
SYMBOLS = "!#$%&*+-/<=>?@^_~"


def _like(value: str, draw: _Stream, hexadecimal: bool = False, symbols: bool = False) -> str:
    """Letters, capitals and digits for the same, and symbols for symbols if they are to change; all else stays."""
    out = []
    for c in value:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isdecimal():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            base, n = ("а", 32) if _script(c.lower()) == "cyrillic" else ("a", 26)
            x = chr(ord(base) + draw.below(n))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(SYMBOLS[draw.below(len(SYMBOLS))] if symbols else c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The ``attempt``-th surrogate of an entity, in the form in which entities are compared."""
    draw = _Stream(key, kind, entity, attempt)
    more = "0" * max(0, attempt - GROWS + 1)  # room where the format has too few forms
    if kind == "email":
        local, _, _domain = entity.partition("@")
        return f"{_like(local + more, draw)}@mail{draw.below(1000)}.example.{('com', 'org', 'net')[draw.below(3)]}"
    if kind == "ip":
        return f"{1 + draw.below(223)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}{_like(more, draw)}"
    if kind in ("phone", "ssn"):
        return str(2 + draw.below(8)) + _like(entity[1:] + more, draw)
    if kind == "card":
        body = entity[0] + _like(entity[1:-1] + more, draw)
        valid = _luhn(entity[:-1]) == int(entity[-1])
        return body + (str(_luhn(body)) if valid else str(draw.below(10)))
    if kind == "iban":
        rest = _like(entity[4:] + more, draw)
        number = "".join(str(int(c, 36)) for c in rest + entity[:2] + "00")
        return f"{entity[:2]}{98 - int(number) % 97:02d}{rest}"
    if kind == "aws_key":
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in entity[4:] + more)
    if kind.startswith(("given", "family")):
        _, gender, script = kind.split("_")
        syllables = SYLLABLES[script]
        stem = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + (attempt > 0) + attempt // 3))
        ends = ENDINGS[gender, script]
        return stem + ends[draw.below(len(ends))]
    return _like(entity + more, draw, kind == "hex", symbols=True)


def written_like(kind: str, mention: str, new: str) -> str:
    """A surrogate in the format of one mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = [c for c in mention if c.isalnum()]
        fill = list(new)
        keep = chars[: len(chars) - len(fill)]  # a country code that the entity leaves out
        flow = iter(keep + fill)
        return "".join(next(flow) if c.isalnum() else c for c in mention) + "".join(flow)
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[0].upper() + new[1:]
    return new.upper() if kind == "email" and mention.isupper() else new


@F.pandas_udf(T.ArrayType(fields("kind string, entity string")))
def _entities(texts: pd.Series) -> pd.Series:
    trim()
    return texts.map(lambda t: [] if not t else [{"kind": k, "entity": e} for k, e in sorted({(k, e) for _, _, k, e in mentions(t)})])


def _draw(key: bytes):
    @F.pandas_udf(T.StringType())
    def drawn(kinds: pd.Series, entities: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, e, int(a)) for k, e, a in zip(kinds, entities, attempts, strict=True)], dtype=object)

    return drawn


@F.pandas_udf(fields("text string, n_entities long, n_distinct long"))
def _replace(texts: pd.Series, tables: pd.Series) -> pd.DataFrame:
    out = []
    for text, table in zip(texts, tables, strict=True):
        found = mentions(text) if text else []
        new = {(r["kind"], r["entity"]): r["surrogate"] for r in (table if table is not None else [])}
        parts, at = [], 0
        for start, end, kind, entity in found:
            parts += [text[at:start], written_like(kind, text[start:end], new[kind, entity])]
            at = end
        out.append(("".join([*parts, text[at:]]) if found else text, len(found), len({x[2:] for x in found})))
    trim()
    return pd.DataFrame(out, columns=["text", "n_entities", "n_distinct"])


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): all surrogates differ, and none is an entity."""
    waiting = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    settled, originals = None, entities.select(F.col("entity").alias("surrogate"))
    while settled is None or not waiting.isEmpty():  # each draw settles nearly all, and surrogates grow at last
        drawn = durable(waiting.withColumn("surrogate", _draw(key)("kind", "entity", "attempt")))
        free = drawn.join(originals, "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled.select("surrogate"), "surrogate", "left_anti")
        won = durable(free.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("one")).select("one.kind", "one.entity", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        waiting = drawn.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
    return settled


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, n_entities, n_distinct, text (with surrogates), text_sha256. ``key`` has 1 to 64 bytes and is secret."""
    if not 1 <= len(key) <= 64:
        raise ValueError("a key of 1 to 64 bytes is needed")
    row = F.xxhash64("doc_id", "text").alias("_row")
    seen = durable(docs.select(row, F.explode(_entities("text")).alias("e")).select("_row", "e.kind", "e.entity"))
    table = durable(assign(durable(seen.select("kind", "entity").distinct()), key))
    needs = seen.distinct().join(table, ["kind", "entity"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("table"))
    done = docs.select("doc_id", "text", row).join(needs, "_row", "left").select("doc_id", _replace("text", "table").alias("r"))
    return done.select("doc_id", "r.n_entities", "r.n_distinct", "r.text", F.sha2(F.coalesce("r.text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
