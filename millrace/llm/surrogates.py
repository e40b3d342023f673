"""Personal data replaced by keyed surrogates.

Entities are found by pattern and checked (card numbers by their check digit, IPv4 by its
ranges).  A surrogate depends on the secret key, the entity's type and the entity alone,
so the same entity gets the same surrogate everywhere in the corpus (coreference).

Surrogates come from keyed permutations, not from draws: each run of same-class symbols
(digits, lower-case or upper-case letters of one script) is read as a number and sent
through a Feistel network with cycle walking over exactly the numbers of that length.  So
format, script and length stay, and two entities never meet in one surrogate: the map is
one-to-one on each format, and formats differ where the unchanged symbols do.  Structure
that carries meaning is kept: separators, country codes, the check digits of a card and of
an international account are made right again, IPv4 groups stay in range.  Given names after a title map within a list of
names of the same gender and script by a keyed permutation of that list; a name that no
list has is permuted letter by letter.

Collision checks: each permutation is one cycle (a rotation between a Feistel network and
its inverse), so no entity is its own surrogate; ``collisions`` counts over a corpus the
surrogates that stand for several entities, which must be none.

Types: email, phone, card, account (digits like a card's without its check digit), ip, ip6
(all eight groups), iban, name (each word of a run of capitalised words after a
title, and other mentions of these words in the text) and secret (values of password, token, key assignments;
hexadecimal stays hexadecimal).

Defined edge cases: null text stays null and has no entities; texts without entities
come back unchanged; very long texts are worked on whole; repeated rows get equal results; null document ids are kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A sample, for the registered query only: whoever knows a key can undo its surrogates, so a production run passes a secret one.
SAMPLE_KEY = b"millrace-surrogates"

_NAMES = {
    "m": "Adam Albert Anton Carlos Daniel David Diego Emil Felix Georg Henri Hugo Jan Javier Johann Jules Karl Louis Lucas Luis Marc Martin Max Miguel Oscar Otto Pablo Paul Pedro Peter Pierre Samuel Simon Thomas Victor Walter".split(),
    "f": "Alice Ana Anna Carla Carmen Clara Claire Elena Elisa Emma Eva Greta Hanna Helena Ida Ines Irma Jana Julia Karin Lara Laura Lea Lena Lucia Luise Maria Marie Marta Nina Nora Paula Rosa Sara Sofia Vera".split(),
}
_TITLES = {
    **dict.fromkeys("Mr Mister Sir Herr Herrn Monsieur Señor Sr Don Господин Κύριος Κύριε".split(), "m"),
    **dict.fromkeys("Mrs Ms Miss Madam Frau Fräulein Madame Mme Mademoiselle Mlle Señora Señorita Sra Srta Doña Госпожа Κυρία".split(), "f"),
    **dict.fromkeys("Dr Prof Professor Professeur Profesor Doctor Docteur Доктор Профессор".split(), "n"),
    "M.": "m",
}
#: Words in lower case that a name goes on after.
_PARTICLES = frozenset("von van vom zu zur de der den del della di da do dos du la le el al bin ben ten ter y e und".split())

_PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{8,}))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip6>(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}(?![\w:]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)(?:[ .-]?\d{2,4}){2,4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{3,4}[ -]\d{3,5}|0\d{1,4}[ /-]\d{5,8}|[679]\d{2} \d{3} \d{3})(?!\w|[.-]\d))"
    r"|(?P<name>\b(?:" + "|".join(re.escape(t) for t in sorted(_TITLES, key=len, reverse=True)) + r")\.?[ \u00a0]+(?=[^\W\d_]))"
)


_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[ \u00a0]+|[-'’]")
_INITIAL = re.compile(r"\. ?")


#: Every entity's text holds one of these.
_HINTS = [*"0123456789@=:", *_TITLES]


class Permuter:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, x: int, bound: int) -> int:
        data = tweak + b"|%d|%d|%d" % (r, x, bound)
        return int.from_bytes(hmac.digest(self.key, data, "sha256")[:16], "big")

    def number(self, x: int, bound: int, tweak: bytes) -> int:
        """A permutation of 0 .. bound-1 in one cycle, so that it moves every number if there are two."""
        if bound < 2:
            return x
        return self._walk((self._walk(x, bound, tweak, True) + 1) % bound, bound, tweak, False)

    def _walk(self, x: int, bound: int, tweak: bytes, forward: bool) -> int:
        """A Feistel network on the next even number of bits, walked until the number is in range; or its inverse."""
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in range(8) if forward else range(7, -1, -1):
                if forward:
                    left, right = right, left ^ (self._round(tweak, r, right, bound) & mask)
                else:
                    left, right = right ^ (self._round(tweak, r, left, bound) & mask), left
            x = left << half | right
            if x < bound:
                return x


_CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_CLASS_OF = {ch: (str(i), chars) for i, chars in enumerate(_CLASSES) for ch in chars}


@functools.lru_cache(100_000)
def _class_of(ch: str) -> tuple[str, str] | None:
    """Label and symbols of a symbol's class; other letters' classes are those of their script and case near them."""
    if ch in _CLASS_OF or not ch.isalpha():
        return _CLASS_OF.get(ch)
    kind = lambda c: (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    first = ord(ch) >> 7 << 7
    chars = "".join(c for c in map(chr, range(first, first + 128)) if c not in _CLASS_OF and kind(c) == kind(ch))
    return f"<{ord(chars[0])}>", chars
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


class Surrogates:
    """Entities of a text and their surrogates under a key."""

    def __init__(self, key: bytes):
        self._permute = Permuter(key)
        self.surrogate = functools.lru_cache(100_000)(self._surrogate)

    def _format(self, text: str, tweak: bytes, keep: int = 0) -> str:
        """Every symbol but the first ``keep`` permuted within its class; the whole string is one number per format."""
        classes = [_class_of(c) if i >= keep else None for i, c in enumerate(text)]
        value, bound = 0, 1
        for c, k in zip(text, classes):
            if k is not None:
                value = value * len(k[1]) + k[1].index(c)
                bound *= len(k[1])
        shape = "".join(c if k is None else k[0] for c, k in zip(text, classes))
        value = self._permute.number(value, bound, tweak + b"|" + shape.encode())
        out: list[str] = []
        for c, k in zip(reversed(text), reversed(classes)):
            if k is None:
                out.append(c)
            else:
                value, at = divmod(value, len(k[1]))
                out.append(k[1][at])
        return "".join(reversed(out))

    def _surrogate(self, kind: str, entity: str) -> str:
        tweak = kind.encode()
        if kind == "email":
            name, _, domain = entity.partition("@")
            labels = domain.split(".")
            cut = 2 if len(labels) > 2 or len(labels) == 2 else 1  # the last two labels tell the kind of address
            head, tail = ".".join([name, *labels[:-cut]]) if len(labels) > cut else name, ".".join(labels[-cut:])
            changed = self._format(head, tweak + b"|" + tail.encode() + b"|" + str(len(name)).encode())
            return changed[: len(name)] + "@" + (changed[len(name) + 1 :] + "." if len(labels) > cut else "") + tail
        if kind == "card":
            digits = [c for c in entity if c.isdigit()]
            body = self._format("".join(digits[:-1]), tweak + str(len(digits)).encode(), keep=1)
            check = next(d for d in "0123456789" if luhn(body + d))
            left = iter(body + check)
            return "".join(next(left) if c.isdigit() else c for c in entity)
        if kind == "ip":
            groups = [int(x) for x in entity.split(".")]
            value = functools.reduce(lambda a, g: a * 256 + g, groups, 0)
            value = self._permute.number(value, 1 << 32, tweak)
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        if kind == "phone":
            lead = re.match(r"\+\d{1,3}", entity)
            return self._format(entity, tweak, keep=lead.end() if lead else 0)
        if kind == "iban":
            if mod_97(entity) != 1:  # no valid one: its surrogate is none either
                while mod_97(entity := self._format(entity, tweak, keep=2)) == 1:
                    pass
                return entity
            changed = self._format(entity, tweak + b"|valid", keep=4)
            return f"{changed[:2]}{98 - mod_97(changed[:2] + '00' + changed[4:]):02d}{changed[4:]}"
        if kind == "ip6":
            digits = entity.replace(":", "")
            value = self._permute.number(int(digits, 16), 16 ** len(digits), tweak + re.sub("[^:]", "x", entity).encode() + str(digits.isupper()).encode())
            left = iter(format(value, f"0{len(digits)}{'X' if digits.isupper() else 'x'}"))
            return "".join(c if c == ":" else next(left) for c in entity)
        if kind == "secret" and _HEX.fullmatch(entity):
            upper = any(c in "ABCDEF" for c in entity)
            value = self._permute.number(int(entity, 16), 16 ** len(entity), tweak + str(len(entity)).encode())
            return format(value, f"0{len(entity)}{'X' if upper else 'x'}")
        if kind in ("name-m", "name-f"):
            names = _NAMES[kind[-1]]
            if entity in names:
                return names[self._permute.number(names.index(entity), len(names), tweak)]
            while (entity := self._format(entity, tweak)) in names:  # never a listed name: those are the listed ones' surrogates
                pass
            return entity
        return self._format(entity, tweak)

    def entities(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, type) of each entity, in order: also later and earlier mentions of a titled name."""
        found = list(self._found(text))
        kinds: dict[str, str] = {}
        for start, end, kind in found:
            if kind.startswith("name-"):
                name = text[start:end]
                if kinds.get(name, "name-n") == "name-n":  # a title with a gender tells more than one without
                    kinds[name] = kind
        for name, kind in kinds.items():
            if kind == "name-n":
                kinds[name] = next((f"name-{g}" for g, names in _NAMES.items() if name in names), kind)
        if not kinds:
            yield from found
            return
        at = 0
        for start, end, kind in [*found, (len(text), len(text), "")]:
            for word in _WORD.finditer(text, at, start):
                name = word.group()
                apart = not text[word.end() : word.end() + 1].isdigit() and text[word.start() - 1 : word.start()] not in ("_", "@")
                if len(name) > 1 and name in kinds and apart:
                    yield word.start(), word.end(), kinds[name]
            if kind:
                yield start, end, kinds[text[start:end]] if kind.startswith("name-") else kind
            at = end

    def _name(self, text: str, at: int, gender: str) -> Iterator[tuple[int, int, str]]:
        """The words of the name that begins at ``at``: a whole run of capitalised words of any script."""
        words: list[tuple[int, int]] = []
        while word := _WORD.match(text, at):
            name, end = word.group(), word.end()
            caseless = unicodedata.category(name[0]) == "Lo"
            if name in _TITLES:
                gender = _TITLES[name] if gender == "n" else gender
                end += text[end : end + 1] == "."
            elif name[0].isupper() or name[0].istitle() or (caseless and not words):
                if text[end : end + 1] in ("@", "_") or re.match(r"\.\w+[@.]|\d", text[end : end + 80]):
                    break  # an address
                words.append(word.span())
            elif name not in _PARTICLES:
                break
            gap = _GAP.match(text, end) or (len(name) == 1 and _INITIAL.match(text, end)) or None
            if not gap or caseless:
                break
            at = gap.end()
        for start, end in words:
            yield start, end, f"name-{gender}"

    def _found(self, text: str) -> Iterator[tuple[int, int, str]]:
        at = 0
        while found := _PATTERN.search(text, at):
            at = found.end()
            kind = found.lastgroup if found.lastgroup != "value" else None
            kind = kind or "secret"
            if kind == "secret":
                yield found.start("value"), found.end("value"), "secret"
            elif kind == "name":
                title = found["name"].rstrip(" \u00a0")
                title = title if title in _TITLES else title.rstrip(".")
                for start, end, name in self._name(text, found.end(), _TITLES[title]):
                    yield start, end, name
                    at = end
            elif kind == "ip":
                if all(int(x) < 256 and str(int(x)) == x for x in found["ip"].split(".")):
                    yield found.start(), found.end(), "ip"
            elif kind == "card":
                digits = "".join(c for c in found["card"] if c.isdigit())
                yield found.start(), found.end(), "card" if luhn(digits) else "account"
            else:
                yield found.start(), found.end(), kind

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str, str]]]:
        """The text with surrogates, and (start, end, type, entity, surrogate) of each entity of the old text."""
        if text is None:
            return None, []
        if not any(map(text.__contains__, _HINTS)):
            return text, []
        out, at, listed = [], 0, []
        for start, end, kind in self.entities(text):
            new = self.surrogate(kind, text[start:end])
            out += [text[at:start], new]
            listed.append((start, end, kind, text[start:end], new))
            at = end
        return "".join([*out, text[at:]]), listed


def mod_97(iban: str) -> int:
    """The remainder of an account number in its international form; 1 if its check digits are right."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_ENTITY = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])


def replace_entities(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities, entities (start, end, type, entity, surrogate)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        names = ("start", "end", "type", "entity", "surrogate")
        for batch in batches:
            got = [maker.replace(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in got], pa.string()),
                    pa.array([len(e) for _, e in got], pa.int64()),
                    pa.array([[dict(zip(names, x)) for x in e] for _, e in got], pa.list_(_ENTITY)),
                ],
                names=["doc_id", "text", "n_entities", "entities"],
            )

    schema = "doc_id long, text string, n_entities long, entities array<struct<start:bigint,end:bigint,type:string,entity:string,surrogate:string>>"
    return rows.mapInArrow(run, schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates of one type that stand for several entities: type, surrogate, n; none are expected."""
    found = replaced.select(F.explode("entities").alias("e")).select("e.type", "e.surrogate", "e.entity").distinct()
    return found.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with surrogates for personal data; the entities as types and places (characters of the old text)."""
    done = replace_entities(common.table(spark, sf_dir, "documents"), key=SAMPLE_KEY)
    place = lambda e: F.concat_ws(":", e["type"], e["start"], e["end"], e["surrogate"])
    return done.select("doc_id", "text", "n_entities", F.array_join(F.transform("entities", place), "\n").alias("entities"))
