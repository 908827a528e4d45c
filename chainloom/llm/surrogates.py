"""Personal data replaced by keyed, type-consistent surrogates.

A detected entity is written in its canonical form, so that spellings of one entity are
one (coreference), and mapped by a keyed permutation of all values of its type and format.
A permutation never gives two entities one surrogate (distinctness), whatever else the
corpus holds, so no table of surrogates is needed: every task on every executor gets the
same answer.  The permutation is a Feistel network over the mixed-radix number of the
value; it is shifted so that no value maps to itself.  Collision checks walk on along the
permutation while the value reached is one the type reserves: an invalid address, a name of
the gazetteer for a surname outside it.  Walking keeps the map one-to-one.

Letters keep their script, their case and whether they are vowels; digits stay digits,
separators stay.  Given names of the gazetteer map among names of the same gender and
script.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Given names by script and gender, family names by script.
GIVEN = {
    ("latin", "f"): "Abigail Agnieszka Alejandra Beatriz Brigitte Camille Carmen Caroline Charlotte Claudia Elizabeth Emily Fatima Franziska Gabriela Giulia Guadalupe Hildegard Isabella Jessica Katarzyna Kimberly Liudmila Lucia Manon Margaret Maria Mariana Michelle Monika Natalie Olivia Patricia Priya Rebecca Sabine Samantha Sophia Susanne Ursula Valentina Victoria Yolanda Zuzanna Adriana Agnes Aisha Alexandra Alice Alicia Alison Amanda Amelia Amy Ana Andrea Angela Anita Anja Ann Anna Anne Annette Antonia Astrid Audrey Barbara Beate Bettina Birgit Brenda Bridget Catherine Cecilia Chiara Christina Christine Chloe Clara Cristina Cynthia Daniela Deborah Denise Diana Donna Doris Dorothy Edith Elena Eleanor Elisabeth Elke Ella Ellen Elsa Emma Erika Esther Eva Evelyn Francesca Gertrud Hannah Heather Heidi Heike Helen Helena Ines Ingrid Irene Isabel Jane Janet Jennifer Joan Joanna Judith Julia Julie Karen Karin Kathleen Katherine Kelly Kerstin Laura Lauren Lena Linda Lisa Louise Lucy Magdalena Marie Marion Martha Martina Mary Megan Melanie Melissa Nadia Nancy Nicole Nina Pamela Paula Pauline Petra Rachel Renate Rita Rosa Ruth Sandra Sara Sarah Sharon Sheila Silvia Simone Sofia Sonia Stefanie Stephanie Susan Sylvia Tamara Teresa Theresa Ulrike Vanessa Vera Veronica Yvonne",
    ("latin", "m"): "Alejandro Andreas Benjamin Bogdan Carlos Charles Christopher Dieter Dmitri Edward Eduardo Ferdinand Francisco Giovanni Guillermo Gustavo Harald Hiroshi Ibrahim Jacques James Javier Jeffrey Joaquin Jonathan Joseph Jürgen Klaus Krzysztof Lorenzo Matthew Michael Miguel Mohammed Nicholas Olivier Pablo Patrick Philippe Rafael Richard Robert Sebastian Vladimir William Wolfgang Zbigniew Aaron Adam Adrian Ahmed Alan Albert Alberto Alex Alexander Alfred Ali Andrew Anthony Anton Antonio Arthur Axel Bernd Bernhard Boris Brian Bruce Bruno Christian Christoph Claude Craig Daniel David Dennis Derek Diego Dominik Donald Douglas Emil Enrique Eric Erik Ernst Eugene Felix Fernando Florian François Frederick Friedrich Gary Geoffrey George Georg Gerald Gerhard Giuseppe Gregory Günther Hans Harold Harry Heinrich Heinz Helmut Henri Henry Herbert Hermann Hugo Igor Ivan Jan Jason Jean Jens Jerome Joachim Johann Johannes John Jorge José Josef Joshua Juan Julian Julien Karl Keith Kenneth Kevin Kurt Larry Lars Laurent Leonard Louis Luca Lucas Luis Lukas Manfred Manuel Marco Marcus Mario Markus Martin Matthias Max Mehmet Nathan Nicolas Niels Nikolai Oliver Oscar Otto Paul Pedro Peter Pierre Rainer Ralph Raymond Roger Roland Ronald Rudolf Ryan Samuel Scott Sergio Simon Stefan Stephen Steven Sven Theodor Thomas Timothy Tobias Uwe Vincent Walter Werner Zachary",
    ("cyrillic", "f"): "Александра Анастасия Валентина Виктория Галина Екатерина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Татьяна",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Василий Виктор Владимир Дмитрий Евгений Иван Максим Михаил Николай Павел Сергей",
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία Χριστίνα",
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Βασίλειος Γεώργιος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος Νικόλαος Χρήστος",
}
FAMILY = {
    "latin": "Anderson Bauer Becker Bernard Brown Clarke Davies Dubois Fischer Garcia Gonzalez Hernandez Hoffmann Johnson Kowalski Lambert Lopez Martinez Meyer Miller Moreau Müller Murphy Nguyen Nowak Patel Robinson Rodriguez Rossi Sanchez Schmidt Schneider Schulz Smith Suzuki Taylor Thompson Torres Wagner Walker Weber Williams Wilson",
    "cyrillic": "Васильев Волков Иванов Козлов Кузнецов Лебедев Михайлов Морозов Новиков Павлов Петров Попов Семёнов Смирнов Соколов Фёдоров",
    "greek": "Αγγελόπουλος Βασιλείου Γεωργίου Δημητρίου Ιωάννου Νικολαΐδης Οικονόμου Παπαδόπουλος Παππάς Χατζής",
}
# Letters by script; of each row the letters map among each other.
LETTERS = """
aeiouy
bcdfghjklmnpqrstvwxz
áàâäãåæéèêëíìîïóòôöõøœúùûüýÿ
çñßšžćčłńśźżřťďğşþð
аеёиоуыэюя
бвгджзйклмнпрстфхцчшщ
αεηιουω
βγδζθκλμνξπρστφχψ
άέήίόύώ
"""
DIGITS = "0123456789"
HEX = "0123456789abcdef"
BASE = "0123456789abcdefghijklmnopqrstuvwxyz"

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")
# Values that hold a digit.  An alternative stands before those whose text it may contain.
NUMBERS = re.compile(
    r"(?P<iban>(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w]))"
    r"|(?P<key>(?<![\w])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\w])|(?<![\w-])(?:sk|pk|ghp|gho|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]{16,}(?![\w-]))"
    r"|(?P<hex>(?<![\w])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\w]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.,-])\d(?:[ -]?\d){12,18}(?![\w]|[.,-]\d))"
    r"|(?P<phone>(?<![\w.,-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
    r"|(?<![\w.,-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])"
    r"|(?<![\w.,-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))"
)
DIGIT = re.compile(r"\d")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
# Cues before a name: a title, a field of that name; and a salutation before a listed given name.
CAPITALISED = r"[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?"
TITLED = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Monsieur|Madame|Señora?|Sra)\.?[ \t]+|(?:[Ff]ull |[Ff]irst |[Ll]ast )?[Nn]ame[ \t]*:[ \t]*)({CAPITALISED}(?:[ \t]+{CAPITALISED})?)(?!\w)")
SALUTED = re.compile(rf"(?<!\w)(?:Dear|Hello|Hi|Liebe|Lieber|Hallo|Cher|Chère|Bonjour|Estimado|Estimada|Querido|Querida|Hola)[ \t]+({CAPITALISED})(?!\w)")
NAME_PART = re.compile(r"[^\W\d_]+")
SURNAME = re.compile(r"[ \t]+(?:(?:de|da|van|von|del|di)[ \t]+)?([^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?)(?![\w])")


def luhn(digits: str) -> int:
    """Sum modulo 10 of the Luhn check; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


class Permutation:
    """A keyed permutation of 0 .. size - 1 without a fixed point (for a size over 1)."""

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        shift = int.from_bytes(self.digest(b"shift"), "big")
        self.shift = 1 + shift % (size - 1) if size > 1 else 0

    def digest(self, data: bytes) -> bytes:
        out = b""
        need = self.half // 8 + 16
        while len(out) < need:
            out += hmac.new(self.key, self.label + b"\0" + len(out).to_bytes(4, "big") + data, hashlib.sha256).digest()
        return out

    def rounds(self, value: int, order: range) -> int:
        left, right = value >> self.half, value & self.mask
        forward = order.step > 0
        for i in order:
            if forward:
                f = int.from_bytes(self.digest(bytes([i]) + right.to_bytes(self.half // 8 + 1, "big")), "big") & self.mask
                left, right = right, left ^ f
            else:
                f = int.from_bytes(self.digest(bytes([i]) + left.to_bytes(self.half // 8 + 1, "big")), "big") & self.mask
                left, right = right ^ f, left
        return left << self.half | right

    def walk(self, value: int, order: range) -> int:
        value = self.rounds(value, order)
        while value >= self.size:
            value = self.rounds(value, order)
        return value

    def __call__(self, value: int) -> int:
        """There, one keyed shift on, and back: a permutation that moves every value."""
        if self.size < 2:
            return value
        there = self.walk(value, range(0, 8, 1))
        return self.walk((there + self.shift) % self.size, range(7, -1, -1))


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.class_of = {c: row for row in [*LETTERS.split(), DIGITS] for c in row}
        self.names: dict[str, list[str]] = {}
        for names in GIVEN.values():
            listed = [n for n in dict.fromkeys(names.split()) if n not in self.names]
            self.names |= dict.fromkeys(listed, listed)
        self.family: dict[str, list[str]] = {}
        for names in FAMILY.values():
            self.family |= dict.fromkeys(names.split(), names.split())
        self.reserved = {n.casefold() for n in [*self.names, *self.family]}
        self.finder = ahocorasick.Automaton()
        for name in self.names:
            self.finder.add_word(name, len(name))
        self.finder.make_automaton()
        self.permutation = functools.lru_cache(maxsize=4096)(lambda label, size: Permutation(key, label, size))

    # --- values of one format ------------------------------------------------------

    def moved(self, label: str, value: str, alphabets: list[str], free: Callable[[str], bool] | None = None) -> str:
        """The value with each character moved within its alphabet, all as one number.
        ``free`` tells which results the type allows; the value itself must be allowed."""
        size = 1
        for a in alphabets:
            size *= len(a)
        permute = self.permutation(label, size)
        number = 0
        for c, a in zip(value, alphabets):
            number = number * len(a) + a.index(c)
        while True:
            number = permute(number)
            rest, out = number, []
            for a in reversed(alphabets):
                rest, at = divmod(rest, len(a))
                out.append(a[at])
            text = "".join(reversed(out))
            if free is None or free(text):
                return text

    def lettered(self, label: str, value: str, free: Callable[[str], bool] | None = None) -> str:
        """Lower-case text moved letter by letter and digit by digit within its format."""
        alphabets = [self.class_of.get(c, c) for c in value]
        form = "".join(a[0] for a in alphabets)
        return self.moved(f"{label}:{form}", value, alphabets, free)

    @staticmethod
    def cased(like: str, value: str) -> str:
        """The canonical value in the case of the original, letter by letter."""
        return "".join(v.upper() if o.isupper() and len(v.upper()) == 1 else v for o, v in zip(like, value))

    @staticmethod
    def refilled(like: str, digits: str) -> str:
        """The original with its digits replaced in order; other characters stay."""
        fresh = iter(digits)
        return "".join(next(fresh) if c.isdecimal() else c for c in like)

    # --- types ---------------------------------------------------------------------

    def email(self, found: str) -> str:
        local, _, host = found.rpartition("@")
        name, _, top = host.rpartition(".")
        fold = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        return f"{self.cased(local, self.lettered('local', fold(local)))}@{self.cased(name, self.lettered('host', fold(name)))}.{top}"

    def ip(self, found: str) -> str:
        value = 0
        for part in found.split("."):
            value = value * 256 + int(part)
        permute = self.permutation("ip", 256**4)
        reserved = value >> 24 in (0, 127) or value >> 28 >= 14
        while True:
            value = permute(value)
            if reserved or not (value >> 24 in (0, 127) or value >> 28 >= 14):
                break
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def ipv6(self, found: str) -> str:
        """The leading three bits, which tell global addresses from others, stay."""
        value = int(ipaddress.IPv6Address(found))
        low = self.permutation("ip6", 1 << 125)(value & ((1 << 125) - 1))
        return str(ipaddress.IPv6Address(value >> 125 << 125 | low))

    def digits(self, label: str, found: str, keep: int = 0) -> str:
        """Digits but for the first ``keep`` moved as one number."""
        all_digits = "".join(c for c in found if c.isdecimal())
        fixed, value = all_digits[:keep], all_digits[keep:]
        if not value:
            return found
        return self.refilled(found, fixed + self.moved(f"{label}:{fixed}:{len(value)}", value, [DIGITS] * len(value)))

    def card(self, found: str) -> str:
        """A valid number becomes a valid one: the check digit follows from the others."""
        value = "".join(c for c in found if c.isdecimal())
        if luhn(value):
            fresh = self.moved(f"number:{len(value)}", value, [DIGITS] * len(value), lambda v: luhn(v) != 0)
        else:
            body = self.moved(f"card:{len(value)}", value[:-1], [DIGITS] * (len(value) - 1))
            fresh = body + str((10 - luhn(body + "0")) % 10)
        return self.refilled(found, fresh)

    def phone(self, found: str) -> str:
        plus = re.match(r"\+(\d{1,3})(?=[ .(-])", found)
        return self.digits("phone", found, len(plus[1]) if plus else 0)

    def hex(self, found: str) -> str:
        fresh = self.moved(f"hex:{len(found)}", found.lower(), [HEX] * len(found))
        return fresh.upper() if found.isupper() else fresh

    def key_of(self, found: str) -> str:
        head = re.match(r"[A-Z]{4}|[a-z]+[-_]", found)[0]
        alphabets = [BASE[:10] if c.isdigit() else BASE[10:] if c.islower() else BASE[10:].upper() if c.isupper() else c for c in found[len(head):]]
        return head + self.moved(f"key:{head}:{''.join(a[0] for a in alphabets)}", found[len(head):], alphabets)

    def iban(self, found: str) -> str:
        """Country, length and grouping stay; the check digits are those of the new number."""
        plain = found.replace(" ", "")
        body = plain[4:]
        alphabets = [DIGITS if c.isdigit() else BASE[10:].upper() for c in body]
        fresh = self.moved(f"iban:{plain[:2]}:{''.join(a[0] for a in alphabets)}", body, alphabets)
        number = int("".join(str(BASE.index(c.lower())) for c in fresh + plain[:2] + "00"))
        fill = iter(plain[:2] + f"{98 - number % 97:02d}" + fresh)
        return "".join(c if c == " " else next(fill) for c in found)

    def listed(self, label: str, name: str, names: list[str]) -> str:
        return names[self.permutation(f"{label}:{names[0]}", len(names))(names.index(name))]

    def surname(self, found: str) -> str:
        if found in self.family:
            return self.listed("family", found, self.family[found])
        if found in self.names:
            return self.listed("given", found, self.names[found])
        fold = "".join(c.lower() if len(c.lower()) == 1 else c for c in found)
        return self.cased(found, self.lettered("surname", fold, lambda v: v not in self.reserved))

    # --- texts ---------------------------------------------------------------------

    def people(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """Given names of the gazetteer with a capitalised family name behind."""
        ends = -1
        for end, length in self.finder.iter_long(text):
            start = end - length + 1
            if start <= ends or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            family = SURNAME.match(text, end + 1)
            if family is None or not family[1][0].isupper() or family[1][1:].upper() == family[1][1:]:
                continue
            given = text[start:end + 1]
            ends = family.end(1)
            own = family[1]
            fresh = "-".join(self.surname(p) for p in own.split("-"))
            yield start, ends, "name", self.listed("given", given, self.names[given]) + text[end + 1:family.start(1)] + fresh

    def mentions(self, text: str, people: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
        """Names behind a cue, and all places of a name that was found in the text."""
        spans = [(start, end) for start, end, _, _ in people]
        for m in TITLED.finditer(text):
            yield m.start(1), m.end(1), "name", NAME_PART.sub(lambda w: self.surname(w[0]), m[1])
            spans.append(m.span(1))
        for m in SALUTED.finditer(text):
            if m[1] in self.names:
                yield m.start(1), m.end(1), "name", self.surname(m[1])
                spans.append(m.span(1))
        known = {w for start, end in spans for w in NAME_PART.findall(text[start:end]) if len(w) > 1 and w[0].isupper()}
        if known:
            for m in NAME_PART.finditer(text):
                before, after = text[m.start() - 1:m.start()], text[m.end():m.end() + 1]
                if m[0] in known and not (before.isalnum() or before in ("_", "@") and before) and not (after.isalnum() or after in ("_", "@") and after):
                    yield m.start(), m.end(), "name", self.surname(m[0])

    def entities(self, text: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and surrogate of each entity, in order and without overlap."""
        found = []
        if "@" in text:
            found += [(m.start(), m.end(), "email", self.email(m[0])) for m in EMAIL.finditer(text)]
        if DIGIT.search(text):
            for m in NUMBERS.finditer(text):
                kind, value = m.lastgroup, m[0]
                plain = [c for c in value if c.isdecimal()]
                if not all(c in DIGITS for c in plain):
                    continue
                if kind == "card":
                    if len(plain) != 16 and luhn("".join(plain)):
                        continue
                    fresh = self.card(value)
                elif kind == "ssn":
                    fresh = self.digits("ssn", value)
                else:
                    fresh = {"iban": self.iban, "key": self.key_of, "hex": self.hex, "ip": self.ip, "phone": self.phone}[kind](value)
                found.append((m.start(), m.end(), kind, fresh))
        if ":" in text:
            for m in IPV6.finditer(text):
                try:
                    found.append((m.start(), m.end(), "ip", self.ipv6(m[0])))
                except ValueError:
                    continue
        people = list(self.people(text))
        found += people
        found += self.mentions(text, people)
        kept, end = [], 0
        for entity in sorted(found, key=lambda e: (e[0], -e[1])):
            if entity[0] >= end:
                kept.append(entity)
                end = entity[1]
        return kept

    def replace(self, text: str) -> tuple[str, list[str]]:
        parts, at, kinds = [], 0, []
        for start, end, kind, fresh in self.entities(text):
            parts += [text[at:start], fresh]
            at = end
            kinds.append(kind)
        return ("".join(parts) + text[at:] if kinds else text), kinds


def with_surrogates(df: DataFrame, key: bytes, text: str = "text", kinds: str = "entity_kinds") -> DataFrame:
    """The rows with personal data in their whole text replaced, and the kinds replaced.

    A null text stays null and an empty one empty, both with no kinds.  Equal texts have
    equal results, an empty table stays empty; other columns stay, and a column named
    ``kinds`` is replaced.  The key is a secret of the caller: who holds it can undo the
    replacement, and another key gives other surrogates.
    """

    @F.arrow_udf("struct<text:string,kinds:array<string>>")
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        surrogates = Surrogates(key)
        for batch in batches:
            done = [(None, []) if t is None else surrogates.replace(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], ["text", "kinds"]
            )

    done = df.withColumn("_replaced", replaced(F.col(text)))
    return done.withColumn(text, F.col("_replaced.text")).withColumn(kinds, F.col("_replaced.kinds")).drop("_replaced")
