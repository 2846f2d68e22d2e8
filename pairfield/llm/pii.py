"""Surrogates for personal data.

Entities are found by patterns per type and replaced by keyed surrogates of the
same kind: digits for digits in the same layout, a mail address for a mail
address, letters of the same script and case, first names of the gender that the
title tells. The same entity gets the same surrogate everywhere (an entity is
its normal form: digits without layout, lower case, and a + before a phone's
country code; secrets are told by their case). A surrogate is drawn from the
normal form and laid out as the entity was found, so all spellings share it. A
name has one gender: the one that its titles (or, without any, its known first
names) tell, none if they differ. People are found by a title, by what stands around
two or three capitalised words (CUES: "my name is", "Dear", "written by", a mail address
in brackets after them), or by a first name of FIRST or KNOWN before a surname; names
that end as streets and places do are none. Their surnames are found wherever else the
text has them, and get the surname of the full name's surrogate.

Types keep what makes them valid: cards the Luhn digit, IBANs their country and check
digits, addresses of private networks the network, public ones stay public; American
numbers are one entity with or without +1, and keep an area code from 2 on; letters stay
in their script. Different entities of a type get different ones:

- numbers pass a keyed permutation of all numbers of their length, so two never
  meet;
- other surrogates come from a keyed hash. All entities of the corpus and their
  surrogates are compared: where two entities got one surrogate, or a surrogate
  is another entity's own text, all but the first entity are drawn anew, until
  none collide; late draws are longer, and if the last round leaves some, an
  error tells it. The entities drawn anew, and names of several genders, reach their documents by a join.

Null texts stay null with no entities; texts without entities stay as they are.
Repeated rows are treated alike. An empty table gives an empty result; other
columns pass through, those with the name of a result are replaced.
"""

from __future__ import annotations

import hmac
import ipaddress
from bisect import bisect
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced, without

ROUNDS = 20
#: Draws from this one on are longer, by one more place each.
WIDER = 10
#: Country codes of one and two digits; the others have three.
CODES = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Titles and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mx": "n", "Dr": "n", "Prof": "n", "Sir": "m", "Madam": "f",
    "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Господин": "m", "Госпожа": "f",
}
#: First names by script and gender.
FIRST = {
    ("Latin", "m"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Robin Simon Tomas Victor".split(),
    ("Latin", "f"): "Alma Berta Clara Diana Emma Flora Greta Helen Ines Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("Latin", "n"): "Alex Andrea Ariel Bo Charlie Dana Eden Frances Gabriel Jamie Kim Lee Morgan Noa Quinn Robin Sacha Toni Val Yuri".split(),
    ("Cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("Cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Марина".split(),
    ("Greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("Greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
#: Syllables of made-up surnames by script.
SYLLABLES = {
    "Latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo".split(),
    "Cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "Greek": "βα βε δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε τα τε το".split(),
}

#: More first names by which people without a title are found.
KNOWN = {
    "m": "James John Robert Michael William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Kevin Brian George Peter Hans Stefan Klaus Pierre Jean Luc José Juan Luis Pedro Miguel".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Anna Anne Emily Eva Ursula Sabine Monika Marie Sophie Claire Camille Ana Carmen Isabel Lucía Elena Sofía".split(),
}
#: Genders of the first names; those of several pools tell none.
GENDERS = {name: gender if sum(name in pool for pool in FIRST.values()) == 1 else "n" for (_, gender), pool in FIRST.items() for name in pool}
GENDERS |= {name: gender for gender, names in KNOWN.items() for name in names}
#: What stands before a name, and the words that end streets and places named after people.
CUES = "(?i:my name is|name is|name:|dear|regards,|sincerely,|signed by|written by|author:|contact:?|attn:?|mich heiße|ich heiße|mein name ist|je m'appelle|me llamo|mi nombre es)"
PLACES = "Street Avenue Road Boulevard Lane Square Drive Park Bridge Station Airport University Museum Prize Straße Strasse Platz Allee Weg Gasse Brücke".lower().split()
_NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = (
    ("email", r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("email", r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}{2,}"),
    ("secret", r"(?i:\b(?:access[_-]?|auth[_-]?|api[_-]?)?(?:token|secret|password|passwd|key))['\"]?\s*[:=]\s*['\"]?(?P<secret>[A-Za-z0-9_./+=-]{8,})"),
    ("secret", r"(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![\p{L}\p{N}])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])"),
    ("ipv6", r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\p{L}\p{N}:])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("card", r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -][0-9]{4}){3}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[0-9]{13,19}(?![\p{L}\p{N}])"),
    ("phone", r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])"),
    ("phone", r"(?<![\p{L}\p{N}+.,-])(?<![0-9] )(?:[2-9][0-9]{2} [0-9]{3} [0-9]{4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![\p{L}\p{N}]| [0-9])"),
    ("person", rf"\b(?P<title>{'|'.join(TITLES)})\.? (?P<person>{_NAME}(?: {_NAME}){{0,2}})"),
    ("person", rf"\b(?:{CUES}) (?P<person>{_NAME}(?: {_NAME}){{1,2}})"),
    ("person", rf"(?<![\p{{L}}\p{{N}}])(?P<person>{_NAME}(?: {_NAME}){{1,2}})(?= ?[<(\[][^\s@<>()]{{1,64}}@)"),
    ("person", rf"(?<![\p{{L}}\p{{N}}])(?P<person>(?P<first>{'|'.join(GENDERS)})(?: {_NAME}){{1,2}})"),
)
#: What a text must hold to be searched at all.
HINT = "[0-9@]|::|" + CUES + " \\p{Lu}|(?:" + "|".join(TITLES) + ")[.]? |(?:" + "|".join(GENDERS) + ") \\p{Lu}|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww]|[Kk][Ee][Yy]['\"]?\\s*[:=]"


_WORD = regex.compile(rf"(?<![\p{{L}}\p{{N}}]){_NAME}")


@lru_cache(maxsize=1)
def _patterns():
    return [(kind, regex.compile(p)) for kind, p in PATTERNS]


def number(key: bytes, kind: str, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join([kind, *map(str, parts)]).encode(), "sha256")[:16], "big")


def permuted(key: bytes, kind: str, digits: str, attempt: int) -> str:
    """digits under a keyed permutation of all digit strings of their length (a Feistel network)."""
    a = len(digits) // 2
    b = len(digits) - a
    if not a:
        return str((int(digits) + 1 + number(key, kind, attempt) % 9) % 10)
    x, y = int(digits[:a]), int(digits[a:])
    for i in range(8):
        if i % 2:
            y = (y + number(key, kind, attempt, i, a, x)) % 10**b
        else:
            x = (x + number(key, kind, attempt, i, b, y)) % 10**a
    return f"{x:0{a}d}{y:0{b}d}"


def luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(text: str) -> int:
    """The remainder of letters and digits read as a number, A as 10."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: Networks that are not public, and their bits.
NETWORKS = (((10, 0), 8), ((127, 0), 8), ((172, 16), 12), ((192, 168), 16), ((169, 254), 16))


def network(n: int) -> tuple[int, int] | None:
    """The private network of an address, as its first address and the bits after it."""
    for (a, b), bits in NETWORKS:
        first = a << 24 | b << 16
        if n >> 32 - bits == first >> 32 - bits:
            return first, 32 - bits
    return None


def moved_address(key: bytes, found: str, attempt: int) -> str:
    """An address under a keyed permutation of its private network, or of the public ones."""
    n = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in found.split("."))))
    first, bits = network(n) or (0, 32)
    half = bits // 2
    n -= first
    while True:
        x, y = n >> half, n & (1 << half) - 1
        for i in range(8):
            if i % 2:
                y = (y + number(key, "ip", attempt, i, bits, x)) % (1 << half)
            else:
                x = (x + number(key, "ip", attempt, i, bits, y)) % (1 << bits - half)
        n = x << half | y
        if bits < 32 or network(n) is None:  # going on along the permutation keeps addresses apart
            return str(ipaddress.IPv4Address(first + n))


def wider(attempt: int) -> int:
    return max(0, attempt - WIDER + 1)


def laid_out(found: str, fresh: str) -> str:
    """found with its digits replaced, one by one; those left over follow."""
    at = iter(fresh)
    return "".join(next(at) if c.isdigit() else c for c in found) + "".join(at)


def normal(kind: str, found: str) -> str:
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in found if c.isdigit())
        if kind == "phone" and not found.startswith("+") and len(digits) == 10 and digits[0] in "23456789":
            return "+1" + digits
        return ("+" if kind == "phone" and found.startswith("+") else "") + digits
    if kind == "ipv6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "ip":
        return ".".join(str(int(part)) for part in found.split("."))
    return "".join(found.split()).lower() if kind in ("email", "iban") else found.lower() if kind == "person" else found


def script(word: str) -> str:
    first = ord(word[0])
    return "Cyrillic" if 0x400 <= first < 0x530 else "Greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "Latin"


#: The first letter and the number of letters in a row of each script.
_ALPHABETS = {"Latin": ("a", 26), "Cyrillic": ("а", 32), "Greek": ("α", 17)}


def letters(key: bytes, kind: str, text: str, attempt: int) -> str:
    """Letters for letters of the same case, digits for digits; marks stay."""
    draw, out = number(key, kind, attempt, text.lower()), []
    for i, c in enumerate(text):
        if i % 24 == 23:
            draw = number(key, kind, attempt, i, text.lower())
        if c.isdigit():
            draw, r = divmod(draw, 10)
            out.append(str(r))
        elif c.isalpha():
            kind_, n = _ALPHABETS[script(c)]
            draw, r = divmod(draw, n)
            out.append(chr(ord(kind_) + r).upper() if c.isupper() else chr(ord(kind_) + r))
        else:
            out.append(c)
    return "".join(out)


def hexed(key: bytes, kind: str, text: str, attempt: int) -> str:
    out = ""
    while len(out) < len(text):
        out += f"{number(key, kind, attempt, len(out), text.lower()):032x}"
    return out[: len(text)].upper() if text.isupper() else out[: len(text)]


def surrogate(key: bytes, kind: str, found: str, attempt: int = 0) -> str:
    """The surrogate of an entity as found, of attempt 0 unless it was drawn anew."""
    if kind == "card":
        digits = normal(kind, found) + "0" * wider(attempt)
        body = permuted(key, kind, digits[:-1], attempt) if not luhn(digits) else None
        # a valid number stays valid; the others pass the permutation whole
        fresh = permuted(key, kind, digits, attempt) if body is None else next(body + str(d) for d in range(10) if not luhn(body + str(d)))
        return laid_out(found, fresh)
    if kind in ("phone", "ssn"):
        norm = normal(kind, found)
        marked = regex.match(CODES, norm)
        digits, code = norm.lstrip("+") + "0" * wider(attempt), len(marked[0]) - 1 if marked else int(kind == "phone" and norm.startswith("0"))
        made, american = permuted(key, f"{kind}{digits[:code]}", digits[code:], attempt), norm.startswith("+1") and digits[1] > "1"
        while american and made[0] < "2":  # an area code; going on along the permutation keeps numbers apart
            made = permuted(key, f"{kind}{digits[:code]}", made, attempt)
        return laid_out(found, ("" if norm.startswith("+") and not found.startswith("+") else digits[:code]) + made)
    if kind == "ip":
        return moved_address(key, found, attempt)
    if kind == "ipv6":
        draw, at = hexed(key, kind, normal(kind, found), attempt), 0
        parts = found.split(":")
        for i, part in enumerate(parts):
            if part and int(part, 16):
                parts[i] = f"{int(draw[at : at + 4], 16) % 0xEFFF + 0x1000:x}"
                at += 4
        return ":".join(parts)
    if kind == "email":
        name, _, host = found.lower().rpartition("@")
        labels = host.split(".")
        return letters(key, kind, name + "a" * wider(attempt), attempt) + "@" + ".".join([*(letters(key, "host", x, attempt) for x in labels[:-1]), labels[-1]])
    if kind == "secret":
        return hexed(key, kind, found, attempt) if all(c in "0123456789abcdefABCDEF" for c in found) else letters(key, kind, found, attempt)
    if kind == "iban":
        said = "".join(found.split()).upper()
        made = letters(key, kind, said[4:], attempt)
        check = f"{98 - mod97(made + said[:2] + '00'):02d}" if mod97(said[4:] + said[:4]) == 1 else letters(key, "iban check", said[2:4] + said[4:], attempt)[:2]
        at = iter(check + made)
        return found[:2] + "".join(c if c.isspace() else next(at) for c in found[2:])
    return found


def person(key: bytes, names: str, gender: str, attempt: int = 0) -> str:
    """First names by gender and script, the last one a surname of its script; each name maps alone, so parts of a full name keep to it."""
    parts, out = names.split(" "), []
    for i, name in enumerate(parts):
        kind = script(name)
        if i < len(parts) - 1:
            pool = FIRST.get((kind, gender)) or FIRST[(kind, "f" if number(key, "gender", name.lower()) % 2 else "m")]
            made = pool[number(key, "first", attempt, name.lower(), gender) % len(pool)]
        else:
            draw, syllables = number(key, "last", attempt, name.lower()), SYLLABLES[kind]
            made = ""
            for _ in range((6 if attempt else 5) + wider(attempt)):
                draw, r = divmod(draw, len(syllables))
                made += syllables[r]
            made = made.capitalize()
        out.append(made.upper() if name.isupper() else made)
    return " ".join(out)


def _is_ipv6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text).exploded.count("0000") < 6
    except ValueError:
        return False


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, gender, whole) of the entities of a text, in order, without overlaps; earlier patterns win.

    whole is the entity's text; for a surname that stands alone, where the text
    also has a full name with it, that name: the nearest before it, or the first.
    """
    taken: list[tuple[int, int, str, str, str]] = []

    def take(a: int, b: int, kind: str, gender: str, whole: str) -> None:
        at = bisect(taken, (a,))
        if (at == len(taken) or b <= taken[at][0]) and (not at or taken[at - 1][1] <= a):
            taken.insert(at, (a, b, kind, gender, whole))

    for kind, pattern in _patterns():
        for m in pattern.finditer(text):
            group = kind if kind in pattern.groupindex else 0
            said = m.groupdict()
            if kind == "person" and m[group].split(" ")[-1].lower() in PLACES or kind == "ipv6" and not _is_ipv6(m[0]):
                continue
            take(*m.span(group), kind, TITLES[said["title"]] if said.get("title") else GENDERS.get(said.get("first"), ""), m[group])
    full: dict[str, list[tuple[int, str, str]]] = {}
    for a, _, kind, gender, whole in taken:
        if kind == "person" and " " in whole:
            full.setdefault(whole.split(" ")[-1].lower(), []).append((a, whole, gender))
    if not full:
        return taken

    def named(at: int, last: str) -> tuple[str, str]:
        said = full[last.lower()]
        return said[max(bisect(said, (at,)) - 1, 0)][1:]

    for i, (a, b, kind, gender, whole) in enumerate(taken):
        if kind == "person" and " " not in whole and whole.lower() in full:
            name, other = named(a, whole)
            taken[i] = a, b, kind, gender if gender != "n" else other, name
    for m in _WORD.finditer(text):
        if m[0].lower() in full:
            name, gender = named(m.start(), m[0])
            take(*m.span(), "person", gender, name)
    return taken


def replaced(key: bytes, text: str, found: list[tuple[int, int, str, str, str]], again: dict[str, dict]) -> str:
    """text with surrogates; again: attempt and gender of the entities that have others than found here."""
    out, at = [], 0
    for a, b, kind, gender, whole in found:
        said, attempt = text[a:b], 0
        if other := again.get(f"{kind}|{normal(kind, whole)}"):
            attempt, gender = other["attempt"], other["gender"]
        if kind != "person":
            made = surrogate(key, kind, said, attempt)
        elif said == whole:
            made = person(key, said, gender, attempt)
        else:  # a surname alone
            made = person(key, whole, gender, attempt).split(" ")[-1]
            made = made.upper() if said.isupper() else made.capitalize()
        out += [text[at:a], made]
        at = b
    return "".join(out) + text[at:]


def _searched(batch: pa.RecordBatch, column: str):
    """(row, text, entities) of the rows whose text has entities."""
    texts = batch.column(batch.schema.get_field_index(column))
    hint = pc.fill_null(pc.match_substring_regex(texts, HINT), False)
    for i in pc.indices_nonzero(hint).to_pylist():
        text = texts[i].as_py()
        if found := entities(text):
            yield i, text, found


def corpus_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """__row, kind, norm and found of each entity of each row; __row: the text's hash."""

    def run(batches):
        for batch in sliced(batches, text):
            rows, out = batch.column(0), {"__row": [], "kind": [], "norm": [], "found": [], "gender": []}
            for i, said, found in _searched(batch, text):
                for _, _, kind, gender, whole in found:
                    for name, value in zip(out, (rows[i].as_py(), kind, normal(kind, whole), whole, gender)):
                        out[name].append(value)
            if out["kind"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("__row", pa.int64()), *((c, pa.string()) for c in ("kind", "norm", "found", "gender"))]))

    return docs.select("__row", text).mapInArrow(run, "__row long, kind string, norm string, found string, gender string")


def collisions(every: DataFrame, key: bytes) -> DataFrame | None:
    """kind, norm, attempt and gender of the entities that must be drawn anew or have several genders; None if there are none."""

    def draw(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                made = person(key, r["found"], r["gender"], r["attempt"]) if r["kind"] == "person" else surrogate(key, r["kind"], r["found"], r["attempt"])
                r["made"] = normal(r["kind"], made)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("norm", pa.string()), ("found", pa.string()), ("gender", pa.string()), ("attempt", pa.int32()), ("made", pa.string())]))

    told = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    settled = F.when(F.max("gender") == "", "").when(F.size(told) == 1, F.get(told, F.lit(0))).otherwise("n")
    state = every.groupBy("kind", "norm").agg(F.min("found").alias("found"), settled.alias("gender"), (F.min("gender") < F.max("gender")).alias("several"))
    state = saved(state, "entities-told")
    fields = "kind string, norm string, found string, gender string, attempt int, made string"
    several = state.where("several").select("kind", "norm")
    drawn = saved(state.drop("several").withColumn("attempt", F.lit(0)).mapInArrow(draw, fields), "surrogates")
    own = drawn.select("kind", F.col("norm").alias("made")).withColumn("real", F.lit(True))
    for at in range(ROUNDS + 1):
        # the first entity that drew a surrogate keeps it, unless the corpus has that text
        holders = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("holder"))
        judged = drawn.join(holders, ["kind", "made"]).join(own, ["kind", "made"], "left")
        bad = F.coalesce("real", F.lit(False)) | (F.col("holder.norm") != F.col("norm"))
        judged = judged.withColumn("bad", bad)
        if judged.where("bad").isEmpty():
            break
        if at == ROUNDS:
            raise RuntimeError(f"{judged.where('bad').count()} entities still share a surrogate after {ROUNDS} rounds")
        fresh = judged.select("kind", "norm", "found", "gender", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
        drawn = saved(fresh.mapInArrow(draw, fields), "surrogates")
    again = drawn.join(several.withColumn("several", F.lit(True)), ["kind", "norm"], "left").where("attempt > 0 OR several").select("kind", "norm", "attempt", "gender")
    return None if again.isEmpty() else again


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text replaced, n_entities and kinds (how many of each kind); who has the key can tell entities from surrogates."""
    docs = without(docs, "n_entities", "kinds", "__row", "__again")
    own = docs.columns
    rows = docs.withColumn("__row", F.xxhash64(text))
    every = saved(corpus_entities(rows, text), "entities")
    again = collisions(every, key)
    if again is None:
        rows = rows.drop("__row").withColumn("__again", F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    else:
        named = every.drop("gender").join(again, ["kind", "norm"]).select("__row", F.concat_ws("|", "kind", "norm").alias("k"), F.struct("attempt", "gender").alias("v")).distinct()
        named = named.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__again"))
        rows = rows.join(named, "__row", "left").drop("__row")

    def run(batches):
        for batch in sliced(batches, text):
            at, again_at = batch.schema.get_field_index(text), batch.schema.get_field_index("__again")
            fresh, n, kinds = {}, [0] * batch.num_rows, [[]] * batch.num_rows
            for i, said, found in _searched(batch, text):
                fresh[i] = replaced(key, said, found, dict(batch.column(again_at)[i].as_py() or ()))
                n[i] = len(found)
                counts: dict[str, int] = {}
                for _, _, kind, _, _ in found:
                    counts[kind] = counts.get(kind, 0) + 1
                kinds[i] = sorted(counts.items())
            texts = batch.column(at)
            if fresh:
                said = texts.to_pylist()
                for i, t in fresh.items():
                    said[i] = t
                texts = pa.array(said, pa.string())
            columns = [texts if i == at else c for i, c in enumerate(batch.columns) if i != again_at]
            names = [c for c in batch.schema.names if c != "__again"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], [*names, "n_entities", "kinds"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", n_entities long, kinds map<string,int>"
    return rows.select(*own, "__again").mapInArrow(run, schema)
