"""Personal data replaced by keyed surrogates of the same kind, format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import fixed_point, fresh, give_back, saved, small_batches

KEY = "surrogate-key"
# After so many attempts each, surrogates become one step longer.
GROWTH = 2

# Titles by gender, and given names by script and gender. Replacements come from the same list.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f",
    "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Doña": "f",
    "Dr": "", "Prof": "", "Professor": "",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Pierre Jean Luis Carlos Pedro Antonio",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Anna Julia Petra Sabine Marie Claire Carmen Lucia Elena Sofia",
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Николай Андрей Михаил Владимир Юрий",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия",
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα",
}
# Given names that are found too, but not given out.
FURTHER = {
    ("latin", "m"): (
        "Aaron Adam Adrian Alan Albert Alejandro Alex Alexander Alfred Ali Andrea Andreas Andrew Anthony Arthur Ben Benjamin Bernd Brandon Brian Bruno "
        "Carl Christian Christoph Christopher Dave Dennis Diego Dieter Donald Douglas Edward Emil Eric Ethan Felix Fernando Florian Francisco "
        "Frank Franz Fred Gabriel Gary George Georg Gerald Giovanni Giuseppe Gregory Günter Guillaume Harry Heinrich Henri Henry Hugo Ian Ivan Jack "
        "Jacob Jacques Jan Jason Javier Jeff Jeffrey Jeremy Jerry Jesse Jim Joe Jonas Jonathan Jorge Jose José Joseph Joshua Juan Jürgen Justin "
        "Karl Keith Kenneth Kevin Larry Lars Laurent Leo Leon Louis Lucas Lukas Marc Marco Marcus Mario Mark Markus Martin Matthew Max Michel Miguel Mike "
        "Mohamed Mohammed Muhammad Nathan Nicholas Nicolas Nick Noah Oliver Olivier Oscar Otto Pablo Patrick Philip Philipp Philippe Rafael Ralph Ramón Raymond "
        "Ricardo Richard Roger Roland Ronald Roy Russell Ryan Samuel Scott Sean Sebastian Simon Stefan Stephen Steve Steven Terry Theo Tim Timothy Tom "
        "Uwe Victor Vincent Walter Wolfgang Xavier Yves Zachary"
    ),
    ("latin", "f"): (
        "Abigail Agnes Alice Alicia Amanda Amelia Amy Ana Andrea Angela Angelika Anita Anja Ann Anne Annette Antonia Ashley Ava Beatrice Beatriz Betty Birgit Brenda "
        "Brigitte Camille Carol Caroline Carolyn Catherine Cecilia Charlotte Chloe Christina Christine Cynthia Deborah Debra Denise Diana Diane Donna Dorothy "
        "Ella Ellen Emily Emma Erika Eva Evelyn Fatima Florence Frances Gabriela Gisela Gloria Grace Hanna Hannah Heather Heidi Helen Helena Helga Inès Ines Ingrid Irene Isabel "
        "Isabella Jacqueline Jane Janet Janice Jean Jessica Joan Johanna Joyce Judith Judy Julie Karin Katharina Katherine Kathleen Kelly Kimberly "
        "Laura Lauren Lea Lena Lily Lisa Louise Lucy Madison Manuela Margaret María Maria Marilyn Marta Martha Martina Megan Melissa Mia Michelle Monica Monika "
        "Natalie Nicole Nina Nora Olga Olivia Pamela Paula Pauline Rachel Rebecca Renate Rosa Rose Ruth Samantha Sandra Sara Sharon Shirley Silvia Simone "
        "Sophia Sophie Stefanie Stephanie Susanne Teresa Theresa Tina Ursula Valerie Vanessa Vera Veronica Victoria Virginia Yvonne Zoe"
    ),
    ("cyrillic", "m"): "Александр Антон Артём Борис Василий Виктор Григорий Денис Евгений Игорь Илья Кирилл Константин Максим Никита Олег Павел Роман Степан Фёдор",
    ("cyrillic", "f"): "Александра Алина Анастасия Валентина Вера Виктория Галина Дарья Евгения Ксения Лариса Людмила Любовь Марина Надежда Нина Полина Софья Тамара",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνης Βασίλης Θανάσης Μιχάλης Παναγιώτης Παύλος Πέτρος Σπύρος Στέλιος Χρήστος",
    ("greek", "f"): "Αγγελική Αικατερίνη Αναστασία Βασιλική Γεωργία Δήμητρα Ειρήνη Ευαγγελία Ιωάννα Χριστίνα",
}
NAMES = {name: at for lists in (FURTHER, GIVEN) for at, names in lists.items() for name in names.split()}
GENDERS = {name.lower(): gender for name, (_, gender) in NAMES.items()}
SYLLABLES = {
    "latin": "ba den for gan hol ker lin mar nor pel ras sten tor val win zel bro dan fel gre",
    "cyrillic": "бар вел гор дан зол кам лан мор нов пет рад сок тар фед чер",
    "greek": "βαρ δελ ζαν καλ λιν μαρ νικ παν ραδ σολ ταν φιλ",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Capital letters of every alphabet, which the patterns have no class for.
_UPPER = "".join(c for c in map(chr, range(0x1F000)) if c.isupper() and c.isalpha() or c.istitle())
_CAPITAL = rf"[{_UPPER}]\w*(?:[-'’][^\W\d_]\w*)?"
_CAPITALS = rf"[{_UPPER}]{{2,}}(?:[-'’][{_UPPER}]+)?(?!\w)"


def _one_of(names: list[str]) -> str:
    """A pattern of names by their first letter, so that most words are turned down at once."""
    tails: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        tails.setdefault(name[0], []).append(name[1:])
    return f"(?=[{''.join(sorted(tails))}])(?:{'|'.join(f'{c}(?:{"|".join(t)})' for c, t in sorted(tails.items()))})"


KEYWORDS = r"token|secret|password|passwd|passphrase|pwd|credentials?|api[_ -]?key|(?:access|private|encryption|signing)[_ -]?key|auth(?:orization)?"
# Names of settings about a secret.
ABOUT = r"count|counts|type|limit|length|len|size|policy|expiry|expires|url|uri|endpoint|name|field|file|path|index|max|min|ttl"
SCHEMES = r"bearer|basic|token|digest|negotiate|apikey"
CUES = r"(?i:my name is|full name:|name:|signed by|attn:|attention:|contact person:|sincerely,|(?:kind |best )?regards,)"
# In order of precedence; the inner group of a kind, where there is one, is the entity, else the whole match.
PATTERNS = [
    # The keyword may stand within an identifier; a scheme before the value is no part of it.
    ("secret", rf"(?:(?<![^\W_])|(?<=[a-z])(?=[A-Z]))(?i:{KEYWORDS})(?!(?i:[_-]?(?:{ABOUT}))(?![A-Za-z0-9]))(?:[_-][A-Za-z0-9]+|(?<=[a-z])[A-Z][a-z0-9]*){{0,4}}[\"']?\s*[:=]\s*[\"']?"
               rf"(?:(?i:{SCHEMES})\s+)?(?!(?i:{SCHEMES})(?:\s|$))(?P<secret>[^\s\"'<>,;#]{{6,}})"),
    ("secret2", r"\b(?:AKIA|ASIA|AIza|gh[pousr]_|sk-|pk_|xox[abp]-)[A-Za-z0-9_\-]{12,}"),
    ("secret3", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)?"),
    ("email", r"[\w.%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\d\-])(?:\d{4}[ \-]?){3}\d{4}(?![\d\-])|(?<![\d\-])\d{4}[ \-]?\d{6}[ \-]?\d{5}(?![\d\-])"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\w+])(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ \-]?\d{2,4}){1,4}(?![\w.])"),
    ("titled", rf"\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ](?P<titled>{_CAPITAL}(?:[ ]{_CAPITAL})?)"),
    ("person", rf"\b(?P<person>{_one_of(list(NAMES))}[ ]{_CAPITAL}|{_one_of([n.upper() for n in NAMES])}[ ]{_CAPITALS})"),
    ("cued", rf"(?<!\w){CUES}\s+(?P<cued>{_CAPITAL}[ ]{_CAPITAL})"),
]
INNER = ("secret", "titled", "person", "cued")
FINDER = re.compile("|".join(f"(?P<k_{kind}>{pattern})" for kind, pattern in PATTERNS))
# A text without a match of this, for an automaton that scans whole columns fast, holds no entity.
HINT = (
    r"@|\p{Nd}|AKIA|ASIA|AIza|gh[pousr]_|sk-|pk_|xox[abp]-"
    rf"|eyJ[A-Za-z0-9_\-]{{8}}|(?i:{KEYWORDS})[A-Za-z0-9_-]*[\"']?[\s\x0B\x1C-\x1F\pZ\x{{85}}]*[:=]|(?i:{CUES[4:]}"
    rf"|(?:^|[^\pL])(?:{'|'.join(TITLES)})\.? \pL|(?:^|[^\pL])(?:{'|'.join([*NAMES, *map(str.upper, NAMES)])}) \p{{Lu}}"
)


def script(text: str) -> str:
    """The script of the first letter that is Latin, Cyrillic or Greek; Latin if none is."""
    for c in text:
        name = unicodedata.name(c, "")
        for kind in ("LATIN", "CYRILLIC", "GREEK"):
            if name.startswith(kind):
                return kind.lower()
    return "latin"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical)`` of every entity of a text, in order and without overlap.

    Mentions that differ in case, or in the separators of numbers, have one canonical form. The kind of a
    person tells gender and script: a title decides the gender, else a known given name. See ``units`` for what is
    replaced.
    """
    out = []
    for match in FINDER.finditer(text or ""):
        kind = next(k for k, _ in PATTERNS if match[f"k_{k}"] is not None)
        start, end = match.span(kind if kind in INNER else 0)
        value = text[start:end]
        if kind == "secret" and not any(map(str.isalnum, value)):
            # A mask hides nothing.
            continue
        if kind == "email":
            canonical = value.lower()
        elif kind in ("card", "phone", "ssn"):
            canonical = re.sub(r"[^\d+]", "", value)
        elif kind == "iban":
            canonical = value.replace(" ", "")
        elif kind in ("titled", "person", "cued"):
            gender = GENDERS.get(value.split(" ")[0].lower(), "")
            if kind == "titled":
                gender = TITLES[text[match.start() : start].rstrip(". ")] or gender
            canonical, kind = value, f"person-{gender}-{script(value)}"
        else:
            canonical, kind = value, kind.rstrip("23")
        out.append((start, end, kind, canonical))
    return out


def units(text: str | None) -> list[tuple[int, int, str, str]]:
    """The entities of a text as they are replaced: persons name by name, all others whole.

    So ``Mr Smith``, ``John Smith`` and ``JOHN SMITH`` keep one surname. A listed given name has a gender, that of the
    title where it follows one, else its own; any other name has none, wherever it stands. The same given name
    after titles of two genders is two names.
    """
    out = []
    for start, end, kind, canonical in entities(text):
        if not kind.startswith("person"):
            out.append((start, end, kind, canonical))
            continue
        gender = kind.split("-")[1]
        for part in canonical.split(" "):
            own = GENDERS.get(part.lower(), "")
            out.append((start, start + len(part), f"person-{own and (gender or own)}-{script(part)}", part.lower()))
            start, gender = start + len(part) + 1, ""
    return out


def hinted(texts: pa.Array) -> list[int]:
    """The rows of those texts that may hold an entity."""
    return np.flatnonzero(pc.match_substring_regex(texts, HINT).fill_null(False).to_numpy(zero_copy_only=False)).tolist()


class Stream:
    """Keyed pseudo-random numbers that depend on an entity and an attempt alone."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int):
        self.seed = hmac.digest(key.encode(), f"{kind}\0{attempt}\0{canonical}".encode("utf-8", "surrogatepass"), "sha256")
        self.turn, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest()
            self.turn += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def _shaped(value: str, numbers: Stream) -> str:
    """The same shape: digits for digits, hex for hex, letters of the same case and script."""
    is_hex = len(value) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    out = []
    for c in value:
        if is_hex:
            digit = "0123456789abcdef"[numbers.below(16)]
            out.append(digit.upper() if value.isupper() else digit)
        elif c.isdecimal():
            out.append(str(numbers.below(10)))
        elif c.isalpha():
            letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script(c), "abcdefghijklmnopqrstuvwxyz")
            letter = letters[numbers.below(len(letters))]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int, key: str = KEY) -> str:
    """The canonical replacement of an entity; later attempts draw from ever larger spaces."""
    numbers, more = Stream(key, kind, canonical, attempt), attempt // GROWTH
    letters = "".join("abcdefghijklmnopqrstuvwxyz"[numbers.below(26)] for _ in range(more))
    if kind == "email":
        local, _, domain = canonical.partition("@")
        reserved = re.search(r"(?:^|\.)example\.(?:com|org|net)$", domain)
        host = domain[: reserved.start()] if reserved else domain.rpartition(".")[0]
        tail = f"example.{('com', 'org', 'net')[numbers.below(3)]}" if not reserved else reserved[0].lstrip(".")
        return _shaped(local, numbers) + letters + "@" + (_shaped(host, numbers) + "." if host else "") + tail
    if kind == "ip":
        # 240.0.0.0/4 is reserved, so no host is named while one of it is free.
        first = numbers.below(256) if more > 4 else 240 + numbers.below(15)
        return ".".join(str(n) for n in (first, numbers.below(256), numbers.below(256), numbers.below(256)))
    if kind == "card":
        digits = canonical[0] + "".join(str(numbers.below(10)) for _ in canonical[1:-1])
        right = [d for d in "0123456789" if luhn(digits + d)][0]
        return digits + (right if luhn(canonical) else str((int(right) + 1 + numbers.below(9)) % 10))
    if kind == "ssn":
        # No such number begins with 9; others are taken when those run out.
        return (str(numbers.below(10)) if more > 4 else "9") + "".join(str(numbers.below(10)) for _ in canonical[1:])
    if kind == "phone":
        lead = 2 if canonical.startswith("+1") else min(3, len(canonical) - 4) if canonical[0] == "+" else 0
        rest = canonical[lead:]
        return canonical[:lead] + str(2 + numbers.below(8)) + "".join(str(numbers.below(10)) for _ in range(len(rest) - 1 + more))
    if kind == "iban":
        body = _shaped(canonical[4:], numbers)
        value = "".join(str(int(c, 36)) for c in body + canonical[:2] + "00")
        return f"{canonical[:2]}{98 - int(value) % 97:02d}{body}"
    if kind.startswith("person"):
        _, gender, writing = kind.split("-")
        if gender:
            names = GIVEN[writing, gender].split()
            return "-".join(names[numbers.below(len(names))] for _ in range(1 + more))
        parts = SYLLABLES[writing].split()
        return "".join(parts[numbers.below(len(parts))] for _ in range(2 + numbers.below(2) + more)).capitalize()
    return _shaped(canonical, numbers) + letters


def dressed(mention: str, kind: str, replacement: str) -> str:
    """A canonical replacement in the format of one mention: its case, or its separators."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(replacement)
        return "".join(next(rest, "") if c.isalnum() or c == "+" else c for c in mention) + "".join(rest)
    if mention.isupper() and (kind == "email" or kind.startswith("person") and len(mention) > 1):
        return replacement.upper()
    return replacement


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """``(text_key, kind, canonical)``: the distinct units of each text, under a hash of it."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<kind: string, canonical: string>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = pa.struct([("kind", pa.string()), ("canonical", pa.string())])
        for texts in batches:
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in hinted(texts):
                found[i] = [{"kind": k, "canonical": c} for k, c in dict.fromkeys(e[2:] for e in units(texts[i].as_py()))]
            yield pa.array(found, pa.list_(pair))
            give_back()

    hit = docs.select(F.xxhash64(text_col).alias("text_key"), find(F.col(text_col)).alias("found"))
    return hit.select("text_key", F.explode("found").alias("found")).select("text_key", "found.kind", "found.canonical")


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, canonical, attempt, surrogate)``: one row per distinct entity, no two surrogates of a kind equal.

    Names of all persons count as one kind here and are compared without case, so that two never become one.
    Every entity proposes a surrogate. Where several propose the same one, or one that is itself an entity of
    that kind, all but the first try again with the next attempt, until nothing collides. The space grows with the attempt,
    so that this ends however many entities there are.
    """

    @F.pandas_udf("string")
    def propose(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, int(a), key) for k, c, a in zip(kind, canonical, attempt, strict=True)])

    def placed(value: str) -> list:
        person = F.col("kind").startswith("person")
        return [F.when(person, "person").otherwise(F.col("kind")).alias("space"), F.when(person, F.lower(value)).otherwise(F.col(value)).alias("form")]

    known = saved(found.groupBy("kind", "canonical").agg(F.lit(0).alias("attempt")))
    taken = known.select(*placed("canonical"), F.lit(True).alias("real")).distinct()
    which = F.struct("attempt", "canonical", "kind")

    def checked(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", *placed("surrogate"))
        first = rows.groupBy("space", "form").agg(F.min(which).alias("first"))
        joined = rows.join(first, ["space", "form"]).join(taken, ["space", "form"], "left")
        clash = F.col("real").isNotNull() | (which != F.col("first"))
        return joined.select("kind", "canonical", "attempt", "surrogate", clash.alias("clash"))

    def again(rows: DataFrame) -> DataFrame:
        attempt = F.col("attempt") + F.col("clash").cast("int")
        moved = rows.select("kind", "canonical", attempt.alias("attempt"))
        return checked(moved.withColumn("surrogate", propose("kind", "canonical", "attempt")))

    start = checked(known.withColumn("surrogate", propose("kind", "canonical", "attempt")))
    return fixed_point(again, start, "clash").drop("clash")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The documents with surrogates in ``text_col`` and all other columns as they are.

    The same entity gets the same surrogate everywhere, and different entities get different ones. Texts stay
    where they are: a task computes first-attempt surrogates itself, and only the few entities that had to
    try again are joined, by a hash of the text, so that ids are not looked at: they may be null or repeated, and
    a row of the join holds what one text holds. Null stays null and empty stays empty; a table without entities
    comes back as it was. Texts of any length are searched whole, one at a time.
    """
    found = saved(_found(docs, text_col))
    given = assign(found, key)
    special = saved(
        found.join(given.where("attempt > 0"), ["kind", "canonical"])
        .groupBy("text_key")
        .agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias("special"))
    )

    @F.arrow_udf("string")
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, specials in batches:
            new, mask = [], np.zeros(len(texts), dtype=bool)
            for i in hinted(texts):
                text = texts[i].as_py()
                spans = units(text)
                if not spans:
                    continue
                rows = specials[i].as_py() or []
                other = {(r["kind"], r["canonical"]): r["surrogate"] for r in rows}
                parts, at = [], 0
                for start, end, kind, canonical in spans:
                    value = other.get((kind, canonical)) or surrogate(kind, canonical, 0, key)
                    parts += [text[at:start], dressed(text[start:end], kind, value)]
                    at = end
                new.append("".join([*parts, text[at:]]))
                mask[i] = True
            yield pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type)) if new else texts
            give_back()

    own, extra = fresh(docs, "special_key", "special_rows")
    named = special.select(F.col("text_key").alias(own), F.col("special").alias(extra))
    joined = docs.join(named, F.xxhash64(text_col) == F.col(own), "left")
    columns = [rewrite(F.col(c), F.col(extra)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns)
