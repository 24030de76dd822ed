"""Problem 6: variant spellings of the names of persons and organisations, linked across two scripts.

Every distinct string is parsed into a main token (surname or an organisation's own name) and the rest. A
symmetric-delete index joins main tokens within small edit distances; under one main token the other
parts are aligned by optimal assignment that permits initials, abbreviations, nicknames and missing parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_collect, cut, require, tasks

#: Bound of the table of name forms.
MOST_FORMS = 100_000

# Cyrillic letters in Latin, as one folded spelling.
_LATIN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sh", "", "i", "", "e", "iu", "ia", "e", "i", "i", "e", "g"], strict=True))
# Latin spellings of one sound, longest first.
_SAME_SOUND = (("shch", "sh"), ("sch", "sh"), ("tch", "ch"), ("dzh", "zh"), ("tz", "ts"), ("kh", "h"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("cz", "ch"), ("yu", "iu"), ("ju", "iu"), ("ya", "ia"), ("ja", "ia"), ("yo", "e"), ("ye", "e"), ("iy", "i"), ("ii", "i"), ("yi", "i"), ("ij", "i"), ("w", "v"), ("j", "zh"), ("y", "i"), ("x", "ks"), ("q", "k"))
# Strings that name nobody, folded.
_NOBODY = {"unknown", "anonymous", "anon", "unknown author", "author unknown", "no author", "various", "various authors", "n a", "na", "none", "null", "not available", "collective", "неизвестен", "неизвестный", "неизвестный автор", "автор неизвестен", "автор не указан", "не указан", "без автора", "аноним", "анонимный автор", "коллектив авторов", "невідомий", "невідомий автор", "автор невідомий", "анонім", "unbekannt", "inconnu", "anonyme", "desconocido", "anónimo", "нет автора", "нет"}
# Titles and remarks beside a name.
_TITLES = {"dr", "prof", "professor", "phd", "md", "sir", "mr", "mrs", "ms", "eds", "editor", "transl", "jr", "sr", "акад", "академик", "проф", "профессор", "доц", "доцент", "канд", "д-р", "доктор", "ред", "сост", "под"}
# Words of organisations in both scripts; the first is the folded meaning.
_ORG_WORDS = {
    "university": ("university", "университет", "ун-т", "універсистет", "universität", "université", "universidad"),
    "institute": ("institute", "институт", "ин-т", "інститут"), "bureau": ("bureau", "бюро", "office"), "society": ("society", "общество", "о-во", "товариство"),
    "publishers": ("publishers", "publisher", "publishing", "издательство", "изд-во", "press", "видавництво"), "academy": ("academy", "академия"), "laboratory": ("laboratory", "лаборатория"),
    "center": ("center", "centre", "центр"), "college": ("college", "колледж", "училище"), "company": ("company", "компания"), "association": ("association", "ассоциация"), "group": ("group", "группа"),
    "library": ("library", "библиотека"), "foundation": ("foundation", "фонд"), "committee": ("committee", "комитет"), "department": ("department", "кафедра"), "school": ("school", "школа"), "museum": ("museum", "музей"),
    "polytechnic": ("polytechnic", "политехнический"), "research": ("research", "исследовательский"), "scientific": ("scientific", "научный", "научное"), "technical": ("technical", "техническое", "технический"),
    "design": ("design", "конструкторское", "конструкторский"), "state": ("state", "государственный"), "medical": ("medical", "медицинский"), "national": ("national", "национальный"), "agricultural": ("agricultural", "сельскохозяйственный"),
    "pedagogical": ("pedagogical", "педагогический"), "historical": ("historical", "историческое", "исторический"), "mathematical": ("mathematical", "математический", "математическое"), "federal": ("federal", "федеральный"), "engineering": ("engineering", "инженерный"),
}
_ORG_NOUNS = {"university", "institute", "bureau", "society", "publishers", "academy", "laboratory", "center", "college", "company", "association", "group", "library", "foundation", "committee", "department", "school", "museum"}
# Short forms and words of two letters.
_SHORT = {"ed", "al", "mr", "ms", "dr", "md", "of", "им", "та"}
_SKIP = {"the", "of", "and", "for", "и", "им", "имени", "та"}
# More forms of given names than the table of forms holds.
MORE_FORMS = (
    ("Vladimir", "Владимир", "Vova", "Вова", "Volodya", "Володя", "Володимир"), ("James", "Джеймс", "Jim", "Джим", "Jimmy", "Джимми", "Jamie"), ("Yury", "Юрий", "Yuri", "Iurii", "Yuriy", "Yura", "Юра", "Юрій", "Jurij"),
    ("Nathaniel", "Натаниэль", "Nathan", "Nate", "Nat", "Нейт", "Нэт"), ("Zinaida", "Зинаида", "Zina", "Зина"), ("Viktor", "Victor", "Виктор", "Витя"), ("Sergey", "Сергей", "Sergei", "Seryozha", "Серёжа", "Сережа"), ("Andrey", "Андрей", "Andrei"),
    ("Grigory", "Григорий", "Grigorii", "Grigoriy", "Grisha", "Гриша"), ("Ivan", "Иван", "Vanya", "Ваня"), ("Pyotr", "Пётр", "Петр", "Petr", "Petya", "Петя"), ("Anna", "Анна", "Anya", "Аня"), ("Maria", "Мария", "Mariya", "Masha", "Маша"),
    ("Elena", "Елена", "Yelena", "Lena", "Лена"), ("Natalia", "Наталья", "Natalya", "Наталия", "Natasha", "Наташа"), ("Konstantin", "Константин", "Kostya", "Костя"), ("Lev", "Лев", "Лёва"), ("Alexey", "Алексей", "Aleksei", "Aleksey", "Alyosha", "Алёша", "Лёша"),
    ("John", "Джон", "Johnny", "Jack"), ("Richard", "Ричард", "Dick", "Rick"), ("Elizabeth", "Элизабет", "Liz", "Beth", "Betty"), ("Michael", "Майкл", "Mike"), ("Joseph", "Джозеф", "Joe"), ("George", "Джордж"), ("Arthur", "Артур", "Art"), ("Simon", "Саймон"),
)
#: Main tokens this long may differ by two edits, shorter ones of at least SHORTEST by one.
LONG, SHORTEST = 8, 4



@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """One spelling for what sounds alike in both scripts, in small Latin letters."""
    w = "".join(_LATIN.get(c, c) for c in unicodedata.normalize("NFKC", word).lower())
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isalpha() and c < "\x80")
    for a, b in _SAME_SOUND:
        w = w.replace(a, b)
    return re.sub(r"c(?!h)", "k", re.sub(r"c(?=[eiy])", "s", w))


def skeleton(folded: str) -> str:
    """Consonants of a folded word, each run once."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiou]", "", folded))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, or most + 1 when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def deletes(word: str) -> list[str]:
    """The word and what is left of it after one deletion, or two where it is long."""
    out, last = {word}, {word}
    for _ in range(2 if len(word) >= LONG else 1 if len(word) >= SHORTEST else 0):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return sorted(out)


def close_enough(a: str, b: str) -> int | None:
    """Edits between two main tokens where they are few enough for their lengths."""
    shorter = min(len(a), len(b))
    most = 2 if shorter >= LONG else 1 if shorter >= SHORTEST else 0
    d = edit_distance(a, b, most)
    return d if d <= most else None


class Forms:
    """Given names: every folded form points to the set of names it can stand for, by their folded main form."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        groups: list[set[str]] = []
        for names in [*({a, b} for a, b in pairs), *map(set, MORE_FORMS)]:
            mine = {fold(x) for x in names} | {x for n in names for x in [fold(n)]}
            raw = {n.lower() for n in names}
            touching = [g for g in groups if g & {f"={x}" for x in raw}]
            merged = {f"={x}" for x in raw} | mine
            for g in touching:
                # forms shared by two full names (a nickname) do not join them; only a full name does
                merged |= g
                groups.remove(g)
            groups.append(merged)
        self.memo: dict[str, set[int]] = {}
        self.costs: dict[tuple[str, str], float | None] = {}
        self.of: dict[str, set[int]] = defaultdict(set)
        self.initials: dict[int, set[str]] = defaultdict(set)
        for i, g in enumerate(groups):
            for x in g:
                if x.startswith("="):
                    self.initials[i].add(fold(x[1:])[:1])
                    self.initials[i].add("^" + x[1])
                else:
                    self.of[x].add(i)

    def ids(self, folded: str) -> set[int]:
        got = self.memo.get(folded)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[folded] = self._ids(folded)
        return got

    def _ids(self, folded: str) -> set[int]:
        got = self.of.get(folded)
        if got or len(folded) < 5:
            return got or set()
        return {i for f, s in self.of.items() if abs(len(f) - len(folded)) <= 1 and f[0] == folded[0] and edit_distance(f, folded, 1) <= 1 for i in s}

    def cost(self, a: str, b: str) -> float | None:
        """_part_cost, kept for pairs met before."""
        key = (a, b)
        if key not in self.costs:
            if len(self.costs) > 1_000_000:
                self.costs.clear()
            self.costs[key] = _part_cost(a, b, self)
        return self.costs[key]

    def keys(self, part: str) -> set[str]:
        """Keys of a part, of which any two parts that can stand for one name share one: its letter, first consonant, and the letters of the names it stands for."""
        if part.endswith("."):
            return {fold(part[:-1])[:1], "^" + part[0]}
        ids = self.ids(part)
        return {part[:1], "~" + skeleton(part)[:1], *(f"#{i}" for i in ids), *(x for i in ids for x in self.initials[i])}


def _tokens(name: str) -> list[str]:
    t = re.sub(r"\([^)]*\)|,\s*(?:eds?|ред)\.", " ", unicodedata.normalize("NFKC", name))
    flat = t == t.lower()
    # two capitals without dots are initials, as "K. B." is
    t = re.sub(r"(?<![^\W_])([^\W\d_])([^\W\d_])(?![^\W_]|\.)", lambda m: f"{m[1]}. {m[2]}." if (m[0].isupper() or flat) and m[0].lower() not in _SHORT else m[0], t)
    t = re.sub(r"\b(ун|ин|о|изд)-(т|во)\b", lambda m: m[1] + "‐" + m[2], t, flags=re.I)
    return [x.replace("‐", "-") for x in re.findall(r"[^\W\d_]+(?:‐[^\W\d_]+)?\.?|,", t)]


@lru_cache(maxsize=200_000)
def _org_word(token: str) -> str | None:
    w = token.rstrip(".").lower()
    if len(w) < 3:
        return None
    for meaning, words in _ORG_WORDS.items():
        for x in words:
            if w == x or (len(w) >= 3 and x.startswith(w) and (token.endswith(".") or len(w) >= 4)) or (len(w) >= 5 and abs(len(w) - len(x)) <= 1 and edit_distance(w, x, 1) <= 1) or (len(x) > 7 and len(w) > 6 and w[:6] == x[:6] and w[0] > "\x80"):
                return meaning
    return None


def parse(name: str | None, forms: Forms) -> dict:
    """kind (person, org or nobody), the folded main token and the parts beside it.

    Parts of a person are folded words, or initials as "x." with the letter as written and folded; parts of an organisation
    are the meanings of its words.
    """
    nobody = {"kind": "nobody", "main": None, "parts": []}
    if name is None:
        return nobody
    plain = " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", name).lower()))
    if not plain or plain in _NOBODY or not re.search(r"[^\W\d_]{2}", plain):
        return nobody
    tokens = [t for t in _tokens(name) if t.rstrip(".").lower() not in _TITLES]
    words = [t for t in tokens if t != ","]
    meanings = [_org_word(t) for t in words]
    if any(m in _ORG_NOUNS for m in meanings) and (len([m for m in meanings if m]) > 1 or len(words) <= 3):
        own = [fold(t) for t, m in zip(words, meanings, strict=True) if not m and t.rstrip(".").lower() not in _SKIP]
        own = [x for x in own if len(x) > 1]
        if own:
            return {"kind": "org", "main": max(own, key=len), "parts": sorted({m for m in meanings if m})}
    initial = lambda t: len(t.rstrip(".")) == 1 or (t.endswith(".") and len(t) <= 3)
    full = [t for t in words if not initial(t)]
    if not full:
        return nobody
    lead = [t for t in tokens[: tokens.index(",")] if not initial(t)] if "," in tokens[1:] else []
    if lead and len(full) >= 1 and len(lead) == 1:
        main = lead[0]
    elif len(full) == 1:
        main = full[0]
    else:
        known = [bool(forms.ids(fold(t))) for t in full]
        if initial(words[0]):
            main = full[-1]
        elif known[0] and not known[-1]:
            main = full[-1]
        elif known[0] and known[-1]:
            main = full[-1] if len(full) != 2 else max(full, key=len)
        elif any(known):
            main = full[0]
        else:
            main = max(full, key=lambda t: len(fold(t)))
    parts, dropped = [], False
    for t in words:
        if t == main and not dropped:
            dropped = True
        elif initial(t):
            parts.append(t.rstrip(".").lower() + ".")
        else:
            parts.append(fold(t))
    return {"kind": "person", "main": fold(main), "parts": parts}


def _part_cost(a: str, b: str, forms: Forms) -> float | None:
    """Cost of two parts standing for the same name, or none where they can't."""
    ia, ib = a.endswith("."), b.endswith(".")
    if ia and ib:
        return 0.1 if a == b or fold(a) == fold(b) else None
    if ia or ib:
        letter, word = (a[:-1], b) if ia else (b[:-1], a)
        ids = forms.ids(word)
        if fold(letter) and word.startswith(fold(letter)) or any({fold(letter)[:1], "^" + letter[0]} & forms.initials[i] for i in ids):
            return 0.2
        return None
    if a == b or forms.ids(a) & forms.ids(b):
        return 0.0
    if len(min(a, b, key=len)) >= 4 and edit_distance(a, b, 2) <= (1 if min(len(a), len(b)) < 7 else 2) and a[0] == b[0]:
        return 0.1
    if skeleton(a) == skeleton(b) and len(skeleton(a)) >= 2:
        return 0.2
    return 0.3 if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) else None


def assignment(costs: list[list[float]]) -> list[int]:
    """Columns of the rows in the cheapest assignment (rows at most as many as columns), by shortest augmenting paths."""
    n, m = len(costs), len(costs[0])
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


#: Costs of a part without a place, and of the longer name's first part without one; both forbid the alignment.
_NO_PLACE, _NO_FIRST = 1e6, 1e3


def align(a: list[str], b: list[str], forms: Forms) -> float | None:
    """Cost of the best assignment of all parts of the shorter name to the longer one's, or none where a part has no place.

    The given names must meet each other; a missing second name costs little, and so does another order.
    """
    if not a or not b:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    costs = []
    for i, x in enumerate(short):
        row = [forms.cost(x, y) for y in long]
        if all(c is None for c in row):
            return None
        costs.append([_NO_PLACE if c is None else c + 0.05 * (i != j) - (0 if j else _NO_FIRST) for j, c in enumerate(row)])
    # the first part of the longer name has its place in the best assignment, unless none allows it
    total = sum(costs[i][j] for i, j in enumerate(assignment(costs))) + _NO_FIRST
    return total + 0.15 * (len(long) - len(short)) if total < _NO_FIRST / 2 else None


def resolve(parts: list[list[str]], forms: Forms) -> list[int]:
    """Entity numbers for the distinct parts under one main token.

    Names with a written given name come first, those with more parts before those with fewer; a name joins
    the only entity all of whose members it agrees with. Where several fit, it stays alone, as it could be either.
    Entities are looked up by keys that parts of one name share, so a frequent surname is not compared with all of its own.
    """
    rank = lambda p: (p[0].endswith(".") if p else True, -sum(not x.endswith(".") for x in p), -len(p), p)
    # initials are measured against written names where an entity has any: letters of two scripts need not match
    written = lambda e: [q for q in e if q and not q[0].endswith(".")] or e
    entities: list[list[list[str]]] = []
    by_key: dict[str, set[int]] = defaultdict(set)
    at: dict[tuple[str, ...], int] = {}
    for p in sorted(parts, key=rank):
        keys = set().union(*map(forms.keys, p)) if p else set()
        near = sorted(set().union(*(by_key[k] for k in keys if k in by_key))) if keys else []
        fit = [i for i in near if all(align(p, q, forms) is not None for q in written(entities[i]))]
        if len(fit) > 1:
            exact = [i for i in fit if any(len(q) == len(p) and not q[0].endswith(".") and not p[0].endswith(".") for q in entities[i])]
            fit = exact if len(exact) == 1 else fit
        if len(fit) != 1:
            fit = [len(entities)]
            entities.append([])
        at[tuple(p)] = fit[0]
        entities[fit[0]].append(p)
        for k in keys:
            by_key[k].add(fit[0])
    return [at[tuple(p)] for p in parts]


_PARSED = pa.struct([("kind", pa.string()), ("main", pa.string()), ("parts", pa.list_(pa.string()))])


def entities(names: DataFrame, name_forms: DataFrame, name: str = "name") -> DataFrame:
    """name and entity for every distinct string that names somebody; strings of one entity share its number.

    Null and empty strings and placeholders name nobody and are left out. name_forms (full_form, other_form) is a small
    fixed table, checked against MOST_FORMS. Everything is keyed: distinct strings, distinct main tokens joined through
    their deletions, and per main token the distinct parts, so repeated rows of a frequent author cost nothing.
    """
    require(names, name)
    require(name_forms, "full_form", "other_form")
    pairs = [(r.full_form, r.other_form) for r in bounded_collect(name_forms.dropna(subset=["full_form", "other_form"]), MOST_FORMS, "the table of name forms")]
    forms = Forms(pairs)

    def parse_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([parse(n, forms) for n in b.to_pylist()], _PARSED)

    distinct = names.select(F.col(f"`{name}`").alias("name")).filter("name IS NOT NULL").distinct()
    parsed = distinct.select("name", F.arrow_udf(parse_all, "struct<kind:string,main:string,parts:array<string>>")("name").alias("p")).select("name", "p.*")
    parsed = cut(parsed.filter("kind <> 'nobody'"))
    mains = cut(canonical_mains(parsed.groupBy("kind", "main").agg(F.count("*").alias("n"))))
    placed = parsed.join(mains, ["kind", "main"])

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([resolve(x, forms) for x in b.to_pylist()], pa.list_(pa.int32()))

    people = placed.filter("kind = 'person'").groupBy("root").agg(F.collect_set("parts").alias("ps")).repartition(tasks(names.sparkSession), "root")
    people = people.select("root", F.explode(F.arrays_zip("ps", F.arrow_udf(number, "array<int>")("ps").alias("e"))).alias("z"))
    people = people.select("root", F.col("z.ps").alias("parts"), F.col("z.e").alias("no"))
    orgs = placed.filter("kind = 'org'").select("root", F.array_join("parts", " ").alias("what"), "name")
    # letters alone beside an organisation's own name stand for its words, such as D.B. for a design bureau
    held = orgs.select("root", "what").distinct().groupBy("root").agg(F.collect_set("what").alias("whats"))
    by_letters = _by_batch(_organisation_of, pa.string(), "string")
    persons = placed.filter("kind = 'person'").join(held, "root", "left")
    persons = persons.withColumn("what", F.when(F.col("whats").isNotNull() & (F.size("parts") > 1), by_letters("parts", "whats")))
    persons = cut(persons.select("name", "root", "parts", "what"))
    orgs = orgs.unionByName(persons.filter("what IS NOT NULL").select("root", "what", "name"))
    named = persons.filter("what IS NULL").join(people, ["root", "parts"]).select("name", F.xxhash64(F.lit("person"), "root", "no").alias("entity"))
    return named.union(orgs.select("name", F.xxhash64(F.lit("org"), "root", "what").alias("entity")))


def _organisation_of(parts: list[str] | None, whats: list[str] | None) -> str | None:
    if not parts or not whats or any(not p.endswith(".") for p in parts):
        return None
    letters = sorted(p[0] for p in parts)
    for what in sorted(whats):
        for i in (0, 1):
            if letters == sorted(_ORG_WORDS[w][i][0] for w in what.split(" ")):
                return what
    return None


def _by_batch(fn: Callable, kind: pa.DataType, ddl: str) -> Callable[..., Column]:
    """A column function that calls fn on the values of whole Arrow batches."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([fn(x) for x in b.to_pylist()], kind)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return lambda *cols: F.arrow_udf(one if len(cols) == 1 else two, ddl)(*cols)


def canonical_mains(mains: DataFrame) -> DataFrame:
    """kind, main and root: the token that most distinct strings use in its neighbourhood of small edit distances.

    A token points to its nearest neighbour that is used more (or as much and sorts first), of equally near ones to the most
    used; jumps along the pointers go on until nothing changes, so that chains of any length come to their end.
    """
    variants = _by_batch(deletes, pa.list_(pa.string()), "array<string>")
    close = _by_batch(close_enough, pa.int32(), "int")
    keyed = mains.select("kind", "main", "n", F.explode(variants("main")).alias("v"))
    other = keyed.select(F.col("kind").alias("k2"), F.col("main").alias("to"), F.col("n").alias("n2"), F.col("v").alias("v2"))
    # never broadcast: sizes are estimated from the tokens, and the index has about fifty times their rows
    joined = keyed.hint("merge").join(other.hint("merge"), (F.col("kind") == F.col("k2")) & (F.col("v") == F.col("v2")) & (F.col("main") != F.col("to")))
    joined = joined.filter((F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("to") < F.col("main"))))
    joined = joined.select("kind", "main", "to", "n2").distinct()
    joined = joined.repartition(tasks(mains.sparkSession), "kind", "main").withColumn("d", close("main", "to")).filter("d IS NOT NULL")
    best = joined.groupBy("kind", "main").agg(F.min_by("to", F.struct("d", (-F.col("n2")).alias("n"), "to")).alias("to"))
    pointed = cut(mains.select("kind", "main").join(best, ["kind", "main"], "left").select("kind", "main", F.coalesce("to", "main").alias("root")))
    while True:
        step = pointed.select("kind", F.col("main").alias("root"), F.col("root").alias("next"))
        jumped = cut(pointed.join(step, ["kind", "root"]).select("kind", "main", "root", "next"))
        pointed = jumped.select("kind", "main", F.col("next").alias("root"))
        if jumped.filter("root <> next").isEmpty():
            return pointed


def linked(found: DataFrame) -> DataFrame:
    """All pairs of different strings of one entity, the smaller first by code point."""
    a = found.select("entity", F.col("name").alias("name_a"))
    b = found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
