"""Problem 7: defective question-answer pairs in chat lines and in raw model replies.

Copies are found by compressing the answer with its question as a zstandard dictionary; refusals and stand-ins
by dictionaries; answers in another language by the language model unless question or system turn asks for it;
truncation by a model of terminal contexts, counted where lines of all answers end and where they go on.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.language import LanguageModel, sentences
from folioflow.llm.language import _WORD as WORD
from folioflow.session import bounded_collect, cut, require

#: Bound of the contexts met five times or more: the last characters that text can have, in four states.
MOST_CONTEXTS = 20_000
DEFECTS = ("empty_answer", "refusal", "copied_question", "other_language", "truncated_answer")

# What stands in for an answer.
STAND_INS = {
    "n/a", "na", "none", "null", "nil", "nan", "undefined", "empty", "no answer", "no response", "blank", "tbd", "todo", "no data", "not available", "br",
    "нет ответа", "ответа нет", "пусто", "нет", "немає відповіді", "keine antwort", "pas de réponse", "sin respuesta",
}

# How a reply declines, by language.
REFUSALS = {
    "en": r"i(?:['’]m| am)? (?:very |so )?sorry\b.*\b(?:can(?:['’]t|not| not)|unable|not able|must decline|have to decline|do not have|don['’]t|not allowed|not permitted|won['’]t)|\b(?:sorry|unfortunately|i apologi[sz]e|regrettably)\b.{0,40}\b(?:can(?:['’]t|not| not)|unable|not able|must decline|have to decline|do not have|don['’]t|not allowed|not permitted|won['’]t)|as an? (?:ai|language|large)\b.{0,30}(?:can(?:['’]t|not| not)|unable|not able|must|may not|do not|am not|won['’]t)|i(?:['’]d| would) (?:rather|prefer) not|i don['’]t feel comfortable|i (?:can(?:['’]t|not)|must decline|have to decline|won['’]t|am not able|am unable|refuse|decline)\b.{0,40}\b(?:help|answer|assist|discuss|talk|write|say|comment|provide|respond|that|this|it)\b|this request can(?:['’]t|not) be|no answer will be given|request (?:was|has been|is) (?:declined|refused|rejected)|(?:violates|against|conflicts with) .{0,30}polic|\b(?:answer|content|response|reply) (?:is |was |has been )?withheld|\bdo not have permission\b|not (?:permitted|allowed) to (?:write|answer|discuss)|usage polic",
    "ru": r"(?:извин|прост|сожал|прошу прощ|увы).{0,60}(?:не мо[гж]|не имею|не в состоянии|не вправе|вынужден|отказ|нельзя)|как (?:языковая|большая|ии)?.{0,12}модель.{0,30}(?:не |вынужден|отказ)|предпочту не|предпочёл бы не|нельзя дать|дать нельзя|запрос отклон|отклон[её]н|(?:вынужден\w*|обязан\w*|должен|должна) отказать|я не (?:могу|буду|стану|вправе|имею права).{0,40}(?:ответ|помо|обсужд|говор|писа|коммент)|не хотел\w* бы отвечать|политик\w+ использовани|правил\w+ использовани",
    "uk": r"(?:вибач|пробач|на жаль|шкод|перепрош).{0,60}(?:не мож|не маю|не в змозі|не вправі|мушу|змушен|відмов)|як (?:мовна|велика|ші)?.{0,12}модель.{0,30}(?:не |мушу|відмов)|волі[юв] не|відповіді на такий запит|запит відхилен|відхилено|(?:мушу|змушен\w*|повин\w+) відмовити|я не (?:можу|буду|маю права).{0,40}(?:відпов|допомог|обговор|писа|говор)|не хотів би відповідати|політик\w+ використанн|правил\w+ використанн",
    "de": r"(?:tut mir leid|leider|entschuldig|verzeih|bedau).{0,60}(?:nicht|nichts|kein|ablehnen|verweigern)|als (?:ki|sprachmodell).{0,30}(?:nicht|nichts|kein|ablehnen)|ich (?:kann|darf|möchte|werde) (?:das|dies|dazu|darauf|hier|hierzu|dabei|bei)?.{0,40}(?:nicht|nichts|keine) .{0,20}(?:helfen|antworten|beantworten|sagen|äußern|schreiben|sprechen)|anfrage (?:wurde|wird|kann nicht).{0,30}(?:abgelehnt|bearbeitet|beantwortet)|(?:muss|möchte) .{0,30}ablehnen|lieber nicht|nutzungsrichtlinie|nutzungsbedingung",
    "fr": r"(?:désolé|malheureusement|navré|regrette|excus|pardon).{0,60}(?:ne (?:peux|puis|suis|peut|dois)|n['’]ai pas|refuser|impossible)|en tant que (?:modèle|ia|mod).{0,40}(?:ne |refuser|n['’])|je (?:préfère|préférerais|aimerais mieux) ne pas|je dois refuser|je ne (?:peux|puis|suis pas en mesure).{0,40}(?:répondre|aider|parler|écrire|dire|discuter)|demande (?:a été )?(?:refusée|rejetée)|ne peut (?:pas )?être (?:donnée?|traitée?)|(?:politique|conditions) d['’]utilisation",
    "es": r"(?:lo siento|lamentablemente|por desgracia|perdón|disculp|lamento).{0,60}(?:no (?:puedo|tengo|debo|estoy|me)|negarme|rechazar|imposible)|como (?:modelo|ia|mod).{0,40}(?:no |debo|negar)|prefiero no|preferiría no|debo (?:negarme|rechazar)|no puedo (?:ayudar|responder|contestar|hablar|escribir|comentar)|solicitud (?:ha sido )?(?:rechazada|denegada)|no se puede (?:dar|responder|completar)|política de uso|normas de uso",
}
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS.values()), re.I | re.S)
#: A refusal is short: it stands in the first sentences and no answer follows.
REFUSAL_WORDS = 45

# Stems by which a language is named when an answer in it is asked for.
LANGUAGE_STEMS = {
    "en": ("english", "английск", "англійськ", "englisch", "anglais", "inglés", "ingles"),
    "ru": ("russian", "русск", "по-русски", "російськ", "russisch", "russe", "ruso"),
    "uk": ("ukrainian", "украинск", "українськ", "ukrainisch", "ukrainien", "ucraniano", "ucranian"),
    "de": ("german", "немецк", "німецьк", "deutsch", "allemand", "alemán", "aleman"),
    "fr": ("french", "французск", "французьк", "französisch", "franzosisch", "français", "francais", "francés", "frances"),
    "es": ("spanish", "испанск", "іспанськ", "spanisch", "espagnol", "español", "espanol", "castellano"),
}

_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_GOES_ON = re.compile(r"(?<=\S) +(?=[a-zа-яёіїєґß-öø-ÿ])")
_ENTRY = re.compile(r"^\s*(?:[-*•–—]|\d{1,3}[.)]|\[[ x]?\])\s+(.*)$")
_LEAD = re.compile(r"^\s*(?:>+|[-*#]+|(?:q|a|question|answer|frage|antwort|вопрос|ответ|питання|відповідь|pregunta|respuesta|réponse)\s*[:.)])\s*", re.I)


def _plain(text: str) -> str:
    """Letters and digits of a text, case and form folded, single blanks between."""
    t = unicodedata.normalize("NFKC", _TAG.sub(" ", text)).casefold()
    return " ".join(re.findall(r"[^\W_]+", t))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = unicodedata.normalize("NFKC", _TAG.sub(" ", _THINK.sub(" ", answer))).strip().casefold()
    bare = re.sub(r"[^\w/ ]+", "", t).strip(" _/")
    return not bare or bare in STAND_INS


@cache
def _alone() -> tuple[zstandard.ZstdCompressor, int]:
    """A compressor without a dictionary, and the size of nothing."""
    c = zstandard.ZstdCompressor(level=9, write_content_size=False)
    return c, len(c.compress(b""))


def copy_cost(question: str, answer: str) -> float:
    """Compressed size of the answer given its question, against its size without; 0 means nothing but the question."""
    q, a = _plain(question).encode(), _plain(answer).encode()
    if not q or not a:
        return 1.0
    given = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    alone, base = _alone()
    return max(0, len(given.compress(a)) - base) / max(1, len(alone.compress(a)) - base)


#: Up to this share of its bytes left under the question's dictionary, an answer is looked at as a copy.
COPY_SHARE = 0.55


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question: the dictionary explains the answer, and hardly a word in it is new."""
    if not question:
        return False
    stripped = _LEAD.sub("", answer)
    if copy_cost(question, stripped) > COPY_SHARE:
        return False
    q, a = _plain(_LEAD.sub("", question)).split(), _plain(stripped).split()
    if not a or not q:
        return False
    known = set(q)
    fresh = sum(w not in known for w in a)
    covered = len(known & set(a))
    return fresh <= max(1, 0.15 * len(a)) and covered >= 0.7 * len(known) and len(a) >= 0.6 * len(q)


_CLOSERS = "\"'»”’)]*_`"
#: A context is complete where lines end in it at least so often for every time that text goes on behind it.
ENDS_TO_INSIDE = 0.25


def context(text: str, entry: bool) -> str:
    """How a text stands at its end: in an entry of a list or not, closed by quotes or brackets or not, and the last mark, letter or digit."""
    bare = text.rstrip(_CLOSERS)
    last = bare[-1:] or text[-1:]
    kind = "letter" if last.isalpha() else "digit" if last.isdigit() else last
    return f"{'entry' if entry else 'plain'} {'closed' if len(bare) < len(text) else 'open'} {kind}"


#: What is known before any text is seen: as so many ends and so many places inside.
_BEFORE = {f"{line} {state} {mark}": (4, 0) for line in ("entry", "plain") for state in ("open", "closed") for mark in ".!?…"}


@dataclass
class EndModel:
    """Terminal contexts: how often lines end in them and how often text goes on; and the same for the last words of list entries."""

    ends: dict[str, int]
    inside: dict[str, int]
    contexts: dict[str, tuple[int, int]] = field(default_factory=dict)

    def complete(self, entry: str) -> bool:
        words = WORD.findall(entry)
        if not words or not entry[-1].isalpha():
            return True
        w = words[-1].lower()
        e, i = self.ends.get(w, 0), self.inside.get(w, 0)
        if e or i:
            return e > 0.02 * i
        return words[-1][0].isupper() and len(words) > 1 and len(w) > 3

    def ended(self, text: str, entry: bool) -> bool:
        """Whether a text may end as it does; contexts never met are complete for closing marks alone."""
        c = context(text, entry)
        (a, b), (e, i) = self.contexts.get(c, (0, 0)), _BEFORE.get(c, (0, 1))
        return a + e > ENDS_TO_INSIDE * (b + i)


def is_truncated(answer: str, ends: EndModel) -> bool:
    t = answer.rstrip().rstrip("\u200b\ufeff").rstrip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    line = t.rsplit("\n", 1)[-1]
    m = _ENTRY.match(line)
    body = m[1].rstrip() if m else line
    if not body:
        return True
    if m and (body[-1].isalpha() or body[-1] == ";"):
        return not (body[-1] == ";" or ends.complete(body))  # words tell more than the letter does
    return not ends.ended(body, bool(m))


def context_counts(answers: list[str | None]) -> dict[str, list[int]]:
    """By context how often a line but the last ends in it, and how often small letters follow it inside a line."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for a in answers:
        lines = _FENCE.sub("", _THINK.sub(" ", a or "")).split("\n")
        for k, line in enumerate(lines):
            m = _ENTRY.match(line)
            body = (m[1] if m else line).strip()
            if not body:
                continue
            if any(x.strip() for x in lines[k + 1 :]):
                out[context(body, bool(m))][0] += 1
            for g in _GOES_ON.finditer(body):
                out[context(body[max(0, g.start() - 3) : g.start()], bool(m))][1] += 1
    return out


def _languages(model: LanguageModel, text: str) -> dict[str, float]:
    """Words of a text by language, over its sentences that tell one."""
    t = _FENCE.sub(" ", text)
    units = [WORD.findall(t[s:e]) for s, e in sentences(t)]
    units = [u for u in units if u]
    if not units:
        return {}
    sums = model.sums(units)
    lang, sure = model.decide(sums)
    out: dict[str, float] = {}
    for x, p, u, known in zip(lang, sure, units, sums[:, -1], strict=True):
        if x is not None and (p >= 0.6 or known >= 2):
            out[x] = out.get(x, 0) + len(u) * p
    return out


def asked_languages(*texts: str | None) -> set[str]:
    t = " ".join(x for x in texts if x).casefold()
    return {code for code, stems in LANGUAGE_STEMS.items() if any(s in t for s in stems)}


#: Share of an answer's words that must be in other languages than the question's.
OTHER_SHARE = 0.5


def is_other_language(question: str, answer: str, system: str | None, model: LanguageModel) -> bool:
    asked = asked_languages(question, system)
    a = _languages(model, answer)
    total = sum(a.values())
    if total < 3:
        return False
    q = _languages(model, question)
    if not q:
        return False
    own = max(q, key=q.get)
    other = total - a.get(own, 0)
    main = max(a, key=a.get)
    return other > OTHER_SHARE * total and main != own and main not in asked


def defect(question: str | None, answer: str | None, system: str | None, model: LanguageModel, ends: EndModel, cut: bool = False) -> str | None:
    """The defect of a pair or none, in the order of DEFECTS; cut tells that the record itself stops inside the answer."""
    if is_empty(answer):
        return "truncated_answer" if cut and answer and answer.strip() else "empty_answer"
    a = _THINK.sub(" ", answer).strip()
    q = question or ""
    if len(a.split()) <= REFUSAL_WORDS and _REFUSAL.search(a):
        return "refusal"
    if is_copy(q, a):
        return "copied_question"
    if is_other_language(q, a, system, model):
        return "other_language"
    return "truncated_answer" if cut or is_truncated(a, ends) else None


# --- pairs of chat lines and raw replies


def chat_pairs(messages: list[dict] | None) -> list[dict]:
    """One pair per user message: its content, the first assistant content before the next user message, the last system turn."""
    pairs, system = [], None
    for m in messages or []:
        role = (m or {}).get("role")
        if role == "system":
            system = m["content"]
        elif role == "user":
            pairs.append({"question": m["content"], "answer": None, "system": system, "cut": False, "open": True})
        elif role == "assistant" and pairs and pairs[-1].pop("open", False):
            pairs[-1]["answer"] = m["content"]
    return [{"pair_no": i, **{k: v for k, v in p.items() if k != "open"}} for i, p in enumerate(pairs, 1)]


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)(")?', re.S)
_KEY = re.compile(r'"(question|answer)"\s*:\s*')


def _unquote(body: str) -> str:
    body = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?\Z", "", body) if not body.endswith("\\\\") else body
    try:
        return json.loads(f'"{body}"', strict=False)
    except ValueError:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)


def raw_pairs(raw: str | None) -> list[dict]:
    """Pairs of a raw reply, however much text, fences or escapes stand around them and wherever it stops."""
    t = _THINK.sub(" ", raw or "")
    if '\\"question\\"' in t and '"question"' not in t.replace('\\"question\\"', ""):
        t = t.replace('\\\\', '\x00').replace('\\"', '"').replace("\\n", "\n").replace("\x00", "\\")
    found: list[dict] = []
    at = 0
    while m := _KEY.search(t, at):
        at = m.end()
        s = _STRING.match(t, at)
        if s:
            value, closed, at = _unquote(s[1]), s[2] is not None, s.end()
        else:
            v = re.match(r"[^,}\]]*", t[at:])[0].strip()
            value, closed = (None if v in ("null", "", "[]", "{}") else v), True
        if m[1] == "question":
            if closed:
                found.append({"question": value, "answer": None, "system": None, "cut": False})
        elif found and found[-1]["answer"] is None:
            found[-1] |= {"answer": value, "cut": not closed}
    return [{"pair_no": i, **p} for i, p in enumerate(found, 1)]


PAIR_DDL = "array<struct<pair_no:bigint,question:string,answer:string,system:string,cut:boolean>>"


_PAIRS = pa.list_(pa.struct([("pair_no", pa.int64()), ("question", pa.string()), ("answer", pa.string()), ("system", pa.string()), ("cut", pa.bool_())]))


def _exploded(df: DataFrame, kind: str, record: str, source: Column, split: Callable) -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([split(x) for x in b.to_pylist()], _PAIRS)

    rows = df.select(F.lit(kind).alias("record_kind"), F.col(f"`{record}`").cast("bigint").alias("record_no"), F.explode(F.arrow_udf(run, PAIR_DDL)(source)).alias("p"))
    return rows.select("record_kind", "record_no", "p.*")


def pairs_of_chats(df: DataFrame, record: str = "line_id", messages: str = "messages") -> DataFrame:
    """Pairs of chat lines; a null array has none, a missing or null reply gives a null answer."""
    require(df, record, messages)
    return _exploded(df, "chatml_line", record, F.col(f"`{messages}`"), chat_pairs)


def pairs_of_raw(df: DataFrame, record: str = "sample_id", raw: str = "raw") -> DataFrame:
    """Pairs of raw replies; a null reply has none, a question that is cut itself makes no pair."""
    require(df, record, raw)
    return _exploded(df, "raw_sample", record, F.col(f"`{raw}`"), raw_pairs)


def fit_ends(pairs: DataFrame, least_share: float = 1e-6) -> EndModel:
    """Terminal contexts of all answers, and the words of all list entries but the last of each answer.

    Words rarer than least_share of all are left out, which bounds the model by 1 / least_share words at any size of the data.
    """
    lines = F.filter(F.split("answer", "\n"), lambda x: x.rlike(r"^\s*(?:[-*•–—]|\d{1,3}[.)])\s+\S"))
    kept = pairs.select(lines.alias("l")).filter(F.size("l") > 1).select(F.explode(F.slice("l", 1, F.size("l") - 1)).alias("e"))
    words = kept.select(F.filter(F.split(F.lower("e"), r"[^\p{L}'’]+"), lambda x: F.length(x) > 0).alias("w")).filter(F.size("w") > 0)
    rows = words.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("n")).groupBy("word")
    rows = rows.agg(F.sum((F.col("i") == F.col("n") - 1).cast("int")).alias("ends"), F.sum((F.col("i") < F.col("n") - 1).cast("int")).alias("inside"))
    rows = cut(rows.filter(F.col("ends") + F.col("inside") >= 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = context_counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([x[0] for x in c.values()], pa.int64()), pa.array([x[1] for x in c.values()], pa.int64())], ["context", "ends", "inside"])

    met = pairs.select("answer").mapInArrow(count, "context string, ends bigint, inside bigint").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))
    contexts = {r.context: (r.ends, r.inside) for r in bounded_collect(met.filter("ends + inside >= 5"), MOST_CONTEXTS, "the table of terminal contexts")}
    total = rows.agg(F.sum(F.col("ends") + F.col("inside"))).first()[0] or 0
    got = rows.filter(F.col("ends") + F.col("inside") >= least_share * total).collect()
    return EndModel({r.word: r.ends for r in got if r.ends}, {r.word: r.inside for r in got if r.inside}, contexts)


def defects(pairs: DataFrame, model: LanguageModel, ends: EndModel) -> DataFrame:
    """The pairs with the column defect: one of DEFECTS, or null. Null and empty answers are empty_answer; a null
    question is an empty one. Repeated pairs stay repeated. No shuffle."""
    require(pairs, "question", "answer", "system", "cut")
    models = pairs.sparkSession.sparkContext.broadcast((model, ends))  # both bounded by their parameters

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for q, a, s, c in batches:
            rows = zip(q.to_pylist(), a.to_pylist(), s.to_pylist(), c.to_pylist(), strict=True)
            yield pa.array([defect(*r[:3], *models.value, bool(r[3])) for r in rows], pa.string())

    return pairs.withColumn("defect", F.arrow_udf(run, "string")("question", "answer", "system", "cut"))
