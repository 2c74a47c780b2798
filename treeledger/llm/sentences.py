"""Sentence units of documents in many languages and scripts.

Blocks come first: blank lines, headings, list items and fenced code part a text. Inside a
block every final mark, every quotation or bracket that holds one at its end, and every
space between Thai letters is a candidate. Ordered pairs of regular expressions, one for
the unit so far and one for what follows, decide it: tables for quotations, pauses, each language's
abbreviations, ends of lists and dates form a cascade, and the first pair that matches says
break or no break. As labels are often wrong and texts mixed, the languages of a place are
those of the script of its last letter. Text whose UTF-8 was read as Latin-1 is repaired
for the rules, and offsets are told in the text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.session import read_table

# Marks, brackets, abbreviations and month names.
_MARK = ".!?…‽。！？｡।॥؟۔"
_FULL = "。！？｡।॥؟۔"
_CLOSE = "\"'”’“»›）)」』】\\]"
#: Without marks that open as well.
_CLOSE_ONLY = "\"'”’»›）)」』】\\]"
_CJK = r"぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_THAI = r"ก-๎"
_W = r"(?:\s|(?<=\n)>)"
_LOWER = r"[a-zß-öø-ÿа-яё]"
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez"
#: Never the end of a sentence.
_TITLES = {
    "en": r"e\.\s?g|i\.\s?e|cf|approx|viz|vs|incl|resp|Mr|Mrs|Ms|Dr|Prof|Rev|Gen|Sen|Gov|Capt|Lt|St",
    "de": r"z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?[äg]|i\.\s?d\.\s?R|z\.\s?T|ca|bzw|vgl|sog|evtl|ggf|inkl|zzgl|Hr|Fr|Dipl",
    "fr": r"c\.-\s?à-\s?d|p\.\s?ex|env|MM|Mme|Mlle|chap|éd",
    "es": r"p\.\s?ej|aprox|Sr|Sra|Srta|Dra|Uds?|EE|p\.\s?e",
    "ru": r"т\.\s?е|т\.\s?н|т\.\s?к|ок|напр|им|[Сс]м|[Сс]р|проф|акад",
    "hi": r"डॉ|प्रो|श्री|सं",
}
#: Not the end of a sentence before a number.
_NUMBERED = {
    "en": r"Nos?|Secs?|Sect|Figs?|Eqs?|Chs?|Tab|Vol|Art|Ver|Pt|p|pp|no|sec|fig|vol|art",
    "de": r"Nr|Abs|Abb|Kap|Bd|S|Art|Ziff",
    "fr": r"art|fig|chap|vol|n",
    "es": r"págs?|art|núm|cap|fig",
    "ru": r"рис|стр|гл|разд|табл|п|пп|ст|с|Рис|Стр|Гл|Табл",
}
#: Closed word classes. Prepositions and conjunctions carry a sentence on behind "etc." and the like, unless they open a clause of their own.
_PREPOSITIONS = {
    "en": r"in|without|under|on|by|at|of|to|with|from|for|during|across|between|over|through|into|about",
    "de": r"in|im|ins|ohne|unter|auf|an|am|bei|beim|mit|von|vom|für|zu|zum|zur|aus|über|durch|gegen|vor|nach|seit|während|zwischen",
    "fr": r"en|dans|sans|sous|sur|par|à|au|aux|de|du|des|d|avec|pour|chez|vers|entre|depuis|pendant|avant|après|dès",
    "es": r"en|sin|bajo|sobre|por|a|al|de|del|con|para|hacia|hasta|entre|desde|durante|antes|tras|según",
    "ru": r"в|во|на|без|под|по|от|до|из|с|со|к|ко|для|при|через|между|после|перед|начиная|над|о|об|у|за",
}
_CONJUNCTIONS = r"and|or|but|nor|und|oder|aber|sowie|sondern|et|ou|mais|ni|y|e|o|u|pero|и|или|но|а"
_SUBORDINATORS = r"if|when|whenever|while|because|unless|although|though|once|wenn|falls|sobald|weil|obwohl|solange|si|quand|lorsque|parce|quoique|puisque|cuando|mientras|porque|aunque|если|когда|пока|хотя"
#: These stand before a noun as well.
_DOUBLE = r"as|since|before|after|until|till|als|wie|bevor|nachdem|bis|comme|como|как"
_BE = r"are|is|were|was|sind|ist|waren|war|sont|est|son|es"
_ON = "|".join((*_PREPOSITIONS.values(), _CONJUNCTIONS, _SUBORDINATORS, _DOUBLE, _BE))
_DETERMINERS = r"the|an?|this|that|these|those|its|our|your|their|his|her|my|some|any|no|each|every|all|most|both|many|few|several|such"
_PRONOUNS = r"it|we|they|he|she|you|there|one|who|what|which"
_ADVERBS = r"here|then|now|never|not|thus|hence|also|why|how|where|so|yet|only|always|often"
_WORD = r"[^\W\d_]+"
#: A capital that starts an English sentence: a word of a closed class, or one that a determiner, a code name or a numbered reference follows, as a command has it.
_STARTS = rf"(?!No\.)(?=[A-Z])(?:(?i:{_DETERMINERS}|{_PRONOUNS}|{_ADVERBS}|{_PREPOSITIONS['en']}|{_SUBORDINATORS}|{_DOUBLE}|and|or|but)\b|\w+{_W}+(?:(?:{_DETERMINERS}|{_PRONOUNS})\b|[`\"“]|\S*\w[._/]\w|(?:{'|'.join(_NUMBERED.values())})\.{_W}*\d))"
#: The end of a list.
_LISTED = r"(?:\b(?:etc|usw|ff)\.|и\s+т\.\s?[дп]\.|и\s+др\.)"
_INSIDE = r"(?:[^.!?…,;:。！？]|[.:,](?=\w))"
#: A short phrase before a colon, and a clause that a comma parts from its main clause: both open a sentence.
_HEADED = rf"(?!(?:as|like|namely|including|such|wie|nämlich|comme|como|как){_W})(?:{_WORD}{_W}+){{0,2}}{_WORD}:{_W}"
_CLAUSE = rf"{_W}+{_INSIDE}*{_W}{_INSIDE}*,{_W}+(?!(?:{_CONJUNCTIONS})\b)"
#: Phrases in front of a subject (English) or of a finite verb (German).
_FRONTED = rf"(?:{_PREPOSITIONS['en']}){_W}+(?:(?:{_DETERMINERS}){_W}+)?(?:(?!(?:{_ON}|all|both|half)\b|\w+ing\b){_WORD}{_W}+){{1,2}}(?:{_DETERMINERS}|{_PRONOUNS})\b|(?:{_PREPOSITIONS['de']}){_W}+(?:{_LOWER}+{_W}+){{0,2}}[A-ZÄÖÜ]\w+{_W}+(?!(?:{_ON})\b){_LOWER}+(?:t|en|ist|sind){_W}+\w"

_QUOTED = rf"[:：]{_W}*(?:\"[^\"]*|“[^”]*|„[^“”]*|«[^»]*|「[^」]*|『[^』]*|'[^']*)"


#: Longer than any abbreviation with the marks and spaces in it.
WORD_REACH = 48


class Rule:
    """Whether to break between a unit that matches ``before`` at its end and a text that starts with ``after``.

    ``small`` limits a rule to texts that start sentences with small letters (True) or to
    others (False). ``word`` rules match the last word of a unit, others may look at all of it.
    """

    __slots__ = ("breaks", "before", "after", "small", "word")

    def __init__(self, breaks: bool, before: str, after: str = "", small: bool | None = None, word: bool = False):
        self.breaks, self.small, self.word = breaks, small, word
        self.before = re.compile(f"(?:{before})\\Z", re.S).search if before else None
        self.after = re.compile(after, re.S).match if after else None


_START = r"\A(?:>\s*)?(?:[-*]\s+|\d+\.\s+)?"

#: Candidates behind a closing quotation mark or bracket.
GROUP_RULES = (
    Rule(False, rf"{_QUOTED}[?!]+\s?[{_CLOSE}]+", rf"{_W}+(?:and|or|but|then|und|oder|et|ou|y|o|и|а)\b"),
    Rule(True, rf"{_QUOTED}[{_MARK}]+\s?[{_CLOSE}]+", rf"(?!{_W}*[,;])"),
    Rule(True, rf"{_START}[(（\[].*[{_MARK}][{_CLOSE}]*[)）\]]", rf"(?={_W}|[{_CJK}“「『（])"),
    Rule(False, r"[)）\]]"),
    Rule(False, "", rf"{_W}*[,;:—–-]"),
    Rule(False, "", rf"{_W}+{_LOWER}"),
    Rule(False, "", rf"[^\s{_CLOSE}]"),
    Rule(True, ""),
)

# Candidates behind final marks, table by table.
PAUSES = (
    Rule(False, rf"[{_CJK}]…+"),
    Rule(False, rf"{_START}\S+(?:…|\.\.\.)", rf"{_W}+[^\s{_UPPER[1:-1]}]"),
    Rule(False, rf"{_START}{_UPPER}.*(?:…|\.\.\.)", rf"{_W}+{_LOWER}+\b(?![\w.`(])"),
    # speech that goes on behind a dash, marks before other stops
    Rule(False, "", rf"{_W}+[—–-]\s?{_LOWER}"),
    Rule(False, "", r"\s*[,;:](?!\S)"),
    # markers of list items and bare numbers of quoted lists
    Rule(False, r"\A(?:>\s*)?\d+\."),
)


def _abbreviations(language: str) -> tuple[Rule, ...]:
    """Words that never end a sentence, and those that do not before a number."""
    rules = (Rule(False, rf"(?:^|[\s(>«„“\"'/-])(?:{_TITLES[language]})\.", word=True),)
    return rules + ((Rule(False, rf"(?:^|[\s(>«„“\"'])(?:{_NUMBERED[language]})\.", rf"{_W}*\d"),) if language in _NUMBERED else ())


def _halves(first: str, second: str) -> Rule:
    """Between the halves of an abbreviation of two words."""
    return Rule(False, rf"(?:^|[\s(>])(?:{first})\.", rf"{_W}?(?:{second})\.", word=True)


LANGUAGES = {
    "en": (
        *_abbreviations("en"), _halves("e|i", "e|g"),
        Rule(False, r"\b(?:[A-Z]\.){2,}", rf"{_W}+(?!{_STARTS})\w", word=True),
        Rule(False, r"\d\s?[aApP]\.\s?[mM]\.", rf"{_W}+(?:[A-Z]{{2,5}}\b|and\b|or\b|to\b|until\b)", word=True),
    ),
    "de": (*_abbreviations("de"), _halves("z|d|o|u|i", "B|h|a|ä|T|d|g|R"), Rule(False, r"(?:^|\D)\d{1,2}\.", rf"{_W}+(?:{_MONTHS})\b", word=True)),
    "fr": (*_abbreviations("fr"), _halves("p", "ex")),
    "es": (*_abbreviations("es"), _halves("EE?|p", "UU|ej|e"), Rule(False, r"\bEE\.\s?UU\.", rf"{_W}+{_LOWER}", word=True)),
    "ru": (*_abbreviations("ru"), _halves("т|р|и", "е|к|н|д|п")),
    "hi": _abbreviations("hi"),
}

#: On where a small letter follows, unless it opens a clause or the text starts its sentences small.
LIST_ENDS = (
    Rule(True, _LISTED, rf"{_W}+(?:{_HEADED}|(?:{_SUBORDINATORS}){_CLAUSE})"),
    Rule(True, _LISTED, rf"{_W}+(?:(?:{_DOUBLE}){_CLAUSE}|{_FRONTED})", small=True),
    Rule(False, _LISTED, rf"{_W}+(?:{_ON})\b(?![.(]\w)"),
    Rule(False, _LISTED, rf"{_W}+{_LOWER}+(?![\w.]*[A-Z(.]\w)", small=False),
)
#: Full stops of scripts without spaces end a sentence wherever they stand, others before white space.
ENDS = (
    Rule(True, rf"[{_FULL}][{_MARK}]*[{_CLOSE}]*"),
    Rule(True, "", rf"{_W}|\Z"),
    Rule(False, ""),
)


def _cascade(*languages: str) -> tuple[Rule, ...]:
    return (*PAUSES, *(rule for language in languages for rule in LANGUAGES[language]), *LIST_ENDS, *ENDS)


MARK_RULES = _cascade(*LANGUAGES)
#: The cascade of each script; elsewhere, as behind a digit, all languages count.
SCRIPTS = ((re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿĀ-ſ]"), _cascade("en", "de", "fr", "es")), (re.compile(r"[Ѐ-ӿ]"), _cascade("ru")), (re.compile(r"[ऀ-ॿ]"), _cascade("hi")), (re.compile(rf"[{_CJK}{_THAI}؀-ۿ]"), _cascade()))


@lru_cache(4096)
def _rules_behind(letter: str) -> tuple[Rule, ...]:
    return next((rules for script, rules in SCRIPTS if script.match(letter)), MARK_RULES)


_TOKENS = rf"""(?P<code>`[^`\n]*`)
    |(?P<group>“[^”]*”|„[^“”]*[“”]|«[^«»]*»|「[^」]*」|『[^』]*』|"[^"]*"|(?<!\w)'[^'\s][^']*'(?!\w)|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）)
    |(?P<mark>[{_MARK}]+[{_CLOSE_ONLY}]*)
    |(?P<thai>(?<=[{_THAI}])[ ]+(?=[{_THAI}]))"""
_CANDIDATE = re.compile(_TOKENS, re.X)
#: In the last block of a text that is cut off, a quotation or bracket may stay open to the end.
_LAST_CANDIDATE = re.compile(_TOKENS + r"""|(?P<open>“[^”]*\Z|„[^“”]*\Z|«[^«»]*\Z|「[^」]*\Z|（[^（）]*\Z|(?:(?<=\s)|(?<=:)|\A)"(?=\S)[^"]*\Z)""", re.X)
_GROUP_END = re.compile(rf"[{_MARK}][{_CLOSE}\s]*\Z")
_SMALL_START = re.compile(rf"(?:>\s*)?(?:[-*]\s+|\d+\.\s+)?{_LOWER}+\s")
_SMALL_ELSEWHERE = re.compile(rf"[^\W\d_]{{5}}(?<!pprox)(?<!aprox)[.!?][ \n]+{_LOWER}+\s")
_LINE = re.compile(r"[^\n]*\n?")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_ITEM = re.compile(r"(?:[-*]|\d+\.)\s")
#: From this length on the middle of a unit is left out: rules look at its start, at the last quotation or marks, and at what lies close before them.
_LONG, _NEAR = 4000, 400
#: The marker of a unit and its first words.
_HEAD = re.compile(r"(?:\S*\s+){0,4}\S*")


@lru_cache(1)
def _head(text: str, begin: int) -> int:
    return _HEAD.match(text, begin).end()


def _unit(text: str, begin: int, at: int, end: int) -> str:
    """The unit as far as rules can tell: all of it, or of a long one its first words and the part around its last candidate."""
    if end - begin <= _LONG:
        return text[begin:end]
    near = at - _NEAR
    while near > begin and not text[near].isspace():
        near -= 1
    while near > begin and text[near].isspace():
        near -= 1
    head = _head(text, begin)
    return text[begin:head] + " " + text[near:end] if head < near else text[begin:end]


def _decide(rules: tuple[Rule, ...], text: str, begin: int, end: int, stop: int, at: int) -> bool:
    """Outcome of the rules for a unit of ``text`` from ``begin`` to ``end``, whose last candidate starts at ``at``, in a block that ends at ``stop``."""
    unit = _unit(text, begin, at, end)
    word = max(0, len(unit) - WORD_REACH)
    for rule in rules:
        if rule.after and not rule.after(text, end, stop) or rule.before and not rule.before(unit, word if rule.word else 0):
            continue
        if rule.small is None or rule.small == _small(text, begin):
            return rule.breaks
    return False


def _small(text: str, begin: int) -> bool:
    """Whether the unit, or another sentence of the text behind a word of five letters or more, starts with a small letter."""
    return bool(_SMALL_START.match(text, begin)) or _starts_small(text)


@lru_cache(1)
def _starts_small(text: str) -> bool:
    return bool(_SMALL_ELSEWHERE.search(text))


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of paragraphs, list items, headings and fences; ``whole`` ones are single units."""
    start, fence, first = -1, -1, True
    for m in _LINE.finditer(text):
        line = m.group().lstrip() if first else m.group()
        if fence >= 0:
            if line.startswith("```"):
                yield fence, m.end(), True
                fence = -1
            continue
        if not line.strip():
            if start >= 0:
                yield start, m.start(), False
            start = -1
            continue
        first = False
        special = line.startswith("```") or _HEADING.match(line)
        if (special or _ITEM.match(line)) and start >= 0:
            yield start, m.start(), False
            start = -1
        if line.startswith("```"):
            fence = m.start()
        elif special:
            yield m.start(), m.end(), True
        elif start < 0:
            start = m.start()
    if fence >= 0:
        yield fence, len(text), True
    elif start >= 0:
        yield start, len(text), False


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _latin_bytes() -> dict[str, int]:
    """Characters that bytes from 0x80 on become when they are read as Latin-1 or as its Windows form."""
    windows = {bytes([b]).decode("cp1252", "ignore"): b for b in range(0x80, 0xA0)}
    return {chr(b): b for b in range(0x80, 0x100)} | {c: b for c, b in windows.items() if c}


_BYTES = _latin_bytes()
_CONTINUED = "".join(re.escape(c) for c, b in _BYTES.items() if b < 0xC0)
#: UTF-8 of one character beyond ASCII, read as Latin-1.
_LEAD = re.compile(rf"[Â-ô][{_CONTINUED}]")
_MISREAD = re.compile(rf"[Â-ß][{_CONTINUED}]|[à-ï][{_CONTINUED}]{{2}}|[ð-ô][{_CONTINUED}]{{3}}")


def _repaired(text: str) -> tuple[str, list[int]]:
    """The text with misread characters made whole, and the place in ``text`` of each of its places.

    White space is left as it stands, as units must hold the characters that it was read as.
    """
    pieces, places, done = [], [], 0
    for m in _MISREAD.finditer(text):
        try:
            whole = bytes(_BYTES[c] for c in m.group()).decode()
        except UnicodeDecodeError:
            continue
        if whole.isspace():
            continue
        pieces += (text[done : m.start()], whole)
        places += (*range(done, m.start()), m.start())
        done = m.end()
    return "".join((*pieces, text[done:])), [*places, *range(done, len(text) + 1)]


def sentence_units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in code points; none for a blank text."""
    if text.isascii() or not _LEAD.search(text):
        return _cut(text)
    whole, places = _repaired(text)
    units = (_trimmed(text, places[a], places[b]) for a, b in _cut(whole))
    return [(a, b) for a, b in units if a < b]


def _cut(text: str) -> list[tuple[int, int]]:
    """The units of a text without misread characters."""
    out = []
    last = len(text.rstrip())
    for begin, stop, whole in _blocks(text):
        begin, stop = _trimmed(text, begin, stop)
        if begin == stop:
            continue
        if not whole:
            for m in (_LAST_CANDIDATE if stop == last else _CANDIDATE).finditer(text, begin, stop):
                end = m.end()
                kind = m.lastgroup
                if kind == "code" or end >= stop:
                    continue
                if kind == "thai":
                    out.append((begin, m.start()))
                    begin = end
                    continue
                if kind == "group" and not _GROUP_END.search(m.group()[1:-1]):
                    continue
                sure = _plain(m.group(), text, begin, m.start(), end, stop) if kind == "mark" else None
                if sure is False:
                    continue
                if sure:
                    out.append((begin, end))
                    begin = _trimmed(text, end, stop)[0]
                    continue
                if _decide(GROUP_RULES if kind == "group" else _rules_behind(text[m.start() - 1]), text, begin, end, stop, m.start()):
                    out.append((begin, end))
                    begin = _trimmed(text, end, stop)[0]
        if begin < stop:
            out.append((begin, stop))
    return out


def _plain(mark: str, text: str, begin: int, at: int, end: int, stop: int) -> bool | None:
    """Outcome of MARK_RULES for the common candidates, without trying them; None for the others.

    Marks inside a word never end a unit, full stops of scripts without spaces always do, and
    a word of seven letters or more is no abbreviation of any table.
    """
    after = text[end]
    if mark[-1] in _FULL:
        return None if after.isspace() or after in ",;:" or "…" in mark else True
    if not after.isspace():
        return None if after in ",;:>" or mark[-1] not in _MARK or any(c in _FULL for c in mark) else False
    if len(mark) > 1 or mark == "…" or at - begin < 8:
        return None
    follows = text[end + 1]
    if follows.isspace() or follows in "—–-,;:>" or end + 1 >= stop:
        return None
    return True if text[at - 7 : at].isalpha() else None


_UNITS = T.ArrayType(T.StructType([T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType())]))


@F.pandas_udf(_UNITS)
def units_of(texts: pd.Series) -> pd.Series:
    return pd.Series([sentence_units(t) if t else [] for t in texts])


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_start, sent_end) of each unit of each row's text.

    Offsets are code points from 0, the end exclusive. Null, empty and blank texts give no
    rows; repeated rows repeat theirs; other columns are ignored; texts are read whole.
    """
    return documents.select(key, F.explode(units_of(F.col(text))).alias("u")).select(key, "u.sent_start", "u.sent_end")


def p8_found(spark, folder: str) -> DataFrame:
    return sentences(read_table(spark, folder, "documents").select("doc_id", "text"))


def p8_lengths(spark, folder: str) -> DataFrame:
    """Units and their mean length per language label."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    n = F.col("u.sent_end") - F.col("u.sent_start")
    return documents.select("lang", F.explode(units_of("text")).alias("u")).groupBy("lang").agg(F.count("*").alias("n_units"), F.round(F.avg(n), 3).alias("mean_length"))
