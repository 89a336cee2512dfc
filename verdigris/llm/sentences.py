"""Sentence boundaries of texts in any language and script.

The standard's sentence-break rules over the characters' sentence-break properties say where a sentence can end, for the terminators of all scripts.
On top come suppression of the abbreviations of the text's language, initials, ordinals and numbers, quotations with their reporting clauses, bracketed
remarks, and scripts that end sentences otherwise. Every step goes once over the text, so the time grows with its length.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from verdigris.llm.abbreviations import BEFORE_NUMBER, CASELESS, FUNCTION_WORDS, MAY_END, NEVER_ENDS, ORDINAL_AFTER, ORDINAL_BEFORE, REPORTING, SUFFIXES

_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\u0085\u2028])[^\S\n\r]*(?:(?:\r\n|[\n\r\u0085\u2028])\s*)|\u2029\s*")
_OPEN_QUOTES, _CLOSE_QUOTES = "“„«「『‟〝", "”«»“」』〞"
_PAIRS = {"“": "”", "„": "“”", "‟": "”", "«": "»", "「": "」", "『": "』", "〝": "〞〟"}
_BRACKETS = {"(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "〔": "〕", "{": "}"}
_OPENED_BY = {closer: [o for o, cs in (_PAIRS | _BRACKETS).items() if closer in cs] for closer in {c for cs in (_PAIRS | _BRACKETS).values() for c in cs}}
_PAIRED = regex.compile("[" + regex.escape("".join({*_PAIRS, *_BRACKETS, *_OPENED_BY}), special_only=False) + "]")
_CLOSERS = "”»」』〞〟\"')]）］】〕}’›"
#: Everything at which something may begin or end: terminators of all scripts (SATerm), ellipses, quotes, brackets, the Thai courtesy words.
_MARK = regex.compile(
    r"(?P<thai>ครับ|ค่ะ|คะ(?=\s|$))|(?P<end>[\p{SB=STerm}\p{SB=ATerm}…⋯;؛]+)|(?P<open>[“„«‟「『〝\"(\[（［【〔{])"
)
_TERMINATORS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}]+")


def _having(characters: str) -> frozenset[str]:
    """The characters of a class in the basic plane, where all those of the classes asked for are."""
    return frozenset(regex.findall(characters, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), regex.VERSION1))


#: Rule SB6: a full stop before a digit is within a number.
_NUMERIC = _having(r"\p{SB=Numeric}")
#: Rule SB8: after a full stop a lower-case letter goes on, whatever stands between that is neither letter nor terminator.
_LOWER = _having(r"\p{SB=Lower}")
#: Rule SB8a: commas and the like go on; dashes are judged by what follows them.
_CONTINUES = _having(r"[\p{SB=SContinue};·؛―--[—–]]")
#: Matched backwards from a full stop.
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.\-’']+")
_NEXT = regex.compile(r"[\s\p{SB=Close}¿¡—–―\-]*")
_NEXT_ABBREVIATION = regex.compile(r"(\p{L}+)\.")
_LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")
_CASED = regex.compile(r"[\p{Lu}\p{Lt}\p{Ll}]")
_JAPANESE_RUN_ON = regex.compile(r"\s*(?:と|って|という|の(?!で)|は|が|を|に|も|など|とか|や|へ)")
_ARABIC_RUN_ON = regex.compile(r"\s*[وف]\p{L}{2}")
_CHINESE_REPORT = regex.compile(r"[^。！？：“”\n]{1,30}(?:说|問|问|道|表示|答|喊|指出|认为|回应|强调|補充|补充|写道)(?=[。，！])")
_KANA_OR_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_REPORT_AFTER = regex.compile(r"\s*((?:[\p{L}\p{M}.’'\-]+\s+){1,7})")
_GREEK_BEFORE = regex.compile(r"\p{Greek}\W*$")
_ENDS_REMARK = regex.compile(r"[.!?…。！？।؟]\s*.$")


def abbreviations_of(text: str) -> frozenset[str]:
    """Abbreviations that never end a sentence, of the text's language: for the Latin script the one of whose frequent words it has most, of all languages
    that tie; those of other scripts cannot be confused and always count.
    """
    words = set(text.lower().split())
    scores = {language: len(known & words) for language, known in FUNCTION_WORDS.items()}
    best = max(scores.values())
    chosen = [language for language, score in scores.items() if score == best]
    return _SHARED.union(*[NEVER_ENDS[language] for language in chosen]) if len(chosen) > 1 else _BY_LANGUAGE[chosen[0]]


_SHARED = NEVER_ENDS["ru"] | NEVER_ENDS["el"]
_BY_LANGUAGE = {language: NEVER_ENDS[language] | _SHARED for language in FUNCTION_WORDS}


class _Text:
    """A text with what is found in it once: the closing marks of its opening marks within a block, the next letter from a place on."""

    def __init__(self, text: str):
        self.text = text
        self.never = None
        self._closed: dict[int, int] = {}
        self._letter_from = self._letter_at = -1

    def abbreviations(self) -> frozenset[str]:
        if self.never is None:
            self.never = abbreviations_of(self.text)
        return self.never

    def scan(self, start: int, stop: int) -> None:
        """Pairs the marks of a block, each kind by a stack of its own."""
        self._closed = {}
        self._letter_from = -1
        stacks: dict[str, list[int]] = {}
        for m in _PAIRED.finditer(self.text, start, stop):
            mark, at = m.group(), m.start()
            for opener in _OPENED_BY.get(mark, ()):
                if stack := stacks.get(opener):
                    self._closed[stack.pop()] = at + 1
            if mark in _PAIRS or mark in _BRACKETS:
                stacks.setdefault(mark, []).append(at)

    def closing(self, at: int, stop: int) -> int:
        """Position after the mark that closes the one at `at`, or -1. Inner pairs of the same kind are counted."""
        if self.text[at] == '"':
            return self.text.find('"', at + 1, stop) + 1 or -1
        return self._closed.get(at, -1)

    def letter_from(self, at: int, stop: int) -> int:
        """Position of the first letter or digit from `at` on, `stop` if there is none."""
        if not self._letter_from <= at <= self._letter_at or self._letter_from < 0:
            m = _LETTER_OR_DIGIT.search(self.text, at, stop)
            self._letter_from, self._letter_at = at, m.start() if m else stop
        return self._letter_at


def _ends_inside(text: str, start: int, stop: int) -> bool:
    """Whether the quoted text just before the closing mark at stop - 1 ends with a terminator."""
    at = stop - 2
    while at >= start and text[at].isspace():
        at -= 1
    if at < start:
        return False
    last = text[at]
    return last == "…" or bool(_TERMINATORS.match(last)) or (last == ";" and bool(regex.search(r"\p{Greek}", text[max(start, at - 64) : at])))


def _next_letter(t: _Text, at: int, stop: int) -> tuple[str, int]:
    """The next letter or digit after spaces, opening marks and whole bracketed remarks."""
    text = t.text
    while at < stop:
        at = _NEXT.match(text, at, stop).end()
        if at < stop and text[at] in _BRACKETS and (past := t.closing(at, stop)) > 0:
            at = past
            continue
        break
    at = t.letter_from(at, stop)
    return (text[at], at) if at < stop else ("", stop)


def _after(text: str, at: int, stop: int) -> int:
    """Position of the next character that is no white space."""
    while at < stop and text[at].isspace():
        at += 1
    return at


def _stop_ends(t: _Text, start: int, at: int, end: int, stop: int) -> bool:
    """Whether the single full stop at `at` (closing marks up to `end`) ends the sentence that began at `start`."""
    text = t.text
    following = _after(text, end, stop)
    if following >= stop:
        return True
    after = text[following]
    spaced = following > end
    word = m.group() if (m := _WORD_BEFORE.match(text, max(start, at - 24), at)) else ""
    # An elided article is no part of the word: l’art.
    bare = word.lower().strip("-'’.").replace("’", "'").rpartition("'")[2]
    letter, where = (after, following) if after.isalnum() else _next_letter(t, following, stop)
    if not word:
        return True
    if not spaced and end == at + 1:
        # Without a space: a number (SB6) or an abbreviation (SB7, SB8) goes on, unless a word ends and a capital follows.
        if after in _NUMERIC or after.isdigit() or after.islower() or after in ".-_/@":
            return False
        if not after.isalnum():
            return after in _OPEN_QUOTES or after in _BRACKETS
        last = word[-1]
        if after.isupper():
            return (last.islower() and bare not in t.abbreviations() and len(bare) > 1) or last.isdigit()
        return bool(_KANA_OR_HAN.match(after)) is False and len(bare) > 2 and bare not in CASELESS
    if after in _CONTINUES:
        return False
    if letter in _LOWER and after not in _OPEN_QUOTES and after != '"':
        return False
    if after in "—–―" and letter.islower():
        return False
    digits_next = letter.isdigit() and where == following
    never = t.abbreviations()
    if word[-1].isdigit():
        return not _is_ordinal(text, start, at, word, where)
    if bare in CASELESS:
        return False
    if (m := _NEXT_ABBREVIATION.match(text, following, stop)) and m.group(1).lower() in SUFFIXES:
        return False
    if digits_next and (bare in BEFORE_NUMBER or bare in never):
        return False
    if bare in ("no",) and word[:1].isupper() and not digits_next:
        return True
    if bare in ("д", "п", "г", "гг", "в", "вв"):
        return _ends_phrase(text, start, at, word, bare)
    if bare in MAY_END and bare not in never:
        return True
    if bare in never:
        return False
    if len(bare) == 1:
        return not (word[-1].isupper() or bare.isalpha() and not word[-1].islower()) and not digits_next
    parts = word.split(".")
    if len(parts) > 1 and all(len(p) <= 2 for p in parts):
        return True
    return True


def _ends_phrase(text: str, start: int, at: int, word: str, bare: str) -> bool:
    """Cyrillic one-letter abbreviations: "и т. д." and the year "2020 г." may end a sentence, "г. Name" does not."""
    before = text[max(start, at - 16) : at - len(word)].rstrip()
    if bare in ("д", "п"):
        return before.endswith("т.")
    return before[-1:].isdigit() or before[-1:] in "IVXLC"


def _is_ordinal(text: str, start: int, at: int, word: str, where: int) -> bool:
    """German ordinals before a capital, and numbers that are all of the unit so far (list marks)."""
    if at - len(word) <= start:
        return True
    before = text[max(start, at - len(word) - 40) : at - len(word)].rstrip()
    if not word.isdigit() or len(word) > 3 or not text[where : where + 1].isupper():
        return False
    follower = regex.match(r"[\p{L}]+", text, pos=where)
    if follower and follower.group().lower() in ORDINAL_AFTER:
        return True
    previous = regex.search(r"[\p{L}]+$", before)
    return bool(previous) and previous.group() in ORDINAL_BEFORE or bool(previous) and previous.group() in {w.capitalize() for w in ("am", "im", "zum", "vom", "der", "die", "das", "beim")}


def _reporting_follows(t: _Text, end: int, stop: int) -> bool:
    """Whether a clause such as "Mr. X asked" follows a quotation."""
    m = _REPORT_AFTER.match(t.text, end, min(stop, end + 160))
    if not m:
        return False
    for word in m.group(1).split():
        bare = word.strip(".").lower()
        if bare in REPORTING:
            return True
        if not (word[0].isupper() or bare in t.abbreviations()):
            return False
    return False


def _mark_ends(t: _Text, start: int, at: int, marks: str, end: int, stop: int, quoted_from: int) -> bool:
    """Whether the run of marks at `at`, closing marks up to `end`, ends the sentence."""
    text = t.text
    following = _after(text, end, stop)
    if following >= stop:
        return True
    after = text[following]
    closed_quote = quoted_from >= 0
    if marks == "." and not closed_quote:
        return _stop_ends(t, start, at, end, stop)
    if not marks.strip(";؛"):
        return ";" in marks and bool(_GREEK_BEFORE.search(text[max(start, at - 8) : at])) and not (_next_letter(t, following, stop)[0] or "A").islower()
    if after in _CONTINUES:
        return False
    letter, _ = _next_letter(t, following, stop)
    if after in "—–―":
        return not letter.islower() and bool(_CASED.match(letter or "a")) and not closed_quote
    if letter in _LOWER and after not in _OPEN_QUOTES and after != '"':
        return False
    if not closed_quote and not marks.strip("….⋯") and len(marks.replace("…", "...")) >= 3:
        # An ellipsis ends only before what is plainly a new sentence.
        return letter.isupper() or after in _OPEN_QUOTES
    if closed_quote:
        introduced = start < quoted_from
        if _KANA_OR_HAN.match(after):
            if text[end - 1] in "」』":
                return not _JAPANESE_RUN_ON.match(text, end)
            return introduced or not _CHINESE_REPORT.match(text, end, stop)
        if introduced and _ARABIC_RUN_ON.match(text, end, stop):
            return False
        if not introduced and _reporting_follows(t, end, stop):
            return False
    return True


def _block_units(t: _Text, start: int, stop: int, add) -> None:
    """Adds the units of one block without blank lines."""
    text = t.text
    t.scan(start, stop)
    start = begin = _after(text, start, stop)
    at = start
    while at < stop:
        m = _MARK.search(text, at, stop)
        if not m:
            break
        at = m.start()
        kind = m.lastgroup
        if kind == "open":
            opener = text[at]
            past = t.closing(at, stop)
            if past < 0:
                at += 1
                continue
            if opener in _BRACKETS:
                if at == begin:
                    # A remark between sentences stands alone, unless the sentence plainly goes on behind it.
                    following = _after(text, past, stop)
                    next_char = text[following] if following < stop else ""
                    if not next_char or not (next_char.islower() or next_char in ",;:،、，；：.。!?！？।؟") or bool(_ENDS_REMARK.search(text[max(at, past - 8) : past])) and next_char not in ",;:،、，；：.。!?！？।؟" and not next_char.islower():
                        add(begin, past)
                        begin = at = following
                        continue
                at = past
                continue
            if _ends_inside(text, at + 1, past):
                marks_at = past - 2
                end = past
                while end < stop and text[end] in _CLOSERS:
                    end += 1
                if m2 := _TERMINATORS.match(text, end, stop):
                    end = m2.end()
                if _mark_ends(t, begin, marks_at, "!", end, stop, at):
                    add(begin, end)
                    begin = at = _after(text, end, stop)
                    continue
                at = end
                continue
            at = past
            continue
        end = m.end()
        while end < stop and text[end] in _CLOSERS and not (text[end] in "\"'’" and end + 1 < stop and (text[end + 1].isalnum())):
            end += 1
        if kind == "thai":
            following = _after(text, end, stop)
            if following >= stop or following > end or not text[end].isalpha():
                if m2 := _MARK.match(text, end, stop):
                    if m2.lastgroup == "end":
                        end = m2.end()
                add(begin, end)
                begin = at = _after(text, end, stop)
            else:
                at = m.end()
            continue
        # French and others put a space before the closing quotation mark.
        if _mark_ends(t, begin, at, m.group(), end, stop, -1):
            add(begin, end)
            begin = at = _after(text, end, stop)
        else:
            at = end
    if begin < stop:
        add(begin, stop)


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the units of a text in code points; none for null, empty and blank texts.

    All text but white space lies in exactly one unit, and no unit has white space at its edges.
    """
    units: list[tuple[int, int]] = []
    if not text:
        return units

    def add(start: int, end: int) -> None:
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start:
            units.append((start, end))

    at, whole = 0, _Text(text)
    for gap in _BLANK_LINE.finditer(text):
        _block_units(whole, at, gap.start(), add)
        at = gap.end()
    _block_units(whole, at, len(text), add)
    return units


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos) of every unit of every document. Works row by row, without a shuffle; other columns are not read."""

    def units(batches):
        for batch in batches:
            keys, starts, ends = [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sentence_units(body)
                keys += [doc] * len(found)
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(units, "doc_id long, start_pos long, end_pos long")
