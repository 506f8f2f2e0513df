"""Sentence ends of subtitle texts in many languages and scripts.

Document-centred disambiguation: whether a word with a full stop is an abbreviation, and whether a capitalised word is a
name, is taken from its unambiguous occurrences elsewhere in the document, then from counts over the corpus, last from
short lists of fixed values. Each script has its own terminators. Cues only cut the stream: a sentence may run through
several, and what no mark closes ends with its cue or speaker unless it plainly runs on.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import shipped
from .repair import repair

#: Least rows of a table of counts; one that is filled by hand has a row for each hash of so many.
BUCKETS = 1 << 17
KINDS = 8
CLOSED, OPEN, FIRST_AFTER_CLOSED, FIRST_AFTER_OPEN, STOP_INSIDE, STOP_FINAL, COMMON, NAME = range(KINDS)

# Abbreviations before a name, in lower case without the last full stop.
TITLES = set(
    """dr prof mr mrs ms st sgt capt lt col gen rev hon sr sra srta dra ud mme mlle m mm hr fr fa frl herrn
    bzw vgl ggf z.b d.h u.a u i.e e.g vs déc janv févr avr juil sept oct nov dec jan feb aug ee uu ej p.ej т т.е проф г гр ул д
    тов акад cf डॉ प्रो श्री د أ م พ.ศ ค.ศ น ดร j.-p jr""".split()
)
# Abbreviations before a number; before a capital they may end a sentence.
NUMBERED = set("no nr núm num pág p art fig vol ch abs env approx aprox ca h стр см kap s".split())
# Abbreviations that may end a sentence before a capital.
CLOSERS = set("""a.m p.m am pm etc ltd inc co corp cie usw usf cía s.a u.n.r u.s u.k gmbh т.д т.п др bc ad bros""".split())
_LISTED = TITLES | NUMBERED | CLOSERS
# Those of firms, after which initials name their legal form.
FIRMS = set("cía cie co corp inc ltd bros gmbh".split())
# What a speaker says while hesitating, before an ellipsis that does not end the sentence.
HESITATIONS = set(
    """i well um uh er eh oh hmm mm so look bueno pues este bien ben euh alors bon äh ähm tja naja nun also ну э эм так
    अच्छा खैर तो حسنا حسناً طيب يعني เอ่อ อืม あの あのう ええと えっと まあ その 那个 这个 嗯 呃""".split()
)
# Those of scripts without spaces, which have no word before them.
_HESITANT = ("那个", "这个", "あの", "えっと", "ええと", "เอ่อ", "嗯", "呃")
# Verbs by which a quotation is part of the sentence around it.
REPORT = re.compile(
    r"\b(?:shout(?:ed|s)|said|says|ask(?:ed|s)|yell(?:ed|s)|cri(?:ed|es)|call(?:ed|s)|whispered|replied|answered|rief|sagte|fragte|schrie|gritó|dijo|preguntó|susurró|cria|dit|demanda|murmura|"
    r"крикнула?|сказала?|спросила?|прошептала?|قال(?:ت)?|صاح(?:ت)?|سأل(?:ت)?|همس(?:ت)?)\b|चिल्लाय[ाी]|बोल[ाी]|पूछा|कहा|喊道|喊|问道|问|说道|说|叫道|ตะโกน|ถาม|พูด|บอก",
    re.I,
)
# How adverts and credits begin or read, folded (lower case, no blanks, 0 as o, 1 and | as l).
CREDITS = re.compile(
    r"^(?:subtitl|untertite|sous-titr|перевод|субтитр|字幕|翻译|翻訳|subtítul|subtitul|legenda|traduc|translat|sync|ripped|encoded|corrected|captioned|adverti|ratethissub|getthe.*app|downl?oad)"
    r"|freesubs|helpothers|watcheverywhere|presents=|^==|wrongsreserved|allrightsres|&friends|[?�]{3,}:|ترجمة:|अनुवाद:|คำบรรยาย"
)
_URL = r"(?:https?://\S+|www\.\S+|[\w-]+(?:\s?\.\s?)(?:example|invalid|com|net|org|info|tv|io|me)\b(?:/\S*)?)"
_ONLY_URL = re.compile(rf"^[\W_]*{_URL}[\W_]*$", re.I)
_HAS_URL = re.compile(_URL, re.I)
_LOST_CREDIT = re.compile(r"^[?�]{3,} ?:?\s?[A-Za-z]")

_MARKUP = re.compile(r"[<{﻿​-‏‪-‮](?:(?<=<)/?[a-zA-Z][^<>\n]*>|(?<=\{)\\[^{}\n]*\}|(?<=\{)[a-z]:[^{}\n]*\}|(?<=[﻿​-‏‪-‮]))")
_PAIRS = dict(zip("])）］】", "[(（［【", strict=True))
_PAIR_MARK = re.compile(r"[\[\]()（）［］【】]")
_SHOWN = re.compile("[^\x00]")
_STAR, _NOTE = re.compile(r"\*+"), re.compile("[♪♫](?:(?<=♪)[～~]|[♪♫]*)")
#: Between notes that were lost: nothing else stands between such marks and blanks without a mark of its own.
_LOST_NOTE = re.compile(r"�(?<![^\s\x00]�) [^�.!?…\n\x02]+ �(?=[ \r\x00]*(?:\n|\x02|\Z))")
_BRACKET = re.compile(r"[\[(（［【*♪♫]")
_FOLD = {ord(c): None for c in " \t\r\n\x00\u00a0"} | {ord(a): b for a, b in ("0o", "1l", "|l", "ąa", "ęe", "ćc", "ńn")}
_SPEAKER = re.compile(r"[\x00 \t]*[-–—‐]?[\x00 ]*(?:[^\W\d_][^\W\d_.]*(?: ?\d{1,2})?) ?[:：](?=[\x00\s]*[^\s\x00])")
_COLON = re.compile("[:：]")
_DASH = re.compile(r"[-–—‐](?!>)(?:(?=[\x00 \t]*[^\s\x00\d-])| ?(?=\d))")
_BEFORE_LETTER = re.compile(r"[\x00 \t]*(?=[^\s\x00\d-])")

_TERM = "[.!?…。！？｡؟।॥．‼⁇⁉⁈|]"
_TERMS = _TERM[1:-1]
_AFTER_WHOLE = frozenset(_TERMS + "\"”»」』“")
#: A verb of saying is looked for in so many words after a quotation, or so many signs of a script without spaces.
WORDS_AHEAD, SIGNS_AHEAD = 5, 24
_BARE = r"[^.!?…。！？｡؟।॥．|\x03\"“«「\s\x00\x02]+"
_GAP = r"(?:[.…]*[\s\x00]*\x02[\s\x00\x02]*[.…]*|[\s\x00]+)"
_AHEAD = re.compile(rf"[\x00 \n]*(?:{_GAP})?{_BARE}(?:{_GAP}{_BARE}){{0,{WORDS_AHEAD - 1}}}")
_GAPS = re.compile(_GAP)
_CLOSE = "[\"'”’»›」』】〉》)\\]“‚‘]"
# patterns begin with one class or character, which is looked for fast; what stands before is looked back at
_TOKEN = re.compile(rf"([{_TERMS}\x02\x03](?:(?<![\x02\x03])(?:[\x00 ]?{_TERM})*|))((?<![\x02\x03])(?:\x00*{_CLOSE}|[\x00 \u00a0\u202f]+»)*(?:�(?!\w))?|)")
_QUOTE = re.compile("[“”„«»「」『』《》\"\x03]")
_WCH = r"[\w\u0300-\u036f\u064b-\u0652\u0900-\u0963\u0e00-\u0e4e]"
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞА-ЯЁ]")
_AFTER_LETTER = re.compile(r"[!?,;:…](?!\w)")
_AFTER_PLAIN = re.compile(r"[!?,;:…](?!\w)|[ \n]+[a-zß-öø-ÿа-яё]")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-ÞА-ЯЁ][A-ZÀ-ÖØ-ÞА-ЯЁ]")
_CUE_BREAK = re.compile("\x02")
_LOWER = re.compile("[a-zß-öø-ÿа-яё]")
_LOST_Q = re.compile(r"\?(?<=[^\W\d_]\?)[a-zа-я]")
_LOST_R = re.compile(r"�(?<=[^\W\d_]�)[a-zа-я]")
# quotations whose marks were lost: after a colon, or set off by blanks; inside, such a mark touches a word
_LOST_QUOTE_R = [
    re.compile(r":\s?(�)(?=\w)(?:[^�\x03]|(?<=\w)�|�(?=\w))*?[.!?…]�(?!\w)"),
    re.compile(r"(�)(?<!\w�) (?=\w)(?:[^�\x03]|(?<=\w)�|�(?=\w))*?[.!?…] �(?=[\s\x02]|\Z)"),
]
_LOST_QUOTE_Q = [re.compile(r":\s?(\?)(?=\w)(?:[^?\x03]|(?<=\w)\?|\?(?=\w))*?[.!…]\?(?!\w)")]
_LAST_STOP = re.compile(r"\.(?<!\.\.)[\x00\s]*\x02")
_TURN_STOP = re.compile(r"\.(?<!\.\.)[\x00\s\x02]*(?:\x03|\Z)")
_QUOTE_MARK = re.compile("[“”„«»「」『』《》\"]")
_NEXT = re.compile(r"[\s\x00\xa0]*")
_VISIBLE = re.compile(r"[^\W_]")
_LETTERS = re.compile(r"[^\W_]*")
_INITIALS = re.compile(r"[^\W\d_]\.")
_SPELT = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_DOTS_ON = re.compile(r"\.\.+[^\W\d_]|…[^\W\d_]")
_OPENERS = "\"'“”„«‹「『《¿¡([（�-–—"
_NOSPACE = re.compile("[฀-๿぀-ヿ㐀-鿿ｦ-ﾟ]")
_STOP = re.compile(r"\.(,[,\s]*|\s[,\s]*(?![A-ZÀ-ÖØ-ÞА-ЯЁ]))(\S)")
_ENDS = frozenset(".!?…。！？｡؟।॥．‼⁇⁉⁈|\"'”’»›」』】〉》“‚‘")
_PUNCT = ".,;:!?…。！？｡؟।॥．‼|\"'”’»›«‹「」『』【】〉》《“„‚‘()[]（）［］*♪#=<>-–—،、，؛·~～\ufeff\u200b"


_MEMO: dict[str, int] = {}


def _bucket(word: str) -> int:
    k = _MEMO.get(word)
    if k is None:
        if len(_MEMO) > 100_000:  # only a memo: what it forgets is computed again
            _MEMO.clear()
        k = _MEMO[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) & (BUCKETS - 1)
    return k


_KEYS: dict[str, int] = {}


def _key(word: str) -> int:
    """60 bits of a hash: among a thousand million words two that share one are rare."""
    k = _KEYS.get(word)
    if k is None:
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        k = _KEYS[word] = int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=8).digest()) >> 4
    return k


_EDGES: tuple[dict[str, str], dict[str, str]] = {}, {}


def edge_word(text: str, last: bool) -> str:
    """The last or first word of text; of scripts without spaces its two characters."""
    words = text.rsplit(None, 1) if last else text.split(None, 1)
    if not words:
        return ""
    shown = words[-last]
    known = _EDGES[last].get(shown)
    if known is not None:
        return known
    w = shown.strip(_PUNCT)
    found = bool(w)
    if not found:
        words = text.rsplit(None, 3) if last else text.split(None, 3)
        w = next(filter(None, (x.strip(_PUNCT) for x in (reversed(words) if last else words))), "")
    if w and "\u0e00" <= w[-1] and _NOSPACE.search(w):
        w = w[-2:] if last else w[:2]
    if found and len(shown) < 32:
        if len(_EDGES[last]) > 100_000:  # only a memo, as above
            _EDGES[last].clear()
        _EDGES[last][shown] = w
    return w


#: A timing line, with the number line before it, as nearly all are written.
_CUE = re.compile("\n(?:(\\d+)[ \t\r]*\n)?[\ufeff \t]*\\d[^\n:>]*:[^\n>]*->[^\n]*(?:\n|\\Z)")


def _content_end(text: str, begin: int, a: int) -> int:
    """Where the text of a cue ends that begins at begin, before the timing line at a: at its number line if there is one."""
    if a > begin:
        line = text.rfind("\n", begin, a - 1) + 1 or begin
        if text[line : a - 1].strip("\ufeff�? \t\r").isdigit():
            return line
    return a


def cue_spans(text: str) -> list[tuple[int, int]]:
    """Where the text lines of each cue stand: between timing lines, without the number line and outer blanks."""
    spans, begin, n = [], 0, len(text)
    for m in _CUE.finditer("\n" + text):
        a, e = m.span()
        spans.append((begin, a if m.start(1) > 0 else _content_end(text, begin, a)))
        begin = e - 1
    if text.count("->") == len(spans):  # each arrow stands in a line of its own that was found
        spans.append((begin, n))
        return spans
    spans, begin = [], 0
    find, back = text.find, text.rfind
    k = find("->")
    while k >= 0:
        a = back("\n", begin, k) + 1 or begin
        e = find("\n", k)
        if e < 0:
            e = n
        if find(":", a, e) >= 0 and text[a:e].lstrip("\ufeff \t")[:1].isdigit():
            spans.append((begin, _content_end(text, begin, a)))
            begin = e + 1
        k = find("->", e)
    spans.append((begin, n))
    return spans


def _cue_bodies(text: str) -> list[str]:
    """The text of each cue, perhaps with blanks around it."""
    parts = _CUE.split("\n" + text)
    if text.count("->") == len(parts) // 2 and None not in parts:
        return parts[::2]
    return [text[a:b] for a, b in cue_spans(text)]


def script(ch: str) -> str:
    """Block of a letter, as the key of its script's totals."""
    c = ord(ch)
    return "han" if 0x3400 <= c <= 0x9FFF else "kana" if 0x3040 <= c <= 0x30FF else f"block{c >> 8}"


class Stats:
    """Corpus counts by word: rows of KINDS numbers, found by the sorted keys of their words; without keys by bucket."""

    def __init__(self, counts: np.ndarray | None = None, keys: np.ndarray | None = None):
        self.counts = np.zeros((BUCKETS, KINDS), np.int64) if counts is None else counts
        self.keys, self._found, self._stops = keys, {}, {}

    def get(self, word: str) -> list[int]:
        if self.keys is None:
            return self.counts[_bucket(word)].tolist()
        n = self._found.get(word)
        if n is None:
            if len(self._found) > 50_000:  # only a memo, as above
                self._found.clear()
            k = _key(word)
            i = int(self.keys.searchsorted(k))
            n = self._found[word] = self.counts[i].tolist() if i < len(self.keys) and self.keys[i] == k else [0] * KINDS
        return n

    def stops(self, word: str) -> bool:
        """Whether a full stop after the word mostly stands inside a sentence."""
        known = self._stops.get(word)
        if known is None:
            if len(self._stops) > 50_000:  # only a memo, as above
                self._stops.clear()
            n = self.get(word)
            known = self._stops[word] = n[STOP_INSIDE] >= 5 and n[STOP_INSIDE] > 2 * n[STOP_FINAL]
        return known

    @classmethod
    def of(cls, k: np.ndarray, n: np.ndarray) -> Stats:
        """From counts n of k, which are key * KINDS + kind."""
        keys, row = np.unique(k // KINDS, return_inverse=True)
        counts = np.zeros((max(BUCKETS, len(keys)), KINDS), np.int64)
        counts[row, k % KINDS] = n
        return cls(counts, keys)


def _line_word(s: str, i: int) -> int:
    """Where the word before i begins at the earliest: after the last blank or break of lines."""
    a = s.rfind("\n", 0, i) + 1
    return s.rfind(" ", a, i) + 1 or a


def _dots(text: str, cased: Callable[[int], bool] | None = None) -> Iterator[str]:
    """Words whose full stop cannot end a sentence: a comma, digit or small letter (where cased) follows. Capitals prove nothing."""
    for m in _STOP.finditer(text):
        nxt = m[2]
        if m[1][0] == "," or nxt.isdigit() or nxt.islower() and (cased is None or cased(m.start(2))):
            i = m.start()
            words = text[_line_word(text, i) : i].rsplit(None, 1)
            w = words[-1].lstrip(_PUNCT) if words else ""
            if w and w[0].isalpha() and w[-1] != ".":
                yield w.lower()


def gather_words(text: str, seen: list[list[str]]) -> None:
    """Adds the document's words, and scripts of words (after a \x00), to the lists of their kinds."""
    closed_last, open_last, closed_first, open_first, inside, final, common, name = seen
    before, w = "", None
    for body in _cue_bodies(text):
        body = body.strip()
        if not body:
            continue
        end, last = before[-1:], None
        k = body.find(".")
        if k >= 0:
            if k < len(body) - 1 and _STOP.search(body, k):
                inside += _dots(body)
            if body[-1] == ".":
                last = edge_word(body, True)
                final.append(last)
        if before and end not in ">])）]】♪*=～":
            first = body[0]
            closed = end in _ENDS and first not in ".…"
            if w is None:
                w = edge_word(before, True)
            if w and (closed or first not in "-–—[(♪*"):
                (closed_last if closed else open_last).append(w)
                if w.islower():
                    common.append(w)
            if first not in "-–—[(（♪*<":
                v = edge_word(body, False)
                if v:
                    if closed:
                        closed_first.append(v)
                        closed_last.append("\x00" + v[0])
                    else:
                        open_first.append(v)
                        open_last.append("\x00" + v[0])
                    if v.islower():
                        common.append(v)
                    elif v[0].isupper() and end.islower() and not v.isupper():
                        name.append(v)
        before, w = body, last


def add_counts(seen: list[list[str]], into: dict[int, int], key: Callable[[str], int]) -> None:
    """Adds the gathered words to into, keyed key(word) * KINDS + kind, and empties the lists."""
    for kind, words in enumerate(seen):
        for w, n in Counter(words).items():
            if w[:1] == "\x00":
                w = "\x00" + script(w[1])
            k = key(w) * KINDS + kind
            into[k] = into.get(k, 0) + n
        words.clear()


def count_words(text: str, into: dict[int, int], key: Callable[[str], int] = _bucket) -> None:
    """Adds the document's evidence to into."""
    seen: list[list[str]] = [[] for _ in range(KINDS)]
    gather_words(text, seen)
    add_counts(seen, into, key)


_NO_BREAK = re.compile(r"[^\n\x02]")


def _blanked(s: str) -> str:
    return _NO_BREAK.sub("\x00", s) if "\n" in s or "\x02" in s else "\x00" * len(s)


def _blank(m: re.Match) -> str:
    return _blanked(m[0])


def _blank_spans(s: str, spans: list[tuple[int, int]]) -> str:
    """s without what stands in spans (first, after last); spans may nest."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            a = max(a, at)
            out += [s[at:a], _blanked(s[a:b])]
            at = b
    return "".join([*out, s[at:]])


def _turns(s: str) -> bool:
    """Whether another speaker begins in one of the lines after the first."""
    k = s.find("\n")
    return k >= 0 and (next(_dashes(s, k + 1), None) or next(_labels(s, k + 1), None)) is not None


def _bracketed(s: str) -> list[tuple[int, int]]:
    """Balanced brackets, also over breaks of cues unless another speaker begins inside."""
    opened, found = {o: [] for o in _PAIRS.values()}, []
    for m in _PAIR_MARK.finditer(s):
        k, ch = m.start(), m[0]
        if ch in opened:
            opened[ch].append(k)
        elif opened[_PAIRS[ch]]:
            o = opened[_PAIRS[ch]].pop()
            if "\x02" not in (inner := s[o : k + 1]) or not _turns(inner):
                found.append((o, k + 1))
    return found


def _between(s: str, mark: re.Pattern) -> list[tuple[int, int]]:
    """What stands between two marks that look alike, also over breaks of lines and cues unless another speaker begins inside.

    A mark that only can open puts an earlier one without partner aside. Where both its sides are alike the mark closes what
    is open; one that stands alone in its line opens nothing.
    """
    found, held = [], None
    for m in mark.finditer(s):
        a, b = m.span()
        if mark is _NOTE and len(m[0]) > 1:
            continue  # with nothing between, or the sign that music begins: whole by itself
        before, after = s[:a].rstrip("\x00")[-1:] if a and s[a - 1] == "\x00" else s[a - 1 : a], s[b : b + 1]
        if after == "\x00":
            after = _SHOWN.search(s, b)
            after = after[0] if after else ""
        first, final = before in ("", "\n"), after in ("", "\n", "\r", "\x02")
        if m[0] == "*" and before.isalnum() and after.isalnum() and before.upper() != before.lower() or before.isdigit() and after.isdigit():
            continue  # letters left out of a word, or a product
        opens, closes = first or not (final or after.isspace()), final or not (first or before.isspace())
        if held and (closes or not opens):
            inner = s[held[0] : b]
            if "\n" not in inner or (mark is _NOTE or held[1] and closes) and not _turns(inner):
                found.append((held[0], b))
                held = None
                continue
        held = (a, opens) if (opens or not closes) and not (first and final) else None
    return found


_HEAD = re.compile(
    r"[\W_]*(?:(?=[slrtcgdvпс字翻تअค]|.[nd])(?:s.bt|.nt.rt|s..s-|перев|субт|字幕|翻|l.g.nd|tr.d|t ?r ?. ?n ?s|s.nc|r.pp|.nc.d|c.rr.ct|c.pt|.dv.rt|r.te th|g.t t|d.wn|v.s.t|ترجمة|अनुवाद|คำบรร)|https?:|www\.)|[?�]{3}|\W?=",
    re.I,
)
_TLD = re.compile(r"\.\s?(?:example|invalid|com|net|org|info|tv|io|me)\b")


def _is_credit(raw: str) -> bool:
    url = "." in raw and _TLD.search(raw)
    if not (url or _HEAD.match(raw) or "&" in raw or "==" in raw):
        return False
    plain = raw.replace("\x00", "").strip()
    if not plain:
        return False
    if CREDITS.search(plain.translate(_FOLD).lower()) or url and _ONLY_URL.match(plain):
        return True
    if _LOST_CREDIT.match(plain) and (url or plain.lstrip("?� ")[:1] == ":"):
        return True
    return bool(url and re.search(r"\b(?:free|subs?|subtitles?|app|download|visit|advertise|sync\w*)\b", plain, re.I))


class Stream:
    """The spoken text of all cues joined: text, and places(ends): where they are in the document.

    Unspoken characters are \\x00, cues are parted by \\x02 and a new line, speakers by \\x03 in place of their mark.
    """

    __slots__ = ("text", "_own", "_there")

    def __init__(self, text: str):
        marked_up = "<" in text or "{" in text or "\ufeff" in text or "\u200b" in text
        bodies, there = [], []
        for a, b in cue_spans(text):
            cut = text[a:b].rstrip()
            if not cut or cut[-1].isdigit() and cut.strip().isdigit():
                continue
            bodies.append(_MARKUP.sub(_blank, cut) if marked_up else cut)
            there.append(a)
        head, tld = _HEAD.match, _TLD.search
        odd, url = "&" in text or "==" in text, "." in text and tld(text)
        if odd or url:
            spoken = [not ((head(c) or odd and ("&" in c or "==" in c) or url and "." in c and tld(c)) and _is_credit(c)) for c in bodies]
        else:
            spoken = [not (head(c) and _is_credit(c)) for c in bodies]
        if not all(spoken):
            bodies, there = list(compress(bodies, spoken)), list(compress(there, spoken))
        s = "\x02\n".join(bodies)
        own = list(accumulate((len(c) + 2 for c in bodies), initial=0))[:-1]
        if _BRACKET.search(s):
            s = _blank_spans(s, _bracketed(s))
            if "*" in s:
                s = _blank_spans(s, _between(s, _STAR))
            if "♪" in s or "♫" in s:
                s = _NOTE.sub(_blank, _blank_spans(s, _between(s, _NOTE)))
        if "� " in s:
            s = _LOST_NOTE.sub(_blank, s)
        if ":" in s or "：" in s:
            s = _marked(s, _labels(s))
        s = _marked(s, _dashes(s))
        self.text, self._own, self._there = s, own, there

    def marked(self) -> bool:
        """Whether marks close most of the cues."""
        ends = [p.rstrip("\x00 \r\n\t")[-1:] for p in self.text.split("\x02\n")]
        ends = [e for e in ends if e]
        return 2 * sum([e in _ENDS for e in ends]) > len(ends)

    def places(self, ends: list[int]) -> list[int]:
        """Places in the document of ascending positions in the text."""
        own, there, out, k, n = self._own, self._there, [], 0, len(self._own)
        for i in ends:
            while k + 1 < n and own[k + 1] <= i:
                k += 1
            out.append(i - own[k] + there[k])
        return out


def _labels(s: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """Where names of speakers stand at the beginning of lines, from at on."""
    done = -1
    for m in _COLON.finditer(s, at):
        a = s.rfind("\n", 0, m.start()) + 1
        if a < at or a == done:
            continue
        done = a
        m = _SPEAKER.match(s, a)
        if m:
            name = m[0].strip("\x00 \t\r\n-–—‐:：")
            if name and not (name[0].islower() and name.upper() != name):
                yield m.span()


def _dashes(s: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """Where dashes of speakers stand at the beginning of lines, from at on."""
    for m in _DASH.finditer(s, at):
        a, k = m.start(), m.start()
        while a > 0 and s[a - 1] in "\x00 \t":
            a -= 1
        if (a == 0 or s[a - 1] == "\n") and a >= at:
            yield a, (_BEFORE_LETTER.match(s, k + 1) or m).end()


def _marked(s: str, spans: Iterator[tuple[int, int]]) -> str:
    """s with a break of speakers in place of the spans."""
    out, last = [], 0
    for a, b in spans:
        out += [s[last:a], "\x03", "\x00" * (b - a - 1)]
        last = b
    return "".join([*out, s[last:]]) if out else s


def _styles(s: str, breaks: list[int]) -> str:
    """A sign for each cue. n: capitals and small letters as usual, s: small letters only, c: mostly capitals; - if too few letters tell."""
    cues = s.split("\x02")
    cased = zip(cues, s.lower().split("\x02"), s.upper().split("\x02"), strict=True)
    out = [("n" if cue != large else "-") if cue != small else "s" if small != large else "-" for cue, small, large in cased]
    m = _CAPITALS.search(s)
    while m:
        k = bisect_right(breaks, m.start())
        out[k] = "c" if len(_UPPER.findall(cues[k])) > len(_LOWER.findall(cues[k])) else "n"
        m = _CAPITALS.search(s, breaks[k]) if k < len(breaks) else None
    return "".join(out)


#: Cues before and after one that tell with it how the text around is written.
NEAR = 20


def _cased_cue(styles: str, k: int) -> bool:
    """Whether the cues around the k-th are written with capitals and small letters as usual."""
    a, b = max(0, k - NEAR), k + NEAR + 1
    n, s, c = styles.count("n", a, b), styles.count("s", a, b), styles.count("c", a, b)
    return n > 0 and n >= c and n + 1 >= s + c  # cues in small letters may go on from others


class _Doc:
    """One document being cut."""

    def __init__(self, stream: Stream, stats: Stats):
        s = stream.text
        self.s, self.stats, self._stream = s, stats, stream
        self._breaks = [m.start() for m in _CUE_BREAK.finditer(s)]
        self._styles = self._marked = self._closing = self._final = None
        self._cased: dict[int, bool] = {}
        # the document's own evidence of stops inside sentences
        self.inside = set(_dots(s, self.cased)) if "." in s else set()
        self.lower, self._plain = None, {}
        self.lost = "?" if "?" in s and _LOST_Q.search(s) else "�" if "�" in s and _LOST_R.search(s) else ""
        self.spans = self._quotes() if _QUOTE_MARK.search(s) else []
        if self.lost == "?" or "�" in s:
            self.spans = sorted([*self.spans, *self._lost_quotes()])

    def cased(self, i: int) -> bool:
        """Whether sentences begin with capitals, and only they and names do, around the cue of position i."""
        k = bisect_right(self._breaks, i - 1)
        known = self._cased.get(k)
        if known is None:
            if self._styles is None:
                self._styles = _styles(self.s, self._breaks)
            known = self._cased[k] = _cased_cue(self._styles, k)
        return known

    @property
    def final(self) -> set[str]:
        """Words before a stop that ends a cue."""
        if self._final is None:
            self._final = {_word(self.s, m.start()).lower() for m in _LAST_STOP.finditer(self.s)}
        return self._final

    @property
    def marked(self) -> bool:
        """Whether marks close most of the cues."""
        if self._marked is None:
            self._marked = self._stream.marked()
        return self._marked

    def closes_turn(self, low: str) -> bool:
        """Whether the document has the word before a stop that closes a turn or the text, where a title cannot stand."""
        if self._closing is None:
            self._closing = {_word(self.s, m.start()).lower() for m in _TURN_STOP.finditer(self.s)}
        return low in self._closing

    def _shown_end(self, i: int) -> int:
        """End of what is shown before i in the same line."""
        s = self.s
        while i > 0 and s[i - 1] in "\x00 \u00a0\t":
            i -= 1
        return i

    def _shown_before(self, i: int) -> str:
        s, k = self.s, i - 1
        while k >= 0 and s[k] in "\x00 \n":
            k -= 1
        return s[k] if k >= 0 else ""

    def is_lower(self, word: str) -> bool:
        """Whether the document has the word in lower case, so it is no name."""
        if self.lower is None:
            self.lower = set(re.findall(r"[a-zà-öø-ÿа-яё’']{2,}", self.s))
        return word.lower() in self.lower

    def is_name(self, word: str) -> bool:
        """Whether the document has the word with a capital after a word in small letters or a comma, so it may be a name."""
        return bool(re.search(rf"[a-zß-öø-ÿа-яё,;][ \n]+{re.escape(word)}\b", self.s))

    def is_plain(self, w: str) -> bool:
        """Whether the document has w without a stop and not as a title: before a small letter or another mark; of single
        letters, which may be prepositions, only before a mark."""
        known = self._plain.get(w)
        if known is None:
            s, follows = self.s, _AFTER_LETTER if len(w) == 1 else _AFTER_PLAIN
            known = False
            for form in {w} if len(w) == 1 else {w, w[0].lower() + w[1:], w[0].upper() + w[1:]}:
                k = s.find(form)
                while k >= 0 and not known:
                    known = bool(follows.match(s, k + len(w))) and not (k and (s[k - 1].isalnum() or s[k - 1] in "_.'’-")) and self.cased(k)
                    k = s.find(form, k + 1)
            self._plain[w] = known
        return known

    def after(self, i: int) -> int:
        ch = self.s[i : i + 1]
        return i if ch.isalnum() or ch == "\x02" else _NEXT.match(self.s, i).end()

    def _before(self, i: int) -> str:
        """Last visible character before i in the same cue stream, '' at a break of speakers or the start."""
        s, k = self.s, i - 1
        while k >= 0 and (s[k] == "\x00" or s[k] == "\x02" or s[k].isspace()):
            k -= 1
        return "" if k < 0 or s[k] == "\x03" else s[k]

    def _quotes(self) -> list[tuple[int, int, bool, bool]]:
        """(open, close, opened inside a sentence, sentence goes on after it), by opening."""
        s, stack, found = self.s, [], []
        close_of = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》"}
        for m in _QUOTE.finditer(s):
            q, i = m[0], m.start()
            if q == "\x03":
                stack.clear()
                continue
            if q == '"':
                prev = s[i - 1] if i else " "
                opening = (prev in " \n\r\t\x00\x02\x03-–—¿¡(\"“" or not stack) and self._opens(i)
                if not opening and stack and stack[-1][0] == '"':
                    found.append((stack.pop()[1], i))
                elif opening:
                    stack = self._opened_anew(stack, '"', i)
                    stack.append(('"', i))
                continue
            if stack and q in stack[-1][0] and not (q == "“" and self._opens(i) and not stack[-1][0].startswith("“")):
                found.append((stack.pop()[1], i))
            elif q in close_of:
                stack = self._opened_anew(stack, close_of[q], i)
                stack.append((close_of[q], i))
            elif any(q in c for c, _ in stack):
                while q not in stack[-1][0]:
                    stack.pop()
                found.append((stack.pop()[1], i))
        out = []
        for o, c in sorted(found):
            prev = self._before(o)
            mid = bool(prev) and prev not in _AFTER_WHOLE and not (prev in "¿¡-–—“«「『„\"" and self._fresh(o))
            out.append((o, c, mid, self._goes_on(o, c, mid)))
        return out

    def _lost_quotes(self) -> list[tuple[int, int, bool, bool]]:
        """As _quotes, of quotations whose marks were lost: after a colon, or set off by blanks."""
        out = []
        for pattern in _LOST_QUOTE_Q if self.lost == "?" else _LOST_QUOTE_R:
            for m in pattern.finditer(self.s):
                o, c = m.start(1), m.end() - 1
                mid = self.s[m.start()] == ":"
                out.append((o, c, mid, self._goes_on(o, c, mid)))
        return out

    def _opened_anew(self, stack: list[tuple[str, int]], close: str, i: int) -> list[tuple[str, int]]:
        """stack without a quotation of that kind, and those inside it, that a cue before that of i opened: it has lost its end."""
        k = next((k for k, (c, o) in enumerate(stack) if c == close and self.s.find("\x02", o, i) >= 0), len(stack))
        return stack[:k]

    def _fresh(self, o: int) -> bool:
        """Only openers stand between o and the start of its line."""
        a = max(self.s.rfind("\n", 0, o), self.s.rfind("\x03", 0, o))
        return not _VISIBLE.search(self.s, a + 1, o)

    def _opens(self, i: int) -> bool:
        return i + 1 < len(self.s) and (self.s[i + 1].isalnum() or self.s[i + 1] in "¿¡\"“«„'…�?\x00.")

    def _goes_on(self, o: int, c: int, mid: bool) -> bool:
        """Whether the sentence around the quotation from o to c, opened inside it if mid, goes on after c."""
        s, j = self.s, self.after(c + 1)
        if j >= len(s):
            return False
        ch = s[j]
        if ch == "\x02":
            k = self.after(j + 1)
            while k < len(s) and s[k] == "\x02":
                k = self.after(k + 1)
            if k >= len(s) or s[k] in "\x03":
                return False
            if _NOSPACE.match(s[k]) or not (s[k].isupper() or s[k].islower()):
                return False if self._inner_ended(c) and s[k] not in "とت" else self._reported(k)
            return s[k].islower() and self.cased(k) or (not self.cased(k) and self._reported(k))
        if ch == "\x03":
            return False
        if ch in ",;:—–،、，；":
            return True
        if ch in "\"”»」』）":
            return False
        if not self._inner_ended(c):
            return ch.isalnum() or self._reported(j)
        if s[o] == "《":
            return ch.isalnum()
        if ch == "と":
            return True
        if self.cased(j) and ch.islower():
            return True
        if not self.cased(j) and ch.islower():
            # small letters tell nothing here; what a sentence has begun before its quotation it goes on with
            return mid or self._reported(j) or bool(re.match(r"(?:and|und|y|et|и)\b", s[j : j + 4]))
        # after a full stop in the quotation a capital begins anew, whatever verb follows
        return not (ch.isupper() and self.cased(j) and self._inner_end(c) == ".") and self._reported(j)

    def _inner_end(self, c: int) -> str:
        """The last mark or character of the quotation that closes at c."""
        s, k = self.s, c - 1
        while k >= 0 and (s[k] in "\x00\"”»“」』" or s[k].isspace()):
            k -= 1
        return s[k] if k >= 0 else ""

    def _inner_ended(self, c: int) -> bool:
        end = self._inner_end(c)
        return bool(end) and end in _TERMS

    def _reported(self, j: int) -> bool:
        """A verb of saying stands in the words from j on, before any mark."""
        words = _AHEAD.match(self.s, j)
        if not words:
            return False
        if _NOSPACE.search(words[0]):
            return bool(REPORT.search(_GAPS.sub(" ", words[0]).lstrip(), 0, SIGNS_AHEAD))
        return bool(REPORT.search(words[0]))

    def cut(self) -> list[int]:
        """Positions in s of the last characters of the sentences."""
        s, ends, last = self.s, [], -1
        visible, is_end, lost = _VISIBLE.search, self._is_end, self.lost == "?"
        mute = [(o, c) for o, c, mid, on in self.spans if mid or on]
        ending = {c for o, c, mid, on in self.spans if mid and not on}
        held, mi, nm = [], 0, len(mute)
        for m in _TOKEN.finditer(s):
            i, e = m.span()
            brk = s[i]
            brk = brk if brk == "\x02" or brk == "\x03" else ""
            if i <= last or brk and i == last + 1:
                continue
            while mi < nm and mute[mi][0] < i:
                held.append(mute[mi])
                mi += 1
            if held:
                held = [x for x in held if x[1] >= i]
            if not (i > last + 1 and s[i - 1].isalnum() or i > last + 3 and (s[last + 2].isalnum() or s[last + 3].isalnum()) or visible(s, last + 1, i)):
                continue
            if brk:
                j = i - 1 if s[i - 1].isalnum() else self._last_visible(i)
                if j <= last or brk == "\x02" and (held or self._runs_on(last + 1, j, i)):
                    continue
                ends.append(j)
                last = j
                continue
            first = m.end(1)
            if lost and " ?" in m[1] and s[first : first + 1].isupper():
                # what stands after the blank opens the next sentence
                e = i + m[1].rindex(" ") - 1
                if not held and is_end(last + 1, i, m[1][: e - i + 1], e):
                    ends.append(e)
                    last = e
                continue
            e -= 1
            if e >= first:
                e = self._closers(first, e)
            if held:
                # the end of a quotation closes the sentence around it only if nothing else holds it open
                c = next((k for k in range(first, e + 1) if k in ending), None)
                if c is None or any(x[1] != c for x in held):
                    continue
            if is_end(last + 1, i, m[1], e):
                ends.append(e)
                last = e
        if visible(s, last + 1):
            j = self._last_visible(len(s))
            if j > last:
                ends.append(j)
        return ends

    def _closers(self, a: int, e: int) -> int:
        """Last closing mark from a to e: an opening one that follows without a partner before is not taken."""
        s, last = self.s, a - 1
        for k in range(a, e + 1):
            ch = s[k]
            if ch == "\x00" or ch.isspace():
                continue
            if ch in "\"“‘‚'" and (k + 1 < len(s) and s[k + 1].isalnum()):
                break
            last = k
        return last

    def _last_visible(self, i: int) -> int:
        s, k = self.s, i - 1
        while k >= 0 and (s[k] in "\x00\x02\x03" or s[k].isspace()):
            k -= 1
        return k

    def _is_end(self, a: int, i: int, term: str, e: int) -> bool:
        s = self.s
        t = term if len(term) == 1 else term.replace("\x00", "").replace(" ", "")
        j = e + 1
        nxt = s[j : j + 1]
        if nxt == " " and s[j + 1 : j + 2].isalnum():
            j += 1
            nxt = s[j]
        elif nxt != "\x02" and not nxt.isalnum():
            j = _NEXT.match(s, j).end()
            nxt = s[j : j + 1]
        direct = j == e + 1
        prev = s[i - 1] if i else ""
        unclosed = s[e] == "�" or self.lost == "?" and len(t) > 1 and t[-1] == "?"
        if unclosed and nxt.isalpha() and not direct and self._reported(j):
            return False  # a quotation whose closing mark was lost
        if t == "|":
            return "ऀ" <= self._before(i) <= "ॣ" or not nxt or nxt in "\x02\x03"
        if self.lost == "?" and set(t) == {"?"}:
            if direct and nxt.isalnum():
                return False
            if prev.isspace() or prev in "\x00\x02\x03":
                if i and not re.match(r"[\s\x00]*(?:\Z|[\x02\x03]|[A-ZÀ-Þ])", s[e + 1 : e + 4]):
                    return False
            if nxt.islower() or nxt in ",;:":
                return not nxt
            return nxt != "\x02" or self._next_starts(j)
        if direct and nxt and nxt != "\x02" and nxt != "\x03":
            if t == "." or t == "．":
                if nxt in "“„«「『¿¡" and prev.islower() and s[j + 1 : j + 2].isalpha():
                    return True
                if prev.isdigit() and nxt.isdigit() or not (nxt.isupper() and prev.islower() and len(_word(s, i)) > 1):
                    return False
                return not _HAS_URL.match(s, j) and (self.cased(j) or s[j + 1 : j + 2].islower())
            if set(t) <= {"."} and len(t) > 1 and nxt.isalnum() and (prev in " \n\x00\x02\x03" or nxt.islower()):
                return False
            if nxt in ".,;:،、，":
                return False
        if nxt and nxt in ",;:،、，；)" and nxt != ")":
            return False
        if t != "." and t[0] in ".…" and not t.strip(".…"):
            before = self._shown_end(i)
            w = _word(s, before).lower()
            if not _VISIBLE.search(s, a, i):
                return False
            if w in HESITATIONS or s.endswith(_HESITANT, 0, before) and self._starts(a, i):
                if self._starts(a, i) or w == "i":
                    if nxt and nxt not in "\x02\x03":
                        return False
            if nxt == "\x02":
                return self._next_starts(j, True)
            return not (nxt.islower() and self.cased(j))
        if unclosed and self.cased(i):
            k = self._next_cue(j) if nxt == "\x02" else j
            if k < len(s) and s[k].islower():
                return False  # the sentence around a quotation whose closing mark was lost
        if t != "." and t != "．":
            if nxt == "\x02" or nxt == "\x03" or not nxt:
                return True
            if nxt.islower() and not direct and self.cased(j):
                # a mark before a small letter: a new sentence only after a break of lines that cased texts begin so
                return not (prev.isspace() and e == i)
            return True
        # one full stop
        if not nxt or nxt == "\x03":
            return True
        w = _word(s, i)
        low = w.lower()
        if self.lost and self.lost in low:
            low = self._restored(low) or low
        if nxt == "\x02":
            return not self._abbreviation(low, w, i) or self._closed_by_cue(low, w, j, a, i)
        k = j
        while k < len(s) and not s[k].isalnum() and (s[k] in _OPENERS or s[k] == "\x00" or s[k].isspace()):
            k += 1
        ch = s[k] if k < len(s) else ""
        if ch.islower() and self.cased(k):
            return not self._abbreviation(low, w, i) and "\n" in s[e:k] and s[j] in _OPENERS
        if w.isdigit() and len(w) <= 2 and ch.isalpha() and not re.search(r"[\d][.,]\d*$", s[max(0, i - 4) : i]):
            return False
        if not self._abbreviation(low, w, i):
            return True
        if ch.isdigit():
            return low in CLOSERS and low not in TITLES
        if low in TITLES or (len(w) == 1 and w.isalpha()):
            return False
        if low in NUMBERED:
            return self.cased(i) or not _VISIBLE.search(s, a, i - len(w))
        if not self.cased(i):
            return False
        nw = _LETTERS.match(s, k)[0]
        if low in CLOSERS:
            return not (low in FIRMS and _INITIALS.match(s, k))
        return self._common(nw)

    def _common(self, word: str) -> bool:
        """Whether a word with a capital is no name: by the document, else by the corpus (not where quotations are lost)."""
        lower, name = self.is_lower(word), self.is_name(word)
        if lower or name:
            return lower and not name
        n = self.stats.get(word)
        return not self.lost and n[COMMON] > n[NAME]

    def _closed_by_cue(self, low: str, w: str, j: int, a: int, i: int) -> bool:
        """Whether the cue that breaks at j ends the sentence from a with its last word (before i), an abbreviation: not
        between a title and the name, an abbreviation and its number (a word alone asks for none), or initials."""
        s, k = self.s, self._next_cue(j)
        if k >= len(s) or s[k] == "\x03":
            return True
        if low in NUMBERED and s[k].isdigit():
            return not _VISIBLE.search(s, a, i - len(w))
        if len(w) == 1 and w.isalpha():
            return not (_INITIALS.match(s, k) or s[k].islower() or not self._common(_LETTERS.match(s, k)[0]))
        if low in TITLES:
            return False
        return self._next_starts(j)

    def _starts(self, a: int, i: int) -> bool:
        """The sentence from a has at most two words before i."""
        words = re.findall(r"[^\W_]+", self.s[a:i])
        return len(words) <= 2

    def _abbreviation(self, low: str, w: str, i: int) -> bool:
        """The document first: seen with a stop inside a sentence, or without any where an abbreviation has one; then the
        corpus; then the lists. That a stop ended a cue proves nothing against a listed word: abbreviations end sentences too."""
        if not w or w[0].isdigit():
            return False
        if self.lost and self.lost in w and self._restored(low):
            return True
        if "." in w and _SPELT.fullmatch(w):
            return True
        listed = low in _LISTED or (len(w) == 1 and w.isalpha())
        inside = low in self.inside
        if listed and not inside and not (len(w) == 1 and self._shown_before(i - 1) == ".") and (self.is_plain(w) or low in TITLES and self.closes_turn(low)):
            return False
        if listed:
            return True
        if inside and low not in self.final and not self.is_plain(w):
            n = self.stats.get(low)
            return n[STOP_INSIDE] >= n[STOP_FINAL]
        return self.stats.stops(low)

    def _restored(self, low: str) -> str:
        """The listed abbreviation that low is with its lost letters filled in, or ''."""
        pattern = re.compile("".join("." if c == self.lost else re.escape(c) for c in low))
        return next((x for x in (*TITLES, *NUMBERED, *CLOSERS) if len(x) == len(low) and pattern.fullmatch(x)), "")

    def _next_cue(self, j: int) -> int:
        """Start of the next spoken cue after the break at j; len(s) if none; the index of a speaker break if it starts so."""
        s = self.s
        k = self.after(j + 1)
        while k < len(s) and s[k] == "\x02":
            k = self.after(k + 1)
        return k

    def _next_starts(self, j: int, weak: bool = False) -> bool:
        """Whether the next cue begins a new sentence. weak: the mark before may also be inside a sentence."""
        s, k = self.s, self._next_cue(j)
        if k >= len(s) or s[k] == "\x03":
            return True
        if s[k] in ".…" and _DOTS_ON.match(s[k : k + 5]):
            m = re.match(r"[.…]+", s[k : k + 5])
            c = s[k + m.end()] if k + m.end() < len(s) else ""
            return c.isupper() and self.cased(k) and not weak
        if s[k].islower() and self.cased(k):
            return False
        return True

    def _runs_on(self, a: int, j: int, i: int) -> bool:
        """Whether the utterance from a to j, which no mark closes, goes on after the cue break at i."""
        s, k = self.s, self._next_cue(i)
        if k >= len(s) or s[k] == "\x03":
            return False
        end, ch = s[j], s[k]
        if end in ",;:،、，；–—-":
            return True
        if end == ".":
            w = _word(s, j)
            if self._abbreviation(w.lower(), w, j) and not self._closed_by_cue(w.lower(), w, i, a, j):
                return True
        if ch == "…" or s.startswith("..", k):
            return True
        if ch.islower() and self.cased(k):
            return True
        if ch in "([*♪¿¡":
            return False
        if (end == "�" and not s[j - 1].isspace() or self.lost and end == self.lost) and self.cased(k) and ch.isupper():
            return False  # a closing mark that was lost
        caseless = bool(_NOSPACE.match(ch)) or not (ch.isupper() or ch.islower())
        if ch in "“«„「『《\"" and not self.marked:
            return False
        c = bisect_right(self._breaks, j)
        w = edge_word(s[max(a, self._breaks[c - 1] if c else 0) : j + 1], True)
        c = bisect_right(self._breaks, k)
        v = edge_word(s[k : self._breaks[c] if c < len(self._breaks) else len(s)], False)
        n, f = self.stats.get(w), self.stats.get(v)
        total = self.stats.get("\x00" + script(ch))
        if not self.marked:
            # no marks in this text: a cue ends its utterance unless such a cut is rare on both sides
            few = (total[CLOSED] + total[OPEN]) / 400
            return n[CLOSED] + n[OPEN] < few and f[FIRST_AFTER_CLOSED] + f[FIRST_AFTER_OPEN] < few
        # how much likelier the last word is where marks close an utterance than where none does, and so the next word
        even = (total[OPEN] + 1) / (total[CLOSED] + 1)
        closes = (n[CLOSED] + 0.5) / (n[OPEN] + 0.5) * even
        begins = (f[FIRST_AFTER_CLOSED] + 0.5) / (f[FIRST_AFTER_OPEN] + 0.5) * even
        return closes * begins < 0.5


_BEFORE_WORD = "�?\x00\x02\x03\"'“”„«»¿¡(（「『《-–—.…"


_INSIDE = re.compile("[\x00-\x03\"“”«»„「『《!！？…¿¡(（]+(?=.)|\\?+(?=[A-ZÀ-ÞА-Я])|(?<=[a-zß-öø-ÿа-яё])\\.(?=[A-ZÀ-ÞА-Я])")


def _word(s: str, i: int) -> str:
    """The word that ends right before i, inner full stops included; '' if there is none."""
    k = s.rfind(" ", max(0, i - 24), i)
    if k >= 0 and (w := s[k + 1 : i]).isalnum():
        return w
    words = s[_line_word(s, i) : i].rsplit(None, 1)
    if not words:
        return ""
    w = words[-1].rstrip("\x00")
    if not w or s[i - 1].isspace():
        return ""
    w = w.lstrip(_BEFORE_WORD)
    return w if w.isalnum() else _INSIDE.split(w)[-1]


_NONE = Stats()


def sentence_ends(text: str | None, stats: Stats | None = None) -> list[int]:
    """Positions (code points of text as stored) of the last character of each sentence; NULL and empty texts have none."""
    if not text:
        return []
    fixed = repair(text)
    s = Stream(fixed.text)
    return fixed.ends(s.places(_Doc(s, stats or _NONE).cut()))


def corpus_stats(docs: DataFrame, text: str = "text") -> Stats:
    """Exact counts over all documents, combined in the tasks and by word: KINDS numbers a distinct edge word reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: dict[int, int] = {}
        seen: list[list[str]] = [[] for _ in range(KINDS)]
        gc.disable()  # the work makes no cycles
        for b in batches:
            for k, t in enumerate(b.column(0).to_pylist(), 1):
                if t:
                    gather_words(t, seen)
                if k % 500 == 0:
                    add_counts(seen, into, _key)
        add_counts(seen, into, _key)
        yield pa.RecordBatch.from_arrays([pa.array(into.keys(), pa.int64()), pa.array(into.values(), pa.int64())], names=["k", "n"])

    rows = shipped(docs.select(text)).mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return Stats.of(rows.column("k").to_numpy(), rows.column("n").to_numpy())


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, end_pos): every sentence of every document once.

    Documents with NULL or empty text give no row; repeated rows of a document are taken once each. Whole texts are
    read, however long; each document is cut by itself, so no group of documents meets in a task. The corpus counts are
    gathered first, over all documents, and broadcast (56 bytes a distinct word at the edge of a cue, 7 MB at least).
    """
    found = corpus_stats(docs, text)
    counts = docs.sparkSession.sparkContext.broadcast((found.counts, found.keys))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Stats(*counts.value)
        gc.disable()  # the work makes no cycles
        for b in batches:
            ids, ends = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                e = sentence_ends(t, stats)
                ids += [d] * len(e)
                ends += e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(cut, "doc_id bigint, end_pos bigint")
